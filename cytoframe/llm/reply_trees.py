"""Chat formatting of reply trees.

Messages point to the message that they answer. Iterative self-joins double the known stretch of every
path from a leaf to its root, so a tree of depth d takes log2(d) rounds on ids alone. Paths are ranked by the sum
of their scores, and every chosen path is formatted as one conversation with the spans of the loss mask. Only
DataFrame functions; ids are written between the rounds, texts are shuffled twice (to their message, to their path).

A turn is ``<s>[INST] role [/INST]text</s>``. Inside roles and texts a backslash is doubled, and one is put
behind the first character of every control string, so that none is left and reading back is exact.

Defined cases: null roles and texts are empty; a parent that is null or missing makes a root; a loop of parents has
no root, so none of its messages lies on a path; paths of equal score are ranked by the id of their leaf; null
scores are 0; repeated rows are said as often as they occur; an empty table gives no rows; other columns are ignored.
A formatted conversation is one string, so it must stay below 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytoframe.llm.common import table, written
from cytoframe.llm.structure_repair import message_digest

BEGIN, MIDDLE, END = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = r"(<(?=/?s>)|\[(?=/?INST\]))"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reply_paths(messages: DataFrame, keep: int | None = None) -> DataFrame:
    """Root-to-leaf paths: conv_id, leaf, rank, node, rise (steps above the leaf).

    ``messages`` has conv_id, node (unique, not null), parent and score; ``keep`` best paths of each
    conversation stay.
    """
    nodes = written(messages.select("conv_id", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score")), "nodes")
    known = nodes.select(F.col("node").alias("parent"))
    jumps = written(nodes.select("node", "parent").join(known, "parent").select("node", F.col("parent").alias("top")), "jumps")
    leaves = nodes.join(nodes.select(F.col("parent").alias("node")).where("node is not null").distinct(), "node", "left_anti")
    paths = written(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("rise")), "paths")
    parts, reach, total = [paths], 1, nodes.count()
    while not jumps.isEmpty() and reach < total:
        grown = paths.join(jumps, "node").select("leaf", F.col("top").alias("node"), (F.col("rise") + reach).alias("rise"))
        parts.append(written(grown, "paths"))
        paths = paths.unionByName(parts[-1])
        above = jumps.select(F.col("node").alias("top"), F.col("top").alias("far"))
        jumps = written(jumps.join(above, "top").select("node", F.col("far").alias("top")), "jumps")
        reach *= 2
    # a path ends at a root; what hangs from a loop of parents never gets there
    roots = nodes.join(known, "parent", "left_anti").select("node", F.lit(1).alias("root"))
    scored = (
        paths.join(nodes.select("node", "conv_id", "score"), "node")
        .join(roots, "node", "left")
        .groupBy("conv_id", "leaf")
        .agg(F.sum("score").alias("score"), F.max("root").alias("root"))
        .where("root = 1")
    )
    place = Window.partitionBy("conv_id").orderBy(F.desc("score"), "leaf")
    chosen = scored.select("conv_id", "leaf", F.row_number().over(place).alias("rank"))
    if keep is not None:
        chosen = chosen.where(F.col("rank") <= keep)
    return paths.join(chosen, "leaf").select("conv_id", "leaf", "rank", "node", "rise")


def format_paths(messages: DataFrame, keep: int | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row a chosen path: conv_id, leaf, rank, formatted, and per turn its start and masked span in code points.

    ``messages`` has conv_id, node, parent, score, role, text and repeats (how often it is said in a row).
    ``turns`` is an array of (start, loss_start, loss_length), the span null where the turn is not learned.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    head = F.concat(F.lit(BEGIN), escaped(role), F.lit(MIDDLE))
    body = escaped(text)
    said = messages.select(
        "node", "repeats", F.concat(head, body, F.lit(END)).alias("piece"),
        F.when(role == loss_role, F.char_length(head)).alias("skip"),
        F.when(role == loss_role, F.char_length(body)).alias("length"),
    )
    order = Window.partitionBy("leaf").orderBy(F.desc("rise"), "copy")
    chars = F.char_length("piece").cast("long")
    rows = (
        reply_paths(messages, keep).join(said, "node")
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))))
        .withColumn("start", F.sum(chars).over(order) - chars)
    )
    turn = F.struct(
        "start", "piece", (F.col("start") + F.col("skip")).alias("loss_start"), F.col("length").cast("long").alias("loss_length")
    )
    return (
        rows.groupBy("leaf", "conv_id", "rank")
        .agg(F.sort_array(F.collect_list(turn)).alias("all"))
        .select(
            "conv_id", "leaf", "rank",
            F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
            F.transform(
                "all", lambda t: F.struct(t["start"].alias("start"), t["loss_start"].alias("loss_start"), t["loss_length"].alias("loss_length"))
            ).alias("turns"),
        )
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles, texts and learned texts again, from the formatted string and its mask."""
    pieces = F.split("formatted", END)
    end = r" \[/INST\]"

    def parsed(piece: Column) -> Column:
        halves = F.split(F.substr(piece, F.lit(len(BEGIN) + 1)), end, 2)
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    def learned(pair: Column) -> Column:
        turn = pair["turns"]
        first = (turn["loss_start"] - turn["start"] + 1).cast("int")
        return unescaped(F.substr(pair["pieces"], first, turn["loss_length"].cast("int")))

    return (
        formatted.withColumn("pieces", F.slice(pieces, F.lit(1), F.size(pieces) - 1))
        .withColumn("said", F.transform("pieces", parsed))
        .withColumn(
            "learned",
            F.transform(F.filter(F.arrays_zip("pieces", "turns"), lambda p: p["turns"]["loss_length"].isNotNull()), learned),
        )
    )


def as_chain(conversations: DataFrame) -> DataFrame:
    """Rows by turn (null first, then by the digest of role and text) as messages that answer the one before.

    Equal rows of one turn become one message with ``repeats``; only ids are ordered, texts stay where they were hashed to.
    """
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.withColumn("digest", message_digest(F.col("role"), F.col("text")))
    place = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("node", F.unhex(F.md5(F.concat_ws(":", *place, F.hex("digest")))))
    said = rows.groupBy("node").agg(
        F.count(F.lit(1)).alias("repeats"), *[F.first(c).alias(c) for c in ("conv_id", "turn", "digest", "role", "text")]
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    before = rows.select("node", "conv_id", "turn", "digest").distinct().select("node", F.lag("node").over(order).alias("parent"))
    return said.join(before, "node").withColumn("score", F.lit(0.0))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    read = read_back(format_paths(as_chain(conversations.unionByName(probe))))
    turns = F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learned = F.array_join("learned", "")
    return read.select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP12_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered as (
  select *, md5(length(role) || ':' || role || text) as digest,
    length(role) + length(text) + 22
      + (length(role || ' ' || text) - length(replace(role || ' ' || text, chr(92), '')))
      + len(regexp_extract_all(role || ' ' || text, '</?s>|\[/?INST\]')) as chars
  from rows
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, digest)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, digest) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from ordered group by conv_id
"""
