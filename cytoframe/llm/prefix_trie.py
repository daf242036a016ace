"""Prefix tries of conversations as double arrays, one per prefix shard.

Equal sequences of turns are counted first. A sequence goes to the shard of its first turns: two, or, where more
than ``most`` turns begin alike, four, eight and so on, so that no shard holds a hot beginning. A shard numbers its
turns densely and packs its trie into BASE and CHECK: the child of slot s by turn t lies in slot BASE[s] + t, and
CHECK of that slot is s. Nodes with most children are placed first, single children fill the gaps. Walking all
sequences through the arrays counts members; a pass from the deepest slots up sums the subtrees.

Nodes below the shard's cut are complete. The upper ones may lie in several shards: their counts are merged by the digest
of their prefix, and what each merged node adds is handed to the upper nodes above it. Turns travel as digests of
16 bytes, whole texts never leave the scan. A conversation's digests are one row; the ids of a node's ending members are
hashed as a stream of sorted ids, never gathered.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), then by the digest of role
and text; rows without conv_id belong to no conversation; conversations without turns are members of the root; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm.common import arrow, table, width, written
from cytoframe.llm.structure_repair import crc32_sql, message_digest

SHARD_TURNS = 200_000
FIRST_CUT = 2


class DoubleArray:
    """A trie over rows of dense turn numbers, packed into BASE and CHECK.

    ``turns`` holds the numbers of all sequences end to end, ``starts`` where each begins (one more at the
    end). Slot 0 is the root. ``levels`` lists the slots of each depth.
    """

    def __init__(self, turns: np.ndarray, starts: np.ndarray) -> None:
        self.turns, self.starts = turns, starts
        self.base = np.zeros(1, dtype=np.int64)
        self.check = np.full(1, -1, dtype=np.int64)
        self.levels = [np.zeros(1, dtype=np.int64)]
        self._free_from = 1
        sizes = np.diff(starts)
        rows, at, depth = np.flatnonzero(sizes > 0), np.zeros(len(sizes), dtype=np.int64), 0
        while len(rows):
            labels = turns[starts[rows] + depth]
            pairs = np.unique(np.stack([at[rows], labels], axis=1), axis=0)
            self._place(pairs)
            at[rows] = self.base[at[rows]] + labels
            self.levels.append(self.base[pairs[:, 0]] + pairs[:, 1])
            depth += 1
            rows = rows[sizes[rows] > depth]

    def _grow(self, size: int) -> None:
        more = size - len(self.check)
        if more > 0:
            more = max(more, len(self.check) // 2)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])

    def _free(self, least: int) -> np.ndarray:
        """At least so many free slots, in order."""
        while True:
            free = np.flatnonzero(self.check[self._free_from :] < 0) + self._free_from
            if len(free) >= least:
                return free
            self._grow(len(self.check) + least)

    def _place(self, pairs: np.ndarray) -> None:
        """Choose BASE of the parents of one level, given as sorted (parent slot, turn)."""
        parents, first, counts = np.unique(pairs[:, 0], return_index=True, return_counts=True)
        for i in np.argsort(-counts, kind="stable")[: int((counts > 1).sum())]:
            labels = pairs[first[i] : first[i] + counts[i], 1]
            reach = int(labels[-1] - labels[0])
            self._grow(self._free_from + reach + 1)
            free = self._free(1)
            for slot in [*free.tolist(), len(self.check)]:
                self._grow(slot + reach + 1)
                slots = slot - labels[0] + labels
                if (self.check[slots] < 0).all():
                    break
            self.base[parents[i]], self.check[slots] = slot - labels[0], parents[i]
        single = counts == 1
        if single.any():
            slots = self._free(int(single.sum()))[: int(single.sum())]
            self.base[parents[single]] = slots - pairs[first[single], 1]
            self.check[slots] = parents[single]
        self._skip_full()

    def _skip_full(self) -> None:
        taken = self.check[self._free_from :] >= 0
        self._free_from += int(np.argmin(taken)) if not taken.all() else len(taken)

    def walk(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Follow all sequences through the arrays: per depth the rows still going, their slots and places in ``turns``."""
        sizes = np.diff(self.starts)
        rows, at, depth = np.arange(len(sizes)), np.zeros(len(sizes), dtype=np.int64), 0
        while len(rows):
            yield depth, rows, at, self.starts[rows] + depth - 1
            going = sizes[rows] > depth
            rows, at = rows[going], at[going]
            slots = self.base[at] + self.turns[self.starts[rows] + depth]
            if (self.check[slots] != at).any():
                raise AssertionError("a packed sequence is not in the arrays")
            at, depth = slots, depth + 1


NODES = (
    "key binary, parent_key binary, above array<binary>, depth long, conv_id long, parent_conv_id long, n_convs long, bytes long, "
    "n_children long, n_leaves long, saved long, ends_sha256 string"
)
_NODE = pa.schema(
    [("key", pa.binary()), ("parent_key", pa.binary()), ("above", pa.list_(pa.binary()))]
    + [(c, pa.int64()) for c in ("depth", "conv_id", "parent_conv_id", "n_convs", "bytes", "n_children", "n_leaves", "saved")]
    + [("ends_sha256", pa.string())]
)


def _shard_nodes(rows: pa.Table) -> pa.RecordBatch:
    """The nodes of one shard's trie; ``key`` is set where other shards may share the node.

    For those, n_children, n_leaves and saved cover the complete nodes below only; for children of
    those, parent_key names the parent and parent_conv_id is left open.
    """
    turns = rows["turns"].combine_chunks()
    starts = np.concatenate([[0], np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    flat = turns.flatten()
    if not len(flat):
        flat = pa.array([], pa.binary())
    coded = flat.dictionary_encode()
    label, digest = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    size_of = rows["bytes"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    copies, smallest, cut = (rows[c].to_numpy().astype(np.int64) for c in ("copies", "conv_id", "cut"))
    ends = rows["ends_sha256"].to_pylist()

    trie = DoubleArray(label, starts)
    slots = len(trie.check)
    n, size, turn = (np.zeros(slots, dtype=np.int64) for _ in range(3))
    least = np.full(slots, np.iinfo(np.int64).max)
    upper = np.zeros(slots, dtype=bool)
    end: dict[int, str] = {}
    lengths = np.diff(starts)
    for depth, going, at, place in trie.walk():
        np.add.at(n, at, copies[going])
        np.minimum.at(least, at, smallest[going])
        upper[at[cut[going] > depth]] = True
        if depth:
            size[at], turn[at] = size_of[place], label[place]
        for row in going[lengths[going] == depth].tolist():
            end[int(at[np.searchsorted(going, row)])] = ends[row]

    children, leaves = np.zeros(slots, dtype=np.int64), np.zeros(slots, dtype=np.int64)
    saved = np.zeros(slots, dtype=np.int64)
    for level in reversed(trie.levels):
        whole = level[~upper[level]]
        leaves[whole] += children[whole] == 0
        saved[whole] += (n[whole] - 1) * size[whole]
        if level is trie.levels[0]:
            break
        up = trie.check[level]
        np.add.at(children, up[~upper[level]], 1)
        np.add.at(leaves, up, leaves[level])
        np.add.at(saved, up, saved[level])

    above: dict[int, list[bytes]] = {}
    columns: dict[str, list] = {name: [] for name in _NODE.names}
    for depth, level in enumerate(trie.levels):
        for slot in level.tolist():
            parent = int(trie.check[slot]) if depth else -1
            shared, below_shared = bool(upper[slot]), depth > 0 and bool(upper[parent])
            if shared:
                chain = above[parent] if depth else []
                key = hashlib.md5((chain[-1] if depth else b"") + (digest[turn[slot]] if depth else b"")).digest()
                above[slot] = [*chain, key]
            values = (
                above[slot][-1] if shared else None, above[parent][-1] if below_shared else None,
                above[slot] if shared else None, depth, int(least[slot]),
                None if below_shared or not depth else int(least[parent]), int(n[slot]), int(size[slot]),
                int(children[slot]), int(leaves[slot]), int(saved[slot]), end.get(slot),
            )
            for name, value in zip(columns, values):
                columns[name].append(value)
    return pa.RecordBatch.from_pydict(columns, schema=_NODE)


def _in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Build a trie whenever a shard's rows, sorted by shard, are complete."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        shards = batch.column("shard").to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
        for a, b in zip(edges, edges[1:]):
            if held and a < b and held[0].column("shard")[0].as_py() != int(shards[a]):
                yield _shard_nodes(pa.Table.from_batches(held))
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield _shard_nodes(pa.Table.from_batches(held))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies, smallest id and digest of the ids of each sequence, from rows sorted by sequence and id."""
    schema = pa.schema([("sequence", pa.binary()), ("copies", pa.int64()), ("conv_id", pa.int64()), ("ends_sha256", pa.string())])
    now = None
    for batch in batches:
        out = []
        for sequence, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now[0] != sequence:
                if now:
                    out.append((*now[:3], now[3].hexdigest()))
                now = [sequence, 0, conv, hashlib.sha256()]
            now[3].update(f",{conv}".encode() if now[1] else str(conv).encode())
            now[1] += 1
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
    if now:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*now[:3], now[3].hexdigest())))], schema=schema)


def _prefix(cut: Column) -> Column:
    """A digest of the first ``cut`` turns of a sequence; the turns are digests of one length."""
    return F.unhex(F.md5(F.array_join(F.transform(F.slice("turns", F.lit(1), cut), F.hex), "")))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """sequence, copies, conv_id (smallest), ends_sha256, turns, bytes: one row each."""
    rows = sequences.withColumn("sequence", _prefix(F.greatest(F.size("turns"), F.lit(1))))
    ids = rows.select("sequence", "conv_id").repartition("sequence").sortWithinPartitions("sequence", "conv_id")
    counted = arrow(ids, _ends, "sequence binary, copies long, conv_id long, ends_sha256 string")
    said = rows.groupBy("sequence").agg(F.first("turns").alias("turns"), F.first("bytes").alias("bytes"))
    return written(counted.join(said, "sequence"), "sequences")


def with_cuts(sequences: DataFrame, most: int) -> DataFrame:
    """Add ``cut``, how many first turns name a sequence's shard: doubled while more than ``most`` turns begin alike."""
    open_, parts, cut = sequences, [], FIRST_CUT
    while True:
        keyed = open_.withColumn("prefix", _prefix(F.lit(cut)))
        hot = keyed.groupBy("prefix").agg(F.sum(F.size("turns")).alias("all"), F.count(F.lit(1)).alias("rows"))
        hot = written(hot.where((F.col("all") > most) & (F.col("rows") > 1)).select("prefix"), "hot")
        if hot.isEmpty():
            parts.append(open_.withColumn("cut", F.lit(cut).cast("long")))
            break
        parts.append(keyed.join(hot, "prefix", "left_anti").drop("prefix").withColumn("cut", F.lit(cut).cast("long")))
        open_ = keyed.join(hot, "prefix", "left_semi").drop("prefix")
        cut *= 2
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def trie_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of the trie of all sequences.

    ``sequences`` has conv_id (long), turns (array of 16-byte digests) and bytes (array of long, as long as ``turns``).
    """
    spark = sequences.sparkSession
    distinct = distinct_sequences(sequences)
    total = distinct.agg(F.sum(F.size("turns"))).first()[0] or 0
    shards = max(width(spark), -(-total // shard_turns))
    dealt = (
        with_cuts(distinct, shard_turns)
        .withColumn("shard", F.pmod(F.xxhash64(_prefix(F.col("cut").cast("int"))), F.lit(shards)))
        .repartition(F.col("shard"))
        .sortWithinPartitions("shard", "sequence")
        .select("shard", "turns", "bytes", "copies", "conv_id", "cut", "ends_sha256")
    )
    nodes = written(arrow(dealt, _in_shards, NODES), "nodes")
    names = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]

    merged = nodes.where("key is not null").groupBy("key").agg(
        *[F.first(c).alias(c) for c in ("parent_key", "above", "depth", "bytes")],
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        F.max("ends_sha256").alias("ends_sha256"),
    )
    merged = written(merged, "upper")
    births = merged.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("born"))
    upper = merged.join(births, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("born", F.lit(0)))
    own = upper.select(
        F.explode("above").alias("key"),
        (F.col("n_children") == 0).cast("long").alias("leaf"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("kept"),
    )
    handed = own.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("kept").alias("kept"))
    upper = (
        upper.join(handed, "key")
        .withColumn("n_leaves", F.col("n_leaves") + F.col("leaf"))
        .withColumn("saved", F.col("saved") + F.col("kept"))
    )
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    rest = nodes.where("key is null")
    below = upper.drop("parent_conv_id").select("parent_key", *[n for n in names if n != "parent_conv_id"])
    below = below.unionByName(rest.where("parent_key is not null").select(*below.columns))
    result = below.where("depth > 0").join(parents, "parent_key").withColumn("parent_conv_id", F.col("parent")).select(*names)
    root = below.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*names)
    return result.unionByName(root).unionByName(rest.where("parent_key is null").select(*names))


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (digests in order) and bytes (of the texts) of every conversation."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turn = F.struct("turn", message_digest(role, text).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return (
        conversations.where("conv_id is not null")
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(turn)).alias("all"))
        .select("conv_id", F.col("all.digest").alias("turns"), F.col("all.bytes").alias("bytes"))
    )


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation c with its first h turns taken from conversation c - c % 5, h = crc32(c) % 9."""
    own = sequences.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int"))
    own = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5)
    donors = sequences.select(F.col("conv_id").alias("base"), F.col("turns").alias("t0"), F.col("bytes").alias("b0"))

    def joined(first: str, rest: str) -> Column:
        head = F.slice(F.coalesce(F.col(first), F.slice(rest, F.lit(1), F.lit(0))), F.lit(1), F.col("h"))
        return F.concat(head, F.slice(rest, F.col("h") + 1, F.greatest(F.size(rest) - F.col("h"), F.lit(0))))

    return own.join(donors, "base", "left").select("conv_id", joined("t0", "turns").alias("turns"), joined("b0", "bytes").alias("bytes"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    nodes = trie_nodes(rebuilt(turn_sequences(rows)))
    return nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).withColumnRenamed("saved", "saved_tokens")


OP11_SQL = f"""
with rows as (
  select conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest,
    strlen(coalesce(text, '')) as bytes
  from conversations where conv_id is not null
), own as (
  select conv_id, list(digest order by turn nulls first, digest) as t, list(bytes order by turn nulls first, digest) as b,
    cast({crc32_sql("cast(conv_id as varchar)")} % 9 as bigint) as h
  from rows group by conv_id
), whole as (
  select o.conv_id, list_concat(coalesce(d.t, [])[1:o.h], o.t[o.h + 1:]) as t,
    list_concat(coalesce(d.b, [])[1:o.h], o.b[o.h + 1:]) as b
  from own o left join own d on d.conv_id = o.conv_id - o.conv_id % 5
), prefixes as (
  select conv_id, len(t) as size, d as depth, case when d > 0 then b[d] else 0 end as bytes,
    array_to_string(t[1:d], '') as key, case when d > 0 then array_to_string(t[1:d - 1], '') end as up
  from (select *, unnest(range(0, len(t) + 1)) as d from whole)
), nodes as (
  select key, any_value(up) as up, any_value(depth) as depth, any_value(bytes) as bytes, min(conv_id) as conv_id,
    count(*) as n_convs,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (depth = size), '')) as ends_sha256
  from prefixes group by key
), born as (select up as key, count(*) as n_children from nodes where up is not null group by up),
subtrees as (
  select p.key, sum((n.n_convs - 1) * n.bytes) as saved, count(*) filter (b.key is null) as n_leaves
  from nodes n left join born b on b.key = n.key join prefixes p on p.conv_id = n.conv_id and p.depth <= n.depth
  group by p.key
)
select n.conv_id, n.depth, u.conv_id as parent_conv_id, n.n_convs, cast(coalesce(b.n_children, 0) as bigint) as n_children,
  s.n_leaves, cast(s.saved as bigint) as saved_tokens, n.ends_sha256
from nodes n join subtrees s using (key) left join nodes u on u.key = n.up left join born b on b.key = n.key
"""
