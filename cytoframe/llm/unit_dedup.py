"""Line or paragraph deduplication by global digests.

Texts are cut into units: lines, paragraphs at blank lines, or lines together with their sentences
(``sentence`` and ``passage``), which also finds a passage that stands inside lines. A unit's normal form (lower case, white space folded) is
hashed to 128 bits. Digests are counted over the corpus with map-side combining; only the occurrences of
repeated ones go on. Of each the earliest stays, by the rank columns, then the id, then the position. The
other occurrences are cut out; their character offsets in the original text come along.

``passage`` counts whole lines of any length; ``least_words`` holds only for the sentences of a line of several.
A removed sentence there takes along what stands next to it in its line as next to its earliest occurrence: the
short sentences on both sides, and the shared last words of the next longer sentence before them, where a
passage is glued to the text around it. A sentence that is itself the earliest of a repeated one is never cut.

Defined cases: units without text always stay, and so do those of fewer than ``least_words`` words (but for
lines in ``passage``); a null text
is the empty text; null ids and ranks order last; rows that agree in id and text are one document given
repeatedly, and lose the same units; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Set

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm.common import arrow, table, whole, written

SPACE = re.compile(r"[\t\n\x0b\f\r ]+")
LINES = re.compile(r"\n")
UNITS = {"line": LINES, "paragraph": re.compile(r"\n[\t\r ]*\n\s*"), "sentence": LINES, "passage": LINES}
CUT_LINES = ("sentence", "passage")
WORD = re.compile(r"[^\t\n\x0b\f\r ]+")
SENTENCE_END = re.compile(r"[.!?]+([\t ]+)")
BROADCAST_ROWS = 1_000_000  # repeated digests of two longs
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def units(text: str, unit: str) -> list[tuple[int, int]]:
    """Start and end character of each unit; separators belong to none."""
    found, start = [], 0
    for m in UNITS[unit].finditer(text):
        found.append((start, m.start()))
        start = m.end()
    return [*found, (start, len(text))]


def sentences(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Start and end of the sentences of a line, without the white space behind them; none if it is one."""
    found, at = [], start
    for m in SENTENCE_END.finditer(text, start, end):
        found.append((at, m.start(1)))
        at = m.end()
    if at < end:
        found.append((at, end))
    return found if len(found) > 1 else []


def _words(text: str) -> list[str]:
    """Words of the normal form."""
    words = SPACE.split(text.lower().strip("\t\n\x0b\f\r "))
    return words if words != [""] else []


def _beside(words: list[list[str]], i: int, least_words: int) -> tuple[str, str]:
    """Normal form of the sentences beside sentence i, a line each.

    Before it these are the short ones and the next one of ``least_words`` words, after it the short ones.
    """
    first, stop = i, i + 1
    while first > 0 and (first == i or len(words[first]) < least_words):
        first -= 1
    while stop < len(words) and len(words[stop]) < least_words:
        stop += 1
    return tuple("\n".join(" ".join(w) for w in part) for part in (words[first:i], words[i + 1 : stop]))


def _hashed(batches: Iterator[pa.RecordBatch], unit: str, least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            which, starts, ends, digests, befores, afters = [], [], [], [], [], []

            def add(i, span, words, before="", after=""):
                which.append(i)
                starts.append(span[0])
                ends.append(span[1])
                digests.append(xxhash.xxh3_128_digest(" ".join(words)))
                befores.append(before)
                afters.append(after)

            for i, text in enumerate(part.column("text").to_pylist()):
                for line in units(text, unit):
                    words = _words(text[line[0] : line[1]])
                    if words and (unit == "passage" or len(words) >= least_words):
                        add(i, line, words)
                    parts = sentences(text, *line) if unit in CUT_LINES else []
                    words = [_words(text[start:end]) for start, end in parts]
                    for n, span in enumerate(parts):
                        if words[n] and len(words[n]) >= least_words:
                            add(i, span, words[n], *(_beside(words, n, least_words) if unit == "passage" else ()))
            index = pa.array(which, pa.int64())
            halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [part.column("document").take(index), part.column("rank").take(index), pa.array(starts, pa.int64()),
                 pa.array(ends, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()),
                 pa.array(befores, pa.string()), pa.array(afters, pa.string())],
                ["document", "rank", "start", "end", "d1", "d2", "before", "after"],
            )


def _extended(
    text: str, parts: list[tuple[int, int]], beside: dict, kept: set[tuple[int, int]], least_words: int
) -> list[tuple[int, int]]:
    """Spans to cut from a line: its gone sentences, and what stands beside them as beside their earliest ones."""
    cuts: dict[int, int] = {}  # number of a sentence and where its cut begins
    for i, part in enumerate(parts):
        if part not in beside:
            continue
        cuts[i] = part[0]
        before, after = beside[part]
        source = before.replace("\n", " ").split(" ") if before else []
        at = i - 1
        while at >= 0 and source and parts[at] not in kept:
            found = list(WORD.finditer(text, *parts[at]))
            n = 0
            while n < min(len(found), len(source)) and found[-1 - n][0].lower() == source[-1 - n]:
                n += 1
            if n:
                start = found[-n].start()
                cuts[at] = min(cuts.get(at, start), start)
            if n < len(found) or n >= least_words:
                break
            source = source[: len(source) - n]
            at -= 1
        for at, short in zip(range(i + 1, len(parts)), after.split("\n") if after else ()):
            if " ".join(_words(text[slice(*parts[at])])) != short:
                break
            cuts[at] = parts[at][0]
    return [(start, parts[at][1]) for at, start in sorted(cuts.items())]


def without_units(
    text: str, gone: dict[tuple[int, int], tuple[str, str]], unit: str, kept: Set[tuple[int, int]] = frozenset(), least_words: int = 5
) -> tuple[str, int, list[dict]]:
    """The text without the given units, how many units it had, and the spans that were cut out.

    ``gone`` has what stands beside each unit's earliest occurrence, ``kept`` the earliest ones of this text.
    """
    pieces, removed, count, before = [], [], 0, 0
    for n, (start, end) in enumerate(units(text, unit)):
        parts = sentences(text, start, end) if unit in CUT_LINES else []
        count += max(1, len(parts))
        if (start, end) in gone:
            cut, left = [(start, end)], ""
        else:
            cut = _extended(text, parts, gone, kept, least_words)
            left = text[start:end]
            if cut:
                stops = [p[0] for p in parts[1:]] + [end]
                begins = {b: a for a, b in cut}
                left = "".join(text[p[0] : begins.get(p[1], stop)] for p, stop in zip(parts, stops))
                left = left.rstrip("\t ") if parts[-1][1] in begins else left
        removed += cut
        if not cut or left.strip("\t "):
            # a unit keeps the separator before it, but for the first one left
            pieces.append((text[before:start] if n and pieces else "") + left)
        before = end
    return "".join(pieces), count, [{"start": a, "end": b} for a, b in removed]


def _without(batches: Iterator[pa.RecordBatch], unit: str, least_words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            columns = (part.column(c).to_pylist() for c in ("text", "spans"))
            made = []
            for text, spans in zip(*columns):
                gone = {(s["start"], s["end"]): (s["before"], s["after"]) for s in spans or () if s["gone"]}
                kept = {(s["start"], s["end"]) for s in spans or () if not s["gone"]}
                made.append(without_units(text, gone, unit, kept, least_words))
            texts, counts, removed = zip(*made)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(removed, SPANS)],
                ["row", "kept_text", "n_units", "removed"],
            )


def _document(key: str, text: str) -> Column:
    """What names a document: its id and text."""
    name = F.concat(F.coalesce(F.col(key).cast("string"), F.lit("\x00")), F.lit("\x01"), whole(text))
    return F.unhex(F.sha2(name.cast("binary"), 256))


def drop_repeated_units(
    docs: DataFrame,
    unit: str = "line",
    least_words: int = 5,
    rank: tuple[str, ...] = (),
    text: str = "text",
    key: str = "doc_id",
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """``row`` (the document's columns), ``kept_text``, ``n_units`` and ``removed`` (spans of characters)."""
    order = [part for c in (*rank, key) for part in (F.col(c).isNull(), F.col(c))]
    rows = docs.select(_document(key, text).alias("document"), F.struct(*order).alias("rank"), whole(text).alias("text"))
    rank_kind = rows.schema["rank"].dataType.simpleString()
    found = written(
        arrow(
            rows,
            lambda b: _hashed(b, unit, least_words),
            f"document binary, rank {rank_kind}, start bigint, end bigint, d1 bigint, d2 bigint, "
            "before string, after string",
        ),
        "units",
    )
    repeated = written(found.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2"), "repeated-digests")
    if repeated.limit(broadcast_rows + 1).count() <= broadcast_rows:
        repeated = F.broadcast(repeated)
    found = written(found.join(repeated, ["d1", "d2"]), "occurrences")
    earliest = found.groupBy("d1", "d2").agg(F.min(F.struct("rank", "document", "start", "before", "after")).alias("first"))
    gone = ~((F.col("document") == F.col("first.document")) & (F.col("start") == F.col("first.start")))
    spans = found.drop("before", "after").join(earliest, ["d1", "d2"]).withColumn("gone", gone)
    if unit != "passage":  # only there the earliest ones matter too
        spans = spans.where("gone")
    beside = [F.when(F.col("gone"), F.col(f"first.{c}")).alias(c) for c in ("before", "after")]
    spans = spans.groupBy("document").agg(F.collect_set(F.struct("start", "end", "gone", *beside)).alias("spans"))
    joined = (
        docs.select(F.struct("*").alias("row"), whole(text).alias("text"), _document(key, text).alias("document"))
        .join(spans, "document", "left")
        .select("row", "text", "spans")
    )
    inner = joined.schema["row"].dataType.simpleString()
    return arrow(
        joined,
        lambda b: _without(b, unit, least_words),
        f"row {inner}, kept_text string, n_units bigint, removed array<struct<start:bigint,end:bigint>>",
    )


def _query(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    result = drop_repeated_units(docs, unit=unit)
    spans = F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return result.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("kept_text").alias("text"),
        "n_units",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(spans, ",").alias("removed"),
    )


def op6_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines and sentences of five words or more that an earlier one has."""
    return _query(spark, sf_dir, "sentence")


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of any length and the passages that an earlier one has."""
    return _query(spark, sf_dir, "passage")


OP6_SQL = """
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM cut
), placed AS (
  SELECT *, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS BIGINT) AS start,
         list_filter(string_split(regexp_replace(line, '([.!?]+[ \t]+)', '\\1' || chr(1), 'g'), chr(1)),
                     lambda p: p <> '') AS pieces
  FROM line
), piece AS (
  SELECT doc_id, n, start AS line_start, unnest(pieces) AS piece, unnest(range(1, len(pieces) + 1)) AS m
  FROM placed WHERE len(pieces) > 1
), sentence AS (
  SELECT *, line_start + CAST(sum(length(piece)) OVER (PARTITION BY doc_id, n ORDER BY m) AS BIGINT) - length(piece) AS start
  FROM piece
), ended AS (
  SELECT *, start + length(CASE WHEN m < max(m) OVER (PARTITION BY doc_id, n) THEN rtrim(piece, ' ' || chr(9)) ELSE piece END)
            AS stop FROM sentence
), unit AS (
  SELECT doc_id, n, 0 AS m, start, start + length(line) AS stop, line AS body FROM placed
  UNION ALL SELECT doc_id, n, m, start, stop, piece FROM ended
), normal AS (
  SELECT *, regexp_replace(lower(trim(body, ' ' || chr(9) || chr(11) || chr(12) || chr(13))),
                           '[\t\n\x0b\f\r ]+', ' ', 'g') AS norm FROM unit
), judged AS (
  SELECT *, len(string_split(norm, ' ')) >= 5
            AND row_number() OVER (PARTITION BY norm ORDER BY doc_id, start) > 1 AS gone FROM normal
), parts AS (
  SELECT doc_id, n, count(*) FILTER (WHERE m > 0) AS n_parts, bool_or(gone AND m = 0) AS line_gone,
         bool_or(gone AND m > 0) AS some_gone, max(m) FILTER (WHERE gone) AS last_gone,
         string_agg(body, '' ORDER BY m) FILTER (WHERE m > 0 AND NOT gone) AS rest,
         max(body) FILTER (WHERE m = 0) AS line
  FROM judged GROUP BY doc_id, n
), left_over AS (
  SELECT doc_id, n, greatest(n_parts, 1) AS n_units, line_gone,
         CASE WHEN line_gone THEN '' WHEN NOT some_gone THEN line
              WHEN last_gone = n_parts THEN rtrim(coalesce(rest, ''), ' ' || chr(9)) ELSE rest END AS line,
         line_gone OR some_gone AS cut FROM parts
), texts AS (
  SELECT doc_id, CAST(sum(n_units) AS BIGINT) AS n_units,
         coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT cut OR trim(line, ' ' || chr(9)) <> ''), '') AS text
  FROM left_over GROUP BY doc_id
), spans AS (
  SELECT j.doc_id, count(*) AS n_removed, string_agg(start || '-' || stop, ',' ORDER BY start) AS removed
  FROM judged j JOIN left_over l ON j.doc_id = l.doc_id AND j.n = l.n
  WHERE j.gone AND (j.m = 0 OR NOT l.line_gone) GROUP BY j.doc_id
)
SELECT t.doc_id, text, n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM texts t LEFT JOIN spans s ON t.doc_id = s.doc_id
"""
