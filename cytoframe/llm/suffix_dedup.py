"""Removal of byte strings of a given length that start anywhere else too, by sharded suffix arrays.

1. Anchors. Every window of ``length`` bytes is represented by its smallest hashed ``GRAM``-gram, the
   leftmost if tied; equal windows have equal anchors. Neighbouring windows with one anchor form a run.
   A window can only occur twice if its anchor does, so runs whose anchor has one place are done.
2. Shards. The bytes of the remaining runs (segments) are dealt by anchor, so all occurrences of a
   repeated string meet; equal segments are folded and need no sorting.
3. Each shard sorts the suffixes of its segments by induced sorting, in stretches of bounded size; a window
   is repeated where its prefix with a neighbour in the order is ``length`` or more.
4. An anchor with more than ``HOT`` different segments (a passage in a great many documents) is not sorted
   in one shard: its windows are dealt singly by their 128-bit digests and counted, which gives the same
   answer without a hot group.
5. Repeated windows become byte ranges, merged per text, and the rest of the text is kept.

Copies of a whole text are handled once; their windows are all repeated.

Defined cases: a null text is the empty text; texts shorter than ``length`` lose nothing; repeated rows,
also with one id, are places of their own, so both lose what they share; null ids stay null; overlapping
occurrences in one text count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm.common import arrow, table, whole, width, written
from cytoframe.llm.suffix_arrays import permuted_prefixes, suffix_array

GRAM = 128
HOT = 4096
STRETCH = 2_000_000  # bytes sorted at once
CHUNK = 1 << 18  # windows of a text looked at once
BASE = 0x9E3779B97F4A7C15 | 1
ANCHORS = "content binary, anchor bigint, first int, windows int, place bigint"


class Powers:
    """Powers of the hash base and of its inverse modulo 2^64."""

    def __init__(self):
        self.size = 0
        self.grow(1 << 16)

    def grow(self, size: int) -> None:
        if size > self.size:
            self.size = max(size, 2 * self.size)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(self.size + 1, base, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(data: bytes, length: int, gram: int, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window and number of windows of each run of neighbouring windows."""
    found = []
    for start in range(0, len(data) - length + 1, CHUNK):
        piece = np.frombuffer(data, np.uint8, min(CHUNK + length - 1, len(data) - start), start)
        n = len(piece)
        powers.grow(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers.up[:n], out=sums[1:])
        hashes = _mix((sums[gram:] - sums[:-gram]) * powers.down[: n - gram + 1])
        # the position in the low bits makes the leftmost of equal hashes the smallest
        keys = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
        span = length - gram + 1
        blocks = -(-len(keys) // span)
        padded = np.full(blocks * span, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[: len(keys)] = keys
        grid = padded.reshape(blocks, span)
        left = np.minimum.accumulate(grid, axis=1).ravel()
        right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - length + 1
        place = (np.minimum(right[:count], left[span - 1 : span - 1 + count]) & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(np.diff(place)) + 1])
        found.append((hashes[place[first]].view(np.int64), first + start, np.diff(np.append(first, count))))
    if not found:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, empty
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _anchored(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            contents = part.column("content").to_pylist()
            parts, which = [], []
            for i, data in enumerate(part.column("bytes").to_pylist()):
                anchors, first, windows = runs(data, length, gram, powers)
                place = _mix(first.astype(np.uint64) + np.uint64(xxhash.xxh64_intdigest(contents[i]))).view(np.int64)
                parts.append((anchors, first, windows, place))
                which.append(np.full(len(anchors), i))
            anchors, first, windows, place = (np.concatenate(c) for c in zip(*parts))
            content = pa.array(contents, pa.binary()).take(pa.array(np.concatenate(which).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [content, pa.array(anchors), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int32)),
                 pa.array(place)],
                ["content", "anchor", "first", "windows", "place"],
            )


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs of each text, with a digest that names equal segments."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            rows = []
            columns = (part.column(c).to_pylist() for c in ("content", "bytes", "runs"))
            for content, data, wanted in zip(*columns):
                for run in wanted:
                    piece = data[run["first"] : run["first"] + run["windows"] + length - 1]
                    rows.append((content, run["anchor"], run["first"], run["windows"], run["place"],
                                 xxhash.xxh3_128_digest(piece), piece))
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            names = ["content", "anchor", "first", "windows", "place", "digest", "bytes"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, kinds)], names
            )


def repeated_windows(pieces: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each piece, ranges of window starts whose ``length`` bytes start elsewhere in the pieces too."""
    sizes = np.array([len(p) + 1 for p in pieces], dtype=np.int64)
    data = np.frombuffer(b"\0".join(pieces) + b"\0", dtype=np.uint8)
    ends = np.cumsum(sizes)
    text = data.astype(np.int64) + 2
    text[ends - 1] = 1  # between pieces
    order = suffix_array(np.append(text, 0), 258)[1:]
    prefix = permuted_prefixes(text, order, int(sizes.max()), ends - sizes)
    long = prefix >= length
    both = long.copy()
    after = np.flatnonzero(long[order[1:]])
    both[order[after]] = True  # the suffix sorted before it shares the same prefix
    starts = ends - sizes
    result = []
    for start, size in zip(starts.tolist(), sizes.tolist()):
        # a window must end inside its piece; there it holds no separator, so neither does its equal
        flags = np.concatenate([[False], both[start : start + size - length], [False]])
        edges = np.flatnonzero(flags[1:] != flags[:-1]).tolist()
        result.append(list(zip(edges[::2], edges[1::2])))
    return result


def _sorted_shard(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated ranges of segments; the segments of an anchor come together."""
    held, size = [], 0

    def solve():
        nonlocal held, size
        rows, held, size = held, [], 0
        found = repeated_windows([r[2] for r in rows], length)
        kept = [(r[0], r[1], [{"a": a, "b": b} for a, b in f]) for r, f in zip(rows, found) if f]
        columns = list(zip(*kept)) if kept else [[], [], []]
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary()), pa.array(columns[2], kind)],
            ["anchor", "digest", "ranges"],
        )

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "digest", "bytes"))):
            if size >= STRETCH and row[0] != held[-1][0]:
                yield solve()
            held.append(row)
            size += len(row[2])
    if held:
        yield solve()


def _single_windows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            rows = []
            for anchor, digest, piece in zip(*(part.column(c).to_pylist() for c in ("anchor", "digest", "bytes"))):
                for a in range(len(piece) - length + 1):
                    rows.append((anchor, digest, a, xxhash.xxh3_128_digest(piece[a : a + length])))
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["anchor", "digest", "a", "window"]
            )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        spans = []
        for ranges in batch.column("ranges").to_pylist():
            merged: list[dict] = []
            for r in sorted(ranges, key=lambda r: r["start"]):
                if merged and r["start"] <= merged[-1]["end"]:
                    merged[-1]["end"] = max(merged[-1]["end"], r["end"])
                else:
                    merged.append(dict(r))
            spans.append(merged)
        yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(spans, kind)], ["content", "spans"])


def repeated_spans(texts: DataFrame, length: int = 400, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``content`` and the merged byte ``spans`` to remove, from rows of ``content`` (digest) and ``bytes``."""
    spark = texts.sparkSession
    texts = texts.where(F.octet_length("bytes") >= length)
    copies = texts.select("content", F.octet_length("bytes").alias("n")).groupBy("content", "n").agg(F.count("*").alias("rows"))
    copied = copies.where("rows > 1").select(
        "content", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("end"))).alias("spans")
    )
    anchors = written(arrow(texts, lambda b: _anchored(b, length, gram), ANCHORS), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    # written, so that the join is one of its own and adaptive execution can split a hot anchor
    shared = written(shared.where("low <> high").select("anchor"), "shared")
    wanted = (
        anchors.join(shared, "anchor")
        .groupBy("content")
        .agg(F.collect_set(F.struct("anchor", "first", "windows", "place")).alias("runs"))
    )
    # one row a text: the segments of its copies would all be sorted in one shard, however many they are
    segments = texts.dropDuplicates(["content"]).join(wanted, "content").select("content", "bytes", "runs")
    segments = written(
        arrow(segments, lambda b: _cut(b, length), ANCHORS + ", digest binary, bytes binary"), "segments"
    )

    # equal segments are folded; one place stands for each
    folded = segments.groupBy("anchor", "digest").agg(F.min("place").alias("place"), F.max("place").alias("high"))
    folded = written(folded.selectExpr("anchor", "digest", "place", "place <> high AS many"), "folded")
    groups = folded.groupBy("anchor").agg(F.count("*").alias("n"), F.bool_and("many").alias("settled"))
    open_groups = groups.where("n > 1 AND NOT settled").select("anchor", (F.col("n") > hot).alias("hot"))
    feed = segments.select("anchor", "digest", "place", "bytes").join(
        folded.join(open_groups, "anchor").select("anchor", "digest", "place", "hot"), ["anchor", "digest", "place"]
    )
    feed = written(feed.select("anchor", "digest", "bytes", "hot"), "feed")
    ranges = "array<struct<a:int,b:int>>"
    by_sorting = arrow(
        feed.where("NOT hot")
        .select("anchor", "digest", "bytes")
        .repartition(width(spark) * 2, "anchor")
        .sortWithinPartitions("anchor"),
        lambda b: _sorted_shard(b, length),
        f"anchor bigint, digest binary, ranges {ranges}",
    )
    single = written(
        arrow(
            feed.where("hot").select("anchor", "digest", "bytes"),
            lambda b: _single_windows(b, length),
            "anchor bigint, digest binary, a int, window binary"
        ),
        "windows",
    )
    often = single.groupBy("window").agg(F.count("*").alias("n")).where("n > 1").select("window")
    by_digest = (
        single.join(often, "window")
        .groupBy("anchor", "digest")
        .agg(F.collect_set(F.struct("a", (F.col("a") + 1).alias("b"))).alias("ranges"))
    )
    found = by_sorting.unionByName(by_digest).groupBy("anchor", "digest").agg(
        F.flatten(F.collect_list("ranges")).alias("ranges")
    )
    # one row a segment, written: the join with its places is then one of its own, and a segment in a great many texts can be split
    settled = written(
        folded.join(found, ["anchor", "digest"], "left").where("many OR ranges IS NOT NULL").select("anchor", "digest", "many", "ranges"),
        "settled",
    )
    marked = (
        segments.select("anchor", "digest", "content", "first", "windows")
        .join(settled, ["anchor", "digest"])
        .withColumn("ranges", F.expr("IF(many, array(struct(0 AS a, windows AS b)), ranges)"))
        .select("content", "first", F.explode("ranges").alias("r"))
    )
    per_text = marked.groupBy("content").agg(
        F.collect_set(
            F.struct(
                (F.col("first") + F.col("r.a")).cast("long").alias("start"),
                (F.col("first") + F.col("r.b") + (length - 1)).cast("long").alias("end"),
            )
        ).alias("ranges")
    )
    spans = arrow(
        per_text.join(copied.select("content"), "content", "left_anti"), _merged, "content binary, spans array<struct<start:bigint,end:bigint>>"
    )
    return written(spans.unionByName(copied), "spans")


def remove_repeats(
    docs: DataFrame,
    length: int = 400,
    gram: int = GRAM,
    hot: int = HOT,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``key``, ``bytes`` (UTF-8), removed ``spans`` of bytes and the ``kept`` bytes of every row."""
    bytes_ = whole(text).cast("binary")
    rows = docs.select(F.col(key).alias("key"), bytes_.alias("bytes"))
    rows = rows.withColumn("content", F.unhex(F.sha2("bytes", 256)))
    spans = repeated_spans(rows.select("content", "bytes"), length, gram, hot)
    size = F.octet_length("bytes").cast("long")
    # what lies between the removed spans
    edges = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["end"]))
    stops = F.concat(F.transform("spans", lambda s: s["start"]), F.array(size))
    pieces = F.arrays_zip(edges.alias("a"), stops.alias("b"))
    kept = F.aggregate(
        pieces,
        F.lit(b""),
        lambda done, p: F.concat(done, F.substring("bytes", (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int"))),
    )
    joined = rows.join(spans, "content", "left")
    none = F.expr("array()").cast("array<struct<start:bigint,end:bigint>>")
    return joined.select(
        F.col("key").alias(key),
        "bytes",
        F.coalesce("spans", none).alias("spans"),
        F.when(F.col("spans").isNull(), F.col("bytes")).otherwise(kept).alias("kept"),
    )


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to strings of 400 bytes that start anywhere else."""
    result = remove_repeats(table(spark, sf_dir, "documents"))
    return result.select(
        "doc_id",
        F.octet_length("bytes").cast("long").alias("n_bytes"),
        (F.octet_length("bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
