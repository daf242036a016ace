"""Near-duplicate documents by MinHash, banding, verification and connected components.

1. One pass over the texts: each document's set of word shingles (64-bit hashes), a digest of the set,
   and ``BANDS * ROWS`` minima under random universal hash functions, 16 bits of each.
2. Documents with one set are one node, named by the smallest id. Nodes whose minima agree in a whole
   band share a bucket.
3. First links: every node is tried against one node only, the smallest of a bucket that it shares most
   bands with. Signatures first, then the full sets decide. This ties hot groups together linearly.
4. Other links: all pairs across components of a bucket with signatures alike enough are checked on full
   sets inside blocks of bounded size; a block gives at most one link less than it has components. Within
   a component no further link can change the result.
5. Components by alternating large and small stars.

At a similarity of 0.8 all bands differ with a probability of 1e-7, and a signature that agrees in less
than ``LEAST`` of its minima has one of 6e-8.

Defined cases: null and empty texts and texts without words have no shingles and are linked with nothing;
a text with fewer words than a shingle is one shingle; a null id is linked with nothing, its component is
null and it is kept; rows that share an id are documents of their own; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm.common import arrow, table, whole, width, written
from cytoframe.llm.components import star_components

BANDS, ROWS = 40, 5
LEAST = 0.65  # of the minima, for a similarity of 0.8
BLOCK = 2048
BROADCAST_IDS = 2_000_000  # ids and digests, 64 MB


class Shingler:
    """Sets of hashed word shingles; word hashes are kept per process."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        # lower-cases A-Z and splits at \x20 and \x09-\x0D, and nowhere else
        words = text.encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        hashes = np.empty(len(words), dtype=np.uint64)
        for i, word in enumerate(words):
            value = known.get(word)
            if value is None:
                value = known[word] = xxhash.xxh64_intdigest(word)
            hashes[i] = value
        size = min(self.words, len(words))
        mixed = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for at in range(size):
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[at : at + len(mixed)])
        return np.unique(mixed)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _functions() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    factors = draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def signature(shingles: np.ndarray, functions) -> bytes:
    """16 bits of the minimum of every universal hash function (multiply, add, high bits first)."""
    factors, shifts = functions
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024]
        np.minimum(least, (factors[:, None] * part + shifts[:, None]).min(1), out=least)
    return (_mix(least) >> np.uint64(48)).astype("<u2").tobytes()


def _signed(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    shingler, functions = Shingler(words), _functions()
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            part = batch.slice(start, 1000)
            sizes, digests, signatures = [], [], []
            for text in part.column("text").to_pylist():
                shingles = shingler(text)
                sizes.append(len(shingles))
                empty = not len(shingles)
                digests.append(None if empty else xxhash.xxh3_128_digest(shingles.tobytes()))
                signatures.append(None if empty else signature(shingles, functions))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()),
                 pa.array(signatures, pa.binary())],
                ["id", "n_shingles", "digest", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    shingler = Shingler(words)
    for batch in batches:
        for start in range(0, batch.num_rows, 500):
            part = batch.slice(start, 500)
            ids, sets = [], []
            columns = (part.column(c).to_pylist() for c in ("id", "digest", "text"))
            for key, digest, text in zip(*columns):
                shingles = shingler(text)
                if xxhash.xxh3_128_digest(shingles.tobytes()) == digest:
                    ids.append(key)
                    sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"]
            )


class Forest:
    """Union-find over the rows of one block, begun with the components they have."""

    def __init__(self, components: np.ndarray):
        _, first = np.unique(components, return_inverse=True)
        self.parent = list(range(int(first.max(initial=-1)) + 1))
        self.label = first.ravel().tolist()

    def find(self, row: int) -> int:
        at, parent = self.label[row], self.parent
        while parent[at] != at:
            parent[at] = parent[parent[at]]
            at = parent[at]
        return at

    def join(self, a: int, b: int) -> None:
        self.parent[self.find(a)] = self.find(b)


def _is_link(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """On sorted sets."""
    smaller, larger = sorted((len(a), len(b)))
    if 100 * smaller < percent * larger:
        return False
    place = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = int((b[place] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _joins(rows: pa.Table, least: float, percent: int) -> pa.RecordBatch:
    """Links that join components of a block, at most one less than it has components.

    Pairs with signatures alike enough are checked on their full sets by falling agreement; a pair
    that shares several bands is left to the first of them.
    """
    ids, parts, sides = (rows[c].to_numpy() for c in ("id", "component", "side"))
    forest, found = Forest(parts), []
    if len(forest.parent) > 1:
        band = rows["band"][0].as_py()
        minima = np.frombuffer(b"".join(rows["signature"].to_pylist()), dtype="<u2").reshape(len(ids), -1)
        one, two = np.flatnonzero(sides != 2), np.flatnonzero(sides != 1)
        agree = np.zeros((len(one), len(two)), dtype=np.uint8 if minima.shape[1] < 256 else np.uint16)
        for column in minima.T:
            agree += column[one][:, None] == column[two][None, :]
        a, b = np.nonzero((agree >= least * minima.shape[1]) & (parts[one][:, None] != parts[two][None, :]))
        keep = a < b if sides.max() == 0 else np.ones(len(a), dtype=bool)
        order = np.argsort(-agree[a[keep], b[keep]].astype(np.int16), kind="stable")
        u, v = one[a[keep][order]], two[b[keep][order]]
        first = [
            (minima[u[at : at + 20_000]] == minima[v[at : at + 20_000]]).reshape(-1, BANDS, ROWS).all(2).argmax(1)
            for at in range(0, len(u), 20_000)
        ]
        here = np.concatenate(first) == band if first else np.empty(0, dtype=bool)
        known: dict[int, np.ndarray] = {}

        def shingles(row: int) -> np.ndarray:
            if row not in known:
                known[row] = rows["shingles"][row].values.to_numpy().view(np.uint64)
            return known[row]

        for a, b in zip(u[here].tolist(), v[here].tolist()):
            if forest.find(a) != forest.find(b) and _is_link(shingles(a), shingles(b), percent):
                forest.join(a, b)
                found.append((int(ids[a]), int(ids[b])))
    return pa.RecordBatch.from_arrays(
        [pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["u", "v"]
    )


def _by_block(batches: Iterator[pa.RecordBatch], least: float, percent: int) -> Iterator[pa.RecordBatch]:
    """``_joins`` of each block; the rows of a block come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column("key").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and a < b and held[-1].column("key")[0].as_py() != keys[a]:
                yield _joins(pa.Table.from_batches(held), least, percent)
                held = []
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield _joins(pa.Table.from_batches(held), least, percent)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full sets."""
    u = sets.select(F.col("id").alias("u"), F.col("shingles").alias("su"))
    v = sets.select(F.col("id").alias("v"), F.col("shingles").alias("sv"))
    common = F.size(F.array_intersect("su", "sv"))
    union = F.size("su") + F.size("sv") - common
    return pairs.join(u, "u").join(v, "v").where(common * 100 >= union * percent).select("u", "v").distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``kept`` per row of ``docs``.

    Similarities of ``percent`` hundredths or more are links; the bands are laid out for 80 and more.
    """
    if percent < 80:
        raise ValueError("the bands find similarities of 80 hundredths and more")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), whole(text).alias("text"))
    signed = arrow(
        rows, lambda b: _signed(b, words), "id bigint, n_shingles bigint, digest binary, signature binary"
    )
    signed = written(signed, "signatures")
    nodes = signed.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(
        F.min("id").alias("id"), F.min("signature").alias("signature")
    )
    nodes = written(nodes, "nodes")
    step = ROWS * 2
    band = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda b: F.xxhash64(F.col("signature").substr(b * step + 1, F.lit(step)), b),
    )
    banded = nodes.select("id", F.posexplode(band).alias("band", "bucket"))
    shared = banded.groupBy("bucket").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1")
    members = written(banded.join(shared, "bucket"), "members")

    # the sets of all nodes that share a bucket, from one more pass over their texts
    wanted = nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "digest")
    if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    sets = rows.join(wanted, "id").select("id", "digest", "text")
    sets = written(arrow(sets, lambda b: _sets(b, words), "id bigint, shingles array<bigint>"), "sets")

    tried = members.where("id <> center").groupBy("id", "center").agg(F.count("*").alias("bands"))
    best = tried.groupBy("id").agg(F.min_by("center", F.struct(-F.col("bands"), "center")).alias("center"))
    near = percent / 100 * LEAST / 0.8
    close = best.join(nodes.select("id", "signature"), "id").join(
        nodes.select(F.col("id").alias("center"), F.col("signature").alias("other")), "center"
    )
    agree = F.size(
        F.filter(F.sequence(F.lit(0), F.lit(BANDS * ROWS - 1)), lambda i: F.col("signature").substr(i * 2 + 1, F.lit(2))
                 == F.col("other").substr(i * 2 + 1, F.lit(2)))
    )
    first = close.where(agree >= near * BANDS * ROWS).select(F.col("center").alias("u"), F.col("id").alias("v"))
    links = written(_confirmed(first, sets, percent), "links")
    parts = star_components(links)

    # buckets that still hold nodes of different components
    placed = members.select("id", "band", "bucket", "n").join(parts.withColumnRenamed("node", "id"), "id", "left")
    placed = written(placed.withColumn("component", F.coalesce("component", "id")), "placed")
    mixed = placed.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    crossing = placed.join(mixed.where("a <> b").select("bucket"), "bucket")
    # a bucket is cut into blocks of bounded size; every pair of its blocks is a unit of work
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    units = crossing.withColumns({"blocks": blocks, "mine": mine}).select(
        "id", "component", "band", "bucket", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    )
    units = units.select(
        "id", "component", "band",
        F.xxhash64("bucket", F.least("mine", "other"), F.greatest("mine", "other")).alias("key"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"),
    )
    rest = arrow(
        units.join(nodes.select("id", "signature"), "id")
        .join(sets, "id")
        .repartition(width(spark) * 2, "key")
        .sortWithinPartitions("key"),
        lambda b: _by_block(b, near, percent),
        "u bigint, v bigint",
    ).distinct()
    final = star_components(links.unionByName(rest))

    named = nodes.select("digest", "id").join(final.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("digest", F.coalesce("component", "id").alias("component"))
    result = signed.select("id", "n_shingles", "digest").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return result.select(
        F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingle sets are alike to 80 hundredths or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` without the near copies of a document with a smaller id.

    Rows that share an id stay or go together: they stay if one of them is the one to keep.
    """
    result = near_duplicates(docs, words, percent, text, key)
    gone = written(result.groupBy(key).agg(F.max("kept").alias("kept")).where("NOT kept").select(key), "near-copies")
    if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti")
