"""Exact top-k inner-product search with a KD-tree per shard.

Shards are the cells of a first KD-tree: median splits fitted on a bounded sample of rows, every row dealt by them, crowded
cells cut further by the hash of the id. Each shard builds a KD-tree of its own: median splits along the widest side, a tight
box at every node. A query traverses a tree best first by the largest inner product that a node's box allows,
and stops when that bound falls under its kth score. Its own cell comes first; the kth score found there is
carried on, so that it skips all cells whose box cannot reach it.

Every row is sent to one shard once a pass; queries stream past the trees in batches.

Defined cases: vectors that are null, empty, or hold a null or non-finite component take no part;
a shorter vector counts as padded with zeros; rows with one id count once (the greatest vector);
null ids take no part; ties go to the smaller id; fewer candidates than k give fewer rows; an empty
table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoframe.llm.common import arrow, stream_past, table, width, written

LEAF = 256
MOST_CELLS = 1024
SAMPLE_ROWS = 32  # a cell, for the first splits
FOUND = "query_id bigint, vec_id bigint, score bigint"
NONE = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max


def largest_products(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query (rows) with a point of its box (rows, or one for all)."""
    return (np.maximum(queries, 0) * high + np.minimum(queries, 0) * low).sum(axis=-1)


class Tree:
    """A KD-tree: node 0 is the root; ``left`` is 0 at a leaf, whose rows are ``rows[start:end]``; boxes are tight."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points, self.rows = points, np.arange(len(points))
        self.low, self.high, self.left, self.start, self.end = [], [], [], [], []
        todo = [self._node(0, len(points))]
        while todo:
            node = todo.pop()
            a, b = self.start[node], self.end[node]
            if b - a <= leaf:
                self.rows[a:b].sort()
                continue
            side = int((self.high[node] - self.low[node]).argmax())
            middle = (b - a) // 2
            self.rows[a:b] = self.rows[a:b][np.argpartition(points[self.rows[a:b], side], middle)]
            self.left[node] = self._node(a, a + middle)
            todo += [self.left[node], self._node(a + middle, b)]
        self.low, self.high, self.left = np.array(self.low), np.array(self.high), np.array(self.left)

    def _node(self, a: int, b: int) -> int:
        part = self.points[self.rows[a:b]]
        for values, value in ((self.low, part.min(0)), (self.high, part.max(0)), (self.left, 0), (self.start, a), (self.end, b)):
            values.append(value)
        return len(self.left) - 1

    def leaves(self) -> list[np.ndarray]:
        return [self.rows[a:b] for a, b, inner in zip(self.start, self.end, self.left) if not inner]


def tree_top_k(
    ids: np.ndarray, tree: Tree, query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k best other rows of a tree per query that reach the query's ``floor`` score.

    ``ids`` ascend with the rows. All queries advance together: each round every query opens the node with its largest
    bound; children get their bounds when their parent is opened, leaves are scored.
    """
    count = len(queries)
    best = np.full((count, k), NONE, dtype=np.int64)
    best_ids = np.full((count, k), NO_ID, dtype=np.int64)
    waiting = np.full((count, len(tree.left)), -np.inf)
    waiting[:, 0] = largest_products(queries, tree.low[0], tree.high[0])
    active = np.arange(count)
    while len(active):
        node = waiting[active].argmax(axis=1)
        bound = waiting[active, node]
        # the kth score so far, or the one carried in; an equal bound may still win by its id
        needed = np.maximum(best[active, k - 1], floor[active])
        going = np.isfinite(bound) & (bound >= needed)
        active, node = active[going], node[going]
        if not len(active):
            break
        waiting[active, node] = -np.inf
        inner = tree.left[node] > 0
        for child in (0, 1):
            q, c = active[inner], tree.left[node[inner]] + child
            waiting[q, c] = largest_products(queries[q], tree.low[c], tree.high[c])
        for number in np.unique(node[~inner]):
            mine, rows = active[~inner][node[~inner] == number], tree.rows[tree.start[number] : tree.end[number]]
            _score_leaf(best, best_ids, ids[rows], tree.points[rows], mine, queries[mine], query_ids[mine], k)
    row, column = np.nonzero((best != NONE) & (best >= floor[:, None]))
    return query_ids[row], best_ids[row, column], best[row, column]


def _score_leaf(best, best_ids, ids, points, mine, queries, query_ids, k: int) -> None:
    """Merge a leaf's rows into the best of the queries numbered ``mine``."""
    scores = (queries @ points.T).astype(np.int64)
    own = query_ids[:, None] == ids[None, :]
    take = min(k, len(ids))
    if points.dtype == np.float64:  # distinct keys: the score, then the smaller id
        keys = np.where(own, NONE, scores * LEAF + (LEAF - 1 - np.arange(len(ids))))
        top = np.argpartition(-np.maximum(keys, NONE + 1), take - 1, axis=1)[:, :take]
    else:
        keys = np.where(own, NONE, scores)
        top = np.argsort(-np.maximum(keys, NONE + 1), axis=1, kind="stable")[:, :take]
    valid = np.take_along_axis(keys, top, 1) != NONE
    all_scores = np.concatenate([best[mine], np.where(valid, np.take_along_axis(scores, top, 1), NONE)], 1)
    all_ids = np.concatenate([best_ids[mine], np.where(valid, ids[top], NO_ID)], 1)
    # the lowest value has no negative: order it last by hand
    ranked = np.lexsort((all_ids, -np.maximum(all_scores, NONE + 1)), axis=1)[:, :k]
    best[mine] = np.take_along_axis(all_scores, ranked, 1)
    best_ids[mine] = np.take_along_axis(all_ids, ranked, 1)


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), dim), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = vectors.flatten().to_numpy(zero_copy_only=False)
    return out


class Cells:
    """The first splits, a small tree of (side, limit, left, right); a negative child is leaf -1 - child, a cell."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.splits: list[list] = []
        self.count = 0
        self.root = self._cut(sample, cells)

    def _cut(self, rows: np.ndarray, cells: int) -> int:
        side = int((rows.max(0) - rows.min(0)).argmax()) if len(rows) else 0
        limit = np.median(rows[:, side]) if cells > 1 and len(rows) > 1 else None
        if limit is None or not 0 < (upper := rows[:, side] >= limit).sum() < len(rows):
            self.count += 1
            return -self.count
        place = len(self.splits)
        self.splits.append([side, limit, 0, 0])
        self.splits[place][2:] = self._cut(rows[~upper], cells - cells // 2), self._cut(rows[upper], cells // 2)
        return place

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.full(len(points), self.root)
        while (inner := np.flatnonzero(at >= 0)).size:
            side, limit, left, right = (np.array([s[i] for s in self.splits])[at[inner]] for i in range(4))
            at[inner] = np.where(points[inner, side] >= limit, right, left)
        return -1 - at


def _boxes(dealt: DataFrame, dim: int) -> tuple[dict[int, int], dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Rows and tight box of every cell; only boxes leave the tasks, at most one a cell and partition."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in batches:
            cell, points = batch.column("cell").to_numpy(), _matrix(batch.column("vector"), dim)
            for c in np.unique(cell).tolist():
                mine = points[cell == c]
                n, low, high = found.get(c, (0, mine[0], mine[0]))
                found[c] = [n + len(mine), np.minimum(low, mine.min(0)), np.maximum(high, mine.max(0))]
        yield pa.RecordBatch.from_pydict(
            {"cell": pa.array(list(found), pa.int32()), "n": pa.array([f[0] for f in found.values()], pa.int64()),
             "low": pa.array([f[1] for f in found.values()], pa.list_(pa.int64())),
             "high": pa.array([f[2] for f in found.values()], pa.list_(pa.int64()))}
        )

    made = arrow(dealt.select("cell", "vector"), partial, "cell int, n bigint, low array<bigint>, high array<bigint>")
    each = made.select("cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("i", "b"))
    rows = (
        each.groupBy("cell", "i").agg(F.sum("n").alias("n"), F.min("b.low").alias("low"), F.max("b.high").alias("high"))
        .groupBy("cell").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("box"))
        .collect()
    )
    sizes = {r["cell"]: r["n"] for r in rows}
    return sizes, {r["cell"]: (np.array([x["low"] for x in r["box"]]), np.array([x["high"] for x in r["box"]])) for r in rows}


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard_rows: int = 16384) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: both inputs have ``id`` and ``vector`` (array of long)."""
    spark = vectors.sparkSession
    rows, dim = vectors.agg(F.count("*"), F.max(F.size("vector"))).first()
    dim = dim or 1
    wanted = min(MOST_CELLS, max(1, math.ceil(rows / shard_rows)))
    share = max(1, rows // (wanted * SAMPLE_ROWS))
    sample = vectors.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(share)) == 0) if wanted > 1 else vectors.limit(0)
    held = [np.array(r["vector"] + [0] * (dim - len(r["vector"]))) for r in sample.limit(2 * MOST_CELLS * SAMPLE_ROWS).collect()]
    cells = Cells(np.array(held).reshape(len(held), dim), wanted)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells.of(_matrix(batch.column("vector"), dim))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

    dealt = written(arrow(vectors.select("id", "vector"), deal, "id bigint, vector array<bigint>, cell int"), "dealt")
    sizes, boxes = _boxes(dealt, dim)
    parts = {c: max(1, math.ceil(n / shard_rows)) for c, n in sizes.items()}
    part_map = F.create_map(*[F.lit(x) for item in parts.items() for x in item]) if parts else None
    if part_map is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    of_cell = F.coalesce(F.try_element_at(part_map, F.col("cell")), F.lit(1))
    stored = dealt.select("cell", F.pmod(F.xxhash64("id"), of_cell).cast("int").alias("part"), "id", "vector")

    def start(shard: pa.Table) -> tuple[np.ndarray, dict, float, np.ndarray]:
        shard = shard.combine_chunks()
        ids, points = shard.column("id").to_numpy(), _matrix(shard.column("vector").combine_chunks(), dim)
        order = np.lexsort((*points.T[::-1], ids))
        order = order[np.append(ids[order][1:] != ids[order][:-1], True)]  # the greatest vector of an id
        ids, points = ids[order], points[order]
        return ids, {}, float(np.abs(points).max(initial=0)), points

    def search(state, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, trees, largest, points = state
        asked = _matrix(batch.column("vector"), dim)
        # arithmetic is in 64-bit integers, through doubles where those are exact
        exact = largest * float(np.abs(asked).max(initial=0)) * dim * 2 * LEAF < 2.0**53
        kind = np.float64 if exact else np.int64
        if kind not in trees:
            trees[kind] = Tree(points.astype(kind))
        found = tree_top_k(ids, trees[kind], batch.column("id").to_numpy(), asked.astype(kind), batch.column("floor").to_numpy(), k)
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], names=["query_id", "vec_id", "score"])

    def searched(asked: DataFrame) -> DataFrame:
        sent = asked.withColumn("part", F.explode(F.sequence(F.lit(0), of_cell - 1)))
        return stream_past(stored, sent, ["cell", "part"], start, search, FOUND, 2 * width(spark))

    lowest = F.lit(NONE)
    alone = queries.groupBy("id").agg(F.max("vector").alias("vector"))
    asked = written(arrow(alone, deal, "id bigint, vector array<bigint>, cell int"), "asked")
    first = searched(asked.withColumn("floor", lowest))
    if len(sizes) > 1:
        first = written(first, "own-cell")
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top = first.withColumn("nth", F.row_number().over(place)).where(F.col("nth") == k)
        kth = top.select(F.col("query_id").alias("id"), F.col("score").alias("floor"))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The other cells whose box allows the carried score."""
            names = sorted(boxes)
            low, high = (np.array([boxes[c][i] for c in names]).astype(np.float64) for i in (0, 1))
            for batch in batches:
                points = _matrix(batch.column("vector"), dim).astype(np.float64)
                floor, home = batch.column("floor").to_numpy(), batch.column("cell").to_numpy()
                bound = np.maximum(points, 0) @ high.T + np.minimum(points, 0) @ low.T
                # doubles may round huge products: leave room
                near = (bound + np.abs(bound) * 1e-9 + 1 >= floor[:, None]) & (np.array(names)[None, :] != home[:, None])
                visits = [np.array(names)[row].astype("int32") for row in near]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("vector"), batch.column("floor"), pa.array(visits, pa.list_(pa.int32()))],
                    names=["id", "vector", "floor", "visits"],
                )

        carried = asked.join(kth, "id", "left").select("id", "vector", "cell", F.coalesce("floor", lowest).alias("floor"))
        others = arrow(carried, reach, "id bigint, vector array<bigint>, floor bigint, visits array<int>")
        first = first.unionByName(searched(others.withColumn("cell", F.explode("visits")).drop("visits")))
    ranked = first.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` (floor of 256 times each component) of the rows that take part."""
    exact = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.forall(exact, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col(key).isNotNull() & (F.size(vector) > 0) & usable).select(
        F.col(key).cast("long").alias("id"), F.transform(exact, lambda x: F.floor(x * 256)).alias("vector")
    )


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other rows of every row whose id is divisible by 50."""
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return exact_top_k(vectors, vectors.where(F.col("id") % 50 == 0), 5)


OP1_SQL = """
WITH parts AS (
  SELECT vec_id, unnest(range(1, len(embedding) + 1)) AS i,
         unnest(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT))) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(sum(a.q * b.q) AS BIGINT) AS score
  FROM parts a JOIN parts b ON a.i = b.i AND a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
  GROUP BY ALL
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scores
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
