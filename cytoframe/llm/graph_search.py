"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Rows are dealt to shards by their id's hash; equal vectors of a shard share a node. A shard's graph starts
at random. In two passes every node is searched for greedily from the medoid; what the search met, with the
present neighbours, is pruned: the nearest candidate becomes a neighbour, and those that are nearer to it
than to the node, by the relaxation factor ``ALPHA``, are dropped; so edges point in different directions.
Edges are also drawn back, and overfull nodes pruned again. All rows are indexed; the index is a table in
the shared folder, so lost tasks search it again.

A query's beam search runs in every shard; its best rows are scored anew in double precision. Inner products
become distances by one more component that makes all norms of a shard equal. The index is read once: a task holds
one shard's graph while the queries stream past it.

Defined cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part; a
shorter vector counts as padded with zeros; rows with one id count once (the greatest vector); null ids take
no part; ties go to the smaller id; fewer candidates than k give fewer rows; an empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cytoframe.llm.common import stream_past, table, width, written

DEGREE = 32
BUILD_BEAM = 48
SEARCH_BEAM = 96
ALPHA = 1.2
AT_ONCE = 512
EXPAND = 4
INDEX = "shard int, node int, ids array<bigint>, vector array<double>, neighbours array<int>"
FOUND = "query_id bigint, vec_id bigint, score double"


def _distances(points: np.ndarray, squares: np.ndarray, rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``rows`` to its list of points, up to the row's own square."""
    return squares[ids] - 2 * np.matmul(points[ids], rows[:, :, None])[:, :, 0]


def beam_search(points, squares, graph, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes met nearest to each query, with distances (less the query's square), nearest first."""
    n, count = len(points), len(queries)
    ids = np.full((count, beam), n, dtype=np.int64)
    distance = np.full((count, beam), np.inf, dtype=np.float32)
    done = np.ones((count, beam), dtype=bool)
    ids[:, 0] = start
    distance[:, 0] = _distances(points, squares, queries, ids[:, :1])[:, 0]
    done[:, 0] = False
    seen = np.zeros((count, n + 1), dtype=bool)
    seen[:, start] = seen[:, n] = True
    live = np.arange(count)
    while len(live):
        waiting = np.where(done[live], np.inf, distance[live])
        pick = np.argsort(waiting, axis=1, kind="stable")[:, :EXPAND]
        open_ = np.isfinite(np.take_along_axis(waiting, pick, 1))
        some = open_.any(1)
        live, pick, open_ = live[some], pick[some], open_[some]
        if not len(live):
            break
        done[live[:, None], pick] = True
        nodes = np.where(open_, ids[live[:, None], pick], n)
        new = graph[nodes].reshape(len(live), -1)
        new = np.sort(new, axis=1)
        fresh = ~seen[live[:, None], new]
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        seen[live[:, None], new] = True
        # only as wide as the row with most new nodes
        width = int(fresh.sum(1).max(initial=0))
        if not width:
            continue
        order = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
        new = np.where(np.take_along_axis(fresh, order, 1), np.take_along_axis(new, order, 1), n)
        near = _distances(points, squares, queries[live], np.minimum(new, n - 1))
        near[new == n] = np.inf
        all_ids = np.concatenate([ids[live], new], 1)
        all_distance = np.concatenate([distance[live], near], 1)
        all_done = np.concatenate([done[live], new == n], 1)
        best = np.argsort(all_distance, axis=1, kind="stable")[:, :beam]
        ids[live] = np.take_along_axis(all_ids, best, 1)
        distance[live] = np.take_along_axis(all_distance, best, 1)
        done[live] = np.take_along_axis(all_done, best, 1)
    return ids, distance


def robust_prune(points, squares, nodes: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
    """Up to ``DEGREE`` diverse neighbours of each node among its candidates (``len(points)`` stands for none)."""
    n = len(points)
    safe = np.minimum(candidates, n - 1)
    to_node = _distances(points, squares, points[nodes], safe) + squares[nodes][:, None]
    to_node[(candidates == n) | (candidates == nodes[:, None])] = np.inf
    ordered = np.sort(candidates, axis=1)
    twice = np.zeros(candidates.shape, dtype=bool)
    by_id = np.argsort(candidates, axis=1, kind="stable")
    np.put_along_axis(twice, by_id[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
    to_node[twice] = np.inf
    order = np.argsort(to_node, axis=1, kind="stable")
    candidates, to_node = np.take_along_axis(safe, order, 1), np.take_along_axis(to_node, order, 1)
    found = points[candidates]
    between = squares[candidates][:, :, None] + squares[candidates][:, None, :] - 2 * (found @ found.transpose(0, 2, 1))
    alive = np.isfinite(to_node)
    result = np.full((len(nodes), DEGREE), n, dtype=np.int64)
    rows = np.arange(len(nodes))
    for place in range(DEGREE):
        chosen = alive.argmax(1)
        valid = alive[rows, chosen]
        if not valid.any():
            break
        result[valid, place] = candidates[rows, chosen][valid]
        alive[rows, chosen] = False
        alive &= ~((alpha * alpha * between[rows, chosen] <= to_node) & valid[:, None])
    return result


def build_graph(points: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Neighbour lists (``len(points)`` stands for none) and the medoid."""
    n = len(points)
    squares = np.einsum("ij,ij->i", points, points)
    draw = np.random.default_rng(seed)
    graph = np.full((n + 1, DEGREE), n, dtype=np.int64)
    graph[:n] = draw.integers(0, n, (n, DEGREE))
    start = int((squares - 2 * points @ points.mean(0)).argmin())
    for alpha in (1.0, ALPHA):
        order = draw.permutation(n)
        for at in range(0, n, AT_ONCE):
            nodes = order[at : at + AT_ONCE]
            met, _ = beam_search(points, squares, graph, start, points[nodes], BUILD_BEAM)
            graph[nodes] = robust_prune(points, squares, nodes, np.concatenate([met, graph[nodes]], 1), alpha)
            # edges back, at most DEGREE new ones a node
            source = np.repeat(nodes, DEGREE)
            target = graph[nodes].ravel()
            real = target < n
            source, target = source[real], target[real]
            gap = squares[source] - 2 * np.einsum("ij,ij->i", points[source], points[target]) + squares[target]
            by = np.lexsort((gap, target))
            source, target = source[by], target[by]
            first = np.concatenate([[True], target[1:] != target[:-1]])
            nth = np.arange(len(target)) - np.maximum.accumulate(np.where(first, np.arange(len(target)), 0))
            some = nth < DEGREE
            targets = target[first]
            row = np.cumsum(first) - 1
            extra = np.full((len(targets), DEGREE), n, dtype=np.int64)
            extra[row[some], nth[some]] = source[some]
            for part in range(0, len(targets), AT_ONCE):
                mine = targets[part : part + AT_ONCE]
                every = np.concatenate([graph[mine], extra[part : part + AT_ONCE]], 1)
                graph[mine] = robust_prune(points, squares, mine, every, alpha)
    return graph, start


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """One more component that makes all norms equal, so nearness by distance is that by inner product."""
    squares = (vectors**2).sum(1)
    largest = squares.max(initial=0.0)
    scale = 1 / math.sqrt(largest) if largest else 1.0
    extra = np.sqrt(np.maximum(largest - squares, 0))[:, None]
    return (np.concatenate([vectors, extra], 1) * scale).astype(np.float32)


def _matrix(vectors, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _indexed(rows: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes (distinct vectors, the medoid first) with their neighbours."""
    shard = int(rows["shard"].iloc[0])
    rows = rows.assign(order=[tuple(v) for v in rows["vector"]])
    rows = rows.sort_values(["id", "order"]).drop_duplicates("id", keep="last")
    dim = max(len(v) for v in rows["vector"])
    vectors, node = np.unique(_matrix(rows["vector"], dim), axis=0, return_inverse=True)
    graph, start = build_graph(_lifted(vectors), shard)
    n = len(vectors)
    swap = np.arange(n + 1)
    swap[[0, start]] = swap[[start, 0]]
    ids = rows["id"].to_numpy()[np.lexsort((rows["id"], node.ravel()))]
    groups = np.split(ids, np.cumsum(np.bincount(node.ravel(), minlength=n))[:-1])
    renamed = swap[graph[swap[:n]]]
    return pd.DataFrame(
        {
            "shard": shard,
            "node": np.arange(n),
            "ids": [groups[i] for i in swap[:n]],
            "vector": list(vectors[swap[:n]]),
            "neighbours": [g[g < n].astype(np.int32) for g in renamed],
        }
    )


class _Shard:
    """A shard's graph, ready for searches."""

    def __init__(self, held: pa.Table) -> None:
        held = held.sort_by("node")
        self.ids = held.column("ids").to_pylist()
        vectors = held.column("vector").to_pylist()
        self.vectors = _matrix(vectors, max(map(len, vectors)))
        self.points = _lifted(self.vectors)
        self.squares = np.einsum("ij,ij->i", self.points, self.points)
        self.graph = np.full((len(vectors) + 1, DEGREE), len(vectors), dtype=np.int64)
        for i, neighbours in enumerate(held.column("neighbours").to_pylist()):
            self.graph[i, : len(neighbours)] = neighbours

    def search(self, own: list[int], vectors: list[list[float]], k: int, beam: int) -> Iterator[tuple[int, int, float]]:
        """(query id, id, score) of the best rows met by each query; components beyond the shard's count for nothing."""
        n, dim = self.vectors.shape
        queries = _matrix(vectors, max(dim, max(map(len, vectors))))
        lengths = np.sqrt((queries**2).sum(1, keepdims=True))
        queries, unit = queries[:, :dim], (queries / lengths)[:, :dim]
        flat = np.concatenate([unit, np.zeros((len(queries), 1))], 1).astype(np.float32)
        for at in range(0, len(queries), AT_ONCE):
            met, _ = beam_search(self.points, self.squares, self.graph, 0, flat[at : at + AT_ONCE], max(beam, k + 1))
            for i, nodes in enumerate(met):
                nodes = nodes[nodes < n]
                scores = (self.vectors[nodes] * queries[at + i]).sum(1)
                best = np.lexsort((nodes, -scores))[: k + 1]
                # a node's smallest ids are enough, one may be the query's own
                rows = [(v, s) for j, s in zip(nodes[best], scores[best]) for v in self.ids[j][: k + 1] if v != own[at + i]]
                rows.sort(key=lambda r: (-r[1], r[0]))
                yield from ((own[at + i], v, s) for v, s in rows[:k])


def build_index(vectors: DataFrame, shard_rows: int = 4096) -> tuple[DataFrame, int]:
    """The graph table of ``vectors`` (``id``, ``vector`` of doubles), and its number of shards."""
    shards = max(1, math.ceil(vectors.count() / shard_rows))
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return written(dealt.groupBy("shard").applyInPandas(_indexed, INDEX), "graph"), shards


def graph_search(index: DataFrame, shards: int, queries: DataFrame, k: int = 20, beam: int = SEARCH_BEAM) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the nearest rows found in all shards."""
    alone = queries.groupBy("id").agg(F.max("vector").alias("vector"))
    asked = alone.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(shard: _Shard, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, vectors = (batch.column(c).to_pylist() for c in ("id", "vector"))
        rows = list(shard.search(own, vectors, k, beam))
        if rows:
            kinds = (pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["query_id", "vec_id", "score"]
            )

    found = stream_past(index, asked, ["shard"], _Shard, search, FOUND, max(shards, width(index.sparkSession)))
    ranked = found.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    )
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``id`` and ``vector`` (doubles) of the rows that take part."""
    exact = F.transform(F.col(vector), lambda x: x.cast("double"))
    finite = F.forall(exact, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(exact, lambda x: x != 0)
    return rows.where(F.col(key).isNotNull() & (F.size(vector) > 0) & finite & some).select(
        F.col(key).cast("long").alias("id"), exact.alias("vector")
    )


def op4_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest other rows found for every row whose id is divisible by 20."""
    vectors = usable_vectors(table(spark, sf_dir, "embeddings"))
    index, shards = build_index(vectors)
    return graph_search(index, shards, vectors.where(F.col("id") % 20 == 0))
