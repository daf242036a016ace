"""Exact k nearest neighbours (Manhattan) in one bounded round.

Training rows belong to the nearest of a bounded number of pivots, as in the published pivot partitioning for
nearest-neighbour joins (Lu et al. 2012). Queries are dealt by their cells to chunks of bounded size (a crowded cell to several); a task
holds one chunk while the rows of the cells that it reaches stream past, its own cells first and then the others by distance. A query
visits just the cells that the triangle inequality leaves within the distance of its kth best row so far.
Inside a task whole numbers of 8 bits bound every distance from below, as in filter-and-refine searches over vector
approximations (Weber et al. 1998), where they leave too many pairs whole numbers of 16 bits do; only the pairs that are left are
measured in double precision. Searches of several groups (other columns or other rows each) run together in one plan, and
several views (some columns of a vector each) of a group share the visit of a pair: their common columns are bounded once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.operators.columns import quoted
from cytoframe.operators.resample import hash_number
from cytoframe.session import materialise

MOST_PIVOTS = 1024
HELD_VALUES = 4_000_000  # numbers that a task holds: vectors, and the distance and row of every neighbour
CHUNK = 32_768  # queries that share one copy of the rows
FEW = 1024  # queries that are not worth a copy of their own
SHARD = 8192  # rows that are compared together
LANES, ROWS = 4096, 64  # queries and rows of a tile
TILE = 131_072  # pairs measured at once
SMALL = 63  # steps of the bounds of 8 bits


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix; all lists are of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    return flat.reshape(len(column), -1)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    step = np.empty_like(out)
    for j in range(a.shape[1]):
        np.subtract(a[:, j, None], b[None, :, j], out=step)
        out += np.abs(step, out=step)
    return out


def _lists(column: pa.Array) -> list[tuple[int, np.ndarray]]:
    """Row numbers and matrix of each list length that occurs."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    return [(np.flatnonzero(size == n), _matrix(column.take(pa.array(np.flatnonzero(size == n))))) for n in np.unique(size)]


class _Views:
    """Views of a vector as places in it, and the parts that they are made of: places that lie in the same views."""

    def __init__(self, views: Sequence[Sequence[int]] | None) -> None:
        self.places = [None] if views is None else [np.array(v, dtype=int) for v in views]
        shared: dict[tuple, list[int]] = {}
        for j in sorted({j for v in views or [] for j in v}):
            shared.setdefault(tuple(i for i, v in enumerate(views) if j in v), []).append(j)
        self.parts = [(np.array(js, dtype=int), of) for of, js in shared.items()] or [(None, (0,))]

    def __len__(self) -> int:
        return len(self.places)

    def of(self, v: int, matrix: np.ndarray) -> np.ndarray:
        return matrix if self.places[v] is None else np.take(matrix, self.places[v], axis=1)

    def sums(self, of_part, used: Sequence[int] | None = None) -> list:
        """Per view (of those ``used``) the sum of ``of_part(places)`` over its parts; a part is computed once."""
        found: list = [None] * len(self)
        for places, views in self.parts:
            wanted = [v for v in views if used is None or v in used]
            made = of_part(slice(None) if places is None else places) if wanted else None
            for v in wanted:
                found[v] = made if found[v] is None else found[v] + made
        return found


class _Cells:
    """Pivots of every group, and once known the sizes and, per view, the radii of their cells."""

    def __init__(self, pivots: list[tuple[str, list[float]]], views: _Views) -> None:
        self.views = views
        self.of = {}
        for i, (group, vec) in enumerate(pivots):
            self.of.setdefault(group, []).append((i, vec))
        self.of = {g: (np.array([i for i, _ in p]), np.array([v for _, v in p])) for g, p in self.of.items()}

    def homes(self, groups: np.ndarray, vec: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        cell, d = np.full(len(groups), -1), np.full((len(groups), len(self.views)), np.nan)
        for rows, matrix in _lists(vec):
            for group in np.unique(groups[rows]):
                if group in self.of:
                    ids, centres = self.of[group]
                    here = np.flatnonzero(groups[rows] == group)
                    at = _manhattan(matrix[here], centres).argmin(axis=1)
                    away = np.abs(matrix[here] - centres[at])
                    cell[rows[here]] = ids[at]
                    d[rows[here]] = np.stack(self.views.sums(lambda p: away[:, p].sum(axis=1)), axis=1)
        return cell, d

    def measured(self, stats) -> None:
        size = max((r["cell"] for r in stats), default=-1) + 1
        self.inner, self.outer = np.zeros((len(self.views), size)), np.zeros((len(self.views), size))
        self.count, missing = np.zeros(size, dtype=np.int64), np.zeros((len(self.views), size), dtype=bool)
        for r in stats:
            self.inner[:, r["cell"]], self.outer[:, r["cell"]], self.count[r["cell"]] = r["lo"], r["hi"], r["n"]
            missing[:, r["cell"]] = r["missing"]
        # a pivot that draws no row has no cell
        for group, (ids, centres) in self.of.items():
            used = np.array([i < size and self.count[i] > 0 for i in ids], dtype=bool)
            self.of[group] = (ids[used], centres[used])
        self.spoiled = {g: missing[:, ids].any(axis=1) for g, (ids, _) in self.of.items()}

    def first(self, group: str, matrix: np.ndarray) -> np.ndarray:
        """Per view which vectors go to the first pivot; that is where vectors with missing numbers go."""
        out = np.ones((len(self.views), len(matrix)), dtype=bool)
        for a in range(0, len(matrix), LANES):
            far = self.views.sums(lambda p: _manhattan(matrix[a : a + LANES, p], self.of[group][1][:, p]))
            for v, d in enumerate(far):
                # with a pivot that misses numbers there is one cell only
                if not np.isnan(self.views.of(v, self.of[group][1])).any():
                    out[v, a : a + LANES] = d.argmin(axis=1) == 0
        return out

    def least(self, group: str, matrix: np.ndarray, some=slice(None)) -> tuple[list, list]:
        """Per view the distances to ``some`` of the group's pivots, and the least possible ones to the rows of their cells."""
        ids, centres = self.of[group][0][some], self.of[group][1][some]
        far = self.views.sums(lambda p: _manhattan(matrix[:, p], centres[:, p]))
        return far, [
            np.maximum(np.maximum(d - self.outer[v][ids], self.inner[v][ids] - d), 0.0) for v, d in enumerate(far)
        ]

    def bounds(self, group: str, matrix: np.ndarray, k: int) -> tuple[np.ndarray, list, list]:
        """Cells and, per view, the least possible distance to each, and a distance within which k rows lie for sure."""
        ids = self.of[group][0]
        far, lower = self.least(group, matrix)
        sure = []
        for v, d in enumerate(far):
            upper = d + self.outer[v][ids]
            order = np.argsort(upper, axis=1)
            enough = np.cumsum(self.count[ids][order], axis=1) >= min(k, int(self.count[ids].sum()))
            sure.append(np.take_along_axis(np.take_along_axis(upper, order, 1), enough.argmax(axis=1)[:, None], 1)[:, 0])
        return ids, lower, sure


def _reachable(distance: np.ndarray) -> np.ndarray:
    """A little more than a distance, for sums in another order; without a number everything is within reach."""
    return np.where(np.isnan(distance), np.inf, distance) * (1 + 1e-9) + 1e-12


def nearest_vectors(
    rows: DataFrame, asked: DataFrame, k: int, pivots: int | None = None, block: int = 2000, evaluations=None,
    views: Mapping[str, Sequence[int]] | None = None,
) -> DataFrame:
    """(g, q, t, distance, carry, rank) of the k nearest of ``rows`` (g, t, vec, carry) to each of ``asked`` (g, q, vec).

    Only rows of the same group g (a string) are compared, ``block`` of them at once; ties go to the smaller t. ``evaluations`` is an
    accumulator that counts the pairs compared. With ``views`` (places in vec by name) one search serves all of them, and the
    result is (g, q, and per view, by its name, the list of (distance, t, carry) by rank).
    """
    seen = _Views(None if views is None else list(views.values()))
    rows = materialise(rows.select("g", "t", "vec", "carry"))
    sizes = {r["g"]: r["n"] for r in rows.groupBy("g").agg(F.count("*").alias("n")).collect()}
    wanted = {g: pivots or min(MOST_PIVOTS, max(32, math.isqrt(n) // 4)) for g, n in sizes.items()}
    most = F.coalesce(*[F.when(F.col("g") == g, n) for g, n in wanted.items()], F.lit(0))
    draw = Window.partitionBy("g").orderBy(hash_number(0, F.col("t")), "t")
    picked = rows.withColumn("nth", F.row_number().over(draw)).where(F.col("nth") <= max(wanted.values(), default=0))
    cells = _Cells([(r["g"], r["vec"]) for r in picked.where(F.col("nth") <= most).select("g", "vec").collect()], seen)
    types = dict(rows.dtypes) | {"q": dict(asked.dtypes)["q"]}

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array(batch.column("g").to_pylist(), dtype=object)
            cell, d = cells.homes(groups, batch.column("vec"))
            far = pa.FixedSizeListArray.from_arrays(pa.array(d.ravel()), d.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), far], names=[*batch.schema.names, "cell", "d"])

    homes = materialise(
        rows.mapInArrow(at_home, f"g string, t {types['t']}, vec array<double>, carry {types['carry']}, cell int, d array<double>")
    ).where("cell >= 0")
    number = [F.when(~F.isnan(F.col("d")[v]), F.col("d")[v]) for v in range(len(seen))]
    ends = [F.array(*[F.coalesce(f(n), F.lit(0.0)) for n in number]).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi"))]
    ends.append(F.array(*[F.max(n.isNull()) for n in number]).alias("missing"))
    cells.measured(homes.groupBy("cell").agg(F.count("*").alias("n"), *ends).collect())
    asking = asked.select("g", "q", "vec").mapInArrow(
        at_home, f"g string, q {types['q']}, vec array<double>, cell int, d array<double>"
    )
    asking = materialise(asking.where("cell >= 0").drop("d").withColumn("h", F.xxhash64("q")))
    askers = {r["cell"]: r["n"] for r in asking.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    chunks = _Chunks(cells, askers, k, rows.sparkSession.sparkContext.defaultParallelism)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that hold a neighbour of any query of a chunk for all that the pivots tell."""
        found = set()
        for batch in batches:
            groups = np.array(batch.column("g").to_pylist(), dtype=object)
            home = batch.column("cell").to_numpy()
            chunk = chunks.of(home, batch.column("h").to_numpy())
            for rows_, matrix in _lists(batch.column("vec")):
                for group in np.unique(groups[rows_]):
                    here = np.flatnonzero(groups[rows_] == group)
                    at = rows_[here]
                    ids, lower, sure = cells.bounds(group, matrix[here], k)
                    near = ids[None, :] == home[at][:, None]
                    for v, (least, far) in enumerate(zip(lower, sure)):
                        near |= ~(least > (np.inf if cells.spoiled[group][v] else _reachable(far)[:, None]))
                    for c in np.unique(chunk[at]):
                        found.update((int(c), int(i)) for i in ids[near[chunk[at] == c].any(axis=0)])
        if found:
            yield pa.RecordBatch.from_pydict(dict(zip(("chunk", "cell"), map(lambda x: pa.array(x, pa.int32()), zip(*sorted(found))))))

    visits = asking.mapInArrow(reached, "chunk int, cell int").distinct().collect()
    sent = chunks.order([(r["chunk"], r["cell"]) for r in visits])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = pa.list_(pa.struct([("task", pa.int32()), ("turn", pa.int32())]))
        to = pa.array([sent.get(c, []) for c in range(len(cells.count))], turn)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("t", "vec", "carry", "cell")], to.take(batch.column("cell"))], names=["t", "vec", "carry", "cell", "to"]
            )

    def asked_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task = chunks.of(batch.column("cell").to_numpy(), batch.column("h").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("g", "q", "vec", "cell")], pa.array(task, pa.int32())], names=["g", "q", "vec", "cell", "task"]
            )

    held = homes.mapInArrow(
        placed, f"t {types['t']}, vec array<double>, carry {types['carry']}, cell int, to array<struct<task: int, turn: int>>"
    ).withColumn("to", F.explode("to"))
    held = held.select(
        "to.task", "to.turn", "cell", "t", "carry", "vec", F.lit(None).cast("string").alias("g"), F.lit(None).cast(types["q"]).alias("q")
    )
    queries = asking.mapInArrow(asked_of, f"g string, q {types['q']}, vec array<double>, cell int, task int").select(
        "task", F.lit(-1).alias("turn"), "cell", F.lit(None).cast(types["t"]).alias("t"), F.lit(None).cast(types["carry"]).alias("carry"),
        "vec", "g", "q",
    )
    # queries of a chunk come first, then the rows by cell
    both = held.unionByName(queries).repartitionById(max(1, len(chunks.group)), F.col("task")).sortWithinPartitions("task", "turn", "cell", "t")
    near = f"array<struct<distance: double, t: {types['t']}, carry: {types['carry']}>>"
    names = [f"near{v}" for v in range(len(seen))]

    def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, waiting, chunk = None, [], [], None

        def compared() -> None:
            nonlocal waiting
            if waiting:
                _Shard(waiting, k, block).nearest(chunk, evaluations)
            waiting = []

        for batch in batches:
            place = np.stack([batch.column("task").to_numpy(), batch.column("turn").to_numpy() >= 0], axis=1)
            edges = [0, *(np.flatnonzero((np.diff(place, axis=0) != 0).any(axis=1)) + 1).tolist(), len(place)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                piece, task = batch.slice(a, b - a), int(place[a][0])
                if task != now:
                    if chunk is not None:
                        compared()
                        yield from chunk.best(names)
                    now, pieces, chunk = task, [], None
                if not place[a][1]:
                    pieces.append(piece.select(["g", "q", "vec", "cell"]))
                elif pieces or chunk:
                    if chunk is None:
                        chunk, pieces = _Asked(pieces, k, cells), []
                    waiting.append(piece.select(["cell", "t", "carry", "vec"]))
                    if sum(map(len, waiting)) >= SHARD:
                        compared()
        if chunk is not None:
            compared()
            yield from chunk.best(names)

    found = both.mapInArrow(past, f"g string, q {types['q']}, " + ", ".join(f"{n} {near}" for n in names))
    # rows with the same key are one query
    best = [F.slice(F.array_sort(F.flatten(F.collect_list(n))), 1, k).alias(n) for n in names]
    found = found.groupBy("g", "q").agg(*best)
    if views is not None:
        return found.select("g", "q", *[F.col(n).alias(view) for n, view in zip(names, views)])
    each = found.select("g", "q", F.posexplode(names[0]).alias("nth", "one"))
    return each.select("g", "q", "one.t", "one.distance", "one.carry", (F.col("nth") + 1).alias("rank"))


class _Chunks:
    """Queries dealt by cell to chunks of bounded size, a group's cells to chunks of its own; a larger cell has several."""

    def __init__(self, cells: _Cells, askers: Mapping[int, int], k: int, parallel: int) -> None:
        self.cells = cells
        size = max(askers, default=-1) + 1
        self.first, self.parts = np.zeros(size, dtype="int64"), np.ones(size, dtype="int64")
        self.group: list[str] = []
        self.homes: list[list[int]] = []
        fair = -(-sum(askers.values()) // (3 * parallel))
        for group, (ids, centres) in cells.of.items():
            held = HELD_VALUES // (centres.shape[-1] + 2 * k * len(cells.views)) if len(ids) else 0
            most, room = max(64, min(CHUNK, held, max(FEW, fair))), 0
            for cell in (int(ids[i]) for i in self._chain(centres)):
                n = askers.get(cell, 0)
                if not n:
                    continue
                parts = -(-n // most)
                if parts > 1 or room < n:
                    self.first[cell], self.parts[cell] = len(self.group), parts
                    self.group += [group] * parts
                    self.homes += [[cell] for _ in range(parts)]
                    room = most - n if parts == 1 else 0
                else:
                    self.first[cell] = len(self.group) - 1
                    self.homes[-1].append(cell)
                    room -= n

    @staticmethod
    def _chain(centres: np.ndarray) -> list[int]:
        """Pivots one after the other, each the nearest to the one before that is left: cells of a chunk lie together."""
        left = np.ones(len(centres), dtype=bool)
        order: list[int] = []
        while left.any():
            far = np.nan_to_num(np.abs(centres - centres[order[-1]]).sum(axis=1), nan=np.inf) if order else np.zeros(len(centres))
            at = np.flatnonzero(left)
            order.append(int(at[far[at].argmin()]))
            left[order[-1]] = False
        return order

    def of(self, cell: np.ndarray, h: np.ndarray) -> np.ndarray:
        return self.first[cell] + h % self.parts[cell]

    def order(self, visits: list[tuple[int, int]]) -> dict[int, list[dict]]:
        """Per cell the chunks that it is sent to and its turn there: the chunk's own cells first, then by distance from these."""
        cells_of: dict[int, list[int]] = {}
        for chunk, cell in sorted(visits):
            cells_of.setdefault(chunk, []).append(cell)
        sent: dict[int, list[dict]] = {}
        for chunk, some in cells_of.items():
            ids, centres = self.cells.of[self.group[chunk]]
            place = {int(c): i for i, c in enumerate(ids)}
            own = centres[[place[c] for c in self.homes[chunk]]]
            far = [-1.0 if c in self.homes[chunk] else float(np.abs(own - centres[place[c]]).sum(axis=1).min()) for c in some]
            for turn, at in enumerate(np.argsort(np.nan_to_num(far, nan=np.inf), kind="stable")):
                sent.setdefault(some[at], []).append({"task": chunk, "turn": turn})
        return sent


class _Asked:
    """The queries that a task holds, and per view the k best rows of each so far."""

    def __init__(self, pieces: list[pa.RecordBatch], k: int, cells: _Cells) -> None:
        self.k, self.cells, self.views = k, cells, cells.views
        self.groups = pa.concat_arrays([p.column("g") for p in pieces])
        self.q = pa.concat_arrays([p.column("q") for p in pieces])
        self.exact = np.concatenate([_matrix(p.column("vec")) for p in pieces])
        self.home = np.concatenate([p.column("cell").to_numpy() for p in pieces])
        self.plain = np.isfinite(self.exact).all(axis=1)
        self.group = self.groups[0].as_py()
        n, v = len(self.q), len(self.views)
        self.distance, self.row = np.full((v, n, k), np.inf), np.full((v, n, k), -1, dtype="int64")
        self.reach = np.empty((v, n))
        for a in range(0, n, LANES):
            _, _, sure = cells.bounds(self.group, self.exact[a : a + LANES], k)
            self.reach[:, a : a + LANES] = _reachable(np.stack(sure))
        # a query that misses numbers sees the rows of the first pivot; where a row misses some, only the pivot's own queries see its rows
        self.missing = np.stack([np.isnan(cells.views.of(i, self.exact)).any(axis=1) for i in range(v)])
        self.spoiled = cells.spoiled[self.group]
        self.reach[self.spoiled] = np.inf
        self.first = cells.first(self.group, self.exact) if self.spoiled.any() or self.missing.any() else None
        # the rows among the best so far
        self.keys = self.carry = None

    def open(self, cell: int) -> np.ndarray:
        """Per view which queries a cell may hold a neighbour of."""
        at = np.flatnonzero(self.cells.of[self.group][0] == cell)
        _, lower = self.cells.least(self.group, self.exact, at)
        return ~(np.stack(lower)[:, :, 0] > _reachable(self.reach)) | (self.home == cell)

    def begin(self, keys: pa.Array, carry: pa.Array) -> int:
        """Takes in a shard's rows and returns the number of the first; rows that are among no best are let go."""
        if self.keys is not None:
            used, at = np.unique(self.row[self.row >= 0], return_inverse=True)
            self.row[self.row >= 0] = at
            self.keys, self.carry = self.keys.take(pa.array(used)), self.carry.take(pa.array(used))
            first = len(self.keys)
            self.keys, self.carry = pa.concat_arrays([self.keys, keys]), pa.concat_arrays([self.carry, carry])
        else:
            self.keys, self.carry, first = keys, carry, 0
        # order of the keys, for equal distances
        self.place = np.arange(len(self.keys))
        if not pa.types.is_nested(self.keys.type):
            self.place[pc.array_sort_indices(self.keys).to_numpy()] = np.arange(len(self.keys))
        return first

    def keep(self, v: int, q: np.ndarray, r: np.ndarray, d: np.ndarray) -> None:
        """The k best of the pairs and of those found before."""
        fits = ~(d > self.reach[v][q])
        q, r, d = q[fits], r[fits], d[fits]
        if not len(q):
            return
        k, row, distance = self.k, self.row[v], self.distance[v]
        some = np.unique(q)
        had = row[some] >= 0
        q = np.concatenate([q, np.repeat(some, had.sum(axis=1))])
        r, d = np.concatenate([r, row[some][had]]), np.concatenate([d, distance[some][had]])
        best = np.lexsort((self.place[r], d, q))
        q, r, d = q[best], r[best], d[best]
        starts = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        nth = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        q, r, d, nth = q[nth < k], r[nth < k], d[nth < k], nth[nth < k]
        distance[q, nth], row[q, nth] = d, r
        self.reach[v][some] = np.fmin(self.reach[v][some], distance[some, k - 1])

    def best(self, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.q), LANES):
            lists = []
            for v in range(len(self.views)):
                row, distance = self.row[v][a : a + LANES], self.distance[v][a : a + LANES]
                hit = row >= 0
                rows = pa.array(row[hit])
                one = pa.StructArray.from_arrays(
                    [pa.array(distance[hit]), self.keys.take(rows), self.carry.take(rows)], names=["distance", "t", "carry"]
                )
                lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hit.sum(axis=1))), pa.int32()), one))
            yield pa.RecordBatch.from_arrays([self.groups.slice(a, LANES), self.q.slice(a, LANES), *lists], names=["g", "q", *names])


class _Shard:
    """Rows that are compared together, by cell, in double precision and as whole numbers of 8 and of 16 bits."""

    def __init__(self, pieces: list[pa.RecordBatch], k: int, block: int) -> None:
        self.k = k
        self.keys = pa.concat_arrays([p.column("t") for p in pieces])
        self.carry = pa.concat_arrays([p.column("carry") for p in pieces])
        self.exact = np.concatenate([_matrix(p.column("vec")) for p in pieces])
        cell = np.concatenate([p.column("cell").to_numpy() for p in pieces])
        edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell)).tolist()
        self.blocks = [
            (int(cell[a]), at, min(at + block, b)) for a, b in zip(edges, edges[1:]) for at in range(a, b, block)
        ]
        self.finite = np.isfinite(self.exact).all(axis=1)
        # how fine the steps are: any choice gives right bounds
        whole = self.exact[self.finite][:: max(1, len(cell) // 4096)]
        width = self.exact.shape[1]
        self.levels = 32_000 // max(1, width)
        low, high, least, most = np.quantile(whole, (0.001, 0.999, 0.005, 0.995), axis=0) if len(whole) else np.zeros((4, width))
        self.low, self.step = low, max(float((high - low).max(initial=0.0)) / max(1, self.levels), 1e-300)
        self.coarse = np.ascontiguousarray(self._coarse(self.exact).T)
        self.least, self.stride = least, max(float((most - least).max(initial=0.0)) / SMALL, 1e-300)
        small, self.rest = self._small(self.exact)
        self.small = np.ascontiguousarray(small.T)

    def _coarse(self, exact: np.ndarray) -> np.ndarray:
        """Steps above ``low``. Cutting at both ends only brings values closer, so their distances still bound from below."""
        with np.errstate(invalid="ignore", over="ignore"):
            return np.nan_to_num(np.rint(np.clip((exact - self.low) / self.step, 0, self.levels))).astype("int16")

    def _small(self, exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_coarse`` in few wide steps, and what the rounding of every value may take off or add, in steps."""
        with np.errstate(invalid="ignore", over="ignore"):
            cut = np.nan_to_num(np.clip((exact - self.least) / self.stride, 0, SMALL))
        whole = np.rint(cut)
        return whole.astype("int8"), np.abs(cut - whole).astype("float32") + np.float32(1e-5)

    def _bounds(self, coarse: np.ndarray, a: int, b: int, places=None) -> np.ndarray:
        out = np.zeros((len(coarse), b - a), dtype="int16")
        step = np.empty_like(out)
        for j in range(coarse.shape[1]) if places is None else places:
            np.subtract(coarse[:, j, None], self.coarse[j, a:b], out=step)
            np.add(out, np.abs(step, out=step), out=out)
        return out

    @staticmethod
    def _distances(mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
        """Of rows to rows, each summed from the first column to the last."""
        diff = np.abs(mine - theirs)
        total = np.zeros(len(diff))
        for j in range(diff.shape[1]):
            total += diff[:, j]
        return total

    def _visible(self, asked: _Asked, v: int, q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs without those that missing numbers keep apart."""
        if asked.first is None:
            return q, r
        lost = self.first[v][r]
        seen = np.where(asked.missing[v][q], lost, ~(asked.spoiled[v] & lost & ~asked.first[v][q]))
        return q[seen], r[seen]

    def _within(self, mine: np.ndarray, v: int, q: np.ndarray, r: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that lie within reach in a view, and their distances."""
        theirs, found = self.seen[v], []
        for a in range(0, len(q), 512):
            i, j = q[a : a + 512], r[a : a + 512]
            x, y = mine[i], theirs[j]
            # sums in any order first
            left = np.flatnonzero(~(np.abs(x - y).sum(axis=1) > reach[a : a + 512]))
            found.append((i[left], j[left], self._distances(x[left], y[left])))
        return tuple(np.concatenate(f) for f in zip(*found))

    def nearest(self, asked: _Asked, evaluations) -> None:
        """Compares the rows with the queries that their cells are open to."""
        views, first = asked.views, asked.begin(self.keys, self.carry)
        self.seen = [views.of(v, self.exact) for v in range(len(views))]
        self.first = None if asked.first is None else asked.cells.first(asked.group, self.exact)
        width = self.exact.shape[1]
        small, rest = self._small(asked.exact)
        small = np.ascontiguousarray(small.T)
        loose = np.stack(views.sums(lambda p: rest[:, p].sum(axis=1)))
        slack = np.stack(views.sums(lambda p: self.rest[:, p].sum(axis=1)))
        sums = "uint16" if SMALL * width < 2**16 - 1 else "uint32"
        top = np.iinfo(sums).max
        cell_now, open_ = None, None
        spare: dict = {}

        def tile(m: int, n: int) -> list:
            if (m, n) not in spare:
                spare.clear()
                spare[m, n] = [np.empty((m, n), "int8"), np.empty((m, n), "uint8"), np.empty((m, -(-n // 8) * 8), bool)]
            return spare[m, n]

        for cell, a, b in self.blocks:
            if cell != cell_now:
                cell_now, open_ = cell, asked.open(cell)
            need = np.flatnonzero(open_.any(axis=0))
            if evaluations is not None:
                evaluations.add(len(need) * (b - a))
            rough = np.flatnonzero(~self.finite[a:b]) + a
            odd = need[~asked.plain[need]]
            for some, others in ((odd, np.arange(a, b)), (need[asked.plain[need]], rough)):
                if len(some) and len(others):
                    for v in range(len(views)):
                        for at in range(0, len(some), max(1, TILE // len(others))):
                            q = some[at : at + max(1, TILE // len(others))]
                            q, r = np.repeat(q, len(others)), np.tile(others, len(q))
                            q, r = self._visible(asked, v, q, r)
                            if len(q):
                                q, r, d = self._within(views.of(v, asked.exact), v, q, r, _reachable(asked.reach[v])[q])
                                asked.keep(v, q, r + first, d)
            need = need[asked.plain[need]]
            for at in range(0, len(need), LANES):
                self._lane(need[at : at + LANES], a, b, asked, open_, small, loose, slack, first, tile, sums, top)

    def _lane(self, who, a, b, asked, open_, small, loose, slack, first, tile, sums, top) -> None:
        """Some queries against the rows a to b: bounds of a tile at a time, then the pairs that these leave."""
        views = asked.views
        codes, exact = np.take(small, who, axis=1), asked.exact[who]
        mine, coarse = [views.of(v, exact) for v in range(len(views))], None
        used = [v for v in range(len(views)) if open_[v][who].any()]
        waiting: dict[int, list] = {v: [] for v in used}
        count = dict.fromkeys(used, 0)

        def limits(v: int) -> np.ndarray:
            """Sums of steps from which on a row is out of reach."""
            with np.errstate(over="ignore"):
                reach = _reachable(asked.reach[v][who]) / self.stride + loose[v][who] + slack[v][a:b].max() + 1e-3
            return np.where(open_[v][who], np.clip(np.floor(reach) + 1, 0, top), 0).astype(sums)

        def settle(v: int) -> None:
            q, r = (np.concatenate(x) for x in zip(*waiting[v]))
            q, r, d = self._within(mine[v], v, q, r, _reachable(asked.reach[v][who])[q])
            asked.keep(v, who[q], r + first, d)
            waiting[v], count[v] = [], 0
            most[v] = limits(v)

        most = {v: limits(v) for v in used}
        rows = np.flatnonzero(self.finite[a:b]) + a
        for at in range(0, len(rows), ROWS):
            here = rows[at : at + ROWS]
            step, few, hits = tile(len(here), len(who))
            hits[:, len(who) :] = False
            theirs = self.small[:, here, None]

            def part(places) -> np.ndarray:
                js = range(len(codes)) if isinstance(places, slice) else places.tolist()
                group = 255 // SMALL
                total = np.zeros(step.shape, sums)
                for at in range(0, len(js), group):
                    np.abs(np.subtract(codes[js[at]], theirs[js[at]], out=step), out=few.view("int8"))
                    for j in js[at + 1 : at + group]:
                        np.abs(np.subtract(codes[j], theirs[j], out=step), out=step)
                        np.add(few, step.view("uint8"), out=few)
                    np.add(total, few, out=total)
                return total

            for v, least in enumerate(views.sums(part, used)):
                if v not in most:
                    continue
                np.less(least, most[v], out=hits[:, : len(who)])
                words = np.flatnonzero(hits.reshape(-1).view("uint64"))
                if not len(words):
                    continue
                w, bit = np.nonzero(hits.reshape(-1, 8)[words])
                r, q = np.divmod(words[w] * 8 + bit, hits.shape[1])
                if len(q) > hits.size // 8 and np.isfinite(asked.reach[v][who]).all():
                    # wide steps tell too little here
                    coarse = self._coarse(exact) if coarse is None else coarse
                    lo, hi = int(here[0]), int(here[-1]) + 1
                    fine = self._bounds(coarse, lo, hi, views.places[v])[q, here[r] - lo]
                    wide = exact.shape[1] if views.places[v] is None else len(views.places[v])
                    left = fine <= np.minimum(_reachable(asked.reach[v][who]) / self.step + wide + 1, 32_001)[q]
                    q, r = q[left], r[left]
                own, r = self._visible(asked, v, who[q], here[r])
                waiting[v].append((np.searchsorted(who, own), r))
                count[v] += len(r)
                if count[v] > 4 * len(who):
                    settle(v)
        for v in used:
            if count[v]:
                settle(v)


def vector(features: Sequence[str]) -> Column:
    return F.array(*[quoted(f).cast("double") for f in features])


def nearest_rows(
    train: DataFrame,
    queries: DataFrame,
    features: Sequence[str],
    key: str,
    k: int,
    carry: str | None = None,
    pivots: int | None = None,
    block: int = 2000,
    evaluations=None,
) -> DataFrame:
    """(query key, neighbour key, distance, rank[, carried column]) of the k nearest rows.

    Equal distances are ordered by the neighbour's key.
    """
    one = F.lit("").alias("g")
    kept = quoted(carry) if carry else F.lit(0)
    rows = train.select(one, quoted(key).alias("t"), vector(features).alias("vec"), kept.alias("carry"))
    asked = queries.select(one, quoted(key).alias("q"), vector(features).alias("vec"))
    found = nearest_vectors(rows, asked, k, pivots, block, evaluations)
    return found.select(
        F.col("q").alias(key), F.col("t").alias("neighbour"), "distance", "rank",
        *([F.col("carry").alias(carry)] if carry else []),
    )


def knn_predict(
    train: DataFrame, queries: DataFrame, features: Sequence[str], y: str, key: str, k: int
) -> DataFrame:
    """Majority label of the k nearest training rows; the smaller label on ties."""
    return vote(nearest_rows(train, queries, features, key, k, carry=y), queries, y, key, k)


def vote(near: DataFrame, queries: DataFrame, y: str, key: str, k: int) -> DataFrame:
    """``queries`` with the majority label among the first k of ``nearest_rows``."""
    votes = near.where(F.col("rank") <= k).groupBy(quoted(key), quoted(y).alias("__y__")).agg(F.count("*").alias("__n__"))
    picked = votes.groupBy(quoted(key)).agg(
        F.max_by("__y__", F.struct(F.col("__n__"), -F.col("__y__"))).alias("__pred__")
    )
    return queries.join(picked, key)
