"""Grey-level co-occurrence by distance and angle, texture measures and the decay fit."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.operators.columns import dense, quoted
from cytoframe.operators.joins import merge


def cropped_cells(
    pixels: DataFrame, value: str = "v", keys: Sequence[str] = ("fov", "label"),
    shares: tuple[float, float] = (0.02, 0.98), inclusive: bool = False,
) -> DataFrame:
    """Non-zero cell pixels clipped to two percentiles of the cell.

    The box end is exclusive unless ``inclusive``: the last row and column of the cell are
    cut off after the percentiles are taken.
    """
    by = [quoted(k) for k in keys]
    held = pixels.where((quoted(keys[-1]) > 0) & (quoted(value) != 0))
    stats = held.groupBy(*by).agg(
        F.percentile(quoted(value), list(shares)).alias("__q__"),
        F.max("y").alias("__y1__"), F.max("x").alias("__x1__"),
    )
    joined = merge(held, stats, list(keys), "inner", False)
    if not inclusive:
        joined = joined.where((F.col("y") < F.col("__y1__")) & (F.col("x") < F.col("__x1__")))
    clipped = F.least(F.greatest(quoted(value), F.get("__q__", F.lit(0))), F.get("__q__", F.lit(1)))
    return joined.select(*by, "y", "x", F.floor(clipped).cast("long").alias(value))


def quantised(
    cells: DataFrame, value: str = "v", keys: Sequence[str] = ("fov", "label"),
    levels: int = 8, out: str = "level",
) -> DataFrame:
    """Percentile levels 1..n of the positive pixels of each cell; background has no row."""
    held = cells.where(quoted(value) > 0)
    shares = [i / levels for i in range(levels)]
    edges = held.groupBy(*[quoted(k) for k in keys]).agg(
        F.percentile(quoted(value), shares).alias("__e__")
    )
    joined = merge(held, edges, list(keys), "inner", False)
    return joined.withColumn(
        out, F.size(F.filter("__e__", lambda e: e <= quoted(value)))
    ).drop("__e__")


def offsets(distances: Sequence[int], angles: Sequence[float]) -> list[tuple]:
    """(distance, angle number, dy, dx): steps rounded to whole pixels, halves away from 0."""
    away = lambda t: int(math.copysign(math.floor(abs(t) + 0.5), t))
    return [
        (d, i, away(math.sin(a) * d), away(math.cos(a) * d))
        for d in distances
        for i, a in enumerate(angles)
    ]


def even_angles(n: int = 16) -> list[float]:
    """``n`` angles from 0 to pi, both included."""
    return [math.pi * i / (n - 1) for i in range(n)] if n > 1 else [0.0]


def _padded(rows: pd.Series, starts, width: int):
    """Rows of different lengths as one matrix, row r shifted right by ``starts[r]``."""
    lengths = np.array([len(r) for r in rows])
    out = np.zeros((len(rows), width), dtype="int64")
    row = np.repeat(np.arange(len(rows)), lengths)
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = place + np.repeat(np.asarray(starts), lengths)
    inside = (place >= 0) & (place < width)
    out[row[inside], place[inside]] = np.concatenate(list(rows))[inside]
    return out


def _count_pairs(part: pd.DataFrame, keys: list[str], columns: list[int], levels: int):
    """Level pair counts of row pairs with one row distance, for all column steps at once."""
    cell = part.groupby(keys, sort=False).ngroup().to_numpy()
    names = part[keys].iloc[np.unique(cell, return_index=True)[1]]
    reach = max(abs(d) for d in columns)
    width = int(part["row"].map(len).max())
    a = _padded(part["row"], np.zeros(len(part), dtype="int64"), width)
    shift = (part["__x1__"] - part["x0"]).to_numpy() + reach
    b = _padded(part["__row1__"], shift, width + 2 * reach)
    for dx in columns:
        q = b[:, reach + dx : reach + dx + width]
        both = (a > 0) & (q > 0)
        code = (np.broadcast_to(cell[:, None], a.shape)[both] * levels + a[both]) * levels + q[both]
        found, n = np.unique(code, return_counts=True)
        made = names.iloc[found // (levels * levels)].reset_index(drop=True)
        yield made.assign(dx=dx, i=found // levels % levels, j=found % levels, n=n)


def cooccurrence(
    cells: DataFrame, steps: Sequence[tuple[int, int]], level: str = "level",
    keys: Sequence[str] = ("fov", "label"),
) -> DataFrame:
    """Directed counts (keys, dy, dx, i, j, n) of level pairs at each (dy, dx) step.

    Rows of a cell are packed into arrays and joined once per row distance, so the shuffle
    carries rows times row distances instead of pixels times steps. Pairs are counted in
    Arrow batches of rows; a batch is cut where its matrices would grow large.
    """
    keys = list(keys)
    by = [quoted(k) for k in keys]
    wanted: dict[int, list[int]] = {}
    for dy, dx in sorted(set(steps)):
        wanted.setdefault(dy, []).append(dx)
    rows = (
        cells.groupBy(*by, "y")
        .agg(
            F.min("x").alias("x0"), F.max("x").alias("x1"),
            F.array_sort(
                F.collect_list(
                    F.struct(F.col("x").cast("int").alias("k"), F.coalesce(quoted(level), F.lit(0)).cast("int").alias("v"))
                )
            ).alias("__e__"),
        )
        .select(
            *by, "y", "x0",
            dense("__e__", F.col("x0").cast("int"), F.col("x1").cast("int") + 1, F.lit(0)).alias("row"),
        )
    )
    here = rows.select(
        *by, F.explode(F.array(*[F.lit(d) for d in wanted])).alias("dy"), "y", "x0", "row"
    ).withColumn("y", F.col("y") + F.col("dy"))
    there = rows.select(*by, "y", F.col("x0").alias("__x1__"), F.col("row").alias("__row1__"))
    paired = here.join(there, [*keys, "y"]).drop("y")
    types = dict(cells.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", dy int, dx int, i int, j int, n long"

    def count(batches):
        for batch in batches:
            widest = int(batch["row"].map(len).max()) if len(batch) else 1
            size = max(1, 4_000_000 // widest)
            for start in range(0, len(batch), size):
                piece = batch.iloc[start : start + size]
                levels = 1 + max(int(max(map(max, piece["row"]))), int(max(map(max, piece["__row1__"]))))
                for dy, part in piece.groupby("dy", sort=False):
                    for made in _count_pairs(part, keys, wanted[int(dy)], levels):
                        yield made.assign(dy=int(dy))[[*keys, "dy", "dx", "i", "j", "n"]]

    counts = paired.mapInPandas(count, schema)
    return counts.groupBy(*by, "dy", "dx", "i", "j").agg(F.sum("n").alias("n"))


def step_correlation(counts: DataFrame, keys: Sequence[str] = ("fov", "label")) -> DataFrame:
    """Correlation of the two levels per step; 1 where either of them does not vary."""
    i, j, n = F.col("i").cast("long"), F.col("j").cast("long"), F.col("n")
    sums = counts.groupBy(*[quoted(k) for k in keys], "dy", "dx").agg(
        F.sum("n").alias("n"), F.sum(n * i).alias("si"), F.sum(n * j).alias("sj"),
        F.sum(n * i * i).alias("sii"), F.sum(n * j * j).alias("sjj"), F.sum(n * i * j).alias("sij"),
    )
    vi = F.col("n") * F.col("sii") - F.col("si") * F.col("si")
    vj = F.col("n") * F.col("sjj") - F.col("sj") * F.col("sj")
    cov = F.col("n") * F.col("sij") - F.col("si") * F.col("sj")
    corr = F.when((vi > 0) & (vj > 0), cov / F.sqrt(vi.cast("double") * vj.cast("double")))
    return sums.select(*[quoted(k) for k in keys], "dy", "dx",
                       F.coalesce(corr, F.lit(1.0)).alias("corr"))


BATCH_CELLS = 2_000_000  # of the padded boxes that are transformed together


def _step_sums(boxes: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs n and the sums of i, j, i^2, j^2 and ij over them, of every box (cells x height x width, 0 = no level) and step.

    Correlations by the transform: three spectra give all steps at once, and as all sums are whole numbers they are rounded.
    """
    _, height, width = boxes.shape
    shape = (height + min(int(np.abs(dy).max(initial=0)), height), width + min(int(np.abs(dx).max(initial=0)), width))
    seen = (boxes > 0).astype("float64")
    m, a, a2 = (np.fft.rfft2(v, s=shape) for v in (seen, boxes, boxes * boxes))
    near = (np.abs(dy) < height) & (np.abs(dx) < width)

    def at_steps(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        whole = np.fft.irfft2(np.conj(left) * right, s=shape)
        out = np.zeros((len(boxes), len(dy)))
        out[:, near] = np.rint(whole[:, dy[near] % shape[0], dx[near] % shape[1]])
        return out

    return at_steps(m, m), at_steps(a, m), at_steps(m, a), at_steps(a2, m), at_steps(m, a2), at_steps(a, a)


def _correlations(boxes: np.ndarray, dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
    n, si, sj, sii, sjj, sij = _step_sums(boxes, dy, dx)
    vi, vj = n * sii - si * si, n * sjj - sj * sj
    varies = (vi > 0) & (vj > 0)
    return np.where(varies, (n * sij - si * sj) / np.sqrt(np.where(varies, vi, 1.0) * np.where(varies, vj, 1.0)), 1.0)


def correlation_by_angle(
    cells: DataFrame,
    distances: Sequence[int] = tuple(range(33)),
    angles: Sequence[float] | None = None,
    level: str = "level",
    keys: Sequence[str] = ("fov", "label"),
) -> DataFrame:
    """|correlation| per (cell, distance, angle); 1 where a step has no pairs or levels that do not vary.

    A cell's pixels are one row; boxes of similar size are transformed together, and one transform
    serves all steps, so the cost does not grow with their number. One shuffle, no join.
    """
    angles = even_angles() if angles is None else angles
    table = offsets(distances, angles)
    keys = list(keys)
    by = [quoted(k) for k in keys]
    dy, dx = (np.array([t[i] for t in table], dtype=np.int64) for i in (2, 3))
    packed = cells.groupBy(*by).agg(
        F.collect_list(F.struct(F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"),
                                F.coalesce(quoted(level), F.lit(0)).cast("long").alias("v"))).alias("__p__")
    ).select(*by, *[F.col("__p__")[c].alias(f"__{c}__") for c in "yxv"])
    types = dict(cells.dtypes)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(f"__{c}__") for c in "yxv"]
            length = lists[0].value_lengths().to_numpy(zero_copy_only=False)
            y, x, v = (c.flatten().to_numpy() for c in lists)
            first = np.concatenate([[0], np.cumsum(length)])[:-1]
            cell = np.repeat(np.arange(len(length)), length)
            y0, x0 = np.minimum.reduceat(y, first), np.minimum.reduceat(x, first)
            size = np.stack([np.maximum.reduceat(y, first) - y0, np.maximum.reduceat(x, first) - x0], axis=1) + 1
            # boxes are padded to powers of two, so those of one padded size share their matrices
            padded = 2 ** np.ceil(np.log2(size)).astype(np.int64)
            corr = np.empty((len(length), len(table)))
            for shape in np.unique(padded, axis=0):
                alike = np.flatnonzero((padded == shape).all(axis=1))
                step = max(1, BATCH_CELLS // int(4 * shape.prod()))
                for at in range(0, len(alike), step):
                    chosen = alike[at : at + step]
                    line = np.full(len(length), -1)
                    line[chosen] = np.arange(len(chosen))
                    mine = np.flatnonzero(line[cell] >= 0)
                    boxes = np.zeros((len(chosen), *shape))
                    boxes[line[cell[mine]], y[mine] - y0[cell[mine]], x[mine] - x0[cell[mine]]] = v[mine]
                    corr[chosen] = np.abs(_correlations(boxes, dy, dx))
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(corr) + 1) * len(table), pa.int32()), pa.array(corr.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], values], names=[*keys, "corr"])

    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", corr array<double>"
    step = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(a).alias("a")) for d, a, _, _ in table])
    return packed.mapInArrow(measure, schema).select(*by, F.explode(F.arrays_zip(step.alias("s"), "corr")).alias("z")).select(
        *by, F.col("z.s.d").alias("d"), F.col("z.s.a").alias("a"), F.col("z.corr").alias("corr")
    )


def variation_over_angles(corr: DataFrame, keys: Sequence[str] = ("fov", "label"),
                          eps: float = 0.1) -> DataFrame:
    """Deviation over angles divided by a mean held above ``eps``, per distance."""
    mean = F.lit(eps) + F.lit(1 - eps) * F.avg("corr")
    return corr.groupBy(*[quoted(k) for k in keys], "d").agg(
        (F.stddev_pop("corr") / mean).alias("cv")
    )


def max_variation(cv: DataFrame, keys: Sequence[str] = ("fov", "label")) -> DataFrame:
    return cv.groupBy(*[quoted(k) for k in keys]).agg(
        F.max("cv").alias("Maximum_Coefficient_Variation")
    )


DECAY_STEPS = 200


def decay_rates(distances: pa.Array, curves: pa.Array, decay: float) -> np.ndarray:
    """Weighted least squares rate of exp(-a d^2) per curve: damped Gauss-Newton steps of all curves of a batch at once."""
    size = distances.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    d, y, w = (np.zeros((len(size), int(size.max(initial=0)))) for _ in range(3))
    d[row, place] = distances.flatten().to_numpy(zero_copy_only=False)
    y[row, place] = curves.flatten().to_numpy(zero_copy_only=False)
    w[row, place] = np.exp(-decay * d[row, place])
    square = d * d

    def cost(rate: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((w[at] * (y[at] - np.exp(-rate[:, None] * square[at]))) ** 2).sum(axis=1)

    rate, damping = np.full(len(size), 0.005), np.full(len(size), 1e-3)
    moving = np.arange(len(size))
    best = cost(rate, moving)
    for _ in range(DECAY_STEPS):
        model = np.exp(-rate[moving, None] * square[moving])
        slope = -square[moving] * model * w[moving]
        curvature = (slope * slope).sum(axis=1)
        steep = curvature > 0
        moving, curvature = moving[steep], curvature[steep]
        if not len(moving):
            break
        gain = (slope[steep] * (w[moving] * (y[moving] - model[steep]))).sum(axis=1)
        step = gain / (curvature * (1 + damping[moving]))
        tried = cost(rate[moving] + step, moving)
        better = tried <= best[moving]
        done = better & (np.abs(step) <= 1e-12 * np.maximum(1.0, np.abs(rate[moving])))
        rate[moving[better]] += step[better]
        best[moving[better]] = tried[better]
        damping[moving] *= np.where(better, 0.1, 10.0)
        moving = moving[~done & (damping[moving] <= 1e12)]
    return rate


@F.arrow_udf(T.DoubleType())
def _decay_rate(distances: pa.Array, curves: pa.Array, decay: pa.Array) -> pa.Array:
    return pa.array(decay_rates(distances, curves, decay[0].as_py() if len(decay) else 0.0))


def decay_residuals(
    corr: DataFrame, keys: Sequence[str] = ("fov", "label"), decay: float = 0.5
) -> DataFrame:
    """Fit exp(-a d^2) to each curve over the distances; the rest is ``residual``."""
    by = [quoted(k) for k in keys]
    curves = corr.groupBy(*by, "a").agg(
        F.sort_array(F.collect_list(F.struct("d", "corr"))).alias("__c__")
    )
    fitted = curves.withColumn(
        "rate", _decay_rate(F.col("__c__.d"), F.col("__c__.corr"), F.lit(decay))
    )
    return fitted.select(*by, "a", "rate", F.explode("__c__").alias("c")).select(
        *by, "a", "rate", F.col("c.d").alias("d"), F.col("c.corr").alias("corr"),
        (F.col("c.corr") - F.exp(-F.col("rate") * F.col("c.d") * F.col("c.d"))).alias("residual"),
    )


def peaks(residuals: DataFrame, angles: Sequence[float],
          keys: Sequence[str] = ("fov", "label"), value: str = "residual") -> DataFrame:
    """Highest residual with its distance and angle (degrees), first in order on ties."""
    degrees = F.array(*[F.lit(180.0 * a / math.pi) for a in angles])
    return residuals.groupBy(*[quoted(k) for k in keys]).agg(
        F.max(value).alias("Peak_Height"),
        F.max_by("d", F.struct(F.col(value), -F.col("d"))).cast("double").alias("Peak_Distance"),
        F.get(degrees, F.max_by("a", F.struct(F.col(value), -F.col("a")))).alias("Peak_Angle"),
    )


def global_alignment(
    pixels: DataFrame, value: str = "v", keys: Sequence[str] = ("fov", "label"),
    levels: int = 8, dmax: int = 32, nangles: int = 16, decay: float = 0.5,
    inclusive: bool = False,
) -> DataFrame:
    """Texture alignment of each cell: largest variation over angles, and the peak."""
    angles = even_angles(nangles)
    cells = quantised(cropped_cells(pixels, value, keys, inclusive=inclusive), value, keys, levels)
    corr = correlation_by_angle(cells, list(range(dmax + 1)), angles, keys=keys)
    best = max_variation(variation_over_angles(corr, keys), keys)
    top = peaks(decay_residuals(corr, keys, decay), angles, keys)
    return merge(best, top, list(keys), "inner", False)


def texture_measures(
    cells: DataFrame, scales: Sequence[int] = (3, 5, 10), level: str = "level",
    keys: Sequence[str] = ("fov", "label"),
) -> DataFrame:
    """Contrast, energy, homogeneity, entropy and correlation per scale and direction.

    Directions are right, down-right, down and down-left at the given pixel distance.
    """
    directions = [(0, 1), (1, 1), (1, 0), (1, -1)]
    steps = [(dy * s, dx * s) for s in scales for dy, dx in directions]
    counts = cooccurrence(cells, steps, level, keys)
    by = [*[quoted(k) for k in keys], F.col("dy"), F.col("dx")]
    total = counts.groupBy(*by).agg(F.sum("n").alias("__t__"))
    p = merge(counts, total, [*keys, "dy", "dx"], "inner", False).withColumn(
        "p", F.col("n") / F.col("__t__")
    )
    step = F.col("i") - F.col("j")
    measures = p.groupBy(*by).agg(
        F.sum("n").alias("pairs"),
        F.sum(F.col("p") * step * step).alias("contrast"),
        F.sum(F.col("p") * F.col("p")).alias("energy"),
        F.sum(F.col("p") / (1 + step * step)).alias("homogeneity"),
        (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"),
    )
    corr = step_correlation(counts, keys).withColumnRenamed("corr", "correlation")
    return merge(measures, corr, [*keys, "dy", "dx"], "inner", False)
