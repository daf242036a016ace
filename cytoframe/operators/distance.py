"""Exact distances inside images and the probe localisation measures built on them.

The squared distance to the nearest seed separates: first along columns (two running
windows), then along rows (the lower envelope of parabolas, all rows of a batch in lockstep). No
pixel-times-seed pairs are made; the largest unit of work is one row of one image.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.functions.scalars import ratio
from cytoframe.operators.columns import quoted
from cytoframe.operators.components import connected_components
from cytoframe.operators.joins import merge, semi
from cytoframe.operators.objects import bounding_boxes
from cytoframe.operators.pixels import rectangle
from cytoframe.session import materialise


BATCH_CELLS = 2_000_000  # of the padded matrix that one pass over rows works on


def row_distances(xs: pa.Array, gaps: pa.Array) -> pa.Array:
    """Row pass: per row min over x' of (x - x')^2 + gap(x')^2, as a root; nulls without seeds.

    All rows of the batch advance together in padded matrices, rows of similar length at a time.
    """
    length = xs.value_lengths().to_numpy(zero_copy_only=False)
    first = np.concatenate([[0], np.cumsum(length)])
    row = np.repeat(np.arange(len(length)), length)
    x = xs.flatten().to_numpy(zero_copy_only=False).astype("float64")
    gap = gaps.flatten().to_numpy(zero_copy_only=False).astype("float64")
    order = np.lexsort((gap, x, row))
    x, gap = x[order], gap[order]
    # a repeated pixel counts with its smallest gap
    again = np.zeros(len(x), dtype=bool)
    again[1:] = (row[1:] == row[:-1]) & (x[1:] == x[:-1])
    square = np.where(again | np.isnan(gap), np.inf, gap**2)
    place = np.arange(len(x)) - first[row]
    found = np.empty(len(x))
    by_length = np.argsort(length, kind="stable")
    at = 0
    while at < len(by_length):
        # the longest row of a chunk sets its width
        end = at + 1
        while end < len(by_length) and (end + 1 - at) * length[by_length[end]] <= BATCH_CELLS:
            end += 1
        chosen = by_length[at:end]
        width = int(length[chosen[-1]])
        if width:
            line = np.repeat(np.arange(len(chosen)), length[chosen])
            flat = np.repeat(first[chosen] - np.concatenate([[0], np.cumsum(length[chosen])[:-1]]), length[chosen]) + np.arange(len(line))
            wide_x, wide_square = np.zeros((len(chosen), width)), np.full((len(chosen), width), np.inf)
            wide_x[line, place[flat]] = x[flat]
            wide_square[line, place[flat]] = square[flat]
            found[flat] = _envelope_minima(wide_x, wide_square)[line, place[flat]]
        at = end
    back = np.empty(len(x))
    back[order] = np.sqrt(found)
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(back, mask=~np.isfinite(back)))


def _envelope_minima(x: np.ndarray, square: np.ndarray) -> np.ndarray:
    """Per row the lower envelope of the parabolas (x - x_i)^2 + square_i, at every x; x ascends, an infinite square is no seed.

    Each row has a stack of parabolas with the left border of each one's stretch; a column of the matrix is pushed on
    all stacks at once, and the rows that still have to pop shrink from step to step.
    """
    rows, width = x.shape
    low = np.zeros((rows, width), dtype=np.int64)
    border = np.full((rows, width), -np.inf)
    top = np.full(rows, -1)
    for q in range(width):
        pushed = np.flatnonzero(np.isfinite(square[:, q]))
        start = np.full(len(pushed), -np.inf)
        todo = np.flatnonzero(top[pushed] >= 0)
        while len(todo):
            r = pushed[todo]
            v = low[r, top[r]]
            cross = (square[r, q] - square[r, v] + x[r, q] ** 2 - x[r, v] ** 2) / (2 * (x[r, q] - x[r, v]))
            start[todo] = cross
            gone = cross <= border[r, top[r]]
            top[r[gone]] -= 1
            todo = todo[gone]
        top[pushed] += 1
        low[pushed, top[pushed]] = q
        border[pushed, top[pushed]] = start
    # the last parabola whose stretch begins before x, by bisection in all rows at once
    here, last = np.zeros((rows, width), dtype=np.int64), np.broadcast_to(np.maximum(top, 0)[:, None], (rows, width)).copy()
    line = np.arange(rows)[:, None]
    for _ in range(width.bit_length()):
        middle = (here + last + 1) // 2
        begun = border[line, middle] < x
        here, last = np.where(begun, middle, here), np.where(begun, last, np.maximum(middle - 1, here))
    best = np.full((rows, width), np.inf)
    for near in (-1, 0, 1):  # a rounded border may be off by one parabola
        seed = low[line, np.clip(here + near, 0, np.maximum(top, 0)[:, None])]
        best = np.minimum(best, (x - x[line, seed]) ** 2 + square[line, seed])
    return best


_row_distances = F.arrow_udf(row_distances, T.ArrayType(T.DoubleType()))


def distance_transform(
    pixels: DataFrame, keys: Sequence[str], seed: Column, out: str = "distance"
) -> DataFrame:
    """Add the Euclidean distance of every pixel to the nearest pixel where ``seed`` holds.

    ``pixels`` holds all pixels of the regions named by ``keys``; a region without a seed
    gives null.
    """
    by = [quoted(k) for k in keys]
    column = Window.partitionBy(*by, "x").orderBy("y")
    at = F.when(F.coalesce(seed, F.lit(False)), F.col("y"))
    above = F.last(at, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first(at, ignorenulls=True).over(column.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("y") - above, below - F.col("y")).cast("double")
    rest = [c for c in pixels.columns if c not in (*keys, "y", out)]
    # everything else of a pixel travels with it, so nothing is joined back
    rows = (
        pixels.select(*by, "y", *[quoted(c) for c in rest], gap.alias("__gap__"))
        .groupBy(*by, "y")
        .agg(F.collect_list(F.struct(*[quoted(c) for c in rest], "__gap__")).alias("__row__"))
    )
    reached = rows.withColumn("__ds__", _row_distances(F.col("__row__.x"), F.col("__row__.__gap__")))
    flat = reached.select(*by, "y", F.explode(F.arrays_zip("__row__", "__ds__")).alias("p"))
    return flat.select(*by, "y", *[F.col("p.__row__")[c].alias(c) for c in rest], F.col("p.__ds__").alias(out))


def cell_regions(
    pixels: DataFrame,
    columns: Sequence[str],
    margin: int = 5,
    inclusive: bool = False,
    fov: str = "fov",
    label: str = "label",
) -> DataFrame:
    """All image pixels in the widened box of each cell, with ``in_cell``.

    A box is widened at its low side only where that stays inside the image; at its high
    side the end is exclusive unless ``inclusive``.
    """
    boxes = bounding_boxes(pixels, fov, label)
    grow = lambda c: F.when(F.col(c) - margin > 0, F.col(c) - margin).otherwise(F.col(c))
    end = margin if inclusive else margin - 1
    boxes = boxes.select(
        quoted(fov), quoted(label), grow("y0").alias("y0"), (F.col("y1") + end).alias("y1"),
        grow("x0").alias("x0"), (F.col("x1") + end).alias("x1"),
    )
    frame = rectangle(boxes, 0, [fov, label])
    image = pixels.select(
        quoted(fov), "y", "x", quoted(label).alias("__own__"), *[quoted(c) for c in columns]
    )
    return (
        merge(frame, image, [fov, "y", "x"], "inner", False)
        .withColumn("in_cell", F.coalesce(F.col("__own__") == quoted(label), F.lit(False)))
        .drop("__own__")
    )


def object_pixels(pixels: DataFrame, value: str, keys: Sequence[str] = ("fov",)) -> DataFrame:
    """Coordinates of the pixels at or above 1."""
    return pixels.where(quoted(value) >= 1).select(*[quoted(k) for k in keys], "y", "x")


def probe_centres(
    regions: DataFrame, probe: str, keys: Sequence[str] = ("fov", "label")
) -> DataFrame:
    """Truncated centre of every 8-connected probe object inside a cell."""
    mask = regions.where(F.col("in_cell") & (quoted(probe) > 0)).select(
        *[quoted(k) for k in keys], "y", "x", F.lit(1).alias("__m__")
    )
    parts = connected_components(mask, list(keys), "__m__", "probe_object", 8)
    return parts.groupBy(*[quoted(k) for k in keys], "probe_object").agg(
        F.floor(F.avg("y")).cast("int").alias("y"), F.floor(F.avg("x")).cast("int").alias("x")
    )


def sample_at(
    centres: DataFrame, surface: DataFrame, values: Sequence[str],
    keys: Sequence[str] = ("fov", "label"),
) -> DataFrame:
    """Values of a pixel map at the centres."""
    at = surface.select(*[quoted(k) for k in keys], "y", "x", *[quoted(v) for v in values])
    return merge(centres, at, [*keys, "y", "x"], "left", False)


def relative_depth(cells: DataFrame, out: str = "depth") -> DataFrame:
    """Distance to the outside of the cell divided by its largest value in the cell.

    ``cells`` are cell regions with a margin of at least one pixel.
    """
    keys = ["fov", "label"]
    deep = distance_transform(cells, keys, ~F.col("in_cell"), "__d__")
    top = deep.groupBy(*keys).agg(F.max("__d__").alias("__top__"))
    return merge(deep, top, keys, "inner", False).withColumn(
        out, ratio("__d__", "__top__")
    ).drop("__d__", "__top__")


def seed_and_edge_distances(
    regions: DataFrame, seed: str, keys: Sequence[str] = ("fov", "label")
) -> DataFrame:
    """Per region pixel: distance to the seed mask, to the outside of the cell, and the
    share seed / (outside + seed)."""
    keys = list(keys)
    both = distance_transform(regions, keys, quoted(seed) > 0, "d_seed")
    if "d_edge" not in both.columns:  # it does not depend on the seed, a caller may have it
        both = distance_transform(both, keys, ~F.col("in_cell"), "d_edge")
    return both.withColumn("d_share", ratio("d_seed", F.col("d_seed") + F.col("d_edge")))


def scaled_map(pixels: DataFrame, value: str, out: str, fov: str = "fov") -> DataFrame:
    """A map divided by its image maximum, 0 outside cells."""
    top = pixels.groupBy(quoted(fov)).agg(F.max(quoted(value)).alias("__top__"))
    joined = merge(pixels, top, [fov], "inner", False)
    return joined.withColumn(
        out, F.when(F.col("label") > 0, ratio(value, "__top__")).otherwise(F.lit(0.0))
    ).drop("__top__")


def statistics_columns(value: str, prefix: str = "", quarters: bool = False) -> list[Column]:
    """Median, mean, sd, sum and quartiles of the values that are not negative.

    ``quarters`` adds counts in the four quarters of 0..1, plain and divided by the number
    of values (the last one by the number of values above 0).
    """
    v = F.when(quoted(value) >= 0, quoted(value).cast("double"))
    made = {
        "median": F.percentile(v, 0.5),
        "mean": F.avg(v),
        "std": F.stddev_pop(v),
        "sum": F.sum(v),
        "c25": F.percentile(v, 0.25),
        "c50": F.percentile(v, 0.5),
        "c75": F.percentile(v, 0.75),
    }
    if quarters:
        known = F.count(v)
        counts = {
            "bin25count": F.count_if((v >= 0) & (v < 0.25)),
            "bin50count": F.count_if((v >= 0.25) & (v < 0.5)),
            "bin75count": F.count_if((v >= 0.5) & (v < 0.75)),
            "bin100count": F.count_if(v >= 0.75),
        }
        made.update(counts)
        for name, c in counts.items():
            base = F.count_if(v > 0) if name == "bin100count" else known
            made[f"norm_count_{name}"] = F.try_divide(c.cast("double"), base.cast("double"))
    return [e.alias(prefix + n) for n, e in made.items()]


def value_statistics(
    df: DataFrame, keys: Sequence[str], value: str, prefix: str = "", quarters: bool = False
) -> DataFrame:
    """Statistics per cell; -1 marks a value outside and is ignored."""
    return df.groupBy(*[quoted(k) for k in keys]).agg(
        *statistics_columns(value, prefix, quarters)
    )


def normalised_by_area(
    per_object: DataFrame, per_pixel: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """Objects per quarter divided by the pixels of the cell in the same quarter."""
    quarter = lambda c: F.least(F.floor(quoted(c) * 4), F.lit(3)).cast("int")

    def counted(df, name):
        return (
            df.where(quoted(value) >= 0)
            .groupBy(*[quoted(k) for k in keys], quarter(value).alias("quarter"))
            .agg(F.count("*").alias(name))
        )

    both = merge(counted(per_pixel, "pixels"), counted(per_object, "objects"),
                 [*keys, "quarter"], "left", False).fillna(0, ["objects"])
    return both.withColumn("objects_per_pixel", ratio("objects", "pixels"))


def probe_localisation(
    pixels: DataFrame,
    probes: Sequence[str],
    seeds: Sequence[str] = ("nucleus", "structure"),
    margin: int = 5,
    inclusive: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One row per (cell, probe) with distance statistics to each seed, and the failed cells.

    A cell with none of a seed's pixels in its box has no distances; it goes to the second
    table instead of stopping the job.
    """
    keys = ["fov", "label"]
    regions = materialise(cell_regions(pixels, [*probes, *seeds], margin, inclusive))
    held = regions.groupBy(*keys).agg(*[F.max(quoted(s)).alias(s) for s in seeds])
    has_all = F.least(F.lit(1), *[F.coalesce(quoted(s), F.lit(0)) for s in seeds]) > 0
    usable = materialise(held.select(*keys, has_all.alias("usable")))
    failed = usable.where(~F.col("usable")).select(*keys)
    usable = usable.where("usable").select(*keys)
    surface = distance_transform(semi(regions, usable, keys), keys, ~F.col("in_cell"), "d_edge")
    for s in seeds:
        surface = seed_and_edge_distances(surface, s).withColumnsRenamed(
            {"d_seed": f"abs_dist_{s}", "d_share": f"dist_{s}"}
        )
    values = [f"{kind}_{s}" for s in seeds for kind in ("dist", "abs_dist")]
    surface = materialise(surface.select(*keys, "y", "x", *values))
    out = None
    for p in probes:
        points = sample_at(
            probe_centres(semi(regions, usable, keys), p), surface, values
        )
        measured = points.groupBy(*keys).agg(
            *[c for v in values for c in statistics_columns(v, f"{v}_")],
            F.sort_array(F.collect_list(F.struct("y", "x"))).alias("probe_centres"),
            F.count("*").alias("probe_objects"),
        )
        rows = merge(usable, measured, keys, "left", False).withColumn("probe", F.lit(p))
        out = rows if out is None else out.unionByName(rows)
    return out, failed
