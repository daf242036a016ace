"""Sliding patches, averaging of predictions and class map clean-up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions.scalars import ratio
from cytoframe.operators.columns import quoted
from cytoframe.operators.joins import merge
from cytoframe.operators.objects import class_map


def _in_strips(pixels: DataFrame, fov: str, value: str, size: int, stride: int) -> DataFrame:
    """Image rows as arrays (fov, y, xs, vs), each sent once to every row of patches that covers it: r is their centre.

    A pixel is shuffled once into its row and then size / stride times with it, whatever the width of the image.
    """
    half = size // 2
    first = F.floor((F.col("y") - (size - half)) / F.lit(stride)) + 1
    last = F.floor((F.least(F.col("y") + half, "__h__")) / F.lit(stride))
    rows = pixels.groupBy(quoted(fov), "y").agg(F.collect_list(F.struct("x", quoted(value).cast("double").alias("v"))).alias("row"))
    tall = pixels.groupBy(quoted(fov)).agg(F.max("y").alias("__h__"), F.max("x").alias("__w__"))
    grid = F.when(F.greatest(first, F.lit(0)) <= last, F.sequence(F.greatest(first, F.lit(0)), last))
    return merge(rows, tall, [fov], "inner", False).select(
        quoted(fov).alias("fov"), F.explode(F.transform(grid, lambda k: (k * stride).cast("int"))).alias("r"),
        F.col("y").cast("int").alias("y"), F.col("__w__").cast("int").alias("wide"),
        F.transform("row", lambda p: p["x"].cast("int")).alias("xs"), F.transform("row", lambda p: p["v"]).alias("vs"),
    )


def _patches(pixels: DataFrame, fov: str, value: str, size: int, stride: int, filled: bool) -> DataFrame:
    """One row a patch: its values divided by their maximum, whole (``filled``, zero where there is no pixel) or as places and values."""
    strips = _in_strips(pixels, fov, value, size, stride)
    half, kind = size // 2, dict(strips.dtypes)["fov"]
    shares = pa.list_(pa.float64())

    def cut(key: tuple, strip: pa.Table) -> pa.Table:
        """All patches of one row of them, sliced from its image rows."""
        r, wide = key[1].as_py(), strip.column("wide")[0].as_py()
        xs, vs = (strip.column(c).combine_chunks() for c in ("xs", "vs"))
        y = np.repeat(strip.column("y").to_numpy(), xs.value_lengths().to_numpy())
        # columns reach half a patch beyond the image on either side
        image = np.full((size, wide + 1 + 2 * size), np.nan)
        held = np.zeros(image.shape, dtype=bool)
        at = (y - (r - half), xs.flatten().to_numpy() + half)
        image[at] = vs.flatten().to_numpy(zero_copy_only=False)
        held[at] = True
        out = {"c": [], "place": [], "patch": []}
        for c in range(0, wide + 1, stride):
            inside, part = held[:, c : c + size], image[:, c : c + size]
            if not inside.any():
                continue
            known = part[~np.isnan(part)]
            most = known.max() if len(known) else 0.0
            share = part / most if most else np.full(part.shape, np.nan)
            out["c"].append(c)
            if filled:
                out["place"].append(None)
                out["patch"].append(np.nan_to_num(share, nan=0.0).ravel())
            else:
                out["place"].append(np.flatnonzero(inside.ravel()).astype("int32"))
                out["patch"].append(np.ma.masked_invalid(share[inside]).tolist())
        n = len(out["c"])
        return pa.table({
            "fov": pa.array([key[0].as_py()] * n, strip.schema.field("fov").type), "r": pa.array([r] * n, pa.int32()),
            "c": pa.array(out["c"], pa.int32()), "place": pa.array(out["place"], pa.list_(pa.int32())), "patch": pa.array(out["patch"], shares),
        })

    made = strips.groupBy("fov", "r").applyInArrow(cut, f"fov {kind}, r int, c int, place array<int>, patch array<double>")
    return made.withColumnRenamed("fov", fov)


def sliding_patches(
    pixels: DataFrame, fov: str = "fov", value: str = "v", size: int = 96, stride: int = 8,
    out: str = "share",
) -> DataFrame:
    """Pixels of every size x size patch centred on a stride grid, divided by the patch maximum.

    Positions outside the image are zero and have no row; ``py``, ``px`` are positions inside the patch. Rows
    of the image travel, not pixels; a pixel is copied to its patches only where they are cut out.
    """
    flat = F.explode(F.arrays_zip(F.col("place"), F.col("patch").alias("share"))).alias("p")
    return _patches(pixels, fov, value, size, stride, False).select(quoted(fov), "r", "c", flat).select(
        quoted(fov), "r", "c", F.floor(F.col("p.place") / size).cast("int").alias("py"), (F.col("p.place") % size).alias("px"),
        F.col("p")["share"].alias(out),
    )


def patch_arrays(
    pixels: DataFrame, fov: str = "fov", value: str = "v", size: int = 96, stride: int = 8
) -> DataFrame:
    """One zero-padded row-major array per patch (size x size shares of the patch maximum)."""
    return _patches(pixels, fov, value, size, stride, True).drop("place")


def labelled_patches(
    pixels: DataFrame, points: DataFrame, fov: str = "fov", value: str = "v", size: int = 96
) -> DataFrame:
    """Patches around annotated points instead of a grid; ``points`` has (fov, r, c, class)."""
    half = size // 2
    wanted = points.select(
        quoted(fov), "r", "c", "class", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("py")
    )
    wanted = wanted.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("px"))
    wanted = wanted.withColumns(
        {"y": F.col("r") - half + F.col("py"), "x": F.col("c") - half + F.col("px")}
    )
    joined = merge(
        wanted, pixels.select(quoted(fov), "y", "x", quoted(value)), [fov, "y", "x"], "inner", False
    )
    patch = Window.partitionBy(quoted(fov), "r", "c", "class")
    return joined.withColumn("share", ratio(quoted(value), F.max(quoted(value)).over(patch))).select(
        quoted(fov), "r", "c", "class", "py", "px", "share"
    )


def softmax(columns: Sequence[str]) -> dict[str, Column]:
    """Exponentials shifted by the row maximum, divided by their sum."""
    top = F.greatest(*[quoted(c) for c in columns])
    powers = {c: F.exp(quoted(c) - top) for c in columns}
    total = sum(list(powers.values())[1:], list(powers.values())[0])
    return {c: p / total for c, p in powers.items()}


def ensemble_softmax(
    predictions: DataFrame, keys: Sequence[str], scores: Sequence[str]
) -> DataFrame:
    """Mean of the score variants per position, turned into probabilities."""
    means = predictions.groupBy(*[quoted(k) for k in keys]).agg(
        *[F.avg(quoted(s)).alias(s) for s in scores]
    )
    return means.select(*[quoted(k) for k in keys], *[e.alias(c) for c, e in softmax(scores).items()])


# fixed values: class order of the model to class order of the map
CLASS_ORDER = {1: 5, 2: 1, 3: 4, 4: 2, 5: 3}


def masked_class_map(
    pixels: DataFrame,
    scores: Sequence[str] = ("p1", "p2", "p3", "p4", "p5"),
    background: str = "background",
    order: Mapping[int, int] = CLASS_ORDER,
) -> DataFrame:
    """Reorder the class probabilities, pick the class, zero both on background."""
    prefix = scores[0][:-1]
    moved = {f"{prefix}{new}": quoted(f"{prefix}{old}") for old, new in order.items()}
    bg = quoted(background) > 0
    picked = pixels.withColumns(moved).withColumn("cls", class_map(scores, bg))
    return picked.withColumns({s: F.when(bg, F.lit(0.0)).otherwise(quoted(s)) for s in scores})
