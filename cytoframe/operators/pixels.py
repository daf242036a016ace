"""The pixel table (fov, y, x, values) and per-image intensity operators.

A group here is one image (or one channel of one image), whose size is fixed by the
camera, so exact ``percentile`` inside the group aggregate is bounded.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.scalars import clamp
from cytoframe.operators.columns import quoted
from cytoframe.operators.joins import merge


def from_arrays(
    images: DataFrame, width: int, array: str = "values", keys: Sequence[str] = ("fov",),
    out: str = "v",
) -> DataFrame:
    """One row-major array per image (or channel) to one row per pixel."""
    return images.select(
        *[quoted(k) for k in keys], F.posexplode(quoted(array)).alias("__pos__", out)
    ).select(
        *[quoted(k) for k in keys],
        F.expr(f"cast(__pos__ div {int(width)} as int)").alias("y"),
        (F.col("__pos__") % F.lit(int(width))).alias("x"),
        quoted(out),
    )


def channel_planes(
    images: DataFrame, channels: Mapping[str, int], width: int, planes: str = "planes",
    fov: str = "fov",
) -> DataFrame:
    """Array of channel planes to long pixels (fov, channel, y, x, v).

    An image whose number of planes differs from the channel map is an error.
    """
    n = len(channels)
    count = F.size(quoted(planes))
    checked = F.when(count == n, quoted(planes)).otherwise(
        F.raise_error(F.format_string("image has %d planes, expected " + str(n), count))
    )
    names = F.array(*[F.lit(c) for c, _ in sorted(channels.items(), key=lambda kv: kv[1])])
    long = images.select(quoted(fov), F.posexplode(checked).alias("__c__", "__plane__")).select(
        quoted(fov), F.get(names, F.col("__c__")).alias("channel"), "__plane__"
    )
    return from_arrays(long, width, "__plane__", (fov, "channel"))


def max_projection(stack: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    return stack.groupBy(*[quoted(k) for k in keys]).agg(F.max(quoted(value)).alias(value))


def brightest_slices(
    stack: DataFrame, fov: str = "fov", z: str = "z", value: str = "v", around: int = 3
) -> DataFrame:
    """Slices within ``around`` of the one with the highest mean (the first on ties)."""
    means = stack.groupBy(quoted(fov), quoted(z)).agg(F.avg(quoted(value)).alias("__m__"))
    best = means.groupBy(quoted(fov)).agg(
        F.max_by(quoted(z), F.struct(F.col("__m__"), -quoted(z))).alias("z_best")
    )
    return merge(stack, best, [fov], "inner", False).where(
        F.abs(quoted(z) - F.col("z_best")) <= around
    )


# ---------------------------------------------------------------- contrast

# fixed values: contrast settings per channel group
CHANNEL_GROUPS = {
    "fluor": ["488", "561", "638", "nuc"],
    "bf": ["bf"],
    "seg": ["seg488", "seg561", "seg638", "backmask", "cell"],
}
CONTRAST_SETTINGS = {
    "fluor": {"clip_quantiles": (0.0, 0.998), "zero_below_median": False},
    "bf": {"clip_quantiles": (0.00001, 0.99999), "zero_below_median": False},
    "seg": {},
}


def _by_group(group: Column, settings: Mapping[str, Column]) -> Column:
    expr = None
    for name, value in settings.items():
        hit = group == F.lit(name)
        expr = F.when(hit, value) if expr is None else expr.when(hit, value)
    return expr


def quantile_contrast(
    pixels: DataFrame,
    keys: Sequence[str],
    value: str = "v",
    out: str = "stretched",
    group: str | None = None,
    settings: Mapping[str, Mapping] = CONTRAST_SETTINGS,
    clip_quantiles: tuple[float, float] = (0.0, 0.999),
    zero_below_median: bool = False,
    full_scale: float = 65535.0,
) -> DataFrame:
    """Clip to two quantiles of the image, optionally zero below the median, stretch to 0..255.

    With ``group`` the quantiles follow the channel group of each image; a group with empty
    settings (segmentations) is passed through. All quantiles come from one aggregate.
    Values are non-negative counts; the quantiles lie on both sides of the median.
    """
    per_group = {"": {"clip_quantiles": clip_quantiles, "zero_below_median": zero_below_median}}
    if group is not None:
        per_group = {g: s for g, s in settings.items() if s}
    shares = sorted({q for s in per_group.values() for q in s["clip_quantiles"]} | {0.5})
    stats = pixels.groupBy(*[quoted(k) for k in keys]).agg(
        F.percentile(quoted(value), shares).alias("__q__")
    )
    at = {q: F.get("__q__", F.lit(i)) for i, q in enumerate(shares)}
    lows = {g: at[s["clip_quantiles"][0]] for g, s in per_group.items()}
    highs = {g: at[s["clip_quantiles"][1]] for g, s in per_group.items()}
    zeroed = {g: F.lit(bool(s.get("zero_below_median"))) for g, s in per_group.items()}
    g = F.lit("") if group is None else quoted(group)
    low, high, zero = _by_group(g, lows), _by_group(g, highs), _by_group(g, zeroed)
    joined = merge(pixels, stats, keys, "inner", False)
    middle = clamp(at[0.5], low, high)
    clipped = clamp(quoted(value).cast("double"), low, high)
    clipped = F.when(zero & (clipped < middle), F.lit(0.0)).otherwise(clipped)
    bottom = F.when(zero & (low < middle), F.lit(0.0)).otherwise(low)
    flat = clamp(clipped / F.lit(full_scale), 0.0, 1.0)
    share = F.when(high > bottom, (clipped - bottom) / (high - bottom)).otherwise(flat)
    stretched = F.rint(share * 255).cast("int")
    if group is not None:
        stretched = F.when(quoted(group).isin(list(per_group)), stretched).otherwise(
            quoted(value).cast("int")
        )
    return joined.withColumn(out, stretched).drop("__q__")


def to_bytes(
    pixels: DataFrame, keys: Sequence[str], value: str = "v", out: str = "byte"
) -> DataFrame:
    """Stretch each image to the full 16-bit range and keep the high byte."""
    limits = pixels.groupBy(*[quoted(k) for k in keys]).agg(
        F.min(quoted(value)).alias("__lo__"), F.max(quoted(value)).alias("__hi__")
    )
    joined = merge(pixels, limits, keys, "inner", False)
    span = F.col("__hi__") - F.col("__lo__")
    wide = F.when(
        span > 0, F.floor((quoted(value) - F.col("__lo__")) / span * F.lit(65535.0))
    ).otherwise(clamp(quoted(value).cast("double"), 0.0, 65535.0))
    return joined.withColumn(out, F.floor(wide / 256).cast("int")).drop("__lo__", "__hi__")


def histogram_contrast(
    pixels: DataFrame,
    keys: Sequence[str],
    byte: str = "byte",
    out: str = "stretched",
    upper_limit: float = 1 / 10,
    low_threshold: float = 1 / 5000,
    zero_full_bins: bool = True,
) -> DataFrame:
    """Stretch by the 256-bin histogram of each image.

    The low end is the first bin under the upper limit, the high end the last bin over the
    low threshold (limits are shares of the non-zero pixels); bins at or over the upper
    limit are set to 0.
    """
    by = [quoted(k) for k in keys]
    counted = pixels.groupBy(*by, quoted(byte).alias("__bin__")).agg(F.count("*").alias("__n__"))
    arrays = counted.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("__bin__", "__n__"))).alias("__h__"),
        F.sum(F.when(F.col("__bin__") > 0, F.col("__n__")).otherwise(0)).alias("__nonzero__"),
        F.max("__bin__").alias("__last__"),
    )
    bins = F.sequence(F.lit(0), F.col("__last__"))
    held = lambda b: F.coalesce(F.try_element_at(F.col("__h__"), b), F.lit(0))
    limit = F.col("__nonzero__") * F.lit(upper_limit)
    floor = F.col("__nonzero__") * F.lit(low_threshold)
    limits = arrays.select(
        *by,
        F.coalesce(F.array_min(F.filter(bins, lambda b: held(b) < limit)), F.lit(0)).alias("__lo__"),
        F.coalesce(
            F.array_max(F.filter(bins, lambda b: held(b) > floor)), F.col("__last__")
        ).alias("__hi__"),
        F.filter(bins, lambda b: held(b) >= limit).alias("__full__"),
    )
    joined = merge(pixels, limits, keys, "inner", False)
    kept = quoted(byte)
    if zero_full_bins:
        kept = F.when(F.array_contains("__full__", kept), F.lit(0)).otherwise(kept)
    lo, hi = F.col("__lo__"), F.col("__hi__")
    stretched = F.when(hi > lo, F.floor((clamp(kept, lo, hi) - lo) / (hi - lo) * 255)).otherwise(kept)
    return joined.withColumn(out, stretched.cast("int")).drop("__lo__", "__hi__", "__full__")


CONTRAST_METHODS = {
    "simple_quantile": quantile_contrast,
    "histogram": lambda px, keys, value="v", out="stretched", **kw: histogram_contrast(
        to_bytes(px, keys, value, "__byte__"), keys, "__byte__", out, **kw
    ).drop("__byte__"),
}


def contrast(pixels: DataFrame, keys: Sequence[str], method: str, **settings) -> DataFrame:
    """Contrast by method name; more methods are added to ``CONTRAST_METHODS``."""
    return CONTRAST_METHODS[method](pixels, keys, **settings)


def rescale_limits(value, low: float, high: float) -> Column:
    """Linear map of fixed limits to 0..1, clipped."""
    v = quoted(value) if isinstance(value, str) else value
    return clamp((v.cast("double") - F.lit(float(low))) / F.lit(float(high - low)), 0.0, 1.0)


def normalise_intensity(
    pixels: DataFrame,
    keys: Sequence[str],
    value: str = "v",
    out: str = "norm",
    low_sigmas: float = 1.0,
    high_sigmas: float = 18.0,
    eps: float = 1e-8,
) -> DataFrame:
    """Clip to mean - a sd .. mean + b sd of the image, then stretch to 0..1."""
    v = quoted(value).cast("double")
    stats = pixels.groupBy(*[quoted(k) for k in keys]).agg(
        F.avg(v).alias("__m__"),
        F.stddev_pop(v).alias("__s__"),
        F.min(v).alias("__lo__"),
        F.max(v).alias("__hi__"),
    )
    joined = merge(pixels, stats, keys, "inner", False)
    low = F.col("__m__") - F.col("__s__") * low_sigmas
    high = F.col("__m__") + F.col("__s__") * high_sigmas
    bottom, top = clamp("__lo__", low, high), clamp("__hi__", low, high)
    stretched = (clamp(v, low, high) - bottom + eps) / (top - bottom + eps)
    return joined.withColumn(out, stretched).drop("__m__", "__s__", "__lo__", "__hi__")


# ---------------------------------------------------------------- tiles and neighbours

def tile_sums(
    pixels: DataFrame, fov: str, value: str, size: int, out: str = "tile_sum"
) -> DataFrame:
    """Sum per size x size tile, given back to each of its pixels."""
    ty, tx = F.expr(f"y div {int(size)}"), F.expr(f"x div {int(size)}")
    tiled = pixels.withColumns({"__ty__": ty, "__tx__": tx})
    sums = tiled.groupBy(quoted(fov), "__ty__", "__tx__").agg(F.sum(quoted(value)).alias(out))
    return merge(tiled, sums, [fov, "__ty__", "__tx__"], "inner", False).drop("__ty__", "__tx__")


EIGHT_NEIGHBOURS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def junction_counts(
    pixels: DataFrame, fov: str, value: str, out: str = "junctions", margin: int = 2
) -> DataFrame:
    """Own value plus the values of the eight neighbours, inside a margin; outside it, own.

    Every non-zero pixel sends its value to its neighbours, so zeros cost nothing.
    """
    steps = F.array(
        *[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in EIGHT_NEIGHBOURS]
    )
    size = pixels.groupBy(quoted(fov)).agg(F.max("y").alias("__h__"), F.max("x").alias("__w__"))
    sent = (
        pixels.where(quoted(value) != 0)
        .select(quoted(fov), "y", "x", quoted(value).alias("__v__"), F.explode(steps).alias("s"))
        .select(
            quoted(fov), (F.col("y") + F.col("s.dy")).alias("y"),
            (F.col("x") + F.col("s.dx")).alias("x"), "__v__",
        )
        .groupBy(quoted(fov), "y", "x")
        .agg(F.sum("__v__").alias("__near__"))
    )
    joined = merge(merge(pixels, sent, [fov, "y", "x"], "left", False), size, [fov], "inner", False)
    inside = (
        (F.col("y") >= margin)
        & (F.col("x") >= margin)
        & (F.col("y") <= F.col("__h__") - margin)
        & (F.col("x") <= F.col("__w__") - margin)
    )
    near = F.when(inside, F.coalesce("__near__", F.lit(0))).otherwise(F.lit(0))
    return joined.withColumn(out, quoted(value) + near).drop("__near__", "__h__", "__w__")


def line_pixels(pixels: DataFrame, fov: str, value: str, out: str = "line") -> DataFrame:
    """Skeleton without its junctions (more than three pixels in a neighbourhood)."""
    counted = junction_counts(pixels, fov, value, "__j__")
    return counted.withColumn(
        out, F.when(F.col("__j__") > 3, F.lit(0)).otherwise(quoted(value))
    ).drop("__j__")


def rectangle(boxes: DataFrame, margin: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """All pixel positions of each box (y0..y1, x0..x1 inclusive): its area in rows."""
    ys = F.explode(F.sequence(F.col("y0") - margin, F.col("y1") + margin)).alias("y")
    rows = boxes.select(*[quoted(k) for k in keep], "x0", "x1", ys)
    xs = F.explode(F.sequence(F.col("x0") - margin, F.col("x1") + margin)).alias("x")
    return rows.select(*[quoted(k) for k in keep], "y", xs)
