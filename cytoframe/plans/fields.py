"""The image job: contrast every field, cut out its cells, list what was made."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.paths import base_name
from cytoframe.operators.joins import anti, merge
from cytoframe.operators.objects import crop_cells, missing_labels
from cytoframe.operators.pixels import CHANNEL_GROUPS, CONTRAST_SETTINGS, contrast


def with_group(pixels: DataFrame, groups: Mapping[str, list[str]] = CHANNEL_GROUPS) -> DataFrame:
    """Add the group of each channel."""
    expr = None
    for group, channels in groups.items():
        hit = F.col("channel").isin(channels)
        expr = F.when(hit, F.lit(group)) if expr is None else expr.when(hit, F.lit(group))
    return pixels.withColumn("channel_group", expr)


def contrasted_fields(
    pixels: DataFrame,
    method: str = "simple_quantile",
    groups: Mapping[str, list[str]] = CHANNEL_GROUPS,
    settings: Mapping[str, Mapping] = CONTRAST_SETTINGS,
) -> DataFrame:
    """Long pixels (fov, channel, y, x, v) with the stretched value of every channel.

    Segmentation channels pass through; the others follow the settings of their group.
    """
    grouped = with_group(pixels, groups)
    keys = ["fov", "channel"]
    if method == "simple_quantile":
        return contrast(grouped, keys, method, group="channel_group", settings=settings)
    flat = [g for g in settings if not settings[g]]
    passed = grouped.where(F.col("channel_group").isin(flat)).withColumn(
        "stretched", F.col("v").cast("int")
    )
    moved = contrast(grouped.where(~F.col("channel_group").isin(flat)), keys, method)
    return moved.unionByName(passed.select(moved.columns))


def wide_channels(pixels: DataFrame, channels: list[str], value: str = "stretched") -> DataFrame:
    """Long channels to one column each, from one aggregate."""
    return pixels.groupBy("fov", "y", "x").agg(
        *[F.max(F.when(F.col("channel") == c, F.col(value))).alias(c) for c in channels]
    )


def cell_manifest(
    fields: DataFrame, labels: DataFrame, out_dir: str, path: str = "2D_fov_tiff_path"
) -> DataFrame:
    """One row per cell: field, label and the names of the rescaled field and cell images.

    ``fields`` holds (fov, path), ``labels`` (fov, label) of the cells found.
    """
    stem = F.regexp_replace(base_name(path), r"\.[^.]*$", "")
    root = out_dir.rstrip("/")
    named = fields.select(
        "fov",
        F.col(f"`{path}`"),
        F.concat(F.lit(f"{root}/output_field_images/"), stem, F.lit("_rescaled.ome.tiff")).alias(
            "rescaled_2D_fov_tiff_path"
        ),
        stem.alias("__stem__"),
    )
    cells = labels.select("fov", F.col("label").alias("cell_label_value"))
    joined = merge(named, cells, ["fov"], "inner", False)
    return joined.withColumn(
        "rescaled_2D_single_cell_tiff_path",
        F.concat(
            F.lit(f"{root}/output_single_cell_images/"), F.col("__stem__"), F.lit("_rescaled_cell"),
            F.col("cell_label_value").cast("string"), F.lit(".ome.tiff"),
        ),
    ).drop("__stem__")


def process_fields(
    fields: DataFrame,
    pixels: DataFrame,
    out_dir: str,
    label_channel: str = "cell",
    channels: list[str] | None = None,
    method: str = "simple_quantile",
) -> dict[str, DataFrame]:
    """Stretched fields, cell crops, the cell manifest, and the fields that failed.

    A field fails when it has no pixels or its labels are not 1..n.
    """
    channels = channels or [c for group in CHANNEL_GROUPS.values() for c in group]
    stretched = contrasted_fields(pixels, method)
    wide = wide_channels(stretched, channels).withColumn("label", F.col(f"`{label_channel}`"))
    wrong = missing_labels(wide)
    good = anti(wide, wrong, ["fov"])
    cells = good.where(F.col("label") > 0).select("fov", "label").distinct()
    absent = anti(fields, pixels, ["fov"]).select("fov", F.lit("no pixels").alias("reason"))
    failed = absent.unionByName(
        wrong.select("fov", F.lit("labels are not 1..n").alias("reason"))
    )
    return {
        "fields": stretched,
        "crops": crop_cells(good, channels),
        "manifest": cell_manifest(fields, cells, out_dir),
        "failed": failed,
    }
