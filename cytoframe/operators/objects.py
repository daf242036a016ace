"""Objects of a label image: shape, borders, crops, relations, class and probe pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.functions.scalars import first_max, ratio
from cytoframe.operators.columns import quoted
from cytoframe.operators.joins import merge
from cytoframe.operators.pixels import rectangle


def bounding_boxes(pixels: DataFrame, fov: str = "fov", label: str = "label") -> DataFrame:
    """Inclusive box per object; label 0 is background."""
    return (
        pixels.where(quoted(label) > 0)
        .groupBy(quoted(fov), quoted(label))
        .agg(
            F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.min("x").alias("x0"), F.max("x").alias("x1"),
        )
    )


def shape_features(pixels: DataFrame, fov: str = "fov", label: str = "label") -> DataFrame:
    """Area, centroid, box, axis lengths and aspect ratio from one aggregate.

    Axis lengths are those of the ellipse with the same second moments; a pixel adds 1/12.
    """
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    moments = (
        pixels.where(quoted(label) > 0)
        .groupBy(quoted(fov), quoted(label))
        .agg(
            F.count("*").alias("area"),
            F.avg(y).alias("centroid_y"), F.avg(x).alias("centroid_x"),
            F.min("y").alias("y0"), F.max("y").alias("y1"),
            F.min("x").alias("x0"), F.max("x").alias("x1"),
            F.var_pop(y).alias("__yy__"), F.var_pop(x).alias("__xx__"),
            F.covar_pop(y, x).alias("__xy__"),
        )
    )
    a, b = F.col("__yy__") + F.lit(1 / 12), F.col("__xx__") + F.lit(1 / 12)
    root = F.sqrt((a - b) * (a - b) / 4 + F.col("__xy__") * F.col("__xy__"))
    major = 4 * F.sqrt((a + b) / 2 + root)
    minor = 4 * F.sqrt(F.greatest((a + b) / 2 - root, F.lit(0.0)))
    return moments.withColumns(
        {"major_axis": major, "minor_axis": minor}
    ).withColumn("aspect_ratio", ratio("minor_axis", "major_axis")).drop(
        "__yy__", "__xx__", "__xy__"
    )


def border_labels(
    pixels: DataFrame, fov: str = "fov", label: str = "label", buffer: int = 1
) -> DataFrame:
    """Labels with a pixel in the first row or column or in the last ``1 + buffer`` ones.

    One pass over the pixels gives the extent of every label; the image size is the
    extent over its labels, background included.
    """
    extents = pixels.groupBy(quoted(fov), quoted(label)).agg(
        F.min("y").alias("y0"), F.max("y").alias("y1"),
        F.min("x").alias("x0"), F.max("x").alias("x1"),
    )
    size = Window.partitionBy(quoted(fov))
    h, w = F.max("y1").over(size), F.max("x1").over(size)
    touching = (
        (F.col("y0") == 0) | (F.col("x0") == 0)
        | (F.col("y1") >= h - buffer) | (F.col("x1") >= w - buffer)
    )
    return (
        extents.withColumn("__t__", touching)
        .where(F.col("__t__") & (quoted(label) != 0))
        .select(quoted(fov), quoted(label))
    )


def crop_cells(
    pixels: DataFrame,
    channels: Sequence[str],
    fov: str = "fov",
    label: str = "label",
) -> DataFrame:
    """Each cell cut out at its box, other pixels 0, every channel stretched to 0..255.

    Output rows are the box pixels in box coordinates.
    """
    boxes = bounding_boxes(pixels, fov, label)
    frame = rectangle(boxes, 0, [fov, label])
    own = pixels.where(quoted(label) > 0).select(
        quoted(fov), quoted(label), "y", "x", *[quoted(c) for c in channels]
    )
    filled = merge(frame, own, [fov, label, "y", "x"], "left", False).fillna(0, list(channels))
    crop = Window.partitionBy(quoted(fov), quoted(label))
    y0, x0 = F.min("y").over(crop), F.min("x").over(crop)
    made = {"crop_y": (F.col("y") - y0), "crop_x": (F.col("x") - x0)}
    for c in channels:
        low, high = F.min(quoted(c)).over(crop), F.max(quoted(c)).over(crop)
        flat = F.least(F.greatest(quoted(c).cast("double"), F.lit(0.0)), F.lit(1.0))
        share = F.when(high > low, (quoted(c) - low) / (high - low)).otherwise(flat)
        made[c] = F.rint(share * 255).cast("int")
    return filled.withColumns(made).select(
        quoted(fov), quoted(label), "crop_y", "crop_x", *[quoted(c) for c in channels]
    )


def missing_labels(pixels: DataFrame, fov: str = "fov", label: str = "label") -> DataFrame:
    """Images whose labels are not exactly 1..n."""
    return (
        pixels.where(quoted(label) > 0)
        .select(quoted(fov), quoted(label)).distinct()
        .groupBy(quoted(fov))
        .agg(F.count("*").alias("labels"), F.min(quoted(label)).alias("first"),
             F.max(quoted(label)).alias("last"))
        .where((F.col("first") != 1) | (F.col("last") != F.col("labels")))
    )


def filter_objects(
    shapes: DataFrame,
    min_area: int | None = None,
    max_area: int | None = None,
    border: DataFrame | None = None,
    on: Sequence[str] = ("fov", "label"),
) -> DataFrame:
    """Objects at least (or at most) some area, optionally without those on the border."""
    from cytoframe.operators.joins import anti

    if min_area is not None:
        shapes = shapes.where(F.col("area") >= min_area)
    if max_area is not None:
        shapes = shapes.where(F.col("area") <= max_area)
    return anti(shapes, border, list(on)) if border is not None else shapes


def counts_per_image(objects: DataFrame, name: str, fov: str = "fov") -> DataFrame:
    return objects.groupBy(quoted(fov)).agg(F.count("*").alias(name))


# ---------------------------------------------------------------- relations

def relate_by_overlap(
    pixels: DataFrame, child: str, parent: str, fov: str = "fov"
) -> DataFrame:
    """Parent of each child: the label it shares most pixels with, the lower one on ties."""
    shared = (
        pixels.where((quoted(child) > 0) & (quoted(parent) > 0))
        .groupBy(quoted(fov), quoted(child), quoted(parent))
        .agg(F.count("*").alias("__n__"))
    )
    return shared.groupBy(quoted(fov), quoted(child)).agg(
        F.max_by(quoted(parent), F.struct(F.col("__n__"), -quoted(parent))).alias(parent),
        F.max("__n__").alias("overlap"),
    )


def relate_by_centre(
    pixels: DataFrame, child: str, parent: str, fov: str = "fov"
) -> DataFrame:
    """Parent of each child: the label under its (truncated) centre; null when there is none."""
    centres = (
        pixels.where(quoted(child) > 0)
        .groupBy(quoted(fov), quoted(child))
        .agg(F.floor(F.avg("y")).cast("int").alias("y"), F.floor(F.avg("x")).cast("int").alias("x"))
    )
    under = pixels.where(quoted(parent) > 0).select(quoted(fov), "y", "x", quoted(parent))
    return merge(centres, under, [fov, "y", "x"], "left", False)


def children_per_parent(
    parents: DataFrame,
    children: DataFrame,
    on: Sequence[str],
    count: str,
    measures: Sequence[str] = (),
) -> DataFrame:
    """Number of children and mean of their measures for every parent."""
    per_parent = children.dropna("any", subset=list(on)).groupBy(*[quoted(k) for k in on]).agg(
        F.count("*").alias(count), *[F.avg(quoted(m)).alias(f"Mean_{m}") for m in measures]
    )
    return merge(parents, per_parent, on, "left", False).fillna(0, [count])


def merge_children(relations: DataFrame, parent: str, out: str, fov: str = "fov") -> DataFrame:
    """Give children of one parent a common new number, 1..k per image."""
    order = Window.partitionBy(quoted(fov)).orderBy(quoted(parent))
    return relations.where(quoted(parent).isNotNull()).withColumn(
        out, F.dense_rank().over(order)
    )


def relabel(objects: DataFrame, by: str, out: str, fov: str = "fov") -> DataFrame:
    """Number the objects of an image 1..k in the order of ``by``. Object rows, not pixels."""
    return objects.withColumn(
        out, F.dense_rank().over(Window.partitionBy(quoted(fov)).orderBy(quoted(by)))
    )


# ---------------------------------------------------------------- class maps

# fixed values: classes 0..5 of the class map
CLASS_NAMES = [
    "Background", "DiffuseOthers", "Fibers", "Disorganized_Puncta", "Organized_Puncta",
    "Organized_ZDisks",
]


def class_map(probabilities: Sequence[str], background: Column | None = None) -> Column:
    """Class number 1..n of the largest probability; 0 on background."""
    best = first_max(F.array(*[quoted(p) for p in probabilities])).cast("int")
    return best if background is None else F.when(background, F.lit(0)).otherwise(best)


def class_fractions(
    pixels: DataFrame,
    fov: str = "fov",
    label: str = "label",
    cls: str = "cls",
    raw: str = "v",
    probabilities: Sequence[str] = ("p1", "p2", "p3", "p4", "p5"),
) -> DataFrame:
    """Area share of each class, mean class probabilities and intensities per cell.

    The background level is the 10th percentile of the whole image.
    """
    v = quoted(raw).cast("double")
    level = pixels.groupBy(quoted(fov)).agg(F.percentile(v, 0.1).alias("Background_Value"))
    cells = (
        pixels.where(quoted(label) > 0)
        .groupBy(quoted(fov), quoted(label))
        .agg(
            F.count("*").alias("Total_Area"),
            *[
                F.avg((quoted(cls) == k).cast("double")).alias(f"Frac_Area_{n}")
                for k, n in enumerate(CLASS_NAMES)
            ],
            *[
                F.avg(quoted(p)).alias(f"Prob_{n}")
                for p, n in zip(probabilities, CLASS_NAMES[1:])
            ],
            F.percentile(v, 0.5).alias("Intensity_Median"),
            F.sum(v).alias("Intensity_Integrated"),
        )
    )
    b = F.col("Background_Value")
    return merge(cells, level, [fov], "inner", False).withColumns(
        {
            "Intensity_Median_BackSub": F.col("Intensity_Median") - b,
            "Intensity_Integrated_BackSub": F.col("Intensity_Integrated")
            - F.col("Total_Area") * b,
        }
    )


def probe_by_class(
    pixels: DataFrame,
    probes: Sequence[str],
    classes: Sequence[int],
    fov: str = "fov",
    label: str = "label",
    nucleus: str = "nucleus",
    cls: str = "cls",
) -> DataFrame:
    """Probe pixels and area per class in the cytoplasm, and totals, per cell.

    The nucleus is cut out of the class counts; cells that are all nucleus have no row.
    """
    in_nucleus = quoted(nucleus) != 0
    cyto = ~in_nucleus

    def n(condition: Column) -> Column:
        return F.count_if(F.coalesce(condition, F.lit(False)))

    aggregates = [n(F.lit(True)).alias("cell_px"), n(in_nucleus).alias("nuc_px")]
    for seg in probes:
        hit = quoted(seg) > 0
        aggregates.append(n(cyto & hit).alias(f"{seg}_total_probe_cyto"))
        for k in classes:
            here = cyto & (quoted(cls) == k)
            aggregates.append(n(here & hit).alias(f"{seg}_probe_px_class_{k}"))
            aggregates.append(n(here).alias(f"{seg}_area_px_class_{k}"))
        aggregates.append(n(in_nucleus & hit).alias(f"{seg}_probe_px_nuc"))
    out = (
        pixels.where(quoted(label) > 0).groupBy(quoted(fov), quoted(label)).agg(*aggregates)
    )
    return out.where(F.col("cell_px") > F.col("nuc_px"))
