"""From the five image-analysis tables to one annotated row per cell."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.paths import under_root
from cytoframe.operators.columns import (
    add_prefix,
    drop_existing,
    existing,
    keep_existing,
    order_columns,
    rename_existing,
)
from cytoframe.operators.joins import membership, merge, outer_flag
from cytoframe.operators.quality import failed_images, without_key

# fixed values: bookkeeping columns without meaning after the merge
BOOKKEEPING = [
    "finalnuc_Children_FinalNucBorder_Count",
    "finalnuc_Number_Object_Number",
    "finalnuc_Mean_seg_probe_488_Number_Object_Number",
    "finalnuc_Mean_seg_probe_561_Number_Object_Number",
    "finalnuc_Mean_seg_probe_638_Number_Object_Number",
    "napariCell_Mean_seg_probe_488_Number_Object_Number",
    "napariCell_Mean_seg_probe_561_Number_Object_Number",
    "napariCell_Mean_seg_probe_638_Number_Object_Number",
    "napariCell_Number_Object_Number",
]
# fixed values: object count columns of the image table
COUNT_COLUMNS = [
    "ImageNumber", "ImagePath", "Count_FilterNuc", "Count_FilterNucBorder", "Count_FinalNuc",
    "Count_FinalNucBorder", "Count_NucBubble", "Count_napari_cell", "Count_nuc",
    "Count_seg_probe_488", "Count_seg_probe_561", "Count_seg_probe_638",
]
# fixed values: sample metadata columns, in output order
SAMPLE_COLUMNS = [
    "rescaled_2D_single_cell_tiff_path", "fov_path", "well_position", "microscope",
    "image_date", "probe488", "probe546", "probe647", "plate_name", "cell_line", "cell_age",
]
# fixed values: names in the score files to names in the feature table
SCORE_NAMES = {
    "cell_num": "napariCell_ObjectNumber",
    "cell_label_value": "napariCell_ObjectNumber",
    "mh score": "mh_structure_org_score",
    "kg score": "kg_structure_org_score",
    "score": "no_structure",
    "fov_id": "FOVId",
}


def with_image_path(images: DataFrame) -> DataFrame:
    return images.withColumn(
        "ImagePath",
        F.concat("ObjectsPathName_napari_cell", F.lit("/"), "ObjectsFileName_napari_cell"),
    )


def merge_cells(
    tables: Mapping[str, DataFrame], failed: DataFrame | None = None
) -> DataFrame:
    """One row per cell with its nuclei, border flag and image.

    Outer joins keep unmatched rows of every table, and missing keys match missing keys.
    """
    key = ["ImageNumber"]
    nuclei = add_prefix(tables["merged_nuclei"], "finalnuc_", key)
    cells = add_prefix(tables["napari_cell"], "napariCell_", key)
    centres = tables["premerge_nuclei_centroids"].select(
        "ImageNumber",
        F.col("ObjectNumber").alias("nuccentroid_ObjectNumber"),
        F.col("Parent_FilterNuc").alias("finalnuc_Parent_FilterNuc"),
        F.col("Parent_napari_cell").alias("napariCell_ObjectNumber"),
    )
    border = tables["flag_border_nuclei"].select(
        "ImageNumber", F.col("Parent_FinalNuc").alias("finalnuc_ObjectNumber")
    )
    linked = merge(nuclei, centres, ["ImageNumber", "finalnuc_Parent_FilterNuc"])
    linked = merge(linked, cells, ["ImageNumber", "napariCell_ObjectNumber"], "outer")
    flagged = outer_flag(
        linked, border, ["ImageNumber", "finalnuc_ObjectNumber"], "finalnuc_border", matched=False
    )
    images = with_image_path(tables["image"]).select("ImageNumber", "ImagePath")
    merged = merge(images, flagged, key, "outer", many="right")
    merged = rename_existing(
        merged, {"napariCell_Children_NucCentroid_Count": "napariCell_nuclei_Count"}
    )
    merged = membership(drop_existing(merged, BOOKKEEPING), "ImageNumber", failed, "ImageFailed")
    return order_columns(
        merged,
        ["ImageNumber", "ImagePath", "ImageFailed", "napariCell_ObjectNumber"],
        ["napariCell_nuclei_Count", "finalnuc_border", "finalnuc_ObjectNumber",
         "finalnuc_Parent_FilterNuc", "nuccentroid_ObjectNumber"],
    )


def add_samples(
    cells: DataFrame,
    manifest: DataFrame,
    samples: DataFrame,
    image_key: str = "rescaled_2D_fov_tiff_path",
    single_cells: bool = True,
    root: str | None = None,
) -> DataFrame:
    """Add the image manifest (per cell or per image) and the sample metadata."""
    names = {"fov_id": "FOVId", "original_fov_location": "fov_path", image_key: "ImagePath"}
    on, first = ["ImagePath"], ["ImageNumber", "FOVId", "ImagePath", "ImageFailed"]
    if single_cells:
        names["cell_label_value"] = "napariCell_ObjectNumber"
        on, first = [*on, "napariCell_ObjectNumber"], [*first, "napariCell_ObjectNumber"]
    manifest = rename_existing(manifest, names)
    if root:
        manifest = manifest.withColumn("ImagePath", under_root("ImagePath", root))
    merged = merge(cells, manifest, on, "outer")
    merged = merge(merged, samples, ["fov_path", "FOVId"], "outer", many="left")
    return order_columns(drop_existing(merged, ["ge_wellID", "notes"]), first, SAMPLE_COLUMNS)


def add_structure_scores(cells: DataFrame, scores: DataFrame) -> DataFrame:
    paths = [
        "rescaled_2D_fov_tiff_path", "original_fov_location",
        "rescaled_2D_single_cell_tiff_path", "single_cell_id",
    ]
    scores = rename_existing(drop_existing(scores, paths), SCORE_NAMES)
    merged = merge(cells, scores, ["FOVId", "napariCell_ObjectNumber"], "outer")
    return drop_existing(merged, ["file_name", "file_base"])


def add_localisation_scores(cells: DataFrame, scores: DataFrame) -> DataFrame:
    scores = rename_existing(scores, {"cell_num": "napariCell_ObjectNumber"})
    merged = merge(cells, scores, ["FOVId", "napariCell_ObjectNumber"], "outer")
    return drop_existing(merged, ["file_name", "file_base"])


def add_border_flag(cells: DataFrame, border: DataFrame) -> DataFrame:
    flagged = outer_flag(
        cells, border, ["FOVId", "ImagePath", "fov_path", "napariCell_ObjectNumber"], "cell_border"
    )
    position = flagged.columns.index("cell_age") + 1 if "cell_age" in flagged.columns else 18
    return order_columns(flagged, [c for c in flagged.columns[:position] if c != "cell_border"],
                         ["cell_border"])


def feature_table(
    tables: Mapping[str, DataFrame],
    manifest: DataFrame,
    samples: DataFrame,
    structure_scores: DataFrame | None = None,
    localisation_scores: DataFrame | None = None,
    border_cells: DataFrame | None = None,
    null_is_failure: bool = False,
    **metadata,
) -> DataFrame:
    """The whole merge as one plan; rows of images that were never analysed are dropped."""
    failed = failed_images(tables["image"], null_is_failure=null_is_failure)
    cells = add_samples(merge_cells(tables, failed), manifest, samples, **metadata)
    if structure_scores is not None:
        cells = add_structure_scores(cells, structure_scores)
    if localisation_scores is not None:
        cells = add_localisation_scores(cells, localisation_scores)
    if border_cells is not None:
        cells = add_border_flag(cells, border_cells)
    return without_key(cells)


def object_counts(images: DataFrame, cells: DataFrame) -> DataFrame:
    """Object counts per image with the distinct sample metadata of its cells.

    Pass the cell table before or after ``without_key`` as wanted.
    """
    counts = keep_existing(with_image_path(images), COUNT_COLUMNS)
    first = [
        "ImageNumber", "ImagePath", "FOVId", "fov_path", "probe488", "probe546", "probe647",
        "plate_name", "cell_line", "cell_age",
    ]
    metadata = keep_existing(cells, existing(cells, first)).distinct()
    return order_columns(merge(counts, metadata, ["ImageNumber", "ImagePath"], "outer"), first)
