"""Score and plate manifests joined by names taken from file paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.names import word, words
from cytoframe.functions.paths import base_name, before, image_set
from cytoframe.operators.columns import drop_existing, keep_existing, rename_existing
from cytoframe.operators.joins import merge
from cytoframe.operators.ranks import sequential_index


def scores_with_field(scores: DataFrame, manifest: DataFrame) -> DataFrame:
    """Give each manual score the id of its image, found by the file's base name and cell."""
    scores = scores.withColumn("file_base", before("file_name", "."))
    manifest = rename_existing(manifest, {"cell_label_value": "cell_num"}).withColumn(
        "file_base", words(base_name("rescaled_2D_fov_tiff_path"), 2, 8)
    )
    merged = merge(manifest, scores, ["cell_num", "file_base"], "outer")
    return keep_existing(
        rename_existing(merged, {"fov_id": "FOVId"}),
        ["FOVId", "cell_num", "file_name", "file_base", "mh score", "kg score",
         "probe_561_loc_score", "probe_638_loc_score"],
    )


def holdout_scores(
    scores: DataFrame, manifest: DataFrame, zero_scores: DataFrame | None = None
) -> DataFrame:
    """Manual scores of fixed cells joined to the classifier manifest, zero scores added."""
    fish = scores.where(F.col("type") == "fish")
    fish = rename_existing(fish, {"plate": "plate_name"})
    joined = merge(manifest, fish, ["CellPath"], "inner")
    joined = rename_existing(
        joined,
        {"fov_id": "FOVId", "cell_label_value": "napariCell_ObjectNumber",
         "original_fov_location": "fov_path", "MH_score": "mh score", "KG_score": "kg score",
         "path": "classifier_image_path", "cell_id": "classifier_cell_id"},
    )
    joined = drop_existing(
        joined,
        ["fov_path", "plate_name", "RawFilePath", "classified_fov", "CellPath", "type",
         "image_name", "cell_id_filename"],
    )
    if zero_scores is None:
        return joined
    zeros = rename_existing(
        zero_scores,
        {"fov_id": "FOVId", "cell_label_value": "napariCell_ObjectNumber",
         "score": "no_structure"},
    )
    return merge(zeros, joined, ["FOVId", "napariCell_ObjectNumber"], "outer")


def live_manifest(manifest: DataFrame, scores: DataFrame, plates: DataFrame) -> DataFrame:
    """Live cells with plate, well and date from the file name, their scores and plate data."""
    name = base_name("RawFilePath")
    cells = rename_existing(manifest, {"CellId": "cell_id"}).withColumns(
        {
            "plate": word(name, 0, "_").try_cast("long"),
            "well_position": word(name, 6, " "),
            "image_date": word(name, 2, "_"),
        }
    )
    live = scores.where(F.col("type") == "live")
    merged = merge(cells, live, ["cell_id", "RawFilePath", "plate"], "outer").drop("type")
    live_plates = plates.where(F.col("type") == "live").drop("wells", "type")
    merged = merge(merged, live_plates, ["plate"], "outer")
    return rename_existing(
        merged,
        {"plate": "plate_name", "age": "Cell age", "RawFilePath": "FOV",
         "replate": "replate_date"},
    )


def image_sets(
    manifest: DataFrame, path: str, position: str, root: str, kind: str, constants: dict,
    present: DataFrame | None = None,
) -> DataFrame:
    """Image-set records for the distinct paths of a manifest, numbered by first position."""
    firsts = manifest.groupBy(path).agg(F.min(position).alias("__first__"))
    numbered = sequential_index(firsts, "__first__", "__number__")
    return image_set(numbered, path, "__number__", root, kind, constants, present)
