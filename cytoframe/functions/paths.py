"""Path columns and the image-set record built from one path."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.operators.columns import quoted
from cytoframe.operators.joins import semi


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(f"`{x}`")


def under_root(x, root: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), _c(x))


def base_name(x) -> Column:
    return F.substring_index(_c(x), "/", -1)


def dir_name(x) -> Column:
    return F.regexp_replace(_c(x), "/[^/]*$", "")


def component(x, number: int) -> Column:
    """The 0-based path component, null when the path is shorter."""
    return F.try_element_at(F.split(_c(x), "/"), F.lit(number + 1))


def posix(x) -> Column:
    return F.regexp_replace(F.replace(_c(x), F.lit("\\"), F.lit("/")), "/+", "/")


def before(x, mark: str) -> Column:
    """Everything before the first ``mark`` (the whole text when it is absent)."""
    return F.substring_index(_c(x), mark, 1)


def replace_prefix(x, old: str, new: str) -> Column:
    return F.replace(_c(x), F.lit(old), F.lit(new))


# fixed values: image channels of the two kinds of image sets
IMAGE_SET_CHANNELS = {
    "structure": [
        "bf", "fore_back", "nuc", "probe_561", "probe_638", "seg_561", "seg_638", "structure",
    ],
    "nonstructure": [
        "bf", "fore_back", "nuc", "probe_488", "probe_561", "probe_638",
        "seg_488", "seg_561", "seg_638",
    ],
}


def image_set(
    images: DataFrame,
    path: str,
    index: str,
    root: str,
    kind: str = "structure",
    constants: Mapping[str, object] | None = None,
    present: DataFrame | None = None,
) -> DataFrame:
    """One record per image: its URL, directory and file name once per channel, and constants.

    ``present`` lists the paths that exist; images not in it are left out.
    """
    if kind not in IMAGE_SET_CHANNELS:
        raise ValueError("kind must be 'structure' or 'nonstructure'")
    if present is not None:
        images = semi(images, present, [path])
    full = under_root(path, root)
    made = {"Group_Index": quoted(index)}
    for prefix, expr in (
        ("URL", F.concat(F.lit("file:"), full)),
        ("PathName", dir_name(full)),
        ("FileName", base_name(full)),
    ):
        for channel in IMAGE_SET_CHANNELS[kind]:
            made[f"{prefix}_{channel}"] = expr
    made["ObjectsURL_napari_cell"] = F.concat(F.lit("file:"), full)
    made["ObjectsPathName_napari_cell"] = dir_name(full)
    made["ObjectsFileName_napari_cell"] = base_name(full)
    made["Metadata_FileLocation"] = F.concat(F.lit("file:"), full)
    for name, value in (constants or {}).items():
        made.setdefault(name, F.lit(value))
    return images.select([e.alias(n) for n, e in made.items()])


def select_by_component(
    df: DataFrame, path: str, number: int, values: Sequence[str]
) -> DataFrame:
    return df.where(component(path, number).isin(list(values)))
