"""Feature names, file names, probe names and slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(f"`{x}`")


# fixed values: name parts that decide region, channel, kind and wavelength of a feature,
# the first that fits counts
REGION_PREFIXES = {"finalnuc_": "nuclear", "napariCell_": "cell"}
CHANNEL_PARTS = {
    "_structure_": "structure",
    "_bf_": "bright field",
    "_nuc_": "DNA",
    "_probe_": "FISH",
}
OTHER_CHANNEL = "segmentation"
TYPE_PARTS = {
    "_Center_": "location",
    "_Count": "count",
    "_Texture_": "texture",
    "_AreaShape_": "shape",
}
WAVELENGTH_PARTS = {"probe_638": "638", "probe_561": "561"}


def _first_fit(name: Column, parts: dict[str, str], test) -> Column:
    expr = None
    for part, label in parts.items():
        hit = test(name, F.lit(part))
        expr = F.when(hit, F.lit(label)) if expr is None else expr.when(hit, F.lit(label))
    return expr


def feature_region(name) -> Column:
    return _first_fit(_c(name), REGION_PREFIXES, F.startswith)


def feature_channel(name) -> Column:
    return F.coalesce(_first_fit(_c(name), CHANNEL_PARTS, F.contains), F.lit(OTHER_CHANNEL))


def feature_type(name) -> Column:
    return _first_fit(_c(name), TYPE_PARTS, F.contains)


def probe_wavelength(name) -> Column:
    return _first_fit(_c(name), WAVELENGTH_PARTS, F.contains)


def annotated(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumns(
        {
            "region": feature_region(name),
            "channel": feature_channel(name),
            "type": feature_type(name),
            "probe_wavelength": probe_wavelength(name),
        }
    )


def feature_dimension(spark: SparkSession, features: list[str]) -> DataFrame:
    """The column dimension: one row per feature with its four annotations."""
    names = spark.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("name"))
    return annotated(names)


def slug(x, sub: str = "_") -> Column:
    """Replace characters outside word, dash, dot and space; then spaces; lowercase."""
    text = F.regexp_replace(_c(x), r"[^\p{L}\p{N}_\-. ]", sub)
    return F.lower(F.replace(F.replace(text, F.lit(" "), F.lit("_")), F.lit("__"), F.lit("_")))


def word(x, number: int, sep: str = " ") -> Column:
    """The ``number``-th part (0-based, negative from the end) or null when there is none."""
    parts = F.split(_c(x), _literal(sep))
    return F.try_element_at(parts, F.lit(number + 1 if number >= 0 else number))


def _literal(sep: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}" else ch for ch in sep)


def words(x, start: int, count: int, sep: str = "_") -> Column:
    """Parts ``start .. start+count-1`` (0-based) joined again with ``sep``."""
    return F.array_join(F.slice(F.split(_c(x), _literal(sep)), start + 1, count), sep)


# fixed values: amplifier suffixes of probe names
AMPLIFIERS = ("-B1", "-B3", "-B4")


def probe_base_name(x) -> Column:
    return F.substring_index(_c(x), "-", 1)


def without_amplifier(name: str) -> str:
    for suffix in AMPLIFIERS:
        name = name.replace(suffix, "")
    return name


# fixed values: imaging date in a file name to plate
PLATE_OF_DATE = {"20190807": "5500000013", "20190816": "5500000014"}


def field_file_name(x, plate_of_date: dict[str, str] = PLATE_OF_DATE) -> Column:
    """Raw microscope file name to ``<plate>_63X_<date>_S<session>_P<position>_<well>``."""
    name = _c(x)
    date = word(name, 0, "_")
    plate = None
    for day, number in plate_of_date.items():
        hit = date == F.lit(day)
        plate = F.when(hit, F.lit(number)) if plate is None else plate.when(hit, F.lit(number))
    session = F.substring(word(name, 2, "_"), 3, 1)
    well = F.right(F.substring_index(name, " [144]", 1), F.lit(2))
    position = F.regexp_replace(
        F.substring(F.substring_index(name, "-", -1), 2, 1_000_000), r"_C\d.*$", ""
    )
    return F.concat(
        plate, F.lit("_63X_"), date, F.lit("_S"), session, F.lit("_P"), position, F.lit("_"), well
    )


def cell_id(fov, cell) -> Column:
    return F.format_string("fov-%s-cell-%s", _c(fov).cast("string"), _c(cell).cast("string"))


def well_id(plate, well) -> Column:
    return F.concat_ws("-", _c(plate).cast("string"), _c(well).cast("string"))


# fixed values: first word of a classifier name to its family
FAMILIES = {"Logistic": "Logistic regression", "Random": "Random Forest"}


def classifier_family(x) -> Column:
    head = F.substring_index(_c(x), " ", 1)
    expr = head
    for short, full in FAMILIES.items():
        expr = F.when(head == F.lit(short), F.lit(full)).otherwise(expr)
    return expr
