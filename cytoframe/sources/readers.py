"""Readers with explicit schemas: CSV tables, per-image result files, sparse counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cytoframe.operators.columns import drop_existing, quoted
from cytoframe.operators.joins import merge, semi
from cytoframe.operators.reshape import stack
from cytoframe.operators.resample import sample_keys


def read_csv(
    spark: SparkSession, path: str | Sequence[str], schema: str | T.StructType,
    index_column: str | None = None,
) -> DataFrame:
    """CSV with header and a given schema (no inference pass); empty fields are null."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return drop_existing(df, [index_column]) if index_column else df


def header_names(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def table_schema(
    names: Sequence[str], text: Sequence[str] = (), integers: Sequence[str] = (),
    default: T.DataType | None = None,
) -> T.StructType:
    """Schema of a wide feature table: doubles but for the columns named.

    Score columns go in ``text`` so that marks such as "n" and "0" stay as written.
    """
    kind = default or T.DoubleType()
    return T.StructType(
        [
            T.StructField(
                n, T.StringType() if n in text else T.LongType() if n in integers else kind
            )
            for n in names
        ]
    )


def read_features(
    spark: SparkSession, path: str, text: Sequence[str] = (), integers: Sequence[str] = ()
) -> DataFrame:
    return read_csv(spark, path, table_schema(header_names(spark, path), text, integers))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks a missing value in the files; in the tables it is null."""
    floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
    return df.withColumns({c: F.nanvl(quoted(c), F.lit(None)) for c in floats}) if floats else df


def read_listed(
    spark: SparkSession, manifest: DataFrame, path_column: str, schema: str | T.StructType
) -> DataFrame:
    """All CSV files named in a manifest column, as one table.

    The scan's file index holds every file name on the driver in any case, so the names (and
    nothing else) are gathered to make it.
    """
    listed = manifest.select(quoted(path_column)).where(quoted(path_column).isNotNull()).distinct()
    return read_csv(spark, sorted(r[0] for r in listed.toLocalIterator()), schema)


def read_field_results(
    spark: SparkSession,
    folder: str,
    schema: str | T.StructType,
    expected: DataFrame,
    fov: str = "FOVId",
    deny: Sequence[int] = (),
    pattern: str = "fov_*.csv",
    number: str = r"fov_(\d+)\.csv$",
) -> tuple[DataFrame, DataFrame]:
    """Per-image result files as one table with the image id taken from the file name.

    Ids in ``deny`` are left out. The second table holds the expected ids without a file.
    """
    found = (
        spark.read.schema(schema).option("header", True).option("pathGlobFilter", pattern).csv(folder)
        .withColumn(fov, F.regexp_extract(F.col("_metadata.file_path"), number, 1).try_cast("long"))
    )
    found = found.where(~F.coalesce(quoted(fov).isin(list(deny)), F.lit(False)))
    from cytoframe.operators.joins import anti

    wanted = expected.where(~quoted(fov).isin(list(deny))) if deny else expected
    return semi(found, wanted, [fov]), anti(wanted, found, [fov])


# fixed values: logical names of the five image-analysis tables and their file names
CELL_TABLE_FILES = {
    "image": "Image.csv",
    "merged_nuclei": "FinalNuc.csv",
    "flag_border_nuclei": "FinalNucBorder.csv",
    "napari_cell": "napari_cell.csv",
    "premerge_nuclei_centroids": "NucCentroid.csv",
}


def read_cell_tables(
    spark: SparkSession, folder: str, prefix: str = "", text: Sequence[str] = (),
    integers: Sequence[str] = ("ImageNumber", "ObjectNumber", "Parent_FilterNuc",
                               "Parent_FinalNuc", "Parent_napari_cell"),
) -> dict[str, DataFrame]:
    """The five tables of one image-analysis run under a common folder and file prefix."""
    text = ("ObjectsPathName_napari_cell", "ObjectsFileName_napari_cell", *text)
    root = folder.rstrip("/")
    return {
        name: read_features(spark, f"{root}/{prefix}{file}", text, integers)
        for name, file in CELL_TABLE_FILES.items()
    }


def read_label_lists(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Coordinate files (image, row, column, blank-separated); the class is the file's place."""
    schema = "image int, r int, c int"
    return stack(
        [
            spark.read.schema(schema).option("sep", " ").csv(p).withColumn("class", F.lit(i))
            for i, p in enumerate(paths)
        ]
    )


# ---------------------------------------------------------------- sparse counts

def read_matrix_market(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate text (1-based row, column, count) to (row, col, count), 0-based.

    Comment lines and the size line (the first other line) are left out.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    ).where(~F.trim("value").startswith("%") & (F.trim("value") != ""))
    # the size line of a file is its first in reading order, whatever the others say
    sizes = lines.groupBy("file").agg(F.min(F.struct("block", "line")).alias("at"))
    lines = lines.join(sizes, "file").where(F.struct("block", "line") != F.col("at"))
    parts = F.split(F.trim("value"), r"\s+")
    return lines.select(
        (F.get(parts, F.lit(0)).cast("long") - 1).alias("row"),
        (F.get(parts, F.lit(1)).cast("long") - 1).alias("col"),
        F.get(parts, F.lit(2)).cast("long").alias("count"),
    )


def named_counts(counts: DataFrame, genes: DataFrame, cells: DataFrame) -> DataFrame:
    """Counts with names: ``genes`` holds (row, gene), ``cells`` (col, cell)."""
    named = merge(counts, genes, ["row"], "inner", False)
    return merge(named, cells, ["col"], "inner", False).select("gene", "cell", "count")


def sample_cells(counts: DataFrame, n: int = 10, seed: int = 0, cell: str = "cell") -> DataFrame:
    """All counts of ``n`` cells picked by hash."""
    return semi(counts, sample_keys(counts, cell, n, seed), [cell])


def expression_subset(
    counts: DataFrame,
    cells: DataFrame,
    genes: Mapping[str, str],
    days: Mapping[str, str],
    cell: str = "cell",
) -> DataFrame:
    """Wide table of some genes for the cells of some days.

    ``genes`` maps gene to output column, ``days`` day to label. Cells without a count of a
    gene have 0 there.
    """
    from cytoframe.functions.scalars import recode

    chosen = cells.where(F.col("day").isin(list(days))).select(
        quoted(cell), recode("day", days).alias("Cell age"), F.col("protocol").alias("Protocol")
    )
    wide = (
        counts.where(F.col("gene").isin(list(genes)))
        .groupBy(quoted(cell))
        .agg(
            *[
                F.sum(F.when(F.col("gene") == g, F.col("count")).otherwise(0)).alias(out)
                for g, out in genes.items()
            ]
        )
    )
    return merge(chosen, wide, [cell], "left", False).fillna(0, list(genes.values()))
