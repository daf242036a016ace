"""Table sinks, dataset publishing, catalogs and test extracts."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.operators.columns import order_columns, select_renamed
from cytoframe.operators.joins import anti, semi
from cytoframe.operators.resample import sample_keys, sample_rows


def write_table(
    df: DataFrame, path: str, order: Sequence[str] = (), fmt: str = "csv", mode: str = "overwrite"
) -> None:
    """Write with the named columns first; CSV gets a header."""
    writer = order_columns(df, order).write.mode(mode)
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def complete_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows with no missing value in the declared columns (all by default)."""
    return df.dropna("any", subset=list(columns) if columns else None)


def dictionary(spark: SparkSession, spec: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Data dictionary rows (name in the table, published name, description)."""
    return spark.createDataFrame(
        list(spec), "column string, published string, description string"
    )


def by_dictionary(df: DataFrame, spec: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Select and rename the dictionary's columns; the description goes to the column."""
    chosen = select_renamed(df, [(name, published) for name, published, _ in spec])
    for _, published, description in spec:
        chosen = chosen.withMetadata(published, {"comment": description})
    return chosen


def readme_text(title: str, spec: Sequence[tuple[str, str, str]]) -> str:
    lines = [f"# {title}", "", "| Column | Description |", "| --- | --- |"]
    return "\n".join(lines + [f"| {published} | {text} |" for _, published, text in spec])


def publish(
    df: DataFrame,
    path: str,
    version: str,
    metadata_columns: Sequence[str] = (),
    path_columns: Sequence[str] = (),
    readme: str = "",
    partition_by: Sequence[str] = (),
) -> None:
    """Write a dataset folder: ``table`` (parquet), ``columns`` (role per column), ``about``.

    Declared columns must exist. The version label and README text are in ``about``.
    """
    for c in [*metadata_columns, *path_columns]:
        if c not in df.columns:
            raise ValueError(f"declared column {c} is not in the table")
    spark, root = df.sparkSession, path.rstrip("/")
    roles = [
        (c, "path" if c in path_columns else "metadata" if c in metadata_columns else "value",
         dict(df.schema[c].metadata or {}).get("comment", ""))
        for c in df.columns
    ]
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/table")
    spark.createDataFrame(roles, "column string, role string, description string").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{root}/columns")
    spark.createDataFrame([(version, readme)], "version string, readme string").coalesce(
        1
    ).write.mode("overwrite").parquet(f"{root}/about")


def read_published(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path.rstrip('/')}/table")


def catalog(
    datasets: DataFrame, renames: Mapping[str, str], present: DataFrame, optional: Sequence[str] = ()
) -> DataFrame:
    """Map dataset names (owner/name) to published names: the map's, else the part after '/'.

    Two datasets with one published name, or a required dataset that is not ``present``,
    are errors. Returns the datasets that are present.
    """
    from cytoframe.functions.scalars import recode

    named = datasets.select(
        "dataset",
        recode("dataset", renames, F.substring_index("dataset", "/", -1)).alias("published")
        if renames
        else F.substring_index("dataset", "/", -1).alias("published"),
    )
    twice = named.groupBy("published").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"published name {twice[0]['published']} is not unique")
    absent = anti(named, present, ["dataset"]).where(~F.col("dataset").isin(list(optional)))
    lost = absent.limit(1).collect()
    if lost:
        raise ValueError(f"dataset {lost[0]['dataset']} does not exist")
    return semi(named, present, ["dataset"])


PART = "cytoframe_part"


def _in_parts(table: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the part that their content puts them in, and per part its number of rows and digest, whatever their order."""
    columns = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in table.schema.fields]
    kind = F.lit(table.schema.json())
    tagged = table.withColumn(PART, F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int"))
    whole = lambda seed: F.sum(F.xxhash64(F.lit(seed), kind, *columns).cast("decimal(38,0)")).cast("string")
    digests = tagged.groupBy(PART).agg(
        F.count("*").alias("rows"), F.sha2(F.concat_ws("|", F.count("*").cast("string"), whole(1), whole(2)), 256).alias("digest")
    )
    return tagged, digests


def manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """The parts (part, rows, digest, folder) of the latest complete version, or None. A version is there once its manifest is."""
    from pyspark.errors import AnalysisException

    try:
        every = spark.read.schema("part int, rows long, digest string, folder string, parts int, version int").parquet(f"{root}/manifest")
        latest = every.agg(F.max("version")).first()[0]
    except AnalysisException:  # no folder yet
        return None
    return None if latest is None else every.where(F.col("version") == latest)


def publish_changes(table: DataFrame, root: str, parts: int = 64) -> int:
    """Write the parts of a table whose content is new, then a manifest that names all its parts. Returns how many were written.

    Parts are made of rows by their content, so an unchanged row lies in the same part in every version, and a part with the
    same digest is not written again. Files are never replaced and the manifest comes last: a run that breaks
    off leaves the version before it readable, and so does one that goes on while others read. At most ``parts`` rows
    reach the driver; later versions keep the first one's number of parts.
    """
    spark, root = table.sparkSession, root.rstrip("/")
    before = manifest(spark, root)
    rows = before.collect() if before is not None else []
    version = rows[0]["version"] + 1 if rows else 1
    parts = rows[0]["parts"] if rows else parts
    tagged, digests = _in_parts(table, parts)
    kept = {r["part"]: r for r in rows}
    found = {r[PART]: r for r in digests.collect()}
    new = [p for p, r in found.items() if p not in kept or kept[p]["digest"] != r["digest"]]
    if rows and not new and found.keys() == {p for p in kept if p >= 0}:
        return 0
    folder = f"data/{uuid.uuid4().hex}"
    if new:
        tagged.where(F.col(PART).isin(new)).write.partitionBy(PART).parquet(f"{root}/{folder}")
    named = [
        (p, r["rows"], r["digest"], f"{folder}/{PART}={p}" if p in new else kept[p]["folder"], parts) for p, r in sorted(found.items())
    ]
    if not named:  # a table without rows still has columns: a part of no rows stands for them
        table.limit(0).write.parquet(f"{root}/{folder}")
        named = [(-1, 0, "", folder, parts)]
    listed = spark.createDataFrame(named, "part int, rows long, digest string, folder string, parts int")
    listed.coalesce(1).write.parquet(f"{root}/manifest/version={version}")
    return len(new)


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the latest complete version."""
    parts = manifest(spark, root.rstrip("/"))
    if parts is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(*[f"{root.rstrip('/')}/{r['folder']}" for r in parts.select("folder").collect()])


def consolidate(
    spark: SparkSession, entries: DataFrame, source: str, target: str, at_once: int = 4, parts: int = 64
) -> dict[str, int]:
    """Bring every catalogued dataset table up to date under its published name; how many parts of each were written.

    The catalogue is paged to the driver; ``at_once`` datasets are looked at side by side. Only parts whose content is
    new are written.
    """
    def update(row) -> tuple[str, int]:
        table = read_published(spark, f"{source.rstrip('/')}/{row['dataset']}")
        return row["published"], publish_changes(table, f"{target.rstrip('/')}/{row['published']}", parts)

    written, rows = {}, entries.orderBy("published").toLocalIterator()
    with ThreadPoolExecutor(at_once) as pool:
        while page := list(islice(rows, 16 * at_once)):
            written.update(pool.map(update, page))
    return written


def extract_rows(df: DataFrame, key: str, n: int = 2, seed: int = 0) -> DataFrame:
    """A small fixed sample of rows."""
    return sample_rows(df, key, n, seed)


def extract_by_key(
    keyed: DataFrame, tables: Sequence[DataFrame], key: str, n: int = 2, seed: int = 0
) -> list[DataFrame]:
    """All rows of ``n`` sampled keys, from every table."""
    keys = sample_keys(keyed, key, n, seed)
    return [semi(t, keys, [key]) for t in tables]


def described(df: DataFrame) -> dict[str, str]:
    return {f.name: (f.metadata or {}).get("comment", "") for f in df.schema.fields}


