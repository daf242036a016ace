"""Pixel tables stored by field: bucketed once, so that work per field needs no exchange afterwards."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from cytoframe.operators.columns import quoted


def _name(path: str) -> str:
    """A catalogue name of its own for each path."""
    return "pixels_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def _ticked(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def store_pixels(pixels: DataFrame, path: str, fov: str = "fov", buckets: int | None = None) -> DataFrame:
    """Store a pixel table bucketed and sorted by field, and return it as stored.

    All pixels of a field go to one file: the rows are dealt once by the hash that also numbers the buckets, so there are as
    many files as buckets (by default the session's shuffle width). A field is one image, so the camera bounds what a bucket's
    largest field weighs; choose ``buckets`` so that a bucket is one task's worth of rows. Rows without a field share a bucket.

    Group-bys and windows whose keys include the field, and joins on the field alone, then run without an exchange, and a
    filter on single fields reads their buckets only. Joins on the field and further columns do so where
    ``spark.sql.requireAllClusterKeysForCoPartition`` is false: that is left to the caller, because it holds for
    every join of the session, and keeps rows of a hot key in one task.

    ``path`` must be new. Its description (``layout``) is written last: without it there is no table.
    """
    spark, path = pixels.sparkSession, path.rstrip("/")
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    (
        pixels.repartition(buckets, quoted(fov))
        .write.bucketBy(buckets, fov).sortBy(fov).format("parquet")
        .option("path", f"{path}/rows").saveAsTable(_name(path))
    )
    layout = [(fov, buckets, pixels.schema.json())]
    spark.createDataFrame(layout, "fov string, buckets int, columns string").coalesce(1).write.parquet(f"{path}/layout")
    return spark.table(_name(path))


def stored_pixels(spark: SparkSession, path: str) -> DataFrame:
    """A stored pixel table, also in a session that did not write it: its buckets are told to the catalogue again."""
    path = path.rstrip("/")
    layout = spark.read.parquet(f"{path}/layout").first()
    if not spark.catalog.tableExists(_name(path)):
        columns = StructType.fromJson(json.loads(layout["columns"])).toDDL()
        location = f"{path}/rows".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {_name(path)} ({columns}) USING parquet "
            f"CLUSTERED BY ({_ticked(layout['fov'])}) SORTED BY ({_ticked(layout['fov'])}) "
            f"INTO {layout['buckets']} BUCKETS LOCATION '{location}'"
        )
    return spark.table(_name(path))
