"""Readers of the supplied tables and the pixel stand-ins derived from them."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.operators.pixels import from_arrays


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark) -> str:
    """A new folder beside the checkpoints; a local one, removed at the end, only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="cytoframe-io-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return folder
    return f"{root.rstrip('/')}/io-{os.urandom(6).hex()}"


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 image per embedding.

    v = non-negative whole grey values, e = the value itself, label = four 4 x 4 cells,
    nucleus = low values, probe = high values, cls = six bands of v.
    """
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("fov"), F.col("embedding").cast("array<double>").alias("values")
    )
    px = from_arrays(vectors, 8, "values", ("fov",), "e")
    v = F.floor((F.col("e") + 1) * 1000).cast("long")
    return px.withColumns(
        {
            "v": v,
            "label": (F.expr("y div 4") * 2 + F.expr("x div 4") + 1).cast("int"),
            "nucleus": (F.col("e") < -0.1).cast("int"),
            "probe": (F.col("e") > 0.1).cast("int"),
            "cls": F.pmod(F.expr("cast(floor((e + 1) * 1000) as bigint) div 50"), F.lit(6)).cast("int"),
        }
    )


# the same pixel table in SQL
PX = """px AS (
  SELECT fov, y, x, e, CAST(floor((e + 1) * 1000) AS BIGINT) AS v,
         CAST((y // 4) * 2 + (x // 4) + 1 AS INTEGER) AS label,
         CAST(e < -0.1 AS INTEGER) AS nucleus, CAST(e > 0.1 AS INTEGER) AS probe,
         CAST((CAST(floor((e + 1) * 1000) AS BIGINT) // 50) % 6 AS INTEGER) AS cls
  FROM (SELECT vec_id AS fov, (i - 1) // 8 AS y, (i - 1) % 8 AS x,
               CAST(embedding[i] AS DOUBLE) AS e
        FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
)"""
