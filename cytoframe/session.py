"""Session defaults, reliable materialisation and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(name: str = "cytoframe", master: str | None = None, **conf) -> SparkSession:
    """A session with adaptive execution on; cluster settings come from spark-submit."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="cytoframe-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared checkpoint folder.

    Used between the rounds of iterative operators and wherever two branches of one plan
    must see the very same rows (approximate sketches are not repeatable).
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the checkpoint folder.

    For wide tables that several jobs read: it is compressed and a job reads only its columns. Unlike ``materialise`` it keeps
    neither partitions nor their order. A table that is stored already is returned as it is.
    """
    if getattr(df, "_cytoframe_stored", False):
        return df
    spark = df.sparkSession
    _ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{os.urandom(8).hex()}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._cytoframe_stored = True
    return table


def broadcast_within(df: DataFrame, values: int = 2_000_000, per_row: int | None = None) -> DataFrame:
    """Materialise a parameter table and hint its broadcast if it is proven small.

    Small means at most ``values`` numbers in all (16 MB of doubles); ``per_row`` is how many
    a row holds, by default one per column. Beyond that the table is joined without a hint,
    so the join is planned by size and adaptive execution splits a skewed side. The table is
    computed once, for the count and for the join.
    """
    small = materialise(df)
    most = values // max(1, per_row or len(df.columns))
    if small.limit(most + 1).count() <= most:
        return F.broadcast(small)
    return small


def split_pieces(spark: SparkSession, most: int = 4096) -> int:
    """How many pieces one hot group is cut into: a power of two, from the shuffle width."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    pieces = 4
    while pieces < min(width, most):
        pieces *= 2
    return pieces
