"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.session import _ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    _ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: it survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole(text: str) -> Column:
    """A text column, null as the empty text."""
    return F.coalesce(F.col(text), F.lit(""))


BATCH_ROWS = 1000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def arrow(rows: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for rows that may hold long texts.

    The session's batches are cut to ``BATCH_ROWS`` rows, as whole texts pass through both the JVM and
    the worker, and a worker gives unused memory back when its task ends.
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(_BATCHES)) <= BATCH_ROWS:
        conf.set(_BATCHES, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def stream_past(
    held: DataFrame, asked: DataFrame, keys: list[str], start: Callable[[pa.Table], object],
    search: Callable[[object, pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, parts: int,
) -> DataFrame:
    """Let the rows of ``asked`` pass the ``held`` rows of their group.

    Every held row goes to one place. There a group's held rows come first and become a state once, by ``start``; then the
    asked rows of the group stream by in Arrow batches, each searched with that state. A task's memory is
    one group's held rows and a batch, however many rows ask. Groups without held rows give nothing.
    """
    both = held.withColumn("__asks__", F.lit(0)).unionByName(asked.withColumn("__asks__", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(parts, *keys).sortWithinPartitions(*keys, "__asks__")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, state = None, [], None
        for batch in batches:
            place = list(zip(*(batch.column(k).to_pylist() for k in (*keys, "__asks__"))))
            edges = [i for i in range(len(place)) if not i or place[i] != place[i - 1]]
            for a, b in zip(edges, [*edges[1:], len(place)]):
                if place[a][:-1] != now:
                    now, rows, state = place[a][:-1], [], None
                piece = batch.slice(a, b - a)
                if not place[a][-1]:
                    rows.append(piece)
                elif rows or state is not None:
                    if state is None:
                        state, rows = start(pa.Table.from_batches(rows)), []
                    yield from search(state, piece)

    return dealt.mapInArrow(run, schema)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
