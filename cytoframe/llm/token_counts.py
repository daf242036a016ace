"""Token counts with a cache keyed by content digest and tokenizer-version digest.

A document's content is joined by digest to the stored counts; each distinct content that is
missing is encoded once, and its count is appended to the cache. Only digests and counts meet in
the final join, whose hot keys (many copies of one text) adaptive execution can split; copies of
a text are folded before its shuffle.

Defined cases: a null text is the empty text (0 bytes, 0 tokens); repeated rows give a row each;
a null id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm.common import arrow, shared_path, table, whole
from cytoframe.llm.encoding import blocks, encode, version_digest

CACHE = "digest binary, version string, n_tokens bigint"


def counted(batches: Iterator[pa.RecordBatch], path: str, version: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, digests = batch.column("text").to_pylist(), batch.column("digest")
        for start, end in blocks(texts):
            yield pa.RecordBatch.from_arrays(
                [
                    digests.slice(start, end - start),
                    pa.array([version] * (end - start)),
                    pa.array([len(ids) for ids in encode(texts[start:end], path)], pa.int64()),
                ],
                ["digest", "version", "n_tokens"],
            )


def cached_counts(
    spark: SparkSession, docs: DataFrame, cache: str, tokenizer: str, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``key``, its ``n_bytes`` and ``n_tokens``; new counts are appended to the table at ``cache``.

    The cache is a folder of Parquet files; it is made if it is missing. A count that was appended
    twice (two jobs at once, or a job that was started again) counts once.
    """
    version = version_digest(tokenizer)
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    rows = docs.select(F.col(key).alias("key"), whole(text).alias("text"))
    rows = rows.select("key", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))

    def stored() -> DataFrame:
        kept = spark.read.schema(CACHE).parquet(cache).where(F.col("version") == version)
        return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    misses = (
        rows.select("digest", "text")
        .join(stored().select("digest"), "digest", "left_anti")
        .groupBy("digest")
        .agg(F.first("text").alias("text"))
    )
    arrow(misses, lambda batches: counted(batches, tokenizer, version), CACHE).write.mode("append").parquet(cache)
    return (
        rows.select("key", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
        .join(stored(), "digest", "left")
        .select(F.col("key").alias(key), "n_bytes", "n_tokens")
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes and tokens; the query starts from an empty cache."""
    counts = cached_counts(
        spark,
        table(spark, sf_dir, "documents"),
        shared_path(spark, "token-cache"),
        public_tokenizers.path("byte_bpe_50k.json"),
    )
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)
