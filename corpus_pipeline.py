"""From raw documents to packed training sequences.

Five stages, each over all that the one before kept; what one returns is written and read again as the
next one's documents. ``run`` returns the last stage's pieces. No SQL can express the field, the signatures
or the packing, so the tests compare the stages with plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm.common import table, written
from cytoframe.llm.mixing import QUALITY_TARGETS, mixing_rates
from cytoframe.llm.near_duplicates import keep_one_of_each
from cytoframe.llm.packing import packed_documents
from cytoframe.llm.toxicity import score_toxicity, toxicity_model
from cytoframe.llm.unit_dedup import drop_repeated_units

REJECT_FROM = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below ``REJECT_FROM``."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where(F.col("score") < REJECT_FROM).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity of 0.8 or more)."""
    return keep_one_of_each(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines and passages that an earlier one has; ``n_chars`` follows the text."""
    result = drop_repeated_units(docs, unit="passage").withColumn("row", F.col("row").withField("text", F.col("kept_text")))
    if "n_chars" in docs.columns:
        size = F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)
        result = result.withColumn("row", F.col("row").withField("n_chars", size))
    return result.select("row.*")


def mix_by_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate for the target token shares by quality has it."""
    rates = mixing_rates(docs, table(spark, sf_dir, "labels"), QUALITY_TARGETS)
    return rates.select("row", F.explode(F.sequence(F.lit(0), F.col("copies"))).alias("copy")).where("copy > 0").select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packed_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("substring-dedup", drop_repeated_lines),
    ("mixing", mix_by_quality),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
