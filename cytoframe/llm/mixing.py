"""Mixing documents to target domain weights with soft membership; DataFrame functions only.

1. Domain posteriors. Simple statistics of the whole text (length, word length, distinct words, symbols,
   sentence ends, line length) fall into fixed bins; a naive Bayes table over the bins is counted from all
   labelled documents.
2. Rates. Nonnegative document rates w minimise

       1/2 sum_d (sum_i w_i n_i p_id - T_d)^2 / m_d + strength/2 sum_i n_i (w_i - 1)^2

   for token numbers n, posteriors p, target totals T and present totals m. Scaled by 1 / n_i the gradient
   of a document is its posteriors' product with the domains' relative misses, so a projected gradient step
   needs one aggregate of a few sums, and a rate follows from the posteriors and the misses of the steps so
   far. Documents with the same bins have the same posteriors: the steps run over these cells, whose number
   the bins bound, whatever the corpus.
3. Copies. The rate's whole part, and one more with the rest as probability, drawn by the id's hash.

Defined cases: a null text is the empty text (no tokens, it has a rate all the same); null ids draw by the
hash of null; repeated rows each have their rate and the same draw; labels that are null, of unknown
documents or not among the targets are left out; a document labelled twice counts with both; without labels
all posteriors are equal; targets of domains without tokens are left out and the others scaled up; an empty
table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm.common import table, whole, written

STEPS = 60
QUALITY_TARGETS = {0: 0.05, 1: 0.95}
BINS = 16


def text_bins(text: Column, n_tokens: Column, words: Column) -> Column:
    """An array of bin numbers (0 to ``BINS`` - 1), one per statistic of the text."""
    size = F.greatest(F.char_length(text), F.lit(1))
    count = F.greatest(n_tokens, F.lit(1))
    statistics = [
        F.log2(count),
        F.char_length(text) / count,
        BINS * F.size(F.array_distinct(words)) / count,
        200 * F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s.,;:!?'\"()-]")) / size,
        100 * F.regexp_count(text, F.lit(r"[.!?](?=\s|$)")) / count,
        F.log2(size / F.size(F.split(text, "\n"))),
        200 * F.regexp_count(text, F.lit(r"\p{N}")) / size,
    ]
    return F.array(*(F.least(F.greatest(F.floor(s), F.lit(0)), F.lit(BINS - 1)).cast("int") for s in statistics))


def _posteriors(counts: dict, priors: dict, domains: list[int], n_statistics: int) -> Column:
    """Naive Bayes over the bins, as an array in the order of ``domains``; the table is a literal."""
    logs = [
        [
            [
                math.log((counts.get((s, b, d), 0) + 1) / (priors.get(d, 0) + BINS))
                for b in range(BINS)
            ]
            for s in range(n_statistics)
        ]
        for d in domains
    ]
    total = sum(priors.get(d, 0) for d in domains)
    scores = []
    for d, of_domain in zip(domains, logs):
        score = F.lit(math.log((priors.get(d, 0) + 1) / (total + len(domains))))
        for s, of_statistic in enumerate(of_domain):
            score = score + F.element_at(F.lit(of_statistic), F.col("bins")[s] + 1)
        scores.append(score)
    array = F.array(*scores)
    shifted = F.transform(array, lambda x: F.exp(x - F.array_max(array)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def _rate(posteriors: Column, misses: list[list[float]], step: float, strength: float) -> Column:
    """The rate after the steps so far: start at 1, move against the gradient, stay nonnegative."""
    if not misses:
        return F.lit(1.0)
    return F.aggregate(
        F.lit(misses),
        F.lit(1.0),
        lambda w, r: F.greatest(
            F.lit(0.0),
            w - step * (
                F.aggregate(F.zip_with(posteriors, r, lambda p, x: p * x), F.lit(0.0), lambda a, y: a + y)
                + strength * (w - 1)
            ),
        ),
    )


def fit_misses(
    cells: DataFrame, targets: list[float], strength: float, steps: int = STEPS, close: float = 1e-7
) -> tuple[list[list[float]], float]:
    """Relative misses of the domain totals before each projected gradient step, and the step's length.

    ``cells`` has ``posteriors`` and their ``tokens``; a step collects one number per domain.
    """
    def totals(weight: Column) -> list[float]:
        parts = [F.coalesce(F.sum(weight * F.col("tokens") * F.col("posteriors")[d]), F.lit(0.0)) for d in range(len(targets))]
        return list(cells.agg(*(p.alias(f"d{d}") for d, p in enumerate(parts))).first())

    mass = totals(F.lit(1.0))
    whole_mass = sum(mass)
    usable = sum(t for t, m in zip(targets, mass) if m > 0)
    if not usable:
        return [], 1.0
    wanted = [t / usable * whole_mass if m > 0 else 0.0 for t, m in zip(targets, mass)]
    step = 1 / (1 + strength)
    misses: list[list[float]] = []
    now = mass
    for _ in range(steps):
        misses.append([(x - t) / m if m > 0 else 0.0 for x, t, m in zip(now, wanted, mass)])
        before, now = now, totals(_rate(F.col("posteriors"), misses, step, strength))
        if max(abs(a - b) for a, b in zip(now, before)) <= close * whole_mass:
            break
    return misses, step


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[int, float],
    label: str = "quality",
    strength: float = 0.001,
    seed: int = 9,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``row`` (the document's columns), ``n_tokens`` (words), ``posteriors``, ``rate`` and ``copies``."""
    domains = sorted(targets)
    rows = docs.select(F.struct("*").alias("row"), F.col(key).alias("key"), whole(text).alias("text"))
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = rows.withColumn("words", words).withColumn("n_tokens", F.size("words").cast("long"))
    bins = text_bins(F.col("text"), F.col("n_tokens"), F.col("words"))
    # the texts are read once: later passes take their columns from this table
    binned = written(rows.select("row", "key", "n_tokens", bins.alias("bins")), "bins")
    narrow = binned.select("key", "n_tokens", "bins")
    known = labels.where(F.col(label).isin(domains)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("domain"))
    counted = (
        narrow.join(known, "key")
        .select("domain", F.posexplode("bins").alias("statistic", "bin"))
        .groupBy("domain", "statistic", "bin")
        .count()
        .collect()  # at most domains x statistics x bins
    )
    counts = {(r["statistic"], r["bin"], r["domain"]): r["count"] for r in counted}
    priors = {d: sum(c for (s, _, e), c in counts.items() if s == 0 and e == d) for d in domains}
    posteriors = _posteriors(counts, priors, domains, 7)
    cells = narrow.groupBy("bins").agg(F.sum("n_tokens").cast("double").alias("tokens"))
    cells = written(cells.select(posteriors.alias("posteriors"), "tokens"), "cells")
    misses, step = fit_misses(cells, [targets[d] for d in domains], strength)
    draw = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return (
        binned.withColumn("posteriors", posteriors)
        .withColumn("rate", _rate(F.col("posteriors"), misses, step, strength))
        .select("row", "n_tokens", "posteriors", "rate", F.floor(F.col("rate") + draw).cast("int").alias("copies"))
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's domain posteriors by quality label, its rate and its number of copies."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rates = mixing_rates(docs, table(spark, sf_dir, "labels"), QUALITY_TARGETS)
    return rates.select(
        F.col("row.doc_id").alias("doc_id"),
        F.col("row.source").alias("source"),
        "n_tokens",
        F.col("posteriors")[0].alias("p_low"),
        F.col("posteriors")[1].alias("p_high"),
        "rate",
        "copies",
    )
