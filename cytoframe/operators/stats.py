"""Contingency tables, intervals, scaling, correlation and classifier reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.scalars import ratio
from cytoframe.operators.columns import quoted
from cytoframe.operators.joins import merge
from cytoframe.operators.ranks import average_ranks, group_quantiles
from cytoframe.session import broadcast_within, materialise


def contingency(df: DataFrame, keys: Sequence[str], name: str = "Count") -> DataFrame:
    """Rows per key combination; rows with a missing key are left out."""
    return (
        df.dropna("any", subset=list(keys))
        .groupBy(*[quoted(k) for k in keys])
        .agg(F.count("*").alias(name))
    )


def mean_interval(
    df: DataFrame, keys: Sequence[str], value: str, extent: float = 0.95
) -> DataFrame:
    """Mean with the lower and upper quantile of the central ``extent`` per group."""
    means = df.groupBy(*[quoted(k) for k in keys]).agg(F.avg(quoted(value)).alias("mean"))
    bounds = group_quantiles(
        df, keys, value, {"ci_low": (1 - extent) / 2, "ci_high": (1 + extent) / 2}
    )
    return merge(means, bounds, keys, "inner")


def class_weights(df: DataFrame, y: str, weight: str = "weight") -> DataFrame:
    """Add n / (rows with the same y)."""
    counts = materialise(df.groupBy(quoted(y)).agg(F.count("*").alias("__c__")))
    total = counts.agg(F.sum("__c__")).first()[0]
    shares = counts.select(quoted(y), (F.lit(total) / F.col("__c__")).alias(weight))
    return merge(df, broadcast_within(shares), [y], "left")


def over_group_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str
) -> DataFrame:
    """Value divided by the median of its own group."""
    medians = group_quantiles(df, keys, value, {"__median__": 0.5})
    joined = merge(df, broadcast_within(medians), keys, "left")
    return joined.withColumn(out, ratio(value, "__median__")).drop("__median__")


def global_median(df: DataFrame, value: str) -> float | None:
    row = group_quantiles(df, [], value, {"m": 0.5}).first()
    return row["m"] if row else None


# ---------------------------------------------------------------- scaling

def scaler_params(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation per column (and group); a zero deviation becomes 1."""
    stats = []
    for c in columns:
        sd = F.stddev_pop(quoted(c))
        flat = F.max(quoted(c)) == F.min(quoted(c))
        stats.append(F.avg(quoted(c)).alias(f"__mean_{c}"))
        stats.append(F.when(flat | (sd == 0), F.lit(1.0)).otherwise(sd).alias(f"__sd_{c}"))
    return df.groupBy(*[quoted(k) for k in by]).agg(*stats)


def _scaled(columns: Sequence[str]) -> dict[str, Column]:
    return {c: (quoted(c) - quoted(f"__mean_{c}")) / quoted(f"__sd_{c}") for c in columns}


def apply_scaler(
    df: DataFrame, params: DataFrame, columns: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Scale by fitted parameters; the global ones are a single row and become literals."""
    if by:
        joined = merge(df, broadcast_within(params), list(by), "left")
        return joined.withColumns(_scaled(columns)).select([quoted(c) for c in df.columns])
    row = params.first()
    return df.withColumns(
        {
            c: (quoted(c) - F.lit(row[f"__mean_{c}"])) / F.lit(row[f"__sd_{c}"])
            for c in columns
        }
    )


def z_scores(
    splits: dict[str, DataFrame],
    columns: Sequence[str],
    probe_columns: Sequence[str] = (),
    probe: str | None = None,
    fit_on: str = "train",
) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Scale every split by parameters fitted on one of them.

    ``probe_columns`` are scaled within each probe instead of over all cells. Returns the
    scaled splits and the parameter tables.
    """
    plain = [c for c in columns if not (probe and c in probe_columns)]
    params = {"all": scaler_params(splits[fit_on], list(columns))}
    if probe and probe_columns:
        params["probe"] = scaler_params(splits[fit_on], list(probe_columns), [probe])
    out = {}
    for name, df in splits.items():
        scaled = apply_scaler(df, params["all"], plain) if plain else df
        if "probe" in params:
            scaled = apply_scaler(scaled, params["probe"], list(probe_columns), [probe])
        out[name] = scaled
    return out, params


# ---------------------------------------------------------------- correlation

def spearman(
    df: DataFrame, keys: Sequence[str], x: str, y: str, weight: str | None = None, out: str = "rho"
) -> DataFrame:
    """Rank correlation with mean ranks for ties, per group; rows lacking x or y are out."""
    pairs = df.select(
        *[quoted(k) for k in keys],
        quoted(x).alias("__x__"),
        quoted(y).alias("__y__"),
        (F.lit(1) if weight is None else quoted(weight)).alias("__w__"),
    ).dropna("any", subset=["__x__", "__y__"])
    if weight is None:
        pairs = materialise(
            pairs.groupBy(*[quoted(k) for k in keys], "__x__", "__y__").agg(
                F.sum("__w__").alias("__w__")
            )
        )
    ranked = pairs
    for value, rank in (("__x__", "__rx__"), ("__y__", "__ry__")):
        ranks = average_ranks(pairs, keys, value, rank, "__w__")
        ranked = merge(ranked, ranks, [*keys, value], "inner", nulls_match=bool(keys))
    w, rx, ry = F.col("__w__"), F.col("__rx__"), F.col("__ry__")
    sums = ranked.groupBy(*[quoted(k) for k in keys]).agg(
        F.sum(w).cast("double").alias("n"),
        F.sum(w * rx).alias("sx"),
        F.sum(w * ry).alias("sy"),
        F.sum(w * rx * rx).alias("sxx"),
        F.sum(w * ry * ry).alias("syy"),
        F.sum(w * rx * ry).alias("sxy"),
    )
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    spread = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (
        n * F.col("syy") - F.col("sy") * F.col("sy")
    )
    return sums.select(*[quoted(k) for k in keys], F.try_divide(cov, F.sqrt(spread)).alias(out))


# ---------------------------------------------------------------- classifier report

def confusion_report(
    predictions: DataFrame, keys: Sequence[str], true: str = "true", pred: str = "pred"
) -> DataFrame:
    """Precision, recall, F1 and support per key, as plain and support-weighted means.

    Labels are those seen as truth or prediction; a 0/0 share counts as 0. Only the counts
    per (key, true, pred) leave the first aggregate.
    """
    by = [quoted(k) for k in keys]
    cells = predictions.groupBy(*by, quoted(true).alias("__t__"), quoted(pred).alias("__p__")).agg(
        F.count("*").alias("__n__")
    )
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("__t__").alias("label"),
                    F.col("__n__").alias("support"),
                    F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("__t__") == F.col("__p__"), F.col("__n__"))
                    .otherwise(F.lit(0))
                    .alias("hit"),
                ),
                F.struct(
                    F.col("__p__").alias("label"),
                    F.lit(0).cast("long").alias("support"),
                    F.col("__n__").alias("predicted"),
                    F.lit(0).cast("long").alias("hit"),
                ),
            )
        ).alias("s"),
    ).select(*by, "s.*")
    per_label = sides.groupBy(*by, "label").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "hit")]
    )
    zero = F.lit(0.0)
    precision = F.coalesce(ratio("hit", "predicted"), zero)
    recall = F.coalesce(ratio("hit", "support"), zero)
    scored = per_label.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1-score",
        F.coalesce(
            F.try_divide(
                2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")
            ),
            zero,
        ),
    )
    measures = ["precision", "recall", "f1-score"]
    plain = [F.avg(quoted(m)).alias(f"macro {m}") for m in measures]
    weighted = [
        ratio(F.sum(quoted(m) * F.col("support")), F.sum("support")).alias(f"weighted {m}")
        for m in measures
    ]
    both = scored.groupBy(*by).agg(*plain, *weighted, F.sum("support").alias("support"))
    kinds = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(f"{kind} avg").alias("Reduction"),
                    *[quoted(f"{kind} {m}").alias(m) for m in measures],
                )
                for kind in ("macro", "weighted")
            ]
        )
    ).alias("__r__")
    return both.select(*by, kinds, "support").select(*by, "__r__.*", "support")


def accuracy(df: DataFrame, keys: Sequence[str], true: str, pred: str) -> DataFrame:
    hit = (quoted(true) == quoted(pred)).cast("double")
    return df.groupBy(*[quoted(k) for k in keys]).agg(F.avg(hit).alias("accuracy"))


def sum_columns(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [quoted(c) for c in columns])
