"""Weighted ridge by normal equations, and the settings of the classifier comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.operators.columns import quoted
from cytoframe.operators.resample import bootstrap_weights
from cytoframe.operators.stats import class_weights


# ---------------------------------------------------------------- ridge

@dataclass(frozen=True)
class Ridge:
    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        terms = [quoted(f) * F.lit(c) for f, c in zip(self.features, self.coefficients)]
        return reduce(lambda a, b: a + b, terms, F.lit(self.intercept))

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        return df.withColumn(out, self.column())

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame(
            list(zip(self.features, self.coefficients)), "feature string, coef double"
        )


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing value in any of the columns (null or NaN)."""
    kinds = dict(df.dtypes)
    present = [
        quoted(c).isNotNull() & ~F.isnan(quoted(c)) if kinds[c] in ("double", "float") else quoted(c).isNotNull()
        for c in columns
    ]
    return df.where(reduce(lambda a, b: a & b, present))


def _centres(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """Column means: sums of products are taken around them, so large offsets cancel nothing."""
    means = df.agg(*[F.avg(quoted(c).cast("double")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [m or 0.0 for m in means]


def _moments(features: Sequence[str], y: str, w: Column, centres: Sequence[float]) -> list[Column]:
    """Weighted sums of all products of (1, features, y), shifted by their centres: one row."""
    shifted = [quoted(c).cast("double") - F.lit(m) for c, m in zip([*features, y], centres)]
    terms = [F.lit(1.0), *shifted]
    return [
        F.sum(w * terms[i] * terms[j]).alias(f"m_{i}_{j}")
        for i in range(len(terms))
        for j in range(i, len(terms))
    ]


def _solve(row, n_features: int, alpha: float) -> tuple[np.ndarray, float]:
    """Ridge from the moments: centre by the weighted means, penalise only the slopes."""
    k = n_features + 2
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = row[f"m_{i}_{j}"]
    total, mean = m[0, 0], m[0, 1:] / m[0, 0]
    centred = m[1:, 1:] - total * np.outer(mean, mean)
    slopes = np.linalg.solve(
        centred[:-1, :-1] + alpha * np.eye(n_features), centred[:-1, -1]
    )
    return slopes, float(mean[-1] - slopes @ mean[:-1])


def fit_ridge(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    balance: bool = True,
    alpha: float = 0.001,
) -> Ridge:
    """Least squares with penalty ``alpha``; ``balance`` weights rows by n / count(y).

    Rows with a missing feature or target are left out of every sum. One aggregate gives the
    means, one the moments around them; only a (features + 2) squared matrix is solved on the
    driver.
    """
    df = _complete(df, [*features, y])
    centres = _centres(df, [*features, y])
    data = class_weights(df, y, "__weight__") if balance else df.withColumn("__weight__", F.lit(1.0))
    row = data.agg(*_moments(features, y, quoted("__weight__"), centres)).first()
    slopes, intercept = _solve(row, len(features), alpha)
    intercept += centres[-1] - float(slopes @ np.array(centres[:-1]))
    return Ridge(tuple(features), tuple(float(s) for s in slopes), intercept)


def bootstrap_ridge(
    df: DataFrame,
    features: Sequence[str],
    y: str,
    order_by: str,
    replicates: int = 10,
    seed: int = 0,
    alpha: float = 0.001,
) -> DataFrame:
    """Ridge slopes per replicate, long: (replicate, feature, coef).

    Each replicate standardises its features and balances its classes anew, as a fit on
    the redrawn table would. Only one row of moments per replicate reaches the solver. Rows
    with a missing value are left out before the draws.
    """
    df = _complete(df, [*features, y])
    centres = _centres(df, [*features, y])
    drawn = bootstrap_weights(df, [], [*features, y], order_by, replicates, seed)
    counts = drawn.groupBy("replicate", quoted(y)).agg(F.sum("__w__").alias("__c__"))
    totals = counts.withColumn("__n__", F.sum("__c__").over(Window.partitionBy("replicate")))
    weighted = drawn.join(totals, ["replicate", y]).withColumn(
        "__weight__", F.col("__w__") * F.col("__n__") / F.col("__c__")
    )
    w = F.col("__w__")
    plain = [F.sum(w).alias("n")]
    for i, f in enumerate(features):
        plain += [
            F.sum(w * (quoted(f) - F.lit(centres[i]))).alias(f"s_{i}"),
            F.sum(w * (quoted(f) - F.lit(centres[i])) ** 2).alias(f"q_{i}"),
        ]
    moments = weighted.groupBy("replicate").agg(*plain, *_moments(features, y, F.col("__weight__"), centres))
    names = list(features)

    def solve(batches):
        import pandas as pd

        for batch in batches:
            for _, row in batch.iterrows():
                n = row["n"]
                sd = np.array(
                    [
                        np.sqrt(max(row[f"q_{i}"] / n - (row[f"s_{i}"] / n) ** 2, 0.0)) or 1.0
                        for i in range(len(names))
                    ]
                )
                # slopes for standardised features: rescale the raw moments
                scaled = row.copy()
                scale = np.concatenate([[1.0], 1.0 / sd, [1.0]])
                for i in range(len(scale)):
                    for j in range(i, len(scale)):
                        scaled[f"m_{i}_{j}"] = row[f"m_{i}_{j}"] * scale[i] * scale[j]
                slopes, _ = _solve(scaled, len(names), alpha)
                yield pd.DataFrame(
                    {"replicate": int(row["replicate"]), "feature": names, "coef": slopes}
                )

    return moments.mapInPandas(solve, "replicate int, feature string, coef double")


# ---------------------------------------------------------------- classifiers

# fixed values: the channels of each feature set
FEATURE_SETS = {
    "morphological": ["segmentation", "bright field", "DNA"],
    "probe": ["FISH"],
    "structure": ["structure"],
    "all_nonstruct": ["segmentation", "bright field", "DNA", "FISH"],
    "all": ["segmentation", "FISH", "bright field", "DNA", "structure"],
}


def feature_sets(channels: dict[str, str]) -> dict[str, list[str]]:
    """Feature name to channel, turned into the columns of each set."""
    return {
        name: [f for f, channel in channels.items() if channel in wanted]
        for name, wanted in FEATURE_SETS.items()
    }


def classifier_grid(test: bool = False) -> list[dict]:
    """The classifiers to compare: dummies, logistic, nearest neighbours, forests."""
    # fixed values: strategies, penalties, neighbours, depths and trees of the grid
    dummies = ["most_frequent"] if test else ["stratified", "most_frequent", "prior", "uniform"]
    penalties = [1e-3] if test else [10.0**e for e in range(-5, 3)]
    neighbours = [3] if test else [1, 2, 3, 5, 9]
    depths = [3] if test else list(range(3, 11))
    trees = 32 if test else 128
    return (
        [{"name": f"Dummy {s}", "kind": "dummy", "strategy": s} for s in dummies]
        + [{"name": f"Logistic Regression C={c:g}", "kind": "logistic", "C": c} for c in penalties]
        + [{"name": f"KNN k={k}", "kind": "knn", "k": k} for k in neighbours]
        + [
            {"name": f"Random Forest depth = {d}", "kind": "forest", "depth": d, "trees": trees}
            for d in depths
        ]
    )


def add_annotator(
    predictions: DataFrame, cells: DataFrame, true: str, other: str, key: str, name: str
) -> DataFrame:
    """A second annotator's scores as one more classifier."""
    return predictions.unionByName(
        cells.select(
            *[quoted(c) for c in predictions.columns if c not in ("classifier", key, "true", "pred")],
            F.lit(name).alias("classifier"),
            quoted(key),
            quoted(true).cast("int").alias("true"),
            quoted(other).cast("int").alias("pred"),
        )
    )
