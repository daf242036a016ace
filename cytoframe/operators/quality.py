"""Cleaning of the feature table and data checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.operators.columns import quoted
from cytoframe.operators.reshape import stack
from cytoframe.session import stored


def null_fractions(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of missing values per column, in one pass; one row reaches the driver."""
    row = df.agg(
        *[F.avg(quoted(c).isNull().cast("double")).alias(c) for c in columns]
    ).first()
    return {c: row[c] or 0.0 for c in columns}


def row_null_fraction(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [quoted(c).isNull().cast("int") for c in columns]) / F.lit(
        float(len(columns))
    )


def prune_missing(
    df: DataFrame, columns: Sequence[str], thresh: float = 0.1, axis: str = "columns"
) -> tuple[DataFrame, list[str]]:
    """Keep feature columns (or rows) whose share of missing values is below ``thresh``."""
    columns = list(columns)
    if axis == "columns":
        shares = null_fractions(df, columns)
        dropped = [c for c in columns if not shares[c] < thresh]
        return df.drop(*dropped), [c for c in columns if c not in dropped]
    if axis == "rows":
        return df.where(row_null_fraction(columns) < thresh), columns
    raise ValueError(f"unknown axis {axis}")


def prune_iteratively(
    df: DataFrame, columns: Sequence[str], threshs: Sequence[float] = (0.1, 0.01)
) -> tuple[DataFrame, list[str]]:
    """Columns, then rows, at ever tighter thresholds. One aggregate job per threshold.

    The input is computed once; the jobs read their columns of the stored table.
    """
    df = stored(df)
    for thresh in threshs:
        for axis in ("columns", "rows"):
            df, columns = prune_missing(df, columns, thresh, axis)
    return df, list(columns)


def low_variance_columns(
    df: DataFrame, groups: Sequence[str], columns: Sequence[str], threshold: float = 0.0
) -> list[str]:
    """Columns whose variance is at or below the threshold in at least one group.

    At threshold 0 the value range decides too, so that rounding noise in the variance of
    a constant column does not keep it.
    """
    spread = []
    for c in columns:
        var = F.var_pop(quoted(c))
        if threshold == 0:
            var = F.least(var, F.max(quoted(c)) - F.min(quoted(c)))
        spread.append(var.alias(c))
    by_group = df.groupBy(*[quoted(g) for g in groups]).agg(*spread)
    row = by_group.agg(*[F.min(quoted(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] <= threshold]


def drop_low_variance(
    df: DataFrame, groups: Sequence[str], columns: Sequence[str], threshold: float = 0.0
) -> tuple[DataFrame, list[str]]:
    low = low_variance_columns(df, groups, columns, threshold)
    return df.drop(*low), [c for c in columns if c not in low]


def drop_scored(
    df: DataFrame, score_columns: Sequence[str], exclude: Sequence[int] = (-1, 0)
) -> DataFrame:
    """Drop rows where any score is one of ``exclude``; rows without a score stay."""
    bad = [F.coalesce(quoted(c).isin(list(exclude)), F.lit(False)) for c in score_columns]
    return df.where(~reduce(lambda a, b: a | b, bad))


def any_error(df: DataFrame, part: str = "ModuleError", null_is_failure: bool = False) -> Column:
    """Is any of the error columns 1 (or, on request, missing)?"""
    flags = []
    for c in df.columns:
        if part in c:
            hit = F.coalesce(quoted(c) == 1, F.lit(False))
            flags.append(hit | quoted(c).isNull() if null_is_failure else hit)
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def failed_images(
    images: DataFrame, key: str = "ImageNumber", null_is_failure: bool = False
) -> DataFrame:
    return images.where(any_error(images, null_is_failure=null_is_failure)).select(quoted(key))


def without_key(df: DataFrame, key: str = "ImageNumber") -> DataFrame:
    """Drop rows whose key is missing: listed in a manifest but never analysed."""
    return df.where(quoted(key).isNotNull())


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return (
        df.groupBy(*[quoted(k) for k in keys])
        .agg(F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )


def known_value(name: str, allowed: Sequence, value: Column) -> Column:
    """``value``, or an error where column ``name`` holds something that is not allowed."""
    bad = quoted(name).isNotNull() & ~quoted(name).isin(list(allowed))
    return F.when(bad, F.raise_error(F.concat(F.lit(f"unknown {name}: "), quoted(name).cast("string")))).otherwise(value)


def check(name: str, df: DataFrame, observed: Column, expected) -> DataFrame:
    """One check row: an aggregate against the value it should have."""
    want = expected if isinstance(expected, Column) else F.lit(expected)
    return df.agg(
        observed.cast("long").alias("observed"), want.cast("long").alias("expected")
    ).select(
        F.lit(name).alias("check"),
        "observed",
        "expected",
        F.col("observed").eqNullSafe(F.col("expected")).alias("ok"),
    )


def checks(rows: Sequence[DataFrame]) -> DataFrame:
    return stack(rows)


def non_null_total(columns: Sequence[str]) -> Column:
    """Number of non-missing cells over several columns (conservation of a reshape)."""
    return reduce(lambda a, b: a + b, [F.count(quoted(c)) for c in columns])
