"""Joins with dataframe-merge semantics: missing keys match missing keys.

An outer merge is one full join, so chains of them scan every input once. Adaptive
execution cannot split a full join: where a key may be hot, ``merge`` stores the side
that holds it, joins that side by a left join (which can be split) and adds the other side's
rest by an anti join with the pre-aggregated distinct keys; the plan does not double either.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.operators.columns import quoted
from cytoframe.session import stored

_R = "__right__"


def shared_columns(left: DataFrame, right: DataFrame) -> list[str]:
    have = set(right.columns)
    return [c for c in left.columns if c in have]


def _right_keys_renamed(right: DataFrame, on: Sequence[str]) -> DataFrame:
    return right.withColumnsRenamed({k: _R + k for k in on})


def _condition(on: Sequence[str], nulls_match: bool) -> Column:
    def one(k):
        a, b = quoted(k), quoted(_R + k)
        return a.eqNullSafe(b) if nulls_match else a == b

    return reduce(lambda p, q: p & q, [one(k) for k in on])


def merge(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | None = None,
    how: str = "inner",
    nulls_match: bool = True,
    many: str | None = None,
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join on ``on`` (default: all shared columns), keys once, left columns first.

    ``how`` is inner, left or outer. ``many`` names the side (left or right) that may hold hot
    keys in an outer join. Other shared columns get ``suffixes``. With ``nulls_match`` the rows
    with missing keys of both sides meet, as in a dataframe merge: m and n of them give m x n
    rows, so a chain should not bring both sides' unmatched rows together again.
    """
    on = list(on) if on is not None else shared_columns(left, right)
    if not on:
        raise ValueError("no common columns to join on")
    clash = [c for c in shared_columns(left, right) if c not in on]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    order = left.columns + [c for c in right.columns if c not in on]
    if how in ("inner", "left"):
        joined = left.join(_right_keys_renamed(right, on), _condition(on, nulls_match), how)
        return joined.select([quoted(c) for c in order])
    if how != "outer":
        raise ValueError(f"unknown join type {how}")
    renamed = _right_keys_renamed(right, on)
    if many is None:
        joined = left.join(renamed, _condition(on, nulls_match), "full")
        keys = {k: F.coalesce(quoted(k), quoted(_R + k)) for k in on}
        return joined.select([keys[c].alias(c) if c in keys else quoted(c) for c in order])
    # the left side is the chain so far and is read twice: once it is computed, nothing doubles
    left = stored(left)
    keep, other = (left, right) if many == "left" else (stored(right), left)
    kept = keep.join(_right_keys_renamed(other, on), _condition(on, nulls_match), "left")
    # the union of two branches with one partitioning may not fit after adaptive re-planning
    rest = anti(other, keep, on, nulls_match).hint("rebalance")
    return (
        kept.select([quoted(c) for c in order])
        .unionByName(rest, allowMissingColumns=True)
        .select([quoted(c) for c in order])
    )


def semi(df: DataFrame, keys: DataFrame, on: Sequence[str], nulls_match: bool = False) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    right = _right_keys_renamed(keys.select([quoted(k) for k in on]).distinct(), on)
    return df.join(right, _condition(on, nulls_match), "left_semi")


def anti(df: DataFrame, keys: DataFrame, on: Sequence[str], nulls_match: bool = False) -> DataFrame:
    """Rows whose key does not occur in ``keys``."""
    right = _right_keys_renamed(keys.select([quoted(k) for k in on]).distinct(), on)
    return df.join(right, _condition(on, nulls_match), "left_anti")


def merge_renamed(
    left: DataFrame, right: DataFrame, pairs: Mapping[str, str], how: str = "inner"
) -> DataFrame:
    """Join columns of different names: ``pairs`` maps left name to right name."""
    return merge(
        left, right.withColumnsRenamed({r: l for l, r in pairs.items()}), list(pairs), how
    )


def outer_flag(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    flag: str,
    matched: bool = True,
) -> DataFrame:
    """Full join with the bare keys of ``right``; ``flag`` tells whether a row was in it.

    ``matched=False`` flips the flag (true = no partner in ``right``).
    """
    marked = right.select([quoted(k) for k in on]).withColumn(flag, F.lit(True))
    joined = merge(left.drop(flag), marked, on, "outer")
    return joined.withColumn(flag, quoted(flag).isNotNull() if matched else quoted(flag).isNull())


def membership(df: DataFrame, key: str, members: DataFrame | None, flag: str) -> DataFrame:
    """Flag rows whose key is in ``members``; without a list the flag is null."""
    if members is None:
        return df.withColumn(flag, F.lit(None).cast("boolean"))
    ids = members.select(quoted(key)).where(quoted(key).isNotNull()).distinct()
    marked = merge(df.drop(flag), ids.withColumn(flag, F.lit(True)), [key], "left", False)
    return marked.withColumn(flag, F.coalesce(quoted(flag), F.lit(False)))


def first_match(
    df: DataFrame, lookup: DataFrame, on: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Left join that takes only the first lookup row of each key, by ``order_by``.

    The lookup is reduced with a partial aggregate, so a key with many rows is never
    gathered in one task.
    """
    values = [c for c in lookup.columns if c not in on]
    rest = [c for c in values if c not in order_by]
    lead = F.struct(*[quoted(c) for c in list(order_by) + rest if c not in on])
    first = (
        lookup.groupBy(*[quoted(k) for k in on])
        .agg(F.min(lead).alias("__first__"))
        .select(
            *[quoted(k) for k in on],
            *[F.col("__first__").getField(c).alias(c) for c in values],
        )
    )
    return merge(df, first, on, "left", nulls_match=False)


def conservation(main: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: does an inner join with ``main`` keep every row of ``other``?"""
    n_main = main.agg(F.count("*").alias("main_rows"))
    merged = merge(main, other.select([quoted(k) for k in on]), on, "inner", False)
    counts = n_main.withColumn("merged_rows", F.lit(None).cast("long")).unionByName(
        merged.agg(F.count("*").alias("merged_rows")).withColumn(
            "main_rows", F.lit(None).cast("long")
        )
    )
    missing = anti(main, other, on).agg(F.count("*").alias("missing_rows"))
    counts = counts.withColumn("missing_rows", F.lit(None).cast("long")).unionByName(
        missing.withColumn("main_rows", F.lit(None).cast("long")).withColumn(
            "merged_rows", F.lit(None).cast("long")
        )
    )
    total = counts.agg(*[F.max(c).alias(c) for c in ("main_rows", "merged_rows", "missing_rows")])
    return total.withColumn(
        "conserved",
        (F.col("main_rows") == F.col("merged_rows")) & (F.col("missing_rows") == 0),
    )
