"""Bootstrap and splits with seeded integer hashes, so that reruns give the same rows."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cytoframe.operators.columns import quoted
from cytoframe.operators.joins import merge
from cytoframe.operators.ranks import group_quantiles, kth_smallest, sequential_index
from cytoframe.operators.stats import mean_interval, spearman
from cytoframe.session import broadcast_within, materialise


def hash_number(seed: int, *parts: Column) -> Column:
    """A 52-bit number from an md5 over the seed and the parts."""
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def bootstrap_weights(
    df: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    order_by: str,
    replicates: int,
    seed: int = 0,
) -> DataFrame:
    """Draws with replacement: (keys, replicate, values, ``__w__`` = times drawn).

    Every replicate of a group has exactly as many draws as the group has rows. The draws
    are made by the rows themselves: row i of replicate r names the row it takes, so no
    task ever holds a whole sample. ``order_by`` is a number unique within the group.
    """
    data = df.dropna("any", subset=list(keys)) if keys else df
    data = data.select(
        *[quoted(k) for k in keys],
        *[quoted(v) for v in values if v not in keys],
        quoted(order_by).alias("__o__"),
    )
    indexed = materialise(sequential_index(data, "__o__", "__i__", keys, start=0).drop("__o__"))
    sizes = indexed.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("__n__"))
    if keys:
        sized = merge(indexed, broadcast_within(sizes), keys, "inner")
    else:
        sized = indexed.withColumn("__n__", F.lit(sizes.first()["__n__"]))
    draws = sized.select(
        *[quoted(k) for k in keys],
        "__i__",
        "__n__",
        F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"),
    )
    taken = hash_number(seed, *[quoted(k) for k in keys], F.col("replicate"), F.col("__i__"))
    # dealt by the drawn row, the draws are counted and joined with it where they are
    weights = (
        draws.withColumn("__i__", taken % F.col("__n__"))
        .select(*[quoted(k) for k in keys], "replicate", "__i__")
        .repartition(*[quoted(k) for k in keys], "__i__")
        .groupBy(*[quoted(k) for k in keys], "replicate", "__i__")
        .agg(F.count("*").alias("__w__"))
    )
    return materialise(merge(weights, indexed, [*keys, "__i__"], "inner", nulls_match=False).drop("__i__"))


def _weighted(stat: str) -> Column | None:
    w, v = F.col("__w__"), F.col("__v__")
    mean = F.sum(w * v) / F.sum(w)
    square = F.sum(w * v * v) / F.sum(w)
    return {
        "mean": mean,
        "sum": F.sum(w * v),
        "std": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))),
        "min": F.min(v),
        "max": F.max(v),
    }.get(stat)


def bootstrap(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order_by: str,
    stat: str | Callable | Mergeable = "median",
    replicates: int = 1000,
    seed: int = 0,
    out: str = "stat",
) -> DataFrame:
    """One statistic per (keys, replicate).

    Named statistics (mean, sum, std, min, max, median, ``q<share>``) stay in the engine
    and take groups of any size, and so does a ``Mergeable``, whose parts are worked out where the rows are. A
    plain callable over a numpy array needs the whole sample in one worker, so it is for groups that fit one.
    """
    drawn = bootstrap_weights(
        df.where(quoted(value).isNotNull()), keys, [value], order_by, replicates, seed
    ).withColumnRenamed(value, "__v__")
    by = [*keys, "replicate"]
    by_cols = [quoted(k) for k in by]
    if isinstance(stat, Mergeable):
        return _mergeable_statistic(drawn, by, stat, out)
    if callable(stat):
        return _python_statistic(drawn, by, stat, out)
    aggregate = _weighted(stat)
    if aggregate is not None:
        return drawn.groupBy(*by_cols).agg(aggregate.alias(out))
    share = 0.5 if stat == "median" else float(stat[1:])
    return group_quantiles(drawn, by, "__v__", {out: share}, weight="__w__")


@dataclass(frozen=True)
class Mergeable:
    """A statistic in parts, so that no worker ever holds a sample.

    ``start()`` gives an empty state, ``add(state, values, times)`` takes numpy arrays of drawn values and how often each is
    drawn, ``merge(a, b)`` joins two states and ``finish(state)`` gives the number. States have to be picklable and small.
    """

    start: Callable
    add: Callable
    merge: Callable
    finish: Callable


HELD_STATES = 50_000


def _mergeable_statistic(drawn: DataFrame, by: list[str], stat: Mergeable, out: str) -> DataFrame:
    """States of each partition's rows, a row each, merged by group: only states are shuffled."""
    types = dict(drawn.dtypes)
    keys = ", ".join(f"`{k}` {types[k]}" for k in by)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def rows() -> pd.DataFrame:
            made = [(*key, pickle.dumps(state)) for key, state in held.items()]
            held.clear()
            return pd.DataFrame(made, columns=[*by, "__state__"])

        for batch in batches:
            for key, part in batch.groupby(by, sort=False, dropna=False):
                key = key if isinstance(key, tuple) else (key,)
                state = held[key] if key in held else stat.start()
                held[key] = stat.add(state, part["__v__"].to_numpy(), part["__w__"].to_numpy())
            if len(held) > HELD_STATES:
                yield rows()
        if held:
            yield rows()

    def finished(part: pd.DataFrame) -> pd.DataFrame:
        state = reduce(stat.merge, (pickle.loads(s) for s in part["__state__"]))
        return part.iloc[:1][by].assign(**{out: float(stat.finish(state))})

    states = drawn.select(*[quoted(k) for k in by], "__v__", "__w__").mapInPandas(partial, f"{keys}, __state__ binary")
    return states.groupBy(*[quoted(k) for k in by]).applyInPandas(finished, f"{keys}, `{out}` double")


def _python_statistic(drawn: DataFrame, by: list[str], stat: Callable, out: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = np.repeat(pdf["__v__"].to_numpy(), pdf["__w__"].to_numpy())
        row = pdf.iloc[:1][by].copy()
        row[out] = float(stat(sample))
        return row

    fields = {f.name: f.dataType.simpleString() for f in drawn.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in by) + f", `{out}` double"
    return drawn.groupBy(*[quoted(k) for k in by]).applyInPandas(run, schema)


def bootstrap_spearman(
    df: DataFrame,
    stratum: str,
    x: str,
    y: str,
    order_by: str,
    replicates: int = 10,
    seed: int = 0,
    extent: float = 0.95,
) -> DataFrame:
    """Mean and interval of the bootstrapped rank correlation per stratum."""
    pairs = df.dropna("any", subset=[x, y])
    drawn = bootstrap_weights(pairs, [stratum], [x, y], order_by, replicates, seed)
    rho = spearman(drawn, [stratum, "replicate"], x, y, "__w__")
    return mean_interval(rho, [stratum], "rho", extent)


def stratified_split(
    df: DataFrame,
    stratum: str,
    key: str,
    test_size: float = 0.25,
    seed: int = 0,
    out: str = "split",
) -> DataFrame:
    """Add ``split``: in each stratum the rounded share with the smallest hashes is 'test'.

    The cut-off hash is an order statistic found in parallel. Rows that share the cut-off's
    hash (a repeated key, or equal 52-bit hashes) are numbered by key, so the share is exact.
    """
    hashed = df.withColumn("__h__", hash_number(seed, quoted(key)))
    wanted = (
        df.groupBy(quoted(stratum))
        .agg(F.count("*").alias("__n__"))
        .select(quoted(stratum), F.rint(F.col("__n__") * F.lit(test_size)).cast("long").alias("__k__"))
    )
    cutoffs = kth_smallest(hashed, [stratum], "__h__", wanted, "__k__", "__cutoff__")
    joined = merge(hashed, broadcast_within(cutoffs), [stratum], "left")
    below = joined.where(F.col("__h__") < F.col("__cutoff__")).groupBy(quoted(stratum)).agg(F.count("*").alias("__b__"))
    missing = merge(wanted, broadcast_within(below), [stratum], "left").select(
        quoted(stratum), (F.col("__k__") - F.coalesce("__b__", F.lit(0))).alias("__m__")
    )
    joined = merge(joined, broadcast_within(missing), [stratum], "left")
    # only rows at the cut-off are numbered, others are groups of their own
    at_cutoff = F.coalesce(F.col("__h__") == F.col("__cutoff__"), F.lit(False))
    tied = Window.partitionBy(
        quoted(stratum), "__h__", F.when(~at_cutoff, F.xxhash64(quoted(key)))
    ).orderBy(quoted(key))
    nth = F.when(at_cutoff, F.row_number().over(tied))
    is_test = F.coalesce(F.col("__h__") < F.col("__cutoff__"), F.lit(False)) | F.coalesce(
        nth <= F.col("__m__"), F.lit(False)
    )
    return joined.withColumn(out, F.when(is_test, "test").otherwise("train")).select(
        *[quoted(c) for c in df.columns], quoted(out)
    )


def random_split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 0, out: str = "split"
) -> DataFrame:
    """Independent coin per row from the hash of its key: no shuffle."""
    coin = hash_number(seed, quoted(key)) / F.lit(float(2**52))
    return df.withColumn(out, F.when(coin < test_size, "test").otherwise("train"))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in the order of the hash of their key (a fixed random extract)."""
    return (
        df.withColumn("__h__", hash_number(seed, quoted(key)))
        .orderBy("__h__", quoted(key))
        .limit(n)
        .drop("__h__")
    )


def sample_keys(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct keys in hash order; join them back with ``semi`` to keep all their rows."""
    return sample_rows(df.select(quoted(key)).where(quoted(key).isNotNull()).distinct(), key, n, seed)
