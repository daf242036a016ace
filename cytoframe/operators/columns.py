"""Projection and column shaping: prefixes, renames, ordering, casts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str):
    """Column by its literal name, dots and spaces included."""
    return F.col(f"`{name}`")


def dense(entries: str, start: Column, stop: Column, zero: Column) -> Column:
    """Values of the sorted (k, v) structs in ``entries`` laid out from ``start`` to before ``stop``.

    Positions without an entry get ``zero``. One pass over the entries and gaps.
    """
    column = quoted(entries)
    others = F.slice(column, F.lit(2), F.greatest(F.size(column) - 1, F.lit(0)))
    following = F.concat(F.transform(others, lambda e: e["k"]), F.array(stop))
    laid = F.zip_with(
        column, following,
        lambda e, after: F.concat(F.array(e["v"]), F.array_repeat(zero, after - e["k"] - 1)),
    )
    return F.concat(F.array_repeat(zero, F.get(column, F.lit(0))["k"] - start), F.flatten(laid))


def add_prefix(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(
        [quoted(c) if c in keep else quoted(c).alias(prefix + c) for c in df.columns]
    )


def rename_existing(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename by map; names the frame does not have are ignored."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def rename_substrings(df: DataFrame, parts: Mapping[str, str]) -> DataFrame:
    """Replace substrings in every column name, in the order of the map."""
    names = []
    for column in df.columns:
        for old, new in parts.items():
            column = column.replace(old, new)
        names.append(column)
    return df.toDF(*names)


def existing(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """The wanted names the frame has, in the order wanted."""
    have = set(df.columns)
    return [c for c in wanted if c in have]


def keep_existing(df: DataFrame, wanted: Iterable[str]) -> DataFrame:
    return df.select([quoted(c) for c in existing(df, wanted)])


def drop_existing(df: DataFrame, unwanted: Iterable[str]) -> DataFrame:
    return df.drop(*existing(df, unwanted))


def order_columns(df: DataFrame, first: Sequence[str], then: Sequence[str] = ()) -> DataFrame:
    """``first``, then ``then``, then all other columns as they were; absent names skipped."""
    lead = existing(df, list(first) + [c for c in then if c not in first])
    return df.select([quoted(c) for c in lead + [c for c in df.columns if c not in lead]])


def drop_containing(df: DataFrame, part: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if part in c])


def select_renamed(df: DataFrame, spec: Sequence[tuple[str, str]]) -> DataFrame:
    """Project ``(name, output name)`` pairs; everything else is dropped."""
    return df.select([quoted(old).alias(new) for old, new in spec])


def require_integers(df: DataFrame, columns: Sequence[str], to: str = "int") -> DataFrame:
    """Cast to integer; a missing value is an error, as it has no integer form."""
    return df.withColumns(
        {
            c: F.when(
                quoted(c).isNull(), F.raise_error(F.lit(f"missing value in {c}")).cast(to)
            ).otherwise(quoted(c).cast(to))
            for c in columns
        }
    )
