"""Wide to long and back, stacking of frames, column-set checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cytoframe.operators.columns import quoted


def _widened(pairs: Sequence[tuple[str, str]], name: str) -> Column:
    """Value of the last pair whose name column equals ``name``."""
    expr = None
    for id_col, value_col in reversed(pairs):
        hit = quoted(id_col) == F.lit(name)
        expr = F.when(hit, quoted(value_col)) if expr is None else expr.when(hit, quoted(value_col))
    return expr


def widen(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]],
    names: Sequence[str],
    suffix: str = "_count",
    fill: Column | None = None,
) -> DataFrame:
    """(name, value) column pairs to one column per name; the pair columns are dropped.

    When both pairs carry the same name the later pair wins.
    """
    used = [c for pair in pairs for c in pair]
    wide = {f"{n}{suffix}": _widened(pairs, n) for n in names}
    if fill is not None:
        wide = {c: F.coalesce(e, fill) for c, e in wide.items()}
    return df.select(
        *[quoted(c) for c in df.columns if c not in used],
        *[e.alias(c) for c, e in wide.items()],
    )


def distinct_names(df: DataFrame, columns: Sequence[str], most: int | None = None) -> list[str]:
    """Sorted distinct values over several columns, from rows where none is missing.

    They become column names; a caller may name how many it can take.
    """
    found = (
        df.select([quoted(c) for c in columns])
        .dropna("any")
        .select(F.explode(F.array(*[quoted(c) for c in columns])).alias("name"))
        .distinct()
    )
    names = (found if most is None else found.limit(most + 1)).collect()
    if most is not None and len(names) > most:
        raise ValueError(f"more than {most} distinct names cannot become columns")
    return sorted(r["name"] for r in names)


def widen_from_data(
    df: DataFrame, pairs: Sequence[tuple[str, str]], suffix: str = "_count"
) -> DataFrame:
    return widen(df, pairs, distinct_names(df, [p[0] for p in pairs]), suffix)


def tidy(
    df: DataFrame,
    value_columns: Sequence[str],
    name: str = "FISH_probe",
    value: str = "FISH_probe_count",
    strip: str = "_count",
) -> DataFrame:
    """One row per non-missing value column; ``strip`` is removed from the name."""
    ids = [quoted(c) for c in df.columns if c not in value_columns]
    long = df.unpivot(ids, [quoted(c) for c in value_columns], name, value)
    return long.where(quoted(value).isNotNull()).withColumn(
        name, F.replace(quoted(name), F.lit(strip), F.lit(""))
    )


def split_by_probe(
    df: DataFrame,
    features: Mapping[str, str | None],
    id_columns: Mapping[str, str],
    wavelengths: Sequence[str],
    out: str = "FISH_probe",
    batch: str = "batch",
) -> DataFrame:
    """Stack one copy of the cells per probe wavelength.

    ``features`` maps a feature to its wavelength (None = shared), ``id_columns`` a
    wavelength to the column naming its probe. In each copy the own features lose their
    ``<wavelength>_`` mark and only columns every copy has are kept.
    """
    others = [c for c in df.columns if c not in features and c not in id_columns.values()]
    copies = []
    for number, w in enumerate(wavelengths):
        own = {f: f.replace(f"{w}_", "") for f, fw in features.items() if fw in (None, w)}
        copies.append(
            df.select(
                *[quoted(c) for c in others],
                quoted(id_columns[w]).alias(out),
                *[quoted(f).alias(n) for f, n in own.items()],
                F.lit(str(number)).alias(batch),
            )
        )
    common = [c for c in copies[0].columns if all(c in d.columns for d in copies)]
    return stack([d.select([quoted(c) for c in common]) for d in copies])


def melt_all(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.unpivot([], [quoted(c) for c in df.columns], name, value)


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; a column a frame lacks is null there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def stack_like_first(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name that keeps only the columns of the first frame."""
    keep = first.columns
    trimmed = [o.select([quoted(c) for c in keep if c in o.columns]) for o in others]
    return stack([first, *trimmed]).select([quoted(c) for c in keep])


def unexpected_values(df: DataFrame, columns: Sequence[str], allowed: Sequence) -> DataFrame:
    """Distinct values over ``columns`` that are not among ``allowed`` (null is allowed)."""
    values = df.select(F.explode(F.array(*[quoted(c) for c in columns])).alias("value")).where(
        F.col("value").isNotNull()
    )
    return values.where(~F.col("value").isin(list(allowed))).distinct()
