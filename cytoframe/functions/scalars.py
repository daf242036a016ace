"""Scalar formulas. Ratios with a zero denominator and unreadable text give null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(f"`{x}`")


def ratio(top, bottom) -> Column:
    return F.try_divide(_c(top).cast("double"), _c(bottom).cast("double"))


def recode(x, mapping: Mapping, default: Column | None = None) -> Column:
    """Value map; values not in it become null (or ``default``)."""
    expr = None
    for old, new in mapping.items():
        hit = _c(x) == F.lit(old)
        expr = F.when(hit, F.lit(new)) if expr is None else expr.when(hit, F.lit(new))
    if expr is None:
        return F.lit(None) if default is None else default
    return expr if default is None else expr.otherwise(default)


def clean_score(
    x,
    ints: Sequence[str] = ("0", "1", "2", "3"),
    missing: Sequence[str] = (" ", "b", "n", "N"),
    threes_to_twos: bool = True,
) -> Column:
    """Text annotation to integer; the ``missing`` marks and anything else become null."""
    text = _c(x)
    number = F.when(text.isin(list(ints)) & ~text.isin(list(missing)), text.try_cast("int"))
    return F.when(number == 3, F.lit(2)).otherwise(number) if threes_to_twos else number


def mean_or_null(*xs) -> Column:
    """Mean that is missing when any part is."""
    return reduce(lambda a, b: a + b, [_c(x).cast("double") for x in xs]) / F.lit(float(len(xs)))


def mean_of_present(*xs) -> Column:
    """Mean over the parts that are present; null when none is."""
    total = reduce(lambda a, b: a + b, [F.coalesce(_c(x).cast("double"), F.lit(0.0)) for x in xs])
    present = reduce(lambda a, b: a + b, [_c(x).isNotNull().cast("int") for x in xs])
    return F.try_divide(total, present.cast("double"))


# fixed values: rounded-up consensus score to group name
SCORE_GROUPS = {1: "1-2", 2: "1-2", 3: "3", 4: "4-5", 5: "4-5"}


def round_up(x) -> Column:
    return F.ceil(_c(x)).cast("int")


def grouped_score(x) -> Column:
    return recode(round_up(x), SCORE_GROUPS)


def clamp(x, low, high) -> Column:
    """Clip to [low, high]; a missing value stays missing."""
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(_c(x).isNotNull(), F.least(F.greatest(_c(x), low), high))


def rounded_score(x, low: int = 1, high: int = 5) -> Column:
    """Round half to even, then clamp to the score range."""
    return clamp(F.rint(_c(x)), float(low), float(high)).cast("int")


def area_units(x, pixel_size: float = 0.12) -> Column:
    return _c(x) * F.lit(pixel_size**2)


def length_units(x, pixel_size: float = 0.12) -> Column:
    return _c(x) * F.lit(pixel_size)


def density_units(x, pixel_size: float = 0.12) -> Column:
    return _c(x) / F.lit(pixel_size**2)


def enrichment(in_class: Sequence, cytoplasm, nucleus, area_shares: Sequence) -> Column:
    """Share of probe pixels in the classes minus the share of area the classes take."""
    add = lambda xs: reduce(lambda a, b: a + b, [_c(x).cast("double") for x in xs])
    return ratio(add(in_class), add([cytoplasm, nucleus])) - add(area_shares)


def relative_difference(a, b, a_scale, b_scale) -> Column:
    """(a' - b') / (a' + b') with each side divided by its own scale."""
    x, y = ratio(a, a_scale), ratio(b, b_scale)
    return F.try_divide(x - y, x + y)


def class_densities(seg: str, classes: Sequence[int]) -> dict[str, Column]:
    """Probe density inside each class and in all other classes together.

    A class without area has density 0. Column names follow ``<seg>_probe_px_class_<k>``
    and ``<seg>_area_px_class_<k>``.
    """
    probe = {k: _c(f"{seg}_probe_px_class_{k}") for k in classes}
    area = {k: _c(f"{seg}_area_px_class_{k}") for k in classes}
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    all_probe, all_area = add(list(probe.values())), add(list(area.values()))
    out = {}
    for k in classes:
        out[f"{seg}_density_class_{k}"] = F.when(area[k] == 0, F.lit(0.0)).otherwise(
            ratio(probe[k], area[k])
        )
        out[f"{seg}_probe_px_OUTSIDE_class_{k}"] = all_probe - probe[k]
        out[f"{seg}_area_px_OUTSIDE_class_{k}"] = all_area - area[k]
        out[f"{seg}_density_OUTSIDE_class_{k}"] = ratio(all_probe - probe[k], all_area - area[k])
    return out


def keep_both_positive(a, b) -> Column:
    return F.coalesce(_c(a) > 0, F.lit(False)) & F.coalesce(_c(b) > 0, F.lit(False))


def keep_unmarked(mark) -> Column:
    return _c(mark).isNull()


def keep_dense(total, area, cutoff: float = 1080.0) -> Column:
    return F.coalesce(ratio(total, area) >= F.lit(float(cutoff)), F.lit(False))


def first_max(values: Column) -> Column:
    """1-based position of the largest array element, the first one on ties."""
    return F.array_position(values, F.array_max(values))
