"""Order statistics that never gather a whole group in one task.

Equal values are pre-aggregated by (group, value) and dealt by a range exchange on (group, value), so a group with
a third of all rows lies in many tasks, in order. Of each partition only its first and last group can go on elsewhere:
their sums, two small rows a partition, give what lies before a partition and what a cut group holds in all. Counts below a
value are then running sums inside the partitions. No sketch, no cut points per group and no join.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.operators.columns import quoted
from cytoframe.operators.joins import merge
from cytoframe.session import broadcast_within, materialise


def _in_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows sorted over all partitions. Materialised, as every use has to see the same borders."""
    order = [quoted(c) for c in columns]
    return materialise(df.repartitionByRange(*order).sortWithinPartitions(*order))


def _changes(rows: pa.Table | pa.RecordBatch, by: Sequence[str]) -> np.ndarray:
    """Where a row has another group than the row before it; the first row counts as one."""
    new = np.zeros(rows.num_rows, dtype=bool)
    new[:1] = True
    for name in by:
        column = rows.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        if pa.types.is_nested(column.type):
            column = pa.array([repr(v) for v in column.to_pylist()])
        before, after = column.slice(0, max(len(column) - 1, 0)), column.slice(1)
        differs = pc.fill_null(pc.not_equal(before, after), False).to_numpy(zero_copy_only=False)
        differs = differs | (before.is_null().to_numpy(zero_copy_only=False) != after.is_null().to_numpy(zero_copy_only=False))
        if pa.types.is_floating(column.type):
            nan = [pc.fill_null(pc.is_nan(v), False).to_numpy(zero_copy_only=False) for v in (before, after)]
            differs = differs & ~(nan[0] & nan[1])
        new[1:] |= differs
    return new


class _Cut:
    """What the first and the last group of every partition have elsewhere."""

    def __init__(self, rows: Sequence[tuple]) -> None:
        """``rows``: (partition, group, amount, is the first, is the last), in order of the partitions."""
        self.before: dict[int, float] = {}
        self.first: dict[int, float] = {}
        self.last: dict[int, float] = {}
        runs: list[list[tuple]] = []
        for row in rows:
            # a group goes on only from the last place of a partition to the first of the next
            if runs and row[3] and runs[-1][-1][4] and runs[-1][-1][1] == row[1]:
                runs[-1].append(row)
            else:
                runs.append([row])
        for run in runs:
            total, seen = sum(r[2] for r in run), 0
            for part, _, amount, first, last in run:
                if first:
                    self.before[part], self.first[part] = seen, total
                if last:
                    self.last[part] = total
                seen += amount


def _edges(ranged: DataFrame, by: Sequence[str], amount: str | None) -> _Cut:
    """One small aggregate: at most two rows a partition reach the driver, whatever the number of rows."""
    by = list(by)
    types = dict(ranged.dtypes)
    whole = amount is None or types[amount] in ("int", "bigint")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None  # [key row, sum] of the first group, and of the latest one if it is another
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(_changes(batch, by))
            weight = np.ones(batch.num_rows, dtype=np.int64) if amount is None else batch.column(amount).to_numpy(zero_copy_only=False)
            sums = np.add.reduceat(weight, starts)
            keys, at, latest = batch.select(by), 0, last or first
            if latest and (not by or not _changes(pa.Table.from_batches([latest[0], keys.slice(0, 1)]), by)[1]):
                latest[1] += sums[0]
                at = 1
            if first is None:
                first, at = [keys.slice(0, 1), sums[0]], 1
            if at < len(starts):
                last = [keys.slice(int(starts[-1]), 1), sums[-1]]
        pid = TaskContext.get().partitionId()
        for key, total in filter(None, (first, last)):
            yield pa.RecordBatch.from_arrays(
                [*key.columns, pa.array([pid], pa.int32()), pa.array([key is first[0]]), pa.array([last is None or key is last[0]]),
                 pa.array([total.item()], pa.int64() if whole else pa.float64())],
                names=[*by, "__pid__", "__first__", "__last__", "__sum__"],
            )

    schema = "".join(f"`{k}` {types[k]}, " for k in by)
    schema += f"__pid__ int, __first__ boolean, __last__ boolean, __sum__ {'long' if whole else 'double'}"
    used = ranged.select(*[quoted(k) for k in by], F.lit(1).alias("__one__") if amount is None else quoted(amount))
    rows = used.mapInArrow(work, schema).collect()
    rows.sort(key=lambda r: (r["__pid__"], not r["__first__"]))
    return _Cut([(r["__pid__"], repr([r[k] for k in by]), r["__sum__"], r["__first__"], r["__last__"]) for r in rows])


def cumulative_counts(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> DataFrame:
    """One row per (group, distinct value): ``__n__`` rows (or weight) at the value,
    ``__below__`` strictly below it, ``__total__`` in the group. Null values are left out.
    """
    by = list(keys)
    amount = F.count("*") if weight is None else F.sum(quoted(weight))
    counts = df.where(quoted(value).isNotNull()).groupBy(*[quoted(k) for k in (*by, value)]).agg(amount.alias("__n__"))
    ranged = _in_ranges(counts, [*by, value])
    cut = _edges(ranged, by, "__n__")
    kind = dict(ranged.dtypes)["__n__"]

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one partition of the exchange: distinct values and their counts only
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        part = TaskContext.get().partitionId()
        starts = np.flatnonzero(_changes(rows, by))
        n = rows.column("__n__").to_numpy()
        upto = np.cumsum(n) - n
        size = np.diff(np.append(starts, len(n)))
        total = np.add.reduceat(n, starts)
        under = upto - np.repeat(upto[starts], size)
        under[: size[0]] += cut.before[part]
        total[0], total[-1] = (cut.first[part], cut.last[part]) if len(total) > 1 else (cut.first[part],) * 2
        rows = rows.append_column("__below__", pa.array(under)).append_column("__total__", pa.array(np.repeat(total, size)))
        yield from rows.to_batches()

    schema = ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes) + f", __below__ {kind}, __total__ {kind}"
    return ranged.mapInArrow(below, schema)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group; ``probs`` maps output name to share.

    For groups of unbounded size. Where a group is one cell or one image,
    ``functions.percentile`` inside the group's aggregate is the cheaper way.
    """
    counts = cumulative_counts(df, keys, value, weight)
    low, end = F.col("__below__"), F.col("__below__") + F.col("__n__")

    def at(rank):
        return F.max(F.when((low <= rank) & (rank < end), quoted(value)))

    aggregates = [F.max("__total__").alias("__total__")]
    for name, p in probs.items():
        place = (F.col("__total__") - 1) * F.lit(float(p))
        aggregates += [
            at(F.floor(place)).alias(f"__lo_{name}"),
            at(F.ceil(place)).alias(f"__hi_{name}"),
        ]
    found = counts.groupBy(*[quoted(k) for k in keys]).agg(*aggregates)
    out = {}
    for name, p in probs.items():
        place = (F.col("__total__") - 1) * F.lit(float(p))
        lo, hi = quoted(f"__lo_{name}"), quoted(f"__hi_{name}")
        out[name] = lo + (hi - lo) * (place - F.floor(place))
    return found.select(
        *[quoted(k) for k in keys], *[c.cast("double").alias(n) for n, c in out.items()]
    )


def average_ranks(
    df: DataFrame, keys: Sequence[str], value: str, rank: str, weight: str | None = None
) -> DataFrame:
    """(group, distinct value) with its 1-based rank, ties sharing the mean rank."""
    counts = cumulative_counts(df, keys, value, weight)
    return counts.select(
        *[quoted(k) for k in keys],
        quoted(value),
        (F.col("__below__") + (F.col("__n__") + 1) / 2).alias(rank),
    )


def kth_smallest(
    df: DataFrame, keys: Sequence[str], value: str, targets: DataFrame, k: str, out: str
) -> DataFrame:
    """The ``k``-th smallest value per group (1-based); ``targets`` holds (keys, k)."""
    counts = merge(cumulative_counts(df, keys, value), broadcast_within(targets), keys, "inner")
    hit = (F.col("__below__") < quoted(k)) & (
        quoted(k) <= F.col("__below__") + F.col("__n__")
    )
    return counts.where(hit).select(*[quoted(c) for c in keys], quoted(value).alias(out))


def sequential_index(
    df: DataFrame, order_by: str, name: str, keys: Sequence[str] = (), start: int = 1
) -> DataFrame:
    """Number rows within their group in the order of a column.

    Rows of equal order are told apart by a hash of all their columns, so each gets a number of
    its own, the same in every run; only rows that are equal in every column may change places.
    """
    by = list(keys)
    rows = df.withColumn("__tie__", F.xxhash64(*[quoted(c) for c in df.columns]))
    ranged = _in_ranges(rows, [*by, order_by, "__tie__"]).drop("__tie__")
    cut = _edges(ranged, by, None)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, cut.before.get(TaskContext.get().partitionId(), 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = _changes(batch, by)
            if last is not None and by:
                new[0] = _changes(pa.Table.from_batches([last, batch.select(by).slice(0, 1)]), by)[1]
            else:
                new[0] = False
            starts = np.union1d([0], np.flatnonzero(new))
            number = np.arange(batch.num_rows) - np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
            if not new[0]:
                number[: starts[1] if len(starts) > 1 else len(number)] += count
            last, count = batch.select(by).slice(batch.num_rows - 1, 1), int(number[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(number + start, pa.int64())], names=[*batch.schema.names, name]
            )

    schema = ", ".join(f"`{c}` {t}" for c, t in ranged.dtypes) + f", `{name}` long"
    return ranged.mapInArrow(numbered, schema)
