"""Order-preserving packing of documents into token sequences by dynamic programming.

The documents of a partition are laid end to end in the table's order. Sequences (windows of at
most ``limit`` tokens) may end at document or sentence ends, and at a higher price on a grid inside long
sentences. For cut points c_0 < ... < c_m with penalties p (none at a document's
end, some at a sentence's, more inside one) the cheapest layout up to c_j is

    f_j = p_j + window_cost + min over c_i >= c_j - limit of (f_i + padding of c_j - c_i tokens)

Padding is ``limit`` minus the length, so the minimum of f_i + c_i over the sliding range comes from
a monotone queue in constant time; lengths that are powers of two need no padding and are looked up
besides. Each partition is one pass without a shuffle, in stretches of bounded token number, so a
lost task is simply run again with the same result.

Defined cases: a null text is the empty text, which is the closing id alone; repeated rows are packed
once each; null ids stay null; a document of any length is cut as needed; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cytoframe.llm.common import arrow, table, whole
from cytoframe.llm.encoding import _byte_of_char, blocks, encode, vocabulary

STRETCH = 1_000_000


@lru_cache(maxsize=4)
def _sentence_marks(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Per id: whether its text ends a sentence, and whether it starts with white space."""
    byte, tokens = _byte_of_char(), vocabulary(path)
    size = max(tokens.values()) + 1
    ends, opens = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    for name, i in tokens.items():
        token = bytes(byte.get(c, 63) for c in name)
        ends[i] = token.rstrip(b"\"')]}").endswith((b".", b"!", b"?")) or b"\n" in token
        opens[i] = token[:1].isspace() or b"\n" in token
    return ends, opens


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, marks, costs: tuple[float, float], grid: int):
    """Ascending positions where a sequence may end, with their penalties; no gap exceeds twice ``grid``."""
    ends, opens = marks
    inner = np.flatnonzero(ends[ids[:-1]] & opens[ids[1:]]) + 1
    points = np.union1d(inner, doc_ends)
    gaps = np.diff(points, prepend=0)
    long = np.flatnonzero(gaps > 2 * grid)
    counts = (gaps[long] - 1) // grid
    nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + 1
    hard = np.repeat(points[long] - gaps[long], counts) + nth * grid
    every = np.union1d(points, hard)
    penalty = np.full(len(every), costs[0])
    penalty[np.searchsorted(every, hard)] = costs[1]
    penalty[np.searchsorted(every, doc_ends)] = 0.0
    return every, penalty


def choose_windows(points: np.ndarray, penalty: np.ndarray, limit: int, window_cost: float) -> np.ndarray:
    """Ends of the cheapest sequence of windows over the cut points."""
    position = np.concatenate([[0], points])
    sizes = 2 ** np.arange(limit.bit_length())
    sizes = sizes[sizes <= limit]
    wanted = position[:, None] - sizes
    at = np.clip(np.searchsorted(position, wanted), 0, len(position) - 1)
    row, column = np.nonzero((position[at] == wanted) & (wanted >= 0))
    exact = at[row, column].tolist()
    first = np.searchsorted(row, np.arange(len(position) + 1)).tolist()
    place, toll = position.tolist(), penalty.tolist()
    cost, back = [0.0] * len(place), [0] * len(place)
    queue: deque[int] = deque()
    keys: deque[float] = deque()
    for j in range(1, len(place)):
        here, key = place[j], cost[j - 1] + place[j - 1]
        while keys and keys[-1] >= key:
            keys.pop()
            queue.pop()
        keys.append(key)
        queue.append(j - 1)
        while place[queue[0]] < here - limit:
            queue.popleft()
            keys.popleft()
        best, source = keys[0] + limit - here, queue[0]
        for i in exact[first[j] : first[j + 1]]:
            if cost[i] < best:
                best, source = cost[i], i
        cost[j], back[j] = best + toll[j - 1] + window_cost, source
    ends = []
    j = len(place) - 1
    while j:
        ends.append(place[j])
        j = back[j]
    return np.array(ends[::-1], dtype=np.int64)


def _pieces(keys: list, ids: list[np.ndarray], first_window: int, marks, limit: int, costs, grid: int, window_cost: float):
    """Arrow columns of the pieces of one stretch, and how many windows it has."""
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    doc_ends = np.cumsum(sizes)
    flat = np.concatenate(ids)
    windows = choose_windows(*cut_points(flat, doc_ends, marks, costs, grid), limit, window_cost)
    ends = np.union1d(windows, doc_ends)
    starts = np.concatenate([[0], ends[:-1]])
    doc = np.searchsorted(doc_ends, starts, side="right")
    window = np.searchsorted(windows, starts, side="right")
    window_starts = np.concatenate([[0], windows[:-1]])
    data = flat.astype("<u4").tobytes()
    columns = [
        pa.array([keys[d] for d in doc]),
        pa.array(starts - (doc_ends - sizes)[doc]),
        pa.array(ends - starts),
        pa.array([data[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary()),
        pa.array(sizes[doc]),
        pa.array(first_window + window),
        pa.array(starts - window_starts[window]),
    ]
    return columns, len(windows)


def _packed(batches: Iterator[pa.RecordBatch], path: str, closing: int, limit: int, costs, grid, window_cost):
    marks = _sentence_marks(path)
    next_window = TaskContext.get().partitionId() << 32
    names = ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    keys, ids, held, kind = [], [], 0, None
    end = np.array([closing], dtype=np.uint32)

    def solve():
        nonlocal next_window, held
        columns, windows = _pieces(keys, ids, next_window, marks, limit, costs, grid, window_cost)
        columns[0] = columns[0].cast(kind)
        next_window += windows
        keys.clear()
        ids.clear()
        held = 0
        return pa.RecordBatch.from_arrays(columns, names)

    for batch in batches:
        kind = batch.column("key").type
        new_keys, texts = batch.column("key").to_pylist(), batch.column("text").to_pylist()
        for start, stop in blocks(texts, 500_000):
            for key, encoded in zip(new_keys[start:stop], encode(texts[start:stop], path)):
                keys.append(key)
                ids.append(np.concatenate([encoded, end]))
                held += len(encoded) + 1
            if held >= STRETCH:
                yield solve()
    if keys:
        yield solve()


def pack(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 1024,
    closing: int = 0,
    sentence_cost: float = 2.0,
    hard_cost: float = 16.0,
    window_cost: float = 32.0,
    grid: int = 32,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """One row per piece: ``key``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset`` in the sequence."""
    rows = docs.select(F.col(key).alias("key"), whole(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    costs, grid = (sentence_cost, hard_cost), min(grid, limit // 2)
    return arrow(
        rows,
        lambda batches: _packed(batches, tokenizer, closing, limit, costs, grid, window_cost),
        f"key {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint",
    ).withColumnRenamed("key", key)


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of 1024-token sequences, with the checksum of their ids."""
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of at most 1024 tokens."""
    return packed_documents(table(spark, sf_dir, "documents"))
