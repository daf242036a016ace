"""Suffix arrays by induced sorting, and permuted longest common prefixes, on numpy arrays."""

from __future__ import annotations

import numpy as np

#: induce bucket by bucket with array operations from this many symbols per bucket on
WIDE = 48


def suffix_array(text: np.ndarray, symbols: int) -> np.ndarray:
    """Sorted suffix starts of ``text`` (int64, values below ``symbols``), whose last symbol 0 occurs once.

    Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S
    suffixes of each run are sorted by inducing their substrings, naming them, and recursion on the
    names where these are not distinct; one more induction places all suffixes.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int64)
    step = np.sign(np.diff(text))
    turn = np.where(step != 0, np.arange(n - 1), n - 2)
    turn = np.minimum.accumulate(turn[::-1])[::-1]
    small = np.empty(n, dtype=bool)
    small[:-1] = step[turn] > 0
    small[-1] = True
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_wide if n >= WIDE * symbols else _induce_narrow
    order = induce(text, small, leftmost, symbols)
    if len(leftmost) > 1:
        is_leftmost = np.zeros(n, dtype=bool)
        is_leftmost[leftmost] = True
        by_substring = order[is_leftmost[order]]
        ends = np.empty(n, dtype=np.int64)
        ends[leftmost] = np.append(leftmost[1:], n - 1)
        names = np.cumsum(~_same_as_before(text, by_substring, ends))
        name_of = np.empty(n, dtype=np.int64)
        name_of[by_substring] = names
        if names[-1] + 1 < len(leftmost):
            by_substring = leftmost[suffix_array(name_of[leftmost], int(names[-1]) + 1)]
        order = induce(text, small, by_substring, symbols)
    return order


def _same_as_before(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each leftmost-S substring equals the one before it in ``starts``; the first does (name 0)."""
    a, b = starts[:-1], starts[1:]
    size = ends[b] - b
    same = size == ends[a] - a
    live = np.flatnonzero(same)
    at = 0
    while len(live):
        equal = text[a[live] + at] == text[b[live] + at]
        same[live[~equal]] = False
        live = live[equal]
        live = live[size[live] > at]
        at += 1
    return np.concatenate([[True], same])


def _bounds(text: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(np.bincount(text, minlength=symbols))
    return ends - np.bincount(text, minlength=symbols), ends


def _induce_wide(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """Both induction scans, a bucket's suffixes at a time: what they induce in their own bucket is the next wave."""
    heads, tails = _bounds(text, symbols)
    order = np.full(len(text), -1, dtype=np.int64)
    seeds = leftmost[np.argsort(text[leftmost], kind="stable")]
    seed_ends = np.cumsum(np.bincount(text[leftmost], minlength=symbols))
    seed_starts = seed_ends - np.bincount(text[leftmost], minlength=symbols)

    fill = heads.copy()

    def put_larger(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        symbol = text[before]
        by = np.argsort(symbol, kind="stable")
        symbol = symbol[by]
        counts = np.bincount(symbol, minlength=symbols)
        place = fill[symbol] + np.arange(len(symbol)) - (np.cumsum(counts) - counts)[symbol]
        order[place] = before[by]
        np.add(fill, counts, out=fill)

    for c in range(symbols):
        at = heads[c]
        while at < fill[c]:
            batch, at = order[at : fill[c]].copy(), fill[c]
            put_larger(batch)
        if seed_starts[c] < seed_ends[c]:
            put_larger(seeds[seed_starts[c] : seed_ends[c]])
    larger_end = fill
    fill = tails.copy()

    def put_smaller(batch: np.ndarray) -> None:
        before = batch[batch > 0] - 1
        before = before[small[before]]
        if not len(before):
            return
        symbol = text[before]
        by = np.argsort(symbol, kind="stable")
        symbol = symbol[by]
        counts = np.bincount(symbol, minlength=symbols)
        place = fill[symbol] - 1 - np.arange(len(symbol)) + (np.cumsum(counts) - counts)[symbol]
        order[place] = before[by]
        np.subtract(fill, counts, out=fill)

    for c in range(symbols - 1, -1, -1):
        at = tails[c]
        while at > fill[c]:
            batch, at = order[fill[c] : at][::-1].copy(), fill[c]
            put_smaller(batch)
        if heads[c] < larger_end[c]:
            put_smaller(order[heads[c] : larger_end[c]][::-1])
    order[0] = len(text) - 1
    return order


def _induce_narrow(text: np.ndarray, small: np.ndarray, leftmost: np.ndarray, symbols: int) -> np.ndarray:
    """Both induction scans, a suffix at a time, for texts of many distinct symbols."""
    heads, tails = _bounds(text, symbols)
    symbol, is_small = text.tolist(), small.tolist()
    order = [-1] * len(symbol)
    fill = tails.tolist()
    for i in leftmost.tolist()[::-1]:
        fill[symbol[i]] -= 1
        order[fill[symbol[i]]] = i
    fill = heads.tolist()
    for at in range(len(order)):
        i = order[at] - 1
        if i >= 0 and not is_small[i]:
            c = symbol[i]
            order[fill[c]] = i
            fill[c] += 1
    fill = tails.tolist()
    for at in range(len(order) - 1, -1, -1):
        i = order[at] - 1
        if i >= 0 and is_small[i]:
            c = symbol[i]
            fill[c] -= 1
            order[fill[c]] = i
    order[0] = len(symbol) - 1
    return np.array(order, dtype=np.int64)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, most: int, restarts: np.ndarray) -> np.ndarray:
    """For each text position, the common prefix with the suffix sorted before it.

    Only irreducible positions, whose left neighbours differ, and the ``restarts`` are compared, seven
    symbols at a time; the value falls by one per position in between. Comparisons stop at about
    ``most``: beyond that many symbols behind an irreducible position or restart values may be too
    small. Symbols are below 512; ``order`` sorts all suffixes.
    """
    n = len(text)
    before = np.empty(n, dtype=np.int64)
    before[order[0]] = -1
    before[order[1:]] = order[:-1]
    at = np.arange(n)
    irreducible = (before < 1) | (at < 1)
    inner = np.flatnonzero(~irreducible)
    irreducible[inner] = text[inner - 1] != text[before[inner] - 1]
    irreducible[restarts] = True
    starts = np.flatnonzero(irreducible)
    padded = np.concatenate([text, np.zeros(7, dtype=text.dtype)]).astype(np.uint64)
    words = np.zeros(n, dtype=np.uint64)
    for k in range(7):
        words |= padded[k : k + n] << np.uint64(9 * k)
    found = np.zeros(n, dtype=np.int64)
    live = starts[before[starts] >= 0]
    length = 0
    while len(live) and length < most:
        a, b = live + length, before[live] + length
        inside = (a < n) & (b < n)
        differ = np.ones(len(live), dtype=np.uint64)
        differ[inside] = words[a[inside]] ^ words[b[inside]]
        ended = differ != 0
        lowest = differ[ended] & (~differ[ended] + np.uint64(1))
        found[live[ended]] = length + np.log2(lowest.astype(np.float64)).astype(np.int64) // 9
        live = live[~ended]
        length += 7
    found[live] = length
    last = np.maximum.accumulate(np.where(irreducible, at, 0))
    return np.maximum(np.minimum(found[last], n - last) - (at - last), 0)
