"""Suffix arrays of a shard by induced sorting, and permuted common prefixes, on numpy arrays.

The steps are those of induced sorting. Suffixes are classified as smaller (S) or
larger (L) than the next one. The leftmost S of each run starts a *leftmost-smaller
substring*; one induction sorts these substrings, equal ones get equal names, and
the string of names is sorted recursively, each round comparing spans twice as
long of the names that are still equal. From the sorted leftmost-smaller
suffixes a last induction gives the whole array. An induction walks the buckets
of first bytes once from each side; inside a bucket all suffixes that stand ready
are moved together, so its cost is linear and Python runs per bucket, not per suffix.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 256


def classify(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the empty suffix is the smallest of all."""
    n = len(text)
    smaller = np.zeros(n, dtype=bool)
    if n > 1:
        ends = np.flatnonzero(text[:-1] != text[1:])  # the last places of the runs of equal symbols, but the last run
        rising = text[ends] < text[ends + 1]
        lengths = np.diff(np.concatenate([[-1], ends]))
        smaller[: ends[-1] + 1 if len(ends) else 0] = np.repeat(rising, lengths)
    return smaller


def _spread(found: np.ndarray, text: np.ndarray, later: list[list[np.ndarray]]) -> None:
    """Append suffixes to the buckets of their first symbols, in the order given."""
    symbol = text.take(found)
    order = np.argsort(symbol, kind="stable")
    found, symbol = found.take(order), symbol.take(order)
    cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(found)]
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b > a:
            later[symbol[a]].append(found[a:b])


def _bucket(parts: list[np.ndarray], text: np.ndarray, symbol: int) -> np.ndarray:
    """All suffixes of one type in a bucket: those put there from other buckets, then what these induce in the bucket itself, run by run."""
    out, wave = list(parts), np.concatenate(parts) if parts else np.zeros(0, np.int32)
    while len(wave):
        wave = wave[wave > 0] - np.int32(1)
        wave = wave[text.take(wave) == symbol]
        out.append(wave)
    return np.concatenate(out) if out else wave


def induce(text: np.ndarray, seeds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(L suffixes, S suffixes) of each bucket in order, from leftmost-smaller suffixes in ``seeds``' order."""
    larger: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    planted: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    _spread(seeds, text, planted)
    larger[text[-1]].append(np.array([len(text) - 1], np.int32))  # what the empty suffix induces
    ls, none = [], np.zeros(0, np.int32)
    for c in range(SYMBOLS):
        own = _bucket(larger[c], text, c)
        ls.append(own)
        source = np.concatenate([own, *planted[c]])
        if len(source):
            before = source[source > 0] - np.int32(1)
            _spread(before[text.take(before) > c], text, larger)
    out: list[tuple[np.ndarray, np.ndarray]] = [(none, none)] * SYMBOLS
    for c in reversed(range(SYMBOLS)):
        own = _bucket(smaller[c], text, c)  # from the right
        source = np.concatenate([own, ls[c][::-1]])
        if len(source):
            before = source[source > 0] - np.int32(1)
            _spread(before[text.take(before) < c], text, smaller)
        out[c] = (ls[c], own[::-1])
    return out


def _same(text: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` symbols at ``a`` and ``b`` are equal, pair by pair."""
    if not len(a):
        return np.zeros(0, dtype=bool)
    first = np.cumsum(size) - size
    step = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    return np.logical_and.reduceat(text.take(np.repeat(a, size) + step) == text.take(np.repeat(b, size) + step), first)


def sort_names(order: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names.

    ``order`` sorts them by their first name and ``fresh`` says where a new name begins
    in that order. Each round sorts what is still equal by the rank of what follows.
    """
    n = len(order)
    rank = np.empty(n + 1, dtype=np.int64)
    rank[n] = -1
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(fresh, place, 0))
    span = 1
    alone = fresh & np.append(fresh[1:], True)
    open_ = order[~alone]
    while len(open_):
        first, second = rank.take(open_), rank.take(np.minimum(open_ + span, n)) + 1
        by = np.argsort((first << np.int64(32)) | second, kind="stable")
        open_, first, second = open_.take(by), first.take(by), second.take(by)
        group = np.ones(len(open_), dtype=bool)
        group[1:] = first[1:] != first[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        at = np.arange(len(open_))
        start, own = np.maximum.accumulate(np.where(group, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank[open_] = first + own - start
        open_ = open_[~(new & np.append(new[1:], True))]
        span *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank[:n]] = place
    return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The suffixes of a byte array in ascending order."""
    if not len(text):
        return np.zeros(0, np.int32)
    smaller = classify(text)
    start = np.zeros(len(text), dtype=bool)
    start[1:] = smaller[1:] & ~smaller[:-1]
    seeds = np.flatnonzero(start).astype(np.int32)
    if len(seeds) > 1:
        rough = np.concatenate([s for _, s in induce(text, seeds)])
        rough = rough[start[rough]]  # sorted by leftmost-smaller substring
        index = np.empty(len(text), dtype=np.int32)
        index[seeds] = np.arange(len(seeds))
        order = index[rough].astype(np.int64)
        size = np.append(np.diff(seeds) + 1, 0)[order].astype(np.int64)  # the last one has no end: no other equals it
        fresh = np.ones(len(order), dtype=bool)
        like = np.flatnonzero((size[1:] == size[:-1]) & (size[1:] > 0)) + 1
        fresh[like] = ~_same(text, rough[like - 1].astype(np.int64), rough[like].astype(np.int64), size[like])
        seeds = seeds[sort_names(order, fresh)]
    return np.concatenate([part for pair in induce(text, seeds) for part in pair])


def words_at(text: np.ndarray, n: int) -> np.ndarray:
    """The eight bytes that begin at each of the first ``n`` places, as integers; zeros follow the text."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    return np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,))


def permuted_prefixes(text: np.ndarray, array: np.ndarray) -> np.ndarray:
    """For each place, the common prefix of its suffix with the one before it in the array, in text order.

    Where the symbols before both suffixes agree, the value is one less than that
    of the place before; only the other places are compared, eight bytes at a time.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, dtype=np.int64)
    before[array[1:]] = array[:-1]
    before[array[0]] = -1
    at = np.arange(n)
    prior = np.where((at > 0) & (before > 0), text[at - 1] == text.take(np.maximum(before, 1) - 1), False)
    heads = np.flatnonzero(~prior)
    length = np.zeros(len(heads), dtype=np.int64)
    words = np.ascontiguousarray(words_at(text, n + 1))  # the last is all zeros
    open_ = np.flatnonzero(before[heads] >= 0)
    a, b = heads[open_], before[heads[open_]]
    while len(open_):
        differ = words.take(a) ^ words.take(b)
        go = differ == 0
        same = np.full(len(differ), 8)
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        same[~go] = np.log2(low[~go].astype(np.float64)).astype(np.int64) >> 3
        length[open_] += same
        a, b, open_ = a[go] + 8, b[go] + 8, open_[go]
        inside = (a < n) & (b < n)
        a, b, open_ = a[inside], b[inside], open_[inside]
    head = np.zeros(n, dtype=np.int64)
    head[heads] = heads
    head = np.maximum.accumulate(head)
    value = np.zeros(n, dtype=np.int64)
    value[heads] = length
    found = value.take(head) - (at - head)
    return np.minimum(found, n - np.maximum(at, before))  # zeros beyond the end are no symbols
