"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than the next one; the leftmost S of each run starts a substring. These
substrings are sorted by one induction and named; if names repeat, the string of names is sorted the same way, recursively. A last
induction from the sorted starts gives the whole array. Where buckets are wide (bytes) an induction takes one bucket at a time as arrays:
all entries that a bucket gets from itself are runs of one symbol, known beforehand. Where they are narrow (names) it takes one entry at a time.
"""

from __future__ import annotations

import numpy as np

from meshlake.llm.textarrays import mix, span_hashes

#: Entries a bucket on average from which a bucket is taken at once.
WIDE = 64


def smaller(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next; the last, a symbol that is smaller than all others, is."""
    n = len(t)
    differs = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
    nearest = np.minimum.accumulate(differs[::-1])[::-1]
    return np.append((t[:-1] < t[1:])[nearest], True)


def _places(symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stable order of the entries by symbol, each one's place within its symbol, and how many each symbol has."""
    order = np.argsort(symbols, kind="stable")
    counts = np.bincount(symbols, minlength=n)
    sorted_ = symbols[order]
    return order, np.arange(len(order)) - (np.cumsum(counts) - counts)[sorted_], counts


def _runs(q: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The entries q, then those one before them, two before and so on, as far as the run of one symbol goes."""
    more = q - left[q]
    if not more.any():
        return q
    each = more + 1
    step = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    return (np.repeat(q, each) - step)[np.argsort(step, kind="stable")]


def _induce_wide(t: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n, k = len(t), len(counts)
    tail = np.cumsum(counts)
    head = tail - counts
    edge = np.ones(n, bool)
    edge[1:] = t[1:] != t[:-1]
    left = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    sa = np.zeros(n, np.int64)
    order, nth, m = _places(t[starts], k)
    low = tail - m
    given = starts[order]
    sa[low[t[given]] + nth] = given
    used = np.flatnonzero(counts)
    fill = head.copy()
    for c in used:  # larger suffixes, from the left
        own = _runs(sa[head[c] : fill[c]], left)
        sa[head[c] : head[c] + len(own)] = own
        fill[c] = head[c] + len(own)
        p = np.concatenate([own, sa[low[c] : tail[c]]]) - 1
        p = p[p >= 0]
        p = p[t[p] > c]
        order, nth, m = _places(t[p], k)
        p = p[order]
        sa[fill[t[p]] + nth] = p
        fill += m
    back = tail.copy()
    back[0] = 0
    sa[0] = n - 1
    for c in used[::-1]:  # smaller suffixes, from the right
        own = sa[back[c] : tail[c]][::-1]
        if c:
            own = _runs(own, left)
            back[c] = tail[c] - len(own)
            sa[back[c] : tail[c]] = own[::-1]
        p = np.concatenate([own, sa[head[c] : fill[c]][::-1]]) - 1
        p = p[p >= 0]
        p = p[t[p] < c]
        order, nth, m = _places(t[p], k)
        p = p[order]
        sa[back[t[p]] - 1 - nth] = p
        back -= m
    return sa


def _induce_narrow(t: np.ndarray, s: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    n = len(t)
    tails = np.cumsum(counts)
    head, back = (tails - counts).tolist(), tails.tolist()
    symbols, small = t.tolist(), s.tolist()
    sa = [-1] * n
    for j in reversed(starts.tolist()):
        c = symbols[j]
        back[c] -= 1
        sa[back[c]] = j
    for i in range(n):
        j = sa[i] - 1
        if j >= 0 and not small[j]:
            c = symbols[j]
            sa[head[c]] = j
            head[c] += 1
    back = tails.tolist()
    for i in range(n - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and small[j]:
            c = symbols[j]
            back[c] -= 1
            sa[back[c]] = j
    return np.array(sa, np.int64)


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Places of the suffixes of t in order; t holds 0..k-1 and ends with its only 0."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    s = smaller(t)
    starts = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    counts = np.bincount(t, minlength=k)

    def induced(starts: np.ndarray) -> np.ndarray:
        return _induce_wide(t, starts, counts) if n >= WIDE * k else _induce_narrow(t, s, starts, counts)

    sa = induced(starts)
    place = np.full(n, -1, np.int64)
    place[starts] = np.arange(len(starts))
    order = place[sa]
    order = order[order >= 0]  # of the substrings
    ends = np.append(starts[1:] + 1, n)
    hashes = span_hashes(mix(t.astype(np.uint64) + np.uint64(1)), starts, ends)[order]
    lengths = (ends - starts)[order]
    names = np.empty(len(starts), np.int64)
    names[order] = np.concatenate([[0], np.cumsum((hashes[1:] != hashes[:-1]) | (lengths[1:] != lengths[:-1]))])
    distinct = int(names.max()) + 1
    if distinct < len(starts):
        order = suffix_array(names, distinct)
    return induced(starts[order])


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in t the place of the next smaller suffix (-1 for the smallest), and the length of their common prefix.

    Where the symbols before both places agree the length is one less than that of the place before; the others are found by
    doubling steps over hashes of spans.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero((before < 1) | (t[np.arange(n) - 1] != t[before - 1]) | (np.arange(n) == 0))
    at = at[before[at] >= 0]
    other, length = before[at], np.zeros(len(at), np.int64)
    symbols = mix(t.astype(np.uint64) + np.uint64(1))
    step = 1 << max(0, n.bit_length() - 1)
    while step:
        fits = np.flatnonzero(np.maximum(at, other) + length + step <= n)
        if len(fits):
            a, b = at[fits] + length[fits], other[fits] + length[fits]
            both = span_hashes(symbols, np.concatenate([a, b]), np.concatenate([a, b]) + step)
            length[fits] += step * (both[: len(a)] == both[len(a) :])
        step >>= 1
    known = np.zeros(n, np.int64)
    known[at] = at + length
    start = np.zeros(n, bool)
    start[at] = True
    start[before < 0] = True
    last = np.maximum.accumulate(np.where(start, np.arange(n), 0))
    return before, np.maximum(known[last] - np.arange(n), 0)
