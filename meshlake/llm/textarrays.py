"""Numpy work on whole Arrow text columns: slices of bounded size, word spans and 64-bit hashes of spans.

A span's hash is a polynomial modulo 2**64 over random values of its symbols, taken from prefix sums, then
mixed. Two different spans share a hash with a probability near 2**-64.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text that are held as arrays at once; a single longer document makes a slice of its own.
SLICE_BYTES = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: White space of the word rule: space and \t \n \v \f \r.
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", BASE), ("down", INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of symbols[start:end] for each span; symbols are any uint64 values."""
    up, _ = powers(len(symbols) + 1)
    sums = np.empty(len(symbols) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
    _, down = powers(len(symbols) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Texts:
    """Documents of one slice: their bytes one after another, and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        r"""Words [^\x20\x09-\x0D]+ with A-Z lower-cased: the lower-cased bytes, starts, ends, and the first word of each document (one more at the end)."""
        data = LOWER[self.data]
        n = len(data)
        ink = ~SPACES[data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.zeros(n, bool)
        before[1:] = ink[:-1]
        starts = np.flatnonzero(ink & (~before | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = ink[1:]
        ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
        return data, starts, ends, np.searchsorted(starts, self.offsets)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word, and the first word of each document (one more at the end)."""
        data, starts, ends, first = self.words()
        return span_hashes(_symbols()[data], starts, ends), first


def as_texts(column: pa.Array) -> Texts:
    """A text column as bytes and offsets; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return Texts(raw[offsets[0] : offsets[-1]], offsets - offsets[0])


def give_back() -> None:
    """Return memory that the allocators hold but nobody uses, for idle workers of earlier stages share an executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``size`` bytes of text, or one document."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths)
        at = 0
        while at < batch.num_rows:
            done = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, done + size, "right")))
            yield batch.slice(at, to - at)
            at = to
        del batch
        give_back()
