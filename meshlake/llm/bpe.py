"""Byte-pair encoding of whole documents in numpy: vectorised pre-tokens, one encoding for each distinct one.

The merges of a pre-token are found with a segment tree over the ranks of its adjacent pairs: the root holds
the leftmost pair of the lowest rank, a merge changes three leaves and the nodes above them, and encoding ends
when the root holds no mergeable pair. Pre-tokens of like length go through their trees side by side.

Null texts count as empty; an empty text has no tokens. Special strings inside a text become their special
token, as the tokenizers library does by default. No text is cut, however long.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from meshlake.llm.textarrays import mix, span_hashes

#: Character classes.
OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Unicode's White_Space property (fixed values).
WHITE = [9, 10, 11, 12, 13, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
#: Endings that both patterns split off after an apostrophe (fixed values).
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
DOCUMENT_END = 0x110000
#: Distinct pre-tokens whose encoding a Python worker remembers.
MEMORY = 100_000
#: Pre-tokens of more symbols go through a tree of their own, in plain Python.
SIDE_BY_SIDE = 64
NONE = np.int32(1 << 30)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of every code point, and of the mark after a document."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    table[WHITE] = SPACE
    return np.append(table, np.uint8(END))


def byte_characters() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte: itself where printable, else 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class SegmentTrees:
    """Minimum trees over keys rank * width + position, one row for each pre-token of a group."""

    def __init__(self, keys: np.ndarray):
        rows, self.width = keys.shape
        self.nodes = np.empty((rows, 2 * self.width), np.int32)
        self.nodes[:, self.width :] = keys
        at = self.width
        while at > 1:
            half = at // 2
            np.minimum(self.nodes[:, at : 2 * at : 2], self.nodes[:, at + 1 : 2 * at : 2], out=self.nodes[:, half:at])
            at = half
        self.flat = self.nodes.reshape(-1)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        return self.flat[rows * (2 * self.width) + 1]

    def update(self, rows: np.ndarray, positions: np.ndarray, keys: np.ndarray) -> None:
        """Set leaves and renew the nodes above them, level by level."""
        base = rows * (2 * self.width)
        at = positions + self.width
        self.flat[base + at] = keys
        for _ in range(self.width.bit_length() - 1):
            at = at >> 1
            below = base + 2 * at
            self.flat[base + at] = np.minimum(self.flat[below], self.flat[below + 1])


class PairTable:
    """Open-addressed table from a pair of ids to the rank of its merge and the merged id."""

    BITS = 18
    EMPTY = np.uint32(0xFFFFFFFF)

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left * 65536 + right).astype(np.uint32)
        size = 1 << self.BITS
        self.keys = np.full(size, self.EMPTY, np.uint32)
        self.ranks = np.full(size, NONE, np.int32)
        self.merged = np.zeros(size, np.int32)
        for rank, (key, slot, to) in enumerate(zip(keys.tolist(), self.slots(keys).tolist(), merged.tolist(), strict=True)):
            while self.keys[slot] != self.EMPTY:
                slot = (slot + 1) % size
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, rank, to

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint32(2654435761)) >> np.uint32(32 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair; a slot without an entry has the rank NONE."""
        keys = (left * 65536 + right).astype(np.uint32)
        at = self.slots(keys)
        met = self.keys[at]
        rest = np.flatnonzero((met != keys) & (met != self.EMPTY))
        while rest.size:
            at[rest] = (at[rest] + 1) & ((1 << self.BITS) - 1)
            met = self.keys[at[rest]]
            rest = rest[(met != keys[rest]) & (met != self.EMPTY)]
        return at


class Bpe:
    """The vocabulary and rules of one tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.lower = bool(file.get("normalizer"))
        self.specials = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")")
        characters = byte_characters()
        self.first = np.array([vocab[c] for c in characters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in characters], np.int64)
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        left, right, merged = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.table = PairTable(left, right, merged)
        self.pairs = {k: (r, m) for r, (k, m) in enumerate(zip((left * 65536 + right).tolist(), merged.tolist(), strict=True))}
        self.known: dict[int, bytes] = {}
        back = {c: b for b, c in enumerate(characters)}
        self.pieces = [b""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for text, i in vocab.items():
            bare = text[: -len(self.suffix)] if self.suffix and text.endswith(self.suffix) else text
            self.pieces[i] = bytes(back[c] for c in bare)
        self.whole = {self.pieces[i]: i for text, i in vocab.items() if text.endswith(self.suffix)}
        for text, i in self.specials.items():
            self.pieces[i] = text.encode()
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.piece_starts = np.concatenate([[0], np.cumsum([len(p) for p in self.pieces])]).astype(np.int64)

    # --- merges

    def encode_group(self, raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pre-tokens, one in each row of ``raw`` (as many columns as a power of two): all ids, and how many each row has."""
        n, width = raw.shape
        step = width + 1  # a column past the end takes writes that mean nothing
        table = self.table
        ids = np.full((n, step), -1, np.int64)
        ids[:, :width] = self.first[raw]
        everyone = np.arange(n)
        ids[everyone, lengths - 1] = self.last[raw[everyone, lengths - 1]]
        place = np.arange(width)
        valid = place < (lengths - 1)[:, None]
        ids[:, :width][place >= lengths[:, None]] = -1
        keys = np.full((n, width), NONE, np.int32)
        r, c = np.nonzero(valid)
        rank = table.ranks[table.find(ids[r, c], ids[r, c + 1])]
        keys[r, c] = np.where(rank < NONE, rank * np.int32(width) + c.astype(np.int32), NONE)
        after = np.tile(np.minimum(np.arange(step) + 1, width), n)
        before = np.tile(np.arange(step) - 1, n)
        ids = ids.reshape(-1)
        trees = SegmentTrees(keys)
        rows = np.flatnonzero(trees.roots(everyone) < NONE)
        while rows.size:
            m = len(rows)
            base = rows * step
            at = (trees.roots(rows) & (width - 1)).astype(np.int64)
            gone = after[base + at]
            left = table.merged[table.find(ids[base + at], ids[base + gone])].astype(np.int64)
            ids[base + at] = left
            ids[base + gone] = -1
            then = after[base + gone]
            after[base + at] = then
            before[base + then] = at
            prior = before[base + at]
            # new pairs: the merged symbol with the next, and the one before with it
            a = np.concatenate([left, ids[base + np.maximum(prior, 0)]])
            b = np.concatenate([ids[base + then], left])
            ok = np.concatenate([then < width, prior >= 0]) & (a >= 0) & (b >= 0)
            rank = np.where(ok, table.ranks[table.find(a, b)], NONE)
            where = np.concatenate([at, prior])
            keys = np.full(3 * m, NONE, np.int32)
            keys[m:] = np.where(rank < NONE, rank * np.int32(width) + where.astype(np.int32), NONE)
            # without a symbol before, that write repeats the merged leaf's own
            none = np.flatnonzero(prior < 0)
            where[m + none], keys[2 * m + none] = at[none], keys[m + none]
            trees.update(np.concatenate([rows] * 3), np.concatenate([gone, where]), keys)
            rows = rows[trees.roots(rows) < NONE]
        kept = ids.reshape(n, step)[:, :width]
        live = kept >= 0
        return kept[live].astype("<u4"), live.sum(1)

    def encode_long(self, word: bytes) -> bytes:
        """Encode one long pre-token with a tree in Python lists."""
        ids = [int(self.first[b]) for b in word]
        ids[-1] = int(self.last[word[-1]])
        n, pairs, never = len(ids), self.pairs, 1 << 60
        none = (never, 0)
        size = 1 << (n - 1).bit_length()
        tree = [never] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = min(never, pairs.get(ids[i] * 65536 + ids[i + 1], none)[0] * size + i)
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n))

        def put(i: int) -> None:
            j = after[i]
            key = pairs.get(ids[i] * 65536 + ids[j], none)[0] * size + i if ids[i] >= 0 and j < n else never
            at = size + i
            tree[at] = min(never, key)
            while at > 1:
                at >>= 1
                tree[at] = min(tree[2 * at], tree[2 * at + 1])

        while tree[1] < never:
            i = tree[1] % size
            j = after[i]
            ids[i] = pairs[ids[i] * 65536 + ids[j]][1]
            ids[j] = -1
            after[i] = after[j]
            before[after[j]] = i
            put(j)
            put(i)
            if before[i] >= 0:
                put(before[i])
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    def encode_words(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The ids of the pre-tokens data[start : start + length], as little-endian unsigned 32-bit integers."""
        found: list[bytes] = [b""] * len(starts)
        widths = np.maximum(2, 1 << np.ceil(np.log2(np.maximum(lengths, 1))).astype(np.int64))
        data = np.append(data, np.zeros(SIDE_BY_SIDE, np.uint8))
        for width in np.unique(widths).tolist():
            members = np.flatnonzero(widths == width)
            if width > SIDE_BY_SIDE:
                for i in members.tolist():
                    found[i] = self.encode_long(data[starts[i] : starts[i] + lengths[i]].tobytes())
                continue
            for at in range(0, len(members), 8_000):
                part = members[at : at + 8_000]
                ids, counts = self.encode_group(data[starts[part][:, None] + np.arange(width)], lengths[part])
                flat, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
                begin = 0
                for i, end in zip(part.tolist(), ends, strict=True):
                    found[i] = flat[begin:end]
                    begin = end
        return found

    # --- pre-tokens

    def characters(self, texts: list[str]) -> np.ndarray:
        """Code points of all texts, each with a mark behind it; special strings are texts of their own here."""
        if self.lower:
            texts = [t if t.isascii() else unicodedata.normalize("NFC", t).replace("Σ", "σ") for t in texts]
            texts = [t.lower() for t in texts]
        parts = []
        mark = np.array([DOCUMENT_END], np.uint32)
        for t in texts:
            parts += (np.frombuffer(t.encode("utf-32-le"), np.uint32), mark)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def spans(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens in ``points``."""
        kind = classes()[points]
        n = len(points)
        change = np.ones(n, bool)
        change[1:] = kind[1:] != kind[:-1]
        change |= kind == END
        starts = change.copy()
        if self.lower:
            starts |= kind == NUMBER
        # an apostrophe alone between a pre-token and one of the endings
        lone = np.flatnonzero((points == 39) & change & np.append(change[1:], True))
        if not self.lower:
            lone = lone[(lone == 0) | (points[lone - 1] != 32)]
        padded = np.append(points, [DOCUMENT_END] * 2)
        for ending in CONTRACTIONS:
            hit = lone
            for i, c in enumerate(ending):
                hit = hit[padded[hit + 1 + i] == ord(c)] if i == 0 or hit.size else hit
            starts[hit + 1] = False
            beyond = hit + 1 + len(ending)
            beyond = beyond[beyond < n]
            starts[beyond] = True
        if not self.lower:
            # white space before ink: all but its last character are one pre-token; a last blank joins the ink
            last = np.flatnonzero((kind[:-1] == SPACE) & change[1:] & (kind[1:] != END))
            starts[last] = True
            blank = last[points[last] == 32]
            starts[blank + 1] = False
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], n)
        use = kind[at] != END
        if self.lower:
            use &= kind[at] != SPACE
        return at[use], ends[use]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and the number of ids of each text."""
        whole, index, inverse, token_text, parts_of, fixed = self.distinct(texts)
        ids, lengths = self.of_words(whole, index)
        counts = lengths[inverse]
        per_part = np.bincount(token_text, weights=counts, minlength=len(fixed)).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        flat = gather(ids, starts[inverse], counts)
        if (fixed >= 0).any():  # special strings
            per_part[fixed >= 0] = 1
            out = np.empty(int(per_part.sum()), np.uint32)
            special = np.repeat(fixed, per_part)
            out[special < 0] = flat
            out[special >= 0] = special[special >= 0]
            flat = out
        return flat, np.bincount(parts_of, weights=per_part, minlength=len(texts)).astype(np.int64)

    def distinct(self, texts: list[str]):
        """The distinct pre-tokens of a slice (as a getter of their bytes, and their hashes), which of them each pre-token is, the part of each pre-token, the text of each part, and the id of parts that are special strings (else -1)."""
        parts, parts_of, fixed = [], [], []
        for i, t in enumerate(texts):
            if "<|" in t:
                for p in self.split.split(t):
                    special = self.specials.get(p, -1)
                    parts.append("" if special >= 0 else p)
                    parts_of.append(i)
                    fixed.append(special)
            else:
                parts.append(t)
                parts_of.append(i)
                fixed.append(-1)
        points = self.characters(parts)
        starts, ends = self.spans(points)
        hashes = span_hashes(mix(points.astype(np.uint64) + np.uint64(7)), starts, ends)
        index, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        mark_at = np.flatnonzero(points == DOCUMENT_END)
        token_text = np.searchsorted(mark_at, starts)

        def whole(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            a, b = starts[first[which]], ends[first[which]]
            data, at = utf8(gather(points, a, b - a), b - a)
            return data, at[:-1], np.diff(at)

        return whole, index, inverse, token_text, np.array(parts_of, np.int64), np.array(fixed, np.int64)

    def of_words(self, whole, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the distinct pre-tokens one after another, and how many each has."""
        if len(self.known) > MEMORY:
            self.known.clear()
        known = self.known
        keys = index.tolist()
        found = list(map(known.get, keys))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            for i, ids in zip(missing, self.encode_words(*whole(np.array(missing))), strict=True):
                found[i] = known[keys[i]] = ids
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<u4"), lengths

    def alone(self) -> np.ndarray:
        """The shortcut of token counting: sorted hashes of the vocabulary's pre-tokens that are proven, by encoding each, to be one token alone."""
        if not hasattr(self, "_alone"):
            words = [w for w in self.whole if w]
            lengths = np.array([len(w) for w in words])
            proven = []
            for w, ids in zip(words, self.encode_words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths, lengths), strict=True):
                if len(ids) == 4:
                    try:
                        proven.append(w.decode())
                    except UnicodeDecodeError:
                        continue
            points = np.frombuffer("".join(proven).encode("utf-32-le"), np.uint32)
            ends = np.cumsum([len(w) for w in proven])
            starts = np.concatenate([[0], ends[:-1]])
            self._alone = np.sort(span_hashes(mix(points.astype(np.uint64) + np.uint64(7)), starts, ends))
        return self._alone

    def count_texts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text: proven pre-tokens count one without being merged."""
        whole, index, inverse, token_text, parts_of, fixed = self.distinct(texts)
        alone = self.alone()
        counts = np.ones(len(index), np.int64)
        at = np.minimum(np.searchsorted(alone, index), len(alone) - 1)
        rest = np.flatnonzero(alone[at] != index)
        if rest.size:
            _, counts[rest] = self.of_words(lambda which: whole(rest[which]), index[rest])
        per_part = np.bincount(token_text, weights=counts[inverse], minlength=len(fixed)).astype(np.int64)
        per_part[fixed >= 0] = 1
        return np.bincount(parts_of, weights=per_part, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, before invalid UTF-8 is replaced."""
        starts = self.piece_starts[ids]
        return gather(self.piece_bytes, starts, self.piece_starts[ids + np.uint32(1)] - starts).tobytes()


def gather(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start : start + count] of each span, one after another."""
    total = int(counts.sum())
    if not total:
        return values[:0]
    step = np.ones(total, np.int64)
    full = counts > 0
    starts, counts = starts[full], counts[full]
    step[0] = starts[0]
    step[np.cumsum(counts)[:-1]] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return values[np.cumsum(step)]


def utf8(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points as UTF-8 bytes, and where each span of so many code points begins in them (one more at the end)."""
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
    return data, at[np.concatenate([[0], np.cumsum(counts)])]


@lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """One vocabulary for each Python worker."""
    return Bpe(path)


def strings(column: pa.Array) -> list[str]:
    """A text column as Python strings; null counts as empty."""
    return [x or "" for x in column.to_pylist()]
