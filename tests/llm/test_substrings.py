import random

import numpy as np
import pytest

from meshlake.llm import substrings
from meshlake.llm.suffixes import common_prefixes, suffix_array
from tests.llm.conftest import document_rows


def texts_of(seed):
    r = random.Random(seed)
    kinds = [
        bytes(r.choice(b"ab") for _ in range(r.randint(1, 60))),
        bytes(r.randrange(256) for _ in range(300)),
        b"a" * r.randint(1, 400) + b"b" + b"a" * r.randint(0, 400),
        b"the same words " * 40,
        b"mississippi",
        "größe 🙂 ".encode() * 9 + b"\0\0\0",
    ]
    return r.choice(kinds) + r.choice(kinds) + r.choice(kinds)


@pytest.mark.parametrize("wide", [1, 64, 10**9])
def test_suffix_arrays_equal_sorted_suffixes(monkeypatch, wide):
    monkeypatch.setattr("meshlake.llm.suffixes.WIDE", wide)  # either way of induction, at all depths
    for seed in range(40):
        x = texts_of(seed)
        t = np.append(np.frombuffer(x, np.uint8).astype(np.uint16) + 1, np.uint16(0))
        sa = suffix_array(t, 258)
        plain = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        assert sa.tolist() == plain
        before, shared = common_prefixes(t, sa)
        for a, b in zip(plain, plain[1:], strict=False):
            n = 0
            while t[a + n] == t[b + n]:
                n += 1
            assert (before[b], shared[b]) == (a, n)
        assert (before[plain[0]], shared[plain[0]]) == (-1, 0)


def plain(rows, width):
    """(doc_id, removed runs, remaining bytes) of every row."""
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for i, x in enumerate(texts):
        for p in range(len(x) - width + 1):
            seen.setdefault(x[p : p + width], []).append((i, p))
    gone = [np.zeros(len(x) + 1, bool) for x in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                gone[i][p : p + width] = True
    out = []
    for (doc_id, _), x, g in zip(rows, texts, gone, strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], g]).astype(int))).tolist()
        out.append((doc_id, tuple(zip(edges[::2], edges[1::2], strict=True)), bytes(np.frombuffer(x, np.uint8)[~g[:-1]])))
    return sorted(out, key=str)


def found(spark, rows, width):
    table = spark.createDataFrame([(i, t, 1, "y", b"z") for i, t in rows], "doc_id long, text string, start int, `a.b` string, kept binary").repartition(3)
    got = substrings.remove_repeats(table, width)
    assert got.columns == ["doc_id", "text", "start", "a.b", "spans", "kept"]
    return sorted(((r.doc_id, tuple((s.start, s.end) for s in r.spans), bytes(r.kept)) for r in got.collect()), key=str)


def copies(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["größe", "🙂"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage, rows = text(60), []
    for i in range(60):
        rows.append((i, text(r.randint(0, 80)) + r.choice(["", passage, passage[r.randint(0, 50) :]]) + text(r.randint(0, 60))))
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [rows[3], rows[3]]
    rows += [(200, None), (None, ""), (None, rows[5][1]), (3, text(50)), (201, "x" * 3000), (202, "ab" * 900), (203, text(9000))]
    return rows


@pytest.mark.parametrize("width", [12, 40, 200])
def test_every_covered_byte_goes(spark, width):
    rows = copies(width)
    assert found(spark, rows, width) == plain(rows, width)


@pytest.mark.parametrize(("block", "longest"), [(500, 1 << 16), (400_000, 30), (137, 7)])
def test_blocks_and_long_segments_lose_no_string(monkeypatch, block, longest):
    texts = [(t or "").encode() for _, t in copies(5)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])

    def strings():
        found = {}
        for document, start, n, key, _, _ in substrings.cut_segments(data, offsets, 40):
            assert n.max() <= substrings.LONGEST
            found |= {(d, a + j): k for d, a, m, k in zip(document.tolist(), start.tolist(), n.tolist(), key.tolist(), strict=True) for j in range(m)}
        return found

    whole = strings()
    assert len(whole) == sum(max(0, len(x) - 39) for x in texts)
    monkeypatch.setattr(substrings, "BLOCK", block)
    monkeypatch.setattr(substrings, "LONGEST", longest)
    assert strings() == whole


def test_heavy_keys_are_cut_without_loss(spark, monkeypatch):
    for name, value in (("HEAVY", 700), ("SHARD", 3000)):
        monkeypatch.setattr(substrings, name, value)
    rows = copies(1) + [(i, t) for i, t, *_ in document_rows()]
    assert found(spark, rows, 40) == plain(rows, 40)


def test_no_documents(spark, no_documents):
    assert substrings.remove_repeats(no_documents).collect() == []
