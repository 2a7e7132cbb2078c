import hashlib
import math
import random
import zlib

import pytest

from meshlake.llm import trie

COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain(rows, family=100, most=6):
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(conv, []).append((role or "", text or ""))
    members, ends = {}, {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % most
        path = (*own.get(c - int(math.fmod(c, family)), [])[:h], *own[c][h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out, total = {}, {}
    for p in sorted(members, key=len, reverse=True):
        kids = [k for k in total.get(p, ())]
        leaves = sum(out[k][5] for k in kids) if kids else 1
        saved = (len(members[p]) - 1) * len(p[-1][1] if p else "") + sum(out[k][6] for k in kids)
        parent = members[p[:-1]][0] if p else None
        out[p] = (members[p][0], len(p), parent, len(members[p]), len(kids), leaves, saved, hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest())
        if p:
            total.setdefault(p[:-1], []).append(p)
    return sorted(out.values(), key=str)


def check(spark, rows, **options):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, na string").repartition(3)
    got = trie.nodes(table, **options)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, **options)


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(r.randint(1, 7)):
            rows.append((c, t if r.random() < 0.95 else None, r.choice(["user", "assistant", None]), r.choice(["hello", "grüße 🙂", "", None, "why?", f"text {r.randint(0, 3)}"])))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_nodes_equal_plain_tries(spark, seed):
    rows = conversations(seed, 250)
    rows += rows[:20]  # repeated turns, ties
    rows += [(None, 0, "user", "nobody's"), (1001, 0, "user", "of a family that isn't there"), (-5, 0, "user", "hello"), (1002, 3, "user", "x" * 300_000)]
    check(spark, rows)


def test_long_conversations_and_nested_chains(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 3)  # conversations and chains over many blocks
    monkeypatch.setattr(trie, "LANE", 2)
    rows = [(0, t, "user", f"turn {t}") for t in range(60)]
    for c in range(1, 30):  # each a little longer than the one before: chains hang on chains
        rows += [(100 * c, t, "user", f"deep {t}") for t in range(c)]
    rows += [(5000 + 100 * c, t, "user", "same") for c in range(40) for t in range(4)]  # copies
    check(spark, rows)
    check(spark, rows, family=7, most=4)


def test_no_conversations(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.nodes(table).collect() == []
