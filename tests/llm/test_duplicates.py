import contextlib
import math
import os
import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from meshlake.llm import components, hnsw, kmeans_tree, minhash, spans
from tests.llm.conftest import prose


def roots(nodes, pairs):
    parent = {i: i for i in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 540)]
    found = {x.node: x.component for x in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert found == {i: want[i] for a, b in pairs if a != b for i in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_minhash_equals_brute_force(spark):
    r = random.Random(2)
    rows = [(i, prose(i, "en", 60)) for i in range(40)]
    for i in range(40, 100):  # near copies at many degrees
        words = rows[r.randrange(12)][1].split()
        for _ in range(r.randrange(4)):
            words[r.randrange(len(words))] = f"w{r.random()}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, rows[3][1].upper()) for i in range(50)] + [(300, None), (301, ""), (302, "one two"), (303, "One  two"), (304, "two one"), (305, " \n"), (3, rows[3][1]), (None, rows[3][1])]
    texts = {i: t for i, t in rows if i is not None}
    sets = {i: shingles(t) for i, t in texts.items()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, pairs)
    found = minhash.near_duplicates(spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, component string").repartition(3)).collect()
    assert len(found) == len(rows)
    for x in found:
        if x.doc_id is None:
            assert x.component_id is None and x.kept
        else:
            assert (x.n_shingles, x.component_id, x.kept) == (len(sets[x.doc_id]), want[x.doc_id], want[x.doc_id] == x.doc_id)
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_finds_all_links_of_a_bucket(spark, monkeypatch):
    """Documents of shared lines, all in one bucket, mostly under the limit alike."""
    r = random.Random(4)
    monkeypatch.setattr(minhash, "TASK_PAIRS", 50)
    monkeypatch.setattr(minhash, "bands", lambda signature: np.ones((len(signature), 2), np.uint64) * np.arange(1, 3, dtype=np.uint64))
    lines = [" ".join(f"w{r.randrange(500)}" for _ in range(14)) for _ in range(30)]
    rows = [(i, " ".join(r.sample(lines, 4)) + f" own{i}") for i in range(80)]
    rows += [(100 + i, rows[i][1] + " tail one") for i in range(0, 80, 9)] + [(200 + i, rows[5][1] + f" end{i}") for i in range(30)]
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, pairs)
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {x.doc_id: x.component_id for x in found} == want
    assert len(set(want.values())) < len(rows) - 30


def test_minhash_on_a_template(spark):
    """300 documents of one template, 0.74 alike with each other; 150 pairs among them are over the limit."""
    template = [f"t{i}" for i in range(170)]
    rows = []
    for i in range(300):
        own = [f"p{i // 2}x{k}" for k in range(4)] + [f"o{i}x{k}" for k in range(25)]
        rows.append((i, " ".join(template + own)))
    sets = {i: shingles(t) for i, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.73 < alike(0, 2) < 0.75 <= alike(0, 1) < 0.78
    found = {x.doc_id: x.component_id for x in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == {i: i - i % 2 for i in range(300)}


def test_parity_maps_never_differ_more_than_the_sets():
    r = np.random.default_rng(6)
    sets = [np.unique(r.integers(0, 4000, size, np.uint64)) for size in (0, 1, 5, 80, 80, 900, 900, 3000)]
    sets += [np.union1d(s[: len(s) * 9 // 10], r.integers(0, 1 << 40, 3).astype(np.uint64)) for s in sets]
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    maps = minhash.parity_maps(np.concatenate(sets), offsets)
    assert maps.shape == (len(sets), minhash.MAP)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            differ = sum(int(x).bit_count() for x in (maps[i] ^ maps[j]).view(np.uint64))
            assert differ <= len(np.setxor1d(a, b)) and (differ > 0 or i == j or len(np.setxor1d(a, b)) % 2 == 0)


def test_minhash_takes_rows_and_not_ids(spark):
    """An id with two texts, repeated rows, nulls, and columns with awkward names."""
    p, other = prose(1, "en", 60), prose(2, "de", 60)
    rows = [(1, p), (2, p), (2, other), (2, other), (3, other + " end"), (None, p), (4, None), (5, ""), (5, "")]
    docs = spark.createDataFrame([(*x, 1, 2, "z") for x in rows], "doc_id long, text string, `a.b` int, Text int, NODE string").repartition(2)
    found = sorted((x.doc_id or 0, x.n_shingles, x.component_id, x.kept) for x in minhash.near_duplicates(docs).collect() if x.n_shingles)
    n = len(shingles(other))
    assert [x for x in found if x[0] == 2] == sorted([(2, len(shingles(p)), 1, False), (2, n, 2, True), (2, n, 2, True)])
    assert (3, n + 1, 2, False) in found
    left = minhash.deduplicated(docs)
    assert left.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in left.collect()) == sorted([(1, p), (2, other), (0, p), (4, ""), (5, "")])
    assert minhash.deduplicated(docs.limit(0)).count() == 0


def test_small_sets_get_whole_signatures():
    values = np.array([5, 1 << 63], np.uint64)
    signature = minhash.signatures(values, np.array([0, 1, 2, 2]))
    assert (signature[0] == 5).all() and (signature[1] == values[1]).all()


def brute_spans(rows, run):
    """The rule in plain Python for rows (doc_id, text) in order: sentences as lists of words, spans, and what later occurrences cover."""
    out, seen = [], {}
    for i, text in rows:
        words = list(re.finditer(r"[^\x20\x09-\x0D]+", text or ""))
        sentence, current, gone = [], [], set()
        for k, m in enumerate(words):
            current.append(m)
            if m[0][-1] in ".!?" or k + 1 == len(words) or "\n" in text[m.end() : words[k + 1].start()]:
                sentence.append(current)
                current = []
        for s in range(len(sentence)):
            e = min(s + run, len(sentence))
            if e - s == run or s == 0:
                key = tuple(re.sub("[A-Z]", lambda c: c[0].lower(), m[0]) for part in sentence[s:e] for m in part)
                if seen.setdefault(key, (i, text, s)) != (i, text, s):
                    gone |= set(range(s, e))
        starts = [s[0].start() for s in sentence] + [len(text or "")]
        left = text if not gone else text[: starts[0]] + "".join(text[starts[k] : starts[k + 1]] for k in range(len(sentence)) if k not in gone)
        out.append((i, len(sentence), len(gone), left))
    return out


def by_id(rows):
    return sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], x[-1] or ""))


def test_spans_equal_brute_force(spark):
    passage = "Alpha beta gamma delta. Epsilon zeta eta! Theta iota kappa lambda mu.\nNu xi omicron pi rho sigma? "
    r = random.Random(5)
    rows = {i: prose(i, "en", 40) for i in range(30)}
    for i in range(30, 50):
        a, b = prose(i, "de", 20), prose(i + 900, "en", 25)
        rows[i] = a + " " + (passage if r.random() < 0.7 else passage.lower()) + b
    rows |= {60: None, 61: "", 62: passage * 3, 63: rows[3], 64: rows[3], 65: " \n ", 66: "no stop at all " * 2000, 67: "Few words.", 68: "few  WORDS.", 69: "Few words. More"}
    rows |= {70 + i: passage[:45] for i in range(3)}
    want = brute_spans(sorted(rows.items()), 3)
    table = [*rows.items(), (64, rows[64])]  # a repeated row
    docs = spark.createDataFrame([(i, t, 7, "z", 1) for i, t in table] + [(None, passage, 7, "z", 1)], "doc_id long, text string, n_removed int, cuts string, `a.b` int").repartition(3)
    cleaned = spans.remove_repeats(docs)
    assert cleaned.columns == ["doc_id", "text", "cuts", "a.b", "n_sentences", "n_removed"]
    found = by_id((x.doc_id, x.n_sentences, x.n_removed, x.text) for x in cleaned.collect())
    assert found == by_id([*want, next(x for x in want if x[0] == 64), (None, 4, 0, passage)])
    assert {x[0]: x[1:3] for x in want}[64] == ({x[0]: x[1] for x in want}[64],) * 2
    assert spans.remove_repeats(docs.limit(0)).count() == 0


def test_spans_take_rows_and_not_ids(spark):
    p, other = prose(1, "en", 200), prose(2, "de", 200)
    rows = [(1, p), (2, p + " " + prose(3, "en", 100)), (2, other), (2, other), (3, other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = by_id((x.doc_id, x.n_removed > 0, x.text) for x in spans.remove_repeats(docs).collect())
    assert [x for x in found if x[0] == 1] == [(1, False, p)]
    assert [x for x in found if x[0] == 2 and not x[1]] == [(2, False, other)] * 2
    assert [x[2] for x in found if x[0] == 3] == [""] and sum(x[1] for x in found) == 2


def vectors(n, seed, dims=16):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dims))
    x[n // 2 : 3 * n // 4] = x[0] + 0.08 * r.standard_normal((3 * n // 4 - n // 2, dims))  # a third near one vector
    x[3 * n // 4 : 4 * n // 5] = x[1] + 0.22 * r.standard_normal((4 * n // 5 - 3 * n // 4, dims))
    x[-20:] = x[5]
    return x


BAD = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] * 16, 1), (9004, [None] * 16, 1), (9005, [float("inf")] + [1.0] * 15, 1), (9006, [1.0, 2.0], 1), (9007, [1.0] * 16, None)]


def test_hnsw_equals_brute_force(spark):
    x = vectors(400, 3)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + BAD + [(5, x[5].tolist(), 2)]
    found = hnsw.near_duplicates(spark.createDataFrame([(*r, "n", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, n string, `a.b` int, Label int").repartition(3), 0.93, shard=60).collect()
    assert len(found) == len(rows)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    ids, label = np.append(np.arange(400), 5), np.append(np.arange(400) % 3, 2)
    unit = np.vstack([unit, unit[5]])
    linked = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    want = roots(range(400), [(int(ids[a]), int(ids[b])) for a, b in zip(*np.nonzero(linked), strict=True)])
    degree = {(int(i), int(n) - 1) for i, n in zip(ids, linked.sum(1), strict=True)}
    for r in found:
        if r.vec_id > 9000:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert (r.vec_id, r.n_links) in degree and r.component_id == want[r.vec_id] and r.kept == (r.component_id == r.vec_id)
    assert hnsw.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_graph_search_finds_neighbours():
    x = np.random.default_rng(1).standard_normal((1500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, leaders, of, cosine = hnsw.grow(x, math.cos(0.1), 48, 1)
    assert len(leaders) == 1500 and (of == np.arange(1500)).all() and (cosine == 1).all()
    ids, near = graph.search(x[:200], 96)
    exact = np.sort(x[:200] @ x.T, 1)[:, -10:]
    assert (near[:, :10] >= exact[:, :1] - 1e-12).mean() > 0.9


def test_tree_search(spark):
    x = vectors(900, 8)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [r[:2] for r in BAD[:6]]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = kmeans_tree.nearest(data, data.where("vec_id % 20 = 0"), k=10, leaf_rows=40, block=30).where("query_id < 9000").collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 900, 20):
        score = x @ x[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(900), -score))[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(s - score[v]) < 1e-9 for _, v, s in mine)
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hits += len({m[1] for m in mine} & set(want.tolist()))
    assert hits >= 0.9 * 10 * 45
    few = data.where("vec_id < 3")
    assert kmeans_tree.nearest(few, few.where("vec_id = 0"), k=20).count() == 2
    assert kmeans_tree.nearest(few.limit(0), few.limit(0)).count() == 0


def test_tree_takes_lengths_and_repeats(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.standard_normal(8).tolist()) for i in range(60)] + [(i, r.standard_normal(5).tolist()) for i in range(60, 90)]
    rows += [rows[3], (20, r.standard_normal(8).tolist()), (None, rows[0][1])]
    data = spark.createDataFrame([(*x, 1, "q") for x in rows], "vec_id long, embedding array<double>, `a.b` int, Vec_Id string")
    found = kmeans_tree.nearest(data, data.where("`a.b` = 1"), k=4).collect()
    got = {}
    for x in found:
        got.setdefault(x.query_id, []).append((x["rank"], x.vec_id, round(x.score, 9)))
    vectors_of = {}
    for i, v in rows:
        if i is not None:
            vectors_of.setdefault(i, []).append(np.array(v))
    for q, of in vectors_of.items():
        score = {i: max(float(a @ b) for a in of for b in v if len(a) == len(b)) for i, v in vectors_of.items() if i != q and len(v[0]) == len(of[0])}
        want = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert sorted(got[q]) == [(k + 1, i, round(s, 9)) for k, (i, s) in enumerate(want)], q


def test_tree_visits_little_of_clustered_data():
    r = np.random.default_rng(4)
    centres = 4 * r.standard_normal((60, 24))
    x = np.concatenate([c + r.standard_normal((80, 24)) for c in centres])
    tree = kmeans_tree.fit(x, 8, 1.0, 100)
    leaf, visits = tree.put(x), 4
    seen = tree.visits(x[::48], visits)
    score = x[::48] @ x.T
    score[np.arange(len(score)), np.arange(0, len(x), 48)] = -np.inf
    top = np.argsort(-score, 1)[:, :20]
    recall = (leaf[top][:, :, None] == seen[:, None, :]).any(2).mean()
    share = np.isin(leaf, seen[0]).mean()
    assert recall >= 0.9 and np.mean([np.isin(leaf, row).mean() for row in seen]) < 0.2, (recall, share)


def python_memory(what, restart=False):
    """The largest figure (MB) of that name in /proc among the Python processes that this session's JVM has started."""
    parents = {}
    for stat in Path("/proc").glob("[0-9]*/stat"):
        with contextlib.suppress(OSError):
            parents[int(stat.parent.name)] = int(stat.read_text().rpartition(")")[2].split()[1])
    most = 0
    for pid in parents:
        above = pid
        while above in parents and above != os.getpid():
            above = parents[above]
        with contextlib.suppress(OSError):
            if above == os.getpid() != pid and "pyspark" in Path(f"/proc/{pid}/cmdline").read_text() and "java" not in os.readlink(f"/proc/{pid}/exe"):
                most = max([most, *(int(line.split()[1]) / 1000 for line in Path(f"/proc/{pid}/status").read_text().splitlines() if line.startswith(what))])
                if restart:
                    Path(f"/proc/{pid}/clear_refs").write_text("5")
    return most


def test_tree_search_needs_little_memory(spark):
    """A query's vector isn't copied for each of the leaves that it visits."""
    x = np.random.default_rng(6).standard_normal((3000, 256)).astype(np.float32)
    data = spark.createDataFrame(pa.table({"vec_id": np.arange(3000), "embedding": pa.array(list(x))}))
    data.mapInArrow(lambda batches: batches, data.schema).count()  # starts workers
    before = python_memory("VmRSS", restart=True)
    found = kmeans_tree.nearest(data, data.where("vec_id % 2 = 0"), k=5, leaf_rows=8).collect()
    used = python_memory("VmHWM") - before
    assert before > 0 and len(found) == 1500 * 5 and used < 150, used


def test_tree_takes_many_copies(spark):
    """Rows whose places the smaller vec_ids of equal vectors take, in leaves cut into several shards; few and huge components."""
    r = np.random.default_rng(7)
    x = np.concatenate([np.repeat(r.standard_normal((2, 6)), 300, 0), r.standard_normal((200, 6)), 1e200 * r.standard_normal((3, 6)), 1e-200 * r.standard_normal((3, 6))])[r.permutation(806)]
    data = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    found = kmeans_tree.nearest(data, data.where("vec_id % 7 = 0"), k=9, leaf_rows=50, recall=1.1, block=100).collect()
    got = {}
    for row in found:
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id))
    for q in range(0, 806, 7):
        with np.errstate(over="ignore"):
            score = (x * x[q]).sum(1)
        score[~np.isfinite(score)] = -np.inf
        score[q] = -np.inf
        assert [i for _, i in sorted(got[q])] == np.lexsort((np.arange(806), -score))[:9].tolist(), q


def test_tree_walk_by_gates():
    """The leaves found for many queries at once are those of the walks one by one, nodes with equal values too."""
    r = np.random.default_rng(8)
    x = r.standard_normal((900, 10))
    for rows in (x, np.round(x), np.repeat(x[:5], 40, 0), x[:1]):
        tree = kmeans_tree.fit(rows, 4, 1.0, 20)
        asked = np.concatenate([rows[:60], np.zeros((1, 10)), np.eye(10)])
        for most in (1, 2, 7, tree.leaves // 2 + 1, tree.leaves, tree.leaves + 3):
            want = [set(row[row >= 0].tolist()) for row in tree.visits(asked, most)]
            assert [set(np.flatnonzero(row).tolist()) for row in tree.first(asked, most)] == want


def test_passages_go_word_by_word(spark):
    words = [f"P{i}" for i in range(70)]
    passage, other = " ".join(words), prose(7, "en", 40)
    rows = [(1, "Begin " + passage + " end."), (2, "Here stands\n" + passage.lower() + "  and so on. " + other), (3, "x " + " ".join(words[5:54]) + " y"), (4, passage), (5, other + " " + passage + " " + passage), (6, "a b c " * 60), (7, None), (8, ""), (9, " ".join(words[10:60]) + " tail")]
    table = [*rows, rows[1], (None, passage), (2, "again " + passage)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in table], "doc_id long, text string, cuts int").repartition(3)
    found = spans.remove_passages(docs, 50)
    assert found.columns == docs.columns
    want = dict(rows) | {2: "Here stands\nand so on. " + other, 5: other + " ", 9: "tail"}
    del want[4]
    assert by_id((r.doc_id, r.text) for r in found.collect()) == by_id([*want.items(), (2, want[2]), (2, "again "), (None, passage)])
    assert spans.remove_passages(docs.limit(0)).count() == 0


def test_passages_equal_brute_force(spark):
    r = random.Random(3)
    word = lambda: r.choice("abcdefgh")
    shared = [word() for _ in range(400)]
    rows = []
    for i in range(60):
        a = r.randrange(350)
        rows.append((i, " ".join([word() for _ in range(r.randrange(30))] + shared[a : a + r.randrange(60)] + [word() for _ in range(r.randrange(30))])))
    seen, want = {}, {}
    for i, t in rows:
        w, gone = t.split(), set()
        for k in range(len(w) - 11):
            if seen.setdefault(tuple(w[k : k + 12]), i) != i:
                gone |= set(range(k, k + 12))
        if not gone or len(gone) < len(w):
            want[i] = [x for k, x in enumerate(w) if k not in gone]
    found = spans.remove_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 12)
    assert {x.doc_id: x.text.split() for x in found.collect()} == want
    assert sum(len(x) for x in want.values()) < sum(len(t.split()) for _, t in rows) * 0.8
