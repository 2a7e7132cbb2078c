import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from meshlake.llm import hmm, language, toxicity
from meshlake.llm.textarrays import as_texts
from tests.llm.conftest import document_rows, prose


def test_language(spark, documents, no_documents):
    model = language.train(documents)
    assert sorted(model.languages) == ["de", "en"]
    found = language.predict(documents, model).collect()
    assert len(found) == len(document_rows())
    for r in found:
        assert 0 <= r.score <= 1 and r.component == "k"
        if r.doc_id is not None and r.doc_id < 60:
            assert r.lang_pred == ("en", "de")[r.doc_id % 2]
        if r.doc_id in (100, 101, 102, 103):
            assert (r.lang_pred, r.score) == ("und", 0.0)
    assert language.predict(no_documents, model).count() == 0
    nothing = language.train(no_documents)
    assert {r.lang_pred for r in language.predict(documents, nothing).collect()} == {"und"}


def test_filter_has_no_false_negatives_and_rare_false_positives():
    r = np.random.default_rng(1)
    table = np.zeros((1, 1 << 16), np.uint8)
    held = r.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)
    for probe in range(language.PROBES):
        table[0, ((held if probe == 0 else language.mix(held + np.uint64(probe))) >> np.uint64(48)).astype(int)] |= 2
    f = language.Filter(["a", "b"], table, np.array([0.0, (table[0] > 0).mean()]))
    assert (f.contained(held)[0] == 2).all()
    other = r.integers(0, 1 << 63, 20000).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    assert abs((f.contained(other)[0] == 2).mean() - f.fill[1] ** 2) < 0.003


def test_predictions_equal_exact_n_gram_sets(spark):
    """The same rule with plain sets in place of filters: equal languages, and shares that differ by the filters' rounding only."""
    rows = [(i, prose(i, ("en", "de")[i % 2], 40), ("en", "de")[i % 2]) for i in range(40)]

    def grams(text):
        data = re.sub(r"[^a-zA-Zäöüß]+", " ", f" {text.lower()} ").encode()
        return [(n, data[i : i + n]) for n in language.ORDERS for i in range(len(data) - n + 1)]

    counts = {lang: Counter(g for _, t, x in rows if x == lang for g in grams(t)) for lang in ("en", "de")}
    counts = {lang: {g: n for g, n in c.items() if n >= 3} for lang, c in counts.items()}
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items()} for lang, c in counts.items()}
    most = {g: max(rate[x].get(g, 0) for x in rate) for x in rate for g in rate[x]}
    sets = {lang: {g for g, x in r.items() if x >= 0.2 * most[g]} for lang, r in rate.items()}
    docs = spark.createDataFrame(rows + [(100 + i, prose(500 + i, ("en", "de")[i % 2], 3 + i), None) for i in range(30)], "doc_id long, text string, lang string")
    for r in language.predict(docs, language.train(docs.where("lang IS NOT NULL"))).collect():
        found = grams(r.text)
        share = {lang: sum(g in s for g in found) / len(found) for lang, s in sets.items()}
        best = max(share, key=share.get)
        assert r.lang_pred == best and abs(r.match - share[best]) < 2e-3 and abs(r.score - share[best] / sum(share.values())) < 5e-3


def test_score_equals_plain_recursion(spark):
    """A whole document's score, word by word and window by window."""
    docs = spark.createDataFrame([(0, prose(1, "en", 150)), (1, "two words"), (2, "")], "doc_id long, text string")
    net = toxicity.Network(np.sort(toxicity.read_words(as_texts(pa.array([prose(1, "en", 20)]))).hashes), 3)
    logistic = lambda z: 1 / (1 + np.exp(-z))

    def recursion(x, side):
        h, out, n = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for v in x:
            g, u = v @ net.p[f"W{side}"] + net.p[f"c{side}"], h @ net.p[f"U{side}"]
            reset, stay = logistic(g[:n] + u[:n]), logistic(g[n : 2 * n] + u[n : 2 * n])
            h = stay * h + (1 - stay) * np.tanh(g[2 * n :] + reset * u[2 * n :])
            out.append(h)
        return out

    for r in toxicity.score(docs, net).collect():
        words = r.text.split()
        logits = []
        for at in range(0, max(1, len(words) - 64 + 32), 32):
            part = words[at : at + 64]
            x = []
            for w in part:
                one = toxicity.read_words(as_texts(pa.array([w])))
                own = int(net.own(one)[0])
                x.append(net.p["grams"][one.grams].sum(0) / math.sqrt(len(one.grams)) + net.p["words"][own])
            states = np.array([np.concatenate(s) for s in zip(recursion(x, "f"), recursion(x[::-1], "b")[::-1], strict=True)]).reshape(len(part), 2 * toxicity.HIDDEN)
            pooled = np.zeros(2 * toxicity.HIDDEN)
            if len(part):
                energy = np.exp(np.tanh(states @ net.p["A"] + net.p["a"]) @ net.p["v"])
                pooled = energy / energy.sum() @ states
            logits.append(pooled @ net.p["w"] + net.p["o"][0])
        assert math.isclose(r.score, logistic(max(logits)), rel_tol=1e-4)


def test_other_columns_do_not_clash(spark):
    docs = spark.createDataFrame([(1, prose(1, "en", 30), "en", 5, 6, 7)], "doc_id long, text string, lang string, `a.b` int, SCORE int, TEXT int")
    scored = toxicity.score(docs, None)
    assert scored.columns == ["doc_id", "text", "lang", "a.b", "TEXT", "score", "predicted"] and scored.count() == 1
    named = language.predict(docs, language.train(docs))
    assert named.columns == ["doc_id", "text", "lang", "a.b", "TEXT", "lang_pred", "score", "match"] and named.first()["lang_pred"] == "en"
    labels = spark.createDataFrame([(1, 1, 3)], "doc_id long, toxic int, Doc_id int")
    assert toxicity.train(docs, labels) is not None


def test_toxicity_learns_words_and_parts_of_words(spark):
    rows = []
    for i in range(300):
        words = prose(i, "en", 40 + i % 200).split()
        bad = i % 3 == 0
        if bad:
            words[i % len(words)] = f"grobl{i % 17}"
        rows.append((i, " ".join(words), int(bad)))
    rows += [(900, None, 1), (901, "", None), (902, "grobl1 " + prose(3, "en", 4000), None), (903, prose(4, "en", 4000) + " grobl99", None)]
    docs = spark.createDataFrame([(i, t, 2.0) for i, t, _ in rows], "doc_id long, text string, score double").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels.where("doc_id < 200"))
    found = {r.doc_id: r for r in toxicity.score(docs, net).collect()}
    assert len(found) == len(rows)
    held = [found[i].predicted == y for i, _, y in rows if 200 <= i < 300]
    assert np.mean(held) >= 0.97
    assert found[902].predicted == 1 and found[903].predicted == 1
    assert all(0 <= r.score <= 1 for r in found.values()) and found[900].score == found[901].score
    assert toxicity.score(docs.limit(0), net).count() == 0
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


def test_network_gradients():
    words = toxicity.read_words(toxicity.as_texts(pa.array(["a bc def xx", "xx yy zz", "hello world a", ""])))
    net = toxicity.Network(words.hashes[:4])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    begin, length, _ = toxicity.windows(words.first, 64, 32)
    index, label = toxicity.places(words, begin, length, len(words.hashes)), np.array([1.0, 0, 1, 0])

    def loss():
        z = net.forward(net.vectors(words).astype(np.float64), index)
        return np.mean(np.log1p(np.exp(z)) - label * z)

    grads = net.gradients(words, net.vectors(words).astype(np.float64), index, label)
    for k, v in net.p.items():
        flat, at = v.reshape(-1), int(np.argmax(np.abs(grads[k])))
        old = flat[at]
        flat[at] = old + 1e-3
        up = loss()
        flat[at] = old - 1e-3
        down = loss()
        flat[at] = old
        assert math.isclose(grads[k].reshape(-1)[at], (up - down) / 2e-3, rel_tol=1e-2, abs_tol=1e-5), k


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 96, 97, 500):
        begin, length, first = toxicity.windows(np.array([0, n]), 64, 32)
        assert first[-1] == len(begin) and set().union(*(range(b, b + x) for b, x in zip(begin, length, strict=True))) == set(range(n))


def test_forward_equals_plain_recursion_and_training_raises_likelihood():
    r = np.random.default_rng(2)
    model = hmm.maximized(r.random(3), r.random((3, 3)), r.random((hmm.CLASSES, 3)))
    lengths = [5, 1, 60, 5]
    first = np.concatenate([[0], np.cumsum(lengths)])
    classes = r.integers(0, 40, first[-1])
    side_by_side = hmm.Lockstep(classes, first)
    found, _, _ = side_by_side.forward(model)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        alpha = model.start * model.emit[classes[a]]
        for c in classes[a + 1 : b]:
            alpha = (alpha @ model.move) * model.emit[c]
        assert math.isclose(found[i], math.log(alpha.sum()), rel_tol=1e-9)
    starts, moves, emissions, likelihood = side_by_side.expected(model)
    assert math.isclose(likelihood, found.sum())
    assert math.isclose(starts.sum(), 4) and math.isclose(moves.sum(), sum(lengths) - 4) and math.isclose(emissions.sum(), sum(lengths))
    better = hmm.maximized(starts, moves, emissions)
    assert side_by_side.forward(better)[0].sum() > found.sum()


def test_scores_equal_brute_force(spark, documents, no_documents):
    from pyspark.sql import functions as F

    docs = documents.withColumn("learn", F.col("doc_id") % 5 != 0)
    found = hmm.score(docs, states=3, rounds=2).collect()
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\n"]) for i, t, _ in document_rows()]
    counts = Counter(w for i, t in tokens if i is not None and i % 5 != 0 for w in t)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for i, t in tokens:
        want[i, len(t), sum(counts[w] > 0 for w in t), n, round(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 5)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found) == want
    # the score by plain recursion over states, with each word's share of its class
    corpus = hmm.learned(docs, states=3, rounds=2)
    model, each = corpus.model, {}
    for i, t in tokens:
        hashes, classes, _ = hmm.tokens(as_texts(pa.array([" ".join(t[:-1])])))
        alpha, total = model.start, 0.0
        for k, (w, c) in enumerate(zip(t, classes.tolist(), strict=True)):
            alpha = (alpha if k == 0 else alpha @ model.move) * model.emit[c]
            total += math.log10(alpha.sum()) + math.log10((counts[w] + 0.1) / (corpus.n_class[c] + 0.1 * (corpus.v_class[c] + 1)))
            alpha = alpha / alpha.sum()
        each[i, len(t)] = total
    assert all(math.isclose(r.score, each[r.doc_id, r.n_tokens], rel_tol=1e-6) for r in found)
    # the words of a class share no more than its whole
    classes = {w: int(c) for w, c in zip(counts, hmm.tokens(as_texts(pa.array([" ".join(w if w != "\n" else "x" for w in counts)])))[1].tolist(), strict=False) if w != "\n"}
    shares = Counter()
    for w, c in classes.items():
        shares[c] += (counts[w] + 0.1) / (corpus.n_class[c] + 0.1 * (corpus.v_class[c] + 1))
    assert max(shares.values()) < 1 and math.isclose(model.emit.sum(), 3)
    assert sum(r.score for r in found) > sum(r.base_score for r in found)
    assert hmm.score(no_documents.withColumn("learn", F.lit(True))).count() == 0
    unlearned = hmm.score(documents.where("doc_id < 5").withColumn("learn", F.lit(None).cast("boolean"))).collect()
    assert {r.n_known for r in unlearned} == {0}


def test_hidden_markov_scores_do_not_depend_on_how_rows_lie(spark):
    rows = [(i, " ".join(f"w{(i * k * k) % 23}" for k in range(5 + i % 40)), i % 10 != 0) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    found = [{r.doc_id: r.score for r in hmm.score(docs.repartition(n), states=3, rounds=4).collect()} for n in (1, 7)]
    assert found[0].keys() == found[1].keys()
    assert all(abs(found[0][i] - found[1][i]) <= 1e-6 * max(1, abs(found[0][i])) for i in found[0])
