import random
import re
from collections import Counter

from meshlake.llm import collocations
from tests.llm.conftest import document_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, top):
    f, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = tuple(re.findall(r"[^ \t]+", piece))
            sizes[lang] += len(words)
            for n in range(1, 5):
                f.setdefault(lang, Counter()).update(words[i : i + n] for i in range(len(words) - n + 1))
    out = []
    for lang, counts in f.items():
        found = []
        for phrase, a in counts.items():
            if len(phrase) < 2 or a < least:
                continue
            cuts = [(2_000_000 * a // (counts[phrase[:k]] + counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            longer = [b for other, b in counts.items() if len(other) > len(phrase) and b >= least and any(other[i : i + len(phrase)] == phrase for i in range(len(other) - len(phrase) + 1))]
            if not any(100 * b >= 80 * a for b in longer):
                found.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, sizes[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def found(spark, rows, least, top):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, times int, `a.phrase` string").repartition(3)
    got = collocations.collocations(table, least, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def texts(seed, n):
    r = random.Random(seed)
    words = ["New", "york", "city", "GRÜN", "grün", "a", "b", "c", "d\x0b", "e-f", "🙂", "of", "the\t"]
    return [(r.choice(["en", "de", None, "und"]), " ".join(r.choice(words) + r.choice(["", "", "", ",", " ", "\n"]) for _ in range(r.randint(0, 40)))) for _ in range(n)]


def test_phrases_equal_plain_counts(spark):
    rows = texts(1, 150) + [("en", "of the new york city")] * 40 + [("de", None), ("de", ""), (None, " \t.;"), ("en", "x" * 9000), ("zz", "only few words")]
    rows += [(lang, t) for _, t, lang in document_rows()]
    assert found(spark, rows, 5, 2000) == plain(rows, 5, 2000)
    assert found(spark, rows, 12, 7) == plain(rows, 12, 7)


def test_many_chunks_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK", 300)
    monkeypatch.setattr(collocations, "BUCKET", 100)
    rows = texts(2, 200)
    assert found(spark, rows, 4, 50) == plain(rows, 4, 50)


def test_no_documents(spark, no_documents):
    assert collocations.collocations(no_documents).collect() == []
