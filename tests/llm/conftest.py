import random

import pytest

#: Rows that every operator on documents must take: null and empty texts, repeats, ties, long texts, a null doc_id.
WORDS = {"en": "the and with this that over under house river light".split(), "de": "der und mit diese dass über unter haus fluss licht".split()}


def prose(seed, lang, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS[lang]) + r.choice(["", "", "s", "ly" if lang == "en" else "ung"]) + ("." if r.random() < 0.1 else "") for _ in range(n))


def document_rows():
    rows = [(i, prose(i, ("en", "de")[i % 2], 30 + i), ("en", "de")[i % 2]) for i in range(60)]
    rows += [
        (100, None, "en"),
        (101, "", None),
        (102, " \t\n", "de"),
        (103, "123 456 !!", None),
        (104, rows[4][1], "en"),
        (104, rows[4][1], "en"),
        (105, prose(7, "en", 9000), "en"),
        (106, "x" * 3000, "en"),
        (107, "<|endoftext|> it's 3 o'clock\n\n  İ Σ 漢字 🙂", "en"),
        (None, "the house with a light", "en"),
    ]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    """With columns whose names the operators use themselves."""
    rows = [(*r, 1, "s", 0.5, "k", 9) for r in document_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, source string, score double, component string, n_tokens int").repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n_chars long, source string")
