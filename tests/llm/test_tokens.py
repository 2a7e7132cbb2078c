import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshlake.llm import bpe, packing, tokens
from tests.llm.conftest import document_rows

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoding_equals_the_library(path):
    r = random.Random(4)
    bits = ["a", "b", " ", "  ", "\n", "'", "'s", "'ll", "don't", "1", "23", "é", "É", "Σ", "İ", "　", "漢字", "!", "...", "<|endoftext|>", "the", " '", "''s", "²", "é", "🙂", "A" * 70, "\xa0"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 20))) for _ in range(800)] + ["", "ab" * 3000]
    model, library = bpe.Bpe(path), Tokenizer.from_file(path)
    ids, counts = model.encode_texts(texts)
    at = np.concatenate([[0], np.cumsum(counts)])
    assert model.count_texts(texts).tolist() == counts.tolist()
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        own = ids[at[i] : at[i + 1]]
        assert own.tolist() == e.ids, texts[i]
        if path == BYTE:
            assert model.decode(own).decode("utf-8", "replace") == library.decode(e.ids, skip_special_tokens=False)


def test_the_shortcut_holds_only_single_tokens():
    model, library = bpe.Bpe(WORD), Tokenizer.from_file(WORD)
    alone = set(model.alone().tolist())
    assert len(alone) > 10_000
    whole, index, *_ = model.distinct(["the house xqzvk"])
    data, starts, lengths = whole(np.arange(len(index)))
    for h, s, n in zip(index.tolist(), starts, lengths, strict=True):
        word = data[s : s + n].tobytes().decode()
        assert (h in alone) == (len(library.encode(word, add_special_tokens=False).ids) == 1)


def test_round_trip_and_counts(spark, documents, no_documents):
    library, words = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)
    want = Counter()
    counted = Counter()
    for doc_id, text, *_ in document_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
        n = len(words.encode(text or "", add_special_tokens=False).ids)
        counted[doc_id, len((text or "").encode()), n, n > 100] += 1
    assert Counter(map(tuple, tokens.round_trip(documents, BYTE).collect())) == want
    assert Counter(map(tuple, tokens.count(documents, WORD, 100).collect())) == counted
    again = {(r["doc_id"], r["text"]) for r in tokens.decode(tokens.encode(documents, BYTE), BYTE).collect()}
    assert again == {(d, t or "") for d, t, _ in document_rows()}
    assert tokens.round_trip(no_documents, BYTE).count() == 0 and tokens.count(no_documents, WORD).count() == 0


@pytest.mark.parametrize("capacity", [16, 64])
def test_packing(documents, no_documents, capacity):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack(documents, WORD, capacity, 0, with_ids=True).collect()
    want = Counter()
    for doc_id, text, *_ in document_rows():
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = ids[start : start + capacity]
            want[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in rows) == want
    placed = defaultdict(list)
    for r in rows:
        placed[r.sequence_id].append((r.offset, r.length))
    for slots in placed.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(placed) <= 1.15 * sum(r.length for r in rows) / capacity + 1
    assert packing.pack(no_documents, WORD, capacity).count() == 0


def test_plan_uses_every_length_once():
    histogram = {10: 7, 6: 3, 5: 9, 4: 20, 1: 2}
    runs = packing.plan(histogram, 10)
    assert {n: sum(r[2] for r in runs if r[0] == n) for n in histogram} == histogram
    used = defaultdict(int)
    for n, _, ranks, sequence, offset, places in runs:
        for i in range(ranks):
            used[sequence + i // places] += n
            assert offset + (i % places + 1) * n <= 10
    total = sum(n * c for n, c in histogram.items())
    assert max(used.values()) <= 10 and sum(used.values()) == total and len(used) <= total // 10 + 3
