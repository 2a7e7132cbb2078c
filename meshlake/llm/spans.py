"""Removal of repeated passages by sliding sentence spans.

A sentence ends with a word that ends in . ! or ?, at a line break, or with the text. A span is a run of ``run``
consecutive sentences, one from every sentence that has so many from there; a text with fewer sentences is one span as a whole.
A span's hash covers the words alone (A-Z lower-cased), not the white space between them. Of the spans with one hash,
the first by doc_id and place stays; every sentence that another one covers is removed with the white space behind it.

Documents are told apart by doc_id and text: rows with one doc_id and different texts are different documents (in the order of
a hash of their texts), rows that repeat both are one document and stay alike. Null texts stay null and empty ones empty, with no
sentences; rows with a null doc_id stay as they are. Long texts are taken whole. An empty table gives an empty result. All
columns are returned as they are but for the text, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.columns import column, numbered, place
from meshlake.llm.scratch import forget, keep
from meshlake.llm.substrings import _least
from meshlake.llm.textarrays import Texts, _symbols, as_texts, mix, slices, span_hashes

STOPS = np.zeros(256, bool)
STOPS[[33, 46, 63]] = True


def sentences(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, first byte of each word, first word of each sentence (one more at the end), and first sentence of each document (one more at the end)."""
    data, starts, ends, first = texts.words()
    n = len(starts)
    hashes = span_hashes(_symbols()[data], starts, ends)
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    stop = np.zeros(n, bool)
    if n:
        stop = STOPS[data[ends - 1]]
        stop[:-1] |= lines[starts[1:]] > lines[ends[:-1]]
        stop[first[1:][first[1:] > 0] - 1] = True
        stop[-1] = True
    begin = np.concatenate([[0], np.flatnonzero(stop) + 1]) if n else np.zeros(1, np.int64)
    return hashes, starts, begin, np.searchsorted(begin[:-1], first)


def spans(docs: DataFrame, run: int) -> DataFrame:
    """span (hash), doc_id, part and sentence (from 0) of every span; docs has doc_id, part and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            hashes, _, begin, first = sentences(as_texts(part.column("text")))
            document = np.repeat(np.arange(len(first) - 1), np.diff(first))
            to = np.minimum(np.arange(len(document)) + run, first[1:][document])
            at = np.flatnonzero((to - np.arange(len(document)) == run) | (np.arange(len(document)) == first[:-1][document]))
            of = pa.array(document[at])
            span = span_hashes(hashes, begin[at], begin[to[at]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(span.view(np.int64)), part.column("doc_id").take(of), part.column("part").take(of), pa.array((at - first[document[at]]).astype(np.int32))], ["span", "doc_id", "part", "sentence"]
            )

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(cut, "span long, doc_id long, part long, sentence int")


def remove_repeats(docs: DataFrame, run: int = 3) -> DataFrame:
    """The rows of docs with text cleaned, n_sentences and n_removed (which replace columns of these names)."""
    rows = numbered(docs)
    text = column(docs, "text").cast("string")
    rows = rows.withColumn("doc_id", column(docs, "doc_id").cast("long")).withColumn("part", F.xxhash64(text))
    every = keep(spans(rows.select("doc_id", "part", text.alias("text")), run))
    often = keep(every.groupBy("span").agg(F.count("*").alias("times")).where("times > 1").select("span"))
    hits = keep(every.join(often, "span"))
    forget(every, often)
    first = keep(hits.groupBy("span").agg(F.min(F.struct("doc_id", "part", "sentence")).alias("first")))
    later = hits.join(first, "span").where("doc_id <> first.doc_id OR part <> first.part OR sentence <> first.sentence")
    cuts = keep(later.groupBy("doc_id", "part").agg(F.collect_set("sentence").alias("cuts")))
    forget(hits, first)

    def clean(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out, n_sentences, n_removed = [], [], []
        for part in slices([pa.RecordBatch.from_arrays([text, cuts], ["text", "cuts"])]):
            texts = as_texts(part.column("text"))
            _, starts, begin, first = sentences(texts)
            data = texts.data.tobytes()
            at = np.append(starts, 0)[begin]  # first byte of each sentence
            counts = np.diff(first)
            for i, cut in enumerate(part.column("cuts").to_pylist()):
                a, b = int(texts.offsets[i]), int(texts.offsets[i + 1])
                n_sentences.append(int(counts[i]))
                if not part.column("text")[i].is_valid or not cut:
                    n_removed.append(0)
                    out.append(data[a:b].decode() if part.column("text")[i].is_valid else None)
                    continue
                gone = np.zeros(int(counts[i]), bool)
                for c in cut:
                    gone[c : c + run] = True
                edges = at[first[i] : first[i + 1]].tolist() + [b]
                kept = [data[a : edges[0]], *(data[edges[k] : edges[k + 1]] for k in np.flatnonzero(~gone).tolist())]
                n_removed.append(int(gone.sum()))
                out.append(b"".join(kept).decode())
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n_sentences, pa.int64()), pa.array(n_removed, pa.int64())], ["text", "n_sentences", "n_removed"])

    # named nondeterministic, so that a filter on its results doesn't run it a second time
    udf = F.arrow_udf(clean, "text string, n_sentences long, n_removed long").asNondeterministic()
    done = rows.join(cuts, ["doc_id", "part"], "left").withColumn("done", udf(text, F.col("cuts")))
    out = [(F.col("done.text") if i == place(docs, "text") else F.col(f"_{i}"), c) for i, c in enumerate(docs.columns) if c.lower() not in ("n_sentences", "n_removed")]
    return done.select(*(c for c, _ in out), "done.n_sentences", "done.n_removed").toDF(*(c for _, c in out), "n_sentences", "n_removed")


def windows(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, and first word, document and key of every run of so many words; a key is the least hash of the shorter runs within, so equal runs have equal keys."""
    hashes, first = texts.word_hashes()
    if len(hashes) < words:
        return hashes, *np.zeros((2, 0), np.int64), np.zeros(0, np.uint64)
    part = max(1, words // 2)
    at = np.arange(len(hashes) - part + 1)
    keys = _least(span_hashes(hashes, at, at + part), words - part + 1)
    at = np.arange(len(keys))
    document = np.searchsorted(first, at, "right") - 1
    whole = at + words <= first[document + 1]
    return hashes, at[whole], document[whole], keys[whole]


def remove_passages(docs: DataFrame, words: int = 50) -> DataFrame:
    """The rows of docs with text cleaned of every run of so many words that an earlier document has, wherever it begins; texts of which no word is left go.

    Words, documents and their order are those of ``remove_repeats``; repeats within a document stay. Only runs whose key stands in several places get a row.
    """
    rows = numbered(docs)
    text = column(docs, "text").cast("string")
    rows = rows.withColumn("doc_id", column(docs, "doc_id").cast("long")).withColumn("part", F.xxhash64(text))
    texts = rows.select("doc_id", "part", text.alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")

    def cut_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            _, _, document, keys = windows(as_texts(part.column("text")), words)
            new = np.ones(len(keys), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (document[1:] != document[:-1])
            of = pa.array(document[new])
            yield pa.RecordBatch.from_arrays([pa.array(keys[new].view(np.int64)), part.column("doc_id").take(of), part.column("part").take(of)], ["key", "doc_id", "part"])

    def cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = as_texts(part.column("text"))
            hashes, at, document, keys = windows(texts, words)
            _, first = texts.word_hashes()
            ends = np.searchsorted(document, np.arange(len(texts) + 1))
            wanted = np.zeros(len(at), bool)
            for i, often in enumerate(part.column("keys")):
                wanted[ends[i] : ends[i + 1]] = np.isin(keys[ends[i] : ends[i + 1]].view(np.int64), often.values.to_numpy())
            at, document = at[wanted], document[wanted]
            of = pa.array(document)
            run = span_hashes(hashes, at, at + words).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(run), part.column("doc_id").take(of), part.column("part").take(of), pa.array((at - first[document]).astype(np.int32))], ["run", "doc_id", "part", "at"])

    every = keep(texts.mapInArrow(cut_keys, "key long, doc_id long, part long"))
    often = keep(every.groupBy("key").agg(F.count("*").alias("times")).where("times > 1").select("key"))
    marked = keep(every.join(often, "key").groupBy("doc_id", "part").agg(F.collect_set("key").alias("keys")))
    forget(every, often)
    runs = keep(texts.join(marked, ["doc_id", "part"]).mapInArrow(cut_runs, "run long, doc_id long, part long, at int"))
    first = keep(runs.groupBy("run").agg(F.min(F.struct("doc_id", "part")).alias("first")))
    later = runs.join(first, "run").where("doc_id <> first.doc_id OR part <> first.part")
    cuts = keep(later.groupBy("doc_id", "part").agg(F.collect_set("at").alias("cuts")))
    forget(marked, runs, first)

    def clean(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out, left = [], []
        for raw, cut in zip(text, cuts, strict=True):
            if not cut.is_valid:
                out.append(None)
                left.append(None)
                continue
            texts = as_texts(pa.array([raw.as_py()], pa.string()))
            _, starts, _, _ = texts.words()
            at = cut.values.to_numpy()
            edge = np.zeros(len(starts) + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + words, -1)
            gone = np.cumsum(edge)[:-1] > 0
            bytes_ = np.repeat(np.concatenate([[False], gone]), np.diff(np.concatenate([[0], starts, [len(texts.data)]])))  # a word takes the white space behind it
            out.append(texts.data[~bytes_].tobytes().decode())
            left.append(not gone.all())
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(left, pa.bool_())], ["text", "left"])

    udf = F.arrow_udf(clean, "text string, left boolean").asNondeterministic()
    joined = rows.join(cuts, ["doc_id", "part"], "left")
    done = joined.withColumn("done", udf(F.when(F.col("cuts").isNotNull(), text), F.col("cuts"))).where("cuts IS NULL OR done.left")
    cleaned = F.when(F.col("cuts").isNull(), text).otherwise(F.col("done.text"))
    return done.select(*(cleaned if i == place(docs, "text") else F.col(f"_{i}") for i in range(len(docs.columns)))).toDF(*docs.columns)
