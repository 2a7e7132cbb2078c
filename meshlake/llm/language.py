"""Language identification with bit-sliced Bloom filters of byte n-grams.

Training counts the n-grams of 3, 4 and 5 bytes of labelled texts (lower-cased, with every run of other
characters than letters as one blank). A language contains an n-gram if it holds it often enough: at least
``least`` times, and at ``share`` or more of the rate of the language that has it most often. Each position of the
filter holds one bit for each language; the AND of an n-gram's positions gives all languages that contain it at once.
Prediction counts these bits for each language, removes the expected false positives, and takes the language that
contains most of the text.

Training reads a sample of at most about ``per_language`` documents of each language, chosen by a hash of doc_id; with
fewer, all of them. Texts that are null or have no letter get ``und`` and score 0; equal counts go to the language
with more training documents, then to the first by name. Rows with null lang, text or doc_id aren't learned from.
Documents are scored row by row and whole, so repeated rows get equal results and an empty table an empty one. Other columns are
returned as they are, whatever their names; those named lang_pred, score or match are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.columns import column, numbered, only
from meshlake.llm.textarrays import as_texts, mix, slices

ORDERS = (3, 4, 5)
PROBES = 2
UNDETERMINED = "und"


def letters(text: Column) -> Column:
    """Lower-cased words of letters between single blanks, with one at each end."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}\p{M}]+", " ")


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: a 64-bit hash of each n-gram that lies within one document, and the first n-gram of each document (one more at the end)."""
    wide = data.astype(np.uint64)
    lengths = np.diff(offsets)
    for n in ORDERS:
        size = len(data) - n + 1
        if size <= 0:
            yield np.zeros(0, np.uint64), np.zeros(len(lengths) + 1, np.int64)
            continue
        code = np.full(size, n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | wide[i : size + i]
        inside = np.ones(size, bool)
        for back in range(1, n):  # n-grams that reach into the next document
            at = offsets[1:-1] - back
            inside[at[(at >= 0) & (at < size)]] = False
        counts = np.maximum(lengths - n + 1, 0)
        yield mix(code[inside]), np.concatenate([[0], np.cumsum(counts)])


@dataclass
class Filter:
    """languages: names by bit; slices: one array of positions for each 64 languages; fill: share of set positions of each language."""

    languages: list[str]
    slices: np.ndarray
    fill: np.ndarray

    def contained(self, hashes: np.ndarray) -> list[np.ndarray]:
        """For each slice, the bits of the languages that contain each n-gram."""
        bits = np.uint64(64 - (self.slices.shape[1] - 1).bit_length())
        found = [s[(hashes >> bits).astype(np.int64)] for s in self.slices]
        for probe in range(1, PROBES):
            at = (mix(hashes + np.uint64(probe)) >> bits).astype(np.int64)
            found = [x & s[at] for x, s in zip(found, self.slices, strict=True)]
        return found

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The corrected share of each text's n-grams that each language contains, and the number of n-grams."""
        texts = as_texts(column)
        hits = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts), np.int64)
        for hashes, first in grams(texts.data, texts.offsets):
            n = np.diff(first)
            total += n
            full = n > 0
            if not full.any():
                continue
            at = first[:-1][full]
            for k, found in enumerate(self.contained(hashes)):
                for i in range(64 * k, min(64 * k + 64, len(self.languages))):
                    bit = ((found >> found.dtype.type(i - 64 * k)) & found.dtype.type(1)).astype(np.int32)
                    hits[full, i] += np.add.reduceat(bit, at)
        false = self.fill**PROBES
        share = (hits / np.maximum(total, 1)[:, None] - false) / np.maximum(1 - false, 1e-9)
        return np.where(total[:, None] > 0, np.maximum(share, 0), 0), total


def train(docs: DataFrame, per_language: int = 3000, least: int = 3, share: float = 0.2, bits: int = 21) -> Filter:
    """Learn a filter of 2**bits positions from the columns doc_id, text and lang of labelled documents."""
    known = only(docs, doc_id="long", text="string", lang="string").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    counted = sorted(((r["n"], r["lang"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()), key=lambda x: (-x[0], x[1]))  # a row for each language
    languages = [name for _, name in counted]
    if not languages:
        return Filter([], np.zeros((0, 1 << bits), np.uint8), np.zeros(0))
    index = F.create_map(*[x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))])
    part = F.create_map(*[x for n, name in counted for x in (F.lit(name), F.lit(min(1.0, per_language / n)))])
    sample = known.where((F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000) < part[F.col("lang")])
    sample = sample.select(index[F.col("lang")].alias("language"), letters(F.col("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            texts = as_texts(piece.column("text"))
            language = piece.column("language").to_numpy()
            for hashes, first in grams(texts.data, texts.offsets):
                owner = np.repeat(language, np.diff(first))
                for i in np.unique(language).tolist():
                    gram, n = np.unique(hashes[owner == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), i, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)], ["language", "gram", "n"])

    held = sample.mapInArrow(count, "language int, gram long, n long").groupBy("gram", "language").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    sizes = {i: 0 for i in range(len(languages))}
    held = held.persist()
    sizes |= {r["language"]: r["n"] for r in held.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    total = F.create_map(*[x for i, n in sizes.items() for x in (F.lit(i), F.lit(float(max(n, 1))))])
    rated = held.withColumn("rate", F.col("n") / total[F.col("language")])
    most = rated.groupBy("gram").agg(F.max("rate").alias("most"))
    kept = rated.join(most, "gram").where(F.col("rate") >= share * F.col("most"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - bits)
        for batch in batches:
            hashes = batch.column("gram").to_numpy().view(np.uint64)
            language = batch.column("language").to_numpy()
            for probe in range(PROBES):
                at = (hashes if probe == 0 else mix(hashes + np.uint64(probe))) >> shift
                yield pa.RecordBatch.from_arrays([pa.array((language // 64).astype(np.int32)), pa.array(at.astype(np.int64)), pa.array((np.uint64(1) << (language % 64).astype(np.uint64)).view(np.int64))], ["slice", "position", "mask"])

    placed = kept.select("gram", "language").mapInArrow(place, "slice int, position long, mask long")
    found = placed.groupBy("slice", "position").agg(F.bit_or("mask").alias("mask")).toArrow()  # at most 2**bits rows for each 64 languages
    held.unpersist()
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= 8 * np.dtype(k).itemsize or k is np.uint64)
    table = np.zeros(((len(languages) + 63) // 64, 1 << bits), kind)
    table[found["slice"].to_numpy(), found["position"].to_numpy()] = found["mask"].to_numpy().view(np.uint64).astype(kind)
    fill = np.array([((table[i // 64] >> kind(i % 64)) & kind(1)).mean() for i in range(len(languages))])
    return Filter(languages, table, fill)


def predict(docs: DataFrame, model: Filter) -> DataFrame:
    """The rows of docs with lang_pred, score (share of the best language among all languages' matches) and match (share of the n-grams that the best language contains)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is set by ``bits``, not by the data

    def judge(text: pa.Array) -> pa.Array:
        model = shared.value
        names, scores, matches = [], [], []
        for part in slices([pa.RecordBatch.from_arrays([text], ["text"])]):
            share, total = model.scores(part.column("text"))
            best = share.argmax(1) if share.shape[1] else np.zeros(len(share), np.int64)
            top = share[np.arange(len(share)), best] if share.shape[1] else np.zeros(len(share))
            known = (total > 0) & bool(model.languages)
            names += [model.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            scores.append(np.where(known, top / np.maximum(share.sum(1), 1e-12), 0.0))
            matches.append(np.where(known, np.minimum(top, 1.0), 0.0))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64()), pa.array(np.concatenate(matches) if matches else [], pa.float64())], ["lang_pred", "score", "match"])

    udf = F.arrow_udf(judge, "lang_pred string, score double, match double")
    text = column(docs, "text").cast("string")
    # texts without a letter come as null, so that they have no n-grams
    judged = udf(F.when(text.rlike(r"\p{L}"), letters(text)))
    own = [(F.col(f"_{i}"), c) for i, c in enumerate(docs.columns) if c.lower() not in ("lang_pred", "score", "match")]
    return numbered(docs).select(*(c for c, _ in own), judged.alias("judged")).select(*(c for c, _ in own), "judged.*").toDF(*(c for _, c in own), "lang_pred", "score", "match")
