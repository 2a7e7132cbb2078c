r"""Language-model scores of whole documents under a hidden Markov model.

Tokens are words [^\x20\x09-\x0D]+ with A-Z lower-cased, and one end behind each document. A hidden state emits a word
class (a hash of the word's last four bytes: a class of its own for most short words; the end has its own), and
the class emits the word in proportion to its training count, with unseen words sharing one place in each class. So the
model's parameters are bounded while every word's count of the whole corpus enters the score. Transitions and class
emissions are trained by Baum-Welch from starting values drawn around the corpus counts of the classes: the expected counts of all
partitions are summed, in ``rounds`` passes over one of ``rounds`` parts of the training documents each (every document
in one of them), then in passes over all of them until the likelihood gains less than ``tolerance`` (natural
logarithm for each token). Scaled forward recursion gives the exact likelihood of each document's whole sequence.

A first pass cuts the corpus into chunks of bounded size, each with its own vocabulary; word counts are summed over all
chunks by hash, and each chunk gets back the counts of its own words. No table of all words exists in one place.
Words count as equal if their 64-bit hashes are.

Null and empty texts are the end alone. Rows whose ``learn`` is false or null are scored only. Repeated rows count as often
as they occur and get equal scores; a null doc_id stays null. A long text is one sequence, in a chunk of its own if need be. Columns besides
doc_id, text and learn are ignored, whatever their names. An empty table gives an empty result; without training documents all counts are 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.columns import only
from meshlake.llm.scratch import forget, keep
from meshlake.llm.textarrays import Texts, _symbols, as_texts, mix, slices, span_hashes

CLASS_BITS = 12
END_CLASS = 1 << CLASS_BITS
CLASSES = END_CLASS + 1
END_HASH = np.uint64(0x5851F42D4C957F2D)
#: Bytes of text in a chunk.
CHUNK_BYTES = 5_000_000
SMOOTH = 0.1


# --- tokens and chunks


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and class of every token (ends included), and the first token of each document (one more at the end)."""
    data, starts, ends, first = texts.words()
    hashes = span_hashes(_symbols()[data], starts, ends)
    code = np.zeros(len(starts), np.uint64)
    for back in range(1, 5):
        at = ends - back
        code = (code << np.uint64(8)) | np.where(at >= starts, data[np.maximum(at, 0)], 0).astype(np.uint64) if len(starts) else code
    classes = (mix(code + np.uint64(1)) >> np.uint64(64 - CLASS_BITS)).astype(np.uint16)
    n = np.diff(first)
    out_first = first + np.arange(len(first))
    place = np.ones(int(out_first[-1]), bool)
    place[out_first[1:] - 1] = False
    all_hashes, all_classes = np.full(len(place), END_HASH), np.full(len(place), END_CLASS, np.uint16)
    all_hashes[place], all_classes[place] = hashes, classes
    assert len(n) + len(hashes) == len(place)
    return all_hashes, all_classes, out_first


def planes(ids: np.ndarray) -> bytes:
    """32-bit numbers as four runs of bytes, which compress better."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


CHUNKS = "doc_ids array<long>, learn binary, deal binary, first binary, ids binary, classes binary, hashes array<long>, kinds array<short>, counts array<long>"


def chunks(docs: DataFrame) -> DataFrame:
    """Rows of a chunk: its documents (``deal``: a hash of each one's words) as numbers of its own words, and for its words (by hash) class and training count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            hashes = np.concatenate([x[2] for x in held])
            classes = np.concatenate([x[3] for x in held])
            lengths = np.concatenate([np.diff(x[4]) for x in held])
            doc_ids = pa.concat_arrays([x[0] for x in held])
            learn = np.concatenate([x[1] for x in held])
            words, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            first = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
            counts = np.bincount(inverse, weights=np.repeat(learn, lengths), minlength=len(words)).astype(np.int64)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            row = {
                "doc_ids": one(doc_ids),
                "learn": pa.array([learn.astype(np.uint8).tobytes()]),
                "deal": pa.array([span_hashes(hashes, first[:-1], first[1:]).tobytes()]),
                "first": pa.array([first.tobytes()]),
                "ids": pa.array([planes(inverse)]),
                "classes": pa.array([classes[at].astype("<u2").tobytes()]),
                "hashes": one(pa.array(words.view(np.int64))),
                "kinds": one(pa.array(classes[at].astype(np.int16))),
                "counts": one(pa.array(counts)),
            }
            return pa.RecordBatch.from_arrays(list(row.values()), list(row))

        for part in slices(batches):
            texts = as_texts(part.column("text"))
            learn = part.column("learn").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            held.append((part.column("doc_id"), learn, *tokens(texts)))
            size += len(texts.data)
            if size >= CHUNK_BYTES:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return only(docs, doc_id="long", text="string", learn="boolean").mapInArrow(run, CHUNKS)


def totals(table: DataFrame) -> DataFrame:
    """hash, class and n (training count in the whole corpus) of every training word; each task adds up its chunks' counts before the shuffle."""
    words = table.select(F.explode(F.arrays_zip("hashes", "kinds", "counts")).alias("w")).select(F.col("w.hashes").alias("hash"), F.col("w.kinds").alias("class"), F.col("w.counts").alias("n"))
    return words.where("n > 0").groupBy("hash").agg(F.min("class").alias("class"), F.sum("n").alias("n"))


def given_back(table: DataFrame, counted: DataFrame) -> DataFrame:
    """chunk, at and n: which of the chunk's words have a training count, and how much it is."""
    words = table.select("chunk", F.posexplode("hashes").alias("at", "hash"))
    return words.join(counted.select("hash", "n"), "hash").groupBy("chunk").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))


# --- the model


@dataclass
class Model:
    """start (states), move (states x states), emit (classes x states)."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Lockstep:
    """Sequences of classes side by side: sorted by length, one place after another."""

    def __init__(self, classes: np.ndarray, first: np.ndarray):
        lengths = np.diff(first)
        self.order = np.argsort(-lengths, kind="stable")
        lengths = lengths[self.order]
        steps = int(lengths[0]) if len(lengths) else 0
        self.active = np.searchsorted(-lengths, -np.arange(steps), "left")  # sequences longer than each place
        self.at = np.concatenate([[0], np.cumsum(self.active)])
        starts = first[:-1][self.order]
        step = np.repeat(np.arange(steps), self.active)
        row = np.arange(self.at[-1]) - np.repeat(self.at[:-1], self.active)
        self.classes = classes[starts[row] + step].astype(np.int64)

    def forward(self, model: Model, keep: bool = False) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
        """Natural logarithm of each sequence's likelihood, in the order given; scaled states and scales of all places, if asked for."""
        n = len(self.order)
        total = np.zeros(n)
        emit, move = model.emit, model.move
        states = np.empty((self.at[-1], len(model.start))) if keep else None
        scales = np.empty(self.at[-1]) if keep else None
        a = None
        log_block, left = np.ones(n), 0
        for t, k in enumerate(self.active.tolist()):
            lo = self.at[t]
            b = emit[self.classes[lo : lo + k]]
            a = model.start * b if t == 0 else (a[:k] @ move) * b
            s = a.sum(1)
            a /= s[:, None]
            log_block[:k] *= s
            left += 1
            if left == 16:  # few enough that their product does not underflow
                total += np.log(log_block)
                log_block, left = np.ones(n), 0
            if keep:
                states[lo : lo + k], scales[lo : lo + k] = a, s
        total += np.log(log_block)
        out = np.empty(n)
        out[self.order] = total
        return out, states, scales

    def expected(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Baum-Welch counts of starts, moves and emissions, and the logarithmic likelihood of all sequences."""
        likelihood, states, scales = self.forward(model, keep=True)
        k_states = len(model.start)
        moves = np.zeros((k_states, k_states))
        later = np.zeros((0, k_states))
        turned = model.move.T.copy()
        for t in range(len(self.active) - 1, -1, -1):
            lo, k = self.at[t], int(self.active[t])
            back = np.ones((k, k_states))
            if len(later):
                moves += states[lo : lo + len(later)].T @ later
                back[: len(later)] = later @ turned
            later = model.emit[self.classes[lo : lo + k]] * back / scales[lo : lo + k, None]
            states[lo : lo + k] *= back
        moves *= model.move
        starts = states[: self.active[0]].sum(0) if len(self.active) else np.zeros(k_states)
        emissions = np.stack([np.bincount(self.classes, weights=states[:, s], minlength=CLASSES) for s in range(k_states)], 1)
        return starts, moves, emissions, float(likelihood.sum())


def maximized(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray) -> Model:
    """The model of expected counts, smoothed so that nothing is impossible."""
    start, move, emit = starts + 0.1, moves + 0.1, emissions + 0.01
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def first_model(n_class: np.ndarray, states: int, seed: int = 5) -> Model:
    """Starting values of fixed size: sticky states whose emissions vary at random around the classes' training counts."""
    r = np.random.default_rng(seed)
    emit = (n_class + 0.5)[:, None] * np.exp(r.standard_normal((CLASSES, states)))
    move = np.full((states, states), 0.1 / max(states - 1, 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


#: Tokens that a pass takes side by side, over several chunks where a part has few in each; a chunk with more is taken alone.
TOGETHER = 1_000_000

# --- passes over the chunks


def sequences(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk's row: word numbers, their classes, first token of each document, and which documents to learn from."""
    ids = unplanes(row["ids"])
    return ids, np.frombuffer(row["classes"], "<u2")[ids], np.frombuffer(row["first"], "<i8"), np.frombuffer(row["learn"], np.uint8).astype(bool)


def one_pass(table: DataFrame, model: Model, part: int = 0, parts: int = 1) -> tuple[Model, float, float]:
    """One Baum-Welch step over the training documents (of one of some parts, dealt by their words, so that it doesn't matter how rows lie in files): the next model, and this one's logarithmic likelihood and tokens; the counts of all partitions meet in a sum by cell."""
    shared = table.sparkSession.sparkContext.broadcast(model)  # of fixed size
    k = len(model.start)
    sizes = k + k * k + CLASSES * k

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = shared.value, np.zeros(sizes + 2)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def add() -> None:
            lengths = np.concatenate([n for _, n in held])
            starts, moves, emissions, likelihood = Lockstep(np.concatenate([c for c, _ in held]), np.concatenate([[0], np.cumsum(lengths)])).expected(model)
            total[:] += np.concatenate([starts, moves.reshape(-1), emissions.reshape(-1), [likelihood, lengths.sum()]])
            held.clear()

        for batch in batches:
            for row in batch.to_pylist():
                first, learn = np.frombuffer(row["first"], "<i8"), np.frombuffer(row["learn"], np.uint8).astype(bool)
                at = np.flatnonzero(learn & (np.frombuffer(row["deal"], np.uint64) % np.uint64(parts) == part))
                if len(at):
                    n = np.diff(first)[at]
                    new = np.concatenate([[0], np.cumsum(n)])
                    rows = np.repeat(first[at] - new[:-1], n) + np.arange(new[-1])
                    classes = np.frombuffer(row["classes"], "<u2")[unplanes(row["ids"])[rows]]
                    if held and sum(len(c) for c, _ in held) + len(classes) > TOGETHER:
                        add()
                    held.append((classes, n))
        if held:
            add()
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    counted = table.select("learn", "deal", "first", "ids", "classes").mapInArrow(count, "cell long, n double")
    found = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # a row for each parameter at most
    total = np.zeros(sizes + 2)
    total[found["cell"].to_numpy()] = found["n"].to_numpy()
    if not total[-1]:
        return model, 0.0, 0.0
    return maximized(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k : sizes].reshape(CLASSES, k)), float(total[-2]), float(total[-1])


def trained(table: DataFrame, n_class: np.ndarray, states: int, rounds: int, tolerance: float) -> Model:
    """The model after ``rounds`` parts of the training documents, and then all of them until their likelihood settles."""
    model, before = first_model(n_class, states), -math.inf
    for part in range(rounds):
        model, _, _ = one_pass(table, model, part, rounds)
    while True:  # each step gains, so this ends
        model, likelihood, n = one_pass(table, model)
        if not n or likelihood / n < before + tolerance:
            return model
        before = likelihood / n


@dataclass
class Corpus:
    """The chunks, the words' training counts given back to them, training tokens and distinct training words of each class, and the model."""

    table: DataFrame
    counts: DataFrame
    n_class: np.ndarray
    v_class: np.ndarray
    model: Model


def learned(docs: DataFrame, states: int = 8, rounds: int = 8, tolerance: float = 0.02) -> Corpus:
    table = keep(chunks(docs).withColumn("chunk", F.monotonically_increasing_id()))
    counted = keep(totals(table))
    found = counted.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).toArrow()  # a row for each class at most
    n_class, v_class = np.zeros(CLASSES), np.zeros(CLASSES)
    n_class[found["class"].to_numpy()], v_class[found["class"].to_numpy()] = found["n"].to_numpy(), found["v"].to_numpy()
    counts = keep(given_back(table, counted))
    forget(counted)
    return Corpus(table, counts, n_class, v_class, trained(table, n_class, states, rounds, tolerance))


def score(docs: DataFrame, states: int = 8, rounds: int = 8, tolerance: float = 0.02) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score for every row of docs (doc_id, text, learn)."""
    corpus = learned(docs, states, rounds, tolerance)
    shared = docs.sparkSession.sparkContext.broadcast((corpus.model, corpus.n_class, corpus.v_class))  # of fixed size
    n_all, v_all = int(corpus.n_class.sum()), int(corpus.v_class.sum())

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        model, n_class, v_class = shared.value
        row = left.iloc[0].to_dict()
        ids, classes, first, _ = sequences(row)
        word_class = np.frombuffer(row["classes"], "<u2")
        c = np.zeros(len(word_class), np.int64)
        for at, n in zip(right["at"], right["n"], strict=True):  # no row if none of its words is known
            c[np.asarray(at)] = np.asarray(n)
        base = np.log10((c + SMOOTH) / (n_all + SMOOTH * (v_all + 1)))
        within = np.log10((c + SMOOTH) / (n_class[word_class] + SMOOTH * (v_class[word_class] + 1)))
        at = first[:-1]
        likelihood, _, _ = Lockstep(classes, first).forward(model)
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if x is None or x != x else int(x) for x in row["doc_ids"]], "Int64"),
                "n_tokens": np.diff(first),
                "n_known": np.add.reduceat((c > 0).astype(np.int64)[ids], at),
                "train_tokens": n_all,
                "base_score": np.add.reduceat(base[ids], at),
                "score": likelihood / np.log(10) + np.add.reduceat(within[ids], at),
            }
        )

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    parts = corpus.table.select("chunk", "doc_ids", "learn", "first", "ids", "classes").groupBy("chunk")
    return parts.cogroup(corpus.counts.groupBy("chunk")).applyInPandas(judge, schema)
