"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A document is read in overlapping windows of words (``window`` long, one every ``stride`` words), and all of them are
scored; the document's score is that of its worst window. A word enters as the sum of a learned vector of its own, if it
was common enough in training, and of vectors of its byte n-grams of 3 and 4, so unseen spellings count too.
Labels are of documents: each training step takes the worst window of a document (at first by the words' log-odds,
later by the network itself) as the one that its label speaks of.

Training reads a sample of at most about ``per_label`` documents without and with the label and about ``most_bytes`` of text in
all, chosen by a hash of doc_id; texts over a tenth of ``most_bytes`` aren't learned from. Rows with a null text, label or doc_id aren't
learned from, nor labels other than 0 and 1; with several labels of one doc_id each counts. Null and empty texts are one empty window, whose score is that of
the network without words. Long texts are scored whole, in all their windows. Scores depend on the text alone, so repeated rows get
equal ones; of windows that tie the first counts. An empty table gives an empty result, no labels at all scores of 0. Other columns are returned as
they are, whatever their names; those named score or predicted are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.columns import column, numbered, only
from meshlake.llm.textarrays import Texts, _symbols, as_texts, mix, slices, span_hashes

WIDTH, HIDDEN, ATTENTION = 8, 12, 8
GRAM_BITS = 13


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def squash(x: np.ndarray) -> np.ndarray:
    """The sigmoid, in place; an overflow gives 0, as it should."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Words:
    """The distinct words of some texts, and the words of each document as numbers of these."""

    hashes: np.ndarray
    grams: np.ndarray
    gram_first: np.ndarray
    sequence: np.ndarray
    first: np.ndarray


def read_words(texts: Texts) -> Words:
    """Words of texts with their byte n-grams; a word's ends count as blanks."""
    data, starts, ends, first = texts.words()
    hashes = span_hashes(_symbols()[data], starts, ends)
    distinct, at, sequence = np.unique(hashes, return_index=True, return_inverse=True)
    a, b = starts[at], ends[at]
    padded = np.concatenate([[32], np.where(data < 33, 32, data), [32]]).astype(np.uint32)
    # n-grams of 3 and of 4 that begin at the blank before a word or in it, and end in it or at the blank behind it
    size = b - a
    three, four = size, np.maximum(size - 1, 1)
    code = np.zeros(len(padded), np.uint64)
    for i in range(3):
        code[: len(padded) - 2] = (code[: len(padded) - 2] << np.uint64(8)) | padded[i : len(padded) - 2 + i]
    code4 = np.zeros(len(padded), np.uint64)
    if len(padded) > 3:
        code4[: len(padded) - 3] = (code[: len(padded) - 3] << np.uint64(8)) | padded[3:] | np.uint64(1 << 40)
    n = three + four
    first_gram = np.concatenate([[0], np.cumsum(n)])
    word = np.repeat(np.arange(len(distinct)), n)
    k = np.arange(len(word)) - first_gram[word]
    is4 = k >= three[word]
    place = a[word] + np.where(is4, k - three[word], k)
    grams = mix(np.where(is4, code4[place], code[place])) >> np.uint64(64 - GRAM_BITS)
    return Words(distinct, grams.astype(np.int32), first_gram, sequence.astype(np.int32), first)


def read_all_words(texts: list[str]) -> Words:
    """The words of many texts, read in slices of bounded size."""
    parts, at = [], 0
    sizes = np.cumsum([len(t) for t in texts])
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + 500_000, "right")))
        parts.append(read_words(as_texts(pa.array(texts[at:to], pa.string()))))
        at = to
    hashes = np.concatenate([p.hashes for p in parts])
    distinct, place, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    before = np.cumsum([0] + [len(p.hashes) for p in parts])
    sizes = np.concatenate([np.diff(p.gram_first) for p in parts])
    joined = Words(hashes, np.concatenate([p.grams for p in parts]), np.concatenate([[0], np.cumsum(sizes)]), np.zeros(0, np.int32), np.zeros(1, np.int64))
    kept = subset(joined, place)
    sequence = np.concatenate([inverse[b + p.sequence] for b, p in zip(before.tolist(), parts, strict=False)]).astype(np.int32)
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.first) for p in parts]))])
    return Words(distinct, kept.grams, kept.gram_first, sequence, first)


def windows(first: np.ndarray, window: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and length of each window, and the first window of each document (one more at the end)."""
    n = np.diff(first)
    count = np.where(n <= window, 1, -(-(n - window) // stride) + 1)
    at = np.concatenate([[0], np.cumsum(count)])
    document = np.repeat(np.arange(len(n)), count)
    begin = (np.arange(len(document)) - at[document]) * stride
    return first[document] + begin, np.minimum(n[document] - begin, window), at


class Network:
    """Parameters and arithmetic of the network; arrays are float32."""

    def __init__(self, known: np.ndarray, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape, by: (r.standard_normal(shape) * by).astype(np.float32)
        self.known = known  # sorted hashes of words with a vector of their own
        self.p = {"words": draw(len(known) + 1, WIDTH, by=0.1), "grams": draw(1 << GRAM_BITS, WIDTH, by=0.1)}
        for side in "fb":
            self.p |= {f"W{side}": draw(WIDTH, 3 * HIDDEN, by=0.4), f"U{side}": draw(HIDDEN, 3 * HIDDEN, by=0.25), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": draw(2 * HIDDEN, ATTENTION, by=0.3), "a": np.zeros(ATTENTION, np.float32), "v": draw(ATTENTION, by=0.5), "w": draw(2 * HIDDEN, by=0.3), "o": np.zeros(1, np.float32)}
        self.p["words"][-1] = 0

    def own(self, words: Words) -> np.ndarray:
        """Which vector of its own each distinct word has; the last one, of zeros, if none."""
        if not len(self.known):
            return np.zeros(len(words.hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, words.hashes), len(self.known) - 1)
        return np.where(self.known[at] == words.hashes, at, len(self.known))

    def vectors(self, words: Words) -> np.ndarray:
        """The input vector of each distinct word, with one of zeros behind them for places past a window's end."""
        out = np.zeros((len(words.hashes) + 1, WIDTH), np.float32)
        own = self.own(words)
        for a in range(0, len(words.hashes), 20_000):  # in blocks, for the n-grams' vectors take much room
            b = min(a + 20_000, len(words.hashes))
            first = words.gram_first[a : b + 1]
            n = np.sqrt(np.diff(first)).astype(np.float32)
            out[a:b] = np.add.reduceat(self.p["grams"][words.grams[first[0] : first[-1]]], first[:-1] - first[0], axis=0) / n[:, None]
            out[a:b] += self.p["words"][own[a:b]]
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows; index (windows x places) names rows of x, of which the last is no word."""
        with np.errstate(over="ignore"):
            return self._forward(x, index, keep)

    def _forward(self, x: np.ndarray, index: np.ndarray, keep: bool):
        p, (rows, steps) = self.p, index.shape
        mask = (index < len(x) - 1).astype(np.float32)
        states = np.empty((rows, steps, 2 * HIDDEN), np.float32)
        memo = {}
        for side, order, part in (("f", range(steps), slice(0, HIDDEN)), ("b", range(steps - 1, -1, -1), slice(HIDDEN, None))):
            ready = x @ p[f"W{side}"] + p[f"c{side}"]
            U, h = p[f"U{side}"], np.zeros((rows, HIDDEN), x.dtype)
            trail = []
            for t in order:
                g, u = ready.take(index[:, t], axis=0), h @ U
                g[:, : 2 * HIDDEN] += u[:, : 2 * HIDDEN]
                gates = squash(g[:, : 2 * HIDDEN].copy())
                reset, stay = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = reset * u[:, 2 * HIDDEN :]
                new += g[:, 2 * HIDDEN :]
                np.tanh(new, out=new)
                before = h
                h = new - before
                h *= mask[:, t, None] * (1 - stay)
                h += before
                states[:, t, part] = h
                if keep:
                    trail.append((t, before, reset, stay, new, u[:, 2 * HIDDEN :]))
            memo[side] = trail
        inner = np.tanh(states @ p["A"] + p["a"])
        energy = np.where(mask > 0, inner @ p["v"], -1e9)
        weight = np.exp(energy - energy.max(1, keepdims=True)) * mask
        weight /= np.maximum(weight.sum(1, keepdims=True), 1e-9)
        pooled = (weight[:, :, None] * states).sum(1)
        logit = pooled @ p["w"] + p["o"][0]
        return (logit, (mask, states, memo, inner, weight, pooled)) if keep else logit

    def gradients(self, words: Words, x: np.ndarray, index: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the mean cross-entropy for every parameter."""
        p = self.p
        logit, (mask, states, memo, inner, weight, pooled) = self.forward(x, index, keep=True)
        d = ((sigmoid(logit) - label) / len(label)).astype(np.float32)
        out = {"w": d @ pooled, "o": d.sum(keepdims=True)}
        d_pooled = d[:, None] * p["w"]
        d_states = weight[:, :, None] * d_pooled[:, None]
        d_weight = (states * d_pooled[:, None]).sum(2)
        d_energy = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
        d_inner = d_energy[:, :, None] * p["v"] * (1 - inner**2)
        out["v"] = np.einsum("bt,bta->a", d_energy, inner)
        out["A"], out["a"] = np.einsum("bth,bta->ha", states, d_inner), d_inner.sum((0, 1))
        d_states += d_inner @ p["A"].T
        d_x = np.zeros_like(x)
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            U, W = p[f"U{side}"], p[f"W{side}"]
            d_U, d_h = np.zeros_like(U), np.zeros((len(label), HIDDEN), np.float32)
            d_g = np.zeros((len(label), index.shape[1], 3 * HIDDEN), np.float32)
            for t, before, reset, stay, new, u in reversed(memo[side]):
                d_h = d_h + d_states[:, t, part]
                m = mask[:, t, None]
                d_new = d_h * m * (1 - stay) * (1 - new**2)
                d_stay = d_h * m * (before - new) * stay * (1 - stay)
                d_reset = d_new * u * reset * (1 - reset)
                d_u = np.concatenate([d_reset, d_stay, d_new * reset], 1)
                d_g[:, t] = np.concatenate([d_reset, d_stay, d_new], 1)
                d_U += before.T @ d_u
                d_h = d_h * (1 - m * (1 - stay)) + d_u @ U.T
            flat = d_g.reshape(-1, 3 * HIDDEN)
            at = index.reshape(-1)
            out[f"U{side}"], out[f"c{side}"], out[f"W{side}"] = d_U, flat.sum(0), x[at].T @ flat
            np.add.at(d_x, at, flat @ W.T)
        used = np.unique(index)
        used = used[used < len(x) - 1]
        out["words"], out["grams"] = np.zeros_like(p["words"]), np.zeros_like(p["grams"])
        np.add.at(out["words"], self.own(words)[used], d_x[used])
        out["words"][-1] = 0
        n = np.diff(words.gram_first)[used]
        rows = np.repeat(words.gram_first[used], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        np.add.at(out["grams"], words.grams[rows], np.repeat(d_x[used] / np.sqrt(n)[:, None], n, axis=0))
        return out

    def documents(self, words: Words, window: int, stride: int, batch: int = 2048) -> tuple[np.ndarray, np.ndarray, tuple]:
        """The worst logit of each document, the window that has it, and all windows."""
        begin, length, first = windows(words.first, window, stride)
        x, logit = self.vectors(words), np.empty(len(begin), np.float32)
        order = np.argsort(length, kind="stable")  # windows of like length together, so few places are empty
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            logit[part] = self.forward(x, places(words, begin[part], length[part], len(x) - 1))
        top = np.maximum.reduceat(logit, first[:-1]) if len(first) > 1 else np.zeros(0, np.float32)
        which = np.flatnonzero(logit == np.repeat(top, np.diff(first)))
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))[which]
        return top, which[np.unique(owner, return_index=True)[1]], (begin, length, first)


def places(words: Words, begin: np.ndarray, length: np.ndarray, nothing: int) -> np.ndarray:
    """The numbers of the words in windows, as a matrix."""
    steps = np.arange(max(1, int(length.max(initial=1))))
    at = np.minimum(begin[:, None] + steps, max(len(words.sequence) - 1, 0))
    found = words.sequence[at] if len(words.sequence) else np.zeros(at.shape, np.int32)
    return np.where(steps < length[:, None], found, nothing)


def fit(texts: list[str], labels: np.ndarray, window: int = 64, stride: int = 32, epochs: int = 6, batch: int = 64, least: int = 3, seed: int = 7, steps: int = 150) -> Network:
    """Train a network on documents, in more rounds if these would make fewer than ``steps`` steps."""
    epochs = max(epochs, -(-steps * batch // max(len(labels), 1)))
    words = read_all_words(texts)
    labels = np.asarray(labels, np.float32)
    owner = np.repeat(np.arange(len(labels)), np.diff(words.first))
    pairs = np.unique(owner * (len(words.hashes) + 1) + words.sequence)
    document, word = pairs // (len(words.hashes) + 1), pairs % (len(words.hashes) + 1)
    held = np.bincount(word, minlength=len(words.hashes))
    of_words = odds(np.bincount(word, labels[document], len(words.hashes)), held, labels)
    common = np.flatnonzero(held >= least)
    net = Network(words.hashes[common], seed)
    of_grams = gram_odds(words, document, word, labels)
    net.p["words"][:-1, 0], net.p["grams"][:, 0] = of_words[common] * 0.7, of_grams * 0.3
    begin, length, first = windows(words.first, window, stride)
    strength = np.append(np.where(held >= least, of_words, 0) + (np.maximum.reduceat(of_grams.astype(np.float32)[words.grams], words.gram_first[:-1]) if len(words.hashes) else 0), -9)
    peak = np.empty(len(begin))
    for at in range(0, len(begin), 4096):
        peak[at : at + 4096] = strength[places(words, begin[at : at + 4096], length[at : at + 4096], len(strength) - 1)].max(1)
    chosen = np.array([a + int(np.argmax(peak[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
    r = np.random.default_rng(seed)
    first_moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    second_moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        if epoch >= 2:
            _, chosen, _ = net.documents(words, window, stride)
        order = r.permutation(len(labels))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            index = places(words, begin[chosen[part]], length[chosen[part]], len(words.hashes))
            # only the words of this step get vectors
            used, index = np.unique(np.append(index.reshape(-1), len(words.hashes)), return_inverse=True)
            index = index[:-1].reshape(len(part), -1)
            some = subset(words, used[:-1])
            grads = net.gradients(some, net.vectors(some), index, labels[part])
            step += 1
            for k, g in grads.items():
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * g
                second_moment[k] = 0.99 * second_moment[k] + 0.01 * g * g
                net.p[k] -= (0.01 * (first_moment[k] / (1 - 0.9**step)) / (np.sqrt(second_moment[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def odds(ones: np.ndarray, held: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Log-odds of label 1, smoothed and bounded, of what ``ones`` documents with that label and ``held`` in all have."""
    return np.clip(np.log((ones + 0.5) / max(labels.sum(), 1)) - np.log((held - ones + 0.5) / max((1 - labels).sum(), 1)), -3, 3)


def gram_odds(words: Words, document: np.ndarray, word: np.ndarray, labels: np.ndarray, block: int = 100_000) -> np.ndarray:
    """Log-odds of each n-gram, counted once in each document; (document, word) pairs are sorted by document."""
    n = np.diff(words.gram_first)
    size = 1 << GRAM_BITS
    ones, held, at = np.zeros(size), np.zeros(size), 0
    while at < len(document):
        to = int(np.searchsorted(document, document[min(at + block, len(document)) - 1], "right"))
        d, w = document[at:to] - document[at], word[at:to]
        k = n[w]
        rows = np.repeat(words.gram_first[w], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        pairs = np.unique(np.repeat(d, k) * size + words.grams[rows])
        ones += np.bincount(pairs % size, labels[document[at] + pairs // size], size)
        held += np.bincount(pairs % size, minlength=size)
        at = to
    return odds(ones, held, labels)


def subset(words: Words, used: np.ndarray) -> Words:
    """Some of the distinct words with their n-grams."""
    n = np.diff(words.gram_first)[used]
    rows = np.repeat(words.gram_first[used], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return Words(words.hashes[used], words.grams[rows], np.concatenate([[0], np.cumsum(n)]), np.zeros(0, np.int32), np.zeros(1, np.int64))


def train(docs: DataFrame, labels: DataFrame, per_label: tuple[int, int] = (2000, 1000), most_bytes: int = 32_000_000) -> Network | None:
    """Fit a network on documents joined with their labels (doc_id, toxic 0 or 1); None if there are none."""
    marked = only(labels, doc_id="long", toxic="int").where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    counts = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # two rows
    rates = {k: min(1.0, per_label[k] / max(counts.get(k, 0), 1)) for k in (0, 1)}
    chance = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) / 1_000_000
    rate = F.create_map(*[x for k, v in rates.items() for x in (F.lit(k), F.lit(v))])[F.col("toxic")]
    # the sample's size is bounded by per_label, so it goes to the documents
    sample = F.broadcast(marked.where(chance < rate))
    texts = only(docs, doc_id="long", text="string").where(F.col("text").isNotNull() & (F.octet_length("text") <= most_bytes // 10)).join(sample, "doc_id")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = texts.where(chance < rate * min(1.0, most_bytes / max(size, 1))).select("doc_id", "text", "toxic").toArrow()
    if not found.num_rows:
        return None
    found = found.sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    return fit(found["text"].to_pylist(), found["toxic"].to_numpy())


def score(docs: DataFrame, net: Network | None, window: int = 64, stride: int = 32) -> DataFrame:
    """The rows of docs with score (0 to 1) and predicted (1 from 0.5 up); they replace columns of these names. Without a network every score is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # bounded by the training sample

    def judge(text: pa.Array) -> pa.Array:
        net = shared.value
        found = [np.zeros(0)]
        for part in slices([pa.RecordBatch.from_arrays([text], ["text"])]):
            if net is None:
                found.append(np.zeros(part.num_rows))
                continue
            top, _, _ = net.documents(read_words(as_texts(part.column("text"))), window, stride)
            found.append(sigmoid(top.astype(np.float64)))
        return pa.array(np.concatenate(found), pa.float64())

    udf = F.arrow_udf(judge, "double")
    own = [(F.col(f"_{i}"), c) for i, c in enumerate(docs.columns) if c.lower() not in ("score", "predicted")]
    scored = numbered(docs).select(*(c for c, _ in own), udf(column(docs, "text").cast("string")).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)).toDF(*(c for _, c in own), "score", "predicted")
