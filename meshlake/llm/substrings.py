"""Removal of every byte that a repeated string of ``width`` bytes covers, by suffix arrays of shards that Spark deals out.

* Every string of ``width`` bytes is keyed by the least hash of the shorter grams within it, so equal strings have equal keys. Neighbouring
  strings with one key form a segment (at most ``LONGEST`` strings), a row of its key, its place and a hash of its bytes.
* Keys with one segment in all go, but for those whose least gram occurs twice near each other: strings may repeat within such a segment. Equal segments of a key become one with a count; if a key has no other, all its strings are repeated.
* The bytes of the other segments are cut out of one of their documents each and dealt to shards by key. A shard's segments form one text whose suffix
  array is made by induced sorting; strings whose permuted common prefix with a neighbour reaches ``width`` are repeated. Documents never
  meet within a string, for segments are parted by a symbol of their own.
* A key with more bytes than a shard (``HEAVY``) is cut into several lots, each in a shard of its own choice. Strings of such keys that a shard has found once
  meet those of other lots by their hashes, so no shard grows with a key.
* Runs of repeated strings go back to all documents that have the segment, and their bytes are cut out.

Documents are told apart by doc_id and a hash of their text; rows that repeat both are documents of their own, each a copy of the other. Null texts
count as empty; a null doc_id is like any other. Texts of any length are taken whole, in blocks. An empty table gives an empty result. Other columns
are returned as they are, whatever their names; only columns named ``spans`` and ``kept`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.columns import column, numbered
from meshlake.llm.scratch import forget, keep
from meshlake.llm.suffixes import common_prefixes, suffix_array
from meshlake.llm.textarrays import _symbols, as_texts, give_back, slices, span_hashes

#: Places of a text that are held as arrays at once.
BLOCK = 400_000
#: Strings of a segment at most.
LONGEST = 1 << 16
#: Bytes of a shard, as a mean.
SHARD = 2_000_000
#: Bytes of a lot of one key, as a mean: a key that fills a shard by itself is cut.
HEAVY = SHARD


def _least(hashes: np.ndarray, window: int) -> np.ndarray:
    """The least of every so many hashes in a row."""
    n = len(hashes)
    rows = np.concatenate([hashes, np.full(-n % window, np.uint64(2**64 - 1))]).reshape(-1, window)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - window + 1], ahead[window - 1 : n])


def cut_segments(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, ...]]:
    """document, start, strings, key, segment hash and whether the key's gram stands twice, of the segments of texts laid one after another, block by block."""
    gram = max(1, width * 8 // 25)
    window = width - gram + 1
    for low in range(0, len(data) - width + 1, BLOCK):
        part = data[low : low + BLOCK + width - 1]
        symbols = _symbols()[part]
        at = np.arange(len(part) - gram + 1)
        grams = span_hashes(symbols, at, at + gram)
        keys = _least(grams, window)
        # a gram is the least of some string if it is the greatest of the least of all strings around it
        rest = np.zeros(window - 1, np.uint64)
        used = np.sort(grams[grams == ~_least(~np.concatenate([rest, keys, rest]), window)])
        twice = used[1:][used[1:] == used[:-1]]
        at = low + np.arange(len(keys))
        document = np.searchsorted(offsets, at, "right") - 1
        whole = at + width <= offsets[document + 1]
        new = whole.copy()
        new[1:] &= (keys[1:] != keys[:-1]) | (document[1:] != document[:-1])
        start = np.flatnonzero(new)
        inside = np.concatenate([[0], np.cumsum(whole)])
        strings = inside[np.append(start[1:], len(keys))[: len(start)]] - inside[start]
        if (strings > LONGEST).any():
            parts = -(-strings // LONGEST)
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            start, strings = np.repeat(start, parts) + nth * LONGEST, np.minimum(np.repeat(strings, parts) - nth * LONGEST, LONGEST)
        if len(start):
            again = np.zeros(len(start), bool)
            if len(twice):
                again = twice[np.minimum(np.searchsorted(twice, keys[start]), len(twice) - 1)] == keys[start]
            yield document[start], low + start - offsets[document[start]], strings, keys[start], span_hashes(symbols, start, start + strings + width - 1), again


def segments(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, part, start, strings, key, seg, again of every segment; docs has doc_id, part and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            texts = as_texts(rows.column("text"))
            for document, start, strings, key, seg, again in cut_segments(texts.data, texts.offsets, width):
                of = pa.array(document)
                out = [rows.column("doc_id").take(of), rows.column("part").take(of), *(pa.array(x.astype(np.int64)) for x in (start, strings)), *(pa.array(x.view(np.int64)) for x in (key, seg)), pa.array(again)]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "part", "start", "strings", "key", "seg", "again"])

    return docs.where(F.octet_length("text") >= width).mapInArrow(cut, "doc_id long, part long, start long, strings long, key long, seg long, again boolean")


def repeated(texts: list[bytes], many: np.ndarray, cut: np.ndarray, width: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Runs (segment, at, strings) of repeated strings of a shard, and the open strings of cut segments (segment, at, hash).

    many: segments that stand for several equal ones. An open string was found once; for repeated strings of cut segments one of each kind is told with the segment -1.
    """
    lengths = np.array([len(x) for x in texts])
    starts = np.cumsum(lengths + 1) - lengths - 1
    data = np.frombuffer(b"\0".join(texts), np.uint8)
    t = np.zeros(len(data) + 1, np.uint16)
    t[:-1] = data
    t[:-1] += 1
    t[starts[1:] - 1] = 257
    before, shared = common_prefixes(t, suffix_array(t, 258))
    segment = np.repeat(np.arange(len(texts)), lengths + 1)
    within = np.arange(len(t)) - starts[segment]
    whole = within + width <= lengths[segment]
    reaches = whole & (shared >= width)
    again = reaches.copy()
    again[before[reaches]] = True
    again |= whole & many[segment]
    edge = again.copy()
    edge[1:] &= ~again[:-1] | (segment[1:] != segment[:-1])
    first = np.flatnonzero(edge)
    counted = np.concatenate([[0], np.cumsum(again)])
    runs = segment[first], within[first], counted[np.append(first[1:], len(t))[: len(first)]] - counted[first]
    alone, told = np.flatnonzero(whole & ~again & cut[segment]), np.flatnonzero(again & ~reaches & cut[segment])
    at = np.concatenate([alone, told])
    hashes = span_hashes(_symbols()[np.append(data, np.uint8(0))], at, at + width)
    return runs, (np.concatenate([segment[alone], np.full(len(told), -1)]), within[at], hashes)


def shard_repeats(dealt: DataFrame, width: int) -> DataFrame:
    """key, seg, at, strings, string (null but for open strings, whose key and seg are null where one is only told); dealt has shard, key, seg, many, cut, bytes, sorted by shard."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
        now, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("shard", "key", "seg", "many", "cut", "bytes")), strict=True):
                if row[0] != now and rows:
                    yield rows
                    rows = []
                now = row[0]
                rows.append(row[1:])
        if rows:
            yield rows

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in shards(batches):
            rows = list({r[:2]: r for r in rows}.values())  # a repeated row of documents gives its bytes again
            key, seg, many, cut, texts = zip(*rows, strict=True)
            (s, at, strings), (o, o_at, hashes) = repeated(list(texts), np.array(many), np.array(cut), width)
            key, seg = np.array(key, np.int64), np.array(seg, np.int64)
            none = pa.nulls(len(s), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key[s]), pa.array(seg[s]), pa.array(at[: len(s)]), pa.array(strings), none], ["key", "seg", "at", "strings", "string"])
            told = o < 0
            open_ = [pa.array(key[o], mask=told), pa.array(seg[o], mask=told), pa.array(o_at), pa.array(np.ones(len(o), np.int64)), pa.array(hashes.view(np.int64))]
            yield pa.RecordBatch.from_arrays(open_, ["key", "seg", "at", "strings", "string"])
            give_back()

    return dealt.mapInArrow(find, "key long, seg long, at long, strings long, string long")


def repeats(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, part, low, high of runs of bytes that repeated strings cover (they may overlap); docs has doc_id, part and text."""
    every = keep(segments(docs, width))
    often = keep(every.groupBy("key").agg(F.count("*").alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("key"))
    hits = keep(every.join(often, "key"))
    forget(every, often)
    kinds = hits.groupBy("key", "seg").agg(F.min(F.struct("doc_id", "part", "start", "strings")).alias("one"), F.count("*").alias("n"))
    kinds = keep(kinds.select("key", "seg", (F.col("n") > 1).alias("many"), "one.*"))
    n_bytes = F.col("strings") + width - 1
    keys = keep(kinds.groupBy("key").agg(F.count("*").alias("kinds"), F.sum(n_bytes).alias("bytes")))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    known = kinds.join(keys, "key")
    alike = known.where("kinds = 1 AND many").select("key", "seg", F.lit(0).cast("long").alias("at"), "strings")
    lots = F.ceil(F.col("bytes") / HEAVY)
    shard = F.pmod(F.xxhash64("key", F.pmod(F.col("seg"), lots)), F.lit(1 + total // SHARD))
    wanted = known.where("kinds > 1 OR NOT many").select("key", "seg", "many", (lots > 1).alias("cut"), shard.alias("shard"), F.col("doc_id").alias("of"), F.col("part").alias("at_part"), "start", n_bytes.alias("n_bytes"))
    texts = docs.where(F.octet_length("text") >= width)
    fetched = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at_part")))
    fetched = fetched.select("shard", "key", "seg", "many", "cut", F.expr("substring(cast(text AS binary), int(start + 1), int(n_bytes))").alias("bytes"))
    found = keep(shard_repeats(fetched.repartition("shard").sortWithinPartitions("shard"), width))
    open_ = found.where("string IS NOT NULL")
    met = open_.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    runs = found.where("string IS NULL").drop("string").union(open_.where("seg IS NOT NULL").join(met, "string").select("key", "seg", "at", "strings")).union(alike)
    low = F.col("start") + F.col("at")
    cover = keep(hits.drop("strings").join(runs, ["key", "seg"]).select("doc_id", "part", low.alias("low"), (low + F.col("strings") + width - 1).alias("high")))
    forget(hits, keys, found)
    return cover


def remove_repeats(docs: DataFrame, width: int = 200) -> DataFrame:
    """The rows of docs with spans (array of start and end of the removed runs of bytes, in order) and kept (the remaining bytes of text, as binary)."""
    rows = numbered(docs)
    text = column(docs, "text").cast("string")
    rows = rows.withColumn("doc_id", column(docs, "doc_id").cast("long")).withColumn("part", F.xxhash64(text))
    cover = repeats(rows.select("doc_id", "part", text.alias("text")), width)
    cover = cover.distinct().groupBy("doc_id", "part").agg(F.collect_list(F.struct("low", "high")).alias("cover"))
    cover = keep(cover).withColumnsRenamed({"doc_id": "of", "part": "of_part"})

    def cut(text: pa.Array, cover: pa.Array) -> pa.Array:
        spans, kept = [], []
        for data, runs in zip(text.cast(pa.large_binary()), cover, strict=True):
            if not runs.is_valid:
                spans.append(None)
                kept.append(None)
                continue
            runs = runs.values.flatten()
            low, high = (x.to_numpy() for x in runs)
            order = np.argsort(low, kind="stable")
            low, high = low[order], np.maximum.accumulate(high[order])
            new = np.append(True, low[1:] > high[:-1])
            first = np.flatnonzero(new)
            low, high = low[first], high[np.append(first[1:], len(high)) - 1]
            spans.append([{"start": a, "end": b} for a, b in zip(low.tolist(), high.tolist(), strict=True)])
            raw = data.as_buffer().to_pybytes()
            kept.append(b"".join(raw[a:b] for a, b in zip([0, *high.tolist()], [*low.tolist(), len(raw)], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.StructArray.from_arrays([pa.array(spans, kind), pa.array(kept, pa.binary())], ["spans", "kept"])

    udf = F.arrow_udf(cut, "spans array<struct<start: long, end: long>>, kept binary").asNondeterministic()
    joined = rows.join(cover, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")), "left")
    done = joined.withColumn("done", udf(F.when(F.col("cover").isNotNull(), text), F.col("cover")))  # only texts that lose bytes go to Python
    nothing = F.array().cast("array<struct<start: bigint, end: bigint>>")
    out: list[tuple[Column, str]] = [(F.col(f"_{i}"), c) for i, c in enumerate(docs.columns) if c.lower() not in ("spans", "kept")]
    whole = F.coalesce(text, F.lit("")).cast("binary")
    return done.select(*(c for c, _ in out), F.coalesce("done.spans", nothing), F.coalesce("done.kept", whole)).toDF(*(c for _, c in out), "spans", "kept")
