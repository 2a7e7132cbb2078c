r"""Phrases of 2 to 4 words whose words stand together far more often than apart, by language.

Texts (null: empty; A-Z lower-cased) are split at ``[.,;:!?\x0A-\x0D]`` into pieces and these into words ``[^\x20\x09]+``. Everything is
counted within a language (null: ``und``), over all occurrences, overlaps included.

* Identical pieces of a language become one with its multiplicity: within a task first, then by a shuffle.
* Pieces are packed into chunks. Every chunk tells the weighted counts of its one- and two-word hashes; duckdb adds them up out of core, one hash bucket
  a task, and the bucket answers the chunks that asked which of their hashes are frequent.
* Longer phrases are looked for only where all pairs of words within are frequent, which no frequent phrase fails. Chunks then tell
  phrases as text with their weights, and duckdb adds these up exactly, again by hash buckets: hash collisions can't change a count.
* Counts of a phrase's parts come by lookup requests that are shuffled to the parts; the worst cut scores.

A language's rows may be all of the table: no step holds a language together but for the last, of ``top`` rows a task. Repeated rows count as often as they stand; ties
are settled by the stated order; texts of any length are taken whole. Other columns don't matter. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.columns import only
from meshlake.llm.scratch import forget, keep
from meshlake.llm.textarrays import _symbols, give_back, mix, slices, span_hashes

#: Bytes of pieces in a chunk.
CHUNK = 4_000_000
#: Counts that a hash bucket has, as a mean.
BUCKET = 4_000_000
#: duckdb's memory for a bucket; the rest goes to its temporary files.
MEMORY = "300MB"
#: Rows that duckdb takes or gives at once.
TOGETHER = 50_000
STOPS = re.compile(rb"[.,;:!?\n-\r]")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
LONGEST = 4


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words with one space between), times; docs has lang and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            found: Counter = Counter()
            for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
                found.update((lang, b" ".join(p.split())) for p in STOPS.split(text.encode().translate(LOWER)))
            langs, parts = zip(*found, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(parts, pa.binary()).cast(pa.string()), pa.array(found.values(), pa.int64())], ["lang", "piece", "times"])
            yield out

    return docs.where("text IS NOT NULL").mapInArrow(cut, "lang string, piece string, times long").where("piece <> ''").groupBy("lang", "piece").agg(F.sum("times").alias("times"))


def chunks(rows: DataFrame) -> DataFrame:
    """chunk, lang, words (occurrences), data (pieces, a line each), times (64-bit numbers)."""

    def packed(lang: str, texts: list[str], times: list[int]) -> pa.RecordBatch:
        times = np.array(times, np.int64)
        words = int(((np.array([x.count(" ") for x in texts]) + 1) * times).sum())
        columns = [pa.array([lang]), pa.array([words]), pa.array(["\n".join(texts).encode()], pa.binary()), pa.array([times.tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "words", "data", "times"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            for lang, piece, times in zip(*(batch.column(c).to_pylist() for c in ("lang", "piece", "times")), strict=True):
                own = held.setdefault(lang, [[], [], 0])
                own[0].append(piece)
                own[1].append(times)
                own[2] += len(piece)
                if own[2] >= CHUNK:
                    yield packed(lang, own[0], own[1])
                    del held[lang]
        for lang, own in held.items():
            yield packed(lang, own[0], own[1])

    return rows.mapInArrow(pack, "lang string, words long, data binary, times binary").select(F.monotonically_increasing_id().alias("chunk"), "lang", "words", "data", "times")


class Words:
    """The words of a chunk: where they begin and end, their pieces' multiplicities, and hashes of runs of words."""

    def __init__(self, lang: str, data: bytes, times: bytes):
        raw = np.frombuffer(data, np.uint8)
        line = raw == 10
        breaks = np.flatnonzero((raw == 32) | line)
        self.starts, self.ends = np.append(0, breaks + 1), np.append(breaks, len(raw))
        self.piece = np.append(0, np.cumsum(line[breaks]))
        self.times = np.frombuffer(times, np.int64)[self.piece]
        seed = span_hashes(_symbols()[np.frombuffer(lang.encode() + b"\n", np.uint8)], np.array([0]), np.array([len(lang.encode()) + 1]))
        self.word = mix(span_hashes(_symbols()[raw], self.starts, self.ends) + seed)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of n words within a piece, and the runs' hashes."""
        m = len(self.word) - n + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.piece[:m] == self.piece[n - 1 :])
        hashes = self.word[at]
        for j in range(1, n):
            hashes = mix(hashes * np.uint64(31) + self.word[at + j])
        return at, hashes

    def counted(self, at: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each hash once, the first run that has it, and its weight."""
        if not len(at):
            return hashes, at, at
        order = np.argsort(hashes, kind="stable")
        sorted_ = hashes[order]
        first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1]))
        return sorted_[first], at[order[first]], np.add.reduceat(self.times[at[order]], first)


def short_runs(packed: DataFrame) -> DataFrame:
    """hash, chunk, times of the runs of one and two words of every chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, lang, data, times = (batch.column(c)[i].as_py() for c in ("chunk", "lang", "data", "times"))
                words = Words(lang, data, times)
                for n in (1, 2):
                    hashes, _, weight = words.counted(*words.runs(n))
                    yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.full(len(hashes), chunk)), pa.array(weight)], ["hash", "chunk", "times"])
                give_back()

    return packed.select("chunk", "lang", "data", "times").mapInArrow(count, "hash long, chunk long, times long")


def phrases(asked: DataFrame) -> DataFrame:
    """lang, phrase, times of the frequent words and pairs of every chunk, and of longer runs all of whose pairs are frequent; asked has frequent (hashes) besides a chunk's columns."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lang, data, times = (batch.column(c)[i].as_py() for c in ("lang", "data", "times"))
                frequent = np.sort(batch.column("frequent")[i].values.to_numpy(zero_copy_only=False).view(np.uint64))
                words, pair = Words(lang, data, times), None
                for n in range(1, LONGEST + 1):
                    at, hashes = words.runs(n)
                    if n <= 2:
                        found = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
                        if n == 2:
                            pair = np.zeros(len(words.word), bool)
                            pair[at[found]] = True
                    else:
                        found = np.logical_and.reduce([pair[at + j] for j in range(n - 1)])
                    _, first, weight = words.counted(at[found], hashes[found])
                    texts = [data[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[first + n - 1].tolist(), strict=True)]
                    for low in range(0, len(texts), 50_000):
                        part = pa.array(texts[low : low + 50_000], pa.binary()).cast(pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(weight[low : low + 50_000])], ["lang", "phrase", "times"])
                give_back()

    return asked.select("lang", "data", "times", "frequent").mapInArrow(tell, "lang string, phrase string, times long")


def in_buckets(rows: DataFrame, keys: list[str], n: int, columns: str, types: str, query: str) -> DataFrame:
    """The query's result in duckdb over ``t``, the rows of each of n hash buckets of the keys; the database lives in the task's folder for as long as the task."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        folder = tempfile.mkdtemp(prefix="bucket-")
        con = duckdb.connect(f"{folder}/t.db", config={"memory_limit": MEMORY, "temp_directory": f"{folder}/spill", "threads": 1, "preserve_insertion_order": False})
        try:
            con.execute(f"CREATE TABLE t ({columns})")
            held: list[pa.RecordBatch] = []

            def insert() -> None:
                con.register("batch", pa.Table.from_batches(held))
                con.execute("INSERT INTO t SELECT * FROM batch")
                con.unregister("batch")
                held.clear()

            for batch in batches:
                held.append(batch)
                if sum(x.num_rows for x in held) >= TOGETHER:
                    insert()
            if held:
                insert()
            yield from con.sql(query).to_arrow_reader(TOGETHER)
        finally:
            con.close()
            shutil.rmtree(Path(folder))
            give_back()

    return rows.repartition(n, *keys).mapInArrow(add_up, types)


def frequent_phrases(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """lang, phrase (1 to 4 words), f of those with f >= least; and lang, n (word occurrences)."""
    spark = docs.sparkSession
    rows = only(docs, lang="string", text="string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    packed = keep(chunks(pieces(rows)))
    sizes = packed.groupBy("lang").agg(F.sum("words").alias("n"), F.sum(F.octet_length("data")).alias("bytes"))
    total = packed.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    least_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least_parts, total // 3 // BUCKET)  # a word and a pair for every six bytes
    counts = short_runs(packed)
    query = f"SELECT chunk, hash FROM t WHERE hash IN (SELECT hash FROM t GROUP BY hash HAVING sum(times) >= {least})"
    answers = keep(in_buckets(counts, ["hash"], buckets, "hash BIGINT, chunk BIGINT, times BIGINT", "chunk long, hash long", query))
    asked = packed.join(answers.groupBy("chunk").agg(F.collect_list("hash").alias("frequent")), "chunk")
    query = f"SELECT lang, phrase, CAST(sum(times) AS BIGINT) AS f FROM t GROUP BY lang, phrase HAVING sum(times) >= {least}"
    told = phrases(asked).repartition(buckets, "lang", "phrase")
    found = keep(in_buckets(told, ["lang", "phrase"], buckets, "lang VARCHAR, phrase VARCHAR, times BIGINT", "lang string, phrase string, f long", query))
    forget(answers)
    return found, sizes.select("lang", "n")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score of each language's best phrases: by score, a, then phrase."""
    found, sizes = frequent_phrases(docs, least)
    sizes = keep(sizes)
    known = found.withColumn("words", F.split("phrase", " ")).withColumn("k", F.size("words"))
    candidates = known.where("k > 1").withColumnRenamed("f", "a")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = candidates.select("lang", "phrase", "a", "words", "k", cut)
    sides = F.explode(F.array(*(F.struct(F.lit(i).alias("side"), F.array_join(x, " ").alias("part")) for i, x in enumerate((F.slice("words", 1, F.col("cut")), F.slice("words", F.col("cut") + 1, F.col("k")))))))
    requests = cuts.select("lang", "phrase", "a", "cut", sides.alias("x")).select("lang", "phrase", "a", "cut", "x.side", "x.part")
    parts = found.select("lang", F.col("phrase").alias("part"), "f")
    answers = keep(requests.join(parts, ["lang", "part"]))
    answers = answers.groupBy("lang", "phrase", "a", "cut").agg(*(F.max(F.when(F.col("side") == i, F.col("f"))).alias(c) for i, c in enumerate("lr")))
    score = F.expr("2000000BD * CAST(a AS DECIMAL(20)) div (CAST(l AS DECIMAL(20)) + CAST(r AS DECIMAL(20)))")
    scored = answers.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("worst"))
    inner = [(low, n) for n in range(2, LONGEST) for low in range(1, LONGEST - n + 2)]
    within = F.array(*(F.when(low + n - 1 <= F.col("k"), F.array_join(F.slice("words", low, n), " ")) for low, n in inner))
    longer = candidates.where("k > 2").select("a", "lang", "phrase", F.explode(within).alias("part")).where("part <> phrase")
    longer = longer.groupBy("lang", F.col("part").alias("phrase")).agg(F.max("a").alias("longer"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where("longer IS NULL OR 100BD * CAST(longer AS DECIMAL(20)) < 80BD * CAST(a AS DECIMAL(20))")
    kept = kept.select("lang", "phrase", "a", "worst.l", "worst.r", "worst.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    lane = F.pmod(F.xxhash64("phrase"), F.lit(64))
    best = kept.withColumn("lane", lane).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order))).where(F.col("rank") <= top)
    best = keep(best.drop("lane")).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
