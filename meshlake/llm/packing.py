"""Best-fit packing of documents into sequences of fixed capacity, planned on the histogram of lengths.

Documents are tokenized, ended with one id and cut where they are longer than the capacity. The plan is made
from how many pieces there are of each length (at most ``capacity`` counts, whatever the table's size): a
sequence starts with the longest length left and takes the longest one that still fits until none does, and
that pattern repeats while its counts last. Then each piece takes the planned slot with its rank among the
pieces of its length. Ranks come from windows over (length, bucket) with the counts of earlier buckets added,
so a length that most pieces share is not ranked in one task.

Null and empty texts give one piece with the end id alone; null doc_ids stay null. Repeated rows are packed as often as they occur;
ties between pieces of one length go by their numbers in the written table of pieces. Long texts are cut into pieces of whole capacity and a
rest. An empty table gives an empty result. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm import bpe
from meshlake.llm.columns import only
from meshlake.llm.scratch import keep
from meshlake.llm.textarrays import slices


def pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, if asked for) of every piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(vocabulary)
        for part in slices(batches):
            ids, counts = model.encode_texts(bpe.strings(part.column("text")))
            raw, end = ids.astype("<u4").tobytes(), int(end_id).to_bytes(4, "little")
            ends = np.cumsum(counts)
            n_pieces = counts // capacity + 1  # with the end id
            row = np.repeat(np.arange(len(counts)), n_pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * capacity
            length = np.minimum(counts[row] + 1 - start, capacity)
            begin = (ends - counts)[row] + start
            stop = np.minimum(begin + capacity, ends[row])
            last = start + length == counts[row] + 1
            bodies = [raw[4 * a : 4 * b] + end * z for a, b, z in zip(begin.tolist(), stop.tolist(), last.tolist(), strict=True)]
            columns = [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in bodies], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in bodies], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return only(docs, doc_id="long", text="string").mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of slots (length, first rank, ranks, first sequence, offset, places in a sequence).

    Of a run, rank r (from its first) lies in sequence first + r // places at offset + (r % places) * length.
    Each pattern uses up a length or leaves fewer of it than the pattern takes, so there are few patterns.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    runs, sequence = [], 0
    while lengths:
        room, pattern = capacity, []
        at = len(lengths) - 1
        while at >= 0:
            n = lengths[at]
            if n <= room and left[n]:
                take = min(room // n, left[n])
                pattern.append((n, take))
                room -= take * n
            at = min(at - 1, int(np.searchsorted(lengths, room, "right")) - 1)
        times = min(left[n] // take for n, take in pattern)
        offset = 0
        for n, take in pattern:
            runs.append((n, used[n], times * take, sequence, offset, take))
            used[n] += times * take
            left[n] -= times * take
            offset += take * n
        lengths = [n for n in lengths if left[n]]
        sequence += times
    return runs


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; with_ids adds the tokens themselves."""
    spark = docs.sparkSession
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # numbers of the written rows deal out a length, so neither a null nor a repeated doc_id makes a hot bucket
    all_pieces = keep(pieces(docs, vocabulary, capacity, end_id, with_ids).withColumn("row", F.monotonically_increasing_id())).withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    sizes = all_pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keep(sizes.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))
    histogram = {int(r["length"]): int(r["n"]) for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs = plan(histogram, capacity)
    # at most some entries for each length; sorted by (length, first rank), so a piece finds its run by bisection
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run = table[np.searchsorted(keys, (n << 44) + rank, "right") - 1]
            within = rank - run[:, 1]
            placed = {"sequence_id": run[:, 3] + within // run[:, 5], "offset": run[:, 4] + within % run[:, 5] * n}
            names = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(x) for x in placed.values()], names + list(placed))

    within = Window.partitionBy("length", "bucket").orderBy("row")
    ranked = all_pieces.withColumn("nth", F.row_number().over(within) - 1).join(sizes.select("length", "bucket", "before").hint("merge"), ["length", "bucket"])  # dealt out by these columns already
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, " + "ids array<int>, " * with_ids + "sequence_id long, offset long"
    return ranked.select(*columns, (F.col("before") + F.col("nth")).cast("long").alias("rank")).mapInArrow(place, schema)
