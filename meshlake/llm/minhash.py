"""Near-duplicate documents by one-permutation MinHash with optimal densification.

A document's set is its distinct shingles of five words (lower-cased A-Z, words without white space); with fewer
words the whole sequence is one shingle; without words or text the set is empty and links with nothing. One hash of
each shingle gives both its bin (the top bits) and its value; an empty bin takes the value of a bin that a
fixed random sequence, the same for all documents, names first among the filled ones. Six bins make a band, and 42 bands
put a pair with a similarity of 0.75 into a common bucket with probability 0.9997, one with 0.4 with 0.16.

Documents with equal sets form a class at once; one of each stands for all. Links are confirmed on full sets:
100 * intersection >= percent * union. The members of a bucket meet one hub, so a bucket of any size gives fewer
candidate pairs than it has members. Members of buckets that hold several components even then are compared exactly:
their shingles are ordered from rare to frequent, and two sets that are similar enough must share one among the first
few of each (prefix filter), at places that leave room for the rest. So what a whole bucket has in common gives no
pairs, and links between its members are found however many components it holds. Of a shingle's documents only those outside its
largest component meet the others; pairs of one component are never made. Each set also has a map of 512 parity bits: two maps
differ in no more bits than the sets in shingles, so a pair whose maps differ in too many is under the limit for certain and
makes no row (a bitmap filter; for sets of more than about 500 shingles it is weak, and the other filters remain).

Every row counts: equal rows are copies; rows with one doc_id and different texts are different documents that
don't link for that. component_id is the smallest doc_id of the rows reachable, with its own. Null doc_ids link with nothing
(component_id null, kept true). Ties need no rule, as classes and components don't depend on an order. Long texts are taken whole, in slices of
their own. An empty table gives an empty result. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshlake.llm.columns import column, numbered, only
from meshlake.llm.components import components
from meshlake.llm.scratch import forget, keep
from meshlake.llm.textarrays import Texts, as_texts, mix, slices

BINS_BITS, ROWS, BANDS = 8, 6, 42
BINS = 1 << BINS_BITS
#: Rounds of the donor sequence that are tabled; more are computed when a set is so small that these don't reach it.
DONORS = 64
#: Longs of a set's parity map.
MAP = 8
MAP_COLUMNS = [f"map{i}" for i in range(MAP)]
#: Comparisons of one shingle's documents that a task makes at most, about.
TASK_PAIRS = 1 << 24


def shingle_sets(texts: Texts, words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all documents one after another, and where each document's begin (one more at the end)."""
    h, first = texts.word_hashes()
    n = np.diff(first)
    rolled = np.zeros(max(len(h) - words + 1, 0), np.uint64)
    factor = np.uint64(0xD6E8FEB86659FD93)
    for i in range(words):
        rolled = rolled * factor + h[i : len(h) - words + 1 + i] if len(rolled) else rolled
    rolled = mix(rolled)
    document = np.repeat(np.arange(len(n)), np.maximum(n - words + 1, 0))
    at = np.arange(len(document)) - np.repeat(np.cumsum(np.maximum(n - words + 1, 0)) - np.maximum(n - words + 1, 0), np.maximum(n - words + 1, 0))
    values = rolled[first[document] + at] if len(document) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < words))
    if short.size:
        whole = np.empty(len(short), np.uint64)
        for k, i in enumerate(short.tolist()):
            x = n[i : i + 1].astype(np.uint64)
            for w in range(first[i], first[i + 1]):
                x = mix(x * factor + h[w : w + 1])
            whole[k] = x[0]
        document, values = np.concatenate([document, short]), np.concatenate([values, whole])
    order = np.lexsort((values, document))
    document, values = document[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (document[1:] != document[:-1])
    document, values = document[new], values[new]
    return values, np.searchsorted(document, np.arange(len(n) + 1))


@lru_cache(maxsize=1)
def donors() -> np.ndarray:
    """Bin named in each round of the densification, for each empty bin: rounds x bins."""
    return (mix(np.arange(1, DONORS * BINS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - BINS_BITS)).astype(np.int64).reshape(DONORS, BINS)


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Densified one-permutation signatures (documents x bins) of sets; those of empty sets mean nothing."""
    n = len(offsets) - 1
    document = np.repeat(np.arange(n), np.diff(offsets))
    cell = document * BINS + (values >> np.uint64(64 - BINS_BITS)).astype(np.int64)
    lead = np.ones(len(cell), bool)  # sorted within a document, so a bin's least value is its first
    lead[1:] = cell[1:] != cell[:-1]
    out = np.zeros(n * BINS, np.uint64)
    filled = np.zeros(n * BINS, bool)
    out[cell[lead]], filled[cell[lead]] = values[lead], True
    row, column = np.nonzero(~filled.reshape(n, BINS) & (np.diff(offsets) > 0)[:, None])
    have = filled.copy()
    for step in donors():
        if not row.size:
            break
        from_ = row * BINS + step[column]
        hit = have[from_]
        out[(row * BINS + column)[hit]] = out[from_[hit]]
        filled[(row * BINS + column)[hit]] = True
        row, column = row[~hit], column[~hit]
    if row.size:  # small sets: the next filled bin to the right
        grid = have.reshape(n, BINS)
        for r, c in zip(row.tolist(), column.tolist(), strict=True):
            out[r * BINS + c] = out[r * BINS + (c + int(np.argmax(np.roll(grid[r], -c)))) % BINS]
    return out.reshape(n, BINS)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    parts = signature[:, : ROWS * BANDS].reshape(len(signature), BANDS, ROWS)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for i in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return mix(keys + np.arange(keys.shape[1], dtype=np.uint64))


def _names(values: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """A 128-bit name of each set, as two numbers."""
    sums = []
    for k, shift in ((0x9E3779B97F4A7C15, 17), (0xC2B2AE3D27D4EB4F, 23)):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values * np.uint64(k) ^ (values >> np.uint64(shift))))])
        sums.append(pa.array(mix(total[offsets[1:]] - total[offsets[:-1]]).view(np.int64)))
    return sums


def parity_maps(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set, MAP longs of bits, each the parity of the number of shingles that fall on it: sets x MAP."""
    n, bits = len(offsets) - 1, 64 * MAP
    cell = np.repeat(np.arange(n), np.diff(offsets)) * bits + (mix(values) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount(cell, minlength=n * bits).reshape(n, bits) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, part, n (set size), set_a and set_b (the set's name), keys (of the bands; null for empty sets); docs has doc_id, text and part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, offsets = shingle_sets(as_texts(part.column("text")))
            n = np.diff(offsets)
            keys = bands(signatures(values, offsets))
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.reshape(-1).view(np.int64))
            lists = pa.compute.if_else(pa.array(n > 0), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("part"), pa.array(n), *_names(values, offsets), lists], ["doc_id", "part", "n", "set_a", "set_b", "keys"])

    return docs.mapInArrow(run, "doc_id long, part long, n long, set_a long, set_b long, keys array<long>")


def sets(docs: DataFrame) -> DataFrame:
    """set_a, set_b, shingles (array<long>) and the parity map of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            values, offsets = shingle_sets(as_texts(part.column("text")))
            lists = pa.ListArray.from_arrays(offsets.astype(np.int32), values.view(np.int64))
            maps = [pa.array(np.ascontiguousarray(x)) for x in parity_maps(values, offsets).T]
            yield pa.RecordBatch.from_arrays([*_names(values, offsets), lists, *maps], ["set_a", "set_b", "shingles", *MAP_COLUMNS])

    return docs.select("text").mapInArrow(run, ", ".join(["set_a long, set_b long, shingles array<long>", *(f"{x} long" for x in MAP_COLUMNS)]))


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id), one row for each input row."""
    return labelled(docs, percent).select("doc_id", "n_shingles", "component_id", "kept")


def deduplicated(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the text of its smallest doc_id stays, once.

    Rows with a null doc_id and those without words all stay, but for repeats of doc_id and text. Columns stay as they are.
    Whole rows are shuffled once, at any size of the table.
    """
    found = labelled(docs, percent, parts=True).where("doc_id IS NOT NULL AND part IS NOT NULL")
    # of a component that holds several texts of its smallest doc_id, one
    best = found.where("kept AND n_shingles > 0").groupBy("component_id", "root").agg(F.min("part").alias("best"), F.count("*").alias("rows")).where("rows > 1").select("root", "best")
    rows = found.join(keep(best), "root", "left")
    rows = rows.select("doc_id", "part", (F.col("kept") & F.coalesce(F.col("best") == F.col("part"), F.lit(True))).alias("stays"))
    # doc_id and text of rows that go, or that are there more than once
    odd = keep(rows.groupBy("doc_id", "part").agg(F.max("stays").alias("stays"), F.count("*").alias("times")).where("NOT stays OR times > 1"))
    marked = numbered(docs).withColumn("doc_id", column(docs, "doc_id").cast("long")).withColumn("part", F.xxhash64(column(docs, "text").cast("string")))
    left = marked.join(odd.hint("merge"), ["doc_id", "part"], "left").where("stays IS NULL OR stays")
    nth = F.row_number().over(Window.partitionBy("doc_id", "part").orderBy(F.lit(0)))  # dealt out and sorted so by the join
    once = left.withColumn("nth", nth).where("times IS NULL OR nth = 1")
    return once.select(*(f"_{i}" for i in range(len(docs.columns)))).toDF(*docs.columns)


def labelled(docs: DataFrame, percent: int = 75, parts: bool = False) -> DataFrame:
    """doc_id, part (a hash of the text that tells rows of one doc_id apart, if asked for), n_shingles, root (a number of the component; null for empty sets), component_id and kept of every row."""
    plain = only(docs, doc_id="long", text="string")
    described = keep(describe(plain.withColumn("part", F.xxhash64("text") if parts else F.lit(None).cast("long"))).withColumn("row", F.monotonically_increasing_id()))
    filled = described.where("n > 0 AND doc_id IS NOT NULL")
    classes = keep(filled.groupBy("set_a", "set_b").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    buckets = classes.select("node", "n", F.explode("keys").alias("key"))
    several = keep(buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key"))
    members = keep(buckets.join(several, "key"))
    full = full_sets(plain, classes, members)
    pairs = keep(_star_pairs(members, percent))
    links = keep(confirmed(pairs, full, percent))
    roots = keep(components(links))
    rest = keep(_open(members, roots))
    forget(several, members, pairs, links)
    candidates = keep(prefix_pairs(rest, full, percent))
    more = keep(confirmed(candidates, full, percent))
    roots = merged(roots, more)
    forget(rest, candidates, full)
    lowest = roots.join(classes.select("node", F.col("doc_id").alias("least")), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = keep(classes.select("set_a", "set_b", "node", "doc_id").join(keep(roots.join(lowest, "component")), "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("root"), F.coalesce("component_id", "doc_id").alias("component_id")))
    forget(classes)
    out = described.drop("keys").join(of_class, ["set_a", "set_b"], "left")
    real = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    component = F.when(real, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "part", F.col("n").alias("n_shingles"), F.when(real, F.col("root")).alias("root"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def full_sets(docs: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """node, shingles and parity map of every class that has a bucket with others."""
    named = classes.select("node", "doc_id", "set_a", "set_b").join(members.select("node").distinct(), "node", "left_semi")
    named = keep(named)
    texts = docs.join(keep(named.select("doc_id").distinct()), "doc_id", "left_semi")
    found = sets(texts).join(named.select("set_a", "set_b", "node"), ["set_a", "set_b"])
    return keep(found.select("node", "shingles", *MAP_COLUMNS).dropDuplicates(["node"]))  # a document's repeated rows


def _star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, na, nb) of each bucket's hub with its other members of a size that can be similar."""
    order = F.xxhash64("node")  # the same in all bands, so that near copies meet few hubs
    hubs = keep(members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "node", "n")).alias("hub")))
    met = members.join(hubs, "key").where("node <> hub.node").where(f"100 * least(n, hub.n) >= {percent} * greatest(n, hub.n)")
    return met.select(F.col("hub.node").alias("a"), F.col("node").alias("b"), F.col("hub.n").alias("na"), F.col("n").alias("nb")).distinct()


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    one = pairs.join(full.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    both = one.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", "na", "nb", shared.alias("shared")).where(f"100 * shared >= {percent} * (na + nb - shared)").select("a", "b")


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """node, n and component of the members of buckets that hold several components."""
    placed = members.join(roots, "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return placed.join(keep(several), "key").select("node", "n", "component").distinct()


def prefix_pairs(rows: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b, na, nb) of rows (node, n, component) of different components that can be similar enough, and others that pass the filter.

    With all sets in one order of shingles, sets that share the number that a similarity of percent takes also share one
    of the first n - that number + 1 shingles of each; for the smaller set that prefix is shorter. Shingles of one set alone come first and need no row.
    """
    tokens = rows.join(full, "node").select("node", "n", "component", F.explode("shingles").alias("token"))
    often = keep(tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1"))
    held = tokens.join(often, "token").groupBy("node", "n", "component").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("t"))
    held = held.withColumn("m", F.size("t")).join(full.select("node", *MAP_COLUMNS), "node")
    least = F.ceil(percent * F.col("n") / 100)  # shared with a larger set
    equal = F.ceil(2 * percent * F.col("n") / (100 + percent))  # shared with a set as large
    first = held.where(F.col("m") >= least).select("node", "n", "component", "m", *MAP_COLUMNS, F.posexplode(F.slice("t", F.lit(1), (F.col("m") - least + 1).cast("int"))).alias("at", "x"))
    prefix = keep(first.select("node", "n", "component", *MAP_COLUMNS, F.col("x.token").alias("token"), (F.col("n") - F.col("m") + F.col("at")).alias("place"), (F.col("at") <= F.col("m") - equal).alias("short")))
    per = prefix.groupBy("token", "component").agg(F.count("*").alias("m"))
    groups = per.groupBy("token").agg(F.max(F.struct("m", "component")).alias("most"), F.sum("m").alias("m"), F.count("*").alias("several")).where("several > 1")
    salts = F.ceil((F.col("m") - F.col("most.m")) * F.col("m") / TASK_PAIRS)
    groups = keep(groups.select("token", F.col("most.component").alias("largest"), salts.alias("salts")))
    met = keep(prefix.join(groups, "token"))
    x = met.where("component <> largest").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts"))).alias("x")
    y = met.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).alias("y")
    apart = "x.token = y.token AND x.salt = y.salt AND x.component <> y.component AND (y.component = y.largest OR x.node < y.node)"
    sizes = f"100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) AND CASE WHEN x.n <= y.n THEN x.short ELSE y.short END"
    room = f"{100 + percent} * least(x.n - x.place, y.n - y.place) >= {percent} * (x.n + y.n)"
    differ = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in MAP_COLUMNS)  # at most the shingles that one set has alone
    near = f"{100 + percent} * (x.n + y.n - ({differ})) >= {2 * percent} * (x.n + y.n)"
    pairs = x.join(y, F.expr(f"{apart} AND {sizes} AND {room} AND {near}"))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb")).distinct()


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links, found from the components before them."""
    if links.isEmpty():
        return roots
    of = roots.select(F.col("node").alias("x"), F.col("component").alias("at"))
    new = links
    for side in ("a", "b"):
        new = new.join(of, F.col(side) == F.col("x"), "left").withColumn(side, F.coalesce("at", side)).drop("x", "at")
    joined = keep(components(keep(new.select("a", "b").distinct())))
    upper = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = roots.join(upper, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # documents that had no link before
    return keep(moved.union(joined.join(roots, "node", "left_anti")))
