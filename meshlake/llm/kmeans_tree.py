"""Approximate nearest neighbours by largest inner product with a hierarchical k-means tree.

The tree is fitted on a sample of at most about ``sample`` vectors, chosen by a hash of vec_id: a cluster is split into
``branching`` ones while it stands for more than ``leaf_rows`` rows of the table, so the tree grows with it; every vector is then put
into the leaf that it reaches. A query goes through the tree best bin first: a priority queue holds the nodes seen by the inner
product of the query and their centroid plus a share of their spread, and each leaf taken from it is visited. How many leaves are visited is
calibrated: exact neighbours of up to ``audit`` queries are found in all rows, and visits widen until the share of them
in visited leaves reaches ``recall``; visiting all leaves is exact. Neighbouring leaves are put together to shards, and leaves of more
rows than a shard are cut; a query is sent once to each shard that has leaves it visits, and comes back with its best candidates of
all these. A shard's rows and its queries are both of bounded size, in rows and bytes, so neither a leaf of copies nor one that all
queries visit is a single task, and the memory of a task doesn't grow with the table.

Null, zero and non-finite vectors take no part. Vectors of different lengths have no inner product: those of each length are searched
among themselves. Equal scores go to the smaller vec_id. A row is never its own neighbour: candidates with the query's vec_id are
left out. Repeated rows count once; if one vec_id has several vectors, the largest product of any of them with any of the query's
counts. Rows with a null vec_id take no part. With fewer candidates than ``k`` all are returned; an empty table gives an empty
result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from meshlake.llm.columns import place
from meshlake.llm.scratch import forget, keep
from meshlake.llm.vectors import with_vectors


#: How much of a node's spread counts for it, in lengths of the query.
SPREAD = 0.3
#: Bytes of a shard's rows, and of its queries, as doubles.
SHARD_BYTES = 1 << 25
#: Rows and products that are compared at once.
PIECE, CELLS = 8192, 1 << 20
#: Queries that go through the tree at once.
WALKED = 256


@dataclass
class Tree:
    """centroids of all nodes; spread (root mean square distance from them); children of each node (empty for a leaf); leaf: the leaf number of each node, or -1."""

    centroids: np.ndarray
    spread: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def put(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each vector reaches by the nearest centroid of each level."""
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while moving.size:
            on = []
            for node in np.unique(at[moving]).tolist():
                kids = self.children[node]
                if kids:
                    rows = moving[at[moving] == node]
                    c = self.centroids[kids]
                    at[rows] = np.array(kids)[((c**2).sum(1) - 2 * (x[rows] @ c.T)).argmin(1)]
                    on.append(rows)
            moving = np.concatenate(on) if on else np.zeros(0, np.int64)
        return self.leaf[at]

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """The first leaves of a best-bin-first walk for each query, in the order visited (-1 where there are no more)."""
        out = np.full((len(x), most), -1, np.int64)
        near = x @ self.centroids.T + SPREAD * np.sqrt((x**2).sum(1, keepdims=True)) * self.spread
        for i in range(len(x)):
            row, queue, n = near[i].tolist(), [(0.0, 0)], 0
            while queue and n < most:
                _, node = heapq.heappop(queue)
                if self.leaf[node] >= 0:
                    out[i, n] = self.leaf[node]
                    n += 1
                for kid in self.children[node]:
                    heapq.heappush(queue, (-row[kid], kid))
        return out

    def first(self, x: np.ndarray, most: int) -> np.ndarray:
        """Whether each leaf is among the first ``most`` of each query's best-bin-first walk (one row a query).

        A leaf's turn comes with that of the worst node on its way, its gate. So leaves with better gates than the last one's are in, and only those behind its gate are walked.
        """
        near = (x @ self.centroids.T + SPREAD * np.sqrt((x**2).sum(1, keepdims=True)) * self.spread).T.copy()
        worst, gate = np.full(near.shape, np.inf), np.zeros(near.shape, np.int64)
        for node, kids in enumerate(self.children):  # ahead of its children, which have consecutive numbers
            if kids:
                at = slice(kids[0], kids[-1] + 1)
                closed = near[at] < worst[node]
                worst[at] = np.where(closed, near[at], worst[node])
                gate[at] = np.where(closed, np.array(kids)[:, None], gate[node])
        nodes = np.flatnonzero(self.leaf >= 0)  # leaves are numbered in this order
        worst, gate = worst[nodes].T.copy(), gate[nodes].T
        if most >= len(nodes):
            return np.ones(worst.shape, bool)
        last = np.partition(worst, len(nodes) - most, axis=1)[:, [len(nodes) - most]]
        out, tied = worst >= last, worst == last
        for i in np.flatnonzero(out.sum(1) > most).tolist():
            gates = np.unique(gate[i, tied[i]]).tolist()
            if len(gates) > 1:  # nodes with equal values
                out[i] = np.isin(np.arange(len(nodes)), self.visits(x[i : i + 1], most)[0])
                continue
            out[i] &= ~tied[i]
            lacking = most - int(out[i].sum())
            row, queue = near[:, i], []
            node = gates[0]
            while lacking:
                if self.leaf[node] >= 0:
                    out[i, self.leaf[node]] = True
                    lacking -= 1
                for kid in self.children[node]:
                    heapq.heappush(queue, (-row[kid], kid))
                if lacking:
                    _, node = heapq.heappop(queue)
        return out


def lloyd(x: np.ndarray, k: int, r: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """The cluster of each vector."""
    c = x[r.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = ((c**2).sum(1) - 2 * (x @ c.T)).argmin(1)
        for i in range(k):
            if (of == i).any():
                c[i] = x[of == i].mean(0)
    return of


def fit(x: np.ndarray, branching: int, stands_for: float, leaf_rows: int, seed: int = 3) -> Tree:
    """Split clusters into up to ``branching`` while they stand for more than ``leaf_rows`` rows; clusters of equal vectors or fewer than two to a branch stay."""
    r = np.random.default_rng(seed)
    centroids, spread, children, leaf = [], [], [], []
    todo, leaves = [np.arange(len(x))], 0

    def add(rows: np.ndarray) -> int:
        centroids.append(x[rows].mean(0) if len(rows) else np.zeros(x.shape[1]))
        spread.append(math.sqrt(((x[rows] - centroids[-1]) ** 2).sum() / max(len(rows), 1)))
        children.append([])
        leaf.append(-1)
        return len(leaf) - 1

    add(todo[0])
    for node, rows in enumerate(todo):  # grows while it runs
        if len(rows) * stands_for > leaf_rows and len(rows) >= 2 * branching:
            of = lloyd(x[rows], branching, r)
            parts = [rows[of == i] for i in np.unique(of).tolist()]
            if len(parts) > 1:
                todo += parts
                children[node] = [add(part) for part in parts]
                continue
        leaf[node] = leaves
        leaves += 1
    return Tree(np.array(centroids), np.array(spread), children, np.array(leaf))


class Top:
    """The ``k`` best candidates seen of each query: different vec_ids by score, ties to the smaller; a score of -inf is an empty place."""

    def __init__(self, queries: np.ndarray, vectors: np.ndarray, k: int):
        self.queries, self.vectors, self.k = queries, vectors, k
        self.lengths = np.sqrt((vectors**2).sum(1))
        self.ids, self.scores = np.zeros((len(queries), k), np.int64), np.full((len(queries), k), -np.inf)

    def add(self, asked: np.ndarray, ids: np.ndarray, x: np.ndarray, group: np.ndarray, seen: np.ndarray) -> None:
        """Take candidates into account for some of the queries (their numbers), for each those of the groups that it has seen (a row of booleans)."""
        ids, x, group = fewer_copies(ids, x, group, self.k)
        n = self.k * int(np.unique(ids, return_counts=True)[1].max())  # so many rows have at least k vec_ids
        longest = math.sqrt((x**2).sum(1).max())
        kind = np.float32 if 1e-15 < min(longest, self.lengths.min()) and max(longest, self.lengths.max()) < 1e15 else np.float64  # a rough product needs no more
        y, order = x.astype(kind).T, np.argsort(ids, kind="stable")
        step = max(1, CELLS // len(ids))
        for lo in range(0, len(asked), step):
            some, groups = asked[lo : lo + step], seen[lo : lo + step]
            v, bound = self.vectors[some], self.scores[some, -1]
            rough = v.astype(kind) @ y
            if kind == np.float64:  # products may have overflowed
                rough[~np.isfinite(rough)] = -np.inf
            left, right = (np.searchsorted(ids, self.queries[some], side, order) for side in ("left", "right"))
            for i in np.flatnonzero(right > left).tolist():
                rough[i, order[left[i] : right[i]]] = -np.inf  # its own
            fresh = np.flatnonzero(np.isneginf(bound))
            if fresh.size and n < len(ids):
                bound[fresh] = np.partition(np.where(groups[fresh][:, group], rough[fresh], -np.inf), len(ids) - n, axis=1)[:, len(ids) - n]
            floor = np.finfo(kind)
            slack = x.shape[1] * (4 * floor.eps * longest * self.lengths[some] + floor.tiny * (1 + longest + self.lengths[some]))  # rounding is below that
            lowest = np.nextafter((bound - slack).astype(kind), kind(-np.inf))
            lowest = np.where(lowest > floor.min, lowest, floor.min)  # not for -inf or nan
            row, col = np.divmod(np.flatnonzero(rough >= lowest[:, None]), len(ids))
            fine = groups[row, group[col]]
            row, col = row[fine], col[fine]
            exact = np.empty(len(row))
            for at in range(0, len(row), PIECE):
                part = slice(at, at + PIECE)
                exact[part] = (x[col[part]] * v[row[part]]).sum(1)  # summed alike for each row, so copies tie
            fine = np.isfinite(exact)
            self.merge(some[row[fine]], ids[col[fine]], exact[fine])

    def merge(self, of: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        touched, of = np.unique(of, return_inverse=True)
        of = np.concatenate([np.repeat(np.arange(len(touched)), self.k), of])
        ids, scores = np.concatenate([self.ids[touched].ravel(), ids]), np.concatenate([self.scores[touched].ravel(), scores])
        order = np.lexsort((-scores, ids, of))
        order = order[~np.isneginf(scores[order])]
        of, ids, scores = of[order], ids[order], scores[order]
        first = np.ones(len(of), bool)
        first[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])  # of one vec_id its best vector
        of, ids, scores = of[first], ids[first], scores[first]
        order = np.lexsort((ids, -scores, of))
        of, ids, scores = of[order], ids[order], scores[order]
        rank = np.arange(len(of)) - np.searchsorted(of, np.arange(len(touched)))[of]
        near = rank < self.k
        self.scores[touched] = -np.inf
        self.ids[touched[of[near]], rank[near]] = ids[near]
        self.scores[touched[of[near]], rank[near]] = scores[near]


def fewer_copies(ids: np.ndarray, x: np.ndarray, group: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows without those that can't count: of a group's equal vectors those with the k smallest vec_ids come first, or one more if a query is among them."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()
    _, of, counts = np.unique(raw, return_inverse=True, return_counts=True)
    if counts.max() <= k + 1:
        return ids, x, group
    order = np.lexsort((ids, group, of))
    new = np.flatnonzero(np.diff(of[order], prepend=-1) | np.diff(group[order], prepend=-1))
    at = np.arange(len(order)) - np.repeat(new, np.diff(new, append=len(order)))
    few = np.sort(order[at <= k])
    return ids[few], x[few], group[few]


def packed(x: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def unpacked(column: pa.Array | pa.ChunkedArray, kind: str, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, length)


def listed(column: pa.Array | pa.ChunkedArray, length: int) -> np.ndarray:
    """Arrow lists of one length, as rows of doubles."""
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


def shards_of(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """The first shard of each leaf and their number: neighbouring leaves share one of at most ``most`` rows, leaves of more rows have several."""
    found, shard, held = {}, 0, 0
    for leaf, rows in sorted(sizes.items()):
        if held and held + rows > most:
            shard, held = shard + 1, 0
        parts = math.ceil(rows / most)
        found[leaf] = (shard, parts)
        shard, held = (shard + parts, 0) if parts > 1 else (shard, held + rows)
    return found


def nearest(
    embeddings: DataFrame, queries: DataFrame, k: int = 20, branching: int = 8, leaf_rows: int = 1024, sample: int = 20_000, audit: int = 200, recall: float = 0.96, block: int = 65_536
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each query; both tables have vec_id and embedding. A shard has at most about ``block`` rows and queries."""
    rows, asked = with_vectors(embeddings), with_vectors(queries)
    if all(single(df) for df in (embeddings, queries)):
        rows, asked = (df.withColumn("vector", F.col("vector").cast("array<float>")) for df in (rows, asked))
    rows, asked = keep(rows.distinct()), keep(asked.distinct())
    lengths = {r["n"]: r["rows"] for r in rows.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).collect()}  # a row for each length
    found = embeddings.sparkSession.createDataFrame([], "query_id long, vec_id array<long>, score array<double>")
    for length, total in sorted(lengths.items()):
        mine = [df.where(F.size("vector") == length) for df in (rows, asked)]
        found = found.union(search(*mine, length, total, k, branching, leaf_rows, sample, audit, recall, block))
    forget(rows, asked)  # the searches have tables of their own
    found = found.repartition("query_id").select("query_id", F.inline(F.arrays_zip("vec_id", "score"))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def single(df: DataFrame) -> bool:
    """Whether the vectors have components of 4 bytes, which doubles needn't widen on their way."""
    return isinstance(getattr(df.schema[place(df, "embedding")].dataType, "elementType", None), FloatType)


def search(rows: DataFrame, asked: DataFrame, length: int, total: int, k: int, branching: int, leaf_rows: int, sample: int, audit: int, recall: float, block: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each query and visited shard (as arrays), for vectors of one length."""
    spark = rows.sparkSession
    kind = "f4" if isinstance(rows.schema["vector"].dataType.elementType, FloatType) else "f8"
    share = min(1.0, sample / total)
    chosen = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000).toArrow().sort_by("vec_id")
    tree = fit(listed(chosen["vector"], length), branching, total / max(chosen.num_rows, 1), leaf_rows)
    shared = spark.sparkContext.broadcast(tree)  # no more nodes than vectors in the sample

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = listed(batch.column("vector"), length)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed(x.astype(kind)), pa.array(shared.value.put(x))], ["vec_id", "vector", "leaf"])

    held = keep(rows.mapInArrow(put, "vec_id long, vector binary, leaf long"))
    visits = calibrated(held, asked, tree, kind, length, k, audit, recall)
    most = max(1, min(block, SHARD_BYTES // (8 * length)))
    even = math.ceil(total / (2 * spark.sparkContext.defaultParallelism))  # a small table's shards keep all cores busy
    placed = shards_of({r["leaf"]: r["count"] for r in held.groupBy("leaf").count().collect()}, min(most, max(even, leaf_rows)))  # a row for each leaf
    first, parts = np.zeros(tree.leaves, np.int64), np.zeros(tree.leaves, np.int64)
    for leaf, at in placed.items():
        first[leaf], parts[leaf] = at

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shards that each query visits, and its leaves there."""
        for whole in batches:
            for lo in range(0, whole.num_rows, WALKED):
                batch = whole.slice(lo, WALKED)
                x = listed(batch.column("vector"), length)
                row, leaf = np.nonzero(shared.value.first(x, visits))
                times = parts[leaf]
                shard = np.repeat(first[leaf] - np.cumsum(times) + times, times) + np.arange(times.sum())
                row, leaf = np.repeat(row, times), np.repeat(leaf, times)
                order = np.lexsort((leaf, shard, row))
                row, shard, leaf = row[order], shard[order], leaf[order]
                new = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(shard, prepend=-1))
                leaves = pa.ListArray.from_arrays(pa.array(np.append(new, len(row)), pa.int32()), pa.array(leaf, pa.int32()))
                visited = pa.StructArray.from_arrays([pa.array(shard[new]), leaves], ["shard", "leaves"])
                ends = pa.array(np.searchsorted(row[new], np.arange(len(x) + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed(x.astype(kind)), pa.ListArray.from_arrays(ends, visited)], ["vec_id", "vector", "visited"])

    walks = keep(asked.mapInArrow(walk, "vec_id long, vector binary, visited array<struct<shard: long, leaves: array<int>>>"))
    counts = walks.select(F.explode("visited.shard").alias("shard")).groupBy("shard").agg(F.ceil(F.count("*") / most).alias("sides")).collect()  # a row for each shard
    sides = F.broadcast(spark.createDataFrame([tuple(r) for r in counts], "shard long, sides long"))
    split = F.broadcast(spark.createDataFrame([(leaf, *at) for leaf, at in placed.items()], "leaf long, first long, parts long"))  # a row for each leaf
    mixed = lambda salt: F.xxhash64("vec_id", "vector", F.lit(salt))

    def scan(candidates: pa.Table, asking: pa.Table) -> pa.Table:
        """The best candidates of each query in the leaves that it visits."""
        if not candidates.num_rows or not asking.num_rows:  # a hash has left one of a leaf's shards, or a side, without rows
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.float64()))], ["query_id", "vec_id", "score"])
        queries = asking["vec_id"].to_numpy()
        top = Top(queries, unpacked(asking["vector"], kind, length).astype(np.float64), k)
        leaf = candidates["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        ids, x, leaf = candidates["vec_id"].to_numpy()[order], unpacked(candidates["vector"], kind, length)[order], leaf[order]
        leaves, group = np.unique(leaf, return_inverse=True)
        visited, seen = asking["leaves"].combine_chunks(), np.zeros((len(queries), len(leaves)), bool)
        for lo in range(0, len(queries), PIECE):
            part = visited.slice(lo, PIECE)
            of, at = part.flatten().to_numpy(), np.repeat(np.arange(lo, lo + len(part)), part.value_lengths().to_numpy())
            here = np.isin(of, leaves)  # a hash may have left a cut leaf without rows in this shard
            seen[at[here], np.searchsorted(leaves, of[here])] = True
        for lo in range(0, len(ids), PIECE):
            part = slice(lo, lo + PIECE)
            groups = slice(group[part][0], group[part][-1] + 1)
            asked = np.flatnonzero(seen[:, groups].any(1))
            if len(asked):
                top.add(asked, ids[part], x[part].astype(np.float64), group[part] - groups.start, seen[asked, groups])
        full = ~np.isneginf(top.scores)
        ends = pa.array(np.append(0, np.cumsum(full.sum(1))), pa.int32())
        return pa.table([pa.array(queries), *(pa.ListArray.from_arrays(ends, pa.array(of[full])) for of in (top.ids, top.scores))], ["query_id", "vec_id", "score"])

    key = ["shard", "side"]
    dealt = held.join(split, "leaf").withColumn("shard", F.col("first") + F.pmod(mixed(1), "parts")).join(sides, "shard")
    dealt = dealt.withColumn("side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))).select(*key, "leaf", "vec_id", "vector")
    sent = walks.select("vec_id", "vector", F.inline("visited")).join(sides, "shard").withColumn("side", F.pmod(mixed(2), "sides")).select(*key, "vec_id", "vector", "leaves")
    return dealt.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(scan, "query_id long, vec_id array<long>, score array<double>")


def calibrated(held: DataFrame, asked: DataFrame, tree: Tree, kind: str, length: int, k: int, audit: int, recall: float) -> int:
    """The number of leaves to visit, from the exact neighbours of a bounded sample of queries in all rows."""
    some = asked.orderBy(F.xxhash64("vec_id", F.lit(5))).limit(audit).toArrow().sort_by("vec_id")
    if not some.num_rows:
        return 1
    queries, x = some["vec_id"].to_numpy(), listed(some["vector"], length)
    shared = held.sparkSession.sparkContext.broadcast((queries, x))  # at most ``audit`` vectors

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, x = shared.value
        for batch in batches:
            if batch.num_rows:
                ids, top = batch.column("vec_id").to_numpy(), Top(queries, x, k)
                vectors = unpacked(batch.column("vector"), kind, length).astype(np.float64)
                for lo in range(0, len(ids), PIECE):
                    part = slice(lo, lo + PIECE)
                    top.add(np.arange(len(queries)), ids[part], vectors[part], np.zeros(len(ids[part]), np.int64), np.ones((len(queries), 1), bool))
                row, at = np.nonzero(~np.isneginf(top.scores))
                found, score = top.ids[row, at], top.scores[row, at]
                leaf = dict(zip(ids.tolist(), batch.column("leaf").to_pylist(), strict=True))  # of rows with one id, that of the last
                yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(found), pa.array(score), pa.array([leaf[i] for i in found.tolist()], pa.int64())], ["query", "vec_id", "score", "leaf"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    scanned = held.mapInArrow(scan, "query long, vec_id long, score double, leaf long")
    exact = scanned.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "leaf").toArrow()  # at most audit * k rows
    order = tree.visits(x, tree.leaves)
    turn = np.empty((len(x), tree.leaves), np.int64)
    np.put_along_axis(turn, order, np.arange(tree.leaves)[None, :].repeat(len(x), 0), 1)
    needed = turn[exact["query"].to_numpy(), exact["leaf"].to_numpy()]
    visits = 1
    while visits < tree.leaves and (needed < visits).mean() < recall:
        visits += 1
    return visits
