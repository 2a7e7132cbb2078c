"""Embedding near-duplicates: navigable small-world graphs of each shard, queried from every shard.

Vectors link if their labels are equal and not null and their cosine, in double precision, is at least ``least``. Each
label's vectors are dealt into shards of about ``shard`` vectors. A shard's graph holds leaders: while it is
built, a vector that finds a leader within half the linking angle joins that leader's cell instead. Members of one
cell are linked for certain (the angles to their leader, each verified, add up to no more than the linking angle), so a
group of copies needs no pairs. Every leader then queries the graph of every shard of its label, in tasks of one
pair of shards. A beam widens until audits pass: for a sample of leaders, all cells that could hold links must be found,
and nearly always the nearest leader; a beam that is full of such cells is widened as well. Pairs of cells
whose radii leave no doubt are decided at once; for the others the cosines of all members are computed, in blocks. Links
between cells are united by distributed components.

Null, zero and non-finite vectors and those with null label link with nothing, nor do vectors of different lengths.
Repeated rows are vectors of their own and link with each other. Rows with null vec_id link with nothing. Ties don't matter, as a
component is named by its smallest vec_id. An empty table gives an empty result. Columns besides vec_id, embedding and label are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlake.llm.columns import column, numbered
from meshlake.llm.components import components
from meshlake.llm.scratch import keep
from meshlake.llm.vectors import matrix, with_vectors

WIDTH = 12
EXPANDED = 4
#: Room for rounding in angles.
MARGIN = 1e-7


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


class Graph:
    """Layers of links between unit vectors; layer 0 holds all nodes, each higher one about a twelfth of those below."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray] | None = None):
        self.x = x
        self.links = links or [np.full((len(x), 2 * WIDTH), -1, np.int32)]

    def beam(self, q: np.ndarray, entries: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of a layer for many queries in lockstep: the nodes found (-1 for none) and their cosines, best first."""
        links, rows = self.links[layer], np.arange(len(q))
        seen = np.zeros((len(q), len(self.x) + 1), bool)
        seen[:, -1] = True
        ids = np.full((len(q), width), -1, np.int64)
        near = np.full((len(q), width), -2.0)
        done = np.ones((len(q), width), bool)
        n = min(width, entries.shape[1])
        entries = entries[:, :n]
        there = entries >= 0
        ids[:, :n] = entries
        near[:, :n] = np.where(there, np.einsum("bwd,bd->bw", self.x[entries], q), -2.0)
        done[:, :n] = ~there
        seen[rows[:, None], entries] = True
        active = rows
        while active.size:
            open_ = np.where(done[active], -3.0, near[active])
            e = min(EXPANDED, width)
            pick = np.argpartition(-open_, e - 1, axis=1)[:, :e]
            value = np.take_along_axis(open_, pick, 1)
            going = value.max(1) > -2.5
            active, pick, value = active[going], pick[going], value[going]
            if not active.size:
                break
            nodes = np.where(value > -2.5, np.take_along_axis(ids[active], pick, 1), -1)
            done[active[:, None], pick] = True
            next_ = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1).astype(np.int64)
            np.maximum(next_, -1, out=next_)
            next_.sort(axis=1)
            next_[:, 1:][next_[:, 1:] == next_[:, :-1]] = -1
            new = ~seen[active[:, None], next_]
            next_ = np.where(new, next_, -1)
            seen[active[:, None], next_] = True
            r, c = np.nonzero(next_ >= 0)
            cosine = np.full(next_.shape, -2.0)
            cosine[r, c] = np.einsum("nd,nd->n", self.x[next_[r, c]], q[active[r]])
            all_ids = np.concatenate([ids[active], next_], 1)
            all_near = np.concatenate([near[active], cosine], 1)
            all_done = np.concatenate([done[active], next_ < 0], 1)
            order = np.argpartition(-all_near, width - 1, axis=1)[:, :width]
            ids[active], near[active], done[active] = (np.take_along_axis(a, order, 1) for a in (all_ids, all_near, all_done))
        order = np.argsort(-near, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)

    def search(self, q: np.ndarray, width: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """From the top layer down to the bottom, with a beam of ``width`` there."""
        ids, near = [], []
        for lo in range(0, len(q), block):
            part = q[lo : lo + block]
            entries = np.full((len(part), 1), int(np.flatnonzero(self.links[-1][:, 0] > -2)[0]))
            for layer in range(len(self.links) - 1, 0, -1):
                entries, _ = self.beam(part, entries, 8, layer)
            a, b = self.beam(part, entries, min(width, len(self.x)), 0)
            ids.append(a)
            near.append(b)
        return np.concatenate(ids), np.concatenate(near)


def grow(x: np.ndarray, reach: float, beam: int, seed: int) -> tuple[Graph, np.ndarray, np.ndarray, np.ndarray]:
    """The graph of a shard's leaders, the rows that lead, and for every row its leader's number and its cosine to it."""
    n = len(x)
    r = np.random.default_rng(seed)
    height = np.floor(-np.log(np.maximum(r.random(n), 1e-12)) / math.log(WIDTH)).astype(int)
    graph = Graph(np.zeros_like(x))
    graph.links[0] = np.full((n, 2 * WIDTH), -1, np.int32)
    leaders, of, cosine = [], np.full(n, -1, np.int64), np.ones(n)
    at = 0
    while at < n:
        to = min(n, at + max(1, min(256, len(leaders))))
        q = x[at:to]
        top = len(graph.links) - 1
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if leaders:
            entries = np.full((len(q), 1), graph.entry)
            for layer in range(top, -1, -1):
                ids, near = graph.beam(q, entries, beam if layer == 0 else 16, layer)
                found.insert(0, (ids, near))
                entries = ids
            hit = found[0][1][:, 0] >= reach
            of[at:to][hit], cosine[at:to][hit] = found[0][0][hit, 0], found[0][1][hit, 0]
        own = q @ q.T
        new: list[int] = []
        for i in np.flatnonzero(of[at:to] < 0).tolist():
            if new:
                j = int(np.argmax(own[i, new]))
                if own[i, new[j]] >= reach:
                    of[at + i], cosine[at + i] = len(leaders) - len(new) + j, own[i, new[j]]
                    continue
            of[at + i], cosine[at + i] = len(leaders), 1.0
            leaders.append(at + i)
            new.append(i)
        if new:
            first = len(leaders) - len(new)
            graph.x[first : len(leaders)] = q[new]
            rows = np.array(new)
            heights = np.minimum(height[at + rows], top + 1)
            for layer in range(0, int(heights.max()) + 1):
                if layer == len(graph.links):
                    graph.links.append(np.full((n, 2 * WIDTH), -2, np.int32))
                here = np.flatnonzero(heights >= layer)
                nodes = first + here
                graph.links[layer][nodes] = -1
                among = own[np.ix_(rows[here], rows[here])].copy()
                np.fill_diagonal(among, -2)
                if layer < len(found):
                    ids, near = found[layer][0][rows[here]], found[layer][1][rows[here]]
                else:
                    ids, near = np.full((len(here), 1), -1), np.full((len(here), 1), -2.0)
                ids = np.concatenate([ids, np.broadcast_to(nodes, among.shape)], 1)
                near = np.concatenate([near, among], 1)
                pick = np.argsort(-near, axis=1, kind="stable")[:, :WIDTH]
                join(graph, layer, nodes, np.where(np.take_along_axis(near, pick, 1) > -1.5, np.take_along_axis(ids, pick, 1), -1))
            if int(heights.max()) >= top or first == 0:
                graph.entry = first + int(np.argmax(heights))
        at = to
    m = len(leaders)
    graph.x = graph.x[:m]
    graph.links = [layer[:m] for layer in graph.links]
    return graph, np.array(leaders), of, cosine


def join(graph: Graph, layer: int, nodes: np.ndarray, to: np.ndarray) -> None:
    """Link nodes with those chosen for them, both ways; a node that gets too many links keeps the nearest."""
    links = graph.links[layer]
    links[nodes, : to.shape[1]] = to
    r, c = np.nonzero(to >= 0)
    if not len(r):
        return
    targets, sources = to[r, c], nodes[r]
    order = np.argsort(targets, kind="stable")
    targets, sources = targets[order], sources[order]
    unique, start = np.unique(targets, return_index=True)
    for t, a, b in zip(unique.tolist(), start.tolist(), [*start[1:].tolist(), len(targets)], strict=True):
        have = links[t]
        some = np.unique(np.concatenate([have[have >= 0], sources[a:b]]))
        some = some[some != t]
        if len(some) > 2 * WIDTH:
            some = some[np.argsort(-(graph.x[some] @ graph.x[t]), kind="stable")[: 2 * WIDTH]]
        links[t] = -1
        links[t, : len(some)] = some


def audited(graph: Graph, q: np.ndarray, own: np.ndarray, bound: np.ndarray, beam: int, seed: int, sample: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) with a cosine of at least the query's bound; the beam widens until audits of a sample pass.

    own is the query's own node, or -1 if the graph has none; it doesn't count as found.
    """
    n = len(graph.x)
    r = np.random.default_rng(seed)
    some = r.permutation(len(q))[:sample]
    exact = q[some] @ graph.x.T
    there = own[some] >= 0
    exact[there, own[some][there]] = -2
    while beam < n:
        ids, near = graph.search(q[some], beam)
        near[ids == np.where(there, own[some], -2)[:, None]] = -2
        wanted = (exact >= bound[some, None]).sum(1)
        got = (near >= bound[some, None]).sum(1)
        nearest = near.max(1) >= exact.max(1) - 1e-9
        if (got >= wanted).all() and nearest.mean() >= 0.9:
            break
        beam *= 2
    rows, nodes = [], []
    left = np.arange(len(q))
    while left.size:
        if beam >= n:  # as wide as the graph: compare with all
            for lo in range(0, len(left), 512):
                a, b = np.nonzero(q[left[lo : lo + 512]] @ graph.x.T >= bound[left[lo : lo + 512], None])
                rows.append(left[lo + a])
                nodes.append(b)
            break
        ids, near = graph.search(q[left], beam)
        hit = near >= bound[left, None]
        full = hit.all(1)
        a, b = np.nonzero(hit & ~full[:, None])
        rows.append(left[a])
        nodes.append(ids[a, b])
        left, beam = left[full], 4 * beam
    return (np.concatenate(rows), np.concatenate(nodes)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


CELLS = "label string, shard long, shards long, row long, cell long, radius double, size long, x binary, links binary, layers int"


def near_duplicates(embeddings: DataFrame, least: float = 0.93, shard: int = 4096, beam: int = 48, block: int = 512) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of embeddings (vec_id, embedding, label)."""
    limit = math.acos(least)
    reach = math.cos(limit / 2 - MARGIN)
    every = keep(numbered(embeddings).select(column(embeddings, "vec_id").cast("long").alias("vec_id"), column(embeddings, "embedding").alias("embedding"), column(embeddings, "label").cast("string").alias("label")).withColumn("row", F.monotonically_increasing_id()))
    usable = with_vectors(every, "label", "row").where("label IS NOT NULL").withColumn("label", F.concat_ws(":", F.size("vector"), "label"))
    per_label = keep(usable.groupBy("label").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.col("n") / shard).cast("long")).drop("n"))
    dealt = usable.join(per_label, "label").withColumn("shard", F.expr("pmod(xxhash64(row, 21), shards)"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        x = matrix(rows["vector"])
        x /= np.sqrt((x**2).sum(1, keepdims=True))
        graph, leaders, of, cosine = grow(x, reach, beam, 1 + int(key[1]))
        radius = np.zeros(len(leaders))
        np.maximum.at(radius, of, np.where(np.arange(len(x)) == leaders[of], 0.0, angle(cosine) + MARGIN))
        size = np.bincount(of, minlength=len(leaders))
        ids = rows["row"].to_numpy()
        mine = np.flatnonzero(np.arange(len(x)) == leaders[of])
        links = [None] * len(x)
        for i in mine.tolist():
            links[i] = np.stack([layer[of[i]] for layer in graph.links]).astype("<i4").tobytes()
        return pd.DataFrame(
            {"label": key[0], "shard": key[1], "shards": rows["shards"], "row": ids, "cell": ids[leaders[of]], "radius": radius[of], "size": size[of], "x": [v.tobytes() for v in x], "links": links, "layers": len(graph.links)}
        )

    members = keep(dealt.groupBy("label", "shard").applyInPandas(build, CELLS))
    leaders = members.where("row = cell")
    # every leader queries every shard of its label; of two shards the lower one asks
    targets = leaders.select("label", F.explode(F.sequence(F.lit(0).cast("long"), "shard")).alias("source"), F.col("shard").alias("target"), "row", "radius", "x", "links", "layers").groupBy("label", "source", "target")
    askers = leaders.select("label", F.col("shard").alias("source"), F.explode(F.expr("sequence(shard, shards - 1)")).alias("target"), "row", "radius", "x").groupBy("label", "source", "target")

    def ask(graph_rows: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        graph_rows = graph_rows.sort_values("row")
        x = np.stack([np.frombuffer(v) for v in graph_rows["x"]])
        layers = int(graph_rows["layers"].iloc[0])
        stacked = np.stack([np.frombuffer(v, "<i4").reshape(layers, -1) for v in graph_rows["links"]])
        graph = Graph(x, [np.ascontiguousarray(stacked[:, i]) for i in range(layers)])
        q = np.stack([np.frombuffer(v) for v in asking["x"]])
        mine, theirs = asking["radius"].to_numpy(), graph_rows["radius"].to_numpy()
        bound = np.cos(np.minimum(limit + MARGIN + mine + theirs.max(initial=0), math.pi))
        names = graph_rows["row"].to_numpy()
        at = np.minimum(np.searchsorted(names, asking["row"].to_numpy()), len(names) - 1)
        own = np.where(names[at] == asking["row"].to_numpy(), at, -1)
        a, b = audited(graph, q, own, bound, beam, 5)
        apart = angle((q[a] * x[b]).sum(1))
        left, right = asking["row"].to_numpy()[a], graph_rows["row"].to_numpy()[b]
        maybe = (apart - mine[a] - theirs[b] <= limit + MARGIN) & (left != right)
        if asking["source"].iloc[0] == asking["target"].iloc[0]:
            left, right = np.minimum(left, right), np.maximum(left, right)
        sure = apart + mine[a] + theirs[b] <= limit - MARGIN
        return pd.DataFrame({"a": left[maybe], "b": right[maybe], "sure": sure[maybe]})

    # leaders keep the order of their rows as node numbers
    pairs = keep(targets.cogroup(askers).applyInPandas(ask, "a long, b long, sure boolean").groupBy("a", "b").agg(F.max("sure").alias("sure")))
    cells = leaders.select(F.col("row").alias("cell"), "size")

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "rows": [rows["row"].to_numpy().astype("<i8").tobytes()], "x": [b"".join(rows["x"])]})

    doubtful = keep(pairs.where("NOT sure").select("a", "b"))
    asked = keep(doubtful.select(F.col("a").alias("cell")).union(doubtful.select("b")).distinct())
    in_doubt = members.join(asked, "cell").withColumn("part", F.expr(f"pmod(xxhash64(row, 4), CAST(ceil(size / {block}) AS BIGINT))"))
    blocks = keep(in_doubt.select("cell", "part", "row", "x").groupBy("cell", "part").applyInPandas(gather, "cell long, part long, rows binary, x binary"))
    left, right = (blocks.select(F.col("cell").alias(c), F.col("rows").alias(f"rows_{c}"), F.col("x").alias(f"x_{c}")) for c in "ab")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows_a, rows_b = np.frombuffer(r["rows_a"], "<i8"), np.frombuffer(r["rows_b"], "<i8")
                linked = np.frombuffer(r["x_a"]).reshape(len(rows_a), -1) @ np.frombuffer(r["x_b"]).reshape(len(rows_b), -1).T >= least
                n = np.concatenate([linked.sum(1), linked.sum(0)])
                if n.any():
                    some = np.flatnonzero(n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), r["a"])), pa.array(np.full(len(some), r["b"])), pa.array(np.concatenate([rows_a, rows_b])[some]), pa.array(n[some].astype(np.int64))], ["a", "b", "row", "n"])

    checked = keep(doubtful.join(left, "a").join(right, "b").mapInArrow(verify, "a long, b long, row long, n long"))
    sure = pairs.where("sure")
    by_size = sure.select(F.col("a").alias("cell"), F.col("b").alias("other")).union(sure.select("b", "a")).join(cells.select(F.col("cell").alias("other"), "size"), "other").groupBy("cell").agg(F.sum("size").alias("more"))
    extra = checked.groupBy("row").agg(F.sum("n").alias("n"))
    ids = every.select("row", "vec_id")
    # cells get the number of their smallest vec_id, so components are named by vectors
    named = keep(members.select("row", "cell").join(ids, "row").groupBy("cell").agg(F.min("vec_id").alias("least"), F.min("row").alias("node")))
    edges = sure.select("a", "b").union(checked.select("a", "b")).distinct()
    roots = components(edges).select(F.col("node").alias("cell"), "component")
    grouped = keep(named.join(roots, "cell", "left").withColumn("component", F.coalesce("component", "cell")))
    lowest = keep(grouped.groupBy("component").agg(F.min("least").alias("component_id")))
    of_cell = grouped.join(lowest, "component").join(keep(by_size), "cell", "left").select("cell", "component_id", F.coalesce("more", F.lit(0)).alias("more"))
    found = members.select("row", "cell", "size").join(keep(of_cell), "cell").join(extra, "row", "left")
    found = found.select("row", "component_id", (F.col("size") - 1 + F.col("more") + F.coalesce("n", F.lit(0))).alias("n_links"))
    component = F.coalesce("component_id", "vec_id")
    return ids.join(found, "row", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
