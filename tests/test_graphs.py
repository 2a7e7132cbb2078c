import random

import pytest

from meshlake.operators import blocks, graph


def reach(links, start, without=None):
    around = {}
    for a, b in links:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    seen, todo = {start}, [start]
    while todo:
        for y in around.get(todo.pop(), ()):
            if y not in seen and y != without:
                seen.add(y)
                todo.append(y)
    return seen


def plain_bridges(links):
    out = set()
    for p in links:
        rest = [q for q in links if q != p]
        side = reach(rest, p[0])
        if p[1] not in side:
            out.add((*p, len(side), len(reach(rest, p[1]))))
    return out


def plain_parts(links):
    out = set()
    for v in {x for p in links for x in p}:
        rest = [p for p in links if v not in p]
        parts = {(min(s), len(s)) for s in (reach(rest, x, v) for p in links if v in p for x in p if x != v)}
        out |= {(v, *x) for x in parts} if len(parts) > 1 else set()
    return out


def sparse(seed, n, m):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)]


GRAPHS = {
    "line": [(1, 2), (2, 3)],
    "ring": [(1, 2), (2, 3), (3, 1)],
    "star": [(1, 2), (1, 3), (1, 4)],
    "apart": [(1, 2), (3, 4), (4, 5), (5, 3)],
    "both ways": [(1, 2), (2, 1), (2, 3), (3, 1), (3, 3)],
    "bow tie": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 3), (5, 6), (6, 7), (7, 8), (8, 5)],
    "two circles on a bridge": [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 4)],
    "sparse": sparse(1, 60, 66),
    "denser": sparse(2, 40, 70),
    "long": [(i, i + 1) for i in range(1, 14)] + [(12, 14), (3, 9)],
}


def test_bridges_and_cut_nodes_equal_brute_force(spark):
    given = [(1000 * k + a, 1000 * k + b) for k, links in enumerate(GRAPHS.values()) for a, b in links]
    links = sorted({(min(p), max(p)) for p in given if p[0] != p[1]})
    pairs = graph.undirected(spark.createDataFrame(given, "a long, b long").repartition(2), "a", "b").select("low", "high")
    ends = graph.both_ways(pairs).select("node").distinct()
    assert {(r.node, r.component) for r in graph.components(ends, pairs).collect()} == {(n, min(reach(links, n))) for p in links for n in p}
    found = blocks.analysed(ends, pairs)
    assert {tuple(r) for r in blocks.bridges(found).collect()} == plain_bridges(links)
    parts = [tuple(r) for r in blocks.cut_parts(found).collect()]
    assert len(parts) == len(set(parts)) and set(parts) == plain_parts(links)


def test_no_links(spark):
    pairs = spark.createDataFrame([], "low long, high long")
    nodes = spark.createDataFrame([(1,), (2,)], "node long")
    found = blocks.analysed(nodes, pairs)
    assert blocks.bridges(found).collect() == [] and blocks.cut_parts(found).collect() == []
    assert {(r.node, r.size) for r in found.collect()} == {(1, 1), (2, 1)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_degrees_shuffle_pairs_once(spark):
    pairs = graph.undirected(spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 3), (2, 3), (4, 1)], "a long, b long"), "a", "b")
    assert {tuple(r) for r in graph.degrees(pairs).collect()} == {(1, 3), (2, 2), (3, 2), (4, 1)}
    assert plan(graph.degrees(pairs)).count("Exchange") == 2  # by pair, by node


def test_both_ways_reads_pairs_once(spark):
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "low long, high long")
    both = graph.both_ways(pairs)
    assert both.columns == ["node", "other"] and sorted(tuple(r) for r in both.collect()) == [(1, 2), (1, 3), (2, 1), (3, 1)]
    assert "Union" not in plan(both)


def test_entities_send_no_tables_through_the_driver(spark, monkeypatch):
    plans, keep = [], graph.keep
    monkeypatch.setattr(graph, "keep", lambda df: (plans.append(plan(df)), keep(df))[1])
    records = spark.createDataFrame([(1, "a", None), (2, "b", "x"), (3, "c", "x"), (4, "a", ""), (5, "c", "y"), (6, None, None)], "id long, k1 string, k2 string")
    assert {tuple(r) for r in graph.resolve_entities(records, "id", ["k1", "k2"]).collect()} == {(1, 1), (2, 2), (3, 2), (4, 1), (5, 2), (6, 6)}
    assert len(plans) > 4 and not any("Broadcast" in p for p in plans)
