import datetime
import random

import pytest
from pyspark.sql import functions as F

from meshlake.operators import coverage, lattice, pairs, prints

POLICY = {"router": "ever", "level": "most", "name": "real", "stack": "longest", "addresses": "union", "vendor": "agreed", "mode": "newest"}
SCHEMA = "id int, at timestamp, source_rank int, router boolean, level int, name string, stack string, addresses array<string>, vendor string, mode string"


def reports(seed):
    r = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    return [
        (
            r.randrange(6), day + datetime.timedelta(hours=r.randrange(50)), r.randrange(3), r.choice([None, False, True]) if r.random() < 0.4 else None, r.choice([None, 1, 2, 300]),
            r.choice([None, "", "Unknown", "found-1", "Offline-2", "lamp", "plug"]), r.choice([None, "Unknown", "1.2", "1.2.34", "1.4.34"]), r.choice([None, [], ["a"], ["b", "a", "b"], ["c", None]]),
            r.choice(["", "Unknown", None, "Acme"] + ["Other"] * (seed % 2)), r.choice([None, "rdn", "rn", "-"]),
        )
        for _ in range(60)
    ]


def plain(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == key]
        flags = [r[3] for r in own if r[3] is not None]
        real = [(r[5].startswith(lattice.PLACEHOLDERS), r[2], r[5]) for r in own if r[5] not in (None, "", "Unknown")]
        stacks = [(-len(r[6]), r[6]) for r in own if r[6] not in (None, "", "Unknown")]
        addresses = {a for r in own for a in r[7] or []}
        vendors = sorted({r[8] for r in own if r[8] not in (None, "", "Unknown")})
        modes = [(r[1], r[9]) for r in own if r[9] is not None]
        addresses = sorted(a for a in addresses if a is not None) + [None] * (None in addresses)
        out[key] = (any(flags) if flags else None, max((r[4] for r in own if r[4] is not None), default=None), min(real)[2] if real else None, min(stacks)[1] if stacks else None,
                    addresses, vendors[0] if len(vendors) == 1 else None, vendors if len(vendors) > 1 else None, max(modes)[1] if modes else None)
    return out


def rows_of(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_reports_meet_in_any_order_and_grouping(spark, seed):
    rows = reports(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = rows_of(lattice.reconciled(df, ["id"], POLICY, "at"))
    assert whole == plain(rows)
    shuffled = rows + rows[:20]  # repeats change nothing
    random.Random(9).shuffle(shuffled)
    states = lattice.states(spark.createDataFrame(shuffled, SCHEMA).repartition(4), ["id"], POLICY, "at")
    parts = states.withColumn("part", F.pmod(F.hash("mode", "name"), F.lit(3)))
    halves = [lattice.met(parts.where(F.col("part") == i).drop("part"), ["id"], POLICY) for i in range(3)]
    merged = lattice.met(halves[0].union(halves[1]), ["id"], POLICY).union(halves[2])
    assert rows_of(lattice.resolved(lattice.met(merged, ["id"], POLICY), ["id"], POLICY)) == whole


def test_prints_tell_tables_apart_whatever_their_order(spark):
    df = spark.createDataFrame([(1, "a", {"k": 1}), (2, None, None), (2, None, None)], "x int, y string, m map<string,int>")
    own = prints.fingerprint(df)
    assert own == prints.fingerprint(df.repartition(3)) == prints.fingerprint(df.orderBy(F.desc("x"))) == prints.fingerprint(df.select("y", "m", "x"))
    others = [df.limit(2), df.withColumn("y", F.coalesce("y", F.lit(""))), df.withColumnRenamed("y", "z"), df.union(df.limit(1)), df.select(F.col("x").cast("long"), "y", "m")]
    found = {prints.fingerprint(x) for x in others}
    assert own not in found and len(found) == len(others)


def test_only_changes_are_written(spark, tmp_path):
    kept = prints.Materialised(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        kept.read()
    df = spark.range(20).withColumn("v", F.col("id") % 3)
    assert [kept.write(x) for x in (df, df.repartition(4), df.where("id <> 3"), df.where("id <> 3"), df)] == [True, False, True, False, True]
    assert sorted(r.id for r in kept.read().collect()) == list(range(20)) and len(kept.versions()) == 3


def test_damaged_chunks_are_named(spark):
    rows = spark.range(100).select((F.col("id") % 2).alias("k"), F.floor(F.col("id") / 2).alias("place"), F.concat(F.lit("v"), "id").alias("v"))
    tree = lambda df: prints.merkle(prints.chunk_digests(df, "k", ["place"], 4), "k", fan=3)
    known = tree(rows)
    assert known.where("level = 3").count() == 2 and prints.damaged(known, tree(rows.repartition(7)), "k").collect() == []
    damage = rows.where("NOT (k = 0 AND place >= 48)").withColumn("v", F.when((F.col("k") == 1) & (F.col("place") == 9), "x").otherwise(F.col("v")))
    more = damage.union(spark.createDataFrame([(1, 55, "new"), (5, 0, "key")], "k long, place long, v string"))
    assert {tuple(r) for r in prints.damaged(known, tree(more), "k").collect()} == {(0, 12, "missing"), (1, 2, "changed"), (1, 13, "added"), (5, 0, "added")}


def test_pages_join_to_the_whole_and_stale_tokens_are_refused(spark):
    df = spark.createDataFrame([(i % 4 if i % 5 else None, i) for i in range(23)], "a int, b int")
    token, found = None, []
    while not found or token:
        rows, token = prints.page(df, ["a", "b"], 5, token)
        found += [tuple(r) for r in rows.collect()]
    assert found == [tuple(r) for r in df.orderBy("a", "b").collect()]
    _, token = prints.page(df, ["a", "b"], 5)
    with pytest.raises(prints.StaleToken):
        prints.page(df.where("b <> 22"), ["a", "b"], 5, token)


def test_coverage_of_requests(spark):
    asked = [(1, 7, 5), (1, 7, 6), (1, 7, 5), (1, 3, 40_000), (1, 3, 9), (1, 2, 9), (2, 1, 4), (3, 1, None)]
    given = [(1, 40_000), (1, 9), (1, 1), (1, None)]
    found = coverage.coverage(spark.createDataFrame(asked, "o int, a int, v int"), spark.createDataFrame(given, "o int, v int"), "o", "a", "v")
    assert {tuple(r) for r in found.collect()} == {(1, 3, 2, 3, 2), (2, 1, 1, None, 0)}  # the first of equally large requests


def test_columns_of_nested_records(spark):
    rows = [(3, '{"b": {"x": 1, "y": {"z": "t"}}, "a": null}'), (1, '{"a": 2.5, "c": [1, 2]}'), (2, '{"b": 7}'), (4, "{}"), (5, None)]
    df = spark.createDataFrame(rows, "place int, text string").select("place", F.parse_json("text").alias("r"))
    found = coverage.ordered(coverage.paths(df, "r"), ["b.y.z", "nowhere"])
    assert [(r.path, r.types, r.n) for r in found.orderBy("column").collect()] == [("b.y.z", ["STRING"], 1), ("a", ["DECIMAL", "VOID"], 2), ("c", ["ARRAY"], 1), ("b", ["BIGINT"], 1), ("b.x", ["BIGINT"], 1)]
    assert {r.path for r in coverage.paths(df, "r", deepest=2).where("type = 'OBJECT'").collect()} == {"b.y"}


def test_only_pairs_of_changed_observations_are_derived(spark, tmp_path):
    rows = [(day, key, float(day * key % 4)) for day in range(1, 7) for key in range(5) if (day + key) % 4]
    store = pairs.PairStore(spark, f"{tmp_path}/pairs")

    def update(rows):
        df = spark.createDataFrame(rows, "day int, key int, v double").repartition(3)
        return store.update(df, "day", "key", "v"), {(r.older_at, r.newer_at, r.key): (r.before, r.after, r.change) for r in store.read(df, "day").collect()}

    def plain(rows):
        days, out = sorted({r[0] for r in rows}), {}
        for a, b in zip(days, days[1:], strict=False):
            x, y = ({k: v for d, k, v in rows if d == day and v is not None} for day in (a, b))
            for k in x.keys() | y.keys():
                if x.get(k) != y.get(k):
                    out[a, b, k] = (x.get(k), y.get(k), "appeared" if k not in x else "disappeared" if k not in y else "changed")
        return out

    assert update(rows) == (5, plain(rows))
    assert update(rows[::-1]) == (0, plain(rows))
    changed = [(d, k, 9.0 if (d, k) == (3, 2) else v) for d, k, v in rows]
    assert update(changed) == (2, plain(changed))
    without = [r for r in rows if r[0] != 4]
    assert update(without) == (1, plain(without))  # days 3 and 5 are now next to each other
    assert update(rows) == (0, plain(rows))  # all known from before


def test_the_most_specific_revision_holds(spark):
    day = datetime.datetime
    revisions = [(None, None, day(2020, 1, 1), None, "any"), ("a", None, day(2020, 3, 1), day(2020, 6, 1), "a1"), ("a", None, day(2020, 6, 1), None, "a2"), (None, "x", day(2020, 4, 1), day(2020, 5, 1), "x"), ("a", "x", day(2020, 4, 10), day(2020, 4, 10), "never")]
    facts = [(1, "a", "y", day(2019, 12, 31)), (2, "a", "y", day(2020, 1, 1)), (3, "a", "y", day(2020, 3, 1)), (4, "a", "y", day(2020, 6, 1)), (5, "b", "x", day(2020, 4, 30, 23)), (6, "b", "x", day(2020, 5, 1)), (7, None, None, day(2025, 1, 1)), (8, "a", "x", None), (9, "a", "x", day(2020, 4, 10))]
    found = pairs.revision_at(
        spark.createDataFrame(facts, "id int, k string, s string, t timestamp"), spark.createDataFrame(revisions, "k string, s string, valid_from timestamp, valid_to timestamp, revision string"), "t", ["k", "s"], bucket_days=7
    )
    got = {r.id: r.revision for r in found.collect()}
    assert {**got, 9: got[9] in ("a1", "x")} == {1: None, 2: "any", 3: "a1", 4: "a2", 5: "x", 6: "any", 7: "any", 8: None, 9: True}
    assert got[9] == "x"  # both give one key: the later beginning holds


def test_coverage_takes_small_sets_as_rows(spark):
    asked = [(1, 1, -5), (1, 1, 2**62), (1, 2, 2**62), (1, 2, 0), (1, 2, 7)]
    df = spark.createDataFrame(asked, "o long, a long, v long")
    found = coverage.coverage(df, df.where("v > 7"), "o", "a", "v")
    assert "bitmap" not in found._jdf.queryExecution().executedPlan().toString()  # 4 kB for each set of each request
    assert [tuple(r) for r in found.collect()] == [(1, 2, 3, 1, 1)]
