import json

import pytest
from pyspark.sql import functions as F

from meshlake.operators import graph, relational
from meshlake.sources import records
from meshlake.streaming import processors, queries, state


def test_records_from_arrays_envelopes_and_objects(spark):
    rows = [
        ("a", json.dumps([{"rloc16": "0x4400", "extAddress": "AA"}, 5, {"attributes": {"rloc16": "0x4401"}}])),
        ("b", json.dumps({"data": [{"id": 1, "attributes": {"extAddress": "BB", "rloc16": "0x0800"}, "rloc16": ""}]})),
        ("c", json.dumps({"rloc16": "0x1"})),
        ("d", "not json"),
        ("e", None),
    ]
    out = records.extract_records(spark.createDataFrame(rows, "path string, content string"), "content")
    found = {(r.path, r.r, r.e) for r in out.select("path", records.aliased("record", ["rloc", "rloc16"]).alias("r"), records.lifted("record", "extAddress").alias("e")).collect()}
    assert found == {("a", "0x4400", "AA"), ("a", "0x4401", None), ("b", None, "BB"), ("c", "0x1", None)}  # a present field, even empty, is not overwritten


def test_text_sections(spark):
    text = "Counters:\n  TxTotal: 12\n  RxTotal: -1\nleader: 300\nrouter: 100\nother: x\n"
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    got = df.select(records.tokens("t", "TxTotal").alias("tx"), records.tokens("t", "other").alias("o"), *records.time_shares("t", ["leader", "router"])).collect()
    assert tuple(got[0]) == (12, None, 75.0, 25.0) and tuple(got[1]) == (None,) * 4 and tuple(got[2]) == (None,) * 4


def test_text_tables(spark):
    text = "| ID | RLOC16 |\n+----+--------+\n|  1 | 0x0400 |\n|  2 | 0x0800 |\n| 3 |\nDone"
    rows = records.table_rows(spark.createDataFrame([("f", text)], "path string, t string"), "t", ["id", "rloc16"]).collect()
    assert [(r.path, r.id, r.rloc16) for r in rows] == [("f", "1", "0x0400"), ("f", "2", "0x0800")]


def test_tlv(spark):
    df = spark.createDataFrame([("0102ABCD0500",), ("0103AB",), ("",)], "h string")
    got = [[tuple(x) for x in r[0]] for r in df.select(records.tlv(F.col("h"))).collect()]
    assert got == [[(1, 2, "abcd"), (5, 0, "")], [], []]


def test_nested_links(spark):
    df = spark.createDataFrame([("a", [("0x1", 3), ("0x2", 1)]), ("b", [])], "d string, links array<struct<to:string,lq:int>>")
    assert {tuple(r) for r in records.flatten_links(df, "d", "links", ["to", "lq"]).collect()} == {("a", 0, "0x1", 3), ("a", 1, "0x2", 1)}


@pytest.fixture
def stream_folder(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 5.0), (1, "2024-01-01 00:05:00", 9.0), (2, "2024-01-01 00:01:00", 1.0), (1, "2024-01-01 01:30:00", 2.0)]
    spark.createDataFrame(rows, "k long, t string, v double").selectExpr("k", "CAST(t AS TIMESTAMP) AS t", "v").coalesce(1).write.parquet(f"{tmp_path}/in")
    return f"{tmp_path}/in"


SCHEMA = "k long, t timestamp, v double"


def run(spark, df, name, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_windows_and_sessions(spark, stream_folder, tmp_path):
    s = spark.readStream.schema(SCHEMA).parquet(stream_folder)
    assert {(r.k, r.n) for r in run(spark, state.windowed_counts(s, "t", "k"), "w", tmp_path, "complete")} >= {(1, 2), (2, 1), (1, 1)}
    assert len(run(spark, state.once(s, "k", "t"), "o", tmp_path)) == 2
    assert {(r.k, r.n) for r in run(spark, state.sessions(s, "t", "k"), "s", tmp_path, "complete")} == {(1, 2), (2, 1), (1, 1)}


def told(spark, folder, operator, name, tmp_path, mode):
    """All rows of a stream with timers, after one more file each time that came later."""
    stream = operator(spark.readStream.schema("id long, k long, t timestamp, v double").parquet(folder))
    return [tuple(r) for r in queries.told(stream, f"{tmp_path}/{name}", mode).collect()]


def put(spark, folder, rows):
    spark.createDataFrame(rows, "id long, k long, t string, v double").selectExpr("id", "k", "CAST(t AS TIMESTAMP) AS t", "v").coalesce(1).write.mode("append").parquet(folder)


def test_absences_go_on_after_a_restart(spark, tmp_path):
    folder = f"{tmp_path}/in"
    put(spark, folder, [(1, 1, "2024-01-01 05:00:00", 0.0), (2, 2, "2024-01-01 06:00:00", 0.0), (3, 2, "2024-01-03 06:00:00", 0.0)])
    operator = lambda s: processors.absences(s, "k", "t")
    first = told(spark, folder, operator, "a", tmp_path, "update")
    assert sorted(first) == [(1, 19723, 0), (1, 19725, 2), (2, 19725, 0)]
    put(spark, folder, [(4, 2, "2024-01-05 01:00:00", 0.0), (5, 1, "2024-01-02 00:00:00", 0.0)])  # the second is later than the watermark: dropped
    again = told(spark, folder, operator, "a", tmp_path, "update")  # from its checkpoint
    assert sorted(again) == [*sorted(first)[:1], (1, 19725, 2), (1, 19727, 4), (2, 19725, 0), (2, 19727, 0)]
    put(spark, folder, [(6, 1, "2024-01-05 02:00:00", 0.0)])  # turns up on the last day counted
    assert (1, 19727, 0) in told(spark, folder, operator, "a", tmp_path, "update")


def test_forgotten_keys_are_told_once_more(spark, tmp_path):
    folder = f"{tmp_path}/in"
    put(spark, folder, [(1, 1, "2024-01-01 05:00:00", 0.0), (2, 2, "2024-01-04 06:00:00", 0.0)])
    operator = lambda s: processors.absences(s, "k", "t", forget_after=3)
    assert (1, 19726, 3) in told(spark, folder, operator, "f", tmp_path, "update")
    put(spark, folder, [(3, 2, "2024-01-09 06:00:00", 0.0)])
    assert [x for x in told(spark, folder, operator, "f", tmp_path, "update") if x[0] == 1 and x[1] > 19726] == []


def test_counter_changes_in_event_time_over_batches(spark, tmp_path):
    folder = f"{tmp_path}/in"
    put(spark, folder, [(1, 1, "2024-01-01 00:00:00", 5.0), (2, 1, "2024-01-01 00:10:00", 9.0), (3, 2, "2024-01-01 00:10:00", 1.0)])
    operator = lambda s: processors.counter_changes(s, "k", "t", "id", "v", "5 minutes")
    assert told(spark, folder, operator, "c", tmp_path, "append") == [(1, 1, "first", None)]  # the watermark is at 00:05
    put(spark, folder, [(4, 1, "2024-01-01 00:07:00", 3.0), (5, 1, "2024-01-01 00:30:00", 1.0), (6, 2, "2024-01-01 00:40:00", 1.0), (7, 1, "2024-01-01 00:01:00", 7.0)])  # out of order; too late
    found = sorted(told(spark, folder, operator, "c", tmp_path, "append"), key=lambda x: x[1])
    assert found == [(1, 1, "first", None), (1, 2, "delta", 6.0), (2, 3, "first", None), (1, 4, "reset-detected", None), (1, 5, "reset-detected", None)]


def test_last_known_keeps_newer_rows(spark, stream_folder, tmp_path):
    known = state.LastKnown(f"{tmp_path}/known", "k", ["t"], ["t", "v"])
    known.start(spark.readStream.schema(SCHEMA).parquet(stream_folder), f"{tmp_path}/cp").awaitTermination(120)
    late = spark.createDataFrame([(1, 99.0), (3, 7.0)], "k long, v double").selectExpr("k", "TIMESTAMP '2020-01-01' AS t", "v")
    known.upsert(late, 1)
    known.upsert(late, 1)
    assert {(r.k, r.v) for r in spark.read.parquet(known.path(1)).collect()} == {(1, 2.0), (2, 1.0), (3, 7.0)}


def test_serial_merge_is_a_fold_in_order(spark):
    import duckdb

    from meshlake.plans import catalog

    folder = "/root/testdata/sf0.001"
    rows = duckdb.sql(f"SELECT l_orderkey, l_linenumber, l_partkey % 256, l_suppkey FROM '{folder}/lineitem.parquet' ORDER BY 1, 2, 3, 4").fetchall()
    want = {}
    for order, _, serial, supp in rows:
        held = want.get(order)
        if held is None or 0 < (serial - held[0]) % 256 < 128:
            want[order] = (serial, supp)
    found = {r.l_orderkey: (r.serial, r.supp) for r in catalog.QUERIES["agg07_serial_merge"](spark, folder).collect()}
    assert found == want


def test_addresses(spark):
    from meshlake.functions import network

    rows = ["::1", "FE80::1:2", "1:2:3:4:5:6:7:8", "1::2::3", "12345::", "g::", None, "::"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "a string").select(network.ipv6_hex("a")).collect()]
    assert got == ["0" * 31 + "1", "fe80" + "0" * 20 + "00010002", "00010002000300040005000600070008", None, None, None, None, "0" * 32]
    v4 = [r[0] for r in spark.createDataFrame([("10.0.1.255",), ("1.2.3",), ("1.2.3.256",)], "a string").select(network.ipv4_hex("a")).collect()]
    assert v4 == ["0a0001ff", None, None]


def test_natural_order_of_long_numbers_and_long_tlv(spark):
    want = ["v2", "v010", "v999999999999", "v1000000000000", "v1000000000000x", "v1000000000001", "w1"]
    df = spark.createDataFrame([(x,) for x in reversed(want)], "v string")
    assert [r.v for r in df.orderBy(relational.natural_key(F.col("v"))).collect()] == want
    got = spark.createDataFrame([("0101ff" * 300,), ("0500" * 300,), (None,)], "h string").select(records.tlv(F.col("h"))).collect()
    assert [len(r[0]) for r in got] == [300, 300, 0]


def test_latest_before_takes_ties_nulls_and_repeats(spark):
    left = spark.createDataFrame([(1, 5), (1, 5), (1, 1), (2, None), (None, 5), (3, 9)], "k int, at int")
    right = spark.createDataFrame([(1, 5, "b"), (1, 5, "c"), (1, 4, "a"), (2, 1, "x"), (None, 1, "y"), (3, None, "z")], "k int, t int, v string")
    for strict, want in ((False, "c"), (True, "a")):
        found = relational.latest_before(left, right, "k", "at", "t", ["v"], strict).collect()
        got = sorted((x.k or 0, x.at or 0, x.v or "") for x in found)
        assert got == sorted([(1, 5, want), (1, 5, want), (1, 1, ""), (2, 0, ""), (0, 5, ""), (3, 9, "")])


def test_places_of_all_rows(spark):
    values = [(i * 7919) % 1000 for i in range(1000)]
    rows = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    assert {x.v: x.place for x in relational.placed(rows, [F.desc("v")]).collect()} == {v: 1000 - v for v in values}
    assert relational.placed(rows.limit(0), [F.desc("v")]).count() == 0


def test_entries_without_a_key_stay(spark):
    rows = spark.createDataFrame([(1, None, 7, 1, "a"), (1, "e", 7, 2, None), (1, "e", 7, 3, "b"), (1, None, 8, 1, "c"), (1, "f", 8, 1, "d"), (1, "g", 8, 1, "d")], "owner int, ext string, rloc int, rank int, x string")
    keyed = relational.with_fallback_key(rows, "owner", "ext", "rloc")
    merged = relational.merge_entries(keyed, "owner", ["ext"], ["rank"], ["x"])
    assert sorted((r.ext or "", r.x) for r in merged.collect()) == [("", "c"), ("e", "a"), ("f", "d"), ("g", "d")]


def test_components_equal_brute_force_on_a_fixture(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (9, 8), (8, 5)], "low int, high int")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 6, 8, 9)], "node int")
    assert {x.node: x.component for x in graph.components(nodes, pairs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 8: 5, 9: 5}


def test_addresses_are_taken_apart_once(spark):
    from meshlake.functions import network

    rows = ["::1", "1::", "::", "FD00:1:2:3::", "1:2:3:4:5:6:7:8", "1::2::3", "1:2:3", "12345::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8::", " ", None, "g::", "1:2:3:4::5:6:7:8"]
    df = spark.createDataFrame([(x,) for x in rows], "a string").select(network.ipv6_hex("a"))
    want = ["0" * 31 + "1", "0001" + "0" * 28, "0" * 32, "fd00000100020003" + "0" * 16, "00010002000300040005000600070008", None, None, None, None, "00010002000300040005000600070008", None, None, None, "00010002000300040005000600070008"]
    assert [r[0] for r in df.collect()] == want
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") < 10
