import math

import pytest
from pyspark.sql import functions as F

from meshlake.operators import conditions as C
from meshlake.operators.conditions import Condition

ROWS = [
    (1, 5.0, True, [1.0, 2.0, None]),
    (2, 4.9, False, [3.0]),
    (3, None, None, []),
    (4, math.nan, True, None),
    (5, math.inf, True, [math.nan, 9.0]),
    (6, -1.0, True, [2.0, 2.0]),
]


def run(spark, *conditions, worst=False):
    df = spark.createDataFrame(ROWS, "id int, x double, g boolean, a array<double>")
    found = C.evaluations(conditions, {"x": F.col("x")}, {"a": (F.col("a"), {"v": lambda e: e})}, {"g": F.col("g")})
    df = df.select("id", (C.worst_of_groups(found) if worst else found).alias("found"))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    return {r.id: {e.name: (e.metric, e.met) for e in r.found} for r in df.collect()}


def test_each_comparison_on_and_beside_its_bound(spark):
    table = [(">=", 5.0), (">", 4.9), ("<=", 4.9), ("<", 5.0), ("==", 5.0), ("!=", 5.0), ("[)", (4.9, 5.0)), ("[]", (4.9, 5.0))]
    got = run(spark, *(Condition(how, "", "", "x", how, t, "low") for how, t in table))
    assert {k: v[1] for k, v in got[1].items()} == {">=": True, ">": True, "<=": False, "<": False, "==": True, "!=": False, "[)": False, "[]": True}
    assert {k: v[1] for k, v in got[2].items()} == {">=": False, ">": False, "<=": True, "<": True, "==": False, "!=": True, "[)": True, "[]": True}
    assert got[3] == got[4] == got[5] == {}  # no number: no evaluation


def test_entries_any_all_and_count(spark):
    got = run(spark, *(Condition(str(how), "", "a", "v", "<=", 2, "low", how=how) for how in ("any", "all", 2)))
    assert {i: {k for k, (_, met) in v.items() if met} for i, v in got.items()} == {1: {"any", "all", "2"}, 2: set(), 3: set(), 4: set(), 5: set(), 6: {"any", "all", "2"}}
    assert got[1]["any"][0] == 1.0  # the least, where small numbers match
    got = run(spark, Condition("many", "", "a", "v", ">=", 2, "low", how="all"))
    assert got[1]["many"] == (2.0, False) and got[6]["many"] == (2.0, True) and got[5]["many"] == (9.0, True)


def test_guards_and_the_worst_of_a_group(spark):
    table = [Condition("low", "one", "", "x", ">=", -5, "low"), Condition("high", "one", "", "x", ">=", 4.9, "high"), Condition("other", "two", "", "x", "<", 5, "info", guard="g")]
    assert {i: set(v) for i, v in run(spark, *table, worst=True).items()} == {1: {"high"}, 2: {"high"}, 3: set(), 4: set(), 5: set(), 6: {"low", "other"}}


@pytest.mark.parametrize("wrong", [Condition("a", "", "", "x", "~", 1, "low"), Condition("a", "", "", "x", ">", math.nan, "low"), Condition("a", "", "", "x", ">", 1, "bad"), Condition("a", "", "", "x", ">", 1, "low", how="all"), Condition("a", "", "a", "v", ">", 1, "low", how=0)])
def test_wrong_conditions_are_refused(spark, wrong):
    with pytest.raises(ValueError):
        run(spark, wrong)


def test_every_condition_is_met_and_missed(spark):
    from meshlake.plans import catalog

    rows = catalog.QUERIES["flt05_condition_counts"](spark, "/root/testdata/sf0.001").collect()
    assert len(C.DEVICE_CONDITIONS) == len(rows) == 42
    over = {c.name: c.over for c in C.DEVICE_CONDITIONS}
    assert all(r.devices_met > 0 and (r.devices_missed > 0 or over[r.name]) for r in rows)
    orders = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey").distinct().count()
    assert all(r.devices_met < orders for r in rows)


def test_conditions_are_evaluated_once_a_row(spark):
    from meshlake.plans import catalog

    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    plan = catalog.QUERIES["flt05_conditions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert [plan.count(c.name + ",") for c in C.DEVICE_CONDITIONS] == [1] * 42


def test_any_entry_by_each_comparison(spark):
    table = [(">=", 2, 2.0), (">", 1, 2.0), ("<=", 1, 1.0), ("<", 2, 1.0), ("==", 1, 1.0), ("!=", 1, 2.0), ("[)", (1, 2), 1.0), ("[]", (1, 2), 1.0)]
    got = run(spark, *(Condition(how, "", "a", "v", how, t, "low") for how, t, _ in table))
    assert got[1] == {how: (x, True) for how, _, x in table}
    assert set(got[2]) == {">=", ">", "!="} and got[3] == got[4] == {}
