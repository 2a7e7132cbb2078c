from pyspark.sql import functions as F

from meshlake.operators import devices as D

FIELDS = "flat string, nested string, flag boolean, number double, role string, type string, rloc16 string, is_router boolean, is_leader boolean, is_border_router boolean, total_children int"


def rows(spark, *records):
    """Records as dicts; what they lack is null."""
    names = [f.split()[0] for f in FIELDS.split(", ")]
    return spark.createDataFrame([(i, *(r.get(n) for n in names)) for i, r in enumerate(records)], f"id int, {FIELDS}"), {n: F.col(n) for n in names}


def test_the_first_evidence_of_a_mode_tells(spark):
    given = [
        {}, {"flat": " ftd"}, {"flat": "x", "nested": "mtd"}, {"flag": False, "number": 1.0}, {"number": 0.5}, {"number": -2.0},
        {"role": " Router "}, {"role": "leader", "type": "Sleepy Child"}, {"role": "child", "type": "router"}, {"type": "lamp"}, {"flat": "MTD", "role": "router"},
    ]
    df, record = rows(spark, *given)
    found = [r.m for r in df.select("id", D.mode_device(record).alias("m")).orderBy("id").collect()]
    assert found == [None, "FTD", "MTD", "MTD", "MTD", "FTD", "FTD", "MTD", "MTD", None, "MTD"]


def test_projection_prefers_what_is_said(spark):
    df, record = rows(spark, {}, {"rloc16": "0X1C00"}, {"rloc16": "0x1c00", "role": "child"}, {"rloc16": "0x1c01", "is_router": True}, {"role": "Leader"}, {"role": "leader", "is_leader": False}, {"rloc16": "1c00"})
    links = F.when(F.col("id") == 1, F.array(F.lit(1), F.lit(2)))
    found = D.projection(record | {"mode_device": F.when(F.col("id") == 4, "reed")}, {"links": links})
    got = [(r.is_router, r.is_leader, r.role_evidence, r.device_type, r.n_links) for r in df.select("id", *(c.alias(n) for n, c in found.items())).orderBy("id").collect()]
    assert got == [
        (False, False, "none", "unknown", 0), (True, False, "rloc16-derived", "unknown", 2), (False, False, "explicit", "unknown", 0), (True, False, "explicit", "unknown", 0),
        (True, True, "explicit", "REED", 0), (True, False, "explicit", "unknown", 0), (False, False, "none", "unknown", 0),
    ]


def test_eligible_records(spark):
    df, record = rows(spark, {}, {"rloc16": "0x1C05"}, {"rloc16": "0x1c"}, {"is_border_router": True}, {"is_border_router": False}, {"type": "Child"}, {"role": "sleepy child "}, {"role": "leader"})
    assert sorted(r.id for r in df.where(D.eligible(record)).collect()) == [1, 3, 5, 6]
