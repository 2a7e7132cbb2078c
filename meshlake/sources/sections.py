"""Command-line text of mesh diagnostics as tables: sections, tables of cells, lists, and flags.

All work on a text column with Spark's own functions. Missing sections and values that don't parse give nulls or no rows; repeated
lines give repeated rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.sources.records import table_rows


def hex_number(c: Column) -> Column:
    """The number of a text like 0x1c00 or 1c00; null for anything else."""
    return F.when(c.rlike(r"^(0[xX])?[0-9a-fA-F]+$"), F.conv(F.regexp_replace(c, "^0[xX]", ""), 16, 10).cast("long"))


def rloc_text(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.lpad(F.hex(c), 4, "0")))


def child_rows(files: DataFrame, text: str, parent: str, others: Sequence[str] = ()) -> DataFrame:
    """SRC-08: children of a table headed by ID and RLOC16, one row each; without an address of its own a child has its parent's router bits and its id."""
    columns = ["id", "rloc16", "timeout", "age", "lq_in"]
    rows = table_rows(files, text, columns)
    derived = F.shiftleft(F.shiftright(hex_number(F.col(parent)), 10), 10) + F.col("id").cast("long")
    return rows.select(*others, parent, F.col("id").cast("int"), rloc_text(F.coalesce(hex_number(F.col("rloc16")), derived)).alias("rloc16"), F.col("timeout").cast("int"), F.col("age").cast("int"), F.col("lq_in").cast("int"))


def section(text: Column, name: str) -> Column:
    """The indented lines behind the line ``name:``."""
    return F.regexp_extract(text, rf"(?m)^{name}:\s*\n((?:[ \t]+.*(?:\n|$))+)", 1)


def number_in(text: Column, name: str) -> Column:
    """The number behind ``name:`` on a line of its own."""
    return F.nullif(F.regexp_extract(text, rf"(?m)^\s*-?\s*{name}:\s*(-?\d+)\s*$", 1), F.lit("")).cast("long")


def leader_data(text: Column) -> Column:
    """SRC-12: the leader section as a struct; its fields are null where the section lacks them."""
    inside = section(text, "Leader Data")
    names = {"partition_id": "PartitionId", "weighting": "Weighting", "data_version": "DataVersion", "leader_router_id": "LeaderRouterId"}
    return F.struct(*[number_in(inside, n).alias(c) for c, n in names.items()])


def route_entries(files: DataFrame, text: str, owner: str) -> DataFrame:
    """SRC-13: a row for each entry of the route section, with the section's sequence number and the entry's place."""
    inside = section(F.col(text), "Route")
    entries = F.filter(F.split(inside, r"(?=- RouterId:)"), lambda x: x.contains("RouterId:"))
    rows = files.select(owner, number_in(inside, "IdSequence").alias("id_sequence"), F.posexplode(entries).alias("place", "x"))
    names = {"router_id": "RouterId", "lq_out": "LinkQualityOut", "lq_in": "LinkQualityIn", "cost": "RouteCost"}
    return rows.select(owner, "id_sequence", "place", *[number_in(F.col("x"), n).alias(c) for c, n in names.items()])


def mode_flags(text: Column) -> Column:
    """SRC-14: the letters of a mode line as flags: r receiver on when idle, d full device, n full network data."""
    letters = F.regexp_extract(text, r"(?m)^Mode:\s*([rdn-]+)\s*$", 1)
    return F.when(letters != "", F.struct(letters.contains("r").alias("rx_on"), letters.contains("d").alias("full_device"), letters.contains("n").alias("full_data")))


def addresses(text: Column) -> Column:
    """SRC-14: the IPv6 addresses listed in their section, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(section(text, "IPv6 Address List"), F.lit(r"-\s*([0-9a-fA-F:]+)\s*(?:\n|$)"), 1))
