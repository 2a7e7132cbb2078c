"""Semi-structured snapshots as rows: envelopes, text sections, TLV bytes and nested link tables (SRC, PRJ, JSN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def extract_records(files: DataFrame, content: str, envelope: str = "data") -> DataFrame:
    """SRC-01/03: the items of a JSON array, or of an envelope with one, or the single object, as VARIANT rows; others go."""
    v = F.try_parse_json(content)
    parsed = files.withColumn("_v", v).where("_v IS NOT NULL")
    shape = F.schema_of_variant("_v")
    inner = F.try_variant_get("_v", f"$.{envelope}", "variant")
    parsed = parsed.withColumn("_items", F.when(shape.startswith("ARRAY"), F.col("_v")).when(F.coalesce(F.schema_of_variant(inner).startswith("ARRAY"), F.lit(False)), inner).otherwise(F.parse_json(F.concat(F.lit("["), F.to_json("_v"), F.lit("]")))))
    keep = [c for c in files.columns if c != content]
    out = parsed.select(*keep, F.variant_get("_items", "$", "array<variant>").alias("_list")).select(*keep, F.explode("_list").alias("record"))
    return out.where(F.schema_of_variant("record").startswith("OBJECT"))


def lifted(record: str, field: str, kind: str = "string") -> Column:
    """JSN-F04: a field of a record, else of its attributes."""
    return F.coalesce(F.try_variant_get(record, f"$.{field}", kind), F.try_variant_get(record, f"$.attributes.{field}", kind))


def aliased(record: str, names: list[str], kind: str = "string") -> Column:
    """PRJ-01: the first of several names with a value that is not empty."""
    return F.coalesce(*[F.nullif(lifted(record, n, kind), F.lit("")) if kind == "string" else lifted(record, n, kind) for n in names])


def tokens(text: str, name: str) -> Column:
    """SRC-09/10/16: the integer behind ``name:`` in text, or null."""
    found = F.regexp_extract(text, rf"(?m)^\s*{name}:\s*(-?\d+)\s*$", 1)
    return F.nullif(found, F.lit("")).cast("long")


def time_shares(text: str, roles: list[str]) -> list[Column]:
    """SRC-11: role times and their percent of the tracked time (one decimal), where time was tracked."""
    times = {r: F.coalesce(tokens(text, r), F.lit(0)) for r in roles}
    total = sum(times.values(), F.lit(0))
    return [F.when(total > 0, F.floor(1000 * t / total + 0.5) / 10).alias(f"{r}_percent") for r, t in times.items()]


def table_rows(files: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """SRC-23: rows of a text table with as many cells as named columns; rules and headers go."""
    keep = [c for c in files.columns if c != text]
    lines = files.select(*keep, F.posexplode(F.split(text, r"\r?\n")).alias("line", "raw")).where(F.col("raw").startswith("|") & ~F.col("raw").rlike(r"^\|[-+|]*$"))
    cells = F.transform(F.filter(F.split(F.trim("raw"), r"\|"), lambda x, i: i > 0), lambda x: F.trim(x))
    rows = lines.select(*keep, "line", cells.alias("c")).where((F.size("c") == len(columns) + 1) & F.col("c")[0].rlike(r"^\d+$|^0x"))
    return rows.select(*keep, "line", *[F.col("c")[i].alias(n) for i, n in enumerate(columns)])


def tlv(hex_text: Column) -> Column:
    """SRC-15: (type, length, value in hex) entries of a hex payload; an entry that reaches past the end ends the list."""
    start = F.struct(F.lower(hex_text).alias("rest"), F.array().cast("array<struct<type:int,length:int,value:string>>").alias("out"), F.lit(True).alias("valid"))

    def step(s: Column, _: Column) -> Column:
        kind = F.conv(F.substring(s["rest"], 1, 2), 16, 10).cast("int")
        length = F.conv(F.substring(s["rest"], 3, 2), 16, 10).cast("int")
        fits = s["valid"] & (F.length(s["rest"]) >= 4) & (F.length(s["rest"]) >= 4 + 2 * length)
        entry = F.struct(kind.alias("type"), length.alias("length"), s["rest"].substr(F.lit(5), 2 * length).alias("value"))
        rest = s["rest"].substr(5 + 2 * length, F.length(s["rest"]))
        return F.struct(
            F.when(fits, rest).otherwise(s["rest"]).alias("rest"), F.when(fits, F.concat(s["out"], F.array(entry.cast("struct<type:int,length:int,value:string>")))).otherwise(s["out"]).alias("out"), fits.alias("valid")
        )

    most = F.greatest(F.lit(1), F.coalesce(F.floor(F.length(hex_text) / 4), F.lit(0))).cast("int")  # an entry has four digits at least
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["out"])


def flatten_links(devices: DataFrame, owner: str, array: str, fields: list[str]) -> DataFrame:
    """GRF-08/09: one row for each entry of a nested link table, with its place; owners without entries go."""
    entries = devices.select(owner, F.posexplode(array).alias("place", "x"))
    return entries.select(owner, "place", *[F.col(f"x.{f}").alias(f) for f in fields])
