"""Guards, coercions and arithmetic of metric values (MTH-F01..F08, ARR-F01..F04, DT-F01..F05)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshlake.functions.identity import column


def finite(c: Column | str) -> Column:
    """MTH-F01: the number, or null for NaN and infinities."""
    c = column(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def non_negative(c: Column | str) -> Column:
    """MTH-F01: the number if finite and not below zero."""
    c = finite(c)
    return F.when(c >= 0, c)


def fraction(value: Column | str, source: Column | str, percent_prefix: str) -> Column:
    """MTH-F02: sources whose name begins with the prefix report percents."""
    value = finite(value)
    return F.when(F.coalesce(column(source).startswith(percent_prefix), F.lit(False)), value / 100).otherwise(value)


def points(before: Column | str, after: Column | str) -> Column:
    """MTH-F03: the change of a ratio in percentage points."""
    return (column(after) - column(before)) * 100


def share(part: Column | str, whole: Column | str, least: float = 0.0) -> Column:
    """MTH-F04: 100 * part / whole where whole is at least (and above) ``least``; else null."""
    part, whole = column(part).cast("double"), column(whole).cast("double")
    return F.when((whole >= least) & (whole > 0), part / whole * 100)


def serial_order(current: Column | str, incoming: Column | str, bits: int = 8) -> Column:
    """MTH-F05: newer, older, equal or ambiguous by serial-number arithmetic."""
    size = 1 << bits
    ahead = F.pmod(column(incoming).cast("int") - column(current).cast("int"), F.lit(size))
    return F.when(ahead == 0, "equal").when(ahead == size // 2, "ambiguous").when(ahead < size // 2, "newer").when(ahead > size // 2, "older")


def banded(value: Column | str, bounds: list[tuple[float, int]], below: int) -> Column:
    """MTH-F06: the level of the first bound that the value reaches, from the highest down."""
    out = None
    for bound, level in sorted(bounds, reverse=True):
        out = F.when(column(value) >= bound, level) if out is None else out.when(column(value) >= bound, level)
    return out.when(column(value).isNotNull(), below)


def bit_field(value: Column | str, shift: int, width: int) -> Column:
    """MTH-F07: ``width`` bits from bit ``shift`` up."""
    return F.shiftright(column(value), shift).bitwiseAND(F.lit((1 << width) - 1))


def missing(c: Column | str, kind: str) -> Column:
    """ARR-F01: null or empty; zero and false are values."""
    c = column(c)
    if kind == "string":
        return c.isNull() | (c == "")
    if kind in ("array", "map"):
        return c.isNull() | (F.size(c) == 0)
    return c.isNull()


def first_present(*candidates: Column | str) -> Column:
    """PRJ-01: the first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(column(c), F.lit("")) for c in candidates])


def boolean(c: Column | str) -> Column:
    """ARR-F04: words and numbers for true and false; null for anything else."""
    clean = F.lower(F.trim(column(c).cast("string")))
    return F.when(clean.isin("true", "yes", "on", "1"), True).when(clean.isin("false", "no", "off", "0"), False)


def number(c: Column | str) -> Column:
    """ARR-F04: numeric text as a double; null for anything else."""
    clean = F.trim(column(c))
    return F.when(clean.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), clean.cast("double"))


def instant(c: Column | str) -> Column:
    """DT-F01: ISO-8601 text with an offset as a timestamp; null without one."""
    clean = F.trim(column(c))
    return F.when(clean.rlike(r"(?i)(z|[+-][0-9]{2}:?[0-9]{2})$") & clean.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), F.try_to_timestamp(clean))


def elapsed_seconds(start: Column | str, end: Column | str) -> Column:
    """DT-F02: whole seconds from start to end, rounded down."""
    return F.floor((F.unix_micros(column(end)) - F.unix_micros(column(start))) / 1_000_000).cast("long")
