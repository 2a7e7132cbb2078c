"""Addresses as fixed-width text, so that sorting and prefix tests are plain comparisons (SRT-03, JON-15, ARR-F03, STR-F14)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meshlake.functions.identity import bound, identifier


def ipv6_hex(c: Column | str) -> Column:
    """The 32 hex digits of an IPv6 address, a :: filled up; null if malformed.

    Each step is bound for the next: written out in place of its name, it would be worked out anew for every use of every use.
    """

    def groups(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def filled(sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        gap = F.when(right.isNotNull(), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))).otherwise(0)
        return F.concat(left, F.array_repeat(F.lit("0"), gap), F.coalesce(right, F.array().cast("array<string>")))

    def text(whole: Column) -> Column:
        good = (F.size(whole) == 8) & F.forall(whole, lambda x: x.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(whole, lambda x: F.lpad(x, 4, "0")), ""))

    def whole(halves: Column) -> Column:
        right = F.when(F.size(halves) == 2, groups(F.try_element_at(halves, F.lit(2))))
        sides = F.struct(groups(halves[0]).alias("left"), right.alias("right"))
        return F.when(F.size(halves) <= 2, bound(sides, lambda x: bound(filled(x), text)))

    return bound(identifier(c), lambda clean: F.when(clean.rlike("^[0-9a-f:]+$"), bound(F.split(clean, "::"), whole)))


def ipv4_hex(c: Column | str) -> Column:
    """Eight hex digits of an IPv4 address; null if malformed."""
    parts = F.split(identifier(c), r"\.")
    good = (F.size(parts) == 4) & F.forall(parts, lambda x: x.rlike("^[0-9]{1,3}$") & (x.try_cast("int") <= 255))
    return F.when(good, F.array_join(F.transform(parts, lambda x: F.lower(F.lpad(F.hex(x.cast("int")), 2, "0"))), ""))


def in_prefix(address_hex: Column, prefix_hex: Column, bits: int) -> Column:
    """Whether an address lies in a network of a multiple of four bits."""
    return F.coalesce(F.substring(address_hex, 1, bits // 4) == F.substring(prefix_hex, 1, bits // 4), F.lit(False))


def camel(c: Column) -> Column:
    """PRJ-02: words joined by _ or - as one word in camel case."""
    parts = F.split(c, "[_-]+")
    return F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, F.lower(x)).otherwise(F.initcap(x))), "")
