"""Identifiers of mesh devices and networks as column expressions (STR-F01..F14).

Everything is built from Catalyst functions, so it stays in generated code and can be pushed below joins.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that stand for "no label" (fixed values).
PLACEHOLDER_LABELS = ["unknown", "n/a", "none", "-", "?"]


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it: it is the only entry of an array."""
    return F.element_at(F.transform(F.array(c), f), 1)


def identifier(c: Column | str) -> Column:
    """STR-F01: trimmed and lower-cased; empty becomes null."""
    return F.nullif(F.lower(F.trim(column(c))), F.lit(""))


def ext_address(c: Column | str) -> Column:
    """STR-F02: sixteen hex digits without separators; null if malformed or all zero."""
    bare = F.regexp_replace(identifier(c), "[:-]", "")
    return F.when(bare.rlike("^[0-9a-f]{16}$") & (bare != "0" * 16), bare)


def device_id(c: Column | str) -> Column:
    """STR-F02: the device id of an extended address."""
    return F.concat(F.lit("extaddr:"), ext_address(c))


def is_placeholder_label(c: Column | str) -> Column:
    """STR-F03: no label, or a word that stands for none."""
    clean = identifier(c)
    return clean.isNull() | clean.isin(PLACEHOLDER_LABELS)


def ext_pan_id(c: Column | str) -> Column:
    """STR-F04: sixteen hex digits (also behind 0x), else decimal text as hex; sixteen digits read as hex first."""
    clean = identifier(c)
    bare = F.regexp_replace(clean, "^0x", "")
    decimal = F.when(clean.rlike("^[0-9]{1,19}$"), F.lower(F.lpad(F.hex(clean.try_cast("bigint")), 16, "0")))
    return F.when(bare.rlike("^[0-9a-f]{16}$"), bare).otherwise(decimal)


def rloc16(number: Column | str) -> Column:
    """STR-F05: 0x and four hex digits."""
    return F.format_string("0x%04x", column(number).cast("int"))


def rloc16_number(text: Column | str) -> Column:
    """STR-F05: the number behind a locator; null if malformed."""
    clean = identifier(text)
    return F.when(clean.rlike("^0x[0-9a-f]{1,4}$"), F.conv(F.substring(clean, 3, 4), 16, 10).cast("int"))


def is_router(number: Column | str) -> Column:
    """STR-F05: the low ten bits are zero."""
    return column(number).bitwiseAND(F.lit(1023)) == 0


def parent(number: Column | str) -> Column:
    """STR-F05: the router above: the low ten bits cleared."""
    return F.shiftleft(F.shiftright(column(number), 10), 10)


def router_id(c: Column | str) -> Column:
    """STR-F06: decimal or 0x text in 0..62, else null."""
    clean = identifier(c)
    number = F.when(clean.rlike("^0x[0-9a-f]{1,4}$"), F.conv(F.regexp_replace(clean, "^0x", ""), 16, 10).cast("int")).when(clean.rlike("^[0-9]{1,4}$"), clean.cast("int"))
    return F.when(number.between(0, 62), number)


def partition_id(c: Column | str) -> Column:
    """STR-F07: 0x and up to eight hex digits, or a decimal, in 0..2**32-1."""
    clean = identifier(c)
    number = F.when(clean.rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.regexp_replace(clean, "^0x", ""), 16, 10).cast("long")).when(clean.rlike("^[0-9]{1,10}$"), clean.cast("long"))
    return F.when(number.between(0, 2**32 - 1), number)


def base64_to_ext_address(c: Column | str, reverse: bool = False) -> Column:
    """STR-F08: eight bytes of base64 as hex, byte-reversed if asked for; backslash-escaped slashes count as slashes."""
    text = F.lower(F.hex(F.unbase64(F.regexp_replace(column(c), r"\\/", "/"))))
    if reverse:
        text = F.concat(*[F.substring(text, 15 - 2 * i, 2) for i in range(8)])
    return F.when(F.length(text) == 16, text)


def composite(fabric: Column | str, node: Column | str) -> Column:
    """STR-F10: fabric and node as hex digits joined by a bar."""
    return F.format_string("%016x|%016x", column(fabric).cast("long"), column(node).cast("long"))


def redacted(c: Column | str, keys: list[str]) -> Column:
    """STR-F11: the values of credential keys in JSON text, masked."""
    return F.regexp_replace(column(c), '("(?:' + "|".join(keys) + ')"\\s*:\\s*)("[^"]*"|[0-9.]+)', '$1"***"')


def relationship_id(a: Column | str, b: Column | str) -> Column:
    """STR-F12: link:from->to; null for a link of a device to itself."""
    a, b = column(a), column(b)
    return F.when(a != b, F.concat(F.lit("link:"), a, F.lit("->"), b))


def stable_id(*parts: Column | str) -> Column:
    """STR-F13: the first 24 hex digits of sha256 over parts joined by NUL."""
    joined = reduce(lambda x, y: F.concat(x, F.lit("\0"), y), [F.coalesce(column(p).cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 24)


def anycast_border_router(address: Column | str) -> Column:
    """STR-F14: whether the last group of an address lies in fc10..fc1f, compared as text."""
    last = F.element_at(F.split(identifier(address), ":"), -1)
    return F.coalesce(last.between("fc10", "fc1f"), F.lit(False))


def valid_label(c: Column | str, longest: int = 64) -> Column:
    """STR-F09: a label of 1 to ``longest`` characters that is no placeholder, trimmed; else null."""
    clean = F.trim(column(c))
    return F.when(~is_placeholder_label(c) & (F.length(clean) <= longest), clean)
