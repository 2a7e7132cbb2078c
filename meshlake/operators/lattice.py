"""EVD-06: reconciliation of reports by field policies, each a merge that neither order nor grouping nor repeats of rows can change.

A policy table says for each field how reports of one record meet. Every policy is an aggregate over a lattice, so Spark takes partial
aggregates before the shuffle, and merging merged records again gives the same as merging all reports at once:

* ``ever``: true once any report is true (a false one never takes it back), false if only false ones are known
* ``most``: the greatest
* ``real``: the least by (placeholder, rank, text): real names before placeholders, earlier sources before later ones
* ``longest``: the longest text, the least of equals; ``Unknown`` and empty count as missing
* ``union``: all distinct values of arrays, sorted
* ``agreed``: the one value that all agree on, and a conflict with all values where they don't; ``Unknown`` and empty count as missing
* ``newest``: the value of the newest report that has one (of equal times the greatest value)
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Beginnings of names that stand for a device without one, and the word for a value that isn't known.
PLACEHOLDERS = ("found-", "Unknown-", "Offline-")
UNKNOWN = "Unknown"


def known(c: Column) -> Column:
    """A text, null if it is empty or says that it isn't known."""
    return F.when(~c.isin("", UNKNOWN), c)


def is_placeholder(c: Column) -> Column:
    found = F.lit(False)
    for p in PLACEHOLDERS:
        found = found | c.startswith(p)
    return found


def _filled(c: Column, value: Column) -> Column:
    return F.when(c.isNotNull(), value)


def _all(f: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(f))))


# for each policy: the columns of a partial state from a report, how states meet, and the field's value from a state
State = dict[str, Column]
POLICIES: dict[str, tuple[Callable[[str, Column], State], Callable[[str], State], Callable[[str], State]]] = {
    "ever": (lambda f, at: {f: F.col(f)}, lambda f: {f: F.bool_or(f)}, lambda f: {f: F.col(f)}),
    "most": (lambda f, at: {f: F.col(f)}, lambda f: {f: F.max(f)}, lambda f: {f: F.col(f)}),
    "real": (
        lambda f, at: {f: _filled(known(F.col(f)), F.struct(is_placeholder(F.col(f)).alias("placeholder"), F.col("source_rank").alias("rank"), F.col(f).alias("text")))},
        lambda f: {f: F.min(f)},
        lambda f: {f: F.col(f)["text"]},
    ),
    "longest": (
        lambda f, at: {f: _filled(known(F.col(f)), F.struct((-F.char_length(f)).alias("length"), F.col(f).alias("text")))},
        lambda f: {f: F.min(f)},
        lambda f: {f: F.col(f)["text"]},
    ),
    "union": (lambda f, at: {f: F.col(f)}, lambda f: {f: _all(f)}, lambda f: {f: F.col(f)}),
    "agreed": (
        lambda f, at: {f: _filled(known(F.col(f)), F.array(f))},
        lambda f: {f: _all(f)},
        lambda f: {f: F.when(F.size(f) == 1, F.get(F.col(f), F.lit(0))), f"{f}_conflict": F.when(F.size(f) > 1, F.col(f))},
    ),
    "newest": (lambda f, at: {f: _filled(F.col(f), F.struct(at.alias("at"), F.col(f).alias("value")))}, lambda f: {f: F.max(f)}, lambda f: {f: F.col(f)["value"]}),
}


def states(reports: DataFrame, key: Sequence[str], policy: dict[str, str], at: str) -> DataFrame:
    """One state for each report; ``source_rank`` must be a column where a field is ``real``."""
    made: State = {}
    for field, name in policy.items():
        made |= POLICIES[name][0](field, F.col(at))
    return reports.select(*key, *(c.alias(n) for n, c in made.items()))


def met(rows: DataFrame, key: Sequence[str], policy: dict[str, str]) -> DataFrame:
    """States of a key met into one; what comes out may be met again."""
    aggs: State = {}
    for field, name in policy.items():
        aggs |= POLICIES[name][1](field)
    return rows.groupBy(*key).agg(*(c.alias(n) for n, c in aggs.items()))


def resolved(rows: DataFrame, key: Sequence[str], policy: dict[str, str]) -> DataFrame:
    """The fields of met states; an ``agreed`` field has its conflict, if any, beside it."""
    out: State = {}
    for field, name in policy.items():
        out |= POLICIES[name][2](field)
    return rows.select(*key, *(c.alias(n) for n, c in out.items()))


def reconciled(reports: DataFrame, key: Sequence[str], policy: dict[str, str], at: str) -> DataFrame:
    """EVD-06: one record of a key from all of its reports."""
    return resolved(met(states(reports, key, policy, at), key, policy), key, policy)
