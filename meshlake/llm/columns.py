"""Columns found by their exact names, whatever other columns a table has (dots, names that differ in case only, repeats)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(df: DataFrame, name: str) -> int:
    """The position of the column with that name: the same letters before the same but for case."""
    for alike in (lambda c: c == name, lambda c: c.lower() == name.lower()):
        found = [i for i, c in enumerate(df.columns) if alike(c)]
        if found:
            return found[0]
    raise ValueError(f"no column {name} in {df.columns}")


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns _0, _1 and so on."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns))))


def column(df: DataFrame, name: str) -> Column:
    """The column of ``numbered(df)`` that has that name in df."""
    return F.col(f"_{place(df, name)}")


def known(df: DataFrame, *names: str) -> DataFrame:
    """The same rows with the named columns under these names and all others numbered, so that no other name clashes."""
    at = {place(df, c): c for c in names}
    return df.toDF(*(at.get(i, f"_{i}") for i in range(len(df.columns))))


def only(df: DataFrame, **types: str) -> DataFrame:
    """The named columns alone, cast to the types given."""
    return numbered(df).select(*(column(df, c).cast(t).alias(c) for c, t in types.items()))
