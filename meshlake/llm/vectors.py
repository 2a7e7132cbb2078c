"""Which vectors can be compared, and vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlake.llm.columns import column, numbered


def usable(column: str) -> Column:
    """True for vectors that are not null, not zero, and without null or non-finite components."""
    c = F.col(column)
    fine = F.forall(c, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(c) > 0) & fine & F.exists(c, lambda x: x != 0), F.lit(False))


def with_vectors(df: DataFrame, *more: str) -> DataFrame:
    """vec_id, vector (array<double>) and further columns of the usable rows."""
    rows = numbered(df).select(column(df, "vec_id").cast("long").alias("vec_id"), column(df, "embedding").cast("array<double>").alias("vector"), *(column(df, c).alias(c) for c in more))
    return rows.where("vec_id IS NOT NULL").where(usable("vector"))


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors of one length, as rows of doubles."""
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 0))
