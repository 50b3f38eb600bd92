"""Small shared helpers for operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def round2(c) -> Column:
    """Round half to even at 2 decimals (``rint(x*100)/100``), as a pandas/numpy round(2)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rint(c * 100) / 100


def scalar_row(df: DataFrame):
    """Collect a one-row aggregate (a handful of scalars) to the driver."""
    rows = df.take(2)
    if len(rows) != 1:
        raise ValueError(f"expected exactly one aggregate row, got {len(rows)}")
    return rows[0]
