"""Shared by the vector searches: usable vectors, ranking, best entries of a score row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, allow_zero: bool, one_length: bool = True) -> DataFrame:
    """(vec_id, embedding) that can be scored, one row per vec_id.

    Out go null ids, vectors that are null or empty, or hold null or non-finite
    components, all-zero ones unless allowed, and, with ``one_length``, those that are
    not as long as most (ties: the longer).  Of several rows with one vec_id the smallest
    vector stands.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    wanted = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine
    if not allow_zero:
        wanted = wanted & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", "embedding").where(F.coalesce(wanted, F.lit(False)))
    if not one_length:
        return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    if not sizes:
        return rows
    return rows.where(F.size(x) == sizes[0].n).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def ranked(found: DataFrame, k: int, better: Column) -> DataFrame:
    """The k best rows of each query_id with their rank; ties to the smaller vec_id."""
    order = Window.partitionBy("query_id").orderBy(better, "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of_row(scores, k: int):
    """Indices of the k largest scores; of equal ones the first."""
    import numpy as np

    if len(scores) <= k:
        return np.argsort(-scores, kind="stable")
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > least)
    equal = np.flatnonzero(scores == least)[: k - len(above)]
    chosen = np.concatenate((above, equal))
    return chosen[np.argsort(-scores[chosen], kind="stable")]
