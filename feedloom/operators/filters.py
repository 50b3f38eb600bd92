"""Row filters of the dashboard: word count, polarity, segment, service."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import has_more_words

ALL = "ALL"


def min_words(df: DataFrame, col: str = "comment", n: int = 3) -> DataFrame:
    """Keep comments with more than ``n`` whitespace-separated words (null never passes)."""
    return df.where(has_more_words(col, n))


def polarity(df: DataFrame, kind: str, score: str = "score", comment: str = "comment",
             low: float = 5, high: float = 8, min_word: int = 3) -> DataFrame:
    """Negative (score <= low) / positive (score >= high) / all verbatims with > 3 words.

    ``ranked`` puts the result in reading order; the filter itself does not sort.
    """
    s = F.col(score)
    bands = {"negative": s <= low, "positive": s >= high, "all": F.lit(True)}
    if kind not in bands:
        raise ValueError(f"unknown polarity {kind!r}")
    return min_words(df.where(bands[kind]), comment, min_word)


def ranked(df: DataFrame, kind: str, score: str = "score") -> DataFrame:
    """O1: reading order of a polarity list: by score (descending for positive), then date and id."""
    s = F.col(score).desc_nulls_last() if kind == "positive" else F.col(score).asc_nulls_last()
    return df.orderBy(s, *[F.col(c) for c in ("dt", "id") if c in df.columns])


def segment(df: DataFrame, dim: str, value: str) -> DataFrame:
    """Equality filter on one dimension; ``ALL`` means no filter."""
    return df if value == ALL else df.where(F.col(dim) == value)


def not_null(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull())


def service_facts(df: DataFrame, service: str, col: str = "service") -> DataFrame:
    """Sales or after-sales facts from one table holding both (a partition column at rest)."""
    return df.where(F.col(col) == service)
