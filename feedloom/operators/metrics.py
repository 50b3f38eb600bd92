"""Dashboard aggregations (A1-A15) and the weekly calendar spine.

Every group-by is one shuffle on a low-cardinality key with map-side partial
aggregation, so a hot dealer or model is pre-aggregated before it moves.
pandas drops null group keys, so each grouping below filters them first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import has_more_words
from feedloom.operators._util import round2, scalar_row

# The technology domain of the dealer comparison, in display order.
TECHNOLOGIES = ["Gasolina", "Diésel", "Híbrido", "Eléctrico"]


def week_start(c) -> "F.Column":
    """Monday of the ISO week, as a date."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_trunc("week", c).cast("date")


# -------------------------------------------------------------------- A1 ----
def weekly_counts(df: DataFrame, ts: str = "dt", out: str = "n_comments") -> DataFrame:
    """Rows per week (Monday start); only weeks with data; sorted by week."""
    return (
        df.where(F.col(ts).isNotNull())
        .groupBy(week_start(ts).alias("week"))
        .agg(F.count(F.lit(1)).alias(out))
        .orderBy("week")
    )


# ------------------------------------------------------------- A10 / A11 ----
def date_range(df: DataFrame, col: str = "dt") -> DataFrame:
    return df.agg(F.min(col).alias("first_date"), F.max(col).alias("last_date"))


def max_count(counts: DataFrame, col: str = "n_comments") -> DataFrame:
    return counts.agg(F.max(col).alias(f"max_{col}"))


# --------------------------------------------------------------- A2 + J4 ----
def weekly_counts_filled(df: DataFrame, dealer: str = "dealer", ts: str = "dt",
                         out: str = "n_comments") -> DataFrame:
    """Rows per (dealer, week) on the *global* week range, zero-filled.

    One pass over the facts builds the (dealer, week) counts (null keys
    included, so the range covers every row); that aggregate is small
    (dealers x weeks), is checkpointed, and yields the range, the dealer list
    and the counts.  The spine is generated per dealer with ``sequence``.
    """
    counts = (
        df.groupBy(F.col(dealer).alias(dealer), week_start(ts).alias("week"))
        .agg(F.count(F.lit(1)).alias(out))
        .checkpoint(eager=True)
    )
    rng = scalar_row(counts.agg(F.min("week").alias("lo"), F.max("week").alias("hi")))
    dealers = counts.where(F.col(dealer).isNotNull()).select(dealer).distinct()
    if rng["lo"] is None:
        return dealers.select(dealer, F.lit(None).cast("date").alias("week"), F.lit(0).cast("bigint").alias(out)).limit(0)
    spine = dealers.select(
        dealer,
        F.explode(F.sequence(F.lit(rng["lo"]), F.lit(rng["hi"]), F.expr("INTERVAL 7 DAYS"))).alias("week"),
    )
    known = counts.where(F.col(dealer).isNotNull() & F.col("week").isNotNull())
    return (
        spine.join(known, [dealer, "week"], "left")
        .select(dealer, "week", F.coalesce(F.col(out), F.lit(0)).cast("bigint").alias(out))
    )


# ----------------------------------------------------------- A3 / A4 ----
def group_matrix(df: DataFrame, key: str, comment: str = "comment", score: str = "score",
                 rounded: bool = False) -> DataFrame:
    """Per key: non-null comments and mean score; groups without a mean are dropped."""
    mean = F.avg(score)
    out = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(comment).alias("n_comments"), mean.alias("mean_score"))
        .where(F.col("mean_score").isNotNull())
    )
    if rounded:
        out = out.withColumn("mean_score", round2("mean_score"))
    return out


# ----------------------------------------------------------- A5 / A6 ----
def mean_score(df: DataFrame, key: str, score: str = "score", rounded: bool = False) -> DataFrame:
    """Mean score per key, sorted by the unrounded mean descending, null means last."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(score).alias("mean_score"))
    out = out.orderBy(F.col("mean_score").desc_nulls_last(), F.col(key))
    if rounded:
        out = out.withColumn("mean_score", round2("mean_score"))
    return out


# ------------------------------------------------------- A7 / A8 / A9 ----
def count_by(df: DataFrame, key: str, sort: str = "count") -> DataFrame:
    """Row count per key; sorted by count (desc) or by key."""
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.col("n").desc(), F.col(key)) if sort == "count" else out.orderBy(key)


# Month tags used by the monthly extracts.
MONTHS_ES = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio", "Agosto",
             "Septiembre", "Octubre", "Noviembre", "Diciembre"]


def month_tag(c) -> "F.Column":
    c = F.col(c) if isinstance(c, str) else c
    return F.element_at(F.array(*[F.lit(m) for m in MONTHS_ES]), F.month(c))


# ------------------------------------------------------------------- A12 ----
def distinct_values(df: DataFrame, dims: list[str]) -> DataFrame:
    """Sorted distinct non-null values of several dimensions in one pass: (dim, value)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]))
    return (
        df.select(pairs.alias("p"))
        .select("p.dim", "p.value")
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("dim", "value")
    )


# ------------------------------------------------------------------- A13 ----
def compare_technology(df: DataFrame, dealer: str = "dealer", tech: str = "technology",
                       score: str = "score", domain: list[str] = TECHNOLOGIES) -> DataFrame:
    """Every dealer x fixed technology domain: dealer mean vs mean over *all* rows.

    One aggregate to (dealer, technology) sums gives both sides; the overall side has at
    most ``len(domain)`` rows, so it is broadcast.  Missing means -> 0, with the number
    of scores beside them (``dealer_n``, ``overall_n``) to tell them from a real 0.
    """
    sums = (
        df.groupBy(dealer, F.when(F.col(tech).isin(domain), F.col(tech)).alias(tech))
        .agg(F.sum(F.col(score).cast("double")).alias("_s"), F.count(score).alias("_c"))
    )
    entry = F.when(F.col(tech).isNotNull(), F.struct(F.col(tech).alias("t"), F.struct(F.col("_s").alias("s"), F.col("_c").alias("c")).alias("v")))
    own = sums.where(F.col(dealer).isNotNull()).groupBy(dealer).agg(F.map_from_entries(F.collect_list(entry)).alias("_own"))
    overall = sums.where(F.col(tech).isNotNull()).groupBy(tech).agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    grid = own.select(dealer, F.explode(F.array(*[F.lit(t) for t in domain])).alias(tech), "_own").withColumn("_v", F.try_element_at("_own", F.col(tech)))
    zero = F.lit(0).cast("bigint")
    return grid.join(F.broadcast(overall), tech, "left").select(
        dealer, tech,
        F.coalesce(round2(F.try_divide(F.col("_v.s"), F.col("_v.c"))), F.lit(0.0)).alias("dealer_mean"),
        F.coalesce("_v.c", zero).alias("dealer_n"),
        F.coalesce(round2(F.try_divide(F.col("_s"), F.col("_c"))), F.lit(0.0)).alias("overall_mean"),
        F.coalesce("_c", zero).alias("overall_n"),
    )


# ------------------------------------------------------------------- A14 ----
def compare_model(df: DataFrame, dealer: str = "dealer", model: str = "model",
                  score: str = "score") -> DataFrame:
    """For each dealer and each model seen at it: dealer mean vs mean of all *other* rows.

    One aggregation to (dealer, model) partial sums, from which the models' totals are
    summed and joined back, so no task holds a model's dealers.  Rows without a dealer
    count toward the rest, as an inequality test on them does.  Missing means -> 0;
    ``dealer_n`` and ``rest_n`` count the scores.
    """
    sums = (
        df.where(F.col(model).isNotNull())
        .groupBy(dealer, model)
        .agg(F.sum(F.col(score).cast("double")).alias("_s"), F.count(score).alias("_c"))
    )
    totals = sums.groupBy(model).agg(F.sum("_s").alias("_ts"), F.sum("_c").alias("_tc"))
    rest = F.try_divide(F.col("_ts") - F.coalesce("_s", F.lit(0.0)), F.col("_tc") - F.col("_c"))
    return sums.where(F.col(dealer).isNotNull()).join(totals, model).select(
        dealer, model,
        F.coalesce(round2(F.try_divide(F.col("_s"), F.col("_c"))), F.lit(0.0)).alias("dealer_mean"),
        F.col("_c").alias("dealer_n"),
        F.coalesce(round2(rest), F.lit(0.0)).alias("rest_mean"),
        (F.col("_tc") - F.col("_c")).alias("rest_n"),
    )


# ------------------------------------------------------------------- A15 ----
def individual_matrix(df: DataFrame, comment: str = "comment", cols=("id", "score", "model", "comment"),
                      min_word: int = 3) -> DataFrame:
    """One point per comment with more than ``min_word`` words."""
    return df.where(has_more_words(comment, min_word)).select(*cols)


__all__ = [
    "TECHNOLOGIES", "weekly_counts", "date_range", "max_count", "weekly_counts_filled", "group_matrix",
    "mean_score", "count_by", "month_tag", "distinct_values", "compare_technology", "compare_model",
    "individual_matrix",
]
