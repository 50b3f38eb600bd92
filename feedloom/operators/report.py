"""Report metrics (R1-R11): the numbers an executive feedback report is built on.

Each metric is one aggregation over the facts (plus, where a share or a gap
needs the grand total, one scalar aggregate).  Breakdowns over several
dimensions are computed in a single shuffle by exploding (dim, value) pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.delays import delay_days
from feedloom.functions.text import WORD_BREAK, fold_accents, fold_plain, mentions
from feedloom.operators._util import round2, scalar_row

DIMENSIONS = ["technology", "model", "dealer"]


def _pairs(dims: list[str], overall: bool) -> F.Column:
    items = [F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims]
    if overall:
        items.append(F.struct(F.lit("ALL").alias("dim"), F.lit("ALL").alias("value")))
    return F.explode(F.array(*items))


# -------------------------------------------------------------------- R1 ----
def report_header(df: DataFrame, date: str = "dt") -> DataFrame:
    """Rows, first/last date and the months covered."""
    month = F.date_format(date, "yyyy-MM")
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
        F.count_distinct(month).alias("n_months"),
        F.array_join(F.array_sort(F.collect_set(month)), ", ").alias("months"),
    )


# -------------------------------------------------------------------- R2 ----
def breakdown(df: DataFrame, dims: list[str] = DIMENSIONS, score: str = "score") -> DataFrame:
    """Per dimension value (null group included): n, % of the grand total, mean; plus an ALL row.

    One pass over the facts: the ALL row is part of the same aggregation, the
    (small) aggregate is checkpointed, and the grand total is read from it.
    """
    agg = (
        df.select(_pairs(dims, True).alias("p"), F.col(score).alias("_s"))
        .groupBy("p.dim", "p.value")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_s").alias("_mean"))
        .checkpoint(eager=True)
    )
    total = scalar_row(agg.where(F.col("dim") == "ALL").select("n"))["n"]
    return agg.select(
        "dim", "value", "n",
        round2(F.col("n") * 100.0 / F.lit(total)).alias("share_pct"),
        round2("_mean").alias("mean_score"),
        F.col("_mean"),
    )


def _public(df: DataFrame) -> DataFrame:
    return df.drop("_mean")


# -------------------------------------------------------------------- R3 ----
def critical(df: DataFrame, dims: list[str] = DIMENSIONS, below: float = 5.0, score: str = "score") -> DataFrame:
    """Named entities whose mean score is below ``below``, worst first."""
    b = breakdown(df, dims, score)
    return _public(
        b.where((F.col("dim") != "ALL") & F.col("value").isNotNull() & (F.col("_mean") < below))
        .orderBy("dim", "_mean", "value")
    )


# -------------------------------------------------------------------- R4 ----
def best(df: DataFrame, dims: list[str] = DIMENSIONS, k: int = 3, min_n: int = 1, score: str = "score") -> DataFrame:
    """Top ``k`` named entities per dimension by mean (ties: more responses, then name)."""
    b = breakdown(df, dims, score).where(
        (F.col("dim") != "ALL") & F.col("value").isNotNull() & F.col("_mean").isNotNull() & (F.col("n") >= min_n)
    )
    w = Window.partitionBy("dim").orderBy(F.col("_mean").desc(), F.col("n").desc(), F.col("value"))
    return _public(b.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))


# -------------------------------------------------------------------- R5 ----
def monthly(df: DataFrame, date: str = "dt", score: str = "score") -> DataFrame:
    """Responses and mean score per calendar month."""
    return (
        df.where(F.col(date).isNotNull())
        .groupBy(F.date_trunc("month", date).cast("date").alias("month"))
        .agg(F.count(F.lit(1)).alias("n"), round2(F.avg(score)).alias("mean_score"))
        .orderBy("month")
    )


# -------------------------------------------------------------------- R6 ----
def coverage_gaps(df: DataFrame, dim: str = "dealer", date: str = "dt") -> DataFrame:
    """(entity, month) pairs with zero responses inside the global month range.

    One pass builds the distinct (entity, month) pairs (small, checkpointed);
    range, entity list and the anti-join all read that aggregate.
    """
    m = F.date_trunc("month", date).cast("date")
    seen = df.select(F.col(dim).alias(dim), m.alias("month")).distinct().checkpoint(eager=True)
    rng = scalar_row(seen.agg(F.min("month").alias("lo"), F.max("month").alias("hi")))
    ents = seen.where(F.col(dim).isNotNull()).select(dim).distinct()
    if rng["lo"] is None:
        return ents.select(dim, F.lit(None).cast("date").alias("month")).limit(0)
    spine = ents.select(dim, F.explode(F.sequence(F.lit(rng["lo"]), F.lit(rng["hi"]), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    observed = seen.where(F.col(dim).isNotNull() & F.col("month").isNotNull())
    return spine.join(observed, [dim, "month"], "left_anti").orderBy(dim, "month")


# -------------------------------------------------------------------- R7 ----
def theme_mentions(df: DataFrame, themes: dict[str, list[str]], *keep: Column, text: str = "comment") -> DataFrame:
    """(theme, keep...): one row for every theme that a comment mentions, however often.

    A comment's different words are looked up in one table of all terms, with their
    plurals in -s and -es, so the work does not depend on the number of themes.  Terms
    that are more than a word (``mal servicio``) are looked for by pattern.  Case and
    accents are ignored.
    """
    spark = df.sparkSession
    single, longer = [], {}
    for theme, terms in themes.items():
        for term in terms:
            plain = fold_plain(term.lower())
            if plain.isascii() and plain.isalnum():
                single += [(plain + end, theme) for end in ("", "s", "es")]
            else:
                longer.setdefault(theme, []).append(term)
    rows = df.select(F.monotonically_increasing_id().alias("_row"), F.lower(text).alias("_text"), *[c.alias(f"_k{i}") for i, c in enumerate(keep)])
    kept = [f"_k{i}" for i in range(len(keep))]
    words = rows.select("_row", *kept, F.explode(F.array_distinct(F.split("_text", WORD_BREAK))).alias("_w"))
    table = spark.createDataFrame(sorted(set(single)) or [], "_w string, theme string")  # the caller's own list of terms
    found = words.withColumn("_w", fold_accents("_w")).join(F.broadcast(table), "_w").select("_row", "theme", *kept)
    if longer:
        named = F.array_compact(F.array(*[F.when(mentions("_text", terms, lowered=True), F.lit(theme)) for theme, terms in longer.items()]))
        found = found.unionByName(rows.select("_row", *kept, F.explode(named).alias("theme")))
    return found.dropDuplicates(["_row", "theme"]).drop("_row")


def _each_theme(spark, themes: dict) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(t,) for t in themes], "theme string"))


def theme(df: DataFrame, themes: dict[str, list[str]], text: str = "comment", score: str = "score") -> DataFrame:
    """Per keyword theme: comments mentioning it, % of all comments, mean score of those comments."""
    counts = theme_mentions(df, themes, F.col(score), text=text).groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.avg("_k0").alias("m"))
    total = F.lit(df.count())
    n = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return _each_theme(df.sparkSession, themes).join(counts, "theme", "left").select(
        "theme", n.alias("n_mentions"), round2(F.try_divide(n * 100.0, total)).alias("share_pct"), round2("m").alias("mean_score")
    )


# -------------------------------------------------------------------- R8 ----
def theme_contrast(df: DataFrame, themes: dict[str, list[str]], low: float = 4, high: float = 7,
                   text: str = "comment", score: str = "score") -> DataFrame:
    """Share of comments mentioning each theme among low-scored vs high-scored comments."""
    sides = {"low": F.col(score) <= low, "high": F.col(score) >= high}
    total = scalar_row(df.agg(*[F.count_if(c).alias(side) for side, c in sides.items()]))
    counts = theme_mentions(df, themes, *sides.values(), text=text).groupBy("theme").agg(*[F.count_if(f"_k{i}").alias(f"m_{side}") for i, side in enumerate(sides)])
    out = ["theme"]
    for side in sides:
        n, m = F.lit(total[side]).cast("bigint"), F.coalesce(F.col(f"m_{side}"), F.lit(0)).cast("bigint")
        out += [n.alias(f"n_{side}"), m.alias(f"mentions_{side}"), round2(F.try_divide(m * 100.0, n)).alias(f"share_{side}_pct")]
    return _each_theme(df.sparkSession, themes).join(counts, "theme", "left").select(*out)


def theme_dealers(df: DataFrame, themes: dict[str, list[str]], low: float = 5, best: int = 3, dealer: str = "dealer",
                  text: str = "comment", score: str = "score") -> DataFrame:
    """R8 by dealer: how often each theme is mentioned at dealers whose mean is below ``low``, and at the ``best`` dealers.

    One aggregate per dealer, one per (dealer, theme); the best are the first by mean
    (then count, then name).
    """
    known = df.where(F.col(dealer).isNotNull())
    each = known.groupBy(F.col(dealer).alias("_d")).agg(F.count(F.lit(1)).alias("_n"), F.avg(score).alias("_m")).where(F.col("_m").isNotNull()).checkpoint(eager=True)
    groups = each.where(F.col("_m") < low).select("_d", "_n", F.lit("low").alias("_g")).unionByName(
        each.orderBy(F.desc("_m"), F.desc("_n"), "_d").limit(best).select("_d", "_n", F.lit("best").alias("_g"))
    )
    hits = theme_mentions(known, themes, F.col(dealer), text=text).groupBy("theme", F.col("_k0").alias("_d")).agg(F.count(F.lit(1)).alias("_h"))
    mentioned = hits.join(groups.select("_d", "_g"), "_d").groupBy("theme").agg(*[F.sum(F.when(F.col("_g") == g, F.col("_h"))).alias(f"m_{g}") for g in ("low", "best")])
    total = scalar_row(groups.agg(*[F.sum(F.when(F.col("_g") == g, F.col("_n")).otherwise(0)).alias(g) for g in ("low", "best")]))
    out = ["theme"]
    for g in ("low", "best"):
        n, m = F.lit(total[g]).cast("bigint"), F.coalesce(F.col(f"m_{g}"), F.lit(0)).cast("bigint")
        out += [n.alias(f"n_{g}"), m.alias(f"mentions_{g}"), round2(F.try_divide(m * 100.0, n)).alias(f"share_{g}_pct")]
    rows = _each_theme(df.sparkSession, themes).join(mentioned, "theme", "left").select(*out)
    return rows if total["low"] is not None else rows.limit(0)


# -------------------------------------------------------------------- R9 ----
def cross(df: DataFrame, d1: str = "model", d2: str = "dealer", score: str = "score") -> DataFrame:
    """Two-dimension cross table: n and mean for every observed (d1, d2) pair."""
    return (
        df.where(F.col(d1).isNotNull() & F.col(d2).isNotNull())
        .groupBy(d1, d2)
        .agg(F.count(F.lit(1)).alias("n"), round2(F.avg(score)).alias("mean_score"))
    )


# ------------------------------------------------------------------- R10 ----
DELAY_EDGES = [1.0, 7.0, 30.0]


def delay_band(days, edges: list[float] = DELAY_EDGES) -> F.Column:
    """Band label of a delay in days: ``<e1``, ``e1-e2``, ..., ``>=eN``; no delay -> ``none``."""
    d = F.col(days) if isinstance(days, str) else days
    fmt = lambda x: f"{x:g}"
    out = F.when(d.isNull(), F.lit("none")).when(d < edges[0], F.lit(f"<{fmt(edges[0])}d"))
    for lo, hi in zip(edges, edges[1:]):
        out = out.when(d < hi, F.lit(f"{fmt(lo)}-{fmt(hi)}d"))
    return out.otherwise(F.lit(f">={fmt(edges[-1])}d"))


def delay_bands(df: DataFrame, edges: list[float] = DELAY_EDGES, text: str = "comment",
                score: str = "score") -> DataFrame:
    """Comments per delay band (longest delay mentioned), with mean score and mean delay."""
    d = df.select(delay_days(text).alias("days"), F.col(score).alias("_s"))
    return (
        d.groupBy(delay_band("days", edges).alias("band"))
        .agg(F.count(F.lit(1)).alias("n"), round2(F.avg("_s")).alias("mean_score"),
             round2(F.avg("days")).alias("mean_days"))
    )


#: Decimal places kept of a delay when scores are added up by delay: its first three digits.
_DIGITS = 3
VERDICTS = ["genial", "bien", "mal"]


def delay_scores(df: DataFrame, by: list[str] = (), text: str = "comment", score: str = "score") -> DataFrame:
    """Scored delays added up: (by..., place, lo, hi, n, s, ss) with count, sum and sum of squares of the scores.

    Delays that agree in their first three digits are one place, so a group has at most
    some 900 places per power of ten, whatever the number of comments.
    """
    d = df.select(*by, delay_days(text).alias("days"), F.col(score).cast("double").alias("_s")).where(F.col("days") > 0).where("_s IS NOT NULL")
    power = F.floor(F.log10("days")).cast("int")
    place = F.struct(power.alias("power"), F.rint(F.col("days") / F.pow(F.lit(10.0), power - (_DIGITS - 1))).cast("int").alias("digits"))
    return d.groupBy(*by, place.alias("place")).agg(
        F.min("days").alias("lo"), F.max("days").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("_s").alias("s"), F.sum(F.col("_s") * F.col("_s")).alias("ss")
    )


def best_cuts(n, s, ss, k: int) -> list[int]:
    """Where to cut a sequence into ``k`` pieces so that squared errors from the pieces' means are least.

    The sequence is given by count, sum and sum of squares of each place; a piece is
    one or more places.  Of equal solutions (to nine decimals) the one with the first
    cut furthest left, then the second, and so on.  Dynamic programming from the right,
    one row of costs at a time: time k m^2, memory k m.
    """
    import numpy as np

    m = len(n)
    k = min(k, m)
    total = [np.concatenate(([0.0], np.cumsum(np.asarray(x, dtype=float)))) for x in (n, s, ss)]

    def cost(i: int, ends):
        count, sums, squares = (t[ends] - t[i] for t in total)
        return squares - sums * sums / count

    rest = np.array([cost(i, np.array([m]))[0] for i in range(m)] + [0.0])  # one piece from i on
    choices = []
    for pieces in range(2, k + 1):
        best, at = np.full(m + 1, np.inf), np.full(m + 1, m, dtype=int)
        for i in range(m - pieces + 1):
            ends = np.arange(i + 1, m - pieces + 2)
            costs = cost(i, ends) + rest[ends]
            at[i] = ends[np.flatnonzero(costs <= costs.min() + 1e-9)[0]]
            best[i] = costs[at[i] - i - 1]
        choices.append(at)
        rest = best
    cuts, i = [], 0
    for at in reversed(choices):
        i = int(at[i])
        cuts.append(i)
    return cuts


def delay_verdicts(df: DataFrame, by: list[str] = (), verdicts: list[str] = VERDICTS, text: str = "comment", score: str = "score") -> DataFrame:
    """Which delays customers call great, fair or bad, learned from their scores.

    Delays are cut into as many ranges as there are verdicts (fewer, where fewer delays
    occur) so that scores differ as little as possible inside the ranges.  The range with
    the best mean score gets the first verdict, and so on.  Returns (by..., band,
    from_days, to_days, n, mean_score, verdict), one set of ranges per group of ``by``.
    """
    keys = list(by)
    table = delay_scores(df, keys, text, score)
    fields = ", ".join(f"`{c}` {table.schema[c].dataType.simpleString()}" for c in keys)
    schema = (fields + ", " if fields else "") + "band int, from_days double, to_days double, n bigint, mean_score double, verdict string"

    def cut(rows):
        import pandas as pd

        rows = rows.sort_values("lo")
        edges = [0, *best_cuts(rows["n"].to_numpy(), rows["s"].to_numpy(), rows["ss"].to_numpy(), len(verdicts)), len(rows)]
        parts = [rows.iloc[a:b] for a, b in zip(edges, edges[1:])]
        means = [p["s"].sum() / p["n"].sum() for p in parts]
        order = sorted(range(len(parts)), key=lambda i: (-means[i], i))
        out = [(i + 1, p["lo"].min(), p["hi"].max(), p["n"].sum(), means[i], verdicts[order.index(i)]) for i, p in enumerate(parts)]
        found = pd.DataFrame(out, columns=["band", "from_days", "to_days", "n", "mean_score", "verdict"])
        for c in keys:
            found[c] = rows[c].iat[0]
        return found[[*keys, "band", "from_days", "to_days", "n", "mean_score", "verdict"]]

    groups = table.drop("place") if keys else table.drop("place").withColumn("_all", F.lit(0))
    cuts = groups.groupBy(*(keys or ["_all"])).applyInPandas(cut, schema)
    return cuts.select(*keys, "band", F.round("from_days", 6).alias("from_days"), F.round("to_days", 6).alias("to_days"), "n", round2("mean_score").alias("mean_score"), "verdict")


# ------------------------------------------------------------------- R11 ----
def gap_to(df: DataFrame, dim: str = "dealer", score: str = "score", ref: str | None = None) -> DataFrame:
    """Each entity's mean against a reference mean: gap in points and in percent.

    The reference is the group ``ref`` of the same dimension (``Eléctrico`` against
    ``Gasolina``), or by default all rows.  One pass: the reference is a row of the
    same (checkpointed) aggregate.
    """
    both = (
        df.select(_pairs([dim], True).alias("p"), F.col(score).alias("_s"))
        .groupBy("p.dim", "p.value")
        .agg(F.avg("_s").alias("_m"))
        .checkpoint(eager=True)
    )
    at = F.col("dim") == "ALL" if ref is None else (F.col("dim") == dim) & (F.col("value") == ref)
    overall = scalar_row(both.where(at).agg(F.max("_m").alias("_m")))["_m"]
    agg = both.where((F.col("dim") == dim) & F.col("value").isNotNull()).select(F.col("value").alias(dim), "_m")
    mean = F.lit(overall).cast("double")
    return agg.select(
        dim,
        round2("_m").alias("mean_score"),
        round2(mean).alias("overall_mean" if ref is None else "ref_mean"),
        round2(F.col("_m") - mean).alias("gap_points"),
        round2(F.try_divide((F.col("_m") - mean) * 100.0, mean)).alias("gap_pct"),
    )
