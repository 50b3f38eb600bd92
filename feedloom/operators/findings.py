"""Findings behind a report: what sets groups apart, where interviews stopped, who moves a mean.

Everything starts from one aggregate with map-side combining; what follows works on
tables of terms, (dealer, month) or (dealer, model) sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators._util import scalar_row
from feedloom.operators.retrieval import text_pieces, words


# ----------------------------------------------------- R8: distinctive terms ----
def ngrams(df: DataFrame, text: str, longest: int = 2) -> DataFrame:
    """``df`` with every run of 1 to ``longest`` words of ``text`` as columns n, term: a row per occurrence."""
    w = F.col("_words")

    def runs(n: int) -> Column:
        if n == 1:
            return F.transform(w, lambda t: F.struct(F.lit(1).alias("n"), t.alias("term")))
        starts = F.slice(w, F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda t, i: F.struct(F.lit(n).alias("n"), F.concat_ws(" ", t, *[F.get(w, i + j) for j in range(1, n)]).alias("term")))

    # the words are a column of their own: inside the functions above they would be split again for every run
    split = df.withColumn("_words", words(text)).drop(text)
    each = split.select("*", F.explode(F.concat(*[runs(n) for n in range(1, longest + 1)])).alias("_g"))
    return each.select(*[c for c in split.columns if c != "_words"], "_g.n", "_g.term")


def dealer_groups(df: DataFrame, low: float = 5, best: int = 3, dealer: str = "dealer", score: str = "score") -> DataFrame:
    """(dealer, side): the ``best`` dealers by mean score, then count, then name, and the others whose mean is below ``low``."""
    each = df.where(F.col(dealer).isNotNull()).groupBy(dealer).agg(F.count(F.lit(1)).alias("_n"), F.avg(score).alias("_m")).where("_m IS NOT NULL")
    each = each.checkpoint(eager=True)
    top = each.orderBy(F.desc("_m"), F.desc("_n"), dealer).limit(best).select(dealer, F.lit("best").alias("side"))
    bottom = each.where(F.col("_m") < low).join(top, dealer, "left_anti").select(dealer, F.lit("low").alias("side"))
    return top.unionByName(bottom)


def term_scores(df: DataFrame, side: str = "side", text: str = "comment", longest: int = 2, prior: float = 500.0, min_count: int = 1) -> DataFrame:
    """(n, term, n_low, n_best, z): how far a term's share among ``low`` texts lies above that among ``best`` texts.

    Weighted log-odds with an informative Dirichlet prior: every term of one length is
    expected as often as in both sides together, with the weight of ``prior`` words, so
    rare terms need more than chance to stand out.  z is the difference of log-odds over
    its standard deviation.  Terms that occur less than ``min_count`` times are left out
    of the result, not of the totals.
    """
    texts = df.select(F.col(side).alias("_side"), F.col(text).alias("_text"))
    # a task holds the different terms of its texts: dealt evenly, in pieces of bounded size
    pieces = max(texts.agg(text_pieces("_text").alias("n")).first()["n"], df.sparkSession.sparkContext.defaultParallelism)
    counted = ngrams(texts.repartition(pieces), "_text", longest).groupBy("n", "term").agg(
        F.count_if(F.col("_side") == "low").alias("n_low"), F.count_if(F.col("_side") == "best").alias("n_best")
    )
    counted = counted.checkpoint(eager=True)  # used for the totals and for the terms
    totals = counted.groupBy("n").agg(F.sum("n_low").alias("_low"), F.sum("n_best").alias("_best"))  # one row per length
    t = counted.where(F.col("n_low") + F.col("n_best") >= min_count).join(F.broadcast(totals), "n")
    expected = (F.col("n_low") + F.col("n_best")) * F.lit(float(prior)) / (F.col("_low") + F.col("_best"))

    def log_odds(own: str, total: str) -> Column:
        return F.log((F.col(own) + expected) / (F.col(total) + F.lit(float(prior)) - F.col(own) - expected))

    spread = F.sqrt(1 / (F.col("n_low") + expected) + 1 / (F.col("n_best") + expected))
    return t.select("n", "term", "n_low", "n_best", ((log_odds("n_low", "_low") - log_odds("n_best", "_best")) / spread).alias("z"))


#: So many dealers go to every task.
FEW_DEALERS = 50_000


def distinctive_terms(df: DataFrame, k: int = 20, low: float = 5, best: int = 3, longest: int = 2, prior: float = 500.0, min_count: int = 5,
                      dealer: str = "dealer", text: str = "comment", score: str = "score") -> DataFrame:
    """The ``k`` terms that set the comments of badly rated dealers apart from those of the best, and the reverse.

    Returns (side, rank, term, n_low, n_best, z); z is above zero on the low side.  Order:
    size of z, then term.
    """
    sides = dealer_groups(df, low, best, dealer, score)
    sides = sides.checkpoint(eager=True)
    if sides.count() <= FEW_DEALERS:  # the texts stay where they are: shuffled by dealer, a crowded one is one task's work
        sides = F.broadcast(sides)
    scored = term_scores(df.join(sides, dealer), "side", text, longest, prior, min_count)
    scored = scored.select("term", "n_low", "n_best", F.round("z", 9).alias("z")).checkpoint(eager=True)
    out = None
    for side, wanted, order in (("low", F.col("z") > 0, F.desc("z")), ("best", F.col("z") < 0, F.asc("z"))):
        top = scored.where(wanted).orderBy(order, "term").limit(k)  # k rows
        ranked = top.select(F.lit(side).alias("side"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "term")).alias("rank"), "term", "n_low", "n_best", F.round("z", 6).alias("z"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


# ------------------------------------------------- R6: when interviews stopped ----
STOP_MONTHS = 2


def silences(df: DataFrame, dim: str = "dealer", date: str = "dt", stop_months: int = STOP_MONTHS) -> DataFrame:
    """Every run of months without a response, per entity, inside the months that the table covers.

    Returns (entity, from_month, n_months, kind, active_months, n_before, n_after):

    * ``late``: before the entity's first response;
    * ``gap``: fewer than ``stop_months`` months, wherever they lie;
    * ``pause``: longer, and the responses came back;
    * ``stopped``: longer, up to the last month of the table.

    ``active_months`` and ``n_before`` are the length and the responses of the active run
    just before the silence, ``n_after`` the responses of the one after it.  Gaps and
    islands over one row per (entity, month): no calendar is built.
    """
    number = F.year(date) * 12 + F.month(date) - 1
    seen = df.where(F.col(dim).isNotNull() & F.col(date).isNotNull()).groupBy(dim, number.alias("m")).agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    bounds = scalar_row(df.agg(F.min(number).alias("lo"), F.max(number).alias("hi")))
    by_month = Window.partitionBy(dim).orderBy("m")
    # consecutive months keep the same difference from their place in the order
    runs = seen.withColumn("run", F.col("m") - F.row_number().over(by_month)).groupBy(dim, "run").agg(F.min("m").alias("first"), F.max("m").alias("last"), F.sum("n").alias("n"))
    by_run = Window.partitionBy(dim).orderBy("first")
    lo, hi = (F.lit(bounds[c]).cast("int") for c in ("lo", "hi"))
    islands = runs.select(dim, "first", "last", "n", F.lead("first").over(by_run).alias("next"), F.lead("n").over(by_run).alias("n_next"), F.row_number().over(by_run).alias("place"))
    none = F.lit(None).cast("bigint")
    after = islands.select(
        dim, (F.col("last") + 1).alias("start"), (F.coalesce("next", hi + 1) - F.col("last") - 1).alias("n_months"), F.col("next").isNotNull().alias("resumed"),
        (F.col("last") - F.col("first") + 1).cast("bigint").alias("active_months"), F.col("n").alias("n_before"), F.col("n_next").alias("n_after"),
    )
    before = islands.where("place = 1").select(
        dim, lo.alias("start"), (F.col("first") - lo).alias("n_months"), F.lit(None).cast("boolean").alias("resumed"), none.alias("active_months"), none.alias("n_before"), F.col("n").alias("n_after")
    )
    kind = F.when(F.col("resumed").isNull(), "late").when(F.col("n_months") < stop_months, "gap").when(F.col("resumed"), "pause").otherwise("stopped")
    month = F.make_date(F.floor(F.col("start") / 12).cast("int"), (F.col("start") % 12 + 1).cast("int"), F.lit(1))
    return before.unionByName(after).where("n_months > 0").select(dim, month.alias("from_month"), F.col("n_months").cast("int").alias("n_months"), kind.alias("kind"), "active_months", "n_before", "n_after")


# --------------------------------------------- R9: who moves a model's mean ----
OTHERS = "(otros)"


def mean_drivers(df: DataFrame, model: str = "model", dealer: str = "dealer", score: str = "score") -> DataFrame:
    """What each dealer adds to the gap between a model's mean and the overall mean.

    Per observed (model, dealer): n, mean_score, share of the model's responses, and

    * ``level``: share x (the dealer's mean on this model - the dealer's mean on all);
    * ``mix``: (share - the dealer's share of all responses) x (the dealer's mean - the
      overall mean): the model is sold where scores are low anyway;
    * ``influence``: the model's mean less what it would be without the dealer's
      responses (null where there are no others).

    One more row per model, dealer ``(otros)``, holds the mix of dealers without responses
    for it.  Level and mix of all rows of a model add up to its ``gap`` exactly.
    Responses without score, model or dealer take no part.
    """
    pairs = df.where(F.col(model).isNotNull() & F.col(dealer).isNotNull() & F.col(score).isNotNull()).groupBy(model, dealer).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(score).cast("double")).alias("s")
    ).checkpoint(eager=True)
    grand = scalar_row(pairs.agg(F.sum("n").alias("n"), F.sum("s").alias("s")))
    if not grand["n"]:
        all_n, mean = F.lit(1), F.lit(None).cast("double")
    else:
        all_n, mean = F.lit(grand["n"]), F.lit(grand["s"] / grand["n"])
    models = pairs.groupBy(model).agg(F.sum("n").alias("nm"), F.sum("s").alias("sm"))
    dealers = pairs.groupBy(dealer).agg(F.sum("n").alias("nd"), F.sum("s").alias("sd"))
    p = pairs.join(models, model).join(dealers, dealer)
    share, usual = F.col("n") / F.col("nm"), F.col("nd") / all_n
    above = F.col("sd") / F.col("nd") - mean
    gap = F.col("sm") / F.col("nm") - mean
    rest = F.try_divide(F.col("sm") - F.col("s"), F.col("nm") - F.col("n"))
    rows = p.select(
        model, dealer, "n", (F.col("s") / F.col("n")).alias("mean_score"), share.alias("share"), (share * (F.col("s") / F.col("n") - F.col("sd") / F.col("nd"))).alias("level"),
        ((share - usual) * above).alias("mix"), (F.col("sm") / F.col("nm") - rest).alias("influence"), gap.alias("gap"), (usual * above).alias("_usual"),
    ).checkpoint(eager=True)
    # what all dealers weigh above and below the mean cancels out, so the absent ones weigh minus what the present ones do
    absent = rows.groupBy(model).agg(F.sum("_usual").alias("mix"), F.first("gap").alias("gap")).select(
        model, F.lit(OTHERS).alias(dealer), F.lit(0).cast("bigint").alias("n"), F.lit(None).cast("double").alias("mean_score"), F.lit(0.0).alias("share"), F.lit(0.0).alias("level"), "mix",
        F.lit(None).cast("double").alias("influence"), "gap",
    )
    numbers = [F.round(F.col(c), 6).alias(c) for c in ("mean_score", "share", "level", "mix", "influence", "gap")]
    return rows.drop("_usual").unionByName(absent).select(model, dealer, "n", *numbers)


# ------------------------------------------------------ R5: turns in a trend ----
#: What a break costs, in variances of a single response: it must explain more than that.
BREAK_COST = 12.0


def best_segments(n, s, ss, penalty: float) -> list[int]:
    """First places of the segments (the first is 0) with the least squared error plus ``penalty`` per break.

    Dynamic programming over the cumulative sums of count, score and squared score; of
    equal solutions (to nine decimals) the one whose last segment begins first.
    """
    import numpy as np

    total = [np.concatenate(([0.0], np.cumsum(np.asarray(x, dtype=float)))) for x in (n, s, ss)]
    m = len(n)
    best, begin = np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for j in range(1, m + 1):
        starts = np.arange(j)
        count, sums, squares = (t[j] - t[starts] for t in total)
        costs = best[starts] + np.where(starts > 0, penalty, 0.0) + squares - sums * sums / count
        begin[j] = np.flatnonzero(costs <= costs.min() + 1e-9)[0]
        best[j] = costs[begin[j]]
    out, j = [], m
    while j > 0:
        j = int(begin[j])
        out.append(j)
    return out[::-1]


def trend_breaks(df: DataFrame, dim: str = "dealer", date: str = "dt", score: str = "score", cost: float = BREAK_COST) -> DataFrame:
    """The stretches of months over which an entity's mean score holds still.

    Returns (entity, segment, from_month, to_month, n, mean_score, change), ``change``
    against the stretch before.  A break is worth its cost only if it takes more than
    ``cost`` variances of a single response (from inside the months) off the squared
    error, so noise in small months makes no break.  One row per (entity, month) reaches a
    task: a group is as long as the calendar.  Months without scores are passed over.
    """
    known = df.where(F.col(dim).isNotNull() & F.col(date).isNotNull() & F.col(score).isNotNull())
    s = F.col(score).cast("double")
    monthly = known.groupBy(F.col(dim), F.date_trunc("month", date).cast("date").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(s).alias("s"), F.sum(s * s).alias("ss"))
    schema = f"`{dim}` {monthly.schema[dim].dataType.simpleString()}, segment int, from_month date, to_month date, n bigint, mean_score double, change double"

    def cut(rows):
        import pandas as pd

        rows = rows.sort_values("month")
        spare = rows["n"].sum() - len(rows)
        inside = (rows["ss"] - rows["s"] ** 2 / rows["n"]).sum()
        starts = best_segments(rows["n"].to_numpy(), rows["s"].to_numpy(), rows["ss"].to_numpy(), cost * max(inside, 0.0) / max(spare, 1))
        out, last = [], None
        for number, (a, b) in enumerate(zip(starts, [*starts[1:], len(rows)]), 1):
            part = rows.iloc[a:b]
            mean = part["s"].sum() / part["n"].sum()
            out.append((rows[dim].iat[0], number, part["month"].iat[0], part["month"].iat[-1], part["n"].sum(), mean, None if last is None else mean - last))
            last = mean
        return pd.DataFrame(out, columns=[dim, "segment", "from_month", "to_month", "n", "mean_score", "change"])

    found = monthly.groupBy(dim).applyInPandas(cut, schema)
    return found.select(dim, "segment", "from_month", "to_month", "n", F.round("mean_score", 6).alias("mean_score"), F.round("change", 6).alias("change"))
