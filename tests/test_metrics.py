"""Aggregations against literal pandas loops on the smallest driver tables."""

import pandas as pd

from feedloom.operators import metrics as M
from feedloom.operators import report as R
from feedloom.plans import fixtures as X
from tests.conftest import SF_SMALL


def test_compare_model_matches_per_dealer_loop(spark):
    f = X.facts(spark, SF_SMALL)
    pdf = f.select("dealer", "model", "score").toPandas()
    got = {(r.dealer, r.model): (r.dealer_mean, r.rest_mean) for r in M.compare_model(f).collect()}
    exp = {}
    for dealer in sorted(pdf.dealer.dropna().unique()):
        for model in sorted(pdf[pdf.dealer == dealer].model.dropna().unique()):
            tot = pdf[pdf.model == model]
            own = tot[tot.dealer == dealer].score.mean()
            rest = tot[tot.dealer != dealer].score.mean()
            exp[(dealer, model)] = (round(own, 2) if pd.notna(own) else 0, round(rest, 2) if pd.notna(rest) else 0)
    assert got == exp


def test_compare_technology_matches_loop(spark):
    v = X.verbatims(spark, SF_SMALL)
    pdf = v.select("dealer", "technology", "score").toPandas()
    got = {(r.dealer, r.technology): (r.dealer_mean, r.overall_mean) for r in M.compare_technology(v).collect()}
    for dealer in pdf.dealer.dropna().unique():
        for tech in M.TECHNOLOGIES:
            t = pdf[pdf.technology == tech]
            own, alls = t[t.dealer == dealer].score.mean(), t.score.mean()
            want = (round(own, 2) if pd.notna(own) else 0, round(alls, 2) if pd.notna(alls) else 0)
            assert got[(dealer, tech)] == want


def test_weekly_filled_sums_equal_weekly_counts(spark):
    f = X.facts(spark, SF_SMALL)
    filled = M.weekly_counts_filled(f, "dealer", "dt")
    plain = M.weekly_counts(f, "dt")
    assert filled.groupBy().sum("n_comments").first()[0] == plain.groupBy().sum("n_comments").first()[0]
    per_dealer = filled.groupBy("dealer").count().select("count").distinct().collect()
    assert len(per_dealer) == 1  # every dealer has the full global week range


def test_breakdown_shares_sum_to_100_with_null_group(spark):
    v = X.verbatims(spark, SF_SMALL)
    b = R.breakdown(v).where("dim = 'model'")
    assert b.where("value IS NULL").count() == 1
    assert abs(b.groupBy().sum("share_pct").first()[0] - 100.0) < 0.01 * b.count()
    assert b.groupBy().sum("n").first()[0] == v.count()


def test_breakdown_share_arithmetic(spark):
    rows = [("Gasolina",)] * 121 + [("Diésel",)] * 82 + [("Híbrido",)] * 46
    df = spark.createDataFrame([(t, 5.0) for (t,) in rows], "technology string, score double")
    got = {r.value: r.share_pct for r in R.breakdown(df, ["technology"]).collect()}
    assert got == {"Gasolina": 48.59, "Diésel": 32.93, "Híbrido": 18.47, "ALL": 100.0}


def test_theme_and_delay_bands_literal(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "Mucha ESPERA en el taller, 3 semanas"), (2, 8.0, "Todo perfecto y rápido"),
         (3, 4.0, "demora de 48 horas"), (4, 7.0, None)],
        "id int, score double, comment string")
    th = {r.theme: r for r in R.theme(df, {"espera": ["espera", "demora"]}).collect()}
    assert th["espera"].n_mentions == 2 and th["espera"].share_pct == 50.0 and th["espera"].mean_score == 3.0
    bands = {r.band: r.n for r in R.delay_bands(df).collect()}
    assert bands == {"none": 2, "1-7d": 1, "7-30d": 1}


def test_best_and_critical(spark):
    df = spark.createDataFrame(
        [("a", 2.0), ("a", 4.0), ("b", 8.0), ("c", 7.0), ("d", 7.0), ("d", 7.0), ("e", 1.0)],
        "dealer string, score double")
    best = [r.value for r in R.best(df, ["dealer"]).orderBy("rank").collect()]
    assert best == ["b", "d", "c"]
    crit = [r.value for r in R.critical(df, ["dealer"]).collect()]
    assert crit == ["e", "a"]


def test_themes_in_one_pass_equal_one_pattern_each(spark):
    """Hundreds of themes, terms of several words and marks, accents, plurals, repeated words; one join in the plan."""
    import random

    from feedloom.functions.text import mentions

    rng = random.Random(9)
    vocabulary = [f"t{i}" for i in range(300)] + ["Atención", "atencion", "ESPERA", "esperas", "tardanzas", "ñoño", "a-b", "mal", "servicio", "mal servicio", "mal, servicio", "x_espera", "vehículoß"]
    rows = [(i, rng.choice([1.0, 3.0, 5.0, 8.0, None]), rng.choice(["d1", "d2", "d3", "d4", None]), rng.choice([None, ""]) if rng.random() < 0.05 else " ".join(rng.choice(vocabulary) for _ in range(12))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, score double, dealer string, comment string")
    themes = {f"tema {i}": [f"t{i}", f"T{(i * 7) % 300}"] for i in range(290)}
    themes |= {"espera": ["espera", "tardanza"], "trato": ["atención", "atencion"], "frases": ["mal servicio", "a-b"], "mixto": ["mal servicio", "ñoño"], "nada": ["inaudito"], "sin": []}
    for name in themes:
        themes[name] = themes[name] or ["nunca dicho"]
    hit = df.select("*", *[mentions("comment", terms).alias(f"h{i}") for i, terms in enumerate(themes.values())]).toPandas()
    got = {r.theme: r for r in R.theme(df, themes).collect()}
    contrast = {r.theme: r for r in R.theme_contrast(df, themes).collect()}
    assert set(got) == set(contrast) == set(themes)
    for i, name in enumerate(themes):
        own = hit[hit[f"h{i}"]]
        assert got[name].n_mentions == len(own), name
        scores = own["score"].dropna()
        assert (got[name].mean_score is None) == scores.empty and (scores.empty or abs(got[name].mean_score - scores.mean()) < 0.0051)
        assert (contrast[name].mentions_low, contrast[name].mentions_high) == ((own["score"] <= 4).sum(), (own["score"] >= 7).sum())
        assert contrast[name].n_low == (hit["score"] <= 4).sum()
    assert R.theme(df.limit(0), {"a": ["b"]}).collect()[0].n_mentions == 0
    assert R.theme_dealers(df.limit(0), {"a": ["b"]}).count() == 0
    plan = R.theme_mentions(df, {k: themes[k] for k in list(themes)[:290]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RLIKE") == 0 and plan.count("BroadcastHashJoin") == 1
