"""Learned delay verdicts, distinctive terms, silences and mean drivers against brute force and planted cases."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import delay_days
from feedloom.operators import findings as FD
from feedloom.operators import report as R
from feedloom.plans.fixtures import spelled


# --- delays -------------------------------------------------------------------
def test_every_spelled_number_is_read(spark):
    """All numbers below a thousand in words, alone, in thousands and with halves."""
    rows = [(f"{spelled(n)} dias", float(n)) for n in range(1, 1000)]
    rows += [(f"Tardó {spelled(n)} mil {spelled(m)} días.", float(n * 1000 + m)) for n, m in zip(range(2, 1000, 37), range(1, 1000, 37))]
    rows += [(f"{spelled(n)} semanas y media", (n + 0.5) * 7) for n in range(2, 60)] + [(f"{spelled(n)} y media horas", (n + 0.5) / 24) for n in range(1, 60)]
    df = spark.createDataFrame(rows, "c string, want double").select("c", "want", delay_days("c").alias("d"))
    assert df.where("d IS NULL OR abs(d - want) > 1e-9").collect() == []


@pytest.mark.parametrize(("text", "want"), [
    ("cinco seis dias", 6.0), ("treinta y dias", None), ("mil mil dias", 1000.0), ("dos, dias", None), ("2 y medio dias", 2.5), ("1.234,5 dias", 1234.5), ("24H", 1.0),
    ("abc24h", None), ("hora y media", None), ("un mes y medio. dos horas", 45.0), ("tres dias y dos horas y media", 3.0), ("dos dias y medio mes", 15.0), ("años", None), ("", None), (None, None),
    ("x" * 500 + " diez días " + "y" * 500 + " 3 semanas y media" + " z" * 300, 24.5), ("diez " + "muy " * 40 + "dias", None), ("novecientos noventa y nueve mil novecientos noventa y nueve dias", 999999.0),
])
def test_delay_forms(spark, text, want):
    got = spark.createDataFrame([(text,)], "c string").select(delay_days("c").alias("d")).first().d
    assert got == want if want is None else abs(got - want) < 1e-9


def all_cuts(n, s, ss, k):
    def cost(a, b):
        return ss[a:b].sum() - s[a:b].sum() ** 2 / n[a:b].sum()

    best = None
    for cuts in itertools.combinations(range(1, len(n)), k - 1):
        edges = [0, *cuts, len(n)]
        c = sum(cost(a, b) for a, b in zip(edges, edges[1:]))
        if best is None or c < best[0] - 1e-9:
            best = (c, list(cuts))
    return best[1]


@pytest.mark.parametrize("seed", range(30))
def test_best_cuts_equal_all_cuts(seed):
    rng = np.random.default_rng(seed)
    m, k = int(rng.integers(1, 13)), int(rng.integers(1, 5))
    scores = [rng.integers(1, 9 if seed % 3 else 3, rng.integers(1, 5)) for _ in range(m)]  # few values: many ties
    n, s, ss = (np.array([f(x) for x in scores], dtype=float) for f in (len, np.sum, lambda x: (x**2).sum()))
    assert R.best_cuts(n, s, ss, k) == all_cuts(n, s, ss, min(k, m))


def test_verdicts_by_group_nulls_and_few_delays(spark):
    rows = [("a", f"{d} dias", s) for d, s in [(1, 8.0), (1, 8.0), (2, 7.0), (5, 4.0), (6, 4.0), (30, 1.0), (40, 2.0)]] + [("b", "2 horas", 3.0), ("b", "nada", 8.0), ("c", "3 dias", None), (None, "9 dias", 5.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "service string, comment string, score double")
    got = [tuple(r) for r in R.delay_verdicts(df, ["service"]).orderBy("service", "band").collect()]
    assert got == [(None, 1, 9.0, 9.0, 1, 5.0, "genial"), ("a", 1, 1.0, 2.0, 3, 7.67, "genial"), ("a", 2, 5.0, 6.0, 2, 4.0, "bien"), ("a", 3, 30.0, 40.0, 2, 1.5, "mal"), ("b", 1, 0.083333, 0.083333, 1, 3.0, "genial")]
    assert R.delay_verdicts(df.limit(0)).collect() == []
    whole = R.delay_verdicts(df).orderBy("band").collect()
    assert {r.verdict for r in whole} == {"genial", "bien", "mal"} and sum(r.n for r in whole) == 9
    assert sorted(whole, key=lambda r: -r.mean_score) == sorted(whole, key=lambda r: ["genial", "bien", "mal"].index(r.verdict))


# --- distinctive terms ----------------------------------------------------------
def test_planted_terms_come_first(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(600):
        dealer, score = rng.choice([("malo 1", 2.0), ("malo 2", 3.0), ("bueno 1", 8.0), ("bueno 2", 7.0), ("medio", 6.0)])
        text = [rng.choice(words) for _ in range(30)]
        if dealer.startswith("malo") and rng.random() < 0.3:
            text += ["larga", "espera"]
        if dealer.startswith("bueno") and rng.random() < 0.3:
            text += ["trato", "cercano"]
        rows.append((dealer, " ".join(text), score))
    rows += [("malo 1", None, None), (None, "espera larga", 1.0), ("malo 2", "", 3.0)]
    df = spark.createDataFrame(rows, "dealer string, comment string, score double")
    got = FD.distinctive_terms(df, k=3, best=2).collect()
    first = {side: [r.term for r in sorted(got, key=lambda r: r["rank"]) if r.side == side] for side in ("low", "best")}
    assert set(first["low"]) == {"larga", "espera", "larga espera"} and set(first["best"]) == {"trato", "cercano", "trato cercano"}
    assert all((r.z > 0) == (r.side == "low") for r in got)
    assert FD.distinctive_terms(df.limit(0)).count() == 0


def test_dealer_groups_do_not_overlap(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", None), (None, 8.0)], "dealer string, score double")
    assert {tuple(r) for r in FD.dealer_groups(df, best=2).collect()} == {("c", "best"), ("b", "best"), ("a", "low")}


# --- silences ------------------------------------------------------------------
def brute_silences(rows, stop=2):
    months = defaultdict(lambda: defaultdict(int))
    for d, y, m in rows:
        months[d][y * 12 + m - 1] += 1
    lo, hi = min(k for v in months.values() for k in v), max(k for v in months.values() for k in v)
    out = []
    for d, seen in months.items():
        m = lo
        while m <= hi:
            if m in seen:
                m += 1
                continue
            end = m
            while end <= hi and end not in seen:
                end += 1
            a = m
            while a > lo and a - 1 in seen:
                a -= 1
            b = end
            while b in seen:
                b += 1
            kind = "late" if m == lo else "gap" if end - m < stop else "stopped" if end > hi else "pause"
            out.append((d, f"{m // 12}-{m % 12 + 1:02d}-01", end - m, kind, m - a if m > lo else None, sum(seen[x] for x in range(a, m)) if m > lo else None, sum(seen[x] for x in range(end, b)) if end <= hi else None))
            m = end
    return sorted(out, key=repr)


def test_silences_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for d in range(40):
        alive = [m for m in range(30) if rng.random() < rng.choice([0.2, 0.6, 0.95])]
        rows += [(f"T{d}", 2023 + m // 12, m % 12 + 1) for m in alive for _ in range(rng.choice([1, 3]))]
    df = spark.createDataFrame(rows, "dealer string, y int, m int").select("dealer", F.make_date("y", "m", F.lit(9)).alias("dt"))
    df = df.unionByName(spark.createDataFrame([(None, None), ("T0", None)], "dealer string, dt date"))
    got = sorted(((r.dealer, str(r.from_month), r.n_months, r.kind, r.active_months, r.n_before, r.n_after) for r in FD.silences(df).collect()), key=repr)
    assert got == brute_silences(rows) and {g[3] for g in got} == {"late", "gap", "pause", "stopped"}
    assert FD.silences(df.where("dealer = 'none'")).count() == 0


# --- drivers -------------------------------------------------------------------
def test_contributions_add_up_to_the_gap(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["M1", "M2", "M3", None]), rng.choice(["a", "b", "c", "d", None]), rng.choice([1.0, 4.0, 8.0, None])) for _ in range(400)] + [("M9", "z", 2.0)]
    df = spark.createDataFrame(rows, "model string, dealer string, score double")
    got = FD.mean_drivers(df).collect()
    used = [r for r in rows if None not in r]
    overall = np.mean([r[2] for r in used])
    for m in {r[0] for r in used}:
        own = [r for r in got if r.model == m]
        gap = np.mean([r[2] for r in used if r[0] == m]) - overall
        assert abs(sum(r.level + r.mix for r in own) - gap) < 1e-4 and all(abs(r.gap - gap) < 1e-6 for r in own)
        assert abs(sum(r.share for r in own) - 1) < 1e-4 and sum(r.dealer == FD.OTHERS for r in own) == 1
        for r in own:
            left = [x[2] for x in used if x[0] == m and x[1] != r.dealer]
            if r.dealer != FD.OTHERS:
                want = np.mean([x[2] for x in used if x[0] == m]) - np.mean(left) if left else None
                assert (r.influence is None) == (want is None) and (want is None or abs(r.influence - want) < 1e-6)
    assert FD.mean_drivers(df.limit(0)).count() == 0


def test_terms_are_counted_in_pieces_of_bounded_size(spark, monkeypatch):
    """A crowded dealer's texts are dealt to many tasks before their terms are counted."""
    from feedloom.operators import retrieval as RT

    monkeypatch.setattr(RT, "PIECE_BYTES", 1000)
    df = spark.createDataFrame([("bad" if i % 2 else "good", f"a{i % 7} b{i % 5} " * 10, 2.0 if i % 2 else 8.0) for i in range(200)], "dealer string, comment string, score double").coalesce(1)
    plans = []
    whole = type(df).checkpoint
    monkeypatch.setattr(type(df), "checkpoint", lambda self, *a, **k: plans.append(self._jdf.queryExecution().executedPlan().toString()) or whole(self, *a, **k))
    got = FD.distinctive_terms(df, k=2, best=1).collect()
    dealt = [p for p in plans if "RoundRobinPartitioning" in p]
    assert len(dealt) == 1 and "SortMergeJoin" not in dealt[0]
    monkeypatch.setattr(RT, "PIECE_BYTES", 1 << 20)
    assert len(got) == 4 and sorted(got) == sorted(FD.distinctive_terms(df, k=2, best=1).collect())
