"""The refreshed embedding store, name variants and trend breaks against plain versions."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.functions import slug
from feedloom.operators import findings as FD
from feedloom.operators import names as N
from feedloom.sources import store as ST


def texts_of(seen):
    def embed(texts):
        seen.append(sorted(r.text for r in texts.collect()))
        return texts.select("text_key", F.array(F.length("text").cast("float")).alias("embedding"))

    return embed


def test_refresh_embeds_new_texts_only_and_retires_old_ones(spark, tmpdir_path):
    load = lambda rows: spark.createDataFrame(rows, "id int, texto_enriquecido string")
    seen = []
    assert ST.read_embeddings(spark, tmpdir_path, "Servicio técnico") is None
    one = ST.refresh_embeddings(load([(1, "aa"), (2, "bbb"), (3, "aa"), (4, None)]), tmpdir_path, "Servicio técnico", texts_of(seen))
    two = ST.refresh_embeddings(load([(2, "bbb"), (5, "cccc"), (6, "bbb"), (7, "")]), tmpdir_path, "Servicio técnico", texts_of(seen))
    ST.refresh_embeddings(load([]), tmpdir_path, "Servicio técnico", texts_of(seen))
    four = ST.refresh_embeddings(load([(1, "aa")]), tmpdir_path, "Servicio técnico", texts_of(seen))
    assert seen == [["aa", "bbb"], ["", "cccc"], [], ["aa"]]  # what had left is new again
    shown = lambda df: sorted(((r.id, r.embedding and r.embedding[0]) for r in df.collect()))
    assert shown(one) == [(1, 2.0), (2, 3.0), (3, 2.0), (4, None)]  # an earlier version stays readable
    assert shown(two) == [(2, 3.0), (5, 4.0), (6, 3.0), (7, 0.0)]
    assert shown(four) == shown(ST.read_embeddings(spark, tmpdir_path, "servicio tecnico")) == [(1, 2.0)]
    assert ST.read_embeddings(spark, tmpdir_path, "Ventas") is None


def test_half_written_version_is_not_seen(spark, tmpdir_path):
    load = spark.createDataFrame([(1, "aa")], "id int, texto_enriquecido string")
    ST.refresh_embeddings(load, tmpdir_path, "Ventas", texts_of([]))
    home = ST._home(tmpdir_path, "Ventas")
    load.write.parquet(f"{home}/00000002/rows")  # a refresh that ended before its marker
    assert ST.current_version(spark, tmpdir_path, "Ventas") == 1
    with pytest.raises(Exception, match="already exists"):
        spark.range(1).write.parquet(f"{home}/00000002/rows")


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def allowed(s):
    return 2 if len(s) >= 10 else 1 if len(s) >= 5 else 0


def test_variants_equal_all_pairs(spark):
    rng = random.Random(6)
    bases = ["Talleres Gallego", "Tolosa Motor", "Kia Sur 12", "Kia Sur 13", "Ana", "Aná", "Auto Norte", "aaaaaaaaaaaa", "Motor Este 4"]
    rows = []
    for _ in range(260):
        name = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(name)) if name else 0
            name[at : at + rng.choice([0, 1])] = rng.choice(["", "x", "a", " ", ",", "É"])
        rows += [("".join(name),)] * rng.choice([1, 2, 5])
    df = spark.createDataFrame([*rows, (None,), ("",), ("--",)], "dealer string")
    keyed = {r.dealer: r.s for r in df.where("dealer IS NOT NULL").select("dealer", slug("dealer").alias("s")).distinct().collect()}
    keys = sorted(set(keyed.values()))
    digits = lambda s: [c for c in s if c.isdigit()]
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    pairs = set()
    for a, b in itertools.combinations(keys, 2):
        if digits(a) == digits(b) and levenshtein(a, b) <= min(allowed(a), allowed(b)):
            pairs.add((a, b))
            x, y = sorted((find(a), find(b)))
            root[y] = x
    found = spark.createDataFrame([(k,) for k in keys], "key string")
    assert {tuple(r) for r in N.variant_pairs(found).collect()} == pairs and len(pairs) > 50
    counts = df.where("dealer IS NOT NULL").groupBy("dealer").count().collect()
    groups = defaultdict(list)
    for r in counts:
        groups[find(keyed[r.dealer])].append((-r["count"], r.dealer))
    want = sorted((name, min(g)[1], -n, len(g)) for g in groups.values() for n, name in g)
    assert sorted(map(tuple, N.resolve_names(df).collect())) == want
    assert N.canonical_names(df).where("dealer IS NULL").count() == 1 and N.canonical_names(df).count() == df.count()
    assert N.resolve_names(df.limit(0)).count() == 0


def test_a_chain_of_variants_is_one_name(spark):
    chain = ["abcdefghij" + "x" * i for i in range(0, 40, 2)]
    df = spark.createDataFrame([(c,) for c in chain] + [(chain[7],)], "dealer string")
    assert {r.canonical for r in N.resolve_names(df).collect()} == {chain[7]}


def all_segments(n, s, ss, penalty):
    m, best = len(n), None
    for size in range(m):
        for cuts in itertools.combinations(range(1, m), size):
            edges = [0, *cuts, m]
            c = penalty * size + sum(ss[a:b].sum() - s[a:b].sum() ** 2 / n[a:b].sum() for a, b in zip(edges, edges[1:]))
            if best is None or c < best - 1e-9:
                best = c
    return best


@pytest.mark.parametrize("seed", range(20))
def test_best_segments_cost_the_least(seed):
    rng = np.random.default_rng(seed)
    m = int(rng.integers(1, 11))
    scores = [rng.integers(1, 9, rng.integers(1, 6)) + (3 if seed % 2 and i > m // 2 else 0) for i in range(m)]
    n, s, ss = (np.array([f(x) for x in scores], dtype=float) for f in (len, np.sum, lambda x: (x**2).sum()))
    penalty = float(rng.choice([0.5, 5, 50]))
    edges = [*FD.best_segments(n, s, ss, penalty), m]
    got = penalty * (len(edges) - 2) + sum(ss[a:b].sum() - s[a:b].sum() ** 2 / n[a:b].sum() for a, b in zip(edges, edges[1:]))
    assert edges[0] == 0 and abs(got - all_segments(n, s, ss, penalty)) < 1e-6


def test_planted_breaks_are_found_and_flat_series_left_alone(spark):
    rng = random.Random(2)
    rows = []
    for month in range(1, 13):
        for _ in range(40):
            rows.append(("llano", month, float(rng.choice([5, 6, 7]))))
            rows.append(("cae", month, float(rng.choice([6, 7, 8]) if month < 7 else rng.choice([2, 3, 4]))))
            rows.append(("pico", month, float(rng.choice([7, 8]) if month in (3, 4) else rng.choice([4, 5]))))
    rows += [("uno", 5, 3.0), ("nulo", 5, None), (None, 5, 1.0)]
    df = spark.createDataFrame(rows, "dealer string, m int, score double").select("dealer", F.make_date(F.lit(2025), "m", F.lit(3)).alias("dt"), "score")
    got = defaultdict(list)
    for r in FD.trend_breaks(df).orderBy("dealer", "segment").collect():
        got[r.dealer].append((r.from_month.month, r.to_month.month))
    assert got == {"llano": [(1, 12)], "cae": [(1, 6), (7, 12)], "pico": [(1, 2), (3, 4), (5, 12)], "uno": [(5, 5)]}
    assert FD.trend_breaks(df.limit(0)).count() == 0


def test_ipv4_bits_are_those_of_the_address_library(spark):
    from feedloom.functions.net import address_bits
    from feedloom.operators.enrich import with_bits

    texts = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "256.1.1.1", "01.2.3.4", "1.2.3", "1.2.3.4 ", "1.2.3.4\n", "a.b.c.d", "::1", "2001:db8::ff00:42:8329", "::ffff:1.2.3.4", "1:2", "", None, "٣.1.1.1"]
    got = {r.ip: r.bits for r in with_bits(spark.createDataFrame([(t,) for t in texts], "ip string"), "ip").collect()}
    assert got == {t: address_bits(t) for t in texts if t is not None and address_bits(t)}
