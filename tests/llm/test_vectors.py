"""Vector searches against brute force, ties, repeated and unusable vectors included."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import ann, topk, vectors
from tests.conftest import SF_SMALL

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def rows_of(seed, n=700, dims=12, same=0.3):
    """Clustered vectors; a third share one vector; some are unusable, some rows repeat."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, dims))
    x = (centers[rng.integers(0, 9, n)] + 0.3 * rng.normal(size=(n, dims))).astype(np.float32)
    x[rng.random(n) < same] = x[0]
    rows = [(int(k), [float(v) for v in row], None) for k, row in enumerate(x)]
    bad = [None, [], [0.0] * dims, [float("nan")] * dims, [float("inf"), *[1.0] * (dims - 1)], [None, *[1.0] * (dims - 1)], [1.0, 2.0]]
    rows += [(100_000 + 100 * k, v, 0) for k, v in enumerate(bad)] + [(None, rows[1][1], 0)] + rows[:3]
    random.Random(seed).shuffle(rows)
    return rows


def fine(rows, dims, allow_zero):
    out = {}
    for i, v, _ in rows:
        if i is not None and v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v) and (allow_zero or any(v)):
            out[i] = v
    return out


def brute(found, queries, k, score):
    out = []
    for q in sorted(queries):
        best = sorted(((-score(found[q], v), i) for i, v in found.items() if i != q))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def whole(a, b):
    return sum(math.floor(1024 * x) * math.floor(1024 * y) for x, y in zip(a, b))


@pytest.mark.parametrize(("seed", "buckets", "blocks"), [(1, 8_192, 2_048), (2, 90, 3)])
def test_op8_equals_brute_force(spark, monkeypatch, seed, buckets, blocks):
    monkeypatch.setattr(topk, "ROWS_PER_BUCKET", buckets)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", blocks)
    rows = rows_of(seed)
    found = fine(rows, 12, True)
    got = sorted(tuple(r) for r in topk.op8_top_k(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(found, [i for i in found if i % 100 == 0], 10, whole)


def test_cutoff_prunes_and_few_candidates_are_all_returned(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    found = topk.top_k(df, F.col("vec_id") % 100 == 0, 10)
    assert found.agg(F.avg("collected")).first()[0] < 0.5 * df.count()
    rows = [(k, [float(k), 1.0], None) for k in (0, 100, 5)]
    got = sorted(tuple(r) for r in topk.op8_top_k(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(fine(rows, 2, True), [0, 100], 10, whole)


def test_large_components_stay_exact(spark):
    rows = [(k, [2.0**16 + k, -(2.0**15) * (k / 50)], None) for k in range(0, 300, 50)]  # beyond what doubles hold
    got = sorted(tuple(r) for r in topk.op8_top_k(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(fine(rows, 2, True), [0, 100, 200], 10, whole)


@pytest.mark.parametrize("slab", [4_096, 40])
def test_op6_recall_scores_and_ties(spark, monkeypatch, slab):
    monkeypatch.setattr(ann, "SLAB_ROWS", slab)
    monkeypatch.setattr(ann, "ROOTS_PER_LIST", 2)
    monkeypatch.setattr(ann, "QUERIES_PER_BLOCK", 7)
    rows = rows_of(4)
    found = fine(rows, 12, False)
    inner = lambda a, b: float((np.array(a) * np.array(b)).sum())
    got = {}
    for r in ann.op6_nearest(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault(r.query_id, []).append(r)
    want = {}
    for q, rank, i, s in brute(found, [i for i in found if i % 20 == 0], 20, inner):
        want.setdefault(q, []).append((i, s))
    assert got.keys() == want.keys()
    hits = 0
    for q, best in want.items():
        mine = sorted(got[q], key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert all(abs(r.score - inner(found[q], found[r.vec_id])) < 1e-9 for r in mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        hits += len({r.vec_id for r in mine} & {i for i, _ in best})
    assert hits >= 0.9 * 20 * len(want)


def test_op6_recall_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROOTS_PER_LIST", 1)  # some forty lists
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, dtype=float) for r in df.collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids])
    hits = total = 0
    got = {}
    for r in ann.op6_nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for q in got:
        s = (x * rows[q]).sum(axis=1)
        s[ids == q] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        hits, total = hits + len(best & got[q]), total + 20
    assert hits >= 0.9 * total


def test_few_candidates_and_empty_tables(spark):
    rows = [(k, [1.0, float(k)], None) for k in (0, 20, 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ann.op6_nearest(df).count() == 4
    for op in (ann.op6_nearest, topk.op8_top_k):
        assert op(df.limit(0)).count() == 0
        assert op(df.where("vec_id = 3")).count() == 0
        assert op(df.where("vec_id = 20")).count() == 0
    assert vectors.usable(spark.createDataFrame(rows_of(5), SCHEMA), False).count() == len(fine(rows_of(5), 12, False))


def test_op8_has_no_clip_and_meets_own_length_alone(spark):
    """Components far beyond 32 bits, products beyond 64 bits with the query itself, two lengths, clashing columns."""
    rows = [(0, [1.0]), (100, [3e6]), (5, [2.5e6]), (7, [-2e6]), (200, [1.0, 2.0]), (9, [3.0, 4.0]), (11, [1e9, 1.0]), (300, [5.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    clash = {c: F.lit(1) for c in ("v", "q", "size", "bucket", "block", "list", "total", "lowest", "query_id", "score", "rank", "label")}
    got = sorted(tuple(r) for r in topk.op8_top_k(df.withColumns(clash)).collect())
    found = dict(rows)
    want = []
    for q in (0, 100, 200):
        same = [(-whole(found[q], v), i) for i, v in found.items() if i != q and len(v) == len(found[q])]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(same))]
    assert got == want and got[0] == (0, 1, 100, 3145728000000)


def test_op8_names_what_does_not_fit(spark):
    for rows, words in (([(0, [4e6]), (1, [4e6])], "score does not fit"), ([(0, [1e17]), (1, [1.0])], "component does not fit")):
        with pytest.raises(Exception, match=words):
            topk.op8_top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()


def test_op6_ignores_clashing_columns(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    clash = {c: F.lit(1) for c in ("query_id", "rank", "score", "list", "slab", "x", "v", "n", "ids", "block", "q")}
    assert sorted(map(tuple, ann.op6_nearest(df.withColumns(clash)).collect())) == sorted(map(tuple, ann.op6_nearest(df).collect()))


def test_op6_threshold_tightens_and_abandons():
    """Over clustered vectors most candidates are abandoned before their last block, and the neighbours are still found."""
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 64))
    x = centers[rng.integers(0, 40, 4000)] + 0.2 * rng.normal(size=(4000, 64))
    rotation = np.linalg.qr(rng.normal(size=(65, 65)))[0]
    index = ann.Index(rotation, None, float(np.sqrt((x * x).sum(axis=1).max())))
    seen = {}
    found = ann.scan(index.lift(x[:60], True), x[:60], index.lift(x, False), x, [np.array([i]) for i in range(4000)], list(range(60)), 10, seen)
    assert seen["pairs"] == 60 * 4000 and seen["whole"] < 0.25 * seen["pairs"]
    scores = x[:60] @ x.T
    scores[np.arange(60), np.arange(60)] = -np.inf
    true = {(q, int(v)) for q, row in enumerate(scores) for v in np.argsort(-row)[:10]}
    assert len(true & {(q, v) for q, v, _ in found}) >= 0.97 * len(true)
