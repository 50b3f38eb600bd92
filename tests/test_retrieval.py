"""kNN against numpy, chat history against a list slice, embedder hook, TF-IDF."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.operators import retrieval as RT
from feedloom.plans import fixtures as X
from tests.conftest import SF_SMALL


def test_knn_matches_numpy(spark):
    emb = X.table(spark, SF_SMALL, "embeddings")
    pdf = emb.toPandas()
    corpus = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    ids = pdf.vec_id.to_numpy()
    queries = spark.createDataFrame(
        [(int(i), [float(x) for x in corpus[i] + 0.01]) for i in range(7)], "query_id long, query_vec array<double>")
    got = RT.knn(queries, emb, k=5, payload=["label"]).collect()
    for q in range(7):
        d = ((corpus - (corpus[q] + 0.01)) ** 2).sum(axis=1)
        order = sorted(range(len(d)), key=lambda i: (d[i], ids[i]))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == [int(ids[i]) for i in order]
        assert np.allclose([r.distance for r in mine], [round(d[i], 6) for i in order])


def test_knn_small_corpus_and_chunks(spark):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(10)], "query_id long, query_vec array<double>")
    out = RT.knn(queries, corpus, k=5, queries_per_cell=3)
    assert out.count() == 30  # fewer than k corpus rows: all of them, per query
    first = {r.query_id: r.vec_id for r in out.where("rank = 1").collect()}
    assert first[0] == 1 and first[1] == 2 and first[9] == 3


def test_history_window_matches_slice(spark):
    conv = X.table(spark, SF_SMALL, "conversations")
    pdf = conv.toPandas().sort_values(["conv_id", "turn"])
    got = {(r.conv_id, r.turn): r.history for r in RT.history_window(conv, 4).collect()}
    exp = {}
    for cid, g in pdf.groupby("conv_id"):
        msgs = list(zip(g.role, g.text))
        for t, (role, _) in enumerate(msgs):
            if role == "user":
                hist = msgs[: t + 1][-4:] if t + 1 >= 4 else []
                exp[(cid, t)] = "\n".join(f"{r}: {x}" for r, x in hist)
    assert got == exp


def test_embed_hook_batches(spark):
    calls = spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(1)
        assert len(texts) <= 100
        return np.array([[len(t or ""), 1.0] for t in texts], dtype=np.float32)

    df = spark.range(250).select(F.col("id"), F.concat(F.lit("x"), F.col("id").cast("string")).alias("comment"))
    out = RT.embed_texts(df.coalesce(1), embed, "comment", "id", batch_size=100)
    rows = out.collect()
    assert len(rows) == 250 and calls.value == 3
    assert rows[0].embedding == [2.0, 1.0]


def test_tfidf_vectors(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "A c"), (3, None)], "id int, comment string")
    out = {r.id: r.features for r in RT.tfidf_vectors(df, num_features=1 << 20).collect()}
    assert len(out[1]) == 2 and len(out[2]) == 2 and len(out[3]) == 0
    vals = sorted(f.value for f in out[1])
    assert abs(vals[0] - np.log(4 / 3)) < 1e-12 and abs(vals[1] - 2 * np.log(4 / 2)) < 1e-12


def test_knn_skips_null_and_mixed_lengths_and_plans_one_scan(spark, tmpdir_path):
    corpus = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [5.0]), (4, [1.0, 1.0]), (5, [])], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [0.0, 0.1]), (1, [0.0, 0.1]), (2, None), (3, [4.0]), (4, [1.0, 2.0, 3.0])], "query_id long, query_vec array<double>")
    got = sorted((r.query_id, r.vec_id) for r in RT.knn(queries.dropDuplicates(), corpus, k=5).collect())
    assert got == [(1, 1), (1, 4), (3, 3)]
    emb = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    many = spark.range(20_000).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i * F.col("id")) % 7 / 10.0).alias("query_vec"))
    hits = RT.knn(many, emb, k=3)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("embeddings") <= 1 or plan.count("Relation [vec_id") == 1
    assert hits.count() == 60_000


def test_history_window_counts_messages_not_turn_numbers(spark):
    """Gaps, a late start, more than one block of turns, a null conversation."""
    turns = [5, 6, 9, 1023, 1024, 1025, 5000, 5003]
    rows = [(c, t, "user" if k % 2 else "assistant", f"m{t}") for c in (1, None) for k, t in enumerate(turns)]
    got = {(r.conv_id, r.turn): (r.n_history, r.history) for r in RT.history_window(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for c in (1, None):
        mine = [r for r in rows if r[0] == c]
        for k, r in enumerate(mine):
            if r[2] == "user":
                want = [f"{m[2]}: {m[3]}" for m in mine[max(0, k - 3) : k + 1]] if k >= 3 else []
                assert got[(c, r[1])] == (len(want), "\n".join(want))


def test_hashed_embeddings(spark):
    df = spark.createDataFrame([(1, "Hola hola mundo"), (2, None)], "id int, comment string")
    rows = {r.id: np.array(r.embedding) for r in RT.hashed_embeddings(df, dim=16).collect()}
    assert rows[1].shape == (16,) and abs(np.linalg.norm(rows[1]) - 1) < 1e-6 and sorted(rows[1])[-1] > 0.8
    assert not rows[2].any()


def test_enriched_text_missing_prints_nan(spark):
    df = spark.createDataFrame([("T1", None, "Gasolina", "7", "ok", None)],
                               "dealer string, model string, technology string, score_raw string, comment string, dt date")
    t = RT.enriched_text(df).first().texto_enriquecido
    assert t == "Taller: T1 | Modelo: nan | Tecnología: Gasolina | Puntuación: 7 | Comentario: ok | Fecha: nan"


def test_local_top_k_exact_with_ties():
    """Matrix-form preselection + exact recheck equals the plain per-query rule, ties included."""
    rng = np.random.default_rng(7)
    for n, m, k in [(200, 300, 5), (4, 3, 5), (50, 10, 1), (1000, 600, 7)]:
        x = rng.integers(-2, 3, size=(n, 8)).astype(np.float64)  # many exact ties
        q = rng.integers(-2, 3, size=(m, 8)).astype(np.float64) + 0.5
        r, qi, d = RT._local_top_k(x, q, k)
        got = sorted(zip(qi.tolist(), r.tolist(), d.tolist()))
        exp = []
        for j in range(m):
            dj = ((x - q[j]) ** 2).sum(axis=1)
            kth = np.sort(dj)[min(k, n) - 1]
            exp += [(j, i, float(dj[i])) for i in np.nonzero(dj <= kth)[0]]
        assert got == sorted(exp), (n, m, k)


def test_stored_knn_equals_direct(spark):
    """Reading the store back changes no retrieval result; hits show the six columns."""
    from feedloom.plans import catalog as Q

    stored = {(r.service, r.query_id, r["rank"]): (r.vec_id, r.distance, r.comment) for r in Q.QUERIES["stored_knn"](spark, SF_SMALL).collect()}
    direct = {}
    for service in ("Ventas", "Posventa"):
        vt = X.verbatims(spark, SF_SMALL).where(F.col("service") == service)
        hits = RT.knn(Q._questions(spark, SF_SMALL), Q._embedded(vt), k=5, payload=Q.STORE_COLS)
        direct |= {(service, r.query_id, r["rank"]): (r.vec_id, r.distance, r.comment) for r in hits.collect()}
    assert stored == direct and len(stored) > 0


def _clustered(n, dims, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dims)) * 3
    x = (centres[rng.integers(0, 25, n)] + spread * rng.normal(size=(n, dims))).astype(np.float32)
    x[rng.random(n) < 0.3] = x[0]  # a third of all rows is one vector
    return x


@pytest.mark.parametrize(("pivots", "cell", "bucket"), [(512, 4096, 8192), (7, 3, 50), (1, 4096, 30)])
def test_knn_with_pivots_equals_brute_force(spark, pivots, cell, bucket):
    x = _clustered(900, 8, 1)
    q = np.concatenate((x[:6], _clustered(6, 8, 2), np.zeros((1, 8), np.float32)))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, []), (5002, [1.0, 2.0]), (5003, [1.0, 2.5])]
    asked = [(i, v.tolist()) for i, v in enumerate(q)] + [(70, None), (71, []), (72, [1.0, 2.0]), (73, [1.0] * 5)]
    got = RT.knn(spark.createDataFrame(asked, "query_id long, query_vec array<float>"), spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5,
                 queries_per_cell=cell, rows_per_bucket=bucket, pivots=pivots)
    want = []
    for i, v in asked:
        if v:
            near = sorted((round(float(((np.array(w, np.float32).astype(float) - np.array(v, np.float32).astype(float)) ** 2).sum()), 9), j) for j, w in rows if w and len(w) == len(v))[:5]
            want += [(i, r + 1, j) for r, (_, j) in enumerate(near)]
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got.collect()) == want


def test_knn_visits_few_parts(spark):
    """Over clustered vectors the triangle bound leaves a query a small share of the parts, and of the rows."""
    x = _clustered(4000, 8, 3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "v long, x array<float>")
    dealt, index = RT.pivot_index(rows)
    q = x[::40].astype(float)
    there = index.parts[8]
    assert there["rows"].sum() == 4000 and len(there["part"]) > 15
    home = index.home(q, 5)
    d = ((q[:, None, :] - x[None].astype(float)) ** 2).sum(axis=2)
    kth = np.sort(d, axis=1)[:, 4]
    further = index.beyond(q, kth, 5)
    visited = np.mean([len(a) + len(b) for a, b in zip(home, further)])
    assert visited < 0.2 * len(there["part"])
    assert all(not set(a) & set(b) for a, b in zip(home, further))


def test_knn_empty_sides(spark):
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, query_vec array<float>")
    assert RT.knn(asked, some.limit(0)).count() == 0 and RT.knn(asked.limit(0), some).count() == 0
    assert [tuple(r) for r in RT.knn(asked, some).collect()] == [(1, 1, 1, 0.0)]


def test_embeddings_take_long_texts_in_small_batches(spark):
    """Ten thousand long texts are not one batch: vectors come out as they would one by one, batches are bounded in bytes."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    long = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(3000)), lambda i: F.concat(F.lit("w"), (i + F.col("id")).cast("string"))))
    df = spark.range(0, 400, 1, 1).select("id", long.alias("comment"))
    out = RT.hashed_embeddings(df, dim=8)

    def sizes(batches):
        for b in batches:
            yield b.slice(0, 1).select(["id"])

    batches = df.select("id", RT.words("comment").alias("w")).mapInArrow(sizes, "id long").count()
    assert batches > 1
    got = {r.id: list(r.embedding) for r in out.collect()}
    for i in (0, 399):
        counts = np.bincount([int(hashlib.md5(f"w{j + i}".encode()).hexdigest()[:8], 16) % 8 for j in range(3001)], minlength=8)
        assert np.allclose(got[i], counts / np.linalg.norm(counts), atol=1e-6)


def test_tfidf_counts_words_where_they_are_read(spark, monkeypatch):
    """Repeated and null ids keep their rows; words are not shuffled."""
    rows = [(1, "a b b"), (1, "a c"), (2, None), (3, ""), (None, "a d"), (None, None), (4, "b b b a b")]
    plans = []
    writer = type(spark.range(1).write)
    write = writer.parquet
    monkeypatch.setattr(writer, "parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or write(self, *a, **k))
    out = RT.tfidf_vectors(spark.createDataFrame(rows, "id int, comment string"), num_features=1 << 20).collect()
    got = sorted((r.id or 0, sorted(round(f.value, 9) for f in r.features)) for r in out)
    ln = lambda x: round(float(np.log(x)), 9)
    one = sorted([round(2 * np.log(8 / 4), 9), round(2 * np.log(8 / 3), 9), ln(8 / 2)])
    assert got == [(0, []), (0, []), (1, one), (1, one), (2, []), (3, []), (4, sorted([ln(2), round(4 * np.log(8 / 3), 9)]))]
    assert "MapInArrow" in plans[0] and "Exchange" not in plans[0]
