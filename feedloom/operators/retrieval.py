"""Retrieval over comments: enriched text, vectors, exact kNN, context, chat history.

* kNN deals the corpus to pivots and rules parts out by the triangle inequality.  What is
  left meets in cells (a bucket of a part's rows, a block of queries) by a cogrouped
  shuffle of (id, vector) only; of the vectors, the driver sees a bounded sample.  A cell
  is scored with vectorised numpy and emits its local top-k per query, so at most k
  rows (plus ties) per query and bucket go on; payload columns join the winners.
* Chat history copies every message to the (at most ``n``) later positions whose window
  it belongs to, so each group holds at most ``n`` rows no matter how long one
  conversation is; positions are counted per block of turns.
* Text vectors are TF-IDF over a fixed number of token buckets.  Dense embeddings
  default to hashed token counts; a caller-supplied embedding model can be plugged in
  through ``embed_texts`` (``mapInPandas``, fixed-size batches per call).  Buckets are
  taken from md5, which other engines compute alike.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from feedloom.functions import word_count
from feedloom.session import bound_batches, ensure_checkpoint_dir

# Labels of the enriched text, in output order.
ENRICHED_LABELS = [
    ("Taller", "dealer"),
    ("Modelo", "model"),
    ("Tecnología", "technology"),
    ("Puntuación", "score_raw"),
    ("Comentario", "comment"),
    ("Fecha", "dt"),
]
MISSING = "nan"


def _show(c: str, dtype: str) -> Column:
    v = F.col(c)
    if dtype == "date":
        v = F.date_format(v.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    elif dtype.startswith("timestamp"):
        v = F.date_format(v, "yyyy-MM-dd HH:mm:ss")
    return F.coalesce(v.cast("string"), F.lit(MISSING))


# -------------------------------------------------------------------- T1 ----
def enriched_text(df: DataFrame, labels=ENRICHED_LABELS, out: str = "texto_enriquecido") -> DataFrame:
    """``Taller: … | Modelo: … | …`` per row; missing values print as ``nan``."""
    types = dict(df.dtypes)
    parts = [F.concat(F.lit(f"{label}: "), _show(c, types[c])) for label, c in labels]
    return df.withColumn(out, F.concat_ws(" | ", *parts))


# -------------------------------------------------------------------- T2 ----
#: Queries and corpus rows that meet in one cell at most (about).
QUERIES_PER_CELL = 4096
ROWS_PER_BUCKET = 8192
#: Pivots are centres of a bounded sample of the corpus; every row is indexed under one.
MAX_PIVOTS = 512
PIVOT_SAMPLE = 4096
#: Distances equal to so many decimals are ties: engines add up squares in different orders.
TIE_DIGITS = 9


class PivotIndex:
    """Pivots per vector length, and of each pivot's rows how many there are and how near and far they lie.

    Small by construction: at most ``MAX_PIVOTS`` pivots and one entry for every length
    that the sample does not hold (such rows are always visited).
    """

    def __init__(self, sample: list, rows: int, pivots: int = MAX_PIVOTS):
        wanted = min(pivots, max(1, int(rows**0.5)))
        self.pivots: dict[int, np.ndarray] = {}
        by_length: dict[int, list] = {}
        for x in sample:
            by_length.setdefault(len(x), []).append(x)
        for n, vectors in by_length.items():
            x = np.array(vectors, dtype=np.float64)
            if n and np.isfinite(x).all():
                self.pivots[n] = _centres(x, max(1, wanted * len(x) // len(sample)))
        self.parts: dict[int, dict[str, np.ndarray]] = {}

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pivot number and distance of each row; number -1 where the length has no pivots."""
        pivots = self.pivots.get(x.shape[1])
        if pivots is None:
            return np.full(len(x), -1), np.zeros(len(x))
        part = _squares(x, pivots).argmin(axis=1)
        return part, np.sqrt(((x - pivots[part]) ** 2).sum(axis=1))

    def add_parts(self, stats: list) -> None:
        """Rows of (length, part, rows, near, far)."""
        for n in {r["length"] for r in stats}:
            own = sorted((r for r in stats if r["length"] == n), key=lambda r: r["part"])
            self.parts[n] = {c: np.array([r[c] for r in own]) for c in ("part", "rows", "near", "far")}

    def home(self, q: np.ndarray, k: int) -> list[np.ndarray]:
        """Per query the parts of the nearest pivots that hold ``k`` rows between them (all, if fewer)."""
        there = self.parts.get(q.shape[1])
        if there is None:
            return [np.empty(0, int)] * len(q)
        if q.shape[1] not in self.pivots:
            return [there["part"]] * len(q)
        d = _squares(q, self.pivots[q.shape[1]])[:, there["part"]]
        out = []
        for order in np.argsort(d, axis=1, kind="stable"):
            enough = int(np.searchsorted(np.cumsum(there["rows"][order]), k)) + 1
            out.append(there["part"][order[:enough]])
        return out

    def beyond(self, q: np.ndarray, kth: np.ndarray, k: int) -> list[np.ndarray]:
        """Per query the further parts that may hold a row within squared distance ``kth``.

        By the triangle inequality a row of part j is no nearer than |d(q, pivot j)| less
        the ring of distances that j's rows have from their pivot, and no nearer than the
        plane half-way between pivot j and the query's nearest pivot.
        """
        home = self.home(q, k)
        pivots = self.pivots.get(q.shape[1])
        there = self.parts.get(q.shape[1])
        if there is None or pivots is None:
            return [np.empty(0, int)] * len(q)
        d = np.sqrt(np.maximum(_squares(q, pivots), 0))
        first = d.argmin(axis=1)
        between = np.sqrt(np.maximum(_squares(pivots, pivots), 0))
        own = d[:, there["part"]]
        ring = np.maximum(own - there["far"], there["near"] - own)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (own**2 - (d[np.arange(len(q)), first] ** 2)[:, None]) / (2 * between[first][:, there["part"]])
        plane[~np.isfinite(plane)] = 0
        # distances are rounded: bounds give way a little
        bound = np.maximum(np.maximum(ring, plane) - 1e-6 * (1 + own + there["far"]), 0)
        near = bound**2 <= kth[:, None] + 2 * 10.0**-TIE_DIGITS
        return [np.setdiff1d(there["part"][mask], seen) for mask, seen in zip(near, home)]


def _squares(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Squared distances, as a matrix product."""
    return np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", p, p)[None, :] - 2 * (x @ p.T)


def _centres(x: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """``k`` centres of a sample: k-means from evenly spaced different vectors."""
    different = np.unique(x, axis=0)
    centres = different[np.linspace(0, len(different) - 1, min(k, len(different))).astype(int)]
    for _ in range(rounds):
        own = _squares(x, centres).argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return np.unique(centres, axis=0)


def pivot_index(rows: DataFrame, pivots: int = MAX_PIVOTS) -> tuple[DataFrame, PivotIndex]:
    """(v, x, length, part) of every row of (v, x), and the index over the parts."""
    sample = [r[0] for r in rows.orderBy(F.xxhash64("v")).limit(PIVOT_SAMPLE).select("x").collect()]
    index = PivotIndex(sample, rows.count(), pivots)

    def assign(batches):
        for pdf in batches:
            lengths = pdf["x"].map(len).to_numpy()
            part, dist = np.full(len(pdf), -1), np.zeros(len(pdf))
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                if n:
                    part[at], dist[at] = index.nearest(np.stack(pdf["x"].to_numpy()[at]).astype(np.float64))
            yield pdf.assign(length=lengths, part=part, dist=dist)

    schema = T.StructType([*rows.schema.fields, T.StructField("length", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("dist", T.DoubleType())])
    dealt = rows.mapInPandas(assign, schema).checkpoint()
    stats = dealt.where("length > 0").groupBy("length", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("dist").alias("near"), F.max("dist").alias("far"))
    index.add_parts([r.asDict() for r in stats.collect()])  # a row per pivot
    return dealt, index


def _visits(asked: DataFrame, choose: Callable) -> DataFrame:
    """(q, qv, length, part) for every part that ``choose`` (vectors, rows) names."""

    def plan(batches):
        for pdf in batches:
            lengths = pdf["qv"].map(len).to_numpy()
            for n in np.unique(lengths[lengths > 0]):
                own = pdf[lengths == n]
                parts = choose(np.stack(own["qv"].to_numpy()).astype(np.float64), own)
                at = np.repeat(np.arange(len(own)), [len(p) for p in parts])
                yield pd.DataFrame({"q": own["q"].to_numpy()[at], "qv": own["qv"].to_numpy()[at], "length": n, "part": np.concatenate(parts) if len(at) else np.empty(0, int)})

    schema = T.StructType([asked.schema["q"], asked.schema["qv"], T.StructField("length", T.IntegerType()), T.StructField("part", T.IntegerType())])
    return asked.mapInPandas(plan, schema)


def _score_visits(dealt: DataFrame, index: PivotIndex, visits: DataFrame, k: int, queries_per_cell: int, rows_per_bucket: int) -> DataFrame | None:
    """Local top-k (q, v, d) of all visits: a part is as many buckets as its rows need, and blocks as its visits need."""
    spark = dealt.sparkSession
    counts = visits.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")).collect()  # at most a row per part
    if not counts:
        return None
    size = {(int(n), int(p)): int(r) for n, there in index.parts.items() for p, r in zip(there["part"], there["rows"])}
    cells = [(c["length"], c["part"], -(-size[c["length"], c["part"]] // rows_per_bucket), -(-c["n"] // queries_per_cell)) for c in counts]
    shape = F.broadcast(spark.createDataFrame(cells, "length int, part int, buckets int, blocks int"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def dealt_by(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    left = dealt.join(shape, ["length", "part"]).select("v", "x", "length", "part", dealt_by("v", "buckets").alias("bucket"), every("blocks").alias("block"))
    right = visits.join(shape, ["length", "part"]).select("q", "qv", "length", "part", dealt_by("q", "blocks").alias("block"), every("buckets").alias("bucket"))
    schema = T.StructType([visits.schema["q"], dealt.schema["v"], T.StructField("d", T.DoubleType())])

    def score(key, here: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if here.empty or there.empty:
            return pd.DataFrame({"q": [], "v": [], "d": []})
        x, q = np.stack(here["x"].to_numpy()).astype(np.float64), np.stack(there["qv"].to_numpy()).astype(np.float64)
        r, c, d = _local_top_k(x, q, k)
        return pd.DataFrame({"q": there["q"].to_numpy()[c], "v": here["v"].to_numpy()[r], "d": d})

    keys = ["length", "part", "bucket", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, schema)


def knn(queries: DataFrame, corpus: DataFrame, k: int = 5, qid: str = "query_id", qvec: str = "query_vec",
        vid: str = "vec_id", vec: str = "embedding", payload: list[str] | None = None,
        queries_per_cell: int = QUERIES_PER_CELL, rows_per_bucket: int = ROWS_PER_BUCKET, pivots: int = MAX_PIVOTS) -> DataFrame:
    """Exact L2 k-nearest neighbours of every query vector in the corpus.

    Returns (qid, rank, vid, payload…, distance) with rank 1..k by ascending
    squared distance (ties broken by ``vid``); fewer than k rows when the
    corpus is smaller.  A query meets the vectors of its own length; null vectors on
    either side take no part.

    Every vector is dealt to its nearest pivot.  A query first meets the parts of the
    nearest pivots that hold k vectors, which gives its k-th distance so far; after that
    only the parts that the triangle inequality does not rule out.  Parts that no query
    visits are not shuffled, and cells follow the number of rows and of visits.
    """
    payload = [c for c in (payload or []) if c not in (vid, vec)]
    asked = queries.select(F.col(qid).alias("q"), F.col(qvec).alias("qv")).where(F.col("qv").isNotNull()).checkpoint()
    rows = corpus.select(F.col(vid).alias("v"), F.col(vec).alias("x")).where(F.col("x").isNotNull()).checkpoint()
    dealt, index = pivot_index(rows, pivots)

    best = Window.partitionBy("q").orderBy(F.round("d", TIE_DIGITS), "v")
    near = _score_visits(dealt, index, _visits(asked, lambda q, own: index.home(q, k)), k, queries_per_cell, rows_per_bucket)
    if near is None:
        hits = asked.join(rows, F.lit(False)).select("q", F.lit(1).alias("rank"), "v", F.lit(0.0).alias("d"))
    else:
        near = near.checkpoint()
        first = near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        kth = first.groupBy("q").agg(F.max("d").alias("kth"), F.count(F.lit(1)).alias("found")).where(F.col("found") >= k).select("q", "kth")
        bounded = asked.join(kth, "q")  # who found fewer than k has met every part
        far = _score_visits(dealt, index, _visits(bounded, lambda q, own: index.beyond(q, own["kth"].to_numpy(), k)), k, queries_per_cell, rows_per_bucket)
        local = near if far is None else near.unionByName(far)
        hits = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    hits = hits.select(F.col("q").alias(qid), "rank", F.col("v").alias(vid), F.round("d", 6).alias("distance"))
    if payload:
        hits = hits.join(corpus.select(vid, *payload), vid, "left")
    return hits.select(qid, "rank", vid, *payload, "distance")


QUERY_BLOCK = 256


def _local_top_k(x: np.ndarray, q: np.ndarray, k: int, slack: float = 2 * 10.0**-TIE_DIGITS):
    """Exact per-query top-k (plus exact ties) of squared L2 distance within one batch.

    Candidates are preselected with the matrix form ``|x|^2 + |q|^2 - 2 x.q``
    (BLAS), widened by a bound on its rounding error, so they contain every row
    whose exact distance is within the k-th smallest.  Exact distances
    ``sum((x - q)^2)`` are then computed for the candidates only and the rule
    "distance <= k-th smallest (plus ``slack``)" is applied to them.  Returns (row, query, distance).
    """
    n, dim = x.shape
    xx = np.einsum("ij,ij->i", x, x)
    out_r, out_q, out_d = [], [], []
    for s in range(0, len(q), QUERY_BLOCK):
        qb = q[s:s + QUERY_BLOCK]
        qq = np.einsum("ij,ij->i", qb, qb)
        if n > k:
            approx = xx[:, None] + qq[None, :] - 2.0 * (x @ qb.T)
            kth = np.partition(approx, k - 1, axis=0)[k - 1]
            # |approx - exact| <= dim * eps * (|x|^2 + |q|^2) per entry, twice for the k-th
            tol = slack + 4.0 * (dim + 2) * np.finfo(np.float64).eps * (xx.max() + qq)
            r, c = np.nonzero(approx <= (kth + tol)[None, :])
        else:
            r, c = np.divmod(np.arange(n * len(qb)), len(qb))
        d = np.einsum("ij,ij->i", x[r] - qb[c], x[r] - qb[c])
        order = np.lexsort((d, c))
        r, c, d = r[order], c[order], d[order]
        counts = np.bincount(c, minlength=len(qb))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        kth_exact = d[np.maximum(starts + np.minimum(counts, k) - 1, 0)]
        keep = d <= kth_exact[c] + slack
        out_r.append(r[keep])
        out_q.append(c[keep] + s)
        out_d.append(d[keep])
    return np.concatenate(out_r), np.concatenate(out_q), np.concatenate(out_d)


def centroids(df: DataFrame, key: str, vec: str = "embedding", out: str = "query_vec", digits: int = 6) -> DataFrame:
    """Element-wise mean vector per key (rounded), e.g. one query vector per label."""
    e = df.select(key, F.posexplode(vec).alias("pos", "x"))
    means = e.groupBy(key, "pos").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("m"))
    return means.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias(out)
    )


# -------------------------------------------------------------------- T3 ----
CONTEXT_FIELDS = ["dealer", "model", "technology", "score_raw"]


def build_context(hits: DataFrame, payload: DataFrame, qid: str = "query_id", vid: str = "vec_id",
                  pid: str = "id", fields=CONTEXT_FIELDS, comment: str = "comment") -> DataFrame:
    """Per query: ``- (dealer, model, technology, score) comment`` lines in rank order, newline-joined."""
    p = payload.select(F.col(pid).alias(vid), *fields, comment)
    shown = [F.coalesce(F.col(f).cast("string"), F.lit(MISSING)) for f in fields]
    line = F.concat(F.lit("- ("), F.concat_ws(", ", *shown), F.lit(") "),
                    F.coalesce(F.col(comment), F.lit(MISSING)))
    rows = hits.join(p, vid, "left").select(qid, "rank", line.alias("line"))
    return rows.groupBy(qid).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda s: s["line"]),
                     "\n").alias("context"),
        F.count(F.lit(1)).alias("n_hits"),
    )


# -------------------------------------------------------------------- T4 ----
TURN_BLOCK = 1024


def _positions(conv: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """0-based position of each message by turn, counted per block of turn numbers, so one long conversation is many tasks' work."""
    blocked = conv.select(conv_id, turn, role, text, F.floor(F.col(turn) / TURN_BLOCK).alias("_b"))
    inside = Window.partitionBy(conv_id, "_b").orderBy(turn, role, text)
    before = Window.partitionBy("_c").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocked.groupBy(F.col(conv_id).alias("_c"), F.col("_b").alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    numbered = blocked.withColumn("_in", F.row_number().over(inside) - 1)
    same = F.col(conv_id).eqNullSafe(F.col("_c")) & F.col("_b").eqNullSafe(F.col("_k"))
    return numbered.join(sizes, same, "left").select(conv_id, turn, role, text, (F.col("_before") + F.col("_in")).cast("bigint").alias("_t"))


def history_window(conv: DataFrame, n: int = 4, conv_id: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text", at_role: str = "user") -> DataFrame:
    """At each ``at_role`` message: the last ``n`` messages including it, only when at least
    ``n`` exist (else empty).  ``turn`` orders the messages; its numbers may have gaps."""
    copies = _positions(conv, conv_id, turn, role, text).select(
        conv_id, turn, role, text, "_t", F.explode(F.sequence(F.col("_t"), F.col("_t") + (n - 1))).alias("_target"),
    )
    msg = F.struct(F.col("_t").alias("t"), F.col(role).alias("role"), F.col(text).alias("text"))
    own = F.col("_t") == F.col("_target")
    grouped = copies.groupBy(conv_id, "_target").agg(
        F.array_sort(F.collect_list(msg)).alias("_msgs"),
        F.max(F.when(own, F.col(role))).alias("_role"),
        F.max(F.when(own, F.col(turn))).alias("_turn"),
        F.max(own.cast("int")).alias("_exists"),
    )
    full = F.size("_msgs") >= n
    joined = F.array_join(F.transform("_msgs", lambda m: F.concat(m["role"], F.lit(": "), F.coalesce(m["text"], F.lit("")))), "\n")
    return grouped.where((F.col("_exists") == 1) & (F.col("_role") == at_role)).select(
        conv_id,
        F.col("_turn").alias(turn),
        F.when(full, F.lit(n)).otherwise(F.lit(0)).alias("n_history"),
        F.when(full, joined).otherwise(F.lit("")).alias("history"),
    )


# -------------------------------------------------------------------- T5 ----
TOKEN_PATTERN = r"[^\p{L}\p{N}_]+"


def words(c) -> Column:
    """Lower-cased words of a text (null: none)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), TOKEN_PATTERN), lambda t: t != "")


def bucket(word: Column, buckets: int) -> Column:
    """Bucket number of a word: the first 8 hex digits of its md5, modulo ``buckets``."""
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


#: Bytes of text in a piece whose words one task counts (about).
PIECE_BYTES = 16 << 20


def text_pieces(text: str) -> Column:
    """Into how many pieces texts are dealt to be counted, as an aggregate."""
    return (F.floor(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)) / PIECE_BYTES) + 1).cast("int")


#: Different words whose bucket a task remembers.
_KNOWN_WORDS = 100_000


def tfidf_vectors(df: DataFrame, text: str = "comment", id_col: str = "id", num_features: int = 1 << 18,
                  out: str = "features") -> DataFrame:
    """Sparse TF-IDF vectors: (id, array of (index, value)), by index.

    Words fall into ``num_features`` buckets; value = count x ln((rows + 1) / (rows with
    the bucket + 1)).  Words are counted where they are read, in batches of bounded size;
    the document frequencies have at most ``num_features`` rows.  A row without words has no entry.
    """
    spark = df.sparkSession
    bound_batches(spark)
    row_type = T.StructType([T.StructField("index", T.IntegerType()), T.StructField("n", T.LongType())])
    counted = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("entries", T.ArrayType(row_type))])

    def count(batches):
        known: dict[str, int] = {}
        for rows in batches:
            lens, ids = _word_buckets(rows.column(1), num_features, known)
            cell, n = np.unique(np.repeat(np.arange(len(lens), dtype=np.int64), lens) * num_features + ids, return_counts=True)
            pairs = pa.StructArray.from_arrays([pa.array(cell % num_features, pa.int32()), pa.array(n, pa.int64())], names=["index", "n"])
            yield pa.RecordBatch.from_arrays([rows.column(0), _lists(np.bincount(cell // num_features, minlength=len(lens)), pairs)], names=[id_col, "entries"])

    def kept(rows: DataFrame) -> DataFrame:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tfidf-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    vectors = kept(df.select(id_col, words(text).alias("_words")).mapInArrow(count, counted))  # used for the frequencies and for the weights
    n_rows = vectors.count()
    repeated = vectors.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    if repeated.isEmpty():
        vectors = vectors.withColumn("copies", F.lit(1).cast("bigint"))
    else:  # rows of one id have one vector
        repeated = kept(repeated)
        same = F.col(id_col).eqNullSafe(F.col("_id"))
        once = vectors.join(repeated, same, "left_anti").withColumn("copies", F.lit(1).cast("bigint"))
        entries = vectors.join(repeated, same, "left_semi").select(id_col, F.inline("entries")).groupBy(id_col, "index").agg(F.sum("n").alias("n"))
        together = entries.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("index", "n"))).alias("entries"))
        again = repeated.join(together, same, "left").select(F.col("_id").alias(id_col), F.coalesce("entries", F.array().cast(counted["entries"].dataType)).alias("entries"), "copies")
        vectors = kept(once.unionByName(again))
    found = vectors.select(F.explode("entries.index").alias("index")).groupBy("index").agg(F.log((F.lit(n_rows) + 1) / (F.count(F.lit(1)) + 1)).alias("idf"))
    idf = np.zeros(num_features)
    for r in found.collect():  # at most num_features rows
        idf[r["index"]] = r["idf"]

    def weigh(batches):
        for rows in batches:
            entries = rows.column(1)
            flat = entries.flatten()
            index = flat.field(0).to_numpy(zero_copy_only=False)
            value = flat.field(1).to_numpy(zero_copy_only=False) * idf[index]
            pairs = pa.StructArray.from_arrays([pa.array(index, pa.int32()), pa.array(value, pa.float64())], names=["index", "value"])
            yield pa.RecordBatch.from_arrays([rows.column(0), _lists(pc.list_value_length(entries).to_numpy(zero_copy_only=False), pairs)], names=[id_col, out])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out, T.ArrayType(T.StructType([T.StructField("index", T.IntegerType()), T.StructField("value", T.DoubleType())])))])
    # a row for each row of an id; rows without an id have no entry
    own = F.when(F.col(id_col).isNotNull(), F.col("entries")).otherwise(F.array().cast(vectors.schema["entries"].dataType))
    rows = vectors.select(id_col, own.alias("entries"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(id_col, "entries")
    return rows.mapInArrow(weigh, schema)


def _word_buckets(lists: pa.ListArray, buckets: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """How many words each row has, and the ``bucket`` of each; ``known`` are a task's words so far."""
    if len(known) > _KNOWN_WORDS:
        known.clear()
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().dictionary_encode()
    different = flat.dictionary.to_pylist()
    for w in different:
        if w not in known:
            known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % buckets
    ids = np.fromiter(map(known.__getitem__, different), np.int64, len(different))
    return lens, ids[flat.indices.to_numpy(zero_copy_only=False)]


def _lists(lens: np.ndarray, values: pa.Array) -> pa.ListArray:
    """Lists of so many values each."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), values)


def hashed_embeddings(df: DataFrame, text: str = "comment", id_col: str = "id", dim: int = 64,
                      out: str = "embedding") -> DataFrame:
    """Offline default embedder: L2-normalised hashed token counts (float32[dim]).

    Words come from the JVM in batches of bounded size and stay in Arrow: numpy counts and
    normalises them by their place among a batch's different words.  A task hashes each
    different word once (``bucket``: the first 8 hex digits of its md5).
    """
    bound_batches(df.sparkSession)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType),
                           T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        known: dict[str, int] = {}
        for rows in batches:
            lens, ids = _word_buckets(rows.column(1), dim, known)
            cell = np.repeat(np.arange(len(lens), dtype=np.int64), lens) * dim + ids
            counts = np.bincount(cell, minlength=len(lens) * dim).reshape(len(lens), dim).astype(np.float64)
            norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
            vecs = (counts / np.where(norms > 0, norms, 1.0)[:, None]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([rows.column(0), _lists(np.full(len(lens), dim), pa.array(vecs.ravel()))], names=[id_col, out])

    return df.select(id_col, words(text).alias("_words")).mapInArrow(run, schema)


def embed_texts(df: DataFrame, embed_fn: Callable[[list[str]], np.ndarray], text: str = "comment",
                id_col: str = "id", batch_size: int = 100, out: str = "embedding") -> DataFrame:
    """Apply an embedding function to texts in fixed-size batches inside each task (Arrow batches)."""
    schema = T.StructType([
        T.StructField(id_col, df.schema[id_col].dataType),
        T.StructField(out, T.ArrayType(T.FloatType())),
    ])

    def run(batches):
        for pdf in batches:
            texts = pdf[text].tolist()
            vecs = []
            for s in range(0, len(texts), batch_size):
                vecs.extend(np.asarray(embed_fn(texts[s:s + batch_size]), dtype=np.float32))
            yield pd.DataFrame({id_col: pdf[id_col], out: [v.tolist() for v in vecs]})

    return df.select(id_col, text).mapInPandas(run, schema)


# -------------------------------------------------------------------- T6 ----
def _csv_field(c: Column) -> Column:
    s = F.coalesce(c.cast("string"), F.lit(""))
    needs = s.rlike('[,"\\n\\r]')
    return F.when(needs, F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def corpus_size(df: DataFrame, cols: list[str], group: str = "service") -> DataFrame:
    """Size of the table serialised as CSV rows, per group: rows, characters, words."""
    line = F.concat_ws(",", *[_csv_field(F.col(c)) for c in cols])
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.length(line) + 1).alias("n_chars"),
        F.sum(word_count(line)).alias("n_words"),
    )
