"""Exact top-k by inner product in three phases with a uniform threshold.

A score is the sum of partial scores over ``LISTS`` blocks of columns, each block a
list of its own.

1. Local lists: each list's k highest partial scores per query are gathered, with the
   list's lowest one and the told entries' totals (rows have all their columns at
   hand).  The k-th of these totals is one that k candidates reach.
2. Safe cutoff: a total that high needs at least one list where the partial score,
   less that list's lowest, reaches an equal share.  These cutoffs go out with the
   queries, and every list collects all its entries from them upwards.
3. What was collected by any list is resolved to exact scores; the k best remain.

Rows and queries meet in cells of bounded size (a bucket of rows, a block of queries),
so neither side is collected or broadcast and no task grows with the input.  The query
set is given, so every row meets every block of queries once a phase.

Components become floor(scale * x) with x as double; scores are exact integers: by
doubles or long arithmetic where these hold every product, else by unbounded integers.
A component or a score that does not fit a long is an error by name.  Defined results:
see ``vectors.usable``; zero vectors take part, and a vector meets those of its own
length.  A query is never its own candidate.  Fewer than k candidates: all.  No vectors
or no queries: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import materialize
from feedloom.llm.vectors import best_of_row, ranked, usable

SCALE = 1024
#: Blocks of columns; the fewer, the higher each share of the cutoff, and the fewer entries are collected.
LISTS = 2
ROWS_PER_BUCKET = 8_192
QUERIES_PER_BLOCK = 2_048
_STRIP = 128  # queries of a cell scored at once


def _matrix(column: pd.Series):
    import numpy as np

    return np.array(column.tolist(), dtype=np.int64)


def _partials(queries, rows, own):
    """Partial scores (lists, queries, rows), exact; ``own`` marks a query's own row, whose scores do not count."""
    import numpy as np

    blocks = np.array_split(np.arange(rows.shape[1]), min(LISTS, rows.shape[1]))
    bound = float(np.abs(queries).max()) * float(np.abs(rows).max()) * rows.shape[1]
    if bound < 1 << 52:
        q, r = queries.astype(np.float64), rows.astype(np.float64)
        return np.stack([q[:, b] @ r[:, b].T for b in blocks]).astype(np.int64)
    if bound < 1 << 62:
        return np.stack([queries[:, b] @ rows[:, b].T for b in blocks])
    q, r = queries.astype(object), rows.astype(object)
    parts = np.stack([q[:, b] @ r[:, b].T for b in blocks])
    parts[:, own] = 0
    for x in (*parts, parts.sum(axis=0)):
        if max(x.max(), -x.min()) >= 1 << 63:
            raise OverflowError("a score does not fit a long integer")
    return parts.astype(np.int64)


def _local_lists(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phase 1 in a cell: each list's k highest entries with their totals, and the list's lowest."""
    out = []
    columns = ["query_id", "list", "vec_id", "total", "lowest"]
    if rows.empty or queries.empty:
        return pd.DataFrame(out, columns=columns)
    rows = rows.sort_values("vec_id")
    ids, qids = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    r, q = _matrix(rows["v"]), _matrix(queries["qv"])
    for at in range(0, len(q), _STRIP):
        parts = _partials(q[at : at + _STRIP], r, qids[at : at + _STRIP][:, None] == ids[None, :])
        for i, qid in enumerate(qids[at : at + _STRIP]):
            others = ids != qid
            if not others.any():
                continue
            p, there = parts[:, i, others], ids[others]
            totals = p.sum(axis=0)
            for b in range(len(parts)):
                lowest = p[b].min()
                out.extend((qid, b, there[j], totals[j], lowest) for j in best_of_row(p[b], k))
    return pd.DataFrame(out, columns=columns)


def _resolve(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """Phases 2 and 3 in a cell: entries from the cutoffs upwards, resolved; the cell's k best."""
    import numpy as np

    out = []
    columns = ["query_id", "vec_id", "score", "collected"]
    if rows.empty or queries.empty:
        return pd.DataFrame(out, columns=columns)
    rows = rows.sort_values("vec_id")
    ids, qids = rows["vec_id"].to_numpy(), queries["query_id"].to_numpy()
    r, q, cuts = _matrix(rows["v"]), _matrix(queries["qv"]), _matrix(queries["cuts"])
    for at in range(0, len(q), _STRIP):
        own = qids[at : at + _STRIP][:, None] == ids[None, :]
        parts = _partials(q[at : at + _STRIP], r, own)
        collected = (parts >= cuts[at : at + _STRIP].T[:, :, None]).any(axis=0) & ~own
        for i, qid in enumerate(qids[at : at + _STRIP]):
            found = np.flatnonzero(collected[i])
            scores = parts[:, i, found].sum(axis=0)
            for j in best_of_row(scores, k):
                out.append((qid, ids[found[j]], scores[j], len(found)))
    return pd.DataFrame(out, columns=columns)


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score, collected) of every query's k highest scores.

    ``collected`` is how many of its cell's rows the cutoff let through for the query.
    """
    scaled = lambda x: x.cast("double") * scale
    too_large = F.exists("embedding", lambda x: F.abs(scaled(x)) >= float(1 << 63))
    whole = F.when(too_large, F.raise_error(F.lit("a component does not fit a long integer")).cast("array<bigint>")).otherwise(F.transform("embedding", lambda x: F.floor(scaled(x)).cast("bigint")))
    rows = usable(vectors, allow_zero=True, one_length=False).select("vec_id", whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialize(rows.withColumn("size", F.size("v")), "whole-vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("q")).first()
    buckets, blocks = max(1, -(-n // ROWS_PER_BUCKET)), max(1, -(-n_queries // QUERIES_PER_BLOCK))

    def cell(name: str, parts: int) -> Column:
        return F.pmod(F.xxhash64("vec_id", F.lit(name)), F.lit(parts)).cast("int")

    def everywhere(parts: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    keys = ["dims", "bucket", "block"]
    left = rows.select("vec_id", "v", F.col("size").alias("dims"), cell("row", buckets).alias("bucket"), everywhere(blocks).alias("block")).groupBy(*keys)
    asked = rows.where("q").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), F.col("size").alias("dims"), cell("query", blocks).alias("block"))

    def cells(queries: DataFrame):
        return left.cogroup(queries.select("*", everywhere(buckets).alias("bucket")).groupBy(*keys))

    # phase 1
    lists = cells(asked).applyInPandas(lambda key, r, q: _local_lists(key, r, q, k), "query_id bigint, list int, vec_id bigint, total bigint, lowest bigint")
    lists = materialize(lists, "local-lists")
    lowest = lists.groupBy("query_id", "list").agg(F.min("lowest").alias("lowest"))
    per_query = lowest.groupBy("query_id").agg(F.sum("lowest").alias("floor"), F.sort_array(F.collect_list(F.struct("list", "lowest"))).alias("lowests"))
    told = ranked(lists.select("query_id", "vec_id", "total").distinct(), k, F.desc("total"))
    reached = told.groupBy("query_id").agg(F.min("total").alias("total"), F.count("*").alias("told"))
    # fewer than k were told only if there are no more: then everything is collected
    share = F.when(F.col("told") < k, 0).otherwise(F.ceil((F.col("total") - F.col("floor")) / F.size("lowests")))
    shared = per_query.join(reached, "query_id").withColumn("share", share.cast("bigint"))
    cuts = shared.select("query_id", F.expr("transform(lowests, x -> x.lowest + share)").alias("cuts"))
    # phases 2 and 3
    best = cells(asked.join(cuts, "query_id")).applyInPandas(lambda key, r, q: _resolve(key, r, q, k), "query_id bigint, vec_id bigint, score bigint, collected bigint")
    return ranked(best, k, F.desc("score")).select("query_id", "rank", "vec_id", "score", "collected")


def op8_top_k(embeddings: DataFrame) -> DataFrame:
    """The 10 highest integer inner products of every vector whose vec_id is divisible by 100."""
    return top_k(embeddings, F.col("vec_id") % 100 == 0, 10).select("query_id", "rank", "vec_id", "score")


OP8_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM best WHERE rank <= 10
"""
