"""Approximate nearest neighbours by inner product: adaptive dimension scan of probed lists.

Index.  Largest inner product is made smallest distance by one more dimension,
``sqrt(M**2 - |x|**2)`` with M the largest norm (queries have 0 there).  Vectors are
rotated by a random orthogonal matrix, so every prefix of dimensions is a fair sample
of a distance.  Centroids are learned from a bounded sample (``SAMPLE_ROWS``, by hash);
every vector is put into the list of its nearest centroid.  The number of lists
follows the root of the number of vectors.  How many lists a query must probe for
``TARGET_RECALL`` is measured on the sample (vectors without clusters need many).

Search.  A query probes its nearest lists.  A list's vectors lie in column
blocks; after each block a candidate whose partial distance is so large that it would,
by the hypothesis test, hardly end below the query's threshold is abandoned.  The
threshold is the k-th best exact distance among the list's vectors scanned so far: a list
is scanned some hundreds of rows at a time, and every such step tightens it.  Survivors
get their exact inner product in double precision on the original vectors.

Equal vectors are indexed once, with their k + 1 smallest vec_ids (no more can be among
the k nearest, ties going to the smaller id), so a vector that a third of the rows
share is one entry.  Long lists are split into slabs of bounded size, each a task's
group of its own; the k best of all slabs are the result.

Defined results: see ``vectors.usable`` (null, zero and non-finite vectors take no
part).  A query is never its own candidate.  Fewer than k candidates among the probed
lists: a query that found fewer than k searches all lists, so it gets all there are.
No vectors or no queries: no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import materialize
from feedloom.llm.vectors import ranked, usable

SAMPLE_ROWS = 16_384
#: One list for so many times the root of the number of different vectors: entries that
#: queries bring back then grow as rows to the power 1.5 at most.
ROOTS_PER_LIST = 8
#: Vectors per slab aimed at; queries per group.
SLAB_ROWS = 4_096
#: Share of the true neighbours that the probed lists are to hold.
TARGET_RECALL = 0.96
QUERIES_PER_BLOCK = 1_024
BLOCK_DIMS = 16
#: Strictness of the test: larger abandons later and loses fewer neighbours.
EPSILON = 1.5
_STRIP = 64  # queries of a cell scanned together
_STEP = 256  # rows scanned between two looks at the threshold
_SEED = 20_240_601
_MAX_LISTS = 4_096


@dataclass
class Index:
    """What tasks need to place vectors: bounded by the sample, whatever the table."""

    rotation: object  # (dims + 1, dims + 1)
    centroids: object  # (lists, dims + 1), rotated
    norm: float  # the largest norm
    probes: int = 1  # lists that a query needs, measured on the sample

    def lift(self, x, query: bool):
        """Rotated vectors with the additional dimension."""
        import numpy as np

        more = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.column_stack((x, more)) @ self.rotation

    def nearest(self, lifted, n: int):
        """The ``n`` nearest lists of each row, nearest first."""
        import numpy as np

        d = (self.centroids**2).sum(axis=1) - 2 * lifted @ self.centroids.T
        n = min(n, d.shape[1])
        some = np.argpartition(d, n - 1, axis=1)[:, :n]
        return np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)


def _matrix(column: pd.Series):
    import numpy as np

    return np.array(column.tolist(), dtype=np.float64)


def build_index(distinct: DataFrame, count: int, k: int, rounds: int = 8) -> Index:
    """Rotation and centroids from at most ``SAMPLE_ROWS`` vectors."""
    import numpy as np

    norm = distinct.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()[0] ** 0.5
    sample = _matrix(distinct.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE_ROWS).toPandas()["v"])
    rng = np.random.default_rng(_SEED)
    rotation = np.linalg.qr(rng.normal(size=(sample.shape[1] + 1,) * 2))[0]
    index = Index(rotation, None, norm)
    lifted = index.lift(sample, False)
    lists = max(1, min(_MAX_LISTS, math.ceil(count**0.5 / ROOTS_PER_LIST), len(sample) // 4))
    index.centroids = lifted[rng.choice(len(lifted), lists, replace=False)]
    for _ in range(rounds):
        own = index.nearest(lifted, 1)[:, 0]
        sums, sizes = np.zeros_like(index.centroids), np.bincount(own, minlength=lists)
        np.add.at(sums, own, lifted)
        index.centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], index.centroids)
    index.probes = enough_probes(index, sample, lifted, k)
    return index


def enough_probes(index: Index, sample, lifted, k: int) -> int:
    """How many lists hold ``TARGET_RECALL`` of the true neighbours of some of the sample's vectors.

    The sample is thinner than the table, so its neighbours lie farther and in more
    lists than the table's: the measure errs towards too many.
    """
    import numpy as np

    asked = np.linspace(0, len(sample) - 1, min(len(sample), 256), dtype=np.int64)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(index.centroids)
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    lists = len(index.centroids)
    order = index.nearest(index.lift(sample[asked], True), lists)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(lists)[None, :], 1)
    needed = np.take_along_axis(place, index.nearest(lifted, 1)[:, 0][best], 1)
    return int(np.quantile(needed, TARGET_RECALL, method="higher")) + 1


def scan(queries, raw_queries, lifted, raw, ids, own_ids, k: int, seen: dict | None = None):
    """Adaptive scan of one slab: (query row, vec_id, score) of each query's k best entries.

    ``ids`` are each entry's smallest vec_ids; ``own_ids`` the queries' vec_ids.  A block
    of columns is one matrix product for a strip of queries while many candidates are
    alive, and one pass over the pairs that are left when few are.  ``seen`` adds up how
    many pairs there were and how many reached the last block (``pairs``, ``whole``).
    """
    import numpy as np

    rows, dims = lifted.shape
    blocks = [slice(at, min(at + BLOCK_DIMS, dims)) for at in range(0, dims, BLOCK_DIMS)]
    columns = [np.ascontiguousarray(lifted[:, b]) for b in blocks]
    norms = [(c * c).sum(axis=1) for c in columns]
    near = min(k, rows - 1)  # one more than k: the query's own entry may be among them
    out = []
    for at in range(0, len(queries), _STRIP):
        q, rq = queries[at : at + _STRIP], raw_queries[at : at + _STRIP]
        parts = [q[:, b] for b in blocks]
        squares = [(x * x).sum(axis=1)[:, None] for x in parts]
        best = np.full((len(q), near + 1), np.inf)  # the smallest exact distances so far
        found = []
        for g in range(0, rows, _STEP):
            step = slice(g, min(g + _STEP, rows))
            limit = best.max(axis=1)
            distance, alive = np.zeros((len(q), step.stop - g)), np.ones((len(q), step.stop - g), bool)
            for x, xx, b, c, n in zip(parts, squares, blocks, columns, norms):
                if alive.mean() > 0.25:
                    distance += n[step] + xx - 2 * x @ c[step].T
                else:
                    i, j = np.nonzero(alive)
                    distance[i, j] += ((x[i] - c[step][j]) ** 2).sum(axis=1)
                if b.stop < dims:
                    # the distance seen so far, scaled up, against the limit with the test's slack
                    alive &= distance * (dims / b.stop) <= (limit * (1 + EPSILON / np.sqrt(b.stop)) ** 2)[:, None] + 1e-9
            if seen is not None:
                seen["pairs"] = seen.get("pairs", 0) + alive.size
                seen["whole"] = seen.get("whole", 0) + int(alive.sum())
            distance[~alive] = np.inf
            both = np.concatenate((best, distance), axis=1)
            best = np.partition(both, near, axis=1)[:, : near + 1]
            i, j = np.nonzero(distance <= (best.max(axis=1) * (1 + 1e-9))[:, None] + 1e-9)
            found.append((i, j + g, distance[i, j]))
        i, j, d = (np.concatenate(x) for x in zip(*found))
        last = d <= best.max(axis=1)[i] * (1 + 1e-9) + 1e-9  # ties included: the ranking decides by vec_id
        last &= np.isfinite(d)
        i, j = i[last], j[last]
        scores = (raw[j] * rq[i]).sum(axis=1)
        for a, e, score in zip(i.tolist(), j.tolist(), scores.tolist()):
            own = own_ids[at + a]
            out.extend((at + a, v, score) for v in ids[e].tolist() if v != own)
    return out


def _probe(key: tuple, slab: pd.DataFrame, queries: pd.DataFrame, index: Index, k: int) -> pd.DataFrame:
    """One slab of a list against one block of the queries that probe it."""
    columns = ["query_id", "vec_id", "score"]
    if slab.empty or queries.empty:
        return pd.DataFrame([], columns=columns)
    raw, raw_queries = _matrix(slab["v"]), _matrix(queries["qv"])
    own = queries["query_id"].tolist()
    found = scan(index.lift(raw_queries, True), raw_queries, index.lift(raw, False), raw, slab["ids"].tolist(), own, k)
    out = pd.DataFrame([(own[i], v, s) for i, v, s in found], columns=columns)
    # a slab answers with its k best
    return out.sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)


def nearest(vectors: DataFrame, is_query: Column, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for every query."""
    rows = usable(vectors, allow_zero=False).select("vec_id", F.col("embedding").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = materialize(rows, "usable-vectors")
    smallest = Window.partitionBy("v").orderBy("vec_id")
    # the rank filter is applied before the shuffle too, so a vector that many rows share stays small
    distinct = rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    distinct = materialize(distinct, "distinct-vectors")
    count = distinct.count()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not count:
        return vectors.sparkSession.createDataFrame([], schema)
    index = build_index(distinct, count, k)
    lists, probes = len(index.centroids), probes or index.probes

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.assign(list=index.nearest(index.lift(_matrix(batch["v"]), False), 1)[:, 0])

    def probe(n: int):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import numpy as np

            for batch in batches:
                if len(batch):
                    near = index.nearest(index.lift(_matrix(batch["qv"]), True), n)
                    yield batch.loc[batch.index.repeat(near.shape[1])].assign(list=np.ravel(near))

        return each

    placed = materialize(distinct.mapInPandas(place, "v array<float>, ids array<bigint>, list int"), "lists")
    # how many slabs each list has: one row per list
    slabs = placed.groupBy("list").agg(F.ceil(F.count("*") / SLAB_ROWS).cast("int").alias("slabs"))
    queries = rows.where("q").select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))

    def search(asked: DataFrame, n: int) -> DataFrame:
        probing = materialize(asked.mapInPandas(probe(n), "query_id bigint, qv array<float>, list int"), "probes")
        # a list's slabs, and the blocks that its own queries make up: one row per list
        asking = probing.groupBy("list").agg(F.ceil(F.count("*") / QUERIES_PER_BLOCK).cast("int").alias("blocks"))
        cells = F.broadcast(slabs.join(asking, "list").select(F.col("list").alias("l"), F.col("slabs").alias("s"), "blocks"))

        def every(parts: str) -> Column:
            return F.explode(F.sequence(F.lit(0), F.col(parts) - 1))

        def own(key: str, parts: str) -> Column:
            return F.pmod(F.xxhash64(key), F.col(parts)).cast("int")

        here = probing.join(cells, F.col("list") == F.col("l")).select("query_id", "qv", "list", own("query_id", "blocks").alias("block"), every("s").alias("slab"))
        there = placed.join(cells, F.col("list") == F.col("l")).select("v", "ids", "list", own("v", "s").alias("slab"), every("blocks").alias("block"))
        keys = ["list", "slab", "block"]
        met = there.groupBy(*keys).cogroup(here.groupBy(*keys))
        found = met.applyInPandas(lambda key, a, b: _probe(key, a, b, index, k), "query_id bigint, vec_id bigint, score double")
        return ranked(found, k, F.desc("score")).select("query_id", "rank", "vec_id", "score")

    first = materialize(search(queries, probes), "first-search")
    if probes >= lists:
        return first
    # a query that found fewer than k asks every list
    full = first.groupBy("query_id").count().where(F.col("count") >= k).select("query_id")
    short = materialize(queries.join(full, "query_id", "left_anti"), "short-queries")
    if short.isEmpty():
        return first
    return first.join(full, "query_id", "left_semi").unionByName(search(short, lists))


def op6_nearest(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest found of every vector whose vec_id is divisible by 20."""
    return nearest(embeddings, F.col("vec_id") % 20 == 0, 20)
