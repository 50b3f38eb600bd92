"""SimHash near-duplicates: exact links within a few bits, found through vantage-point trees.

1. A text's fingerprint has a bit set where over half of its shingle hashes (XXH64,
   seed 42) have it.  Copies share a fingerprint, so only different fingerprints
   go on, each with its smallest doc_id.
2. A vantage-point tree over a bounded sample cuts the Hamming space into shards:
   a node holds a vantage point and a radius; points within the radius go inside.
   Every fingerprint has one home shard and visits each later shard whose region is
   within ``max_bits`` of it by the triangle inequality.  The earlier of two homes
   visits the later, so each pair of shards is looked at from one side.
3. A task builds the vantage-point tree of its shard, prunes by the same bounds and
   compares what is left, which finds every pair.  It sends on one edge per linked
   fingerprint (to the root of its local group), never the pairs.
4. Large-star and small-star rounds join the local groups; each round is written to
   the shared folder.

Work in a dense group is bounded: fingerprints are distinct, and only 2080 others lie
within two bits of one, however many documents share them.

Defined results: null and empty texts have fingerprint zero and are linked like any
other.  Rows without a doc_id take part, but never name a component unless nothing
in it has an id (then the component is null).  Repeated rows get equal results.
Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from feedloom.llm.common import materialize, packed

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Fingerprints per shard aimed at, and the sample that shapes the shards.
SHARD_SIZE = 4_096
SAMPLE_SIZE = 8_192
_LEAF = 64


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """A text's fingerprint as an unsigned integer."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z alone are lowered, [\x20\x09-\x0D] alone split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle_words + 1)
    digest = xxhash.xxh64_intdigest
    lasts = ends[min(shingle_words, len(words)) - 1 :]
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), lasts.tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65_536):
        bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, *more: str) -> DataFrame:
    """(doc_id, more..., fp) with the fingerprint's 64 bits as a signed long."""

    @F.pandas_udf(LongType())
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        for s in texts:
            yield pd.Series(np.array([fingerprint(t, shingle_words) for t in s], dtype=np.uint64).view(np.int64))

    return docs.select("doc_id", *more, fp("text").alias("fp"))


@dataclass
class Node:
    """Inner node (vantage point, radius, children) or a shard (leaf number)."""

    vantage: int = 0
    radius: int = 0
    inside: Node | None = None
    outside: Node | None = None
    leaf: int = -1


def _distances(points, vantage):
    import numpy as np

    return np.bitwise_count(points ^ np.uint64(vantage)).astype(np.int16)


def _split(points) -> tuple[int, int] | None:
    """A vantage point among ``points`` and the radius that halves them best; None if none separates them."""
    import numpy as np

    best = None
    for at in (0, len(points) // 3, len(points) - 1):
        d = _distances(points, points[at])
        counts = np.cumsum(np.bincount(d, minlength=65))
        radius = int(np.abs(counts[:-1] - len(points) / 2).argmin())
        small = min(counts[radius], len(points) - counts[radius])
        if small and (best is None or small > best[0]):
            best = (small, int(points[at]), radius)
    return best and best[1:]


def shard_tree(sample, shards: int) -> tuple[Node, int]:
    """The tree that deals fingerprints to about ``shards`` shards; also how many there are."""
    import numpy as np

    numbered = iter(range(1 << 30))

    def build(points, parts: int) -> Node:
        cut = _split(points) if parts > 1 and len(points) > 1 else None
        if cut is None:
            return Node(leaf=next(numbered))
        near = _distances(points, cut[0]) <= cut[1]
        return Node(*cut, build(points[near], (parts + 1) // 2), build(points[~near], parts // 2))

    tree = build(np.unique(sample), shards)
    return tree, next(numbered)


def route(tree: Node, points, max_bits: int):
    """Home shard of each point, and (point index, shard) of every later shard in reach."""
    import numpy as np

    home = np.empty(len(points), np.int64)
    visits: list[tuple] = []

    def down(node: Node, idx, at_home) -> None:
        if not len(idx):
            return
        if node.inside is None:
            home[idx[at_home]] = node.leaf
            visits.append((idx[~at_home], np.full(int((~at_home).sum()), node.leaf)))
            return
        d = _distances(points[idx], node.vantage)
        own = d <= node.radius
        a, b = d <= node.radius + max_bits, d > node.radius - max_bits
        down(node.inside, idx[a], (at_home & own)[a])
        down(node.outside, idx[b], (at_home & ~own)[b])

    down(tree, np.arange(len(points)), np.ones(len(points), bool))
    who, where = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*visits) if visits else ([], [])))
    later = where > home[who]
    return home, who[later], where[later]


def close_pairs(points, queries, max_bits: int, same: bool) -> Iterator[tuple]:
    """Index arrays (query, point) within ``max_bits``; ``same``: the queries are the points, each pair once."""
    import numpy as np

    stack = [(np.arange(len(points)), np.arange(len(queries)))]
    while stack:
        p, q = stack.pop()
        if not len(p) or not len(q):
            continue
        cut = _split(points[p]) if len(p) > _LEAF else None
        if cut is None:
            rows = max(1, 1_000_000 // len(p))
            for at in range(0, len(q), rows):
                part = q[at : at + rows]
                i, j = np.nonzero(np.bitwise_count(queries[part][:, None] ^ points[p][None, :]) <= max_bits)
                i, j = part[i], p[j]
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield i, j
            continue
        d, dq = _distances(points[p], cut[0]), _distances(queries[q], cut[0])
        stack.append((p[d <= cut[1]], q[dq <= cut[1] + max_bits]))
        stack.append((p[d > cut[1]], q[dq > cut[1] - max_bits]))


def _merge(labels, a, b) -> None:
    """Give joined entries the smallest label among them, in place."""
    import numpy as np

    while True:
        la, lb = labels[a], labels[b]
        low = np.minimum(la, lb)
        if (la == lb).all():
            return
        np.minimum.at(labels, la, low)
        np.minimum.at(labels, lb, low)
        while (labels != labels[labels]).any():
            labels[:] = labels[labels]


def _shard_edges(shard: pd.DataFrame, max_bits: int) -> pd.DataFrame:
    """One edge to the local root for each linked fingerprint of a shard."""
    import numpy as np

    fps = shard["fp"].to_numpy().view(np.uint64)
    own = shard["home"].to_numpy()
    order = np.argsort(~own, kind="stable")
    fps, n = fps[order], int(own.sum())
    labels = np.arange(len(fps))
    for i, j in close_pairs(fps[:n], fps[:n], max_bits, True):
        _merge(labels, i, j)
    for i, j in close_pairs(fps[:n], fps[n:], max_bits, False):
        _merge(labels, i + n, j)
    linked = labels != np.arange(len(fps))
    signed = fps.view(np.int64)
    return pd.DataFrame({"a": signed[linked], "b": signed[labels[linked]]})


def shard_edges(different: DataFrame, max_bits: int = MAX_BITS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(a, b) edges that span every local group; ``different`` has one row per fingerprint."""
    import numpy as np

    count = different.count()
    # the smallest hashes are a fair sample of bounded size
    rows = different.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_SIZE).collect()
    shards = 1 << max(0, (-(-count // shard_size) - 1).bit_length())  # a power of two: halves stay even
    tree, _ = shard_tree(np.array([r.fp for r in rows], dtype=np.int64).view(np.uint64), shards)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy()
            home, who, where = route(tree, fp.view(np.uint64), max_bits)
            yield pd.DataFrame({"shard": np.r_[home, where], "fp": np.r_[fp, fp[who]], "home": np.r_[np.ones(len(fp), bool), np.zeros(len(who), bool)]})

    dealt = different.select("fp").mapInPandas(deal, "shard bigint, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInPandas(lambda g: _shard_edges(g, max_bits), "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component.

    Alternates large-star and small-star until a round changes nothing.  Sums and
    minima are combined before each shuffle; joins on a hub are plain equi-joins,
    which adaptive execution splits.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.where("a <> b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _rooted(fps: DataFrame, max_bits: int, shard_size: int) -> DataFrame:
    """(fp, first_doc, root) per different fingerprint; ``root`` names its component."""
    different = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct-fingerprints")
    linked = components(shard_edges(different, max_bits, shard_size))
    rooted = different.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return materialize(rooted, "rooted-fingerprints")


def simhash_components(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(doc_id, fp, component_id) per row of ``docs``; component_id is the smallest doc_id reachable."""
    fps = materialize(fingerprints(docs, shingle_words), "fingerprints")
    rooted = _rooted(fps, max_bits, shard_size)
    roots = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    return fps.join(rooted.join(roots, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _text_key(text) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component stays: that of its smallest doc_id (of its texts there, the one with the least hash).

    A doc_id that occurs with texts of several components is looked at text by text.
    Rows without a doc_id stay: nothing tells them apart.
    """
    texts = docs.select("doc_id", "text")
    fps = materialize(fingerprints(texts.withColumn("text_key", _text_key(F.col("text"))), shingle_words, "text_key"), "fingerprints")
    members = fps.where("doc_id IS NOT NULL").join(_rooted(fps.select("doc_id", "fp"), max_bits, SHARD_SIZE).select("fp", "root"), "fp")
    keepers = members.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("k")).select(F.col("k.doc_id").alias("keeper"), F.col("k.text_key").alias("keeper_text"))
    rows = packed(docs)
    own = _text_key(F.col("row.text"))
    kept = rows.join(keepers, (F.col("row.doc_id") == F.col("keeper")) & (own == F.col("keeper_text")), "left_semi")
    one = Window.partitionBy("row.doc_id", own).orderBy(F.xxhash64("row"))
    kept = kept.withColumn("place", F.row_number().over(one)).where("place = 1")
    return kept.select("row").unionByName(rows.where("row.doc_id IS NULL")).select("row.*")


def op9_simhash(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint in hex, component_id."""
    found = simhash_components(documents.select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
