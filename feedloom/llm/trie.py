"""Prefix trie of conversations, its subtrees summed by the Euler-tour technique.

A node is a different sequence of first turns (role, text); the root has none.

1. Turns are numbered per conversation over a range-partitioned table: windows inside
   a block of the range, plus what earlier blocks hold of a conversation that a border
   cuts (two rows a block).  One conversation with a third of all turns is many blocks.
   Texts stay behind: a turn goes on as two 64-bit hashes and its length.
2. The key of a prefix is the XOR of 128-bit hashes of (position, turn), a running sum
   that splits over blocks in the same way.  Rows with one key are the node's members.
3. Children stand in the order of their smallest conversation; the next sibling comes
   from a range-partitioned table too, so the root may have any number of children.
4. Every node has an enter and an exit arc, each with its successor in the tour.  The
   tour is ranked in three steps: a task follows the arcs inside its block of nodes, so
   that only runs remain (one per link between blocks); runs are halved by coin flips,
   a quarter at a time, while there are more than ``LAST_RUNS``; the rest is ranked in
   one task of that bounded size.  The removed ones are put back in reverse order.
5. With places come sums of leaves and savings up to each arc.  What lies between a
   node's arcs is its subtree.

Every step is written to the shared folder, so a lost executor repeats one step.

Defined results: turns are ordered by turn, nulls first, then by the MD5 of role, line
break and text; repeated rows are repeated turns.  Null role or text is empty.  Rows
without a conv_id are left out.  An empty table has no nodes, not even a root.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.common import join_hot, materialize

#: Nodes of a block that one task follows at once (some 100 bytes each).
NODES_PER_BLOCK = 100_000
#: Runs that the last step ranks in one task (40 bytes each).
LAST_RUNS = 250_000
#: Ids joined to one text on the way to a digest.
CHUNK_IDS = 10_000
_BLOCK_BITS = 33  # of monotonically_increasing_id: the rest is the partition


class Trie(NamedTuple):
    """``nodes``: one row per node with its sums; ``ends``: (depth, k1, k2, conv_id) of the last node of every conversation."""

    nodes: DataFrame
    ends: DataFrame


def _blocks(df: DataFrame, *order: str) -> DataFrame:
    """``df`` range-partitioned by ``order`` and written, with the number of the range as ``block``."""
    return materialize(df.repartitionByRange(*order).withColumn("block", F.spark_partition_id()), "blocks")


def _cut_keys(blocks: DataFrame, key: str) -> DataFrame:
    """(block, key) where a border may cut the key: the first and the last of each block."""
    ends = blocks.groupBy("block").agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
    return ends.select("block", F.explode(F.array_distinct(F.array("lo", "hi"))).alias(key))


def _before(blocks: DataFrame, key: str, **sums: Column) -> DataFrame:
    """(block, key, sums) over the blocks before this one, for keys that borders cut; two rows a block at most."""
    local = blocks.join(F.broadcast(_cut_keys(blocks, key)), ["block", key]).groupBy("block", key).agg(*(c.alias(n) for n, c in sums.items()))
    earlier = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    combine = {n: F.sum(n) if n.startswith("n_") else F.bit_xor(n) for n in sums}
    return local.select("block", key, *(F.coalesce(c.over(earlier), F.lit(0)).alias(n) for n, c in combine.items()))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(block, conv_id, pos, c1, c2, chars): turns in order, from 1, with hashes and length instead of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.unhex(F.md5(F.concat(role, F.lit("\n"), text))).alias("tie"),
        F.monotonically_increasing_id().alias("row_no"),  # sets repeated rows apart, so that they too can be cut
        F.xxhash64(F.lit("a"), role, text).alias("c1"),
        F.xxhash64(F.lit("b"), role, text).alias("c2"),
        F.length(text).cast("bigint").alias("chars"),
    )
    blocks = _blocks(turns, "conv_id", "turn", "tie", "row_no")
    inside = Window.partitionBy("block", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "tie", "row_no")
    local = blocks.withColumn("local", F.row_number().over(inside))
    placed = local.join(F.broadcast(_before(blocks, "conv_id", n_before=F.count("*"))), ["block", "conv_id"], "left")
    pos = (F.col("local") + F.coalesce("n_before", F.lit(0))).cast("bigint")
    return materialize(placed.select("block", "conv_id", pos.alias("pos"), "c1", "c2", "chars"), "numbered-turns")


def _hashes(depth: Column, c1: Column, c2: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit("x"), depth, c1, c2), F.xxhash64(F.lit("y"), depth, c1, c2)


def prefix_rows(conversations: DataFrame, shared: Column, base: Column, most_shared: int) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, chars, last) for every prefix of every conversation, the empty one included.

    A conversation is the first ``shared`` (at most ``most_shared``) turns of
    conversation ``base``, as many as there are, then its own turns from number
    ``shared`` + 1 on; both are columns over conv_id.  ``p1``, ``p2`` are the parent's
    key; ``last`` marks the whole conversation.
    """
    turns = numbered_turns(conversations)
    total = turns.count()
    zero = F.lit(0).cast("bigint")
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("own"))

    # the nodes along the first turns of each base: at most most_shared a conversation
    g1, g2 = _hashes(F.col("pos"), F.col("c1"), F.col("c2"))
    first = turns.where(F.col("pos") <= most_shared).select("conv_id", F.struct("pos", g1.alias("g1"), g2.alias("g2"), "chars").alias("t"))
    heads = first.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def so_far(i: Column, field: str) -> Column:
        return F.aggregate(F.slice("ts", F.lit(1), i), zero, lambda acc, t: acc.bitwiseXOR(t[field]))

    def node(t: Column) -> Column:
        i = t["pos"].cast("int")
        k1, k2 = so_far(i, "g1"), so_far(i, "g2")
        return F.struct(t["pos"].alias("depth"), k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(t["g1"]).alias("p1"), k2.bitwiseXOR(t["g2"]).alias("p2"), t["chars"].alias("chars"))

    heads = heads.select(F.col("conv_id").alias("base"), F.transform("ts", node).alias("path"))
    convs = lengths.select("conv_id", "own", shared.cast("bigint").alias("shared"), base.cast("bigint").alias("base")).join(heads, "base", "left")
    taken = F.when(F.col("path").isNull(), 0).otherwise(F.least(F.size("path"), F.col("shared"))).cast("int")
    convs = convs.withColumn("taken", taken).withColumn("path", F.when(F.col("taken") > 0, F.slice("path", F.lit(1), F.col("taken"))))
    end = (F.col("taken") + F.greatest(F.col("own") - F.col("shared"), zero)).alias("end")
    trunk = F.try_element_at("path", F.col("taken"))
    key = [F.when(F.col("taken") > 0, trunk[k]).otherwise(zero).alias("b" + k) for k in ("k1", "k2")]
    convs = materialize(convs.select("conv_id", "own", "shared", "taken", end, "path", *key), "rebuilt")

    root = F.struct(zero.alias("depth"), *(zero.alias(c) for c in ("k1", "k2", "p1", "p2", "chars")))
    path = F.concat(F.array(root), F.coalesce("path", F.array().cast("array<struct<depth:bigint,k1:bigint,k2:bigint,p1:bigint,p2:bigint,chars:bigint>>")))
    upper = convs.select("conv_id", "end", F.explode(path).alias("node")).select("conv_id", "node.*", (F.col("node.depth") == F.col("end")).alias("last"))

    own = join_hot(turns, convs.select("conv_id", "own", "shared", "taken", "end", "bk1", "bk2"), ["conv_id"], "own", total)
    depth = F.col("pos") - F.col("shared") + F.col("taken")
    own = own.where("pos > shared").withColumn("depth", depth)
    g1, g2 = _hashes(F.col("depth"), F.col("c1"), F.col("c2"))
    own = materialize(own.select("block", "conv_id", "depth", "chars", "end", "bk1", "bk2", g1.alias("g1"), g2.alias("g2")), "own-turns")
    running = Window.partitionBy("block", "conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = F.broadcast(_before(own, "conv_id", x1=F.bit_xor("g1"), x2=F.bit_xor("g2")))
    summed = own.select("*", F.bit_xor("g1").over(running).alias("r1"), F.bit_xor("g2").over(running).alias("r2")).join(earlier, ["block", "conv_id"], "left")
    k1, k2 = (F.col(f"r{i}").bitwiseXOR(F.col(f"bk{i}")).bitwiseXOR(F.coalesce(f"x{i}", zero)) for i in (1, 2))
    lower = summed.select("conv_id", "depth", k1.alias("k1"), k2.alias("k2"), "g1", "g2", "chars", (F.col("depth") == F.col("end")).alias("last"))
    lower = lower.withColumn("p1", F.col("k1").bitwiseXOR(F.col("g1"))).withColumn("p2", F.col("k2").bitwiseXOR(F.col("g2")))
    columns = ["conv_id", "depth", "k1", "k2", "p1", "p2", "chars", "last"]
    return materialize(upper.select(columns).unionByName(lower.select(columns)), "prefixes")


def _follow(nxt, weights):
    """For lists given by local successors (-1: none): each entry's head, and the weights before it from there on."""
    import numpy as np

    n = len(nxt)
    ptr = np.arange(n)
    before = np.zeros_like(weights)
    has = np.flatnonzero(nxt >= 0)
    ptr[nxt[has]] = has
    before[nxt[has]] = weights[has]
    while True:
        further = ptr[ptr]
        if (further == ptr).all():
            return ptr, before
        before += before[ptr]
        ptr = further


def _local(arcs, nxt):
    """Index of each successor among ``arcs`` (ascending), -1 where it is elsewhere."""
    import numpy as np

    at = np.searchsorted(arcs, nxt)
    at[at == len(arcs)] = 0
    return np.where(arcs[at] == nxt, at, -1)


_PARTS = ["kind", "id", "a", "a_pos", "a_leaves", "a_saved", "b", "b_pos", "b_leaves", "b_saved"]
_MEMBER, _RUN = 0, 1


def _contract(block: pd.DataFrame) -> pd.DataFrame:
    """The arcs of a block of nodes: where each lies in which run (a: enter, b: exit), and the runs.

    Arc 2 id enters node id, arc 2 id + 1 leaves it.
    """
    import numpy as np

    block = block.sort_values("id")
    ids, parent, sibling, child = (block[c].to_numpy() for c in ("id", "parent", "sibling", "child"))
    arcs = np.stack((2 * ids, 2 * ids + 1), axis=1).reshape(-1)
    enter = np.where(child >= 0, 2 * child, 2 * ids + 1)
    leave = np.where(sibling >= 0, 2 * sibling, np.where(parent >= 0, 2 * parent + 1, -1))
    nxt = np.stack((enter, leave), axis=1).reshape(-1)
    weights = np.zeros((len(arcs), 3), np.int64)
    weights[:, 0] = 1
    weights[::2, 1] = child < 0
    weights[::2, 2] = block["saving"].to_numpy()
    local = _local(arcs, nxt)
    head, before = _follow(local, weights)
    member = np.column_stack((np.full(len(ids), _MEMBER), ids, arcs[head[::2]], before[::2], arcs[head[1::2]], before[1::2]))
    tails = np.flatnonzero(local < 0)
    zeros = np.zeros((len(tails), 4), np.int64)
    runs = np.column_stack((np.full(len(tails), _RUN), arcs[head[tails]], nxt[tails], (before + weights)[tails], zeros))
    return pd.DataFrame(np.concatenate((member, runs)), columns=_PARTS)


def _rank_last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums before each of at most ``LAST_RUNS`` runs."""
    import numpy as np

    parts = list(batches)
    if not parts:
        return
    runs = pd.concat(parts).sort_values("arc")
    arcs = runs["arc"].to_numpy()
    _, before = _follow(_local(arcs, runs["next"].to_numpy()), runs[["pos", "leaves", "saved"]].to_numpy())
    yield pd.DataFrame(np.column_stack((arcs, before)), columns=["arc", "pos", "leaves", "saved"])


_SUMS = ["pos", "leaves", "saved"]


def rank_runs(runs: DataFrame, last_runs: int = LAST_RUNS) -> DataFrame:
    """(arc, pos, leaves, saved): the sums of all runs before each in a list of (arc, next, pos, leaves, saved)."""
    removed = []
    while runs.count() > last_runs:
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(len(removed))), F.lit(2)) == 1
        takes = (~coin("arc")) & (F.col("next") >= 0) & coin("next")
        mine = runs.where(takes).select(F.col("arc").alias("pred"), F.col("next").alias("arc"), *(F.col(c).alias("p_" + c) for c in _SUMS))
        step = materialize(runs.where(coin("arc")).join(mine, "arc", "left"), "run-pairs")
        gone = step.where("pred IS NOT NULL")
        merged = gone.select(F.col("pred").alias("arc"), "next", *((F.col(c) + F.col("p_" + c)).alias(c) for c in _SUMS))
        rest = step.where("pred IS NULL").select("arc", "next", *_SUMS)
        runs = materialize(runs.where(~coin("arc") & ~takes).unionByName(rest).unionByName(merged), "runs")
        removed.append(gone.select("arc", "pred", *(F.col("p_" + c).alias("p_" + c) for c in _SUMS)))
    done = materialize(runs.coalesce(1).mapInPandas(_rank_last, "arc bigint, pos bigint, leaves bigint, saved bigint"), "ranked-runs")
    for gone in reversed(removed):
        back = gone.join(done.withColumnRenamed("arc", "pred"), "pred").select("arc", *((F.col(c) + F.col("p_" + c)).alias(c) for c in _SUMS))
        done = materialize(done.unionByName(back), "ranked-runs")
    return done


def conversation_trie(conversations: DataFrame, shared: Column | None = None, base: Column | None = None, most_shared: int = 0,
                      nodes_per_block: int = NODES_PER_BLOCK, last_runs: int = LAST_RUNS) -> Trie:
    """The prefix trie of conversations, which may begin with turns of others (see ``prefix_rows``).

    Nodes: depth, k1, k2 (the prefix's key), conv_id (smallest member), parent_conv_id,
    n_convs, n_children, enter, leave (places of the arcs in the tour), n_leaves and
    saved_tokens (summed over the subtree).
    """
    shared = F.lit(0) if shared is None else shared
    rows = prefix_rows(conversations, shared, F.col("conv_id") if base is None else base, most_shared)
    n_blocks = max(1, -(-rows.count() // nodes_per_block))
    nodes = rows.groupBy("depth", "k1", "k2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("chars").alias("chars")
    )
    # numbered in the order of (conv_id, depth): unshared turns are neighbours, and the block is part of the number
    nodes = nodes.repartitionByRange(n_blocks, "conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    nodes = materialize(nodes.withColumn("id", F.monotonically_increasing_id()), "trie-nodes")

    below = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.col("id").alias("kid"))
    inner = below.groupBy("depth", "k1", "k2").agg(F.min("kid").alias("child"), F.count("*").alias("n_children"))
    inner = materialize(nodes.select("depth", "k1", "k2", F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id")).join(inner, ["depth", "k1", "k2"]), "inner-nodes")
    kids = _blocks(join_hot(below, inner.drop("child"), ["depth", "k1", "k2"], "n_children", nodes.count()).select("parent", "parent_conv_id", "kid"), "parent", "kid")
    later = Window.partitionBy("block", "parent").orderBy("kid")
    firsts = kids.join(F.broadcast(_cut_keys(kids, "parent")), ["block", "parent"]).groupBy("block", "parent").agg(F.min("kid").alias("first"))
    firsts = firsts.select("block", "parent", F.lead("first").over(Window.partitionBy("parent").orderBy("block")).alias("over"))
    links = kids.withColumn("next", F.lead("kid").over(later)).join(F.broadcast(firsts), ["block", "parent"], "left")
    links = links.select(F.col("kid").alias("id"), "parent", "parent_conv_id", F.coalesce("next", "over").alias("sibling"))

    tour = nodes.join(links, "id", "left").join(inner.select(F.col("parent").alias("id"), "child", "n_children"), "id", "left")
    tour = materialize(tour, "tour")
    none = F.lit(-1).cast("bigint")
    arcs = tour.select("id", *(F.coalesce(c, none).alias(c) for c in ("parent", "sibling", "child")), ((F.col("n_convs") - 1) * F.col("chars")).alias("saving"))
    schema = ", ".join(f"{c} bigint" for c in _PARTS)
    parts = materialize(arcs.groupBy(F.shiftright("id", _BLOCK_BITS)).applyInPandas(_contract, schema), "tour-parts")
    runs = parts.where(F.col("kind") == _RUN).select(F.col("id").alias("arc"), F.col("a").alias("next"), *(F.col("a_" + c).alias(c) for c in _SUMS))
    ranked = rank_runs(runs, last_runs)
    placed = parts.where(F.col("kind") == _MEMBER)
    for side in "ab":
        heads = ranked.select(F.col("arc").alias(side), *(F.col(c).alias(f"{side}0_{c}") for c in _SUMS))
        placed = placed.join(heads, side)
    up_to = {(side, c): F.col(f"{side}0_{c}") + F.col(f"{side}_{c}") for side in "ab" for c in _SUMS}
    sums = placed.select(
        "id",
        up_to["a", "pos"].alias("enter"),
        up_to["b", "pos"].alias("leave"),
        (up_to["b", "leaves"] - up_to["a", "leaves"]).alias("n_leaves"),
        (up_to["b", "saved"] - up_to["a", "saved"]).alias("saved_tokens"),
    )
    out = tour.join(sums, "id").select(
        "depth", "k1", "k2", "conv_id", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), "enter", "leave", "n_leaves", "saved_tokens"
    )
    return Trie(out, rows.where("last").select("depth", "k1", "k2", "conv_id"))


def ends_digest(ends: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the comma-joined conv_ids, ascending, that end at a node.

    Ids are sorted over range partitions, which split a node's, and joined to chunks there.
    A digest is made one byte after the other, so a node's chunks pass through one task, in
    order and one batch at a time.
    """
    keys = ["depth", "k1", "k2"]

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            key = batch[keys].to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)]) if len(key) else []
            text, out = batch["conv_id"].astype(str).tolist(), []
            for a, b in zip(starts, [*starts[1:], len(key)]):
                for at in range(a, b, chunk_ids):
                    out.append((*key[a].tolist(), batch["conv_id"].iat[at], ",".join(text[at : min(at + chunk_ids, b)])))
            yield pd.DataFrame(out, columns=[*keys, "first", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for batch in batches:
            out = []
            for *own, ids in zip(*(batch[c].tolist() for c in (*keys, "ids"))):
                if own == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key is not None:
                    out.append((*key, sha.hexdigest()))
                key, sha = own, hashlib.sha256(ids.encode())
            yield pd.DataFrame(out, columns=[*keys, "ends_sha256"])
        if key is not None:
            yield pd.DataFrame([(*key, sha.hexdigest())], columns=[*keys, "ends_sha256"])

    sorted_ids = ends.repartitionByRange(*keys, "conv_id").sortWithinPartitions(*keys, "conv_id")
    chunks = sorted_ids.mapInPandas(join, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    return chunks.repartition(*keys).sortWithinPartitions(*keys, "first").mapInPandas(digest, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def op11_prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations rebuilt on the first turns of their hundred's first one."""
    conv = F.col("conv_id")
    shared = F.crc32(conv.cast("string").cast("binary")) % 6
    trie = conversation_trie(conversations.select("conv_id", "turn", "role", "text"), shared, conv - conv % 100, 5)
    out = trie.nodes.join(ends_digest(trie.ends), ["depth", "k1", "k2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            md5(coalesce(role, '') || chr(10) || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
lengths AS (SELECT conv_id, max(pos) AS own FROM turns GROUP BY conv_id),
convs AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 100 AS base,
         xor(list_reduce([ord(x)::BIGINT for x in string_split(c.conv_id::VARCHAR, '')],
             lambda crc, b: list_reduce([0::BIGINT, 1, 2, 3, 4, 5, 6, 7],
               lambda r, i: xor(r >> 1, 3988292384 * (r & 1)), xor(crc, b)), 4294967295::BIGINT), 4294967295) % 6 AS h
  FROM lengths c),
shares AS (SELECT c.conv_id, base, h, least(h, coalesce(own, 0)) AS m FROM convs c LEFT JOIN lengths b ON b.conv_id = base),
sized AS (SELECT s.*, s.m + greatest(l.own - s.h, 0) AS size FROM shares s JOIN lengths l USING (conv_id)),
rebuilt AS (
  SELECT s.conv_id, t.pos AS depth, role, text FROM sized s JOIN turns t ON t.conv_id = s.base AND t.pos <= s.m
  UNION ALL
  SELECT s.conv_id, s.m + t.pos - s.h, role, text FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND t.pos > s.h
  UNION ALL
  SELECT conv_id, 0, '', '' FROM sized),
prefixes AS (
  SELECT r.conv_id, depth, length(text) AS chars, depth = size AS last,
         md5(string_agg(md5(role) || md5(text), ',') OVER (PARTITION BY r.conv_id ORDER BY depth)) AS k
  FROM rebuilt r JOIN sized USING (conv_id)),
linked AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY depth) AS p FROM prefixes),
nodes AS (
  SELECT k, min(depth) AS depth, min(p) AS p, count(*) AS n_convs, min(conv_id) AS conv_id, max(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM linked GROUP BY k),
children AS (SELECT p AS k, count(*) AS n_children FROM nodes WHERE p IS NOT NULL GROUP BY p),
full_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (k)),
sums AS (
  SELECT a.k, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.chars)::BIGINT AS saved_tokens
  FROM full_nodes v JOIN linked a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY a.k)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums USING (k) LEFT JOIN full_nodes q ON q.k = n.p
"""
