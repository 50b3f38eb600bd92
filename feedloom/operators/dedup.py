"""Deduplication: exact distinct (D2) and conditional near-duplicate removal.

D1 semantics: rows are grouped by the name keys (null keys form a group of
their own); walking each group in input order, a row is removed when at least
``threshold`` comparable columns are equal and non-null versus an earlier row
that was *kept*.  This is the greedy, order-dependent pass of the original
cleaner, computed exactly and the same way for groups of every size:

1. **Copy collapse.**  Identical rows with at least ``threshold`` non-null
   comparable columns are always removed after their first occurrence (an
   identical earlier copy, or whatever removed it, removes them too).  One
   ``groupBy`` with map-side partial aggregation folds them, so a hot group of
   copies is pre-aggregated before it is shuffled.  The result is written once;
   everything after works on its row ids and hashed cells.
2. **Pieces.**  A group of ``HOT_GROUP`` rows or more is cut, at row ids told by a
   bounded sample of it, into pieces of about ``PIECE`` rows in input order; the first
   pieces are small (``bucket_window`` rows, then ``GROWTH`` times as many, ...), and each
   of these steps is a phase.  Smaller groups are packed whole, many to a piece.  Any cuts
   give the same result.
3. **Tiles.**  Two pieces of a group, or one with itself, meet in one task, which finds
   their similar rows in memory.  Similar rows differ in at most ``C - threshold``
   columns, and a differing column spoils one block, so of ``C - threshold + r`` disjoint
   column blocks they agree on at least ``r``.  Every choice of ``r`` blocks is a signature;
   rows that agree on one are compared.  A tile chooses ``r`` and the blocks with the fewest
   colliding pairs in a bounded sample of its rows, so that columns of few values, each
   useless alone, are selective together.  Any layout gives the same result.  Neither a
   row's signatures nor the pairs that are compared leave the task.
4. **Phases.**  The undecided rows of a phase are met among themselves; of a row's similar
   predecessors a tile tells ``PREDECESSORS`` at most, and whether that is all.  The greedy
   rule is propagated over these edges: a row is kept once all its predecessors are told and
   removed, and removed as soon as one is kept.  The rows kept then meet all that are
   undecided, in this phase and after it, and remove what is similar to them, so that later
   phases do not tell the edges of rows like those.  State is checkpointed to cut lineage.

Cells are compared by their 64-bit hashes and groups by 128 bits.
"""

from __future__ import annotations

import logging
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Rows of a group's first phase.
BUCKET_WINDOW = 512
#: Each phase ends at so many times the rows of the one before.
GROWTH = 8
#: Rows of a piece; a task holds two.
PIECE = 1 << 16
#: Rows that the smaller groups of a pack have in all, about.
PACK = 1 << 14
#: Similar predecessors of a row that a tile tells at most.
PREDECESSORS = 16
#: Pairs of rows compared at once.
PAIRS = 1 << 18

#: Groups of so many rows are cut into pieces; layouts and cuts come from about so many sampled rows.
HOT_GROUP = 1_000
LAYOUT_SAMPLE = 4_096
#: Signatures of a row at most; more blocks to a signature are only tried below that.
MAX_SIGNATURES = 300
#: A group with over 1/HOT_SHARE of all rows has its layout broadcast; such groups are fewer than HOT_SHARE.
HOT_SHARE = 1_000


def distinct_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Exact distinct over a projection."""
    return df.select(*cols).dropDuplicates()


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _sorted(df: DataFrame) -> DataFrame:
    """``df`` for a join by shuffle and sort.

    Tables that grow with the input are never broadcast: Spark takes the size of a
    checkpointed table from the input file, in which a column of few values (a row id, an
    array of hashes) is a small part of what it is in memory, and would build the whole of it in the driver.
    """
    return df.hint("merge")


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def drop_near_duplicates(df: DataFrame, keys=("apellido_cliente", "nombre_cliente"), order: str = "_row",
                         threshold: int = 30, compare: list[str] | None = None,
                         bucket_window: int = BUCKET_WINDOW) -> DataFrame:
    """Remove later rows that repeat >= ``threshold`` comparable columns of an earlier kept row.

    ``order`` is a unique, totally ordered row id (input order).  A table that
    lacks any key column is returned unchanged.
    """
    keys = list(keys)
    if not set(keys) <= set(df.columns):
        return df
    if order not in df.columns:
        raise ValueError(f"order column {order!r} is required to define 'earlier'")
    compare = list(compare) if compare is not None else [c for c in df.columns if c not in keys and c != order]
    others = [c for c in df.columns if c not in keys and c not in compare and c != order]
    cols_out = [_q(c) for c in df.columns]

    # -- 1. collapse exact copies (only where copies are provably similar) --
    nn = reduce(add, [_q(c).isNotNull().cast("int") for c in compare], F.lit(0))
    solo = F.when(nn < threshold, _q(order)).alias("_solo")
    rows = (
        df.groupBy(*[_q(k) for k in keys], *[_q(c) for c in compare], solo)
        .agg(F.min(F.struct(_q(order).alias(order), *[_q(c).alias(c) for c in others])).alias("_first"))
        .select(*[_q(k) for k in keys], *[_q(c) for c in compare], "_first.*")
        .select(*cols_out)
        .checkpoint()
    )
    n = len(compare)
    if threshold > n:  # nothing can be similar
        return rows
    if threshold <= 0:  # everything is similar: the first row of each group survives
        first = rows.groupBy(*[_q(k) for k in keys]).agg(F.min(_q(order)).alias(order)).select(order)
        return rows.join(_sorted(first), order, "left_semi").select(*cols_out)
    kept = _resolve(rows, keys, order, compare, threshold, bucket_window)
    return rows.join(_sorted(kept), order, "left_semi").select(*cols_out)


def _blocks(rows: DataFrame, compare: list[str], threshold: int) -> list[list[int]]:
    """Column numbers of each block: the most varied columns alone, the others together."""
    counts = rows.agg(*[F.approx_count_distinct(_q(c)).alias(f"_{i}") for i, c in enumerate(compare)]).first()
    varied = sorted(range(len(compare)), key=lambda i: (-counts[i], i))
    alone = len(compare) - threshold
    return [[i] for i in varied[:alone]] + [varied[alone:]]


def choose_layout(cells, threshold: int, rows: int) -> tuple[list[int], list[list[int]]]:
    """(block of each column, signatures as lists of blocks) for a group, from sampled rows of hashed cells (0: null).

    For r = 1, 2, ... the columns are dealt to blocks so that blocks are about equally
    selective, and the pairs that agree on a signature are counted in the sample.  The
    cheapest in pairs plus memberships, for the whole group, is taken.
    """
    from itertools import combinations
    from math import comb

    import numpy as np

    n, width = cells.shape
    spare = width - threshold

    def pairs(keys) -> float:
        same = np.unique(keys, return_counts=True)[1].astype(float)
        return float((same * (same - 1)).sum() / 2)

    agree = [pairs(cells[cells[:, c] != 0, c]) for c in range(width)]
    all_pairs = max(n * (n - 1) / 2, 1.0)
    told = [-np.log(max(p, 0.5) / all_pairs) for p in agree]  # how much a column tells rows apart
    best = None
    for r in range(1, threshold + 1):
        blocks = spare + r
        if r > 1 and comb(blocks, r) > MAX_SIGNATURES:
            break
        weight, block_of = np.zeros(blocks), [0] * width
        for c in sorted(range(width), key=lambda c: (-told[c], c)):
            at = int(weight.argmin())
            block_of[c] = at
            weight[at] += told[c] + 1e-9  # columns that tell nothing are spread as well
        hashes, whole = np.zeros((n, blocks), np.uint64), np.ones((n, blocks), bool)
        for c in range(width):
            at = block_of[c]
            hashes[:, at] = (hashes[:, at] ^ cells[:, c].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            whole[:, at] &= cells[:, c] != 0
        signatures = [list(s) for s in combinations(range(blocks), r)]
        found = 0.0
        for number, signature in enumerate(signatures):
            key = np.zeros(n, np.uint64)
            for at in signature:
                key = (key ^ hashes[:, at]) * np.uint64(0xC2B2AE3D27D4EB4F)
            found += pairs(key[whole[:, signature].all(axis=1)])
            if best is not None and found * (rows / n) ** 2 > best[0]:
                break
        cost = found * (rows / n) ** 2 + len(signatures) * rows
        if best is None or cost < best[0]:
            best = (cost, block_of, signatures)
    return best[1], best[2]


def _of_groups(cells: DataFrame, groups: DataFrame, total: int, how: str = "inner") -> DataFrame:
    """``cells`` with what ``groups`` (g1, g2, n, ...) says of their group; the few crowded groups are broadcast.

    With ``how="left"`` rows of other groups stay.
    """
    crowded = F.broadcast(groups.where(F.col("n") * HOT_SHARE > total))  # fewer than HOT_SHARE groups
    others = groups.where(F.col("n") * HOT_SHARE <= total)
    rest = cells.join(F.broadcast(crowded.select("g1", "g2")), ["g1", "g2"], "left_anti")
    return cells.join(crowded, ["g1", "g2"]).unionByName(rest.join(_sorted(others), ["g1", "g2"], how))


def _layouts(cells: DataFrame, hot: DataFrame, threshold: int, total: int) -> DataFrame:
    """(g1, g2, n, block_of, signatures) of every group of ``hot`` (g1, g2, n); a group's sample is bounded."""
    import numpy as np
    import pandas as pd

    share = F.greatest(F.floor(F.col("n") / LAYOUT_SAMPLE), F.lit(1))
    sample = _of_groups(cells, hot, total).where(F.pmod(F.xxhash64("o"), share) == 0)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = np.array([[0 if c is None or c != c else int(c) for c in row] for row in rows["cells"]], dtype=np.int64)
        block_of, signatures = choose_layout(m, threshold, int(rows["n"].iat[0]))
        return pd.DataFrame({"g1": [key[0]], "g2": [key[1]], "n": [rows["n"].iat[0]], "block_of": [block_of], "signatures": [signatures]})

    text = sample.select("g1", "g2", "n", "cells")
    return text.groupBy("g1", "g2").applyInPandas(choose, "g1 bigint, g2 bigint, n bigint, block_of array<int>, signatures array<array<int>>")


def _own_buckets(rows: DataFrame) -> DataFrame:
    """(o, bucket) of rows that carry their group's layout."""
    cell = F.zip_with("cells", "block_of", lambda c, b: F.struct(c.alias("c"), b.alias("b")))

    def block_hash(number: Column) -> Column:
        own = F.filter(cell, lambda x: x["b"] == number)
        return F.when(F.exists(own, lambda x: x["c"].isNull()), F.lit(None)).otherwise(F.aggregate(own, F.lit(7).cast("bigint"), lambda h, x: F.xxhash64(h, x["c"])))

    hashed = rows.withColumn("_blocks", F.transform(F.sequence(F.lit(0), F.array_max("block_of")), block_hash))

    def bucket(signature: Column, number: Column) -> Column:
        parts = F.transform(signature, lambda b: F.get("_blocks", b))
        whole = ~F.exists(parts, lambda h: h.isNull())
        return F.when(whole, F.aggregate(parts, F.xxhash64("g1", "g2", number), lambda h, x: F.xxhash64(h, x)))

    return hashed.select("o", F.explode(F.array_compact(F.transform("signatures", bucket))).alias("bucket"))


def bucket_members(cells: DataFrame, blocks: list[list[int]], threshold: int) -> DataFrame:
    """(o, bucket) such that similar rows share a bucket; rows alone in their group or bucket are left out.

    The signatures as a table, which shows how few pairs they leave.  It has hundreds of rows
    for a row of a large group, so ``drop_near_duplicates`` makes them inside its tiles.
    """
    cells = cells.checkpoint()
    sizes = cells.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").checkpoint()
    total = cells.count()
    layouts = _layouts(cells, sizes.where(F.col("n") >= HOT_GROUP), threshold, total).checkpoint()
    buckets = [
        F.when(_all([F.col("cells")[i].isNotNull() for i in block]), F.xxhash64(F.lit(b), "g1", "g2", *[F.col("cells")[i] for i in block]))
        for b, block in enumerate(blocks)
    ]
    small = _of_groups(cells, sizes, total).where(F.col("n") < HOT_GROUP)
    own = _of_groups(cells, layouts, total)
    members = small.select("o", F.explode(F.array_compact(F.array(*buckets))).alias("bucket")).unionByName(_own_buckets(own)).checkpoint()
    shared = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    return members.join(_sorted(shared), "bucket", "left_semi").select("o", "bucket").checkpoint()


def hashed_cells(rows: DataFrame, keys: list[str], order: str, compare: list[str]) -> DataFrame:
    """(o, g1, g2, cells): row id, 128-bit hash of the group and 64-bit hashes of the compared values (null stays null)."""
    group = [x for k in keys for x in (_q(k), _q(k).isNull())]  # a hash passes over nulls, so they are marked
    return rows.select(
        _q(order).alias("o"), F.xxhash64(F.lit(1), *group).alias("g1"), F.xxhash64(F.lit(2), *group).alias("g2"),
        F.array(*[F.when(_q(c).isNotNull(), F.xxhash64(_q(c))) for c in compare]).alias("cells"),
    )


def _cuts(cells: DataFrame, hot: DataFrame, total: int, window: int) -> DataFrame:
    """(g1, g2, n, cuts, starts) of every group of ``hot`` (g1, g2, n).

    A row's piece is the number of ``cuts`` up to its id; ``starts`` has the first piece of
    each phase, and at its end the number of pieces.
    """
    import numpy as np
    import pandas as pd

    share = F.greatest(F.floor(F.col("n") / LAYOUT_SAMPLE), F.lit(1))
    sample = _of_groups(cells.select("o", "g1", "g2"), hot, total).where(F.pmod(F.xxhash64("o"), share) == 0)
    # places in the sorted sample: (g1, g2, n, places, starts)
    sizes = sample.groupBy("g1", "g2").agg(F.first("n").alias("n"), F.array_sort(F.collect_set("o")).alias("_sample"))
    most, growth = PIECE, GROWTH

    def places(parts):
        for part in parts:
            out = {"g1": part["g1"], "g2": part["g2"], "places": [], "starts": []}
            for n, m in zip(part["n"], part["m"]):
                ends, starts, at, end = [], [], 0, window
                while at < n:
                    end = min(end, n)
                    starts.append(len(ends))
                    ends += np.linspace(at, end, -(-(end - at) // most) + 1)[1:].tolist()
                    at, end = end, end * growth
                out["places"].append([min(int(end * m / n), m - 1) for end in ends[:-1]])
                out["starts"].append([*starts, len(ends)])
            yield pd.DataFrame(out)

    at = sizes.select("g1", "g2", "n", F.size("_sample").alias("m")).mapInPandas(places, "g1 bigint, g2 bigint, places array<int>, starts array<int>")
    return sizes.join(_sorted(at), ["g1", "g2"]).select("g1", "g2", "n", F.transform("places", lambda i: F.get("_sample", i)).alias("cuts"), "starts")


def _numbered(cells: DataFrame) -> DataFrame:
    """(o, number): numbers in the order of the ids, which may be of any type."""
    ids = cells.select("o").distinct().repartitionByRange("o").sortWithinPartitions("o")
    return ids.select("o", F.monotonically_increasing_id().alias("number")).checkpoint()


def _placed(cells: DataFrame, numbers: DataFrame, window: int) -> DataFrame:
    """(o, g1, g2, cells, pack, piece, phase, starts): every row's place; ``o`` is its id's number and nulls of ``cells`` are 0 from here on."""
    sizes = cells.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"))
    hot = sizes.where(F.col("n") >= min(HOT_GROUP, 8 * window)).checkpoint()
    total = cells.count()
    # of an id that comes twice, all rows must be met before it is decided: then there is one phase
    twice = numbers.count() < total
    cells = cells.join(_sorted(numbers), "o").select(F.col("number").alias("o"), "g1", "g2", "cells")
    packs = max(1, total // PACK)
    if hot.isEmpty():
        in_group = cells.withColumn("cuts", F.lit(None).cast("array<bigint>")).withColumn("starts", F.lit(None).cast("array<int>"))
    else:
        in_group = _of_groups(cells, _cuts(cells, hot, total, window).checkpoint(), total, "left")
    piece = F.size(F.filter("cuts", lambda c: c <= F.col("o")))
    one = F.array(F.lit(0), F.lit(1))
    starts = F.when(F.col("cuts").isNull(), one).otherwise(F.array(F.lit(0), F.element_at("starts", -1)) if twice else F.col("starts"))
    return (
        in_group.select(
            "o", "g1", "g2", F.transform("cells", lambda c: F.coalesce(c, F.lit(0).cast("bigint"))).alias("cells"),
            F.when(F.col("cuts").isNull(), F.pmod(F.xxhash64("g1", "g2"), F.lit(packs))).otherwise(-1).alias("pack"),
            F.when(F.col("cuts").isNull(), 0).otherwise(piece).alias("piece"), starts.alias("starts"))
        .withColumn("phase", F.size(F.filter("starts", lambda c: c <= F.col("piece"))) - 1)
        .checkpoint()
    )


def similar_rows(src, dst, threshold: int, most: int, mixed: bool):
    """(places in ``src``, places in ``dst``) of rows that are similar, at most ``most`` for a row of ``dst``.

    ``src`` and ``dst`` are (ids, groups, cells): a pair counts where the id of the first
    is below that of the second; ``mixed`` rows are of several groups, which must agree.
    Cells are hashes, 0 is null.  Rows of ``src`` are taken in order.
    """
    import numpy as np

    (src_id, src_group, a), (dst_id, dst_group, b) = src, dst
    n, m, width = len(a), len(b), a.shape[1]
    if not n or not m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # the layout, from a sample; of several groups, each is about as large as the largest
    both = a if a is b else np.concatenate((a, b))
    step = -(-len(both) // LAYOUT_SAMPLE)
    rows = int(np.unique(dst_group, return_counts=True)[1].max()) if mixed else int((2.0 * n * m) ** 0.5)
    block_of, signatures = choose_layout(both[::step], threshold, max(rows, 1))
    # values are numbered by column: 0 is a null of src, 1 of dst
    parts, largest = [], 0
    for c in range(width):
        values, number = np.unique(both[:, c], return_inverse=True)
        number = np.where(both[:, c] == 0, 0, number.reshape(-1) + 2)
        parts.append(number.astype(np.uint8 if len(values) < 254 else np.uint16 if len(values) < 65_534 else np.uint32))
        largest = max(largest, parts[-1].dtype.itemsize)
    numbers = np.stack(parts, axis=1).astype(f"u{largest}")
    del parts, both
    x, y = (numbers, numbers.copy()) if a is b else (numbers[:n], numbers[n:].copy())
    y[y == 0] = 1

    def blocks(numbers, null):
        hashes, whole = np.zeros((max(block_of) + 1, len(numbers)), np.uint64), np.ones((max(block_of) + 1, len(numbers)), bool)
        for c, at in enumerate(block_of):
            hashes[at] = (hashes[at] ^ numbers[:, c]) * np.uint64(0x9E3779B97F4A7C15)
            hashes[at] ^= hashes[at] >> np.uint64(29)
            whole[at] &= numbers[:, c] != null
        return hashes, whole

    def keys(hashes, groups, signature, rows):
        key = groups[rows].copy()
        for at in signature:
            key = (key ^ hashes[at][rows]) * np.uint64(0xC2B2AE3D27D4EB4F)
            key ^= key >> np.uint64(31)
        return key

    (xh, xw), (yh, yw) = blocks(x, 0), blocks(y, 1)
    told = np.zeros(m, np.int64)
    found_src, found_dst = [], []
    for signature in signatures:
        left = np.flatnonzero(xw[signature].all(axis=0))
        left_keys = keys(xh, src_group, signature, left)
        y_whole = yw[signature].all(axis=0)
        while len(left):
            right = np.flatnonzero(y_whole & (told < most))
            right_keys = keys(yh, dst_group, signature, right)
            order = np.argsort(right_keys)
            right, right_keys = right[order], right_keys[order]
            first = np.searchsorted(right_keys, left_keys)
            count = np.searchsorted(right_keys, left_keys, "right") - first
            ends = np.cumsum(count)
            at, full = 0, 0
            while at < len(left) and full * 4 <= len(right):
                to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")), at + 1)
                some = count[at:to]
                i = np.repeat(left[at:to], some)
                j = right[np.arange(len(i)) - np.repeat(np.cumsum(some) - some - first[at:to], some)]
                at = to
                fit = (src_id[i] < dst_id[j]) & (told[j] < most)
                if mixed:
                    fit &= src_group[i] == dst_group[j]
                i, j = i[fit], j[fit]
                same = np.count_nonzero(x[i] == y[j], axis=1) >= threshold
                i, j = i[same], j[same]
                if len(i):  # a pair is told where it first agrees
                    agree = (xh[:signature[-1] + 1, i] == yh[:signature[-1] + 1, j]) & xw[:signature[-1] + 1, i] & yw[:signature[-1] + 1, j]
                    new = agree[signature].all(axis=0) & (agree.sum(axis=0) == len(signature))
                    i, j = i[new], j[new]
                    by_dst = np.argsort(j, kind="stable")
                    i, j = i[by_dst], j[by_dst]
                    runs = np.flatnonzero(np.r_[True, j[1:] != j[:-1]]) if len(j) else np.zeros(0, np.int64)
                    place = np.arange(len(j)) - np.repeat(runs, np.diff(np.r_[runs, len(j)]))
                    within = told[j] + place < most
                    i, j = i[within], j[within]
                    before = np.unique(j)
                    told += np.bincount(j, minlength=m)
                    full += int((told[before] >= most).sum())
                    found_src.append(i)
                    found_dst.append(j)
            left, left_keys = left[at:], left_keys[at:]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_src]), np.concatenate([none, *found_dst])


def _meet(tiles: DataFrame, threshold: int, most: int) -> DataFrame:
    """(src, dst) of similar rows of ``tiles`` (t1, t2, pack, i, j, earlier, later, o, g1, g2, cells).

    A tile tells ``most`` rows for a ``dst``; where it does, one more, without ``src``, says that there may be others.
    """
    def similar(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by("o").combine_chunks()
        o = table.column("o").to_numpy()
        mixed = table.column("pack")[0].as_py() >= 0
        group = np.zeros(len(o), np.uint64)
        if mixed:
            group = np.unique(np.stack([table.column(c).to_numpy() for c in ("g1", "g2")]), axis=1, return_inverse=True)[1].reshape(-1).astype(np.uint64)
        cells = table.column("cells").combine_chunks().flatten().to_numpy().reshape(len(o), -1)
        roles = [np.flatnonzero(table.column(c).to_numpy(zero_copy_only=False)) for c in ("earlier", "later")]
        whole = all(len(r) == len(o) for r in roles)
        src, dst = ((o, group, cells) if whole else (o[r], group[r], cells[r]) for r in roles)
        i, j = similar_rows(src, dst, threshold, most, mixed)
        i, j = roles[0][i], roles[1][j]
        more = np.flatnonzero(np.bincount(j, minlength=len(o)) >= most)
        return pa.table({"src": pa.concat_arrays([pa.array(o[i]), pa.nulls(len(more), pa.int64())]), "dst": o[np.concatenate((j, more))]})

    return tiles.groupBy("t1", "t2", "pack", "i", "j").applyInArrow(similar, "src bigint, dst bigint")


def _tiles(rows: DataFrame, i, j, earlier, later) -> DataFrame:
    """``rows`` in the tile of pieces (i, j); the rows of a pack are in one, whatever their group."""
    packed = F.col("pack") >= 0
    g = [F.when(packed, 0).otherwise(F.col(c)).alias(t) for c, t in (("g1", "t1"), ("g2", "t2"))]
    return rows.select(*g, "pack", i.alias("i"), j.alias("j"), earlier.alias("earlier"), later.alias("later"), "o", "g1", "g2", "cells")


def _among(rows: DataFrame, phase: int) -> DataFrame:
    """Tiles in which the rows of a phase meet."""
    other, piece = F.col("_other"), F.col("piece")
    each = rows.withColumn("_other", F.explode(F.sequence(F.get("starts", F.lit(phase)), F.get("starts", F.lit(phase + 1)) - 1)))
    return _tiles(each, F.least(piece, other), F.greatest(piece, other), piece <= other, piece >= other)


def _against(kept: DataFrame, rest: DataFrame, phase: int) -> DataFrame:
    """Tiles in which rows kept in a phase meet the undecided of their piece and those after it."""
    piece = F.col("piece")
    left = kept.withColumn("_other", F.explode(F.sequence(piece, F.element_at("starts", -1) - 1)))
    right = rest.withColumn("_other", F.explode(F.sequence(F.get("starts", F.lit(phase)), F.least(piece, F.get("starts", F.lit(phase + 1)) - 1))))
    yes, no = F.lit(True), F.lit(False)
    return _tiles(left, piece, F.col("_other"), yes, no).unionByName(_tiles(right, F.col("_other"), piece, no, yes))


def _propagate(edges: DataFrame, head: DataFrame) -> DataFrame:
    """(o, s) of the rows of ``head`` (o) by the greedy rule over ``edges``: K kept, R removed, U undecided."""
    short = edges.where(F.col("src").isNull()).select(F.col("dst").alias("o")).distinct()
    local = (
        head.join(_sorted(short.withColumn("_short", F.lit(True))), "o", "left")
        .select("o", F.lit("U").alias("s"), F.col("_short").isNull().alias("complete"))
        .checkpoint()
    )
    edges = edges.where(F.col("src").isNotNull())
    # kept once complete and every similar predecessor is removed; removed as soon as one is kept
    while True:
        src = local.select(F.col("o").alias("src"), F.col("s").alias("ss"))
        verdict = (
            edges.join(_sorted(src), "src").where(F.col("ss") != "R")
            .groupBy("dst").agg(F.max((F.col("ss") == "K").cast("int")).alias("any_k"),
                                F.max((F.col("ss") == "U").cast("int")).alias("any_u"))
        )
        nxt = (
            local.join(_sorted(verdict), local.o == verdict.dst, "left")
            .select("o", "complete", F.col("s").alias("old"),
                    F.when(F.col("s") != "U", F.col("s"))
                    .when(F.col("any_k") == 1, F.lit("R"))
                    .when(F.col("complete") & F.coalesce(F.col("any_u") == 0, F.lit(True)), F.lit("K"))
                    .otherwise(F.lit("U")).alias("s"))
            .checkpoint()
        )
        if nxt.where(F.col("s") != F.col("old")).isEmpty():
            return nxt.select("o", "s")
        local = nxt.drop("old")


def _resolve(rows: DataFrame, keys: list[str], order: str, compare: list[str], threshold: int, window: int) -> DataFrame:
    """Ids (as ``order``) of the rows that are kept."""
    cells = hashed_cells(rows, keys, order, compare).where(F.col("o").isNotNull())  # a row without an id is never kept
    numbers = _numbered(cells)
    placed = _placed(cells, numbers, window)
    last = placed.agg(F.max("phase")).first()[0]
    if last is None:
        return numbers.select(F.col("o").alias(order))
    undecided, kept, passes = placed.select("o").distinct().checkpoint(), [], 0
    for phase in range(last + 1):
        while True:
            passes += 1
            mine = placed.where(F.col("phase") == phase).join(_sorted(undecided), "o", "left_semi")
            edges = _meet(_among(mine, phase), threshold, PREDECESSORS).checkpoint()
            state = _propagate(edges, mine.select("o").distinct())
            new = state.where(F.col("s") == "K").select("o")
            kept.append(new)
            left = not state.where(F.col("s") == "U").isEmpty()
            if phase == last and not left:
                break
            still = undecided.join(_sorted(state.where(F.col("s") != "U").select("o")), "o", "left_anti")
            mine = placed.where(F.col("phase") == phase).join(_sorted(new), "o", "left_semi")
            rest = placed.where(F.col("phase") >= phase).join(_sorted(still), "o", "left_semi")
            removed = _meet(_against(mine, rest, phase), threshold, 1).select(F.col("dst").alias("o")).distinct()
            undecided = still.join(_sorted(removed), "o", "left_anti").checkpoint()
            if not left or placed.where(F.col("phase") == phase).join(_sorted(undecided), "o", "left_semi").isEmpty():
                break
    log.info("near-duplicate resolution: %d phases, %d passes", last + 1, passes)
    numbers_kept = reduce(DataFrame.unionByName, kept).select(F.col("o").alias("number"))
    return numbers.join(_sorted(numbers_kept), "number", "left_semi").select(F.col("o").alias(order))
