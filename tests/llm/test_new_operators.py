"""Prefix trie, lexical search and exact dedup against brute force and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import exact_dedup, lexical, trie
from tests.conftest import SF_SMALL
from tests.llm import brute

TURNS = "conv_id bigint, turn int, role string, text string"
CLASH = ("row", "h", "norm", "keeper", "copies", "group_size", "id", "block", "pos", "depth", "parent", "shared", "base", "score", "n_terms", "ids", "tfs", "rank", "term")


# --- exact dedup -------------------------------------------------------------


def with_clash(df):
    """Extra columns whose names clash with inner ones."""
    return df.withColumns({c: F.lit(0) for c in CLASH if c not in df.columns})


def brute_exact(rows):
    clean = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[clean(t)].append((-len(t or ""), i is None, i))
    out = []
    for norm, members in groups.items():
        best = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        kept = False
        for m in members:
            first = m == best and not kept
            kept |= first
            out.append((m[2], best[2], len(members), first, brute.sha(norm)))
    return sorted(out, key=repr)


def exact_rows():
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "\ta  b"), (4, "\ta  b"), (5, None), (6, ""), (7, " \n\x0b\x0c\r\t"), (None, "x"), (None, "x"), (8, "x"), (None, "y  "), (9, "y")]
    rows += [(10, "é"), (11, "é "), (12, "é"), (13, "x\x1cy"), (14, "xy"), (15, "w" * 100_000), (16, "w " * 100_000), (2**61, "ab"), (17, "\xa0ab")]
    return rows + [(100 + i, "the same hot text\n") for i in range(60)] + [(100 + i, "the same hot text ") for i in range(0, 60, 2)]


def collected(df):
    return sorted(map(tuple, df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


@pytest.mark.parametrize("share", [1, 3, 1000])
def test_op13_equals_brute_force(make_docs, monkeypatch, share):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", share)
    rows = exact_rows()
    docs = with_clash(make_docs(rows))
    assert collected(exact_dedup.op13_exact_dedup(docs)) == brute_exact(rows)


@pytest.mark.parametrize("bits", [0, 1])
def test_op13_compares_bytes_where_hashes_collide(make_docs, bits):
    rows = exact_rows()
    weak = lambda norm: F.substring(F.md5(norm), 1, bits)
    assert collected(exact_dedup.exact_duplicates(make_docs(rows), weak)) == brute_exact(rows)


def test_op13_empty_table_and_plan(make_docs, capsys):
    empty = make_docs([])
    assert exact_dedup.op13_exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).count() == 0
    exact_dedup.exact_duplicates(make_docs(exact_rows())).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_drop_exact_duplicates_keeps_columns(make_docs):
    rows = exact_rows()
    docs = with_clash(make_docs(rows))
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((r[0] for r in brute_exact(rows) if r[3]), key=repr)


# --- lexical search ----------------------------------------------------------


def brute_lexical(docs, items, k=10):
    terms = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", brute.lower(t or ""))
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for item, words in asked.items():
        found = []
        for i, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            if s > 0 and i is not None:
                found.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def lexical_rows(seed, n=400):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcdéß中')}{rng.randrange(60)}" for _ in range(200)] + ["Aß", "the", "THE", "x_y", "a-b", "ünï", "½"]
    text = lambda size: " ".join(rng.choice(vocabulary) if rng.random() < 0.7 else "the" for _ in range(size))
    docs = [(i, text(rng.choice([0, 3, 30, 200]))) for i in range(n)]
    docs += [docs[3], docs[3], (None, "the b3"), (7000, None), (7001, ""), (7002, " ,;\t"), (7003, "only " * 50_000), (7004, "the"), (7005, "the")]
    items = [(i, text(rng.choice([1, 5, 40]))) for i in range(25)] + [(3, "more words the"), (None, "the"), (90, None), (91, ""), (92, "unheard-of"), (93, "the"), (94, "only the")]
    rng.shuffle(docs)
    return docs, items


@pytest.mark.parametrize(("seed", "chars", "shard", "postings"), [(1, 8_000_000, 32_768, 4_000_000), (2, 300, 17, 4_000_000), (3, 8_000_000, 10_000, 50)])
def test_op12_equals_brute_force(spark, make_docs, seed, chars, shard, postings):
    docs, items = lexical_rows(seed)
    table = with_clash(spark.createDataFrame(items, "item_id bigint, text string"))
    got = lexical.lexical_search(with_clash(make_docs(docs)), table, block_chars=chars, shard_docs=shard, shard_postings=postings)
    assert sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()) == brute_lexical(docs, items)


def test_op12_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    for docs, asked in ((make_docs([]), items), (make_docs([(1, "a")]), items.limit(0)), (make_docs([(1, None)]), items)):
        found = lexical.op12_lexical(docs, asked)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_accumulators_are_limited():
    """Rare terms close the set; frequent terms then make no accumulators, and scores stay exact."""
    rng = np.random.default_rng(4)
    n = 3000
    rows = [[0] + ([1] if rng.random() < 0.5 else []) + ([2] if i % 100 == 0 else []) + ([3] if i % 150 == 0 else []) for i in range(n)]
    ids = [np.array(sorted(r), "<i4").tobytes() for r in rows]
    tfs = [np.ones(len(r), "<i4").tobytes() for r in rows]
    sizes = np.array([len(r) for r in rows])
    shard = lexical.Shard(np.arange(n), sizes, ids, tfs, n, int(sizes.sum()))
    df = [sum(t in r for r in rows) for t in range(4)]
    terms = np.array(sorted(range(4), key=lambda t: df[t]))
    weights = np.array([lexical.weight(n, df[t]) for t in terms])
    for _ in range(2):  # a search leaves no trace for the next
        who, scores, made = shard.search(terms, weights, 10)
        m = [10 + 90 * int(s) * n // int(sizes.sum()) for s in sizes]
        full = sorted((-sum(int(w) * (10**9 // (1000 + 8 * m[i])) for t, w in zip(terms, weights) if t in rows[i]), i) for i in range(n))[:10]
        assert [(-int(s), int(i)) for s, i in zip(scores, who)] == full
        assert 10 <= made <= 60  # of 3000 documents that hold a term


# --- prefix trie -------------------------------------------------------------


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, hashlib.md5(f"{role}\n{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children, leaves, saved = Counter(), Counter(), Counter()
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * (len(k[-1][1]) if k else 0)
    out = []
    for k, m in members.items():
        digest = brute.sha(",".join(map(str, sorted(ends[k]))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], digest))
    return sorted(out, key=repr)


def trie_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(215, 230), -5, -100, -150, 2**60]:
        same = rng.random() < 0.4
        for turn in range(rng.choice([1, 2, 4, 9])):
            rows.append((c, turn, rng.choice(["user", "assistant"]) if not same else "user", f"text {turn if same else rng.randrange(5)} é"))
    rows += [(7, None, None, None), (7, None, "user", None), (300, 1, "a\nb", "c"), (400, 1, "a", "b\nc"), (500, 3, "user", "w" * 20_000), (None, 1, "user", "lost")]
    rows += [(600, 5, "user", "again")] * 40 + [(600, None, "user", "again")] * 3 + [(12, 0, "user", "twice")] * 2
    return rows + [(700, i, "user", f"long {i % 3}") for i in range(400)] + [(701, i, "user", f"long {i % 3}") for i in range(300)]


def trie_of(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(columns).collect()), key=repr)


@pytest.mark.parametrize(("seed", "nodes", "last"), [(1, 100_000, 250_000), (2, 40, 250_000), (3, 25, 8)])
def test_op11_equals_brute_force(spark, monkeypatch, seed, nodes, last):
    """One block, many blocks, and coin rounds down to a few runs."""
    monkeypatch.setattr(trie.conversation_trie, "__defaults__", (None, None, 0, nodes, last))
    rows = trie_rows(seed)
    random.Random(seed).shuffle(rows)
    df = with_clash(spark.createDataFrame(rows, TURNS))
    assert trie_of(trie.op11_prefix_trie(df)) == brute_trie(rows)


def test_tour_places_are_a_permutation_and_nest(spark):
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    nodes = trie.conversation_trie(df, nodes_per_block=50, last_runs=4).nodes.collect()
    assert sorted(p for r in nodes for p in (r.enter, r.leave)) == list(range(2 * len(nodes)))
    stack = []
    for place, r in sorted((p, r) for r in nodes for p in (r.enter, r.leave)):
        if place == r.enter:
            assert len(stack) == r.depth
            stack.append(r)
        else:
            assert stack.pop() == r


def test_op11_empty_table_and_digest_over_batches(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.op11_prefix_trie(empty).count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(100 * i, 0, "user", "same") for i in range(20)] + [(100 * i + 1, 0, "user", f"own {i}") for i in range(10)]
        assert trie_of(trie.op11_prefix_trie(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ends_digest_over_chunks(spark):
    """One node with most of the ids, cut into small chunks over several partitions and batches."""
    rows = [(3, 7, -9, i) for i in range(-50, 700)] + [(1, k, k, 10 * k) for k in range(40)]
    df = spark.createDataFrame(rows, "depth bigint, k1 bigint, k2 bigint, conv_id bigint")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        got = {(r.depth, r.k1): r.ends_sha256 for r in trie.ends_digest(df, 13).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(3, 7): brute.sha(",".join(str(i) for i in range(-50, 700)))} | {(1, k): brute.sha(str(10 * k)) for k in range(40)}
    assert got == want
    assert trie.ends_digest(df.limit(0)).count() == 0
