"""Operators on texts against brute force, and on odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import attention_lm, chunk_bpe, common, licenses, line_dedup, packing, quality, simhash, token_files
from tests.conftest import SF_SMALL
from tests.llm import brute

BYTE = common.public_tokenizer("byte_bpe_50k.json")
WORD = common.public_tokenizer("word_bpe_49k.json")
RANKS = common.public_tokenizer("byte_bpe_50k.tiktoken")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def held(doc_id, folds):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % folds == 0


def odd_texts(n=300, seed=1):
    rng = random.Random(seed)
    alphabet = "abc 'sAÉé́.,!1२\n\t  　中😀ﬁΣ|#ab  "
    fixed = ["", " ", "\n", "a  b", "a \nb", "\na", "a\n", "x <|endoftext|> y", "<|startoftext|>", "a\x00b c", "\x1c a", "é ́", "x" * 3000, "ab " * 2000, "a\r\nb"]
    return fixed + ["".join(rng.choice(alphabet) for _ in range(rng.choice([3, 20, 400, 4000]))) for _ in range(n)]


# --- encoders ---------------------------------------------------------------


def library_ids(path, text):
    return common.load_tokenizer(path).encode(text, add_special_tokens=False).ids


def test_byte_encoder_equals_library(monkeypatch):
    texts = odd_texts()
    for bound in (common.MEMO_ENTRIES, 50):
        monkeypatch.setattr(common, "MEMO_ENTRIES", bound)
        encoder = common.ByteBpeEncoder(BYTE)
        for _ in range(2):
            got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many([None, *texts])]
            assert got == [[], *(library_ids(BYTE, t) for t in texts)]
        assert len(encoder.memo) <= bound


def test_chunk_encoder_equals_library(monkeypatch):
    texts = odd_texts()
    rng = random.Random(3)
    shared = "".join(f"{rng.choice('bdfgklmnprst')}{rng.choice('aeiou')}{rng.randrange(100)}x " for _ in range(2000))
    texts += [x + shared + x for x in texts[:40]]
    monkeypatch.setattr(chunk_bpe, "STORE_BYTES", 60_000)
    encoder = chunk_bpe.ChunkEncoder(WORD)
    for at in range(0, len(texts), 50):
        part = texts[at : at + 50]
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_many(part)]
        assert got == [library_ids(WORD, t) for t in part]
    assert encoder.reused > 50  # passages that texts share are taken from the store
    assert encoder.size <= 60_000


def test_chunks_follow_content():
    rng = random.Random(5)
    text = "".join(f"{rng.choice('bdfgklmnprst')}ä{rng.randrange(1000)}{rng.choice(' ' * 5 + chr(10))}" for _ in range(5000))
    whole, moved = chunk_bpe.chunks_of(text), chunk_bpe.chunks_of("something else first " + text)
    assert "".join(whole) == text and len(set(whole) & set(moved)) > 0.8 * len(whole)


def test_op10_encodes_and_decodes(odd_docs):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in chunk_bpe.op10_chunk_bpe(odd_docs).collect()}
    tok = common.load_tokenizer(WORD)
    want = set()
    for i, t in pairs(odd_docs):
        ids = library_ids(WORD, t or "")
        want.add((i, len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()), brute.sha(tok.decode(ids, skip_special_tokens=False))))
    assert got == want
    encoded = chunk_bpe.encode(odd_docs, WORD)
    assert {(r.doc_id, len(r.ids)) for r in encoded.collect()} == {(i, n) for i, n, _, _ in want}
    assert {(r.doc_id, brute.sha(r.text)) for r in chunk_bpe.decode(encoded, WORD).collect()} == {(i, d) for i, _, _, d in want}


# --- token files ------------------------------------------------------------


@pytest.mark.parametrize("file_bytes", [token_files.FILE_BYTES, 10_000])
def test_op2_round_trip(spark, odd_docs, monkeypatch, file_bytes):
    monkeypatch.setattr(token_files, "FILE_BYTES", file_bytes)
    docs = odd_docs.unionByName(odd_docs.sparkSession.createDataFrame([(k, f"text {k} " * k) for k in range(10, 60)], "doc_id bigint, text string"), allowMissingColumns=True)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files.op2_token_files(docs).collect()), key=lambda r: r[0])
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, at = [], 0
    for i, t in rows:
        ids = library_ids(BYTE, t or "") + [0]
        want.append((at, i, len(ids), brute.crc(ids)))
        at += len(ids)
    assert got == want


def test_records_read_in_shuffled_order_and_damage_is_found(spark, odd_docs):
    path = common.shared_path(spark, "records-test")
    token_files.write_records(odd_docs, f"{path}/r", BYTE)
    index = token_files.write_index(spark, f"{path}/r", f"{path}/i", BYTE)
    read = token_files.read_records(spark, f"{path}/r", index, BYTE, seed=5).collect()
    want = sorted((str(i), library_ids(BYTE, t or "") + [0]) for i, t in pairs(odd_docs))
    assert sorted((str(r.doc_id), list(r.ids)) for r in read) == want
    assert [r.place for r in read] != [r.place for r in token_files.read_records(spark, f"{path}/r", index, BYTE, seed=6).collect()]
    good = token_files.frame(b"payload") + b"\n"
    assert token_files.unframe(good, 0) == (b"payload", len(good))
    for k in range(len(good) - 1):
        with pytest.raises(ValueError):
            token_files.unframe(good[:k] + bytes([good[k] ^ 1]) + good[k + 1 :], 0)


# --- licences ---------------------------------------------------------------


def brute_licenses(text, threshold):
    from collections import Counter

    prepared, _ = licenses.prepare(licenses.TEMPLATES)
    segments = [(m.span(), licenses.words(m[0])) for m in licenses._SEGMENT.finditer(text)]
    segments = [s for s in segments if s[1]]
    hits = []
    for i in range(len(segments)):
        for j in range(i, len(segments)):
            w = [x for s in segments[i : j + 1] for x in s[1]]
            a = Counter(zip(w, w[1:]))
            for t, template in enumerate(prepared):
                dice = 2 * sum((a & template.bigrams).values()) / (sum(a.values()) + template.size)
                if dice >= threshold:
                    hits.append((dice, t, i, j))
    return licenses.choose(hits, prepared, [s[0] for s in segments])


def test_licenses_equal_brute_force():
    rng = random.Random(2)
    prepared, index = licenses.prepare(licenses.TEMPLATES)
    common_words = "the of to and software is license version this work under any person copy".split()
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 8)):
            w = rng.choice(licenses.TEMPLATES)[1].split() if rng.random() < 0.5 else rng.choices(common_words, k=rng.randint(1, 12))
            parts.append(" ".join(x for x in w if rng.random() < 0.95) + rng.choice(["\n", ". ", " ", "! "]))
        text = "".join(parts)
        for threshold in (0.6, 0.8):
            assert licenses.scan(text, prepared, index, threshold) == brute_licenses(text, threshold)


def test_op3_finds_planted_lines_and_nothing_else(spark, make_docs, odd_docs):
    docs = make_docs([(1, "Some words.\nLicensed under CC BY-NC 4.0.\nmore words"), (2, "Licensed under CC BY 4.0."), (3, "we licensed it under no terms"), (4, "x\n" + licenses.TEMPLATES[5][1])])
    got = {(r.doc_id, r.license) for r in licenses.op3_licenses(docs).collect()}
    assert got == {(1, "CC-BY-NC-4.0"), (2, "CC-BY-4.0"), (4, "MIT")}
    assert licenses.op3_licenses(odd_docs).count() == 0
    whole = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    lines = {r.doc_id for r in whole.where(F.col("text").rlike("(?i)licensed under|released under the")).collect()}
    assert {r.doc_id for r in licenses.op3_licenses(whole).collect()} == lines


def brute_passages(text, threshold, prepared):
    """Every word span against every template; greedy by Dice, as licenses.choose."""
    from collections import Counter

    found = [(m.span(), m[0].lower()) for m in licenses._WORD.finditer(text)]
    every = [x for _, x in found]
    told = licenses.marks(every)
    hits = []
    for i in range(len(found)):
        for j in range(i + 1, len(found)):
            w = [x for _, x in found[i : j + 1]]
            a = Counter(zip(w, w[1:]))
            for t, template in enumerate(prepared):
                dice = 2 * sum((a & template.bigrams).values()) / (j - i + template.size)
                if dice >= threshold and licenses.agrees(template, every, told, i, j):
                    hits.append((dice, t, i, j))
    out = licenses.choose(hits, prepared, [(k, k) for k in range(len(found))])
    return [(name, dice, found[i][0][0], found[j][0][1], size) for name, dice, i, j, size in out]


def test_license_passages_equal_brute_force_over_all_word_spans():
    rng = random.Random(12)
    short = [x for x in licenses.TEMPLATES[:26] if len(x[1]) < 130]
    prepared, index = licenses.prepare(short)
    filler = "the of to and software is license version this work under any by".split()
    for _ in range(25):
        parts = []
        for _ in range(rng.randint(1, 4)):
            w = rng.choice(short)[1].split() if rng.random() < 0.6 else rng.choices(filler, k=rng.randint(1, 9))
            parts.append(" ".join(x for x in w if rng.random() < 0.95) + rng.choice(["\n", ". ", " ", ", "]))
        text = "".join(parts)
        for threshold in (0.6, 0.8):
            assert licenses.find_passages(text, prepared, index, threshold) == brute_passages(text, threshold, prepared)


@pytest.mark.parametrize(
    "text, name",
    [
        ("This file is part of the project and is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("Copyright 2020 The Example Authors, licensed under the Apache License, Version 2.0", "Apache-2.0"),
        ("Released under the MIT license by the author of this page in 2019", "MIT"),
    ],
)
def test_op3_finds_notices_inside_sentences(make_docs, text, name):
    (row,) = licenses.op3_licenses(make_docs([(1, text)])).collect()
    assert row.license == name and text[row.start : row.end].lower().split()[0] in ("licensed", "released")


def test_license_names_of_a_family_are_told_apart():
    prepared, index = licenses.prepare(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        assert [m[0] for m in licenses.find_passages(f"Some words before. {text}", prepared, index, 0.8)] == [name], text
    for text in ("Licensed under CC BY 9.0.", "This work is licensed under the GNU General Public License, version 7."):
        assert licenses.find_passages(text, prepared, index, 0.8) == []


# --- packing ----------------------------------------------------------------


def test_best_fit_equals_plain_search():
    for seed in range(120):
        rng = random.Random(seed)
        size = rng.choice([1, 2, 7, 16, 31, 64, 2048])
        lengths = sorted((rng.randint(1, size) for _ in range(rng.randint(0, 150))), reverse=True)
        where, offset = packing.best_fit(lengths, size)
        assert len(set(where)) == brute.best_fit_bins(lengths, size)
        ends = {}
        for b, o, n in zip(where, offset, lengths):
            assert o == ends.get(b, 0)
            ends[b] = o + n
        assert all(e <= size for e in ends.values())


@pytest.mark.parametrize("group", [packing.GROUP_PIECES, 5])
def test_op4_pieces_and_places(odd_docs, group):
    rows = packing.pack_documents(odd_docs, group_pieces=group).collect()
    want = []
    for i, t in pairs(odd_docs):
        ids = library_ids(BYTE, t or "") + [0]
        cut = packing.pieces_of(len(ids), 2048)
        assert [n for _, n in cut[1:]] == [2048] * (len(cut) - 1) and sum(n for _, n in cut) == len(ids)
        want += [(str(i), k, s, n, brute.crc(ids[s : s + n])) for k, (s, n) in enumerate(cut)]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048
    if group > 5:
        assert len(by) == brute.best_fit_bins([n for *_, n, _ in want], 2048)


# --- line dedup -------------------------------------------------------------


def line_rows(seed, n=80):
    rng = random.Random(seed)
    pool = [f"a line that is long enough {k}" for k in range(12)] + ["short", "", "  A LINE that is long enough 1\t", "exactly twenty chars", "nineteen characters"]
    rows = [(rng.choice([None, *range(n)]), "\n".join(rng.choices(pool, k=rng.randint(0, 6)))) for _ in range(n)]
    # a hot line in most documents, as first and as last hash of several ranges
    rows += [(1000 + k, "the line that all of these documents hold\n" + rng.choice(pool)) for k in range(150)]
    return rows + rows[:5] + [(3, None), (4, "")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_op5_equals_brute_force(spark, make_docs, seed):
    rows = line_rows(seed)
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in line_dedup.op5_line_dedup(make_docs(rows)).collect())
    want = sorted((str(i), len((t or "").split("\n")), len((t or "").split("\n")) - len(k), brute.sha("\n".join(k))) for i, t, k in brute.dedup(rows))
    assert got == want


def test_decisions_do_not_depend_on_ranges_or_batches(spark, make_docs):
    """The stream's state across batches and range borders, driven directly."""
    import pandas as pd

    rows = line_rows(7)
    lines = line_dedup.line_keys(make_docs(rows)).toPandas()
    lines["down"] = -lines["doc_id"]
    lines = lines.sort_values(["h1", "h2", "down", "text_key", "pos"]).drop(columns="down").reset_index(drop=True)
    key = list(zip(lines.h1, lines.h2, lines.doc_id))
    want = None
    for seed in range(40):
        rng = random.Random(seed)
        borders = sorted({0, len(lines), *(k for k in rng.sample(range(1, len(lines)), rng.randint(0, 12)) if key[k] != key[k - 1])})
        out = []
        for a, b in zip(borders, borders[1:]):
            cuts = sorted({a, b, *rng.sample(range(a, b), min(b - a, rng.randint(0, 6)))})
            out += list(line_dedup._decide(iter([lines.iloc[x:y] for x, y in zip(cuts, cuts[1:])]), 3))
        d = pd.concat(out)
        s = d[d.kind == line_dedup._SUMMARY].groupby(["h1", "h2"]).agg(n=("docs", "sum"), top=("doc_id", "max"))
        gone = {(r.doc_id, r.text_key, r.pos) for r in d[d.kind == line_dedup._DROP].itertuples()}
        for r in d[d.kind == line_dedup._OPEN].itertuples():
            if (r.h1, r.h2) in s.index and s.loc[(r.h1, r.h2), "n"] >= 3 and s.loc[(r.h1, r.h2), "top"] != r.doc_id:
                gone.add((r.doc_id, r.text_key, r.pos))
        assert len(d[d.kind == line_dedup._SUMMARY]) <= 2 * (len(borders) - 1)
        want = want or gone
        assert gone == want


def test_dedup_lines_keeps_columns(odd_docs):
    out = line_dedup.dedup_lines(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == odd_docs.count()
    assert sorted(map(str, pairs(out))) == sorted(map(str, pairs(odd_docs)))


# --- SimHash ----------------------------------------------------------------


def near_rows(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([2, 3, 40, 200]))) for _ in range(20)]
    rows = []
    for k in range(n):
        w = rng.choice(base).split(" ")
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((rng.choice([None, k, k, k, k]), rng.choice([" ", "\n", "  "]).join(w)))
    return rows + rows[:4] + [(500, None), (501, ""), (502, " \n")]


@pytest.mark.parametrize("shard_size", [4096, 8])
def test_op9_equals_brute_force(make_docs, shard_size):
    rows = near_rows(shard_size)
    found = simhash.simhash_components(make_docs(rows), shard_size=shard_size)
    got = sorted((str(r.doc_id), format(r.fp & (1 << 64) - 1, "016x"), r.component_id) for r in found.collect())
    assert got == sorted((str(i), f, c) for i, f, c in brute.simhash_components(rows))


def test_vantage_trees_find_every_pair():
    rng = np.random.default_rng(4)
    for n in (3, 70, 400, 1500):
        points = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        near = points[: n // 2] ^ (np.uint64(1) << rng.integers(0, 64, n // 2).astype(np.uint64))
        points = np.unique(np.r_[points, near, near ^ np.uint64(4), np.arange(min(n, 300), dtype=np.uint64)])
        got = {(i, j) for a, b in simhash.close_pairs(points, points, 2, True) for i, j in zip(a.tolist(), b.tolist())}
        close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
        want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(close))) if i < j}
        assert got == want
        tree, shards = simhash.shard_tree(points[::3], 16)
        home, who, where = simhash.route(tree, points, 2)
        seen = {(k, s) for k, s in zip(who.tolist(), where.tolist())}
        for i, j in want:
            a, b = (i, j) if home[i] <= home[j] else (j, i)
            assert home[a] == home[b] or (a, int(home[b])) in seen


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(900, 901), (903, 901)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 901: 900, 903: 900}
    assert simhash.components(edges.limit(0)).count() == 0


def test_near_duplicates_go(odd_docs):
    out = simhash.drop_near_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    got = sorted(str(r.doc_id) for r in out.collect())
    assert got == sorted(map(str, [1, 2, 4, 5, 7, 2**60 + 1, None, None]))  # 3 and 6 are as empty as 2


# --- quality ----------------------------------------------------------------


def test_trees_learn_and_walk_like_plain_code():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] < -0.5)).astype(float)
    trees = quality.fit_trees(x[:2000], y[:2000])
    p = trees.score(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.97
    for row, score in list(zip(x[2000:], p))[:50]:
        raw = trees.base
        for f, t, left, right, value in zip(trees.feature, trees.threshold, trees.left, trees.right, trees.value):
            k = 0
            while left[k] != k:
                k = left[k] if row[f[k]] <= t[k] else right[k]
            raw += value[k]
        assert abs(score - 1 / (1 + np.exp(-raw))) < 1e-9


def test_op1_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.op1_quality(docs, labels).collect()}
    assert len(rows) == docs.count() and all(r.held_out == held(r.doc_id, 5) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    out = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in out]) > 0.9
    assert np.mean([a for a, b in out if b == 1]) > 0.95


def test_op1_odd_rows(spark, odd_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (5, None, None), (None, 1, 1), (4, 0, 0), (99, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality.op1_quality(odd_docs, labels).count() == odd_docs.count()
    assert {r.score for r in quality.op1_quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns


# --- language model ---------------------------------------------------------


def test_op7_baseline_equals_brute_force_and_is_beaten(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pairs(docs)
    want = dict(zip((i for i, _ in rows), brute.word_base([t for i, t in rows if not held(i, 10)], [t for _, t in rows])))
    monkeypatch.setattr(attention_lm, "FREQUENT_WORDS", 2_000)  # many words go through the join
    got = attention_lm.op7_lm(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        n, known, total, base = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 10), n, known, total)
        assert abs(r.base_score - base) < 1e-8 * abs(base)
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen)


def tiny_model():
    rng = np.random.default_rng(3)
    width, experts, vocabulary = 7, 3, 12
    starts = np.arange(vocabulary) % 2 == 0
    class_of = np.where(starts, 4, 5).astype(np.int32)
    class_of[:4] = np.arange(4)
    counts = rng.integers(0, 9, (experts, width, width)).astype(float)
    m = attention_lm._tables(counts, class_of, np.zeros(vocabulary), starts, np.arange(4))
    return m.with_gates(0.3 * rng.normal(size=m.gates_of().shape))


def plain_probability(m, sequence, t):
    """P of the t-th class given those before, one position at a time, over the window that scores it."""
    prev = [m.classes - 1, *sequence]
    first = t - t % attention_lm.STRIDE - (attention_lm.WINDOW - attention_lm.STRIDE)
    places = [j for j in range(max(0, first), t + 1)]
    w = np.array([np.exp(float(m.query[prev[t]] @ m.key[prev[j]]) + m.nearness[t - j]) for j in places])
    gates = m.bias + (w / w.sum()) @ np.array([m.value[prev[j]] for j in places])
    g = np.exp(gates - gates.max())
    table = m.experts.reshape(m.classes, m.classes, -1)[prev[t]]
    return table @ (g / g.sum())


def test_windows_score_each_subword_once_with_causal_attention():
    m = tiny_model()
    rng = np.random.default_rng(8)
    docs = [np.r_[2, rng.integers(0, 6, n)][:n] for n in (0, 1, 5, 23, 24, 25, 100)]  # a text starts with a first subword
    edge = m.classes - 1
    previous = np.concatenate([np.r_[edge, d] for d in docs]).astype(np.int32)
    following = np.concatenate([np.r_[d, edge] for d in docs]).astype(np.int32)
    got = attention_lm.text_scores(m, previous, following, np.array([len(d) + 1 for d in docs]))
    for d, score in zip(docs, got):
        targets = [*d, edge]
        p = [plain_probability(m, d, t) for t in range(len(targets))]
        assert abs(sum(np.log(q[t]) for q, t in zip(p, targets)) - score) < 1e-3 * max(1, abs(score))
        for q in p:  # a distribution over the classes at every place
            assert abs(q.sum() - 1) < 1e-5


def test_gradient_descent_lowers_the_loss():
    m = tiny_model()
    rng = np.random.default_rng(9)
    seqs = [np.tile(np.r_[2, rng.integers(0, 6, 3)], 30) for _ in range(20)]
    data = attention_lm.class_sequence(m, [s for s in seqs])
    before = attention_lm.text_scores(m, *data).sum()
    after = attention_lm.text_scores(m.with_gates(attention_lm.descend(m, *data, epochs=5)), *data).sum()
    assert after > before + 10


def test_op7_word_order_counts(make_docs):
    """Held-out texts in the order of the training texts score clearly above the same words shuffled."""
    rng = random.Random(4)
    words = [a + b for a in ("red", "blue", "green", "dark") for b in (" car", " tree", " house", " river")]
    words = sorted({w for pair in words for w in pair.split()})
    follows = {w: words[(7 * i + 3) % len(words)] for i, w in enumerate(words)}

    def told():
        w, out = rng.choice(words), []
        for _ in range(40):
            out.append(w)
            w = follows[w] if rng.random() < 0.95 else rng.choice(words)
        return out

    rows, shuffled = [], {}
    for i in range(400):
        text = told()
        rows.append((i, " ".join(text)))
        if held(i, 10):
            rng.shuffle(text)
            shuffled[i] = " ".join(text)
    unseen = [i + 10_000 for i in range(5_000) if held(i + 10_000, 10)]
    mixed = dict(zip(unseen, shuffled.values()))
    score = {r.doc_id: r.score for r in attention_lm.op7_lm(make_docs(rows + list(mixed.items()))).collect()}
    pairs_of = list(zip(shuffled, mixed))
    assert len(pairs_of) > 20
    assert sum(score[a] - score[b] for a, b in pairs_of) / len(pairs_of) > 5


def test_op7_trains_on_every_document_in_rounds(make_docs, monkeypatch):
    """Every training document is laid out for descent once; more documents are more rounds; topics see all histograms."""
    assert [attention_lm.training_rounds(n) for n in (0, 2_047, 4_096, 8_192, 16_384)] == [2, 2, 3, 4, 5]
    rows = [(i, "ab " * (i % 5 + 1)) for i in range(300)]
    docs = make_docs(rows)
    seen = docs.sparkSession.sparkContext.accumulator(0)
    run = attention_lm.Descent.run

    def counted(self, previous, following, lengths):
        seen.add(len(lengths))
        return run(self, previous, following, lengths)

    ranks = common.public_tokenizer("byte_bpe_50k.tiktoken")
    vocabulary = attention_lm.subword_encoder(ranks).n_vocab
    model = tiny_model()
    model.class_of = np.full(vocabulary, 4, np.int32)
    monkeypatch.setattr(attention_lm, "Descent", type("Counted", (attention_lm.Descent,), {"run": counted}))
    attention_lm.train_gates(docs, model, ranks, 300)
    assert seen.value == 300
    # a sample of one kind alone starts the topics; all histograms move them
    mixed = make_docs([(i, "a" if i % 2 else "zzzz z") for i in range(60)])
    centers = attention_lm.topic_centroids(mixed, topics=1, topic_sample=1)
    want = np.mean([attention_lm.byte_histogram(b"a"), attention_lm.byte_histogram(b"zzzz z")], axis=0)
    assert np.allclose(centers[0], want, atol=1e-5)


def test_op7_reads_each_text_once(make_docs):
    """Counting, training and scoring read the ids that one pass over the texts wrote."""
    rows = [(i, f"some words {i % 7} of text {i % 11}") for i in range(60)]
    read = make_docs(rows).sparkSession.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    docs = make_docs(rows).withColumn("text", told.asNondeterministic()("text"))
    assert attention_lm.op7_lm(docs).count() == len(rows)
    assert read.value == len(rows)


def test_op7_running_ids_are_those_of_words_apart():
    ranks = common.public_tokenizer("byte_bpe_50k.tiktoken")
    encoder, starts = attention_lm.subword_encoder(ranks), attention_lm.word_starts(ranks)
    texts = ["a plain text, it's 12.5 of it", "caf\xe9 \u4e2d\u6587 \U0001f600\x1cy", "two\xa0\xa0 \xa0parts \u3000 x\u2003", "", "w" * 5_000 + " '' 'll"]
    for text in texts:
        words = attention_lm.words_of(text)
        flat = attention_lm.running_ids(words, ranks)
        assert flat.tolist() == [i for w in words for i in attention_lm.subwords(encoder, w)]
        assert starts[flat].sum() == len(words)
    # every word is counted under a name of its own, whether its ids are few or many
    counts = attention_lm.WordCounts(starts)
    for text in texts * 2:
        counts.add(attention_lm.running_ids(attention_lm.words_of(text), ranks))
    names, n = counts.taken()
    assert len(set(names)) == len(names) == len({w for t in texts for w in attention_lm.words_of(t)})
    assert sum(n) == 2 * sum(len(attention_lm.words_of(t)) for t in texts) and len(counts) == 0


def test_op7_odd_rows(odd_docs):
    rows = pairs(odd_docs)
    got = attention_lm.op7_lm(odd_docs).collect()
    want = brute.word_base([t for i, t in rows if not held(i, 10)], [t for _, t in rows])
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(
        (str(i), n, k, total, round(b, 6)) for (i, _), (n, k, total, b) in zip(rows, want)
    )
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)


@pytest.mark.parametrize("op", [chunk_bpe.op10_chunk_bpe, token_files.op2_token_files, licenses.op3_licenses, packing.op4_packing, line_dedup.op5_line_dedup, simhash.op9_simhash, attention_lm.op7_lm])
def test_empty_tables(odd_docs, op):
    assert op(odd_docs.limit(0)).count() == 0
