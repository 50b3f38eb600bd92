"""The pipeline against brute force stage by stage, and on odd documents."""

import numpy as np

import corpus_pipeline
from feedloom.llm import common, quality
from tests.conftest import SF_SMALL
from tests.llm import brute

BYTE = common.public_tokenizer("byte_bpe_50k.json")


def pieces(rows):
    tok = common.load_tokenizer(BYTE)
    out = []
    for i, text in rows:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        starts = [0, *range(first, len(ids), 2048)]
        out += [(str(i), k, s, e - s, brute.crc(ids[s:e])) for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    return sorted(out)


def test_run_equals_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = {r.doc_id for r in quality.op1_quality(docs, labels).collect() if r.predicted}
    assert 0 < len(good) < len(rows)
    lines = [(i, "\n".join(k)) for i, _, k in brute.dedup([r for r in rows if r[0] in good])]
    found = brute.simhash_components(lines)
    left = [r for r, (i, _, first) in zip(lines, found) if i == first]
    got = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces(left)
    ends = {}
    for r in sorted(got, key=lambda r: r.offset):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 1


def test_stages_keep_the_columns_of_documents(spark, odd_docs, tmp_path):
    """Nulls, repeats and clashing columns go through every stage; each decision takes effect."""
    sf = str(tmp_path)
    spark.createDataFrame([(5, 0, 0), (4, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), "odd")
        assert docs.columns == odd_docs.columns, name
    assert len({r.doc_id for r in docs.collect() if r.doc_id is not None}) == sum(r.doc_id is not None for r in docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() <= docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd_docs.limit(0), sf).count() == 0, name


def test_planted_copies_lines_and_junk(spark, make_docs, tmp_path):
    """Of exact and near copies one stays, a passage of many documents stays in one, clean documents stay whole."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words, n))
    passage = prose(60)
    clean = [(k, prose(200)) for k in range(40)]
    copies = [(100 + k, clean[0][1]) for k in range(30)]
    near = [(200 + k, clean[1][1].replace(words[0], "changed") + (" more" if k % 2 else "")) for k in range(20)]
    shared = [(300 + k, prose(150) + "\n" + passage + "\n" + prose(150)) for k in range(25)]
    docs = make_docs(clean + copies + near + shared)
    sf = str(tmp_path)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf), "planted")
    left = {r.doc_id: r.text for r in docs.collect()}
    assert all(left.get(i) == t for i, t in clean[2:])
    assert sum(passage in t for t in left.values()) == 1 and passage in left[324]
    assert sum(i in left for i, _ in [*copies, clean[0]]) <= 2  # the one that kept its only line, and an empty one
    assert len({t for t in left.values() if t}) == sum(bool(t) for t in left.values())
