"""Cases in which rows or places were lost before."""

import itertools

from feedloom.llm import simhash, token_files
from tests.llm import brute


def test_a_doc_id_with_two_texts_loses_neither(make_docs):
    words = [f"w{i}" for i in range(400)]
    a, b, c = (" ".join(words[i::3]) for i in range(3))
    rows = [(1, a), (1, b), (2, c), (3, b), (3, b), (4, "solo uno"), (4, "solo uno"), (None, a), (5, None), (6, "")]
    left = simhash.drop_near_duplicates(make_docs(rows)).collect()
    assert sorted((r.doc_id, r.text) for r in left if r.doc_id is not None) == sorted([(1, a), (1, b), (2, c), (4, "solo uno"), (5, None)], key=lambda r: r)
    assert sum(r.doc_id is None for r in left) == 1


def test_starts_over_more_than_a_thousand_files(spark, make_docs, tmp_path, monkeypatch):
    """One record a file, all in one partition: file c1000 comes after c999, not after c100."""
    from feedloom.llm.common import public_tokenizer

    monkeypatch.setattr(token_files, "FILE_BYTES", 1)
    tokenizer = public_tokenizer("byte_bpe_50k.json")
    docs = make_docs([(i, "word " * (i % 5)) for i in range(1203)]).coalesce(1)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        token_files.write_records(docs, f"{tmp_path}/records", tokenizer)
        index = token_files.write_index(spark, f"{tmp_path}/records", f"{tmp_path}/index", tokenizer).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len({r.file for r in index}) > 1000
    rows = sorted(index, key=lambda r: r.doc_id)
    assert [r.start for r in rows] == [0, *itertools.accumulate(r.n_tokens for r in rows)][:-1]
    assert brute.crc([0]) in {r.ids_crc32 for r in rows}
