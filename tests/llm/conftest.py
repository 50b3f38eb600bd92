import pytest

DOC_SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture()
def make_docs(spark):
    """documents from (doc_id, text) pairs, with null companions."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, None, len(t) if t is not None else None) for i, t in rows], DOC_SCHEMA)

    return make


@pytest.fixture()
def odd_docs(make_docs):
    """Nulls, empty and long texts, repeated rows, and columns that clash with inner names."""
    from pyspark.sql import functions as F

    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (2, None), (3, ""), (None, "a row without an id\nof two lines"), (None, None)]
    rows += [(4, "w" * 50_000), (5, "word and then another\n" * 3_000), (6, " \t\n\n  "), (7, "ünïcödé ěščř 中文 😀 é x\x1cy"), (2**60 + 1, "large id")]
    clash = {c: F.lit(0) for c in ("score", "_kept", "_keeper", "_row", "_key", "_doc", "row", "id", "h", "word", "fp", "x", "y", "text_key", "keep", "n_lines", "held_out", "piece", "length", "_n_dropped", "_n_lines", "file", "place")}
    return make_docs(rows).withColumns(clash)
