"""Line deduplication: keep bitmaps from a range-partitioned, sorted stream of line hashes.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z
lower-cased.  Keys of at least ``min_chars`` code points that occur in at least
``min_docs`` documents are dropped everywhere except in the largest doc_id that
holds them (all its lines with the key stay).

1. Every long line becomes (128-bit key hash, doc_id, text hash, position); no text
   is shuffled.
2. Rows are range-partitioned by (hash, doc_id descending) and sorted with the
   position last.  As the doc_id is part of the range, a key that a third of all
   documents hold is spread over many tasks.
3. Each task streams its rows: the first document of a key is its keeper, the
   second waits until a third one shows up.  A key cut by a range border is left
   undecided; each task sends at most two border summaries, which are added up and
   settle those rows.
4. Dropped positions meet per document as one compressed bitmap.

Defined results: null or empty text is one empty line.  Rows without a doc_id
belong to no document: they neither count nor lose lines.  Rows with the same
doc_id and text get the same bitmap; rows with one doc_id and different texts are
one document when documents are counted.  Empty tables give empty results.  Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from feedloom.llm.common import materialize, packed

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = " \t\n\x0b\x0c\r"  # fixed value: what a key is stripped of

_DROP, _OPEN, _SUMMARY = 0, 1, 2
_LINES = "h1 bigint, h2 bigint, doc_id bigint, text_key bigint, pos int"
_DECISIONS = "kind int, h1 bigint, h2 bigint, doc_id bigint, text_key bigint, pos int, docs bigint"


def text_key(text: Column) -> Column:
    """Which text of a doc_id a bitmap belongs to, should a doc_id occur with several."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line whose key is long enough: hash, doc_id, text key, position."""

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        for batch in batches:
            digests, ids, texts, positions = [], [], [], []
            for doc_id, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"]):
                for pos, line in enumerate(text.split("\n")):
                    line = line.strip(BLANKS)
                    if len(line) >= min_chars:
                        digests.append(xxhash.xxh3_128_digest(line.encode().lower()))  # bytes.lower(): A-Z alone
                        ids.append(doc_id)
                        texts.append(key)
                        positions.append(pos)
            h = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
            yield pd.DataFrame({"h1": h[:, 0], "h2": h[:, 1], "doc_id": ids, "text_key": texts, "pos": positions})

    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    return rows.select("doc_id", text_key(F.col("text")).alias("text_key"), "text").mapInPandas(keys, _LINES)


def _decide(batches: Iterator[pd.DataFrame], min_docs: int) -> Iterator[pd.DataFrame]:
    """Stream one sorted range; see the module's text.  Holds one batch and the waiting documents of one key."""
    import numpy as np

    cols = ["h1", "h2", "doc_id", "text_key", "pos"]
    empty = pd.DataFrame(columns=cols)
    key, first_key, docs, top, last = None, None, 0, None, None  # of the key that the stream is in
    waiting = empty  # its rows after the keeper's, while too few documents were seen

    def out(rows: pd.DataFrame, kind: int) -> pd.DataFrame:
        return rows.assign(kind=kind, docs=0)[["kind", *cols, "docs"]]

    def summary() -> pd.DataFrame:
        return pd.DataFrame([[_SUMMARY, key[0], key[1], top, 0, 0, docs]], columns=["kind", *cols, "docs"])

    for batch in batches:
        if batch.empty:
            continue
        h1, h2, d = (batch[c].to_numpy() for c in ("h1", "h2", "doc_id"))
        new_key = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
        new_key[0] = key != (h1[0], h2[0])
        new_doc = new_key | np.r_[True, d[1:] != d[:-1]]
        new_doc[0] = new_key[0] or d[0] != last
        last = d[-1]
        group = np.cumsum(new_key)  # 0: goes on from the batch before
        starts = np.flatnonzero(new_key)
        begins = np.r_[0, starts] if not new_key[0] else starts
        # the number, among the key's documents, of each row's document
        number = np.cumsum(new_doc)
        offset = number[begins] - new_doc[begins]
        if not new_key[0]:
            offset[0] -= docs
        slot = group if not new_key[0] else group - 1
        number = number - offset[slot]
        sizes = np.maximum.reduceat(number, begins)  # documents of each key, up to this batch's end
        ends_here = np.arange(len(begins)) < len(begins) - 1
        if not new_key[0]:  # settle or extend the key of the batch before
            if key == first_key:
                if ends_here[0]:
                    docs = int(sizes[0])
                    yield summary()
            elif sizes[0] >= min_docs:
                yield out(waiting, _DROP)
                waiting = empty
            elif ends_here[0]:
                waiting = empty
        elif key is not None:
            if key == first_key:
                yield summary()
            waiting = empty
        if first_key is None:
            first_key = (h1[0], h2[0])
            if ends_here[0]:
                key, docs, top = first_key, int(sizes[0]), d[0]
                yield summary()
        in_first = (h1 == first_key[0]) & (h2 == first_key[1])
        drop = (number > 1) & (sizes[slot] >= min_docs) & ~in_first
        yield out(batch[drop], _DROP)
        yield out(batch[in_first], _OPEN)
        if new_key[0] or len(begins) > 1:
            top = d[begins[-1]]
        key, docs = (h1[-1], h2[-1]), int(sizes[-1])
        if key != first_key and docs < min_docs:
            more = batch[(slot == len(begins) - 1) & (number > 1)]
            waiting = pd.concat([waiting, more]) if len(begins) == 1 and not new_key[0] else more
    if key is not None:
        yield out(waiting, _OPEN)
        yield summary()


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, pos) of every line that goes."""
    lines = materialize(line_keys(docs, min_chars), "line-keys")  # range partitioning reads it twice
    order = ["h1", "h2", F.desc("doc_id")]
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order, "text_key", "pos")
    decided = materialize(ranged.mapInPandas(lambda b: _decide(b, min_docs), _DECISIONS), "line-decisions")
    # at most two rows from each range: small by construction
    borders = (
        decided.where(F.col("kind") == _SUMMARY)
        .groupBy("h1", "h2")
        .agg(F.sum("docs").alias("all_docs"), F.max("doc_id").alias("keeper"))
        .where(F.col("all_docs") >= min_docs)
    )
    row = ["doc_id", "text_key", "pos"]
    settled = decided.where(F.col("kind") == _OPEN).join(F.broadcast(borders), ["h1", "h2"]).where("doc_id <> keeper")
    return decided.where(F.col("kind") == _DROP).select(row).unionByName(settled.select(row))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, text_key, n_lines, n_dropped, keep) per different (doc_id, text).

    ``keep`` is the zlib-compressed bitmap of the lines, first line in the lowest
    bit of the first byte, 1 for a line that stays.
    """

    @F.pandas_udf(BinaryType())
    def bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for n, gone in zip(n_lines, dropped):
            bits = np.ones(n, dtype=np.uint8)
            bits[np.asarray(gone, dtype=np.int64)] = 0
            out.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        return pd.Series(out)

    # one document's own lines: the group is as large as the document
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("gone"))
    text = F.coalesce(F.col("text"), F.lit(""))
    each = docs.select(
        "doc_id", text_key(text).alias("text_key"), (F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("bigint").alias("n_lines")
    ).dropDuplicates(["doc_id", "text_key"])
    return (
        each.join(gone, ["doc_id", "text_key"], "left")
        .withColumn("gone", F.coalesce("gone", F.array().cast("array<int>")))
        .select("doc_id", "text_key", "n_lines", F.size("gone").cast("bigint").alias("n_dropped"), bitmap("n_lines", "gone").alias("keep"))
    )


@F.pandas_udf(StringType())
def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines that a bitmap keeps, joined by newlines (null text stays null)."""
    import numpy as np

    out = []
    for t, k in zip(text, keep):
        if t is None or k is None:
            out.append(t)
            continue
        lines = t.split("\n")
        bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=len(lines), bitorder="little")
        out.append("\n".join(x for x, b in zip(lines, bits) if b))
    return pd.Series(out, dtype=object)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, n_lines, n_dropped, kept): each row of ``docs`` as a struct, with its text's kept lines."""
    marked = packed(docs).withColumn("own_key", text_key(F.col("row.text")))
    right = bitmaps.withColumnRenamed("doc_id", "id")
    joined = marked.join(right, (F.col("own_key") == F.col("text_key")) & F.col("row.doc_id").eqNullSafe(F.col("id")), "left")
    changed = F.col("n_dropped") > 0
    kept = kept_text(F.when(changed, F.col("row.text")), F.when(changed, F.col("keep")))  # untouched texts stay out of Python
    return joined.select("row", "n_lines", "n_dropped", F.when(changed, kept).otherwise(F.col("row.text")).alias("kept"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with repeated lines removed; n_chars, where present, follows the new text."""
    out = apply_bitmaps(docs, keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs))
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("bigint")}
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op5_line_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the sha256 of what stays, from the bitmaps."""
    docs = documents.select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs)).select(
        F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256")
    )


OP5_SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pieces AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM pieces),
keyed AS (
  SELECT doc_id, line, pos,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keyed.doc_id, line, pos, (keeper IS NOT NULL AND keyed.doc_id <> keeper) AS gone
  FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
