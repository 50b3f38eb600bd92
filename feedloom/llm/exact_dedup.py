"""Exact duplicates by content hash, with DataFrame and SQL functions alone.

Texts are equal when they agree after every character of ``[\\x20\\x09-\\x0D]`` is
deleted (the normalised text).

1. Rows are grouped by (128-bit hash, normalised text).  The text in the key is what
   compares the bytes: two texts that share a hash fall into two classes.  Equal texts
   fold inside each task before the one shuffle that carries texts, so a text that a
   third of all rows hold arrives once a task.
2. A class knows its size and its keeper: the row with the most code points in the
   original text, then the smallest doc_id.
3. Rows go on as digests (doc_id, hash, SHA-256, length), repeated ones folded with
   their number.  Rows alone in their class are settled by the lack of a partner.  The
   classes that hold over a thousandth of all rows are fewer than a thousand, so they
   are broadcast; in the join with the others no key holds more than that share.
4. Where a hash has several classes, its rows (and only they) meet their class by hash
   and normalised text.

Defined results: null counts as empty text, and such texts are one class.  A row
without a doc_id takes part and counts; it stays only where its class has no row with
a doc_id among those with most code points.  Of rows that agree in doc_id, length and
normalised text one is kept.  Empty tables give empty results; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import materialize, packed

BLANKS = " \t\n\x0b\x0c\r"  # fixed value: what equality ignores
#: A class with more than 1/HOT_SHARE of all rows is broadcast; there are fewer than HOT_SHARE such classes.
HOT_SHARE = 1_000


def normalised(text: Column) -> Column:
    """The text without blanks; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(norm))


def _order(doc_id: str, n_chars: str) -> Column:
    """Keeper first: most code points, then the smallest doc_id, nulls last."""
    return F.struct((-F.col(n_chars)).alias("less"), F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"))


def _hashed(docs: DataFrame, hashing: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.length(text).alias("n_chars"), normalised(F.col("text")).alias("norm"))
    return rows.withColumn("h", hashing(F.col("norm")))


def text_classes(docs: DataFrame, hashing: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(h, group_size, keeper) of every class: rows of one hash whose normalised texts agree byte for byte."""
    rows = _hashed(docs, hashing)
    each = rows.groupBy("h", "norm").agg(F.count("*").alias("group_size"), F.min(_order("doc_id", "n_chars")).alias("keeper"))
    return each.drop("norm")


def exact_duplicates(docs: DataFrame, hashing: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs``."""
    classes = materialize(text_classes(docs, hashing), "text-classes")
    collided = materialize(classes.groupBy("h").agg(F.count("*").alias("classes")).where("classes > 1").select("h"), "shared-hashes")
    rows = _hashed(docs, hashing).select("doc_id", "h", "n_chars", F.sha2("norm", 256).alias("text_sha256"))
    digests = rows.groupBy("doc_id", "h", "n_chars", "text_sha256").agg(F.count("*").alias("copies"))
    total = classes.agg(F.sum("group_size")).first()[0] or 0
    compared = None
    if not collided.isEmpty():  # these few rows go by their texts
        digests = digests.join(collided, "h", "left_anti")
        classes = classes.join(collided, "h", "left_anti")
        texts = _hashed(docs, hashing).join(collided, "h", "left_semi")
        own = texts.groupBy("h", "norm").agg(F.count("*").alias("group_size"), F.min(_order("doc_id", "n_chars")).alias("keeper"))
        members = texts.groupBy("h", "norm", "doc_id", "n_chars").agg(F.count("*").alias("copies"))
        compared = members.join(own, ["h", "norm"]).withColumn("text_sha256", F.sha2("norm", 256))

    facts = ["doc_id", "n_chars", "text_sha256", "copies", "group_size", "keeper"]
    digests = materialize(digests, "row-digests")
    several = classes.where("group_size > 1")
    hot = several.where(F.col("group_size") * HOT_SHARE > total)  # fewer than HOT_SHARE rows
    usual = several.where(F.col("group_size") * HOT_SHARE <= total)
    rest = digests.join(F.broadcast(hot.select("h")), "h", "left_anti").join(usual, "h", "left")
    settled = digests.join(F.broadcast(hot), "h").select(facts).unionByName(rest.select(facts))
    if compared is not None:
        settled = settled.unionByName(compared.select(facts))

    own = _order("doc_id", "n_chars")
    found = settled.select(
        "doc_id",
        F.coalesce("keeper", own).alias("keeper"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        own.eqNullSafe(F.coalesce("keeper", own)).alias("first"),
        "text_sha256",
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    )
    return found.select("doc_id", F.col("keeper.id").alias("keep_id"), "group_size", (F.col("first") & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The kept row of every class, with all its columns (of rows that tie, the one with the least row hash)."""
    rows = packed(docs).withColumn("norm", normalised(F.col("row.text")))
    n_chars = F.length(F.coalesce(F.col("row.text"), F.lit("")))
    place = F.struct((-n_chars).alias("less"), F.col("row.doc_id").isNull().alias("none"), F.col("row.doc_id").alias("id"), F.xxhash64("row").alias("tie"))
    return rows.groupBy(content_hash(F.col("norm")).alias("h"), "norm").agg(F.min_by("row", place).alias("row")).select("row.*")


def op13_exact_dedup(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    return exact_duplicates(documents.select("doc_id", "text"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM d WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
