"""Spellings of one name brought together.

Names are compared by their slug (lower case, no accents, one mark between words).  Slugs
within a few edits of each other are variants, unless their digits differ: a workshop's
number is no misspelling.  Pairs are found by prefix filtering on q-grams, so no two
names meet that share no rare q-gram; chains of variants are one name, called like its
most frequent spelling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.text import slug

Q = 2
#: Slugs of at least so many characters may differ by so many edits.  Shorter ones must agree:
#: with fewer than q x edits + 1 q-grams a pair need not share any.
EDITS = ((10, 2), (5, 1))


def _edits(key: Column) -> Column:
    out = F.lit(0)
    for length, edits in reversed(EDITS):
        out = F.when(F.length(key) >= length, edits).otherwise(out)
    return out


def _grams(key: Column) -> Column:
    """The q-grams of a text; a repeated one carries its number, so that equal sets are equal multisets."""
    plain = F.transform(F.sequence(F.lit(1), F.greatest(F.length(key) - (Q - 1), F.lit(1))), lambda i: F.substring(key, i, F.lit(Q)))
    return F.transform(plain, lambda g, i: F.concat(g, F.size(F.filter(F.slice(plain, F.lit(1), i + 1), lambda x: x == g)).cast("string")))


def variant_pairs(keys: DataFrame) -> DataFrame:
    """(a, b), a < b, of all slugs in column ``key`` that are variants of each other.

    Strings within d edits share all but q x d of their q-grams.  So of the q x d + 1
    globally rarest of either, one is shared: only these are joined on.
    """
    digits = F.regexp_replace("key", "[^0-9]", "").alias("digits")
    sized = keys.select("key", digits, _edits(F.col("key")).alias("d"), F.length("key").alias("n")).where("d > 0")
    grams = sized.select("*", F.explode(_grams(F.col("key"))).alias("gram"))
    rare = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("key").orderBy("df", "gram")  # a slug's own q-grams
    prefix = grams.join(rare, "gram").withColumn("place", F.row_number().over(order)).where(F.col("place") <= Q * F.col("d") + 1)
    prefix = prefix.select("gram", "digits", "key", "d", "n").checkpoint()
    edits = F.least("a.d", "b.d")
    met = prefix.alias("a").join(prefix.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.digits") == F.col("b.digits")) & (F.col("a.key") < F.col("b.key")))
    near = met.where(F.abs(F.col("a.n") - F.col("b.n")) <= edits).select(F.col("a.key").alias("a"), F.col("b.key").alias("b"), edits.alias("d")).distinct()
    return near.where(F.levenshtein("a", "b") <= F.col("d")).select("a", "b")


def _components(edges: DataFrame) -> DataFrame:
    """(key, root) of every key of an edge; root is the smallest key of its component.

    Every round gives a key the smallest root among its neighbours and itself, then the
    root's own root; it ends when a round changes nothing.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    roots = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("key"), "root").checkpoint()
    while True:
        seen = both.join(roots.select(F.col("key").alias("b"), "root"), "b").groupBy(F.col("a").alias("key")).agg(F.min("root").alias("near"))
        lower = roots.join(seen, "key").select("key", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = lower.select(F.col("key").alias("root"), F.col("root").alias("above"))
        now = lower.join(up, "root").select("key", "old", F.least("root", "above").alias("root")).checkpoint()
        roots = now.select("key", "root")
        if now.where("root <> old").isEmpty():
            return roots


def resolve_names(df: DataFrame, name: str = "dealer") -> DataFrame:
    """(name, canonical, n, n_variants): every spelling, the name it stands for, its rows, and the name's spellings.

    ``canonical`` is the spelling with most rows, then the smallest.  Null names are left out.
    """
    spellings = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    spellings = spellings.withColumn("key", slug("name")).checkpoint()
    linked = _components(variant_pairs(spellings.select("key").distinct()))
    rooted = spellings.join(linked, "key", "left").withColumn("root", F.coalesce("root", "key"))
    best = rooted.groupBy("root").agg(F.min(F.struct((-F.col("n")).alias("less"), "name")).alias("best"), F.count(F.lit(1)).alias("n_variants"))
    return rooted.join(best, "root").select("name", F.col("best.name").alias("canonical"), "n", "n_variants")


def canonical_names(df: DataFrame, name: str = "dealer") -> DataFrame:
    """``df`` with every spelling of ``name`` replaced by its canonical one."""
    found = resolve_names(df, name).select(F.col("name").alias("_spelling"), "canonical")
    joined = df.join(found, F.col(f"`{name}`") == F.col("_spelling"), "left")
    return joined.select(*(F.coalesce("canonical", F.col(f"`{c}`")).alias(c) if c == name else F.col(f"`{c}`") for c in df.columns))
