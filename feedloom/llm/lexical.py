"""Ranked lexical search: term at a time, rarest first, with a limited set of accumulators.

1. Each document becomes one row: its number of terms, and the ids and frequencies of
   those terms that some query holds.  Counts over all documents follow from these
   rows (documents, terms, documents per term), combined per task and then by Spark.
2. A task reads its documents in shards of bounded size and inverts each shard.  Per
   query it walks the posting lists, rarest term first.  A document met for the first
   time gets an accumulator as long as the bounds of the remaining terms, summed, can
   still reach the k-th best partial score.  From then on no document outside can
   enter: the remaining terms only update the survivors, each exactly, and short sets
   of survivors are looked up in long posting lists by bisection.
3. Shards send their k best of each query on; Spark ranks them.

Queries are taken in blocks of about ``BLOCK_CHARS`` code points of text (at least one
query), so what a task is told does not grow with the query table; each block reads
all documents.

Terms are the maximal matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z
lower-cased.  With N documents that hold a term, L terms in all, n terms in a document,
df documents with the term and tf its occurrences, a term weighs
w = floor(1000 ln((2N + 2) / (2 df + 1))), and a document scores the sum of
w * (10^9 tf div (1000 tf + 8 m)), m = 10 + 90 n N div L, over the query's terms.

Defined results: null and empty texts hold no terms.  Every document row counts and is
scored by itself, repeated rows too; rows without a doc_id count, but are not returned.
Query rows without an item_id are left out; rows with the same item_id are one query
with the terms of all.  Only scores above 0 are returned; equal scores go by doc_id.
Empty tables give empty results; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from feedloom.llm.common import materialize
from feedloom.llm.vectors import best_of_row

K = 10
#: Code points of query text in a block of queries.
BLOCK_CHARS = 8_000_000
#: Documents and postings of a shard, whichever is reached first.
SHARD_DOCS = 32_768
SHARD_POSTINGS = 4_000_000
#: Survivors are bisected into a posting list this many times as long; else the list is scanned.
_BISECT = 8

# every byte that is no part of a term becomes a blank, A-Z become a-z; bytes above 0x7F are parts of non-ASCII letters
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b > 0x7F else 32 for b in range(256))


def split_terms(text: str | None) -> list[bytes]:
    """All terms of a text in order, as UTF-8."""
    return (text or "").encode().translate(_TERM_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@F.pandas_udf(ArrayType(StringType()))
def _different_terms(texts: pd.Series) -> pd.Series:
    return pd.Series([sorted({w.decode() for w in split_terms(t)}) for t in texts], dtype=object)


def query_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""
    known = items.where("item_id IS NOT NULL")
    return known.select("item_id", F.explode(_different_terms("text")).alias("term")).distinct()


def document_terms(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, n_terms, ids, tfs): of every document with a term, those of ``terms`` as little-endian integers."""
    ids = {t.encode(): i for i, t in enumerate(terms)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        find = ids.get
        for batch in batches:
            sizes, found, times = [], [], []
            for text in batch["text"]:
                words = split_terms(text)
                hits = np.array([i for i in map(find, words) if i is not None], dtype="<i4")
                which, tf = np.unique(hits, return_counts=True)
                sizes.append(len(words))
                found.append(which.tobytes())
                times.append(tf.astype("<i4").tobytes())
            out = pd.DataFrame({"doc_id": batch["doc_id"], "n_terms": sizes, "ids": found, "tfs": times})
            yield out[out["n_terms"] > 0]

    return docs.select("doc_id", "text").mapInPandas(count, "doc_id bigint, n_terms bigint, ids binary, tfs binary")


def document_frequencies(rows: DataFrame, n_terms: int) -> DataFrame:
    """(id, df) of the terms that occur; each task sends one row per term it met."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(np.frombuffer(b"".join(batch["ids"]), "<i4"), minlength=n_terms)
        yield pd.DataFrame({"id": np.flatnonzero(df), "df": df[df > 0]})

    return rows.select("ids").mapInPandas(count, "id int, df bigint").groupBy("id").agg(F.sum("df").alias("df"))


class Shard:
    """Some documents, inverted: per term the documents that hold it, ascending, and what each gains per weight."""

    def __init__(self, doc_ids, sizes, ids: list[bytes], tfs: list[bytes], n_docs: int, all_terms: int):
        import numpy as np

        order = np.argsort(doc_ids, kind="stable")  # ascending, so the first of equal scores is the smaller doc_id
        self.doc_ids = doc_ids[order]
        m = np.array([10 + 90 * int(n) * n_docs // all_terms for n in sizes[order]], np.int64)
        lengths = np.array([len(ids[i]) // 4 for i in order], np.int64)
        term = np.frombuffer(b"".join(ids[i] for i in order), "<i4")
        tf = np.frombuffer(b"".join(tfs[i] for i in order), "<i4").astype(np.int64)
        doc = np.repeat(np.arange(len(order), dtype=np.int32), lengths)
        gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        by_term = np.argsort(term, kind="stable")
        self.docs, self.gains = doc[by_term], gain[by_term]
        self.terms, starts = np.unique(term[by_term], return_index=True)
        self.starts = np.r_[starts, len(term)]
        self.most = np.maximum.reduceat(self.gains, starts) if len(starts) else np.empty(0, np.int64)
        self.score = np.zeros(len(order), np.int64)
        self.seen = np.zeros(len(order), bool)

    def search(self, terms, weights, k: int):
        """Rows of the k best documents with their scores, and how many accumulators were made.

        ``terms`` come rarest first.
        """
        import numpy as np

        at = np.searchsorted(self.terms, terms)
        there = (at < len(self.terms)) & (weights > 0)
        there[there] = self.terms[at[there]] == terms[there]
        at, w = at[there], weights[there]
        bounds = w * self.most[at]
        left = np.cumsum(bounds[::-1])[::-1]  # of this term and all after it
        score, seen = self.score, self.seen
        members = np.empty(0, np.int32)
        kth, closed = 0, False
        for j, t in enumerate(at):
            docs, gains = self.docs[self.starts[t] : self.starts[t + 1]], self.gains[self.starts[t] : self.starts[t + 1]]
            if not closed and left[j] < kth:
                closed = True
                members = np.sort(members)
            if not closed:
                new = docs[~seen[docs]]
                seen[new] = True
                members = np.concatenate((members, new))
                score[docs] += w[j] * gains
                if len(members) >= k:
                    kth = np.partition(score[members], len(members) - k)[len(members) - k]
            elif len(docs) > _BISECT * len(members):
                place = np.searchsorted(docs, members)
                place[place == len(docs)] = 0
                hit = docs[place] == members
                score[members[hit]] += w[j] * gains[place[hit]]
            else:
                hit = seen[docs]
                score[docs[hit]] += w[j] * gains[hit]
        members = np.sort(members)
        scores = score[members]
        score[members], seen[members] = 0, False
        best = best_of_row(scores, k)
        best = best[scores[best] > 0]
        return members[best], scores[best], len(members)


_FOUND = "item_id bigint, doc_id bigint, score bigint, accumulators bigint"


def _search_shards(rows: DataFrame, queries: list[tuple], n_docs: int, all_terms: int, k: int, shard_docs: int, shard_postings: int) -> DataFrame:
    """The k best of every query in every shard of ``rows``."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        asked = [(item, np.array(terms, np.int64), np.array(weights, np.int64)) for item, terms, weights in queries]

        def flush(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts)
            shard = Shard(rows["doc_id"].to_numpy(), rows["n_terms"].to_numpy(), rows["ids"].tolist(), rows["tfs"].tolist(), n_docs, all_terms)
            out = []
            for item, terms, weights in asked:
                who, scores, made = shard.search(terms, weights, k)
                out.append(pd.DataFrame({"item_id": item, "doc_id": shard.doc_ids[who], "score": scores, "accumulators": made}))
            return pd.concat(out)

        parts, docs, postings = [], 0, 0
        for batch in batches:
            for start in range(0, len(batch), shard_docs):
                part = batch.iloc[start : start + shard_docs]
                parts.append(part)
                docs += len(part)
                postings += sum(map(len, part["ids"])) // 4
                if docs >= shard_docs or postings >= shard_postings:
                    yield flush(parts)
                    parts, docs, postings = [], 0, 0
        if docs:
            yield flush(parts)

    return rows.where("doc_id IS NOT NULL AND length(ids) > 0").mapInPandas(search, _FOUND)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = K, block_chars: int = BLOCK_CHARS, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score, accumulators) of every item's k best documents.

    ``accumulators`` is how many the document's shard made for the query.
    """
    from pyspark.sql import Window

    spark = docs.sparkSession
    chars = items.where("item_id IS NOT NULL").agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    found = []
    for number in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number)
        pairs = query_terms(mine).collect()  # of about block_chars code points of text
        if not pairs:
            continue
        terms = sorted({p.term for p in pairs})
        rows = materialize(document_terms(docs, terms), "document-terms")
        n_docs, all_terms = rows.agg(F.count("*"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        number_of = {t: i for i, t in enumerate(terms)}
        df = {r.id: r.df for r in document_frequencies(rows, len(terms)).collect()}  # at most one row per term of the block
        asked: dict[int, list] = {}
        for item, term in pairs:
            i = number_of[term]
            if i in df:
                asked.setdefault(item, []).append((df[i], i))
        queries = []
        for item, own in sorted(asked.items()):
            own.sort()  # rarest first
            queries.append((item, [i for _, i in own], [weight(n_docs, d) for d, _ in own]))
        found.append(_search_shards(rows, queries, n_docs, all_terms, k, shard_docs, shard_postings))
    if not found:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint, accumulators bigint")
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score", "accumulators")


def op12_lexical(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every benchmark item's 10 highest-scoring documents."""
    return lexical_search(documents, benchmark).select("item_id", "rank", "doc_id", "score")


OP12_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS row_no, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row_no, doc_id, terms, len(terms)::BIGINT AS n FROM words WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS all_terms FROM docs),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL),
postings AS (
  SELECT row_no, doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT row_no, doc_id, n, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
  FROM postings, totals WHERE term IN (SELECT term FROM asked) GROUP BY term, n_docs),
scored AS (
  SELECT item_id, row_no, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // all_terms)))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term), totals
  WHERE doc_id IS NOT NULL GROUP BY item_id, row_no, doc_id),
best AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= 10
"""
