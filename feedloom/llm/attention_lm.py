"""Language-model scoring: causal self-attention over subword ids, gating mixtures of experts.

Text is a sequence of words (A-Z lowered, split at white space), each a run of subword
ids, then one end.  The model's probability of the next subword is

    sum over k of g_k * P_k(next | previous)

P_k are ``EXPERTS`` bigram tables over the commonest subwords (rarer ones share two
classes, with their own share of the class), counted over all training documents, each
document counting for the topic nearest to its byte histogram.  From a word's last subword
they lead to the first one of the next word, counted over the running text.  The gates g are the
softmax of what causal self-attention gathers from the subwords so far, with learned
queries, keys, values and relative-position weights; values start as each subword's
evidence for each topic and are trained by gradient descent in numpy.

Corpus passes, all over whole texts:

1. Every text is tokenised once; its subword ids are written, beside its byte histogram,
   with the counts of words and subwords of the training texts, combined in each task,
   then by Spark.  The other passes read ids.  A word is its run of ids: BPE gives a word
   one run, the run spells the word, and each word's first subword alone starts with a space.
2. Topics are fitted on the byte histograms of all training documents; pairs of
   neighbouring classes are counted over the running text of each topic.
3. Training on all training documents, dealt by hash to rounds, one more for every
   doubling of the corpus.  In a round every task descends along its documents from the
   averaged gates of the round before; Spark averages by windows.
4. Scoring: overlapping windows of ``WINDOW`` subwords, of which the last ``STRIDE``
   are scored, so each subword is scored once with the others as context.

The baseline needs every word's count.  The ``FREQUENT_WORDS`` commonest go to every
task (a bounded broadcast); occurrences of the others are joined to the counts table
by Spark.  Tables of topics, experts and gates are bounded by the vocabulary.

Defined results: null and empty texts are the end alone.  A null doc_id is held out.
Rows that repeat a doc_id and text get equal results.  Without training documents
every probability is uniform.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import materialize, public_tokenizer

FOLDS = 10
EXPERTS = 8
#: Subwords with rows of their own in the tables.
CLASSES = 768
WINDOW = 32
STRIDE = 24
KEY_DIMS = 8
#: Training documents for which the rounds of training are one more than for half as many.
ROUND_DOCS = 2_048
#: Passes over all histograms that fit the topics.
TOPIC_ROUNDS = 4
FREQUENT_WORDS = 300_000
TOPIC_SAMPLE = 4_096  # documents that say where the topics start
_TRAINED_AT_ONCE = 64  # documents that a task lays end to end
_TASK_WORDS = 500_000  # different words that a task counts before it passes them on
_SHORT = 4  # ids of 16 bits in a word of 64
#: White space to the tokenizer that does not part words.
_INNER_SPACE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]").search
_BATCH = 256  # windows attended to at once
_PULLS = [10.0 * 4**i for i in range(9)]  # weights of the back-off at word borders, chosen among by the counts
_SEED = 7


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def lowered(text: str | None) -> bytes:
    """A text as UTF-8 (null: empty); bytes lower A-Z alone, and split at [\\x20\\x09-\\x0D] alone."""
    return (text or "").encode().lower()


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8."""
    return lowered(text).split()


#: What the pattern says of white space but for one space in front of something else.
_SPACE_RULES = r"|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def subword_encoder(path: str, spaced: bool = True):
    """The byte-level BPE of a ranks file; not ``spaced``: for text whose only white space is one space in front of each word."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    # the rules for other white space need look-ahead, which costs a quarter of the time
    pattern = public_tokenizers.PATTERN if spaced else public_tokenizers.PATTERN.removesuffix(_SPACE_RULES)
    return tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def subwords(encoder, word: bytes) -> list[int]:
    """Ids of a word with the space before it."""
    return encoder.encode_ordinary(" " + word.decode())


@lru_cache(maxsize=2)
def word_starts(path: str):
    """Per id of a ranks file, whether it begins with a space."""
    import numpy as np

    encoder = subword_encoder(path)
    if encoder.n_vocab >= 1 << 16:
        raise ValueError("ids are written in 16 bits; 0xFFFF and more do not fit")
    return np.array([encoder.decode_single_token_bytes(i)[:1] == b" " for i in range(encoder.n_vocab)])


def running_ids(words: list[bytes], path: str):
    """Ids of words one behind the other, as unsigned 16-bit integers.

    The tokenizer cuts in front of each space that follows anything but white space, so
    words without white space of their own are encoded in one string.
    """
    import numpy as np

    if not words:
        return np.zeros(0, "<u2")
    text = " " + b" ".join(words).decode()
    if not text.isascii() and _INNER_SPACE(text):
        return np.array([i for w in words for i in subwords(subword_encoder(path), w)], dtype="<u2")
    return np.array(subword_encoder(path, spaced=False).encode_ordinary(text), dtype="<u2")


def packed_ids(flat, begins, lengths):
    """Runs of at most ``_SHORT`` ids as one integer each."""
    import numpy as np

    key = np.zeros(len(begins), np.uint64)
    for j in range(_SHORT):
        on = slice(None) if j == 0 else np.flatnonzero(lengths > j)
        key[on] |= (flat[begins[on] + j].astype(np.uint64) + np.uint64(1)) << np.uint64(16 * j)
    return key


def word_runs(flat, starts):
    """Words in ids: begins, lengths, which are of at most ``_SHORT`` ids, these packed, which are longer, these as bytes."""
    import numpy as np

    begins = np.flatnonzero(starts[flat])
    lengths = np.diff(begins, append=len(flat))
    few = lengths <= _SHORT
    short, longer = np.flatnonzero(few), np.flatnonzero(~few)
    raw, at = flat.tobytes(), begins[longer]
    runs = [raw[a:b] for a, b in zip((2 * at).tolist(), (2 * (at + lengths[longer])).tolist())]
    return begins, short, packed_ids(flat, begins[short], lengths[short]), longer, runs


def key_bytes(keys) -> list[bytes]:
    """Packed ids as 8 bytes; longer runs have more."""
    raw = keys.astype("<u8").tobytes()
    return [raw[i : i + 8] for i in range(0, len(raw), 8)]


class WordCounts:
    """How often a task met each word: packed ids in arrays, longer runs by their bytes."""

    def __init__(self, starts):
        import numpy as np

        self.starts, self.longer = starts, Counter()
        self.keys, self.counts, self.new = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def add(self, flat) -> None:
        import numpy as np

        _, _, keys, _, runs = word_runs(flat, self.starts)
        self.new.append(np.unique(keys, return_counts=True))
        self.longer.update(runs)
        if sum(len(k) for k, _ in self.new) > _TASK_WORDS:
            self._merge()

    def _merge(self) -> None:
        import numpy as np

        keys, back = np.unique(np.concatenate([self.keys, *(k for k, _ in self.new)]), return_inverse=True)
        counts = np.bincount(back, weights=np.concatenate([self.counts, *(n for _, n in self.new)]), minlength=len(keys))
        self.keys, self.counts, self.new = keys, counts.astype(np.int64), []

    def __len__(self) -> int:
        return len(self.keys) + len(self.longer)

    def taken(self) -> tuple[list[bytes], list[int]]:
        """Words and counts; what was counted is forgotten."""
        self._merge()
        found = key_bytes(self.keys) + list(self.longer), self.counts.tolist() + list(self.longer.values())
        self.__init__(self.starts)
        return found


# --- topics -----------------------------------------------------------------


def byte_histogram(raw: bytes):
    """Square roots of the byte shares of a lowered text: near for texts of one language or kind."""
    import numpy as np

    return np.sqrt(np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / max(1, len(raw))).astype(np.float32)


def with_histograms(training: DataFrame) -> DataFrame:
    """doc_id and byte histogram (32-bit floats; null text: null) of every document."""

    def histograms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "histogram": [None if t is None else byte_histogram(lowered(t)).tobytes() for t in batch["text"]]})

    rows = training.select("doc_id", "text")
    return rows.mapInPandas(histograms, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, histogram binary")


def laid_histograms(column):
    """Histograms of a batch as a matrix; null is all zeros."""
    import numpy as np

    return np.frombuffer(b"".join(bytes(1024) if h is None else h for h in column), np.float32).reshape(-1, 256)


def topics_of(centroids, x):
    """The nearest centroid of each histogram."""
    import numpy as np

    return np.concatenate([((centroids[None] - x[i : i + 64, None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(x), 64)] or [np.zeros(0, np.int64)])


def first_centroids(training: DataFrame, topics: int, topic_sample: int):
    """Where the topics start: k-means of the byte histograms of at most ``topic_sample`` documents, by hash."""
    import numpy as np

    # ids first: a sort of whole rows would bring topic_sample of them from every task
    ids = training.where(F.col("histogram").isNotNull()).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(topic_sample)
    sample = training.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").where(F.col("histogram").isNotNull()).select("histogram")
    x = laid_histograms(r.histogram for r in sample.limit(topic_sample).collect())
    if not len(x):
        return np.zeros((topics, 256), np.float32)
    rng = np.random.default_rng(_SEED)
    centers = [x[0]]
    for _ in range(topics - 1):  # far apart to begin with
        d = np.min([((x - c) ** 2).sum(axis=1) for c in centers], axis=0)
        centers.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[0])
    centers = np.array(centers)
    for _ in range(12):
        own = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
        centers = np.array([x[own == k].mean(axis=0) if (own == k).any() else centers[k] for k in range(topics)])
    return centers


def topic_centroids(training: DataFrame, topics: int = EXPERTS, rounds: int = TOPIC_ROUNDS, topic_sample: int = TOPIC_SAMPLE):
    """Centroids of the byte histograms of all training documents; a sample only says where k-means starts."""
    import numpy as np

    if "histogram" not in training.columns:
        training = with_histograms(training)
    centers = first_centroids(training, topics, topic_sample)
    for _ in range(rounds):
        now = centers

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((topics, 257))
            for batch in batches:
                x = laid_histograms(batch["histogram"])
                own = topics_of(now, x)
                for k in range(topics):
                    total[k, :-1] += x[own == k].sum(axis=0, dtype=np.float64)
                total[:, -1] += np.bincount(own, minlength=topics)
            place = np.flatnonzero(total)
            yield pd.DataFrame({"place": place, "x": total.ravel()[place]})

        found = training.where(F.col("histogram").isNotNull()).select("histogram").mapInPandas(sums, "place int, x double")
        added = found.groupBy("place").agg(F.sum("x").alias("x")).toPandas()
        total = np.zeros((topics, 257))
        total.ravel()[added["place"].to_numpy(dtype=np.int64)] = added["x"].to_numpy(dtype=np.float64)
        n = total[:, -1:]
        centers = np.where(n > 0, total[:, :-1] / np.maximum(n, 1), now).astype(np.float32)
    return centers


# --- ids and counts ---------------------------------------------------------


def encoded_documents(docs: DataFrame, ranks: str) -> DataFrame:
    """Every document's ids, and the counts of the training documents' words and subwords; for one pass over the texts.

    A row has either ``ids`` (a document: row, doc_id, text_key, deal, trained, histogram
    of a training document), a ``word`` and how often a task met it, or a ``subword`` and
    how often.  Ids are little-endian unsigned 16-bit integers; a word is its packed ids
    or, if longer, its run of ids.
    """
    import pyarrow as pa

    docs = docs.select("doc_id", "text")
    keyed = docs.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
        F.xxhash64("doc_id", "text").alias("deal"),
        (~held_out(F.col("doc_id"))).alias("trained"),
        "text",
    )
    own = ["row", "doc_id", "text_key", "deal", "trained"]
    schema = f"row bigint, doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key bigint, deal bigint, trained boolean, histogram binary, ids binary, word binary, subword int, n bigint"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        starts = word_starts(ranks)
        seen, subword = WordCounts(starts), np.zeros(len(starts), np.int64)
        types = None

        def rows(**columns):
            return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(len(columns["n"]), t) for c, t in types.items()], names=list(types))

        def words():
            runs, n = seen.taken()
            return rows(word=runs, n=n)

        for batch in batches:
            if types is None:
                types = {c: batch.schema.field(c).type for c in own} | {"histogram": pa.binary(), "ids": pa.binary(), "word": pa.binary(), "subword": pa.int32(), "n": pa.int64()}
            ids, histograms, learned = [], [], []
            for text, learn in zip(batch.column("text").to_pylist(), batch.column("trained").to_pylist()):
                raw = lowered(text)
                flat = running_ids(raw.split(), ranks)
                ids.append(flat.tobytes())
                histograms.append(byte_histogram(raw).tobytes() if learn and text is not None else None)
                if learn:
                    learned.append(flat)
            if learned:
                flat = np.concatenate(learned)
                seen.add(flat)
                subword += np.bincount(flat, minlength=len(subword))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(histograms, pa.binary()), pa.array(ids, pa.binary()), *(pa.nulls(len(ids), types[c]) for c in ("word", "subword", "n"))], names=list(types))
            if len(seen) > _TASK_WORDS:
                yield words()
        if types is not None:
            met = np.flatnonzero(subword)
            yield words()
            yield rows(subword=met, n=subword[met])

    return keyed.mapInArrow(encode, schema)


def pair_counts(training: DataFrame, centroids, class_of):
    """Counts by topic, class and next class over the running text of all training documents.

    The last class is the edge: a document's start as previous, its end as next.
    """
    import numpy as np

    width = CLASSES + 3
    sent = training.sparkSession.sparkContext.broadcast((centroids, class_of))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centroids, class_of = sent.value
        total = np.zeros(EXPERTS * width * width, np.int64)
        for batch in batches:
            if not len(batch):
                continue
            previous, following, lengths = laid_classes(class_of, width - 1, [np.frombuffer(x, "<u2") for x in batch["ids"]])
            topic = np.repeat(topics_of(centroids, laid_histograms(batch["histogram"])), lengths)
            place, n = np.unique((topic.astype(np.int32) * width + previous) * width + following, return_counts=True)
            total[place] += n
        place = np.flatnonzero(total)
        yield pd.DataFrame({"place": place, "n": total[place]})

    found = training.select("ids", "histogram").mapInPandas(pairs, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    sent.destroy()
    counts = np.zeros(EXPERTS * width * width, np.int64)
    counts[found["place"].to_numpy(dtype=np.int64)] = found["n"].to_numpy(dtype=np.int64)
    return counts.reshape(EXPERTS, width, width)


# --- model ------------------------------------------------------------------


@dataclass
class Model:
    """Tables over subword classes; class ``len(classes)`` is other first subwords, the next other inner ones, the last start and end."""

    class_of: object  # int32 per subword id
    share: object  # natural log of an id's share of its class, float64 per id
    experts: object  # (classes * classes, EXPERTS): P_k(next | prev)
    query: object  # (classes, KEY_DIMS)
    key: object  # (classes, KEY_DIMS)
    value: object  # (classes, EXPERTS): what a subword adds to the gates
    bias: object  # (EXPERTS,)
    nearness: object  # (WINDOW,): by distance

    @property
    def classes(self) -> int:
        return len(self.value)

    def gates_of(self):
        """The trained parameters as one vector."""
        import numpy as np

        return np.concatenate([x.ravel() for x in (self.query, self.key, self.value, self.bias, self.nearness)])

    def with_gates(self, flat) -> Model:
        """A copy with the trained parameters taken from a vector."""
        import numpy as np

        parts, at = [], 0
        for x in (self.query, self.key, self.value, self.bias, self.nearness):
            parts.append(np.asarray(flat[at : at + x.size], dtype=np.float32).reshape(x.shape))
            at += x.size
        return Model(self.class_of, self.share, self.experts, *parts)


def build_model(training: DataFrame, centroids, subword_counts, starts) -> Model:
    """Expert tables and untrained gates.

    ``subword_counts``: per id, over the training documents; ``starts``: per id, whether it
    begins with a space.  What reaches the driver is bounded by the classes.
    """
    import numpy as np

    n = subword_counts.astype(np.float64)
    common = np.argsort(-n, kind="stable")[:CLASSES]
    width = CLASSES + 3
    class_of = np.where(starts, CLASSES, CLASSES + 1).astype(np.int32)
    class_of[common] = np.arange(CLASSES, dtype=np.int32)
    total = np.bincount(class_of, weights=n + 0.01, minlength=width)
    share = np.log((n + 0.01) / total[class_of])
    share[common] = 0.0

    running = pair_counts(training, centroids, class_of)
    first = np.append(starts[common], [True, False, True])  # classes behind a border
    borders = running * first
    # within words: the edge leads to a word's first subword, its last one to the edge, a document's end from edge to edge
    inside = running * ~first
    inside[:, -1] = borders.sum(axis=1)
    inside[:, :-1, -1] = borders[:, :-1].sum(axis=2)
    return _tables(inside.astype(np.float32), class_of, share, starts, common, borders.astype(np.float32))


def pulled(n, back):
    """Rows of counts as distributions, pulled towards ``back`` by the weight under which each
    count is best foretold by the others (leave-one-out), over all rows."""
    import numpy as np

    row = n.sum(axis=-1, keepdims=True)
    at = n > 0
    held, rows, behind = n[at], np.broadcast_to(row, n.shape)[at], np.broadcast_to(back, n.shape)[at]

    def told(weight: float) -> float:
        return float((held * np.log((held - 1 + weight * behind) / (rows - 1 + weight))).sum(dtype=np.float64))

    weight = max(_PULLS, key=told)
    return (n + weight * back) / (row + weight)


def _tables(counts, class_of, share, starts, common, borders=None) -> Model:
    """``counts`` within words, ``borders`` from the last class of a word to the first of the next (edge: a document's start, its end)."""
    import numpy as np

    width, edge = counts.shape[1], counts.shape[1] - 1  # edge: start of a word as prev, its end as next
    first = np.append(starts[common], [True, False, True])  # classes that a word (or the text's end) starts with
    inner = ~first
    inner[edge] = True  # as next, the end of the word
    rng = np.random.default_rng(_SEED)

    def smoothed(n, back, weight):
        return (n + weight * back) / (n.sum(axis=-1, keepdims=True) + weight)

    def spread(n, allowed):
        return (n + 0.5) * allowed / ((n + 0.5) * allowed).sum()

    everywhere = counts.sum(axis=0)
    begin = spread(everywhere[edge] * first, first)
    go_on = spread(everywhere[:edge].sum(axis=0) * inner, inner)
    backs = smoothed(everywhere[:edge] * inner, go_on, 20.0)
    experts = np.zeros((width, width, len(counts)), np.float32)
    for k, n in enumerate(counts):
        begins = smoothed(n[edge] * first, begin, 50.0)
        table = smoothed(n[:edge] * inner, backs, 20.0)
        # after a word's last subword: its end, then, given that subword, the first of the next word or the text's end
        across = np.broadcast_to(begins, (width, width)) if borders is None else pulled(borders[k] * first, begins)
        experts[:edge, :, k] = table * (np.arange(width) != edge) + table[:, edge : edge + 1] * across[:edge]
        experts[edge, :, k] = across[edge]
    by_topic = counts.sum(axis=1) + 1.0
    evidence = np.log(by_topic / by_topic.sum(axis=1, keepdims=True))
    evidence = (evidence - evidence.mean(axis=0)).T.astype(np.float32)
    evidence[edge] = 0
    prior = np.log(by_topic.sum(axis=1) / by_topic.sum()).astype(np.float32)
    small = lambda *shape: (0.05 * rng.normal(size=shape)).astype(np.float32)
    return Model(class_of, share, experts.reshape(width * width, -1), small(width, KEY_DIMS), small(width, KEY_DIMS), 4 * np.clip(evidence, -3, 3), prior, np.zeros(WINDOW, np.float32))


def windows(lengths):
    """Index of the first scored subword, its document's bounds, for windows over documents laid end to end."""
    import numpy as np

    ends = np.cumsum(lengths)
    begins = ends - lengths
    per = -(-lengths // STRIDE)
    doc = np.repeat(np.arange(len(lengths)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return begins[doc] + number * STRIDE, begins[doc], ends[doc], doc


def attend(model: Model, previous, following, at, begin, end):
    """Forward pass over a batch of windows; returns what training needs, probabilities last."""
    import numpy as np

    context = at[:, None] + np.arange(STRIDE - WINDOW, STRIDE)
    there = (context >= begin[:, None]) & (context < end[:, None])
    context *= there
    # what is not there has a row of zeros behind the classes'
    tokens = previous.take(context).astype(np.intp)
    tokens[~there] = model.classes
    asked, scored = tokens[:, WINDOW - STRIDE :], there[:, WINDOW - STRIDE :]
    # a column of ones sums the weights in the product with the values
    keys, queries = (np.concatenate((x, np.zeros((1, x.shape[1]), np.float32))) for x in (model.key, model.query))
    values = np.zeros((model.classes + 1, model.value.shape[1] + 1), np.float32)
    values[:-1, :-1], values[:-1, -1] = model.value, 1
    q, k, v = queries.take(asked, axis=0), keys.take(tokens, axis=0), values.take(tokens, axis=0)
    weight = np.matmul(q, k.transpose(0, 2, 1))
    weight += _distance_bias(model)
    np.exp(weight, out=weight)
    summed = np.matmul(weight, v)
    total = summed[:, :, -1:] + 1e-30
    attended = summed[:, :, :-1] / total
    gates = attended + model.bias
    np.minimum(gates, 60, out=gates)
    np.exp(gates, out=gates)
    target = following.take(context[:, WINDOW - STRIDE :])
    place = asked * scored
    place *= model.classes
    place += target
    mixed = model.experts.take(place, axis=0)
    mixed *= gates
    one = np.ones(gates.shape[2], np.float32)
    share = (gates.reshape(-1, len(one)) @ one + 1e-30).reshape(scored.shape)
    p = (mixed.reshape(-1, len(one)) @ one).reshape(scored.shape) / share
    return tokens, asked, scored, q, k, v, weight, total, attended, gates, share, mixed, p


def _distance_bias(model: Model):
    """Weights by distance, minus infinity for what is not yet written: (STRIDE, WINDOW)."""
    import numpy as np

    return np.append(model.nearness, np.float32(-np.inf))[_distances()]


@lru_cache(maxsize=1)
def _distances():
    """From each scored subword of a window back to each of its subwords; WINDOW for those behind it."""
    import numpy as np

    distance = (np.arange(STRIDE) + WINDOW - STRIDE)[:, None] - np.arange(WINDOW)[None, :]
    return np.where(distance >= 0, distance, WINDOW)


def text_scores(model: Model, previous, following, lengths):
    """Natural log-probability of each document's classes."""
    import numpy as np

    at, begin, end, doc = windows(lengths)
    out = np.zeros(len(lengths))
    for i in range(0, len(at), _BATCH):
        part = slice(i, i + _BATCH)
        _, _, scored, *_, p = attend(model, previous, following, at[part], begin[part], end[part])
        logs = np.log(np.maximum(p, 1e-30), where=scored, out=np.zeros_like(p))
        np.add.at(out, doc[part], logs.sum(axis=1, dtype=np.float64))
    return out


class Descent:
    """Adam on the gates of a model, over as many runs of documents as come."""

    def __init__(self, model: Model, rate: float = 0.02):
        import numpy as np

        self.model, self.rate = model, rate
        self.flat = model.gates_of().astype(np.float64)
        self.first, self.second, self.steps, self.windows = np.zeros_like(self.flat), np.zeros_like(self.flat), 0, 0
        self.rng = np.random.default_rng(_SEED)

    def run(self, previous, following, lengths) -> None:
        """One epoch over documents laid end to end."""
        import numpy as np

        at, begin, end, _ = windows(lengths)
        self.windows += len(at)
        distance = _distances().ravel()
        order = self.rng.permutation(len(at))
        for i in range(0, len(order), _BATCH):
            part = order[i : i + _BATCH]
            m = self.model.with_gates(self.flat)
            tokens, asked, scored, q, k, v, weight, total, attended, gates, share, mixed, p = attend(m, previous, following, at[part], begin[part], end[part])
            each = scored / (share * max(1, int(scored.sum())))
            d_gates = gates * each[:, :, None]
            mixed *= (each / np.maximum(p, 1e-30))[:, :, None]
            d_gates -= mixed
            # by the weights before they were divided by their total: what a weight pulls is its
            # value's part less that of what was attended to; absent subwords have zeros in v
            d_summed = np.empty(v.shape[:1] + d_gates.shape[1:2] + v.shape[2:], np.float32)
            np.divide(d_gates, total, out=d_summed[:, :, :-1])
            np.einsum("bij,bij->bi", d_summed[:, :, :-1], -attended, out=d_summed[:, :, -1])
            d_score = np.matmul(d_summed, v.transpose(0, 2, 1))
            d_score *= weight
            grads = [
                _scattered(asked, np.matmul(d_score, k), m.classes),
                _scattered(tokens, np.matmul(d_score.transpose(0, 2, 1), q), m.classes),
                _scattered(tokens, np.matmul(weight.transpose(0, 2, 1), d_summed[:, :, :-1]), m.classes),
                np.ones(scored.size, np.float32) @ d_gates.reshape(scored.size, -1),
                np.bincount(distance, weights=np.ones(len(d_score), np.float32) @ d_score.reshape(len(d_score), -1), minlength=WINDOW)[:WINDOW],
            ]
            g = np.concatenate([x.ravel() for x in grads])
            self.steps += 1
            self.first *= 0.9
            self.first += 0.1 * g
            g *= g
            self.second *= 0.99
            g *= 0.01
            self.second += g
            np.sqrt(self.second, out=g)
            g /= (1 - 0.99**self.steps) ** 0.5
            g += 1e-8
            np.divide(self.first, g, out=g)
            g *= self.rate / (1 - 0.9**self.steps)
            self.flat -= g


def descend(model: Model, previous, following, lengths, rate: float = 0.02, epochs: int = 1):
    """Train the gates on documents laid end to end; returns them as one vector."""
    descent = Descent(model, rate)
    for _ in range(epochs):
        descent.run(previous, following, lengths)
    return descent.flat


def _scattered(rows, values, n: int):
    """Sums of ``values`` by the row of a table of ``n`` that they belong to; those of row n are left out."""
    import numpy as np

    flat = rows.ravel()
    return np.stack([np.bincount(flat, weights=x, minlength=n + 1)[:n] for x in np.ascontiguousarray(values.reshape(len(flat), -1).T, dtype=np.float64)], axis=1)


def laid_classes(class_of, edge: int, ids: list):
    """(previous, following, lengths) of documents given as id arrays: classes end to end, an edge at each document's start and end."""
    import numpy as np

    lengths = np.array([len(x) for x in ids], dtype=np.int64)
    flat = class_of[np.concatenate(ids)] if len(ids) else np.zeros(0, np.int32)
    slot = np.arange(len(flat)) + np.repeat(np.arange(len(ids)), lengths)
    previous = np.full(len(flat) + len(ids), edge, np.int32)
    following = previous.copy()
    following[slot] = previous[slot + 1] = flat
    # a document's first place follows an edge
    previous[np.cumsum(lengths + 1) - (lengths + 1)] = edge
    return previous, following, lengths + 1


def class_sequence(model: Model, ids: list):
    """(previous, following, lengths) of documents given as id arrays."""
    return laid_classes(model.class_of, model.classes - 1, ids)


def training_rounds(n_docs: int) -> int:
    """Rounds that build on each other: one more for every doubling of the training documents."""
    return max(2, 1 + int(n_docs // ROUND_DOCS).bit_length())


def train_gates(training: DataFrame, model: Model, ranks: str, n_docs: int) -> Model:
    """Gates after all rounds; every training document is in one of them."""
    import numpy as np

    if "ids" not in training.columns:
        training = encoded_documents(training, ranks).where("ids IS NOT NULL")
    rounds = training_rounds(n_docs)
    spark = training.sparkSession
    for number in range(rounds):
        sent = spark.sparkContext.broadcast(model)
        rate = 0.02 / (1 + number) ** 0.5

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            descent = Descent(sent.value, rate)
            for batch in batches:
                for at in range(0, len(batch), _TRAINED_AT_ONCE):
                    laid = [np.frombuffer(x, "<u2") for x in batch["ids"].iloc[at : at + _TRAINED_AT_ONCE]]
                    descent.run(*class_sequence(descent.model, laid))
            if descent.windows:
                yield pd.DataFrame({"place": np.arange(len(descent.flat)), "x": descent.flat * descent.windows, "n": descent.windows})

        share = training.where(F.pmod("deal", F.lit(rounds)) == number).select("ids")
        fitted = share.mapInPandas(fit, "place int, x double, n bigint")
        mean = fitted.groupBy("place").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas().sort_values("place")["x"].to_numpy()
        sent.destroy()
        if len(mean):
            model = model.with_gates(mean)
    return model


# --- scoring ----------------------------------------------------------------


@dataclass
class Frequent:
    """The commonest words, as runs of ids, and the baseline's log10 probabilities.

    Packed ids ascend; the longer runs' places are behind theirs.
    """

    keys: object  # uint64
    longer: dict[bytes, int]  # place of the log
    log_base: object  # one more: 0 for the words that are not here


def frequent_words(words: list[bytes], log_base) -> Frequent:
    """``words``: packed ids or longer runs of ids."""
    import numpy as np

    few = np.array([len(w) == 8 for w in words], dtype=bool)
    short, others = np.flatnonzero(few), np.flatnonzero(~few)
    keys = np.frombuffer(b"".join(w for w in words if len(w) == 8), "<u8")
    order = np.argsort(keys)
    return Frequent(keys[order], {words[i]: len(short) + k for k, i in enumerate(others.tolist())}, np.concatenate((log_base[short[order]], log_base[others], [0.0])))


def scored_texts(model: Model, frequent: Frequent, starts, ids: list[bytes]):
    """(n_words, known, base of frequent words, score) arrays; which texts have which rarer words how often, as three lists."""
    import numpy as np

    n = len(ids)
    each = [np.frombuffer(x, "<u2") for x in ids]
    flat = np.concatenate(each)
    doc = np.repeat(np.arange(n), [len(x) for x in each])
    log = text_scores(model, *class_sequence(model, each))
    log += np.bincount(doc, weights=model.share[flat], minlength=n)
    begins, short, packed, longer, runs = word_runs(flat, starts)
    of = doc[begins]
    place = np.full(len(begins), -1)  # the last of the logs, 0
    key, back = np.unique(packed, return_inverse=True)
    if len(frequent.keys):
        near = np.minimum(np.searchsorted(frequent.keys, key), len(frequent.keys) - 1)
        place[short] = np.where(frequent.keys[near] == key, near, -1)[back]
    place[longer] = [frequent.longer.get(run, -1) for run in runs]
    n_words = np.bincount(of, minlength=n)
    known = np.bincount(of, weights=place >= 0, minlength=n).astype(np.int64)
    base = np.bincount(of, weights=frequent.log_base[place], minlength=n)
    rare = np.flatnonzero(place[short] < 0)
    pair, times = np.unique(of[short[rare]] * max(1, len(key)) + back[rare], return_counts=True)
    who, what = np.divmod(pair, max(1, len(key)))
    others = Counter((d, run) for d, run, at in zip(of[longer].tolist(), runs, place[longer].tolist()) if at < 0)
    return n_words, known, base, log / np.log(10), who.tolist() + [d for d, _ in others], key_bytes(key[what]) + [run for _, run in others], times.tolist() + list(others.values())


def lm_scores(docs: DataFrame, ranks: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs``."""
    import numpy as np
    import pyarrow as pa

    spark = docs.sparkSession
    starts = word_starts(ranks)
    encoded = materialize(encoded_documents(docs, ranks), "encoded")
    every = encoded.where("ids IS NOT NULL")
    training = every.where("trained")
    # a task has each word about once: nothing to combine before the shuffle
    totals = materialize(encoded.where("word IS NOT NULL").select("word", "n").repartition("word").groupBy("word").agg(F.sum("n").alias("c")), "word-totals")
    n_docs = training.count()
    n, v = totals.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + n_docs, v + (n_docs > 0)
    floor = float(np.log10(n + 0.1 * (v + 1)))

    met = encoded.where("subword IS NOT NULL").groupBy("subword").agg(F.sum("n").alias("n")).toPandas()
    subword_counts = np.zeros(len(starts), np.int64)
    subword_counts[met["subword"].to_numpy(dtype=np.int64)] = met["n"].to_numpy(dtype=np.int64)
    model = build_model(training, topic_centroids(training), subword_counts, starts)
    model = train_gates(training, model, ranks, n_docs)

    # the count from which words are few enough: found on a histogram of 8 steps per doubling
    steps = totals.groupBy(F.floor(8 * F.log2("c")).alias("step")).count().orderBy(F.desc("step")).collect()
    taken, least = 0, None
    for r in steps:
        taken += r["count"]
        if taken > FREQUENT_WORDS:
            break
        least = r.step
    often = totals.where(F.floor(8 * F.log2("c")) >= F.lit(least) if least is not None else F.lit(False)).toArrow()
    frequent = frequent_words(often.column("word").to_pylist(), np.log10(often.column("c").to_numpy().astype(np.float64) + 0.1) - floor)
    del often
    sent = spark.sparkContext.broadcast((model, frequent))

    columns = {"row": "bigint", "n_words": "bigint", "known": "bigint", "base": "double", "log": "double", "word": "binary", "times": "bigint"}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, frequent = sent.value
        starts = word_starts(ranks)
        types = dict(zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64())))

        def rows(found: dict):
            return pa.RecordBatch.from_arrays([pa.array(found[c], t) if c in found else pa.nulls(len(found["row"]), t) for c, t in types.items()], names=list(types))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                row = part.column("row").to_numpy()
                n_words, known, base, log, who, word, times = scored_texts(model, frequent, starts, part.column("ids").to_pylist())
                yield rows({"row": row, "n_words": n_words, "known": known, "base": base, "log": log})
                yield rows({"row": row[who], "word": word, "times": times} if who else {"row": []})

    both = materialize(every.select("row", "ids").mapInArrow(score, ", ".join(f"{c} {t}" for c, t in columns.items())), "scored")
    rare = both.where("n_words IS NULL").join(totals, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - floor)).alias("more_base"),
    )
    each = every.select("row", F.col("doc_id").cast("string").alias("id"), "text_key").join(both.where("n_words IS NOT NULL").select("row", "n_words", "known", "base", "log"), "row").join(rare, "row", "left")
    # rows that repeat a document get one result
    found = each.groupBy("id", "text_key").agg(F.count("*").alias("rows"), *(F.first(x).alias(x) for x in ("n_words", "known", "base", "log", "more_known", "more_base")))
    end = float(np.log10(n_docs + 0.1) - floor)
    found = found.select(
        F.explode(F.array_repeat(F.col("id").cast("bigint"), F.col("rows").cast("int"))).alias("doc_id"),
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + int(n_docs > 0)).cast("bigint").alias("n_known"),
        F.lit(int(n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + end).alias("base_score"),
        F.col("log").alias("score"),
    )
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_lm(documents: DataFrame) -> DataFrame:
    """Log10 probabilities of every whole text, by the model and by the word baseline."""
    return lm_scores(documents, public_tokenizer("byte_bpe_50k.tiktoken"))
