"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are taken from the whole text inside a pandas UDF, so rows stay where
they are and only texts and scores cross to Python.  Trees are grown in numpy on
feature histograms (logistic loss, second-order gains) and flattened into arrays;
scoring walks all rows of a batch through a tree level by level.

Learning reads a bounded sample: the ``max_rows`` labelled documents with the
smallest hash of their doc_id (a documented bound; scoring and statistics cover
every document).  Labels, lang, source and doc_id never enter a score.

Defined results: null and empty texts are scored (all statistics zero).  Labels that
are null, or of a doc_id that is null, teach nothing; of repeated labels the mean
counts.  A doc_id that is null is held out.  Without any usable label every score
is 0.5.  Repeated documents get equal scores; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

#: Rows learned from, at most.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5

_SENTENCE = re.compile(r"[.!?]+(?:\s|$)")
#: Byte classes that are counted, as fixed values.
_CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "stop": b".,;:",
    "shout": b"!?",
    "bar": b"|<>/\\=_~^",
    "symbol": b"#$%&*@+-",
    "bracket": b"()[]{}\"'",
    "other": bytes(range(128, 256)),
}
#: What ``statistics`` returns, in order.
FEATURES = (
    ["log_bytes", "log_words", "log_lines"]
    + [f"share_{c}" for c in _CLASSES]
    + ["word_length", "long_words", "distinct_words", "top_word", "one_letter_words", "capital_words", "shouted_words", "marked_words"]
    + ["line_length", "repeated_lines", "repeated_line_bytes", "short_lines", "open_lines", "bullet_lines", "sentence_words", "compression", "entropy"]
)


def _class_matrix():
    import numpy as np

    m = np.zeros((256, len(_CLASSES)))
    for j, members in enumerate(_CLASSES.values()):
        m[list(members), j] = 1
    return m


def statistics(text: str | None, classes) -> list[float]:
    """The document statistics of one text."""
    import numpy as np

    if not text:
        return [0.0] * len(FEATURES)
    raw = text.encode()
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts / n
    some = shares[shares > 0]
    words = raw.split()
    w = max(1, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    distinct = Counter(words)
    lines = raw.split(b"\n")
    line_counts = Counter(lines)
    again = [(line, c) for line, c in line_counts.items() if c > 1 and line]
    ends = [x[-1:] for x in lines if x]
    return [
        np.log1p(n),
        np.log1p(len(words)),
        np.log1p(len(lines)),
        *(shares @ classes),
        float(lengths.mean()),
        float((lengths > 20).mean()),
        len(distinct) / w,
        max(distinct.values(), default=0) / w,
        float((lengths == 1).mean()),
        sum(x[:1].isupper() for x in words) / w,
        sum(x.isupper() for x in words) / w,
        sum(x[-1:] in b"#$%&*@!|" for x in words) / w,
        n / len(lines),
        sum(c - 1 for _, c in again) / len(lines),
        sum(len(x) * (c - 1) for x, c in again) / n,
        sum(len(x) < 30 for x in lines) / len(lines),
        sum(x not in (b".", b"!", b"?", b":", b'"') for x in ends) / max(1, len(ends)),
        sum(x.lstrip()[:1] in (b"-", b"*") for x in lines) / len(lines),
        len(words) / max(1, len(_SENTENCE.findall(text))),
        len(zlib.compress(raw, 1)) / n,
        float(-(some * np.log2(some)).sum()),
    ]


def features(text: Column) -> Column:
    """Document statistics as array<float>, in the order of ``FEATURES``."""

    @F.pandas_udf(ArrayType(FloatType()))
    def each(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        classes = _class_matrix()
        for s in texts:
            yield pd.Series([np.asarray(statistics(t, classes), dtype=np.float32) for t in s], dtype=object)

    return each(text)


@dataclass
class Trees:
    """Flattened trees: node k of a tree sends x[feature[k]] <= threshold[k] to left[k], else to right[k]."""

    feature: object  # int (trees, nodes)
    threshold: object  # float (trees, nodes)
    left: object  # int (trees, nodes); a leaf points to itself
    right: object  # int (trees, nodes)
    value: object  # float (trees, nodes)
    base: float
    depth: int

    def score(self, x):
        """Probability of label 1 for each row of ``x``."""
        import numpy as np

        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, left, right, value in zip(self.feature, self.threshold, self.left, self.right, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = np.where(x[rows, f[node]] <= t[node], left[node], right[node])
            out += value[node]
        return 1 / (1 + np.exp(-out))


def fit_trees(x, y, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 5) -> Trees:
    """Grow trees on histograms of binned features; ``y`` in 0 to 1."""
    import numpy as np

    n, width = x.shape
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.int64) if n else np.zeros((0, width), np.int64)
    flat = binned + np.arange(width) * bins
    nodes = 2 ** (depth + 1) - 1
    shape = (trees, nodes)
    out = Trees(np.zeros(shape, np.int64), np.zeros(shape), np.tile(np.arange(nodes), (trees, 1)), np.tile(np.arange(nodes), (trees, 1)), np.zeros(shape), base, depth)
    raw = np.full(n, base)
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        members, at = {0: np.arange(n)}, np.zeros(n, np.int64)
        for k in range(nodes):
            rows = members.pop(k, None)
            if rows is None:
                continue
            at[rows] = k
            total_g, total_h = g[rows].sum(), h[rows].sum()
            out.value[t, k] = -rate * total_g / (total_h + l2)
            if 2 * k + 2 >= nodes or len(rows) < 2 * min_rows:
                continue
            cells = flat[rows].ravel()
            gs, hs, cs = (np.bincount(cells, np.repeat(v, width), minlength=width * bins).reshape(width, bins).cumsum(axis=1) for v in (g[rows], h[rows], np.ones(len(rows))))
            gain = gs**2 / (hs + l2) + (total_g - gs) ** 2 / (total_h - hs + l2) - total_g**2 / (total_h + l2)
            gain[(cs < min_rows) | (len(rows) - cs < min_rows)] = -1
            j, b = np.unravel_index(gain.argmax(), gain.shape)
            if gain[j, b] <= 1e-9 or b >= len(edges[j]):
                continue
            near = binned[rows, j] <= b
            out.feature[t, k], out.threshold[t, k] = j, edges[j][b]
            out.left[t, k], out.right[t, k] = 2 * k + 1, 2 * k + 2
            members[2 * k + 1], members[2 * k + 2] = rows[near], rows[~near]
        raw += out.value[t, at]
    return out


def held_out(doc_id: Column) -> Column:
    """Whether labels of the document are kept from learning."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Trees:
    """Trees learned from at most ``max_rows`` labelled documents outside the held-out fold."""
    import numpy as np

    taught = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.avg(F.col("quality").cast("double")).alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    # at most max_rows ids: 16 bytes each
    rows = docs.select("doc_id", "text").join(F.broadcast(taught), "doc_id")
    found = rows.select("doc_id", "y", features(F.col("text")).alias("x")).orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(max_rows).toPandas()
    x = np.array(found["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))
    return fit_trees(x, found["y"].to_numpy(dtype=np.float64))


def quality_score(text: Column, trees: Trees) -> Column:
    """Score of each text (0 to 1), statistics and trees in one pass."""

    @F.pandas_udf(DoubleType())
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        classes = _class_matrix()
        for s in texts:
            # as float32, like the rows learned from
            x = np.array([statistics(t, classes) for t in s], dtype=np.float32).reshape(-1, len(FEATURES))
            yield pd.Series(trees.score(x.astype(np.float64)))

    return score(text)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score below ``threshold``; all columns as they were."""
    trees = train(docs, labels)
    return docs.where(quality_score(F.col("text"), trees) >= threshold)


def op1_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    trees = train(documents, labels)
    scored = documents.select("doc_id", quality_score(F.col("text"), trees).alias("score"))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted")
    )
