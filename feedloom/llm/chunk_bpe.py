"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over bytes cuts a text where the content says so, wherever the passage
stands, so passages that documents share give equal chunks.  A Python worker has the
tokenizer encode a chunk once and keeps its ids; other documents, batches and tasks of
the worker take them from its store.  A cut may fall into a word, so joins are repaired:
a window around the cut, whole words on both sides, is encoded again.  It stands in for
what the chunks have there if the tokenizer's ids agree exactly on both sides:

* the left part of the window alone gives the last ids of the left chunk, the right part
  the first ids of the right chunk, so it is known which ids the window replaces;
* the outer words of the window have the same ids in it as they have in the chunks, so
  what the cut changed lies between them.

Otherwise the window grows by a word on both sides; where a chunk has no more whole words,
the whole text is encoded.  Windows always go to the tokenizer as they are.

Chunks do too, or, ``by_words``, word by word: a tokenizer that drops white space and never
looks across it gives a chunk the ids of its words, and a worker asks for each word once.
The joins then hold these ids against the tokenizer's on running text.

The store is per worker and bounded in bytes, not corpus-wide: taking ids to other
machines would shuffle every text, which costs more than encoding it (see README).

Defined results: null and empty texts have no ids and decode to ''.  A text with the
string of an added token, or without white space, is encoded in one piece.  Repeated
rows get equal results; null doc_ids stay null.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from feedloom.llm.common import MEMO_ENTRIES, load_tokenizer, public_tokenizer

WINDOW_BYTES = 32
MEAN_BYTES = 1024
MIN_BYTES = 256
MAX_BYTES = 16_384
#: Bytes of chunks and ids that a worker keeps.
STORE_BYTES = 48 << 20

_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: dict = {}


def _powers(n: int):
    """First ``n`` powers of the multiplier and of its inverse, modulo 2**64."""
    import numpy as np

    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, factor in (("up", _MULTIPLIER), ("down", pow(_MULTIPLIER, -1, 1 << 64))):
            steps = np.full(size, factor, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def cuts(data: bytes) -> list[int]:
    """Byte positions after which a chunk ends, the end of ``data`` included; never inside a character."""
    import numpy as np

    n, out, last = len(data), [], 0
    if n > WINDOW_BYTES + MIN_BYTES:
        b = np.frombuffer(data, np.uint8)
        up, down = _powers(n + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + 1) * up[:n], dtype=np.uint64)))
        window = (sums[WINDOW_BYTES:] - sums[:-WINDOW_BYTES]) * down[: n - WINDOW_BYTES + 1]
        window = (window ^ (window >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hits = np.flatnonzero((window >> np.uint64(40)) % np.uint64(MEAN_BYTES) == 0) + WINDOW_BYTES
        for at in [*hits.tolist(), n]:
            while at - last > MAX_BYTES:
                last = _whole(data, last + MAX_BYTES)
                out.append(last)
            at = _whole(data, at)
            if at < n and at - last >= MIN_BYTES:
                out.append(at)
                last = at
    if not out or out[-1] < n:
        out.append(n)
    return out


def _whole(data: bytes, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def chunks_of(text: str) -> list[str]:
    """The text's chunks; one without a space or newline goes with the next."""
    data, out, held, start = text.encode(), [], b"", 0
    for end in cuts(data):
        held += data[start:end]
        start = end
        if b" " in held or b"\n" in held:
            out.append(held.decode())
            held = b""
    if held:
        out.append((out.pop() if out else "") + held.decode())
    return out


def _word_before(chunk: str, at: int) -> int:
    """Where the white space before the last word in front of ``at`` stands; -1 if no whole word is there."""
    end = len(chunk[:at].rstrip(" \n"))
    return max(chunk.rfind(" ", 0, end), chunk.rfind("\n", 0, end))


def _word_behind(chunk: str, at: int) -> int:
    """Where the first word from ``at`` on ends; -1 if it may go on behind the chunk."""
    begin = len(chunk) - len(chunk[at:].lstrip(" \n"))
    ends = [p for p in (chunk.find(" ", begin), chunk.find("\n", begin)) if p >= 0]
    return min(ends, default=-1)


class Window:
    """Text around a cut: ``words`` whole words of both chunks and what the cut parted."""

    def __init__(self, left: str, right: str, words: int):
        inner = max(left.rfind(" "), left.rfind("\n"))
        begin = inner
        behind = min(p for p in (right.find(" "), right.find("\n")) if p >= 0)
        end = behind
        self.known = inner >= 0
        for _ in range(words):
            if self.known:
                begin, end = _word_before(left, begin), _word_behind(right, end)
                self.known = begin >= 0 and end >= 0
        if self.known:
            # a piece carries the white space in front of it, as it has it in the chunk
            self.left, self.right = left[begin:], right[:end]
            self.first, self.last = left[begin:inner], right[behind:end]
            self.pieces = (self.left, self.right, self.left + self.right)


class ChunkEncoder:
    """Encodes whole texts through a store of chunks; kept from task to task of a worker.

    Counts chunks encoded and reused, joins, windows that had to grow, and texts encoded whole.
    """

    def __init__(self, path: str, by_words: bool = False, tok=None):
        self.tok, self.by_words = tok or load_tokenizer(path), by_words
        self.words: dict[str, bytes] = {}
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.store: dict[str, bytes] = {}
        self.size = self.reused = self.encoded = self.joins = self.grown = self.whole = 0

    def _ids(self, texts) -> dict[str, bytes]:
        """The tokenizer's ids of each different text."""
        different = list(dict.fromkeys(texts))
        return dict(zip(different, (_u4(e.ids) for e in self.tok.encode_batch_fast(different, add_special_tokens=False)))) if different else {}

    def _word_ids(self, texts) -> dict[str, bytes]:
        """Ids of each different text, put together from its words'; the tokenizer is given words that are new."""
        import numpy as np

        split = {t: t.replace("\n", " ").split(" ") for t in texts}
        new = list(dict.fromkeys(w for ws in split.values() for w in ws if w and w not in self.words))
        found = self.words
        if new:
            e = self.tok.encode(new, is_pretokenized=True, add_special_tokens=False)
            raw = np.array(e.ids, dtype="<u4").tobytes()
            ends = (np.searchsorted(np.array(e.word_ids, dtype=np.int64), np.arange(len(new)), side="right") * 4).tolist()
            fresh = {w: raw[i:j] for w, i, j in zip(new, [0, *ends], ends)}
            if len(self.words) + len(fresh) <= MEMO_ENTRIES:
                self.words.update(fresh)
            else:
                found = self.words | fresh
        return {t: b"".join([found[w] for w in ws if w]) for t, ws in split.items()}

    def _apart(self, texts) -> dict[str, bytes]:
        """Ids of chunks and of words on their own."""
        return self._word_ids(texts) if self.by_words else self._ids(texts)

    def _join(self, text: str, chunks: list[str], own: list[bytes], windows: list[Window], pieces: dict[str, bytes], words: dict[str, bytes]) -> bytes:
        """Ids of a text from those of its chunks; ``windows`` are the smallest ones, ``pieces`` and ``words`` their ids."""
        parts, cut = [], 0
        for k, window in enumerate(windows):
            self.joins += 1
            size, ids, outer = 1, pieces, words
            while True:
                if not window.known:
                    return self._encode_whole(text)
                if size > 1:
                    ids, outer = self._ids(window.pieces), self._apart((window.first, window.last))
                left, right, both = (ids[p] for p in window.pieces)
                first, last = outer[window.first], outer[window.last]
                placed = own[k].endswith(left) and own[k + 1].startswith(right)
                if placed and first and last and left.startswith(first) and both.startswith(first) and right.endswith(last) and both.endswith(last):
                    break
                size += 1
                self.grown += 1
                window = Window(chunks[k], chunks[k + 1], size)
            if cut + len(left) > len(own[k]):
                return self._encode_whole(text)  # the windows of two joins meet
            parts += [own[k][cut : len(own[k]) - len(left)], both]
            cut = len(right)
        return b"".join([*parts, own[-1][cut:]])

    def _encode_whole(self, text: str) -> bytes:
        self.whole += 1
        return _u4(self.tok.encode(text, add_special_tokens=False).ids)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [chunks_of(t) if t and not any(a in t for a in self.added) else None for t in texts]
        new = list(dict.fromkeys(c for chunks in split if chunks for c in chunks if c not in self.store))
        self.encoded += len(new)
        self.reused += sum(len(c) for c in split if c) - len(new)
        fresh = self._apart(new)
        windows = [[Window(left, right, 1) for left, right in zip(chunks, chunks[1:])] if chunks else [] for chunks in split]
        known = [w for each in windows for w in each if w.known]
        pieces = self._ids(p for w in known for p in w.pieces)
        words = self._apart([x for w in known for x in (w.first, w.last)])
        out = []
        for t, chunks, joints in zip(texts, split, windows):
            if not t:
                out.append(b"")
            elif not chunks:
                out.append(self._encode_whole(t))
            else:
                out.append(self._join(t, chunks, [fresh[c] if c in fresh else self.store[c] for c in chunks], joints, pieces, words))
        self._keep(fresh)
        return out

    def _keep(self, fresh: dict[str, bytes]) -> None:
        """Store new chunks; the oldest leave when the bound is reached."""
        for c, ids in fresh.items():
            self.store[c] = ids
            self.size += len(c) + len(ids)
        while self.size > STORE_BYTES and self.store:
            c = next(iter(self.store))
            self.size -= len(c) + len(self.store.pop(c))


def _u4(ids: list[int]) -> bytes:
    import numpy as np

    return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a file whose tokenizer drops white space."""
    return ChunkEncoder(path, by_words=True)


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids) with ids as array<int>, for every whole text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encoder = chunk_encoder(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in encoder.encode_many(part["text"].tolist())]
                yield pd.DataFrame({"id": part["id"].tolist(), "ids": ids})

    found = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(run, "id string, ids array<int>")
    return found.select(F.col("id").cast("bigint").alias("doc_id"), "ids")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, ids, text) as the tokenizer decodes the ids, special tokens included."""

    @F.pandas_udf(StringType())
    def text(ids: pd.Series) -> pd.Series:
        tok = load_tokenizer(tokenizer)
        return pd.Series([tok.decode(x.tolist(), skip_special_tokens=False) for x in ids], dtype=object)

    return encoded.withColumn("text", text("ids"))


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), encoded and decoded in one pass so that ids stay in the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encoder = chunk_encoder(tokenizer)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                for doc_id, ids in zip(part["id"], encoder.encode_many(part["text"].tolist())):
                    back = encoder.tok.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
                    rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "id string, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    found = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(run, schema)
    return found.select(F.col("id").cast("bigint").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op10_chunk_bpe(documents: DataFrame) -> DataFrame:
    """Every whole text encoded and decoded with the word BPE file."""
    return digests(documents, public_tokenizer("word_bpe_49k.json"))
