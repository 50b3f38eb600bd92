"""Helpers shared by the training-data operators: tables, shared folders, tokenisation."""

from __future__ import annotations

import re
import uuid
from functools import lru_cache
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.session import BATCH_BYTES, bound_batches, ensure_checkpoint_dir  # noqa: F401

#: Distinct chunks that one Python worker remembers while encoding (about 200 bytes each).
MEMO_ENTRIES = 800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, through Spark's reader; Python workers get it in bounded batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def packed(df: DataFrame) -> DataFrame:
    """Each row as one struct ``row``: whatever its columns are called, they clash with nothing."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def public_tokenizer(name: str) -> str:
    """Path of a public tokenizer file; present on every machine beside the library."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizers library's object for a file, once per Python worker; one thread, no cuts or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class ByteBpeEncoder:
    """Whole-text ids of a byte-level BPE file, remembering the ids of space-separated chunks.

    Byte-level pre-tokenisation never lets a piece run across the place before a
    single space or newline that stands between two other characters.  There the
    text may be cut and the parts encoded apart, by the tokenizers library, with
    their leading space or newline.  Chunks repeat, so the ids of the first
    ``MEMO_ENTRIES`` are kept.  New chunks are encoded some dozens to a string; a
    chunk starts where a token starts with the space (or is the newline).  A text
    with any other run of white space, or with the string of an added token, is
    encoded by the library in one piece.
    """

    def __init__(self, path: str):
        import numpy as np

        self.tok = load_tokenizer(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        space, newline = (self.tok.encode(c, add_special_tokens=False).tokens[0][0] for c in (" ", "\n"))
        self.starts = {" ": np.zeros(max(vocab.values()) + 1, bool), "\n": np.zeros(max(vocab.values()) + 1, bool)}
        for t, i in vocab.items():
            self.starts[" "][i], self.starts["\n"][i] = t[0] == space, t[0] == newline
        self.first = len(self.tok.encode("\n", add_special_tokens=False).ids)
        self.memo: dict[str, bytes] = {}

    def _encode_apart(self, chunks: list[str], lead: str) -> dict[str, bytes]:
        """Ids of chunks, each behind a space (or starting with its newline), a few dozen to a string."""
        import numpy as np

        joined = ["".join(chunks[i : i + 64]) if lead == "\n" else " " + " ".join(chunks[i : i + 64]) for i in range(0, len(chunks), 64)]
        ids = np.array([i for e in self.tok.encode_batch_fast(joined, add_special_tokens=False) for i in e.ids], dtype="<u4")
        at = np.flatnonzero(self.starts[lead][ids])
        if len(at) != len(chunks) or (len(at) and at[0] != 0):
            raise ValueError("the tokenizer is not byte-level with spaces leading")
        raw = ids.tobytes()
        cuts = [*(at * 4).tolist(), len(raw)]
        return dict(zip(chunks, [raw[i:j] for i, j in zip(cuts, cuts[1:])]))

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text (null: empty) as little-endian unsigned 32-bit integers."""
        split = [("\n" + t.replace("\n", " \n")).split(" ") if t and not any(a in t for a in self.added) else [""] for t in texts]
        new = set().union(*split).difference(self.memo)
        before = len(self.memo)
        apart = list(filter(_SEPARABLE, new))
        for lead in " \n":
            self.memo.update(self._encode_apart([c for c in apart if (c[0] == "\n") == (lead == "\n")], lead))
        bad = new.difference(apart)
        ids = self.memo.__getitem__
        out = []
        for t, chunks in zip(texts, split):
            if not t:
                out.append(b"")
            elif bad and not bad.isdisjoint(chunks):
                out.append(_u4(self.tok.encode(t, add_special_tokens=False).ids))
            else:
                out.append(b"".join(map(ids, chunks))[4 * self.first :])
        if len(self.memo) > MEMO_ENTRIES:  # the oldest, found in the first texts, are the frequent ones
            for c in list(islice(reversed(self.memo), len(self.memo) - max(before, MEMO_ENTRIES))):
                del self.memo[c]
        return out


#: Chunks that text around them leaves alone: no white space at either end but the newline in front.
_SEPARABLE = re.compile(r"\n?[^\s\0](?:[^\n\0]*[^\s\0])?").fullmatch


def _u4(ids: list[int]) -> bytes:
    import numpy as np

    return np.array(ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpeEncoder:
    """The worker's encoder for a file; kept from task to task."""
    return ByteBpeEncoder(path)


#: A key with more than 1/HOT_SHARE of all rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1_000


def join_hot(rows: DataFrame, table: DataFrame, key: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with ``table``, which has one row per key and in ``count`` how many of the ``total`` rows hold it.

    Hot keys are broadcast, being few; in the join with the others no key holds more
    than 1/HOT_SHARE of the rows.  ``how``: inner or left.
    """
    hot = table.where(F.col(count) * HOT_SHARE > total)
    usual = table.where(F.col(count) * HOT_SHARE <= total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(usual, key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
