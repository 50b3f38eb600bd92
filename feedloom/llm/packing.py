"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

1. Every whole text is encoded and an end id appended.  Only documents longer than a
   sequence are cut: the remainder is the first piece, the others fill a sequence.
   One small row per piece goes on (start, length, checksum); no ids are shuffled.
2. Pieces are dealt by hash into groups of about ``group_pieces``, so the number of
   groups follows the data, copies spread evenly and a task's memory is bounded.
3. A group is packed in decreasing length.  The tree's leaves are the remaining
   capacities 0 to ``size``; an inner node knows whether an open bin lies below.  The
   tightest bin that fits is found by one walk up and one down.
4. Each group leaves at most a few sequences part-filled, as the last bins; the
   small pieces of a group fill the others.  Groups are independent, so the waste
   stays below one sequence per group beyond best fit's own.

Defined results: null text is an empty document (only the end id).  Null doc_ids are
packed like any other.  Repeated rows are each packed.  Empty tables give no piece.
Equal lengths are placed in order of (doc_id as text, piece).  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.common import byte_bpe, materialize, public_tokenizer

SEQUENCE_TOKENS = 2048
END_ID = 0
#: Pieces per group aimed at; each is about 100 bytes in the group's task.
GROUP_PIECES = 32_768

#: doc_id travels as text inside, so that null ids survive pandas.
_PIECES = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint, row bigint"


def pieces_of(total: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the remainder first, then full ones."""
    first = total % size or size
    return [(0, first), *((at, size) for at in range(first, total, size))] if total else []


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """One row per piece of every document, with the checksum of its ids."""
    end = END_ID.to_bytes(4, "little")

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = byte_bpe(tokenizer)
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                for doc_id, text_hash, ids in zip(part["doc_id"], part["row"], encoder.encode_many(part["text"].tolist())):
                    ids += end
                    for k, (start, length) in enumerate(pieces_of(len(ids) // 4, size)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), text_hash))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    row = F.xxhash64("doc_id", "text").alias("row")  # spreads and orders rows
    return docs.select(F.col("doc_id").cast("string"), "text", row).mapInPandas(encode, _PIECES)


class OpenBins:
    """Segment tree over the remaining capacities 0..size of open bins."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, number: int, room: int) -> None:
        """Open bin ``number`` has ``room`` left."""
        self.bins[room].append(number)
        node = self.leaves + room
        while node and not self.some[node]:
            self.some[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (bin, room) of the tightest bin with room for ``need``."""
        some, node = self.some, self.leaves + need
        if not some[node]:
            while node & 1 or not some[node + 1]:  # up, until a subtree to the right has a bin
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:  # down, leftmost
                node = 2 * node if some[2 * node] else 2 * node + 1
        room = node - self.leaves
        number = self.bins[room].pop()
        if not self.bins[room]:
            while node and (node >= self.leaves or not (some[2 * node] or some[2 * node + 1])):
                some[node] = 0
                node >>= 1
        return number, room


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length (already in decreasing order)."""
    open_bins, count, where, offsets = OpenBins(size), 0, [], []
    for length in lengths:
        found = open_bins.take(length) if length < size else None
        number, room = found or (count, size)
        count += found is None
        where.append(number)
        offsets.append(size - room)
        if room > length:
            open_bins.put(number, room - length)
    return where, offsets


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset; they need doc_id, piece, start, length, ids_crc32, row."""
    groups = max(1, -(-pieces.count() // group_pieces))
    order = ["length", "doc_id", "piece", "row"]

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, ascending=[False, True, True, True], kind="stable")
        number, offset = best_fit(group["length"].tolist(), size)
        first = int(group["_group"].iloc[0]) << 32  # sequence numbers of a group stay below its pieces
        return group.drop(columns=["_group", "row"]).assign(sequence_id=[first + n for n in number], offset=offset)

    out = "doc_id string, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("row", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(pack, out).withColumn("doc_id", F.col("doc_id").cast("bigint"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = SEQUENCE_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pieces of all documents with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer or public_tokenizer("byte_bpe_50k.json"), size)
    return pack_pieces(materialize(pieces, "token-pieces"), size, group_pieces)


def op4_packing(documents: DataFrame) -> DataFrame:
    """Every document packed into sequences of at most 2048 tokens."""
    return pack_documents(documents)
