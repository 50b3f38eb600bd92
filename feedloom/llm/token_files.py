"""Token-ID output: length-delimited binary records with masked checksums, and an offset index.

A file is a run of frames, in ascending doc_id order across and within files:

    length    8 bytes  little-endian unsigned, of the payload
    checksum  4 bytes  masked CRC-32 of the length's bytes
    payload            1 byte: 1 if a doc_id follows, else 0; 8 bytes doc_id; ids
    checksum  4 bytes  masked CRC-32 of the payload
    newline   1 byte   the text sink's row end

Ids are little-endian unsigned, 2 bytes where the vocabulary allows it, else 4.  The
mask (rotate right by 15, add a constant) keeps a checksum of data that itself holds
checksums from being trivial.  Frames leave Spark through its text sink, as raw bytes,
and come back through its binaryFile source, so any store that Spark knows will do.

A file holds as many records as make ``FILE_BYTES`` of average text.  The index, a
Parquet table beside the files, has a row per record (file, offset, length, doc_id,
n_tokens, start); ``read_records`` gives every reader its records in a shuffled order
from it, without scanning for frame borders.

Defined results: null and empty texts have the end id alone.  Null doc_ids come first
and are read back as null.  Repeated rows have a record each, in order of text.
Empty tables write no record.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedloom.llm.common import byte_bpe, load_tokenizer, public_tokenizer, shared_path

END_ID = 0
MASK_DELTA = 0xA282EAD8  # fixed value: the constant that masks checksums
#: Bytes of text per file aimed at, by the mean length of the texts; a file is read back whole.
FILE_BYTES = 32 << 20

_INDEX = "file string, offset bigint, length bigint, doc_id string, n_tokens bigint, ids_crc32 bigint, start_in_file bigint"


def masked(data: bytes) -> int:
    """Masked checksum of some bytes."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record as it stands in a file, without the row end."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(content: bytes, offset: int) -> tuple[bytes, int]:
    """Payload of the record at ``offset`` and where the next starts; raises if a checksum is wrong."""
    length, check = struct.unpack_from("<QI", content, offset)
    if check != masked(content[offset : offset + 8]):
        raise ValueError(f"damaged length at byte {offset}")
    payload = content[offset + 12 : offset + 12 + length]
    if len(payload) != length or struct.unpack_from("<I", content, offset + 12 + length)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {offset}")
    return payload, offset + 12 + length + 5


def id_type(tokenizer: str) -> str:
    """numpy type of ids in the files."""
    return "<u2" if load_tokenizer(tokenizer).get_vocab_size() <= 1 << 16 else "<u4"


def write_records(docs: DataFrame, path: str, tokenizer: str) -> None:
    """Encode whole texts and write one record per row below ``path``, in doc_id order."""
    kind = id_type(tokenizer)

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        encoder = byte_bpe(tokenizer)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part, out = batch.iloc[at : at + 256], []
                for doc_id, ids in zip(part["id"], encoder.encode_many(part["text"].tolist())):
                    ids = np.append(np.frombuffer(ids, "<u4"), END_ID).astype(kind).tobytes()
                    out.append(frame(struct.pack("<Bq", doc_id is not None, int(doc_id or 0)) + ids))
                yield pd.DataFrame({"frame": out})

    mean = docs.agg(F.avg(F.octet_length(F.coalesce("text", F.lit(""))))).first()[0] or 0
    per_file = max(1, int(FILE_BYTES / (mean + 32)))
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    frames = ordered.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(records, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("maxRecordsPerFile", per_file).text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_index(spark: SparkSession, path: str, index_path: str, tokenizer: str) -> DataFrame:
    """Read every file back, check each record, and write the offset index; returns it.

    ``start`` counts the ids of all records before, across files; the numbers in file
    names give the record order.
    """
    kind = id_type(tokenizer)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                at, start, rows = 0, 0, []
                while at < len(content):
                    payload, after = unframe(content, at)
                    there, doc_id = struct.unpack_from("<Bq", payload)
                    ids = np.frombuffer(payload, kind, offset=9).astype("<u4")
                    rows.append((name, at, after - at, str(doc_id) if there else None, len(ids), zlib.crc32(ids.tobytes()), start))
                    at, start = after, start + len(ids)
                yield pd.DataFrame(rows, columns=["file", "offset", "length", "doc_id", "n_tokens", "ids_crc32", "start_in_file"])

    found = _files(spark, path).mapInPandas(scan, _INDEX).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    found.write.parquet(index_path)
    index = spark.read.parquet(index_path)
    # one row per file, numbered by partition and by file of the partition; names do not sort (c1000 before c101)
    number = lambda pattern: F.regexp_extract("file", pattern, 1).cast("int")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("tokens")).select("file", "tokens", number(r"part-(\d+)").alias("part"), number(r"-c(\d+)[^/]*$").alias("place"))
    earlier = Window.unboundedPreceding
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(earlier, -1)
    parts = totals.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # one row per partition
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(earlier, -1)), F.lit(0)).alias("before"))
    bases = totals.withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(parts, "part").select("file", (F.col("before") + F.col("inside")).alias("base"))
    return index.join(bases, "file").withColumn("start", F.col("base") + F.col("start_in_file")).drop("base", "start_in_file")


def read_records(spark: SparkSession, path: str, index: DataFrame, tokenizer: str, seed: int = 0) -> DataFrame:
    """(place, doc_id, ids) of the indexed records; ordering by ``place`` gives the seed's shuffled order.

    Each file is opened once; its records are cut out at the index's offsets.
    """
    kind = id_type(tokenizer)
    wanted = index.withColumn("place", F.xxhash64("file", "offset", F.lit(seed)))

    def cut(key: tuple, files: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = []
        for content in files["content"]:
            for place, offset in zip(rows["place"], rows["offset"]):
                payload, _ = unframe(content, int(offset))
                there, doc_id = struct.unpack_from("<Bq", payload)
                out.append((place, str(doc_id) if there else None, np.frombuffer(payload, kind, offset=9).astype("int64").tolist()))
        return pd.DataFrame(out, columns=["place", "doc_id", "ids"])

    files = _files(spark, path).withColumnRenamed("path", "file")
    both = files.groupBy("file").cogroup(wanted.select("file", "place", "offset").groupBy("file"))
    return both.applyInPandas(cut, "place bigint, doc_id string, ids array<bigint>").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def op2_token_files(documents: DataFrame) -> DataFrame:
    """Write all documents' ids, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = documents.sparkSession
    tokenizer = public_tokenizer("byte_bpe_50k.json")
    path = shared_path(spark, "token-files")
    write_records(documents, f"{path}/records", tokenizer)
    return write_index(spark, f"{path}/records", f"{path}/index", tokenizer).select("doc_id", "start", "n_tokens", "ids_crc32")
