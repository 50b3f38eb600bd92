"""CSV extracts by header: many files whose columns drift, in one scan per distinct header.

A load of thousands of workbooks holds few different headers.  One job reads the first
record of every file into a catalogue (file, header); files with the same header are one
scan, by position, however many they are.  What differs from file to file (new column
names, a label) is a column of the catalogue, joined by the file's path.  The number of
jobs does not depend on the number of files, and the number of scans is that of headers.

The driver holds file paths (as Spark's own file index does) and the different headers.
Files are read whole: a record may hold line breaks, so a file is not split.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# RFC 4180: quotes inside a value are doubled, and a quoted value may hold line breaks.
# A file with line breaks in values cannot be split, so large facts belong in Parquet.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}

#: Most different (header, new names) pairs that a load may have; each header is a scan of its own.
MAX_HEADERS = 10_000


class Shape(NamedTuple):
    """Files that share a header (``width`` columns) and what their columns are called."""

    header: str
    names: tuple[str, ...]
    files: list[str]


_NO_HOST = r"^([A-Za-z][A-Za-z0-9+.-]*):///"  # file:///a and file:/a are one path


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Every file below a path, spelled as by ``file_path``; a path that does not exist has none.

    Spark's file index lists them when the plan is made: no job, and no file is opened.
    """
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(re.sub(_NO_HOST, r"\1:/", unquote(f)) for f in found.inputFiles())


def file_path() -> Column:
    """The path of a row's file, readable again: Spark's metadata column is URL-encoded."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), _NO_HOST, "$1:/")


def input_order(extract: int = 0) -> Column:
    """Place of a row in the input: extract, file, split, position; to be taken on the scan itself."""
    return F.struct(
        F.lit(extract).alias("extract"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos")
    )


def _first_records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lines up to the end of each file's first record; lines come in the order of the file."""
    text, done = {}, set()
    for batch in batches:
        out = []
        for file, line in zip(batch["file"], batch["value"]):
            if file in done:
                continue
            text[file] = line if file not in text else f"{text[file]}\n{line}"
            if text[file].count('"') % 2 == 0:
                done.add(file)
                out.append((file, text.pop(file)))
        yield pd.DataFrame(out, columns=["file", "header"])
    yield pd.DataFrame(list(text.items()), columns=["file", "header"])


def read_headers(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, header): the first record of each file, as written; empty files have none.

    One linear pass over the lines finds the first of each file.  Where that line leaves a
    quote open, the record goes on: the lines of these files alone are looked at again.
    """
    lines = spark.read.text(files).where("value <> ''").select(file_path().alias("file"), "value", F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("at"))
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    first = first.select("file", F.regexp_replace("header", "^﻿", "").alias("header")).checkpoint(eager=True)
    is_open = F.length(F.regexp_replace("header", '[^"]', "")) % 2 == 1
    longer = [r.file for r in first.where(is_open).select("file").collect()]
    if not longer:
        return first
    opened = spark.read.text(longer).where("_metadata.file_block_start = 0").select(file_path().alias("file"), F.regexp_replace("value", "^﻿", "").alias("value"))
    return first.where(~is_open).unionByName(opened.where("value <> ''").mapInPandas(_first_records, "file string, header string"))


def header_names(header: str) -> list[str]:
    """The column names of a first record; unnamed columns are ``_c`` and their number."""
    record = next(csv.reader(io.StringIO(header, newline="")), [])
    return [name or f"_c{i}" for i, name in enumerate(record)]


@F.pandas_udf(ArrayType(StringType()))
def names_of(headers: pd.Series) -> pd.Series:
    return pd.Series([header_names(h) for h in headers], dtype=object)


def numbered(names: list[str]) -> tuple[str, ...]:
    """Names that differ: a second ``email`` becomes ``email_2``.  Spark does not tell cases apart, so neither does this."""
    out, taken = [], {n.lower() for n in names}
    seen: set[str] = set()
    for name in names:
        new, number = name, 1
        while new.lower() in seen or (number > 1 and new.lower() in taken):
            number += 1
            new = f"{name}_{number}"
        seen.add(new.lower())
        out.append(new)
    return tuple(out)


def shapes(catalogue: DataFrame, rename=lambda name: name) -> list[Shape]:
    """The different (header, names) of a catalogue (file, header, names) with their files, in the order of the files."""
    rows = catalogue.groupBy("header", "names").agg(F.sort_array(F.collect_list("file")).alias("files"))
    found = rows.take(MAX_HEADERS + 1)
    if len(found) > MAX_HEADERS:
        raise ValueError(f"a load has over {MAX_HEADERS} different headers")
    return sorted((Shape(r.header, numbered([rename(n) for n in r.names]), r.files) for r in found), key=lambda s: s.files[0])


def _scan(spark: SparkSession, group: list[Shape], columns: list[str], extras: list[str], labels: DataFrame | None) -> DataFrame:
    """One header's files: each output column by position, by variant where files of one header name a place differently."""
    width = len(group[0].names)
    places = [f"_place{i}" for i in range(width)]
    reader = spark.read.options(**CSV_OPTIONS).schema(", ".join(f"{p} string" for p in places))
    rows = reader.csv([f for s in group for f in s.files]).select("*", file_path().alias("_path"), input_order().alias("_row"))
    facts = spark.createDataFrame([(f, v) for v, s in enumerate(group) for f in s.files], "_path string, _variant int") if len(group) > 1 else None
    if labels is not None:
        facts = labels if facts is None else facts.join(labels, "_path")
    if facts is not None:  # the load's own list of files, which the driver holds
        rows = rows.join(F.broadcast(facts), "_path")

    def value(name: str) -> Column:
        at = [{n.lower(): i for i, n in enumerate(s.names)}.get(name.lower()) for s in group]
        if len(set(at)) == 1:
            return F.lit(None).cast("string") if at[0] is None else F.col(places[at[0]])
        cases = [(F.col("_variant") == v, F.col(places[i])) for v, i in enumerate(at) if i is not None]
        return reduce(lambda chain, case: chain.when(*case), cases[1:], F.when(*cases[0]))

    return rows.select(*(value(c).alias(c) for c in columns), *extras)


def read_by_header(spark: SparkSession, found: list[Shape], extras: list[str], labels: DataFrame | None = None) -> DataFrame | None:
    """Every file of ``found`` in one frame of strings, by column name; None without files.

    ``labels`` (_path, ...) adds columns by file.  ``extras`` names what is kept beside
    the files' own columns: ``_path``, ``_row`` and columns of ``labels``.
    """
    if not found:
        return None
    columns: dict[str, str] = {}
    kept = {e.lower() for e in extras}  # a label stands before a column of its name
    for shape in found:
        for name in shape.names:
            if name.lower() not in kept:
                columns.setdefault(name.lower(), name)
    groups: dict[str, list[Shape]] = {}
    for shape in found:
        groups.setdefault(shape.header, []).append(shape)
    frames = [_scan(spark, group, list(columns.values()), extras, labels) for group in groups.values()]
    return reduce(DataFrame.union, frames)
