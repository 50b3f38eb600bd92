"""Readers for survey extracts, verbatims, lookup dimensions and processed facts.

Raw workbooks are re-aimed as per-sheet extracts: a workbook ``<book>`` becomes
``<book>__<Sheet>.<ext>`` files (``Ventas``, ``Posventa``, ``Questionnaire``;
positional sheets as ``sheet0``, ``sheet1``).  CSV extracts with drifting columns go
through a catalogue of headers (``sources.headers``): one scan per distinct header and a
fixed number of jobs, however many files there are.  Parquet extracts are read in one
scan with ``mergeSchema`` (null-filled missing columns, same semantics) or, where each
has its own renames or types, one by one.
"""

from __future__ import annotations

import logging
import posixpath
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from feedloom.operators.columns import norm_name, rename_by_dict
from feedloom.sources import headers as H
from feedloom.sources.headers import CSV_OPTIONS

log = logging.getLogger(__name__)

SHEET_SEP = "__"


def union_diagonal(dfs: list[DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """Union by column name, missing columns null-filled; empty list -> empty table."""
    dfs = list(dfs)
    if not dfs:
        return empty_frame(spark)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def empty_frame(spark: SparkSession | None = None, schema: StructType | str | None = None) -> DataFrame:
    spark = spark or SparkSession.getActiveSession()
    return spark.createDataFrame([], schema or StructType([]))


def list_extracts(spark: SparkSession, root: str, suffix: str, recursive: bool = True) -> list[str]:
    """Extracts under ``root`` whose name ends with ``suffix``: single files, or folders
    of part files written by Spark (listed once; only the paths are read).  With
    ``recursive=False`` only extracts directly inside ``root`` count."""
    return sorted(_extract_files(spark, root, suffix, recursive))


def _extract_files(spark: SparkSession, root: str, suffix: str, recursive: bool = True) -> dict[str, list[str]]:
    """The files of each extract under ``root`` whose name ends with ``suffix``."""
    pattern = re.compile(r"(.*?/[^/]*" + re.escape(suffix) + r")(?:/|$)")
    out: dict[str, list[str]] = {}
    for path in H.list_files(spark, root):
        m = pattern.match(path)
        if m:
            out.setdefault(m[1], []).append(path)
    if not recursive:
        top = _unqualified(root).rstrip("/")
        out = {e: files for e, files in out.items() if posixpath.dirname(_unqualified(e)) == top}
    return out


def _unqualified(path: str) -> str:
    """Path without its scheme (``file:/a`` and ``file:///a`` -> ``/a``, ``s3a://b/a`` -> ``//b/a``)."""
    return re.sub(r"^//(?=/)", "", re.sub(r"^[A-Za-z][\w+.-]*:", "", path))


def _reader(spark: SparkSession, fmt: str):
    r = spark.read.format(fmt)
    return r.options(**CSV_OPTIONS, inferSchema="false") if fmt == "csv" else r


def _read_one(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    return _reader(spark, fmt).load(path)


# What Spark says of a file that is not of its format.
_BAD_FILE = ("UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "is not a Parquet file")


def _skip_or_raise(error: Exception, path: str, skipped: list | None) -> None:
    """Note a corrupt extract; any other error goes on."""
    if not any(words in str(error) for words in _BAD_FILE):
        raise error
    log.warning("skipping %s: %s", path, error)
    if skipped is not None:
        skipped.append((path, str(error)))


def read_survey(spark: SparkSession, root: str, sheet: str, fmt: str = "csv",
                questionnaire: str = "Questionnaire", skipped: list | None = None) -> DataFrame:
    """S1 + S3: every ``*__<sheet>.<fmt>`` extract under ``root`` (recursively).

    An extract is a single file or a folder of part files written by Spark.

    Columns are renamed through the workbook's own questionnaire extract when one exists
    (Display ID -> question text), names are normalised and values are strings.  Where two
    columns of a file come to one name, the later is numbered (``email``, ``email_2``).
    A corrupt Parquet extract is logged, added to ``skipped`` as (path, reason) and left
    out; any other error is raised.  Adds ``_file`` (lineage) and ``_row``, an ordered
    struct: part file (by path), place in the file.
    """
    if fmt == "csv":
        return _read_survey_csv(spark, root, sheet, questionnaire)
    parts = []
    for number, path in enumerate(list_extracts(spark, root, f"{SHEET_SEP}{sheet}.{fmt}")):
        try:
            df = _read_one(spark, path, fmt)
            names = df.columns
            df = df.select(*(F.col(f"`{c}`") for c in names), H.input_order(number).alias("_row"))
            qpath = path[: -len(f"{sheet}.{fmt}")] + f"{questionnaire}.{fmt}"
            body = df.drop("_row")
            if qpath != path and path_exists(spark, qpath):
                qdf = _read_one(spark, qpath, fmt)
                if {"Display ID", "Questionnaire"} <= set(qdf.columns):
                    body = rename_by_dict(body, qdf)
            new = H.numbered([norm_name(c) for c in body.columns])
            df = df.select(*(F.col(f"`{old}`").cast("string").alias(to) for old, to in zip(names, new)), "_row")
            parts.append(df.withColumn("_file", F.lit(posixpath.basename(path))))
        except Exception as e:  # noqa: BLE001 - raised again unless the extract is corrupt
            _skip_or_raise(e, path, skipped)
    return union_diagonal(parts, spark)


def _book(path, suffix: str):
    """The workbook of a file: its extract's path up to the sheet's name."""
    return F.regexp_extract(path, r"^(.*?/[^/]*" + re.escape(SHEET_SEP) + ")" + re.escape(suffix) + r"(?:/|$)", 1)


def _questions(spark: SparkSession, files: list[str], suffix: str) -> DataFrame | None:
    """(book, id, question) of all questionnaire files: the last row of an id stands."""
    found = [s for s in H.shapes(H.read_headers(spark, files).withColumn("names", H.names_of("header"))) if {"Display ID", "Questionnaire"} <= set(s.names)]
    rows = H.read_by_header(spark, found, ["_path", "_row"])
    if rows is None:
        return None
    known = rows.where(F.col("`Display ID`").isNotNull() & F.col("Questionnaire").isNotNull())
    return known.groupBy(_book(F.col("_path"), suffix).alias("book"), F.col("`Display ID`").alias("id")).agg(F.max_by("Questionnaire", "_row").alias("question"))


def _read_survey_csv(spark: SparkSession, root: str, sheet: str, questionnaire: str) -> DataFrame:
    """``read_survey`` by header catalogue: two listings, the first records, the question sheets, one scan per header."""
    suffix = f"{sheet}.csv"
    files = [f for part in _extract_files(spark, root, SHEET_SEP + suffix).values() for f in part]
    if not files:
        return empty_frame(spark)
    catalogue = H.read_headers(spark, files).withColumn("names", H.names_of("header"))
    sheets = [f for part in _extract_files(spark, root, f"{SHEET_SEP}{questionnaire}.csv").values() for f in part]
    questions = _questions(spark, sheets, f"{questionnaire}.csv") if sheets and questionnaire != sheet else None
    if questions is not None:
        places = catalogue.select("file", "header", _book(F.col("file"), suffix).alias("book"), F.posexplode("names").alias("pos", "id"))
        named = places.join(questions, ["book", "id"], "left").withColumn("name", F.coalesce("question", "id"))
        catalogue = named.groupBy("file", "header").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))
    rows = H.read_by_header(spark, H.shapes(catalogue, norm_name), ["_path", "_row"])
    if rows is None:  # files without a single record
        return empty_frame(spark)
    extract = F.regexp_extract("_path", r"^.*?([^/]*" + re.escape(SHEET_SEP + suffix) + r")(?:/|$)", 1)
    return rows.withColumn("_file", extract).select(*(f"`{c}`" for c in rows.columns if c not in ("_path", "_row")), "_row", "_file")


def read_survey_parquet(spark: SparkSession, root: str, sheet: str) -> DataFrame:
    """S1 for Parquet extracts: one scan, columns unioned by name (``mergeSchema``)."""
    df = (
        spark.read.option("mergeSchema", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{SHEET_SEP}{sheet}.parquet").parquet(root)
    )
    new = H.numbered([norm_name(c) for c in df.columns])
    return df.select(*(F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(df.columns, new)),
                     F.col("_metadata.file_name").alias("_file"), H.input_order().alias("_row"))


def read_verbatims(spark: SparkSession, root: str, fmt: str = "csv", skipped: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Flat folder of workbooks with positional sheets: first = sales, second = service.

    A sheet extract is a single file or a folder written by Spark.  Corrupt
    extracts are left out and added to ``skipped``.

    Returns two (possibly empty) frames unioned by name.
    """
    out = []
    for sheet in ("sheet0", "sheet1"):
        extracts = _extract_files(spark, root, f"{SHEET_SEP}{sheet}.{fmt}", recursive=False)
        if fmt == "csv":
            out.append(_read_csv_files(spark, [f for part in extracts.values() for f in part]))
            continue
        parts = []
        for p in sorted(extracts):
            try:
                parts.append(_read_one(spark, p, fmt))
            except Exception as e:  # noqa: BLE001 - raised again unless the extract is corrupt
                _skip_or_raise(e, p, skipped)
        out.append(union_diagonal(parts, spark))
    return out[0], out[1]


def _read_csv_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """CSV files concatenated by column name."""
    found = H.shapes(H.read_headers(spark, files).withColumn("names", H.names_of("header"))) if files else []
    rows = H.read_by_header(spark, found, [])
    return empty_frame(spark) if rows is None else rows


def read_tagged(spark: SparkSession, files: dict[str, str], tag: str = "Mes", fmt: str = "csv") -> DataFrame | None:
    """Read a fixed list of extracts, tag each with its label, concatenate by column name.

    An extract is a single file or a folder of part files written by Spark.  CSV files are
    scanned once per distinct header, Parquet files once with ``mergeSchema``; reordered,
    missing and additional columns keep their values, and a label, joined by the file's
    path, cannot reach another extract's rows.  A column of the label's name gives way to
    it.  Missing extracts are skipped; none at all -> ``None``.
    """
    labels = []
    for path, label in files.items():
        found = H.list_files(spark, path)
        if not found and not path_exists(spark, path):
            log.warning("missing %s", path)
        labels += [(f, label) for f in found]
    if not labels:
        return None
    # one row per file of the caller's list: a table that may be broadcast
    table = spark.createDataFrame(labels, T.StructType([T.StructField("_path", T.StringType()), T.StructField(tag, T.StringType())]))
    paths = [f for f, _ in labels]
    if fmt != "csv":
        rows = spark.read.option("mergeSchema", "true").format(fmt).load(paths)
        return rows.drop(tag).withColumn("_path", H.file_path()).join(F.broadcast(table), "_path").drop("_path")
    found = H.shapes(H.read_headers(spark, paths).withColumn("names", H.names_of("header")))
    return H.read_by_header(spark, found, [tag], table)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists; Spark looks when it makes the plan, without a job."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as e:
        return _unless_missing(e, False)


def _unless_missing(error: AnalysisException, value):
    """``value`` where the error says that a path does not exist; else the error goes on."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error
    return value


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Processed fact table (any Hadoop-compatible URI, e.g. ``s3a://``)."""
    return spark.read.parquet(path)


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Processed workbook facts, re-aimed to Parquet/CSV extracts."""
    return _reader(spark, fmt).load(path)


def read_dim(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "csv") -> DataFrame:
    """Lookup dimension with an explicit schema (e.g. postal codes stay strings)."""
    r = spark.read.format(fmt).schema(schema)
    if fmt == "csv":
        r = r.options(**CSV_OPTIONS)
    return r.load(path)


def read_report(spark: SparkSession, root: str, service: str) -> DataFrame:
    """Stored report text for a service (one row per file, whole text); unknown -> empty.

    The report is a single file or a folder written by Spark.

    Spark decodes the file as UTF-8 and replaces undecodable bytes.
    """
    from feedloom.operators.columns import name_key

    path = posixpath.join(root, f"informe{name_key(service).replace('_', '')}.txt")
    if not path_exists(spark, path):
        return empty_frame(spark, "value string")
    return spark.read.text(path, wholetext=True)
