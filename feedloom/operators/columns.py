"""Projection and schema operators.

Name bookkeeping (which columns merge into which) happens on the driver over
column *names* only; the data work is always a single ``select``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def norm_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Strip, lower-case and replace spaces by ``_`` in every column name."""
    new = [norm_name(c) for c in df.columns]
    dupes = sorted({n for n in new if new.count(n) > 1})
    if dupes:
        raise ValueError(f"normalised column names collide: {dupes}")
    return df.toDF(*new)


def stringify(df: DataFrame) -> DataFrame:
    """Cast every column to string."""
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in df.columns])


# Raw verbatim column names and their display names.
VERBATIM_RENAMES = {
    "Dealer Name": "Taller",
    "Model": "Modelo",
    "Fuel": "Tecnología",
    "Product Score": "Puntuación",
    "Verbatim": "Comentarios",
    "Date": "Fecha",
}
VERBATIM_DROPS = ["Customer Name", "Dealer No.", "VIN", "Date of Response"]


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename by a fixed map; names not present are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_if_exists(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns, ignoring missing ones."""
    return df.drop(*[n for n in names if n in df.columns])


# Letters without a canonical decomposition and their plain spelling.
PLAIN_LETTERS = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ħ": "h", "ı": "i"}
_FOLD = str.maketrans(PLAIN_LETTERS)


def name_key(s: str) -> str:
    """The words of a name, lower-cased and without accents, joined by ``_``."""
    folded = unicodedata.normalize("NFKD", str(s).lower()).translate(_FOLD)
    plain = "".join(ch for ch in folded if not unicodedata.combining(ch))
    return "_".join(re.findall(r"[^\W_]+", plain))


#: Rows of a column-name dictionary that the driver reads at most; more is an error, not a cut.
MAX_NAME_ROWS = 100_000


def _name_rows(frame: DataFrame, *cols: str) -> list[tuple]:
    """A dictionary of column names as tuples; it is as large as the widest table, so it has a bound."""
    rows = frame.select(*cols).take(MAX_NAME_ROWS + 1)
    if len(rows) > MAX_NAME_ROWS:
        raise ValueError(f"a column-name dictionary has over {MAX_NAME_ROWS} rows")
    return [tuple(r) for r in rows]


def _mapping_pairs(mapping) -> list[tuple[str, str]]:
    """Accept a dict, a list of pairs, a pandas frame or a small Spark frame of
    (columna_original, columna_normalizada); rows with a missing side are skipped."""
    names = ["columna_original", "columna_normalizada"]
    if isinstance(mapping, DataFrame):
        pairs = _name_rows(mapping, *names)
    elif isinstance(mapping, Mapping):
        pairs = mapping.items()
    elif hasattr(mapping, "itertuples"):
        pairs = mapping[names].itertuples(index=False, name=None)
    else:
        pairs = mapping
    return [(str(a), str(b)) for a, b in pairs if a is not None and b is not None and a == a and b == b]


def merge_plan(columns: list[str], mapping) -> list[tuple[str, list[str]]]:
    """What ``merge_columns`` does, as an ordered list of (output column, its sources).

    An output stands where its first source stood.  A column that the mapping does
    not name keeps its name, unless a merged column takes it.
    """
    by_key = {name_key(original): target for original, target in _mapping_pairs(mapping)}
    target = {c: by_key[name_key(c)] for c in columns if name_key(c) in by_key}
    taken = set(target.values())
    outputs = dict.fromkeys(target.get(c, c) for c in columns if c in target or c not in taken)
    return [(out, [c for c in columns if target.get(c) == out] or [out]) for out in outputs]


def merge_columns(df: DataFrame, mapping) -> DataFrame:
    """P5: canonicalise column names through a mapping, merging synonyms.

    Columns whose ``name_key`` has the same target become one: the first non-null
    value from left to right, as text where their types differ.
    """
    types = dict(df.dtypes)

    def merged(sources: list[str]):
        mixed = len({types[c] for c in sources}) > 1
        values = [F.col(f"`{c}`").cast("string") if mixed else F.col(f"`{c}`") for c in sources]
        return F.coalesce(*values) if len(values) > 1 else values[0]

    return df.select(*(merged(sources).alias(out) for out, sources in merge_plan(df.columns, mapping)))


def rename_by_dict(df: DataFrame, dictionary) -> DataFrame:
    """S3: rename columns through a per-file question dictionary (Display ID -> text)."""
    if isinstance(dictionary, DataFrame):
        dictionary = {str(a): str(b) for a, b in _name_rows(dictionary, "`Display ID`", "Questionnaire")}
    return df.select(*[F.col(f"`{c}`").alias(dictionary.get(c, c)) for c in df.columns])


def split_datetime(df: DataFrame, col: str = "respondido") -> DataFrame:
    """Add ``<col>_fecha`` (date) and ``<col>_hora`` (``HH:mm:ss`` text)."""
    if col not in df.columns:
        return df
    return df.withColumns({
        f"{col}_fecha": F.to_date(col),
        f"{col}_hora": F.date_format(col, "HH:mm:ss"),
    })


def with_date(df: DataFrame, src: str, out: str) -> DataFrame:
    """Derive a date column from a datetime column."""
    return df.withColumn(out, F.to_date(src))


def project(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Column projection for display or export."""
    return df.select(*cols)
