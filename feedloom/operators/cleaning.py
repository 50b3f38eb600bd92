"""Survey cleaning operators (C1-C10): each is one projection and/or one filter.

The row filters (e-mail, phone) drop rows, exactly like the original cleaners:
a null or invalid value removes the row.  ``infer_bool`` is the only operator
with a driver action: a single one-row aggregate decides which columns convert.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.functions import (
    clean_email_value,
    duration_seconds,
    email_is_valid,
    is_dash,
    parse_date,
    parse_datetime,
    phone_digits_es,
    phone_is_valid_es,
    recode,
    to_number,
    yes_no_bool,
    yes_no_ok,
    zfill5,
)
from feedloom.operators._util import scalar_row


def clean_email(df: DataFrame, col: str = "email") -> DataFrame:
    """Normalise e-mails and keep only rows with a plausible, non-placeholder address."""
    return df.withColumn(col, clean_email_value(col)).where(email_is_valid(col))


def clean_phone_es(df: DataFrame, col: str = "teléfono") -> DataFrame:
    """Spanish phone numbers to 9 digits; rows with invalid or fake numbers are dropped."""
    return df.withColumn(col, phone_digits_es(col)).where(phone_is_valid_es(col))


def dash_to_null(df: DataFrame) -> DataFrame:
    """Every cell that is just ``-`` (after stripping) becomes null, in all columns."""
    return df.select(*[F.when(~is_dash(F.col(c)), F.col(c)).alias(c) for c in df.columns])


def infer_bool(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """C4: convert yes/no columns to boolean.

    A column converts iff all its non-null stripped, lower-cased values are in
    {s, si, y, n, none, ""}; all-null columns convert too.  One global
    aggregate (``bool_and`` per column, map-side combined) decides for every
    column at once; the 1-row verdict is read on the driver.
    """
    cols = list(df.columns if cols is None else cols)
    if not cols:
        return df
    verdict = scalar_row(df.agg(*[F.coalesce(F.bool_and(yes_no_ok(c)), F.lit(True)).alias(f"_{i}")
                                  for i, c in enumerate(cols)]))
    convert = {c for i, c in enumerate(cols) if verdict[f"_{i}"]}
    return df.select(*[yes_no_bool(c).alias(c) if c in convert else F.col(c) for c in df.columns])


def duration_to_seconds(df: DataFrame, col: str = "tiempo_empleado") -> DataFrame:
    """``"Xm Ys"`` text -> bigint seconds, in place."""
    return df.withColumn(col, duration_seconds(col))


# Which survey columns hold day-first datetimes and dates.
DATE_COLUMNS = {
    "respondido": "datetime",
    "enviado": "date",
    "recordatorio": "date",
    "fecha_contacto": "date",
    "fecha_de_contacto": "date",
    "fecha_solucionado": "date",
    "fecha_de_solucionado": "date",
}


def parse_dates(df: DataFrame, mapping: dict[str, str] = DATE_COLUMNS) -> DataFrame:
    """Lenient parse of the present date/datetime columns; unparsable -> null."""
    exprs = {}
    for c, kind in mapping.items():
        if c in df.columns:
            exprs[c] = parse_datetime(c) if kind == "datetime" else parse_date(c)
    return df.withColumns(exprs) if exprs else df


def to_datetime(df: DataFrame, col: str) -> DataFrame:
    """Coerce an already typed column to timestamp_ntz; bad -> null."""
    return df.withColumn(col, F.col(col).try_cast("timestamp_ntz"))


def coerce_number(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Lenient numeric coercion of a text column."""
    return df.withColumn(out or col, to_number(col))


# Fuel spellings of the raw extracts and their display names.
FUEL_NAMES = {"Petrol": "Gasolina", "Hybrid": "Híbrido", "Electric": "Eléctrico", "Diesel": "Diésel"}


def recode_values(df: DataFrame, col: str, mapping: dict = FUEL_NAMES, out: str | None = None) -> DataFrame:
    """Dictionary recode; unmatched values pass through."""
    return df.withColumn(out or col, recode(col, mapping))


def pad_postal_code(df: DataFrame, col: str) -> DataFrame:
    """Zero-pad postal codes to 5 characters (longer codes stay whole)."""
    return df.withColumn(col, zfill5(col))
