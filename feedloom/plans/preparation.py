"""End-to-end preparation of survey and verbatim extracts, composed from the operators.

``prepare_survey`` follows the original cleaning order, with one change: column
names are canonicalised *before* the model -> technology join, so a file whose
model column is spelled differently still joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from feedloom.functions import parse_datetime, to_number
from feedloom.operators import cleaning as C
from feedloom.operators import columns as P
from feedloom.operators import dedup as D
from feedloom.operators import enrich as J
from feedloom.sources.sinks import materialize


def prepare_survey(raw: DataFrame, tech_dim: DataFrame | None = None, mapping=None,
                   city=None, asn=None, income=None, threshold: int = 30, order: str = "_row") -> DataFrame:
    """Clean, type and enrich one kind of survey facts (sales or after-sales).

    ``raw`` is the union of per-file extracts (all strings, normalised names,
    with an ``order`` column).  Steps whose columns are absent are skipped.  What later
    steps read twice is materialised: the input before rows are compared, the kept rows
    before their yes/no columns are found.
    """
    raw = materialize(raw)
    df = D.drop_near_duplicates(raw, ("apellido_cliente", "nombre_cliente"), order=order, threshold=threshold,
                                compare=[c for c in raw.columns
                                         if c not in ("apellido_cliente", "nombre_cliente", order, "_file")])
    cols = set(df.columns)
    if "tiempo_empleado" in cols:
        df = C.duration_to_seconds(df, "tiempo_empleado")
    if "email" in cols:
        df = C.clean_email(df, "email")
    if "teléfono" in cols:
        df = C.clean_phone_es(df, "teléfono")
    df = materialize(C.dash_to_null(df))
    lineage = [c for c in (order, "_file") if c in df.columns]
    df = C.infer_bool(df, [c for c in df.columns if c not in lineage and c != "tiempo_empleado"])
    if mapping is not None:
        df = P.merge_columns(df, mapping)
    if tech_dim is not None and "modelo" in df.columns:
        df = J.enrich_technology(df, tech_dim, "modelo")
    df = C.parse_dates(df)
    df = P.split_datetime(df, "respondido")
    if city is not None and asn is not None and "ip" in df.columns:
        df = J.enrich_ip(df, city, asn, "ip")
        if income is not None:
            df = J.enrich_income(df, income)
    return df


def prepare_verbatims(raw: DataFrame) -> DataFrame:
    """v1 preparation of positional-sheet verbatims: date, drops, renames, fuel recode."""
    if not raw.columns:
        return raw
    df = raw
    if "Date of Response" in df.columns:
        df = P.with_date(df.withColumn("Date of Response", parse_datetime("Date of Response")), "Date of Response", "Date")
    df = P.drop_if_exists(df, P.VERBATIM_DROPS)
    df = P.rename(df, P.VERBATIM_RENAMES)
    if "Tecnología" in df.columns:
        df = C.recode_values(df, "Tecnología", C.FUEL_NAMES)
    if "Puntuación" in df.columns:
        df = df.withColumn("Puntuación", to_number("Puntuación"))
    return df


__all__ = ["prepare_survey", "prepare_verbatims"]
