"""Writers and materialisation.

Materialised intermediates go to reliable storage (a written table, or
``checkpoint()`` into the session's ``spark.checkpoint.dir``), never to an
executor-local cache, so a lost executor costs a recompute, not the job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.columns import name_key, project
from feedloom.sources.ingest import path_exists


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Write cleaned facts (optionally partitioned, e.g. by service or month)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> bool:
    """Write a table unless it is empty; returns whether anything was written."""
    if df.isEmpty():
        return False
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.options(**CSV_WRITE_OPTIONS)
    w.save(path)
    return True


# RFC 4180, values as they are: doubled quotes, no trimming.
CSV_WRITE_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def export_name(kind: str, segment: str) -> str:
    """Export name ``comentarios_<kind>_<segment>`` (lower-case, spaces -> ``_``)."""
    return f"comentarios_{kind.lower()}_{segment.replace(' ', '_').lower()}.csv"


def export_csv(df: DataFrame, cols: list[str], path: str, mode: str = "overwrite") -> None:
    """CSV export (with header) of a projected verbatim list."""
    project(df, cols).write.mode(mode).options(**CSV_WRITE_OPTIONS).csv(path)


def embeddings_store(spark: SparkSession, root: str, service: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The embedding table of a service, built and written once, then read back."""
    path = f"{root.rstrip('/')}/vectorizacion_{name_key(service).replace('_', '')}.parquet"
    if not path_exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Build once and reuse.  With a path, write Parquet and read it back; otherwise
    checkpoint into the session's ``spark.checkpoint.dir`` (reliable, lineage cut)."""
    if path:
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.parquet(path)
    return df.checkpoint(eager=True)
