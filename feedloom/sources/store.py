"""An embedding store kept up to date by the content of its texts.

A version of the store is two Parquet tables: ``vectors`` (one row per different text, by
the SHA-256 of the text) and ``rows`` (the payload with its vector, what readers see).  A
refresh embeds only texts that the version before does not hold, leaves out what the load
no longer has, and writes a new version.  The version counts once its marker is written,
the last step; readers take the highest marked version, so they never see half of one, and
versions that are being read stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.operators.columns import name_key
from feedloom.sources.headers import list_files

KEY = "text_key"


def _home(root: str, service: str) -> str:
    return f"{root.rstrip('/')}/vectorizacion_{name_key(service).replace('_', '')}"


def current_version(spark: SparkSession, root: str, service: str) -> int:
    """The highest version that is complete; 0 where there is none."""
    marks = (re.search(r"/listas/(\d+)/", f) for f in list_files(spark, _home(root, service) + "/listas"))
    return max((int(m[1]) for m in marks if m), default=0)


def read_embeddings(spark: SparkSession, root: str, service: str) -> DataFrame | None:
    """The rows of the current version with their vectors; None before the first refresh."""
    version = current_version(spark, root, service)
    return spark.read.parquet(f"{_home(root, service)}/{version:08d}/rows") if version else None


def refresh_embeddings(rows: DataFrame, root: str, service: str, embed: Callable[[DataFrame], DataFrame], text: str = "texto_enriquecido") -> DataFrame:
    """Bring a service's store up to ``rows`` and return its new contents.

    ``embed`` turns (text_key, text) into (text_key, embedding); it is given every text
    that the store does not hold yet, once.  Rows without a text get a null vector.  Two
    refreshes at a time cannot both write a version: the second to start writing fails.
    """
    spark, home = rows.sparkSession, _home(root, service)
    version = current_version(spark, root, service)
    keyed = rows.withColumn(KEY, F.sha2(F.col(text), 256))
    texts = keyed.where(F.col(KEY).isNotNull()).groupBy(KEY).agg(F.min(text).alias("text"))  # equal texts fold before the shuffle
    folder = f"{home}/{version + 1:08d}"
    if version:
        before = spark.read.parquet(f"{home}/{version:08d}/vectors")
        fresh = embed(texts.join(before, KEY, "left_anti"))
        kept = before.join(texts.select(KEY), KEY, "left_semi")
        vectors = kept.unionByName(fresh.select(*before.columns))
    else:
        vectors = embed(texts).select(KEY, "embedding")
    vectors.write.parquet(f"{folder}/vectors")
    vectors = spark.read.parquet(f"{folder}/vectors")
    keyed.join(vectors, KEY, "left").write.parquet(f"{folder}/rows")
    spark.range(1).write.parquet(f"{home}/listas/{version + 1:08d}")
    return spark.read.parquet(f"{folder}/rows")
