"""Registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm.ann import op6_nearest
from feedloom.llm.attention_lm import op7_lm
from feedloom.llm.chunk_bpe import op10_chunk_bpe
from feedloom.llm.common import table
from feedloom.llm.exact_dedup import OP13_SQL, op13_exact_dedup
from feedloom.llm.lexical import OP12_SQL, op12_lexical
from feedloom.llm.licenses import op3_licenses
from feedloom.llm.line_dedup import OP5_SQL, op5_line_dedup
from feedloom.llm.packing import op4_packing
from feedloom.llm.quality import op1_quality
from feedloom.llm.simhash import op9_simhash
from feedloom.llm.token_files import op2_token_files
from feedloom.llm.topk import OP8_SQL, op8_top_k
from feedloom.llm.trie import OP11_SQL, op11_prefix_trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": lambda spark, d: op1_quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_token_files": lambda spark, d: op2_token_files(table(spark, d, "documents")),
    "op3_licenses": lambda spark, d: op3_licenses(table(spark, d, "documents")),
    "op4_packing": lambda spark, d: op4_packing(table(spark, d, "documents")),
    "op5_line_dedup": lambda spark, d: op5_line_dedup(table(spark, d, "documents")),
    "op6_nearest": lambda spark, d: op6_nearest(table(spark, d, "embeddings")),
    "op7_lm": lambda spark, d: op7_lm(table(spark, d, "documents")),
    "op8_top_k": lambda spark, d: op8_top_k(table(spark, d, "embeddings")),
    "op9_simhash": lambda spark, d: op9_simhash(table(spark, d, "documents")),
    "op10_chunk_bpe": lambda spark, d: op10_chunk_bpe(table(spark, d, "documents")),
    "op11_prefix_trie": lambda spark, d: op11_prefix_trie(table(spark, d, "conversations")),
    "op12_lexical": lambda spark, d: op12_lexical(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op13_exact_dedup": lambda spark, d: op13_exact_dedup(table(spark, d, "documents")),
}
ORACLE: dict[str, str] = {"op5_line_dedup": OP5_SQL, "op8_top_k": OP8_SQL, "op11_prefix_trie": OP11_SQL, "op12_lexical": OP12_SQL, "op13_exact_dedup": OP13_SQL}
