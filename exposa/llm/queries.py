"""Registered queries of the training-data operators, and DuckDB SQL where SQL states the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposa.llm import (concat_cut, exact_dedup, filter_audit, html_extract, packing, quality, secret_scan,
                        sentencepieces, simhash, source_divergence, token_files, url_filter, vector_graph)
from exposa.llm.common import table


def op1_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    return secret_scan.scan(table(spark, d, "documents"))


def op2_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, d, "pages")).drop("n_candidates")


def op3_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op4_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"))


def op5_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, d, "documents"))


def op6_token_files(spark: SparkSession, d: str) -> DataFrame:
    return token_files.write_and_read(table(spark, d, "documents"))


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.score(table(spark, d, "documents"), table(spark, d, "labels"))


def op8_vector_graph(spark: SparkSession, d: str) -> DataFrame:
    return vector_graph.search(table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    return sentencepieces.digests(table(spark, d, "documents"))


def op10_html_extract(spark: SparkSession, d: str) -> DataFrame:
    return html_extract.extract(table(spark, d, "pages"))


def op11_source_divergence(spark: SparkSession, d: str) -> DataFrame:
    return source_divergence.audit(table(spark, d, "documents"))


def op12_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


def op13_concat_cut(spark: SparkSession, d: str) -> DataFrame:
    return concat_cut.pack(table(spark, d, "documents"))


_QUERIES = [op1_secret_scan, op2_url_filter, op3_simhash, op4_packing, op5_exact_dedup, op6_token_files, op7_quality,
            op8_vector_graph, op9_sentencepiece, op10_html_extract, op11_source_divergence, op12_filter_audit,
            op13_concat_cut]
LLM_QUERIES = {f.__name__: f for f in _QUERIES}

LLM_ORACLES = {
    "op2_url_filter": url_filter.oracle(),
    "op5_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) keep_id, count(*) OVER (PARTITION BY t) group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) kept, sha256(t) text_sha256
FROM d""",
    "op11_source_divergence": source_divergence.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
