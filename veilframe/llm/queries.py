"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, embedding_forest, filter_audit, html, language, mixing, ngram_join, packing, prefix_trie, records, tiff, toxicity, url_rules
from .common import settings, table, tokenizer_path


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings(spark)
    return records.sequences(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings(spark)
    return html.extract(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.score(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings(spark)
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings(spark)
    return tiff.as_media(table(spark, sf_dir, "documents"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings(spark)
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.link(table(spark, sf_dir, "embeddings"))


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).drop("mined")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings(spark)
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_language, op2_records, op3_html, op4_mixing, op5_bpe, op6_toxicity, op7_tiff, op8_ngram_join, op9_packing, op10_forest, op11_url_rules, op12_prefix_trie, op13_filter_audit)}
ORACLE_SQL: dict[str, str] = {"op8_ngram_join": ngram_join.ORACLE_SQL, "op10_forest": embedding_forest.ORACLE_SQL, "op11_url_rules": url_rules.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL}
