"""Corpus pipeline: toxicity, language ID, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents.  All but the last
return the columns of documents, whichever those are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import language, ngram_join, packing
from veilframe.llm import toxicity as toxic
from veilframe.llm.common import scratch, settings, table, tokenizer_path

#: A text is rejected by language ID if it has no letter or no language reaches this score.
LEAST_SCORE = 0.3


def _kept(docs: DataFrame) -> DataFrame:
    """A row's text beside the whole row, so no column that a stage adds can clash with one of the documents'."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    settings(spark)
    return toxic.score(_kept(docs), toxic.fit(docs, table(spark, sf_dir, "labels"))).where("predicted = 0").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the languages learned from the documents themselves."""
    settings(spark)
    guessed = language.predict(_kept(docs), language.fit(docs))
    return guessed.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id; rows without id stay."""
    settings(spark)
    path = scratch(spark, "dropped")
    ngram_join.join(docs).where("doc_id <> component_id").select("doc_id").write.parquet(path)
    kept = docs.join(spark.read.parquet(path), "doc_id", "left_anti")
    again = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.limit(1).count():  # only rows that repeat an id are looked at twice
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    return kept.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    settings(spark)
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("language_id", language_id), ("near_duplicates", near_duplicates), ("packing", pack)]
#: No stage can be expressed in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage but the last is settled in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
