"""Bounded samples of labelled rows that classifiers are fitted on."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labelled: DataFrame, per_label: int) -> pd.DataFrame:
    """text and label of at most ``per_label`` documents of each label, those whose hashed ids are least.

    ``labelled`` has (doc_id, label).  Ids are chosen before any text is read, so only the sample's texts move;
    what is broadcast are about ``per_label`` ids a label, at any size of the table.
    """
    one = labelled.where("label is not null and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    one = one.withColumn("hash", F.xxhash64("doc_id"))
    # Hashes spread evenly: below this bound lie the least of a label and a margin of eight standard deviations.
    want = per_label + 8 * per_label**0.5 + 8
    bound = one.groupBy("label").agg((F.lit(2.0**64 * want) / F.count("*") - F.lit(2.0**63)).alias("bound"))
    # One row a label, fewer than the ids broadcast below.
    low = one.join(F.broadcast(bound), "label").where(F.col("hash").cast("double") <= F.col("bound"))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(low.select("doc_id", "label", "hash")), "doc_id").dropDuplicates(["doc_id"]).toPandas()
    rows = rows.sort_values(["hash", "doc_id"]).groupby("label", sort=False).head(per_label)
    return rows[["doc_id", "text", "label"]].sort_values("doc_id", ignore_index=True)
