"""Tables settled in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, one of our own, but only where all of Spark runs on this machine."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors and the driver share")
        path = f"file://{tempfile.mkdtemp(prefix='veilframe-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def settled(df: DataFrame) -> DataFrame:
    """df computed once, its rows in the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Takes a table that ``scratch`` named out of the shared folder again."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession) -> None:
    """Texts come to Python in batches of a fixed size, however long they are and however many a task has."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(2 << 20))
