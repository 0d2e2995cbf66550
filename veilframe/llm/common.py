"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from veilframe.functions.shared import scratch, settled, shared_folder  # noqa: F401

#: Where the public tokenizer files are; a parameter of every operator that needs one.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settings(spark: SparkSession) -> None:
    """Rows come to Python in batches that stay small though some texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def give_back() -> None:
    """Memory that was freed goes back to the system: a worker lives on, and its next tasks and neighbours need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_batches(rows: DataFrame, make: Callable[[], Callable[[dict[str, list]], Iterator[dict[str, list]]]], schema: str) -> DataFrame:
    """rows, an Arrow batch at a time, through the function that ``make`` gives once a task.

    It takes a batch's columns as lists and yields columns of ``schema``; ids stay the integers they are, beside nulls too.
    """
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for b in batches:
            if b.num_rows:
                for out in one({name: c.to_pylist() for name, c in zip(b.schema.names, b.columns)}):
                    yield pa.RecordBatch.from_pydict(out, schema=kinds)
        give_back()

    return rows.mapInArrow(run, schema)


def fold(col: Column, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id is in no held-out fold (-1)."""
    return F.coalesce(F.crc32(col.cast("string")) % of, F.lit(-1))


def parts_for(spark: SparkSession, n_bytes: int, each: int) -> int:
    """So many partitions that each holds about ``each`` bytes; at least those the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / each))
