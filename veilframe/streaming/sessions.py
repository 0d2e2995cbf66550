"""Conversations in keyed state: what a key's uses make of it, and when it may be forgotten.

A use begins, and may be held until it ends; a key's conversation lives for the idle time behind its last beginning,
and never ends under a use.  So a use reaches from its beginning to the later of both, and conversations are what
uses that overlap make together - in whatever order they come, so streams and batches agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: Uses of a key are first put together a span of time at a time, so that no task sorts all uses of one key.
SPAN_SECONDS = 86_400
CLOSED = "key string, started timestamp, last_used timestamp, expires timestamp, uses long"


def _reach(idle_seconds: int) -> Column:
    """Up to where a use keeps its conversation alive, in microseconds."""
    begins, ends = F.unix_micros("start"), F.unix_micros("end")
    return F.greatest(begins + idle_seconds * 1_000_000, F.coalesce(ends, begins))


def _merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """(key, lo, last, reach, uses) of parts that overlap within a group of ``by``."""
    w = Window.partitionBy(*by).orderBy("lo", "reach")
    before = F.max("reach").over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.coalesce((F.col("lo") >= before).cast("int"), F.lit(0))).over(w)
    return parts.withColumn("_run", run).groupBy(*by, "_run").agg(F.min("lo").alias("lo"), F.max("last").alias("last"), F.max("reach").alias("reach"), F.sum("uses").alias("uses")).drop("_run")


def conversations(uses: DataFrame, idle_seconds: int = 1800, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """(key, started, last_used, expires, uses) of all conversations of ``uses`` (key, start, end).

    A null end is a use that is not held.  Uses without a beginning belong nowhere and are left out; a null key is a
    key.  A hot key's uses are put together by spans of time first.
    """
    at = uses.where("start is not null").select(F.col("key").cast("string").alias("key"), F.unix_micros("start").alias("lo"), F.unix_micros("start").alias("last"), _reach(idle_seconds).alias("reach"), F.lit(1).cast("long").alias("uses"))
    spans = _merged(at.withColumn("span", F.floor(F.col("lo") / (span_seconds * 1_000_000))), ["key", "span"])
    time = lambda c: F.timestamp_micros(c)
    return _merged(spans.drop("span"), ["key"]).select("key", time("lo").alias("started"), time("last").alias("last_used"), time("reach").alias("expires"), "uses")


def settle(held: list[list[int]], uses: list[tuple[int, int]]) -> list[list[int]]:
    """Open conversations [lo, last, reach, uses], in order, with more uses; those that overlap become one."""
    parts = sorted([*held, *([lo, lo, reach, 1] for lo, reach in uses)])
    out: list[list[int]] = []
    for p in parts:
        if out and p[0] < out[-1][2]:
            o = out[-1]
            out[-1] = [o[0], max(o[1], p[1]), max(o[2], p[2]), o[3] + p[3]]
        else:
            out.append(list(p))
    return out


def expired_conversations(uses: DataFrame, delay: str, idle_seconds: int = 1800) -> DataFrame:
    """A streamed row (key, started, last_used, expires, uses) for each conversation once the watermark has passed it.

    Uses (key, start, end) may come in any order within ``delay``.  The state is open conversations: those that uses
    still to come could touch.  One goes when it expires; a use that is held keeps it.  A use that comes later than
    ``delay`` counts only if it still reaches beyond the watermark, with what is open then.

    A session window's sessions become one even where they only touch, so uses reach a microsecond less here.
    """
    if idle_seconds <= 0:
        raise ValueError("a conversation must be idle for some time before it ends")
    begins = F.unix_micros("start")
    gap = ((_reach(idle_seconds) - begins - 1).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    rows = uses.where("start is not null").withWatermark("start", delay)
    rows = rows.select(F.col("key").cast("string").alias("key"), "start", begins.alias("lo"), F.make_interval(secs=gap).alias("gap"))
    found = rows.groupBy("key", F.session_window("start", F.col("gap")).alias("open")).agg(F.max("lo").alias("last"), F.count("*").alias("uses"))
    return found.select("key", F.col("open.start").alias("started"), F.timestamp_micros("last").alias("last_used"), F.timestamp_micros(F.unix_micros("open.end") + 1).alias("expires"), "uses")


def write_expired(uses: DataFrame, path: str, checkpoint: str, delay: str, idle_seconds: int = 1800) -> StreamingQuery:
    """Starts writing expired conversations below ``path``, a folder a micro-batch; run again, a batch is overwritten.

    What is written says which scopes may be purged: ``mappings.purge`` and ``MappingStore.purge`` take it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return expired_conversations(uses, delay, idle_seconds).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
