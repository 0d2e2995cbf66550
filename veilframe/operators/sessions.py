"""Conversations over event tables: idle expiry, ceilings and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def sessions(events: DataFrame, key: str, ts: str, order: str, idle_seconds: int = 1800) -> DataFrame:
    """events with ``session``, from 0 per key; a gap of exactly the idle time already ends a session."""
    w = Window.partitionBy(key).orderBy(ts, order)
    gap = _micros(F.col(ts)) - _micros(F.lag(ts).over(w))
    return events.withColumn("_new", (gap >= idle_seconds * 1_000_000).cast("int")).withColumn("session", F.sum(F.coalesce("_new", F.lit(0))).over(w)).drop("_new")


def most_recent(events: DataFrame, key: str, ts: str, ceiling: int = 64) -> DataFrame:
    """The ``ceiling`` keys used last (ties: the smaller key), with when; a top-k, so only k rows a task are kept."""
    used = events.groupBy(key).agg(F.max(ts).alias("last_used"))
    return used.orderBy(F.desc("last_used"), F.asc(key)).limit(ceiling)


def expired(rows: DataFrame, written: str, now, seconds: int) -> DataFrame:
    """Rows whose age has reached the limit."""
    return rows.where(_micros(now) - _micros(F.col(written)) >= seconds * 1_000_000)
