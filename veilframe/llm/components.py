"""Connected components of an edge table by alternating large and small stars.

Every round points nodes at the least neighbour they know; after a few rounds,
as many as the logarithm of the longest path, each component is one star.  All
of it is grouping with partial minima and equi-joins; nothing reaches the driver
but one row a round, and edges that are stars already take no round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


#: Edges that a task makes stars of at a time.
AT_ONCE = 1 << 19


def _grouped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[pd.DataFrame] = []
    for f in frames:
        held.append(f)
        if sum(map(len, held)) >= AT_ONCE:
            yield pd.concat(held)
            held = []
    if held:
        yield pd.concat(held)


def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Some batches' edges as stars around the least node of each of their own components, so fewer rounds are left."""
    for f in _grouped(frames):
        nodes, ends = np.unique(f.to_numpy(np.int64).ravel(), return_inverse=True)
        a, b = ends.reshape(-1, 2).T
        label = np.arange(len(nodes))
        while (label[a] != label[b]).any():
            least = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], least)
            np.minimum.at(label, label[b], least)
            while (label[label] != label).any():
                label = label[label]
        own = np.flatnonzero(label != np.arange(len(nodes)))
        yield pd.DataFrame({"u": nodes[own], "v": nodes[label[own]]})


def _unsettled(edges: DataFrame) -> bool:
    """Whether edges (u, v), v the lesser and none twice, are not yet stars: a node points at two, or at one that points on."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")).select("e.*")
    points = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into")).where("out > 1 or (out > 0 and into > 0)")
    return points.agg(F.count("*")).first()[0] > 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a long, b long); component is the least node reachable.

    Loops and repeated edges change nothing; no edges, no rows.
    """
    now = edges.select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v")).where("u <> v").distinct()
    now = settled(now.mapInPandas(_stars, "u long, v long").distinct())
    while _unsettled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = settled(small.select("e.u", "e.v").where("u <> v").distinct())
    return now.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.col("m").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
