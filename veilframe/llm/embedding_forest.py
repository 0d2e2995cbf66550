"""Near-duplicate embeddings by a forest of random-projection trees.

Trees are fitted on a bounded sample: each node projects on a random direction
and splits at the sample's median.  Every row is then dropped through every
tree; a row within the spill margin of a split goes to both sides, so two near
rows part only if the split lies between them and both are outside the margin.
Rows of a leaf with equal labels are compared exactly.  A row carries the leaves it
is in, so a pair that meets in several counts in the first alone; what leaves a
comparison are a row's count and one row it is united with, never pairs.

Equal vectors of a label are collapsed before, so thousands of copies are one
row.  How deep a label's rows fall depends on how many it has; leaves that stay
large (near copies that no plane parts) are compared in pairs of bounded blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settings, settled
from .components import components

THRESHOLD = 0.98
TREES = 6
#: Rows of one label that a leaf should hold.
LEAF = 200
#: Half-width of the band around a split whose rows go to both sides.
SPILL = 0.02
#: Vectors the trees are fitted on.
SAMPLE = 20_000
DEPTH = 16
#: Rows a comparison task holds on each side, and those of them that are compared at once.
BLOCK = 2_000
ROWS = 64


class Tree:
    """A complete tree: one direction a level and node, split at the median of the sample's rows in that node."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        self.depth, self.dim = depth, sample.shape[1]
        rng = np.random.default_rng(seed)
        self.plane, self.cut = [], []
        node = np.zeros(len(sample), np.int64)
        for level in range(depth):
            planes = rng.standard_normal((1 << level, self.dim)).astype(np.float32)
            planes /= np.linalg.norm(planes, axis=1, keepdims=True)
            cuts = np.zeros(1 << level, np.float32)
            value = np.einsum("ij,ij->i", sample, planes[node])
            order = np.lexsort((value, node))
            begin = np.searchsorted(node[order], np.arange((1 << level) + 1))
            for k in np.flatnonzero(np.diff(begin)).tolist():
                i, j = begin[k], begin[k + 1]
                cuts[k] = value[order[(i + j) // 2]]
            node = 2 * node + (value > cuts[node])
            self.plane.append(planes)
            self.cut.append(cuts)

    def leaves(self, x: np.ndarray, depth: np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of every leaf a row is in; row k falls ``depth[k]`` levels."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        done = []
        for level in range(self.depth):
            over = depth[row] <= level
            done.append((row[over], node[over]))
            row, node = row[~over], node[~over]
            if not len(row):
                break
            value = np.einsum("ij,ij->i", x[row], self.plane[level][node]) - self.cut[level][node]
            both = np.abs(value) <= spill
            right = value > 0
            row, node = np.r_[row, row[both]], np.r_[2 * node + right, 2 * node[both] + ~right[both]]
        done.append((row, node))
        return tuple(np.concatenate(x) for x in zip(*done))


def _unit(vectors: list, dim: int) -> np.ndarray:
    """Unit rows in double precision, cut or filled with zeros to ``dim``."""
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        m = min(dim, len(v))
        out[k, :m] = np.asarray(v[:m], np.float64)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The definition itself, dot / (|a| |b|), of rows as they are."""
    return np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))


def _met_before(a: np.ndarray, b: np.ndarray, here: int) -> np.ndarray:
    """Whether two rows (their leaves in ascending order, filled with -1) share a leaf below ``here``: there the pair counts."""
    met = np.zeros(len(a), bool)
    for k in range(a.shape[1]):
        own = a[:, k : k + 1]
        met |= ((own == b) & (own >= 0) & (own < here)).any(axis=1)
    return met


def compare_leaf(left: pd.DataFrame, right: pd.DataFrame | None, here: int, threshold: float) -> pd.DataFrame:
    """(rep, near, other): per row how many vectors it is linked with in this leaf and in none before, and a row it is united with.

    Columns: rep, copies, leaves (packed), embedding.  Rows of ``left`` are compared with those of ``right``, or with
    each other.  Matches are counted a bounded number of pairs at a time; no list of pairs is kept.
    """
    same = right is None
    f = left if same else pd.concat([left, right], ignore_index=True)
    n, first = len(f), 0 if same else len(left)
    raw = np.array(f["embedding"].tolist(), np.float64)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    packed = [np.frombuffer(b, "<i8") for b in f["leaves"]]
    leaves = np.full((n, max(map(len, packed))), -1, np.int64)
    for k, own in enumerate(packed):
        leaves[k, : len(own)] = own
    copies, near, label = f["copies"].to_numpy(), np.zeros(n, np.int64), np.arange(n)
    for i in range(0, len(left), ROWS):
        stop = min(i + ROWS, len(left))
        product = unit[i:stop] @ unit[i if same else first :].T
        at, to = np.nonzero(product >= threshold - 1e-9)
        doubt = product[at, to] < threshold + 1e-9
        at, to = at + i, to + (i if same else first)
        keep = at < to
        if doubt.any():
            keep[doubt] &= _exact(raw[at[doubt]], raw[to[doubt]]) >= threshold
        at, to = at[keep], to[keep]
        while len(at):  # unite: every row takes the least label it meets, until none changes
            a, b = label[at], label[to]
            if (a == b).all():
                break
            least = np.minimum(a, b)
            np.minimum.at(label, a, least)
            np.minimum.at(label, b, least)
            while (label[label] != label).any():
                label = label[label]
        new = ~_met_before(leaves[at], leaves[to], here)
        near += np.bincount(at[new], copies[to[new]], minlength=n).astype(np.int64) + np.bincount(to[new], copies[at[new]], minlength=n).astype(np.int64)
    rep = f["rep"].to_numpy()
    some = np.flatnonzero((near > 0) | (label != np.arange(n)))
    return pd.DataFrame({"rep": rep[some], "near": near[some], "other": rep[label[some]]})


def link(rows: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """op10: vec_id, n_links, component_id, kept of every vector.

    Vectors compare when their labels are equal and not null and they have as many components.  Null, empty and
    zero vectors, and such with null or non-finite components, link with nothing.  vec_id is a key; rows that
    repeat it count as one vector, the first by its contents; rows without it link with nothing and stay, component and kept null.
    """
    spark = rows.sparkSession
    settings(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0))
    key = [F.col("label"), F.xxhash64("embedding", F.lit(1)).alias("k1"), F.xxhash64(F.reverse("embedding"), F.lit(2)).alias("k2")]
    keyed = usable.select("vec_id", "embedding", *key)
    classes = settled(keyed.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("copies"), F.first("embedding").alias("embedding")))
    member = keyed.select("vec_id", "label", "k1", "k2").join(classes.select("label", "k1", "k2", "rep", "copies"), ["label", "k1", "k2"]).groupBy("vec_id").agg(F.min_by("rep", F.struct("rep")).alias("rep"), F.min_by("copies", F.struct("rep")).alias("copies"))
    classes = classes.withColumn("dim", F.size("embedding"))
    sample = [r[0] for r in classes.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(SAMPLE).select("embedding").collect()]
    dim = max((len(v) for v in sample), default=1)
    fitted = _unit(sample, dim).astype(np.float32) if sample else np.zeros((1, 1), np.float32)
    per = classes.groupBy("label", "dim").agg(F.count("*").alias("many"))
    per = per.withColumn("depth", F.greatest(F.lit(0), F.least(F.lit(DEPTH), F.ceil(F.log2(F.col("many") / leaf)))).cast("int"))
    deepest = per.agg(F.max("depth")).first()[0] or 0
    deepest = min(deepest, max(1, len(sample)).bit_length())
    forest = spark.sparkContext.broadcast([Tree(fitted, deepest, seed + t) for t in range(trees)])  # sample-sized, whatever the table

    def drop(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            x = _unit(f["embedding"].tolist(), dim).astype(np.float32)
            depth = f["depth"].to_numpy()
            row, leaf = [], []
            for t, tree in enumerate(forest.value):
                # a label that fits into one leaf needs one tree
                some = np.arange(len(x)) if not t else np.flatnonzero(depth > 0)
                r, node = tree.leaves(x[some], depth[some], spill)
                row.append(some[r])
                leaf.append((t << 32) + node)
            row, leaf = np.concatenate(row), np.concatenate(leaf)
            order = np.lexsort((leaf, row))
            row, leaf = row[order], leaf[order]
            cut = np.searchsorted(row, np.arange(len(x) + 1)).tolist()
            own = [leaf[i:j].astype("<i8").tobytes() for i, j in zip(cut, cut[1:])]
            yield pd.DataFrame({"rep": f["rep"].to_numpy()[row], "label": f["label"].to_numpy()[row], "dim": f["dim"].to_numpy()[row], "leaf": leaf, "copies": f["copies"].to_numpy()[row], "leaves": [own[k] for k in row.tolist()]})

    kind = classes.schema["label"].dataType.simpleString()
    deep = classes.join(per.select("label", "dim", "depth"), ["label", "dim"]).select("rep", "label", "dim", "copies", "depth", "embedding")
    dropped = settled(deep.mapInPandas(drop, f"rep long, label {kind}, dim int, leaf long, copies long, leaves binary"))
    leaf_key = ["label", "dim", "leaf"]
    size = dropped.groupBy(*leaf_key).agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"), F.count("*").alias("many")).where("many > 1").drop("many")
    dealt = dropped.join(size, leaf_key).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    # every pair of blocks meets once: (low, high)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).join(classes.select("rep", "embedding"), "rep")

    def compare(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        here, low, high = int(key[2]), key[-2], key[-1]
        left, right = (f, None) if low == high else (f[f["own"] == low], f[f["own"] == high])
        if not len(left) or right is not None and not len(right):
            return pd.DataFrame({"rep": [], "near": [], "other": []}, dtype="int64")
        return compare_leaf(left, right, here, threshold)

    met = settled(dealt.select(*leaf_key, "low", "high", "own", "rep", "copies", "leaves", "embedding").groupBy(*leaf_key, "low", "high").applyInPandas(compare, "rep long, near long, other long"))
    near = met.groupBy("rep").agg(F.sum("near").alias("near"))
    united = components(met.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    member = member.join(near, "rep", "left").join(united, "rep", "left")
    member = member.select("vec_id", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.where("vec_id is not null").select("vec_id").distinct().join(member, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    nameless = rows.where("vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), "vec_id")
    return out.unionAll(nameless.toDF(*out.columns)).withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id AS v, vec_id AS c FROM v UNION SELECT k.b, r.c FROM r JOIN k ON k.a = r.v),
m AS (SELECT v AS vec_id, min(c) AS component_id FROM r GROUP BY v),
d AS (SELECT a AS vec_id, count(*) AS n FROM k GROUP BY a)
SELECT m.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, m.component_id, m.vec_id = m.component_id AS kept FROM m LEFT JOIN d USING (vec_id)
"""
