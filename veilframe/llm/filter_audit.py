"""What each of several filters removes in every order they could be applied in.

Orders form a trie: filters applied left to right.  What survives depends on which filters were applied, not on their
order, so a state is a set of filters and is computed once: depth first, each state's survivors are the persisted
DataFrame of the state above it with one filter applied, and are counted as they are - per part, how many the
filters still to come remove from them, and how many of those are labelled.  A state's counts are written as a table;
then its survivors are given back.  Orders look their edges up in those tables.

Texts are read once, to judge each document by every filter; survivors are rows of a part and a few flags.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

FILTERS = "ABCDE"
#: A text that more than one in so many documents has is looked up by a broadcast list, which so has fewer rows than that.
HOT = 1000
_SPACE = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> dict[str, Column]:
    """Conditions of the filters that look at one text; null is empty.

    A: under 200 words; B: fewer distinct words than half of all; C: more than 2 in 100 characters in A-Z;
    D: any of # $ % & * |.  Words lie between blanks and are told apart by case.
    """
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 200, "B": 100 * F.size(F.array_distinct(words)) < 50 * n, "C": 100 * capitals > 2 * F.length(text), "D": text.rlike("[#$%&*|]")}


def repeats(hashed: DataFrame) -> DataFrame:
    """hashed (digest, doc_id, ...) with ``E``: whether a smaller id has the same text.

    Only texts that several rows have are joined back.  Each of those that more than one in ``HOT`` rows has is in a
    list of fewer than ``HOT`` rows that all tasks get, so no task meets all copies of one text.
    """
    many = hashed.groupBy("digest").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n")).where("_n > 1")
    held = scratch(hashed.sparkSession, "copies")
    many.write.parquet(held)
    many = hashed.sparkSession.read.parquet(held)
    line = hashed.count() // HOT
    hot = many.where(F.col("_n") > line).select("digest", F.col("_least").alias("_hot"))
    rest = many.where(F.col("_n") <= line).select("digest", "_least")
    met = hashed.join(F.broadcast(hot), "digest", "left")
    cold = met.where("_hot is null").join(rest, "digest", "left")
    both = cold.unionByName(met.where("_hot is not null").withColumn("_least", F.lit(None).cast("long")))
    return both.withColumn("E", F.coalesce(F.col("doc_id") > F.coalesce("_hot", "_least"), F.lit(False))).drop("_hot", "_least")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, ..., E, good, toxic) of every row of ``docs`` (doc_id, text, source).

    part is the source, empty for null.  Ids may be null (those rows repeat nothing and have no label) or repeat.
    A document is good or toxic if any of its labels says so.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), *(c.alias(k) for k, c in failures(F.col("text")).items()))
    held = scratch(docs.sparkSession, "judged")
    rows.write.parquet(held)
    rows = repeats(docs.sparkSession.read.parquet(held)).drop("digest")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = rows.join(marks.where("good or toxic"), "doc_id", "left")
    return marked.select("part", *FILTERS, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _counted(survivors: DataFrame, rest: str) -> DataFrame:
    """(part, kept, f, removed, good, toxic) of one state: what each filter still to come would take from it."""
    n = lambda *conditions: F.count_if(reduce(lambda a, b: a & b, map(F.col, conditions)))
    edges = [F.struct(F.lit(f).alias("f"), n(f).alias("removed"), n(f, "good").alias("good"), n(f, "toxic").alias("toxic")) for f in rest]
    return survivors.groupBy("part").agg(F.count("*").alias("kept"), F.array(*edges).alias("edges"))


def executed(judged: DataFrame) -> DataFrame:
    """(state int, part, kept, edges): every set of filters, bit k for the k-th, and its survivors counted.

    Depth first from no filter; a state that was reached by another order is not executed again.  At most as many
    states are persisted at once as there are filters.
    """
    spark = judged.sparkSession
    path, done = scratch(spark, "states"), set()

    def visit(state: frozenset, survivors: DataFrame) -> None:
        done.add(state)
        rest = [f for f in FILTERS if f not in state]
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        if rest:
            number = sum(1 << FILTERS.index(f) for f in state)
            _counted(survivors, "".join(rest)).write.parquet(f"{path}/state={number}")
        for f in rest:
            if state | {f} not in done and len(rest) > 1:
                visit(state | {f}, survivors.where(~F.col(f)))
        survivors.unpersist()

    visit(frozenset(), judged)
    schema = "part string, kept long, edges array<struct<f:string,removed:long,good:long,toxic:long>>, state int"
    return spark.read.schema(schema).parquet(path)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): a row a part,
    order of the filters and step.

    Null texts are empty, null sources the part named by the empty text, other columns are not looked at; no
    documents, no rows.  ``shapley`` sums what a step's filter removes over all orders.
    """
    spark = docs.sparkSession
    held = scratch(spark, "verdicts")
    verdicts(docs, labels).write.parquet(held)
    states = executed(spark.read.parquet(held))
    every, count = (1 << len(FILTERS)) - 1, len(FILTERS)
    weights = F.array(*(F.lit(math.factorial(k) * math.factorial(count - 1 - k)) for k in range(count)))  # orders that come by an edge behind k filters
    e = states.select("part", "state", "kept", F.explode("edges").alias("e")).select("part", "state", "e.f", F.concat(F.col("state").cast("string"), "e.f").alias("edge"), (F.col("kept") - F.col("e.removed")).alias("kept"), "e.removed", "e.good", "e.toxic")
    of = lambda f, n: F.coalesce(F.sum(F.when(F.col("f") == f, n)), F.lit(0).cast("long"))
    removed, share = F.col("removed"), F.col("removed") * F.get(weights, F.bit_count("state"))
    totals = F.array(*(F.struct(of(f, F.when(F.col("state") == 0, removed)).alias("fails"), of(f, F.when(F.col("state") == every - (1 << k), removed)).alias("only"), of(f, share).alias("share")) for k, f in enumerate(FILTERS)))
    parts = e.groupBy("part").agg(totals.alias("totals"), F.map_from_entries(F.collect_list(F.struct("edge", F.struct("kept", "removed", "good", "toxic")))).alias("edges"))  # 80 edges at most
    steps = [(("".join(o)), k + 1, o[k], f"{sum(1 << FILTERS.index(x) for x in o[:k])}{o[k]}") for o in itertools.permutations(FILTERS) for k in range(len(FILTERS))]
    way = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(FILTERS.index(f)).alias("f"), F.lit(e).alias("edge")) for o, k, f, e in steps))
    df = parts.withColumn("s", F.explode(way)).select("part", "s.filter_order", "s.step", F.get("totals", F.col("s.f")).alias("t"), F.col("edges")[F.col("s.edge")].alias("v"))
    value = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    removed = value(F.col("v.removed"))
    return df.select("part", "filter_order", "step", value(F.col("v.kept")).alias("kept"), removed.alias("removed"), (F.col("t.fails") - removed).alias("redundant"), F.col("t.only").alias("unique_fails"), value(F.col("v.good")).alias("good_lost"), value(F.col("v.toxic")).alias("toxic_lost"), F.col("t.share").alias("shapley"))


ORACLE_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS part FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
    l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
    v AS (SELECT part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(w.doc_id > least, false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l USING (doc_id)),
    f AS (SELECT unnest(range(1, 6)) AS f),
    o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
    s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
    k AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM v GROUP BY ALL),
    x AS (SELECT k.*, o, step, o[step] AS f, len(list_filter(o[1:step - 1], lambda j: fails[j])) > 0 AS before, len(list_filter(fails, lambda b: b)) AS many FROM k, s),
    r AS (SELECT part, o, step, f, sum(CASE WHEN NOT before AND NOT fails[f] THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT before AND fails[f] THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN before AND fails[f] THEN n ELSE 0 END)::BIGINT AS redundant,
      sum(CASE WHEN fails[f] AND many = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails, sum(CASE WHEN NOT before AND fails[f] THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT before AND fails[f] THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM x GROUP BY ALL)
    SELECT part, array_to_string(list_transform(o, lambda j: substr('ABCDE', j, 1)), '') AS filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM r"""
