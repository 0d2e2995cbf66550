"""URL filtering by listed rules and by association rules mined from labelled urls.

A url's tokens are its scheme, the labels of its host, the words of its path (runs of digits as ``#``) and the keys
of its query.  Spark's FP-growth counts the token combinations that labelled urls share; those that foretell a label
often enough (``MIN_SUPPORT``, ``MIN_CONFIDENCE``) and better than any part of theirs are rules.  An inverted index
holds each rule under its rarest token; a url looks up its own tokens and keeps the rules all of whose tokens it has.

Everything is DataFrame functions.  Labels are those that a list of hand-written rules gives, unless others are
handed in; urls that the list doesn't decide get the mined verdict.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: Share of labelled urls that a combination and its label must be in, and how often the label must follow.
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.9
#: Listed rules of the query: (verdict, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Verdict of urls that neither the list nor a mined rule decides.
DEFAULT = "allow"
#: Where the index is too large to be sent to all tasks, each rule is dealt to so many places, and so are the urls of a common token.
SALTS = 16

RULE = "anchor string, items array<array<string>>, label string, confidence double, hits long, size int"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.coalesce(lowered(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://`` and for null."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def tokens(url: Column) -> Column:
    """The distinct tokens of a url, sorted; none for null and for texts without ``://``."""
    named = lambda kind, parts: F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    scheme = named("s:", F.array(lowered(F.regexp_extract(url, r"(?s)^(.*?)://", 1))))
    words = F.split(F.regexp_replace(path(url), "[0-9]+", "#"), r"[/._-]+")
    keys = F.transform(F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0])
    found = F.concat(scheme, named("h:", F.split(host(url), r"\.")), named("p:", words), named("q:", keys))
    return F.when(url.contains("://"), F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))


def listed(url_host: Column, url_path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct<rule, verdict> of the longest listed rule that fits, of equals the first by name; null where none does.

    A rule fits its host and all hosts below it where the url's path begins with the rule's.  The list is written by
    hand and held in the plan.
    """
    one = lambda r: F.struct(F.lit(len(r[1])).alias("size"), F.lit(r[1]).alias("rule"), F.lit(r[0]).alias("verdict"), F.lit(r[1].partition("/")[0]).alias("host"), F.lit("/" + r[1].partition("/")[2]).alias("path"))
    fits = lambda r: ((url_host == r["host"]) | url_host.endswith(F.concat(F.lit("."), r["host"]))) & url_path.startswith(r["path"])
    ordered = sorted(dict.fromkeys(rules), key=lambda r: (-len(r[1]), r[1], r[0]))
    return F.get(F.filter(F.array(*map(one, ordered)), fits), F.lit(0)) if ordered else F.lit(None).cast("struct<size:int,rule:string,verdict:string,host:string,path:string>")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (anchor, items, label, confidence, hits, size) from all rows of ``labelled`` (items array<string>, label string).

    Tokens that stand in exactly the same rows tell the same.  The first by name is mined for all of them, so repeated
    urls and chains of folders don't multiply the combinations, and a rule takes any of them in its place: an item is
    the list of such tokens, and a url must have one of each.  ``hits`` counts the rows with all items and the label.
    A rule is dropped where one of its items can go without loss of confidence.  It has a row for each token of its
    rarest item, the anchor.  No labelled rows, no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.where("label is not null").select(F.array_distinct("items").alias("items"), "label")
    held = scratch(spark, "labelled")
    rows.withColumn("row", F.monotonically_increasing_id()).write.parquet(held)
    rows = spark.read.parquet(held)
    n = rows.count()
    if not n:
        return spark.createDataFrame([], RULE)
    # the same rows, told by their number and two sums over their hashes
    one = rows.select(F.explode("items").alias("item"), F.xxhash64("row").alias("a"), F.hash("row").cast("long").alias("b"))
    alike = one.groupBy("item").agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(38,0)")).alias("a"), F.sum("b").alias("b"))
    held = scratch(spark, "alike")
    alike.where(F.col("n") >= math.ceil(min_support * n)).groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("item")).alias("alike")).select(F.col("alike")[0].alias("item"), "alike").write.parquet(held)
    alike = spark.read.parquet(held)
    # a row of the list at most T / min_support, where T is the mean number of tokens: FP-growth brings as many to the driver
    kept = F.array(*(F.lit(r[0]) for r in sorted(alike.select("item").collect()))).cast("array<string>")
    baskets = rows.select(F.concat(F.array_intersect("items", kept), F.array(F.concat(F.lit("label:"), "label"))).alias("items"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = scratch(spark, "itemsets")
    sets = FPGrowth(itemsCol="items", minSupport=min_support, numPartitions=parts).fit(baskets).freqItemsets
    is_label = lambda x: x.startswith("label:")
    sets = sets.select(F.array_sort(F.filter("items", lambda x: ~is_label(x))).alias("items"), F.substring(F.get(F.filter("items", is_label), F.lit(0)), 7, 1 << 20).alias("label"), F.col("freq").alias("hits"))
    sets.where(F.size("items") > 0).write.parquet(found)
    sets = spark.read.parquet(found)
    alone = sets.where("label is null")
    rules = sets.where("label is not null").join(alone.select("items", F.col("hits").alias("all")), "items").withColumn("confidence", F.col("hits") / F.col("all")).drop("all")
    # all confident rules stay in reach of the ones that drop them: a smaller rule has as many hits or more
    less = rules.withColumn("part", F.explode(F.transform("items", lambda x: F.array_remove("items", x)))).where(F.size("part") > 0)
    plain = rules.select(F.col("items").alias("part"), F.col("label").alias("_l"), F.col("confidence").alias("_c"))
    dropped = less.join(plain, ["part"]).where("label = _l and _c >= confidence").select("items", "label").distinct()
    rules = rules.where(F.col("confidence") >= min_confidence).join(dropped, ["items", "label"], "left_anti")
    # the rarest of a rule's tokens
    each = rules.withColumn("item", F.explode("items")).join(alone.where(F.size("items") == 1).select(F.col("items")[0].alias("item"), F.col("hits").alias("n")), "item")
    each = each.join(alike, "item").groupBy("items", "label", "confidence", "hits").agg(F.min(F.struct("n", "item", "alike"))["alike"].alias("anchors"), F.array_sort(F.collect_list("alike")).alias("alike"))
    out = scratch(spark, "rules")
    each.select(F.explode("anchors").alias("anchor"), F.col("alike").alias("items"), "label", "confidence", "hits", F.size("alike").alias("size")).write.parquet(out)
    return spark.read.parquet(out)


def judged(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (any columns, among them ``tokens``), each row once, with ``mined``: the best rule whose tokens it has.

    Best is the most confident, then the one with most hits, the shortest, the last label and the last tokens by
    name.  Rows are grouped by all their columns, so the caller makes them distinct first.  Rules were written as
    a table, so Spark knows their size: it sends them to all tasks where that is small, else both sides are dealt by
    token and salt, so that no task gets all urls of a common token.
    """
    keys = [c for c in urls.columns if c != "tokens"]
    rules = rules.select("anchor", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.struct("confidence", "hits", (-F.col("size")).alias("size"), "label", "items").alias("_rule"))
    dealt = urls.select(*keys, "tokens", F.explode_outer("tokens").alias("anchor"), F.pmod(F.xxhash64(*keys), F.lit(SALTS)).cast("int").alias("_salt"))
    met = dealt.join(rules, ["anchor", "_salt"], "left")
    fits = F.when(F.forall("_rule.items", lambda alike: F.arrays_overlap(alike, F.col("tokens"))), F.col("_rule"))
    order = F.struct("_rule.confidence", "_rule.hits", "_rule.size", "_rule.label", F.array_join(F.transform("_rule.items", lambda alike: F.array_join(alike, "|")), " ").alias("items"))
    best = met.withColumn("_fit", F.when(fits.isNotNull(), order)).groupBy(*keys, "tokens").agg(F.max("_fit").alias("mined"))
    return best.drop("tokens")


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, labelled: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of every row of ``pages`` (page_id, url).

    The list decides where a rule of its fits; else the best mined rule, else ``default``.  Rules are mined from the
    urls that the list decides, or from ``labelled`` (url, label).  Null urls and texts without ``://`` have an empty
    host and path, no tokens and the default verdict; repeated rows stay, ids may be null or repeat, other columns are
    not looked at.  No labelled urls: the list and the default decide.
    """
    rows = pages.select("page_id", "url").groupBy("page_id", "url").agg(F.count("*").alias("_times"))
    base = rows.select("page_id", "_times", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("tokens"))
    by_list = lambda df: df.withColumn("_listed", listed(F.col("host"), F.col("path"), rules))
    if labelled is None:
        own = pages.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), tokens(F.col("url")).alias("items"))
        mined = mine(by_list(own).where("_listed is not null").select("items", F.col("_listed.verdict").alias("label")))
    else:
        mined = mine(labelled.select(tokens(F.col("url")).alias("items"), "label"))
    out = by_list(judged(base, mined))
    verdict = F.coalesce("_listed.verdict", "mined.label", F.lit(default))
    out = out.select("page_id", "host", "path", F.col("_listed.rule").alias("rule"), verdict.alias("verdict"), F.col("mined.items").alias("mined"), "_times")
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_times", "_n")


def oracle_sql(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """DuckDB SQL for ``judge`` with the rules given: all combinations of each labelled url's tokens, counted one by one."""
    quote = lambda s: s.replace("'", "''")
    values = ", ".join(f"('{v}', '{quote(r)}', '{quote(r.partition('/')[0])}', '/{quote(r.partition('/')[2])}')" for v, r in rules)
    return rf"""
    WITH listed(verdict, rule, rhost, rpath) AS (VALUES {values}),
    cut AS (SELECT row_number() OVER () AS k, page_id, coalesce(url, '') AS url, contains(coalesce(url, ''), '://') AS has, regexp_extract(coalesce(url, ''), '(?s)^(.*?)://', 1) AS scheme,
      regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1) AS host0, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(coalesce(url, ''), '(?s)^[^?#]*\?([^#]*)', 1) AS query FROM pages),
    page AS (SELECT *, translate(host0, '{_UPPER}', '{_LOWER}') AS host, translate(scheme, '{_UPPER}', '{_LOWER}') AS sch FROM cut),
    bag AS (SELECT k, page_id, host, path, CASE WHEN has THEN list_sort(list_distinct(list_concat(
        CASE WHEN sch = '' THEN [] ELSE ['s:' || sch] END,
        list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
        list_transform(list_filter(string_split_regex(regexp_replace(path, '[0-9]+', '#', 'g'), '[/._-]+'), lambda x: x <> ''), lambda x: 'p:' || x),
        list_transform(list_filter(list_transform(string_split(query, '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'q:' || x)))) ELSE [] END AS tokens FROM page),
    fit AS (SELECT k, arg_max(rule, (length(rule), rule)) AS rule, arg_max(verdict, (length(rule), rule)) AS verdict FROM bag, listed WHERE (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) GROUP BY k),
    train AS (SELECT k, tokens, verdict AS label FROM bag JOIN fit USING (k)), size AS (SELECT count(*) AS n FROM train),
    tok AS (SELECT token, list(k ORDER BY k) AS rows, count(*) AS n FROM (SELECT k, unnest(tokens) AS token FROM train) GROUP BY token HAVING count(*) >= (SELECT ceil({MIN_SUPPORT} * n) FROM size)),
    cls AS (SELECT token, min(token) OVER (PARTITION BY rows) AS rep FROM tok), rep AS (SELECT DISTINCT rep AS token FROM cls),
    has AS (SELECT k, list(DISTINCT rep) AS reps FROM (SELECT k, unnest(tokens) AS token FROM bag) JOIN cls USING (token) GROUP BY k),
    slim AS (SELECT k, label, list_sort(list_intersect(tokens, reps)) AS t FROM train, (SELECT list(token) AS reps FROM rep)),
    sub AS (SELECT label, list_transform(list_filter(range(0, len(t)), lambda i: (m >> i) & 1 = 1), lambda i: t[i + 1]) AS items FROM (SELECT *, unnest(range(1, 1::BIGINT << len(t))) AS m FROM slim)),
    freq AS (SELECT items, label, count(*) AS hits FROM sub GROUP BY ALL),
    assoc AS (SELECT items, label, hits, hits / sum(hits) OVER (PARTITION BY items) AS confidence FROM freq),
    strong AS (SELECT * FROM assoc WHERE confidence >= {MIN_CONFIDENCE} AND hits >= (SELECT ceil({MIN_SUPPORT} * n) FROM size)),
    best AS (SELECT k, arg_max(label, (confidence, hits, -len(items), label)) AS label FROM has JOIN strong ON list_has_all(reps, items) GROUP BY k)
    SELECT page_id, host, path, rule, coalesce(fit.verdict, best.label, '{DEFAULT}') AS verdict FROM bag LEFT JOIN fit USING (k) LEFT JOIN best USING (k)"""


ORACLE_SQL = oracle_sql()
