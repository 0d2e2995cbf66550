"""Placeholders: allocation, protection and what is kept of them.

Mappings are rows (scope, type, idx, identity, value), and surface where a stand-in is shown instead of a token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.checks import canonical
from veilframe.functions.shared import settled
from veilframe.functions.spans import splice

from .privacy import Policy

COLUMNS = ["scope", "type", "idx", "identity", "value"]
STYLES = {"angle": "<%s_%03d>", "square": "[%s_%03d]", "curly": "{%s_%03d}"}
#: Fixed bound: what a placeholder's number may be at most.
TOP = 999_999


def numbered(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with ``idx``: 1, 2, ... in each group of ``keys``, in the order given, which must be total.

    Rows are sorted over all tasks at once, so a group may span any number of them: each task counts what it holds
    of a group, and a running sum over those counts says where its numbers begin.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    spread = settled(spread.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    held = spread.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count("*").alias("_many"))
    before = F.sum("_many").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    held = held.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_many")
    return spread.join(held, ["_part", *keys]).withColumn("idx", (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("int")).drop("_part", "_at", "_first", "_before")


def allocate(decided: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """mappings: dense per scope and type in order of turn and place, the first spelling of a value kept.

    Only texts that may leave and only values to anonymize take an index.  Known identities in ``before`` keep
    theirs and new ones go on behind the largest.
    """
    e = decided.where("status = 'ok'").select("scope", "turn", F.explode(F.filter("entities", lambda e: e["action"] == "anonymize")).alias("e"))
    e = e.select("scope", "turn", "e.type", "e.start", "e.value").withColumn("identity", canonical(F.col("value")))
    seen = e.groupBy("scope", "type", "identity").agg(F.min(F.struct("turn", "start", "value")).alias("f")).select("scope", "type", "identity", "f.*")
    order = ["turn", "start", "identity"]
    fits = F.when(F.col("idx") <= TOP, F.col("idx")).otherwise(F.raise_error(F.lit("a scope has more values of a type than placeholders have numbers")).cast("int"))
    if before is None:
        return numbered(seen, ["scope", "type"], order).withColumn("idx", fits).select(*COLUMNS)
    top = before.groupBy("scope", "type").agg(F.max("idx").alias("top"))
    new = numbered(seen.join(before.select("scope", "type", "identity"), ["scope", "type", "identity"], "left_anti"), ["scope", "type"], order)
    new = new.join(top, ["scope", "type"], "left").withColumn("idx", (F.col("idx") + F.coalesce("top", F.lit(0))).cast("int")).withColumn("idx", fits)
    return before.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def protect(decided: DataFrame, mappings: DataFrame, policy: Policy, style: str = "angle") -> DataFrame:
    """(scope, turn, status, protected_text, reversible): null text where blocked or refused.

    (scope, turn) is the key of texts.  Values show their mapping's surface where it has one, else their token.
    """
    ok = decided.where("status = 'ok'")
    e = ok.where(F.size("entities") > 0).select("scope", "turn", F.explode("entities").alias("e")).withColumn("type", F.col("e.type")).withColumn("identity", canonical(F.col("e.value")))
    surface = F.col("surface") if "surface" in mappings.columns else F.lit(None).cast("string")
    e = e.join(mappings.select("scope", "type", "identity", "idx", surface.alias("surface")), ["scope", "type", "identity"], "left")
    token = F.coalesce("surface", F.format_string(STYLES[style], "type", "idx"))
    shown = F.when(F.col("e.action") == "allow", F.col("e.value")).when(F.col("e.action") == "mask", policy.mask_token).otherwise(token)
    cuts = e.groupBy("scope", "turn").agg(F.array_sort(F.collect_list(F.struct(F.col("e.start").alias("start"), F.col("e.end").alias("end"), shown.alias("shown")))).alias("cuts"), F.max((F.col("e.action") == "mask").cast("int")).alias("masked"))
    df = decided.join(cuts, ["scope", "turn"], "left")
    text = F.when(F.col("status") == "ok", F.coalesce(splice(F.col("text"), F.col("cuts")), F.col("text")))
    return df.select("scope", "turn", "status", text.alias("protected_text"), (F.coalesce("masked", F.lit(0)) == 0).alias("reversible"))


# Stand-ins: invented names, reserved domains, numbers and addresses set aside for examples.
POOLS: dict[tuple[str, str], tuple[str, ...]] = {
    ("PERSON", "en"): ("Avery Lane", "Rowan Hale", "Jordan Finch", "Casey Wren", "Morgan Pike", "Quinn Harbor", "Ellis Ford", "Harper Dunn"),
    ("PERSON", "ja"): ("青山 仁", "白石 明", "緑川 葵", "桜庭 薫", "月島 渚", "星川 翼"),
    ("PERSON", "zh"): ("安宁", "白雪", "江月", "林夏", "秋阳", "叶青"),
    ("COMPANY_NAME", "en"): ("Bluefield Works", "Northgate Supply", "Harborline Group", "Maple Row Trading", "Stonebridge Partners"),
    ("COMPANY_NAME", "ja"): ("青空商会", "若葉産業", "東雲物産", "月光工房"),
    ("COMPANY_NAME", "zh"): ("蓝天商行", "青禾实业", "晨光贸易", "远山工坊"),
    ("PHONE", "en"): ("+1 555 0100", "+1 555 0101", "+1 555 0102", "+1 555 0103", "+1 555 0104"),
    ("PHONE", "ja"): ("03-0000-0001", "03-0000-0002", "03-0000-0003"),
    ("PHONE", "zh"): ("010-00000001", "010-00000002", "010-00000003"),
    ("EMAIL", "*"): tuple(f"contact{k}@example.com" for k in range(1, 13)),
    ("INTERNAL_IP", "*"): tuple(f"192.0.2.{k}" for k in range(1, 13)),
    ("INTERNAL_URL", "*"): tuple(f"https://example.org/{k}" for k in range(1, 9)),
}


def text_locale(text: Column) -> Column:
    return F.when(text.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), "ja").when(text.rlike(r"\p{IsHan}"), "zh").otherwise("en")


def with_surrogates(mappings: DataFrame, texts: DataFrame) -> DataFrame:
    """mappings with ``surface``: a stand-in, or null where the token is shown.

    The k-th value of a scope and type takes the k-th stand-in of its pool or the next one that is free: not taken
    by a value before it and no value of the scope itself.  A pool serves at most as many values as it has
    stand-ins, so only those rows are gathered.  The locale is that of the text the value first stood in.
    """
    pools = mappings.sparkSession.createDataFrame([(t, loc, list(v)) for (t, loc), v in POOLS.items()], "type string, pool string, names array<string>")
    locale = texts.where("text is not null").groupBy("scope").agg(F.min_by(text_locale(F.col("text")), "turn").alias("locale"))
    few = mappings.where(F.col("idx") <= max(map(len, POOLS.values()))).join(F.broadcast(pools), "type").join(locale, "scope", "left")
    few = few.where((F.col("pool") == "*") | (F.col("pool") == F.coalesce("locale", F.lit("en")))).where(F.col("idx") <= F.size("names"))
    own = mappings.select("scope", F.col("value").alias("name"))
    taken = few.select("scope", "type", F.explode("names").alias("name")).distinct().join(own, ["scope", "name"], "left_semi").groupBy("scope", "type").agg(F.collect_set("name").alias("taken"))
    groups = few.groupBy("scope", "type").agg(F.array_sort(F.collect_list("idx")).alias("idx"), F.first("names").alias("names")).join(taken, ["scope", "type"], "left")
    start = F.from_json(F.lit("[]"), "array<struct<idx:int,surface:string>>")

    def take(acc: Column, i: Column) -> Column:
        turned = F.concat(F.slice("names", i, F.size("names") - i + 1), F.slice("names", F.lit(1), i - 1))
        free = F.array_except(F.array_except(turned, F.transform(acc, lambda a: a["surface"])), F.coalesce("taken", F.array().cast("array<string>")))
        return F.concat(acc, F.array(F.struct(i.alias("idx"), F.get(free, F.lit(0)).alias("surface"))))

    given = groups.select("scope", "type", F.explode(F.aggregate("idx", start, take)).alias("g")).select("scope", "type", "g.idx", "g.surface")
    return mappings.join(given, ["scope", "type", "idx"], "left").select(*mappings.columns, "surface")


def purge(mappings: DataFrame, scopes: DataFrame) -> DataFrame:
    """mappings without those of ``scopes`` (scope); their counters start anew."""
    return mappings.join(scopes.select("scope").distinct(), "scope", "left_anti")


def outgrown(mappings: DataFrame, most: int = 5_000) -> DataFrame:
    """(scope, mappings) of conversations that have to end: more mappings than the limit."""
    return mappings.groupBy("scope").agg(F.count("*").alias("mappings")).where(F.col("mappings") > most)


def protection_record(decided: DataFrame, mappings: DataFrame, policy: Policy, by: str = "", recall: str | None = None) -> DataFrame:
    """(scope, record): a value-free JSON document a scope: tokens and kinds, what was protected and masked; no place, length or value.

    ``mode`` tells how values are shown: by placeholders, by stand-ins (``surrogate``) or by both (``mixed``).  A
    stand-in is no token: its kind is counted under ``stand_ins`` of the second contract, which scopes with stand-ins
    have.  ``by`` and ``recall`` are told where they are known.
    """
    surface = F.col("surface") if "surface" in mappings.columns else F.lit(None).cast("string")
    maps = mappings.select("scope", F.col("type").alias("kind"), surface.isNotNull().alias("shown"))
    e = decided.where("status = 'ok'").select("scope", F.explode("entities").alias("e")).select("scope", F.col("e.type").alias("kind"), "e.action")
    lists = lambda df, n, name: df.groupBy("scope", "kind").agg(F.count("*").alias(n)).groupBy("scope").agg(F.array_sort(F.collect_list(F.struct("kind", n))).alias(name))
    df = decided.select("scope").distinct()
    for part in (lists(maps.where("not shown"), "tokens", "placeholders"), lists(maps.where("shown"), "count", "stand_ins"), lists(e.where("action = 'anonymize'"), "count", "protected"), lists(e.where("action = 'mask'"), "count", "masked")):
        part = part.withColumnRenamed("scope", "_s")
        df = df.join(part, F.col("scope").eqNullSafe(F.col("_s")), "left").drop("_s")
    none = lambda n: F.from_json(F.lit("[]"), f"array<struct<kind:string,{n}:bigint>>")
    stood, tokens = F.col("stand_ins").isNotNull(), F.col("placeholders").isNotNull()
    told = lambda value: F.lit(value or None).cast("string")
    body = F.struct(
        F.when(stood, "protection-scope/2").otherwise("protection-scope/1").alias("contract"), told(by).alias("by"), "scope", F.col("masked").isNull().alias("reversible"), F.when(stood & tokens, "mixed").when(stood, "surrogate").otherwise("placeholder").alias("mode"),
        F.coalesce("placeholders", none("tokens")).alias("placeholders"), "stand_ins", F.coalesce("protected", none("count")).alias("protected"), F.coalesce("masked", none("count")).alias("masked"), told(recall).alias("recall"), F.lit(policy.digest()).alias("policy_hash"),
    )
    return df.select("scope", F.to_json(body).alias("record"))
