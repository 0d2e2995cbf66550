"""Every query of the library, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions.checks import entropy, luhn, preview, private_ipv4
from veilframe.functions.shared import settled, small_batches
from veilframe.functions.spans import spans
from veilframe.operators import mappings as M
from veilframe.operators import privacy as P
from veilframe.operators import restore as R
from veilframe.operators import sessions as S
from veilframe.operators.rules import Rule, rules_for

from .rule_sql import actions, candidates, resolution

EMAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
PHONE = r"\+[0-9]{1,3}[ -]?(?:\([0-9]{1,4}\)[ -]?)?[0-9]{1,4}(?:[ -]?[0-9]{2,4}){1,4}"
CARD = r"[0-9]{4}(?:[ -]?[0-9]{4}){3}"
IPV4 = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
TOKEN = r'(token = ")([0-9a-f]{40})'
#: The rules that SQL can state without look-around.  Two may meet in one place, as a phone number does with a card behind it.
SLICE = [Rule("EMAIL", EMAIL, 1.0, need="@"), Rule("PHONE", PHONE, 0.7, need="+"), Rule("CREDIT_CARD", CARD, 1.0, validator="luhn"), Rule("PASSWORD", TOKEN, 0.7, grouped=True, need="token")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as they are read; only where that gives fewer tasks than there are cores (a small file) are they dealt out."""
    d = _table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").alias("turn"), "text")
    cores = spark.sparkContext.defaultParallelism
    return d if d.rdd.getNumPartitions() >= cores else d.repartition(4 * cores)


def _spans(pattern: str, grouped: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(spark, sf_dir).select(F.col("turn").alias("doc_id"), F.explode(spans(F.col("text"), pattern, grouped)).alias("s")).select("doc_id", F.col("s.start").alias("start_at"), F.col("s.value").alias("value"))

    return run


def _spans_sql(pattern: str, group: int = 0) -> str:
    q = pattern.replace("'", "''")
    p = f"coalesce(length(list_extract(regexp_extract_all(text, '{q}', 1), i)), 0)" if group else "0"
    return f"""
    WITH m AS (SELECT doc_id, text, regexp_extract_all(text, '{q}') AS m, string_split_regex(text, '{q.replace("(token", "(?:token").replace(")([0-9a-f]", ")(?:[0-9a-f]")}') AS p FROM documents),
    u AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m)
    SELECT doc_id, (list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) + {p})::INT AS start_at,
      list_extract(regexp_extract_all(text, '{q}', {2 if group else 0}), i) AS value FROM u"""


def _decided(spark: SparkSession, sf_dir: str, policy: P.Policy = P.Policy()) -> DataFrame:
    """All documents, judged by all rules of all packs over their normalized texts."""
    return P.decide(P.detect(_texts(spark, sf_dir), rules_for()), policy)


def _entities(decided: DataFrame) -> DataFrame:
    return decided.select("scope", "turn", "status", F.explode("entities").alias("e")).select("scope", "turn", "status", "e.*")


_LUHN = """list_sum(list_transform(range(1, length(d) + 1), lambda k: CASE WHEN (length(d) - k) % 2 = 0 THEN d[k]::INT ELSE CASE WHEN d[k]::INT > 4 THEN 2 * d[k]::INT - 9 ELSE 2 * d[k]::INT END END)) % 10 = 0"""


def entities_sql(rules: list[Rule]) -> str:
    """Common tables hits, blocked and ok (scope, turn, type, value, place): what is left of the rules' hits and of token-shaped literals when overlaps are resolved."""
    literal = Rule("TEXT", P.PLACEHOLDER, 1.0, "literal")
    one = lambda r: f"SELECT doc_id, start_at AS s, start_at + length(value) AS e, value, '{r.type}' AS type, {float(r.confidence)}::DOUBLE AS conf, {P.ENTITY_TYPES[r.type][0]} AS sev, '{P.ENTITY_TYPES[r.type][1]}' AS cat, '{r.pack}' AS source, '{r.type}' AS rule FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({_spans_sql(r.pattern, 2 if r.grouped else 0)})) WHERE {_LUHN if r.validator == 'luhn' else 'true'}"
    return f"""
WITH RECURSIVE found AS ({" UNION ALL ".join(one(r) for r in [*rules, literal])}), {resolution(cand="found")},
hits AS (SELECT d.lang AS scope, d.doc_id AS turn, k.type AS type, k.value AS value, k.s AS place FROM kept JOIN documents d ON d.doc_id = kept.doc_id),
blocked AS (SELECT DISTINCT turn FROM hits WHERE type = 'PASSWORD'),
ok AS (SELECT * FROM hits WHERE turn NOT IN (SELECT turn FROM blocked))
"""


_ENTITIES = entities_sql(SLICE)


_ACTION = actions(P.Policy(), "k.type")
#: What ``_decided`` finds, by all rules: hits, the documents that are blocked, and the hits of the others.
_ALL = f"""WITH RECURSIVE {candidates(rules_for())}, {resolution()},
hits AS (SELECT d.lang AS scope, d.doc_id AS turn, k.type AS type, k.value AS value, k.s AS place, k.sev AS severity, k.cat AS category, {_ACTION} AS action FROM kept JOIN documents d ON d.doc_id = kept.doc_id),
blocked AS (SELECT DISTINCT turn FROM hits WHERE action = 'block'),
ok AS (SELECT * FROM hits WHERE turn NOT IN (SELECT turn FROM blocked) AND action = 'anonymize')
"""


def sendable_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language: documents, how many are blocked, and distinct placeholders of each type that the others need."""
    decided = _decided(spark, sf_dir)
    docs = decided.groupBy("scope").agg(F.count("*").alias("documents"), F.sum((F.col("status") == "blocked").cast("long")).alias("blocked"))
    kinds = _entities(decided).where("status = 'ok' and action = 'anonymize'").groupBy("scope").agg(*(F.count_distinct(F.when(F.col("type") == t, F.col("value"))).alias(t.lower()) for t in ("EMAIL", "PHONE", "CREDIT_CARD")))
    return docs.join(kinds, "scope", "left").select(F.col("scope").alias("lang"), "documents", "blocked", *(F.coalesce(t, F.lit(0)).cast("long").alias(t) for t in ("email", "phone", "credit_card")))


def detections_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(_decided(spark, sf_dir)).groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("turn").alias("n_docs"))


def blocked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).where("status = 'blocked'").select(F.col("turn").alias("doc_id"))


def policy_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(_decided(spark, sf_dir)).groupBy("type", "action", "category", "severity").agg(F.count("*").alias("n"))


def inspect_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _decided(spark, sf_dir).where(F.size("entities") > 0)
    return df.select(F.col("turn").alias("doc_id"), F.concat_ws(",", F.array_sort(F.array_distinct(F.transform("entities", lambda e: e["type"])))).alias("types"))


def placeholder_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of placeholders per scope and type, and the largest index: dense, so both agree."""
    m = M.allocate(_decided(spark, sf_dir))
    return m.groupBy("scope", "type").agg(F.count("*").alias("n"), F.max("idx").cast("long").alias("top"), F.min(F.when(F.col("idx") == 1, F.col("value"))).alias("first_value"))


def email_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with mail addresses masked."""
    policy = P.Policy(rules={"EMAIL": "mask", "TEXT": "anonymize"})
    decided = settled(P.decide(P.detect(_texts(spark, sf_dir), SLICE[:1], normalize=False), policy))
    out = M.protect(decided, M.allocate(decided), policy)
    return out.where(F.col("protected_text").contains("[REDACTED]")).select(F.col("turn").alias("doc_id"), F.sha2("protected_text", 256).alias("digest"), "reversible")


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sendable text, protected and restored again: as many as come back unchanged."""
    decided = settled(_decided(spark, sf_dir))
    maps = settled(M.allocate(decided))
    sent = M.protect(decided, maps, P.Policy()).where("status = 'ok'")
    back = R.restore(sent.select("scope", F.col("turn").alias("response_id"), F.col("protected_text").alias("text")), maps)
    same = back.join(decided.select(F.col("turn").alias("response_id"), "text"), "response_id").withColumn("same", F.col("restored_text") == F.col("text"))
    return same.groupBy("scope").agg(F.count("*").alias("texts"), F.sum(F.col("same").cast("long")).alias("unchanged"))


def card_luhn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(CARD)(spark, sf_dir).withColumn("valid", luhn(F.col("value")))


def ipv4_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(IPV4)(spark, sf_dir).withColumn("private", private_ipv4(F.col("value"))).drop("start_at")


def hex_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(TOKEN, True)(spark, sf_dir).select("doc_id", F.round(entropy(F.col("value")), 6).alias("bits"))


def masked_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(EMAIL)(spark, sf_dir).select("doc_id", preview(F.col("value")).alias("preview"))


def session_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.sessions(_table(spark, sf_dir, "events"), "user_id", "ts", "event_id")
    return s.groupBy("user_id").agg((F.max("session") + 1).cast("long").alias("sessions"), F.count("*").alias("events"))


def lru_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.most_recent(_table(spark, sf_dir, "events"), "user_id", "ts", 64).select("user_id")


def retention_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).first()[0]
    return S.expired(e.withColumn("now", F.lit(now)), "ts", F.col("now"), 7 * 86400).groupBy("event_type").agg(F.count("*").alias("n"))


def full_rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each rule of all packs fires, rules that never do included."""
    rules = rules_for()
    hits = P.detect(_texts(spark, sf_dir), rules).select(F.explode(F.transform("dets", lambda d: d["rule"])).alias("rule")).groupBy("rule").count()
    names = spark.createDataFrame([(r.id,) for r in rules], "rule string")
    return names.join(hits, "rule", "left").select("rule", F.coalesce("count", F.lit(0)).alias("n"))


def html_page_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemes that pages are served by, of pages with a mail address and without."""
    p = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), (F.size(spans(F.regexp_replace("html", "<[^>]*>", " "), EMAIL)) > 0).alias("has_mail"))
    return p.groupBy("scheme", "has_mail").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "email_spans": _spans(EMAIL), "phone_spans": _spans(PHONE), "token_assignment": _spans(TOKEN, True),
    **{f.__name__: f for f in (card_luhn, ipv4_class, hex_entropy, masked_preview, sendable_by_language, detections_by_type, blocked_documents, policy_actions, inspect_types, placeholder_allocation, email_protected, restore_roundtrip, session_expiry, lru_conversations, retention_expired, full_rule_audit, html_page_mail)},
}

ORACLE_SQL: dict[str, str] = {
    "email_spans": _spans_sql(EMAIL), "phone_spans": _spans_sql(PHONE), "token_assignment": _spans_sql(TOKEN, 2),
    "card_luhn": f"SELECT doc_id, start_at, value, {_LUHN} AS valid FROM (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM ({_spans_sql(CARD)}))",
    "ipv4_class": f"""SELECT doc_id, value, (a <= 255 AND b <= 255 AND c <= 255 AND o[4]::INT <= 255) AND (a IN (0, 10, 127) OR a >= 240 OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 198 AND b IN (18, 19)) OR (a = 192 AND b = 0 AND c IN (0, 2)) OR (a = 198 AND b = 51 AND c = 100) OR (a = 203 AND b = 0 AND c = 113)) AS private
      FROM (SELECT doc_id, value, o, o[1]::INT AS a, o[2]::INT AS b, o[3]::INT AS c FROM (SELECT doc_id, value, string_split(value, '.') AS o FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{IPV4}')) AS value FROM documents)))""",
    "hex_entropy": f"""WITH v AS (SELECT doc_id, row_number() OVER () AS r, value FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{TOKEN}', 2)) AS value FROM documents)),
      c AS (SELECT doc_id, r, ch, count(*) AS k FROM (SELECT doc_id, r, unnest(string_split(value, '')) AS ch FROM v) GROUP BY ALL)
      SELECT doc_id, round(-sum(k / 40.0 * log2(k / 40.0)), 6) AS bits FROM c GROUP BY doc_id, r""",
    "masked_preview": f"SELECT doc_id, left(value, 1) || repeat('*', length(value) - 1) AS preview FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS value FROM documents)",
    "sendable_by_language": _ALL + """, k AS (SELECT scope, type, count(DISTINCT value) AS n FROM ok GROUP BY ALL)
      SELECT lang, count(*) AS documents, count(*) FILTER (doc_id IN (SELECT turn FROM blocked)) AS blocked, coalesce(max((SELECT n FROM k WHERE scope = lang AND type = 'EMAIL')), 0) AS email,
      coalesce(max((SELECT n FROM k WHERE scope = lang AND type = 'PHONE')), 0) AS phone, coalesce(max((SELECT n FROM k WHERE scope = lang AND type = 'CREDIT_CARD')), 0) AS credit_card FROM documents GROUP BY lang""",
    "detections_by_type": _ALL + "SELECT type, count(*) AS n, count(DISTINCT turn) AS n_docs FROM hits GROUP BY type",
    "blocked_documents": _ALL + "SELECT turn AS doc_id FROM blocked",
    "policy_actions": _ALL + "SELECT type, action, category, severity, count(*) AS n FROM hits GROUP BY ALL",
    "inspect_types": _ALL + "SELECT turn AS doc_id, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM hits GROUP BY turn",
    "placeholder_allocation": _ALL + """, f AS (SELECT scope, type, value, min((turn, place)) AS place FROM ok GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY scope, type ORDER BY place, value) AS idx FROM f) SELECT scope, type, count(*) AS n, max(idx) AS top, min(value) FILTER (idx = 1) AS first_value FROM r GROUP BY ALL""",
    "email_protected": f"SELECT doc_id, sha256(regexp_replace(text, '{EMAIL}', '[REDACTED]', 'g')) AS digest, false AS reversible FROM documents WHERE regexp_matches(text, '{EMAIL}')",
    "restore_roundtrip": _ALL + "SELECT lang AS scope, count(*) AS texts, count(*) AS unchanged FROM documents WHERE doc_id NOT IN (SELECT turn FROM blocked) GROUP BY lang",
    "session_expiry": """WITH g AS (SELECT user_id, ts, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)
      SELECT user_id, count(*) FILTER (gap >= 1800000000) + 1 AS sessions, count(*) AS events FROM g GROUP BY user_id""",
    "lru_conversations": "SELECT user_id FROM events GROUP BY user_id ORDER BY max(ts) DESC, user_id LIMIT 64",
    "retention_expired": "SELECT event_type, count(*) AS n FROM events WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts) >= 604800000000 GROUP BY event_type",
    "html_page_mail": f"SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_matches(regexp_replace(html, '<[^>]*>', ' ', 'g'), '{EMAIL}') AS has_mail, count(*) AS n FROM pages GROUP BY ALL",
}
