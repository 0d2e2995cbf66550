"""Queries over passes that are plugged in, conversation state and sinks, with the SQL that gives the same rows."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.engine import Engine
from veilframe.functions.scripts import RANGES, class_of, regions, scripts_in, sentences_sql
from veilframe.functions.shared import scratch, settled
from veilframe.operators import mappings as M
from veilframe.operators import passes as X
from veilframe.operators import privacy as P
from veilframe.operators.rules import Rule, rules_for
from veilframe.sources.audit import AuditTrail
from veilframe.sources.store import MappingStore
from veilframe.streaming import sessions as SS

from .catalogue import _ENTITIES, SLICE, _table, _texts, entities_sql
from .rule_cases import CASES
from .rule_sql import candidates
from .whole import _ALLOC, OPENING

#: The least windows that keep values of 64 characters whole are far smaller than these; texts are up to some thousand characters long.
SIZE, OVERLAP = 400, 130
#: Where in its window the scripted model says a name is: if it is there, only that place counts.
TOLD = 7


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("scope"), "turn", "text")


def _script(window: str) -> str | None:
    """A model that takes a window's first capitalized word for a name, and refuses where there is none."""
    words = [w for w in re.findall("[A-Za-z0-9]+", window) if re.fullmatch("[A-Z][a-z]{3,}", w)]
    if not words:
        return "There is nothing to tell."
    return "Found:\n```json\n" + json.dumps({"entities": [{"type": "full name", "value": words[0], "start": TOLD}, {"type": "MOOD", "value": words[0]}]}) + "\n```"


class BioTagger:
    """A recognizer that tags each capitalized word, and the one behind it as inside."""

    def entities(self, text: str):
        before = None
        for m in re.finditer("[A-Za-z0-9]+", text):
            if re.fullmatch("[A-Z][a-z]+", m[0]):
                inside = before is not None and text[before : m.start()] == " "
                yield ("I-PER" if inside else "B-PER"), m.start(), m.end(), 0.9
                before = m.end()
            else:
                yield "MISC", m.start(), m.end(), 0.9
                before = None


def model_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a scripted model finds names in turns, asked window by window, besides the opening word that a rule claims."""
    ask = X.MODELS.passes("scripted", script=_script, size=SIZE, overlap=OVERLAP)
    d = P.detect(_turns(spark, sf_dir), [OPENING], normalize=False, passes=ask).select("scope", "turn", F.explode("dets").alias("d"))
    return d.where("d.source <> 'literal'").select(F.col("scope").cast("long").alias("conv_id"), "turn", "d.source", "d.type", F.col("d.start").alias("start_at"), F.col("d.value").alias("value"))


def recognized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of capitalized words per turn, as a recognizer tags them word by word; none where the rule claims a part."""
    d = P.detect(_turns(spark, sf_dir), [OPENING], normalize=False, passes=(X.RecognizerPass(BioTagger, "tagger", join=True),))
    own = F.filter("dets", lambda d: d["source"] == "tagger")
    return d.select(F.col("scope").cast("long").alias("conv_id"), "turn", F.size(own).alias("names"), F.aggregate(own, F.lit(0), lambda n, x: n + F.length(x["value"])).alias("letters"))


def phone_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that the plans of four countries know, where no card or address is."""
    ips = Rule("INTERNAL_IP", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])", 0.9, "custom", id="custom.INTERNAL_IP.1")
    d = P.detect(_texts(spark, sf_dir), [ips], normalize=False, passes=X.PHONES.passes("plans")).select(F.col("turn").alias("doc_id"), F.explode("dets").alias("d"))
    return d.where("d.source = 'phone'").groupBy(F.col("d.rule").alias("rule")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"), F.min("d.value").alias("least"))


NAME, KANA = "王小明先生", "です"


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a Chinese name for every ``and`` and kana for every ``the``: sentences of either, both and neither."""
    text = F.regexp_replace(F.regexp_replace("text", r"\band\b", NAME), r"\bthe\b", KANA)
    return _texts(spark, sf_dir).withColumn("text", text)


def script_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scripts of each text, and how many sentences hold kana, Chinese characters or either, with the characters of those."""
    size = lambda r: F.aggregate(r, F.lit(0), lambda n, x: n + x["end"] - x["start"])
    df = _mixed(spark, sf_dir).where("text is not null")
    df = df.select(F.col("turn").alias("doc_id"), F.concat_ws(",", scripts_in(F.col("text"))).alias("scripts"), *(regions(F.col("text"), *s).alias(n) for n, s in (("_kana", ("kana",)), ("_han", ("han",)), ("_either", ("kana", "han")))))
    return df.select("doc_id", "scripts", F.size("_kana").alias("kana"), size("_kana").alias("kana_size"), F.size("_han").alias("han"), F.size("_either").alias("either"), size("_either").alias("either_size"))


def silenced_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chinese names that stand in no sentence with kana, and what the Japanese pack makes of all of them, a language."""
    d = P.detect(_mixed(spark, sf_dir), [r for r in rules_for(("ja", "zh")) if r.id in ("zh.PERSON.1", "ja.PERSON.1")], normalize=False)
    rule = F.transform("dets", lambda d: d["rule"])
    n = lambda name: F.coalesce(F.sum(F.size(F.filter(rule, lambda r: r == name)).cast("long")), F.lit(0))
    return d.groupBy("scope").agg(n("zh.PERSON.1").alias("chinese"), n("ja.PERSON.1").alias("japanese"))


def rules_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per rule: documents that a text it must find something in is planted behind, and near misses, and how often it finds just that value there."""
    ids = list(CASES)
    pick = (F.col("turn") % (2 * len(ids))).cast("int")
    case = F.get(F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(v).alias("value"), F.lit(t).alias("planted"), F.lit(near).alias("near")) for k, (text, v, miss) in CASES.items() for t, near in ((text, False), (miss, True)))), pick)
    d = _texts(spark, sf_dir).where("turn is not null").withColumn("case", case)
    d = d.select(F.to_json(F.struct("case.rule", "case.value", "case.near", (F.length(F.coalesce("text", F.lit(""))) + 2).alias("from"))).alias("scope"), "turn", F.concat(F.coalesce("text", F.lit("")), F.lit("\n\n"), "case.planted").alias("text"))
    told = F.from_json("scope", "rule string, value string, near boolean, `from` int")
    hits = P.detect(d, rules_for()).withColumn("c", told)
    there = F.filter("dets", lambda x: (x["rule"] == F.col("c.rule")) & (x["start"] >= F.col("c.from")))
    hit = F.when(F.col("c.near"), F.size(there) > 0).otherwise(F.exists(there, lambda x: x["value"] == F.col("c.value")))
    return hits.groupBy("c.rule", "c.near").agg(F.count("*").alias("planted"), F.sum(hit.cast("long")).alias("found"))


IDLE, HELD = 1800, 2700


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a use of its user's conversation; purchases are held for longer than a conversation may be idle."""
    held = F.when(F.col("event_type") == "purchase", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + HELD * 1_000_000))
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("start"), held.alias("end"), "event_id")


def _conversations(df: DataFrame) -> DataFrame:
    micros = lambda c: F.unix_micros(c).alias(c)
    return df.select(F.col("key").cast("long").alias("user_id"), micros("started"), micros("last_used"), micros("expires"), "uses")


def held_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of all users, none ended under a use that is held."""
    return _conversations(SS.conversations(_uses(spark, sf_dir), IDLE))


def expired_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, streamed: four slices of time, every other event a slice late, each in a run of its own; the last one only moves the watermark."""
    uses = _uses(spark, sf_dir)
    low, high = uses.agg(F.min(F.unix_micros("start")), F.max(F.unix_micros("start"))).first()
    if low is None:
        return held_conversations(spark, sf_dir)
    step = (high - low) // 4 + 1
    which = F.floor((F.unix_micros("start") - low) / step) + F.col("event_id") % 2
    source, out, checkpoint = (scratch(spark, x) for x in ("uses", "expired", "stream"))
    schema = "key long, start timestamp, end timestamp"
    end = spark.createDataFrame([(None, high + 3 * step + (IDLE + HELD) * 1_000_000)], "key long, at long").select("key", F.timestamp_micros("at").alias("start"), F.lit(None).cast("timestamp").alias("end"))
    for k in range(6):
        part = uses.where(which == k).select("key", "start", "end") if k < 5 else end
        part.write.mode("append").parquet(source)
        SS.write_expired(spark.readStream.schema(schema).parquet(source), out, checkpoint, f"{2 * step // 1_000_000 + 1} seconds", IDLE).awaitTermination()
    return _conversations(spark.read.schema(SS.CLOSED + ", batch int").parquet(out))


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of protection records of each language's documents, written in three batches, one of which runs twice; records of odd days aren't audited."""
    decided = settled(P.decide(P.detect(_texts(spark, sf_dir), SLICE, normalize=False), P.Policy()))
    maps = settled(M.allocate(decided))
    trail = AuditTrail(scratch(spark, "audit"), strict=False)
    records = M.protection_record(decided, maps, P.Policy(), by="queries", recall="recall_first")
    odd = records.withColumn("record", F.lit('{"contract":"diary/1"}'))
    counts = [trail.append(r, n, "2026-01-01T00:00:00.000Z") for n, r in ((0, records), (1, records.unionByName(odd)), (1, records.unionByName(odd)), (2, odd))]
    lines = trail.read(spark).groupBy("batch", F.col("at").alias("stamped"), F.get_json_object("record", "$.mode").alias("mode"), F.get_json_object("record", "$.by").alias("by_whom")).agg(F.count("*").alias("lines"))
    kept = spark.createDataFrame([(n, counts[k].written, counts[k].dropped) for n, k in ((0, 0), (1, 2), (2, 3))], "batch int, written long, dropped long")
    return kept.join(lines, "batch", "left")


def stored_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of a store: even documents' values, then all, then without two languages; in each, mappings and the largest number a scope and type."""
    decided = settled(P.decide(P.detect(_texts(spark, sf_dir), SLICE, normalize=False), P.Policy()))
    store = MappingStore(spark, scratch(spark, "store"))
    store.allocate(decided.where("turn % 2 = 0"))
    store.allocate(decided)
    store.purge(decided.where("scope in ('de', 'fr')").select("scope"))
    out = [store.read(v).groupBy("scope", "type").agg(F.count("*").alias("n"), F.max("idx").alias("top")).withColumn("version", F.lit(v)) for v in range(1, store.version() + 1)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session over all languages in two calls, even documents first, with stand-ins; replies that quote each text: how many come back as it was."""
    engine = Engine(packs=(), rules=tuple(SLICE), co_occurrence=False, stand_ins=True)
    session = engine.session(MappingStore(spark, scratch(spark, "store")))
    texts = _texts(spark, sf_dir).where("text is not null")
    calls = [session.protect(texts.where(f"turn % 2 = {k}")).texts for k in (0, 1)]
    sent = calls[0].unionByName(calls[1]).where("status = 'ok'")
    back = session.restore(sent.select("scope", F.col("turn").alias("response_id"), F.col("protected_text").alias("text")))
    same = back.join(texts.select(F.col("turn").alias("response_id"), F.col("text").alias("was")), "response_id")
    return same.groupBy("scope").agg(F.count("*").alias("texts"), F.sum((F.col("restored_text") == F.col("was")).cast("long")).alias("unchanged"))


def admitted_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages and addresses in texts that an endpoint might be on, by the boundaries that let them in."""
    pages = _table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/:?#]*)", 1).alias("host"))
    ips = _table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.lit(0))).alias("host"))
    let_in = [P.admitted(F.col("host"), b, ("spam-farm.example.org",)).alias(b) for b in P.BOUNDARIES]
    return pages.unionByName(ips).select(*let_in).groupBy(*P.BOUNDARIES).agg(F.count("*").alias("n"))


def record_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How scopes' values are shown where stand-ins are used while they last: kinds of tokens and of stand-ins a scope."""
    decided = settled(P.decide(P.detect(_texts(spark, sf_dir), SLICE[:2], normalize=False), P.Policy()))
    maps = settled(M.with_surrogates(M.allocate(decided), _texts(spark, sf_dir)))
    r = M.protection_record(decided, maps, P.Policy())
    body = F.from_json("record", "contract string, mode string, placeholders array<struct<kind:string,tokens:bigint>>, stand_ins array<struct<kind:string,count:bigint>>")
    total = lambda c, f: F.aggregate(F.coalesce(F.transform(F.col(c), lambda x: x[f]), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, x: a + x)
    return r.withColumn("r", body).select("scope", "r.contract", "r.mode", total("r.placeholders", "tokens").alias("tokens"), total("r.stand_ins", "count").alias("stand_ins"))


def windows_sql(table: str, key: str, size: int, overlap: int, name: str = "win") -> str:
    """Common tables that end in ``name`` (key, text, pos, stop): the windows of each text."""
    tail = size // 4
    low = size - tail
    return rf"""w({key}, text, pos, stop) AS (
      SELECT {key}, text, -1, 0 FROM {table} WHERE text <> ''
      UNION ALL
      SELECT {key}, text, pos, CASE WHEN pos + {size} >= length(text) THEN length(text) ELSE pos + {low} + CASE WHEN length(p) > 0 THEN length(p) WHEN length(n) > 0 THEN length(n) WHEN greatest(length(c), length(d)) > 0 THEN greatest(length(c), length(d)) ELSE {tail} END END
      FROM (SELECT {key}, text, pos, regexp_extract(t, '^([\s\S]*\n[\t\n\v\f\r ]*\n)', 1) AS p, regexp_extract(t, '^([\s\S]*\n)', 1) AS n, regexp_extract(t, '^([\s\S]*[。！？])', 1) AS c, regexp_extract(t, '^([\s\S]*[.!?])[\t\n\v\f\r ]', 1) AS d
        FROM (SELECT {key}, text, pos, substr(text, pos + {low + 1}, {tail}) AS t
          FROM (SELECT {key}, text, CASE WHEN pos < 0 THEN 0 ELSE greatest(pos + 1, stop - {overlap}) END AS pos FROM w WHERE stop < length(text))))),
    {name} AS (SELECT {key}, pos, substr(text, pos + 1, stop - pos) AS win FROM w WHERE pos >= 0)"""


_PIECES = """SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS place FROM (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) AS x, unnest(range(1, len(regexp_extract_all({text}, '[A-Za-z0-9]+|[^A-Za-z0-9]+')) + 1)) AS i FROM {table})"""


def _phone_sql() -> str:
    digits = "regexp_replace(value, '[^0-9]', '', 'g')"
    region = "CASE " + " ".join(f"WHEN CASE WHEN value LIKE '+%' THEN regexp_matches({digits}, '{a}') ELSE regexp_matches({digits}, '{h}') END AND regexp_matches(value, '{form}') THEN '{r}'" for r in X.PLANS for a, h, form in [X.plan_patterns(r)]) + " END"
    return f"""WITH RECURSIVE {candidates([Rule("PHONE", X.CANDIDATE, 0.9, "custom", id="p")])}, ip AS (SELECT doc_id, s, e FROM ({_IP_SQL})),
      f AS (SELECT doc_id, s, e, value, {region} AS region FROM cand)
      SELECT 'phone.' || region AS rule, count(*) AS n, count(DISTINCT doc_id) AS docs, min(value) AS least FROM f WHERE region IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ip WHERE ip.doc_id = f.doc_id AND ip.s < f.e AND f.s < ip.e) GROUP BY region"""


_IP_SQL = r"""WITH RECURSIVE walk AS (SELECT doc_id, chr(10) || text AS rest, 0 AS pos, NULL::VARCHAR AS value, 0 AS s FROM documents WHERE text IS NOT NULL
      UNION ALL SELECT doc_id, right(v, 1) || substr(rest, length(b) + length(v) + 1), pos + length(b) - 1 + length(v), v, pos + length(b) - 1
      FROM (SELECT *, regexp_extract(rest, '^([\s\S]*?[^0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?:[^0-9]|$)', 1) AS b, regexp_extract(rest, '^([\s\S]*?[^0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?:[^0-9]|$)', 2) AS v FROM walk) WHERE v <> '') SELECT doc_id, s, s + length(value) AS e FROM walk WHERE value IS NOT NULL"""

_q = lambda pattern: pattern.replace("'", "''")
_MIXED = rf"""WITH mixed AS (SELECT lang AS scope, doc_id, regexp_replace(regexp_replace(text, '\band\b', '{NAME}', 'g'), '\bthe\b', '{KANA}', 'g') AS text FROM documents)"""
_HELD = f"""WITH u AS (SELECT user_id, epoch_us(ts) AS lo, epoch_us(ts) + CASE WHEN event_type = 'purchase' THEN {HELD}000000 ELSE {IDLE}000000 END AS reach FROM events),
      b AS (SELECT *, max(reach) OVER (PARTITION BY user_id ORDER BY lo, reach ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM u),
      r AS (SELECT *, sum(CASE WHEN lo >= before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, reach ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM b)
      SELECT user_id, min(lo) AS started, max(lo) AS last_used, max(reach) AS expires, count(*) AS uses FROM r GROUP BY user_id, run"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (model_pass, recognized_names, phone_plans, script_regions, silenced_names, rules_shown, held_conversations, expired_stream, audit_trail, stored_mappings, record_modes, session_turns, admitted_hosts)}
ORACLE_SQL: dict[str, str] = {
    "model_pass": f"""WITH RECURSIVE c AS (SELECT row_number() OVER () AS k, * FROM conversations), {windows_sql("c", "k", SIZE, OVERLAP)},
      numbered AS (SELECT k || '/' || pos AS id, k, pos, win FROM win), piece AS ({_PIECES.format(key="id", text="win", table="numbered")}),
      first AS (SELECT id, arg_min(x, i) AS value FROM piece WHERE regexp_full_match(x, '[A-Z][a-z]{{3,}}') GROUP BY id),
      opening AS (SELECT k, regexp_extract(text, '^[A-Z][a-z]{{2,20}}', 0) AS value FROM c),
      said AS (SELECT n.*, f.value, substr(n.win, {TOLD + 1}, length(f.value)) = f.value AS told FROM numbered n JOIN first f USING (id)),
      found AS (SELECT k, (pos + {TOLD})::INT AS s, value FROM said WHERE told UNION SELECT n.k, (n.pos + p.place)::INT, n.value FROM said n JOIN piece p USING (id) WHERE NOT told AND p.x = n.value)
      SELECT conv_id, turn, 'model' AS source, 'PERSON' AS type, s AS start_at, f.value AS value FROM found f JOIN c USING (k) JOIN opening o USING (k) WHERE s >= length(o.value)
      UNION ALL SELECT conv_id, turn, 'custom', 'PERSON', 0, value FROM opening JOIN c USING (k) WHERE value <> ''""",
    "recognized_names": f"""WITH c AS (SELECT row_number() OVER () AS k, * FROM conversations), piece AS ({_PIECES.format(key="k", text="text", table="(SELECT k, coalesce(text, '') AS text FROM c)")}),
      t AS (SELECT *, regexp_full_match(x, '[A-Z][a-z]+') AS named, lag(x) OVER (PARTITION BY k ORDER BY i) = ' ' AND regexp_full_match(lag(x, 2) OVER (PARTITION BY k ORDER BY i), '[A-Z][a-z]+') AS follows FROM piece),
      g AS (SELECT *, sum(CASE WHEN coalesce(follows, false) THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM t WHERE named),
      r AS (SELECT k, run, min(place) AS s, max(place + length(x)) AS e FROM g GROUP BY ALL)
      SELECT conv_id, turn, count(r.k)::INT AS names, coalesce(sum(e - s), 0)::INT AS letters FROM c LEFT JOIN r ON r.k = c.k AND r.s >= length(regexp_extract(c.text, '^[A-Z][a-z]{{2,20}}', 0)) GROUP BY c.k, conv_id, turn""",
    "phone_plans": _phone_sql(),
    "rules_shown": f"""WITH c(k, rule, near) AS (VALUES {", ".join(f"({2 * k + j}, '{r}', {bool(j)})" for k, r in enumerate(CASES) for j in (0, 1))}) SELECT rule, near, count(*) AS planted, CASE WHEN near THEN 0 ELSE count(*) END::BIGINT AS found FROM documents JOIN c ON doc_id % {2 * len(CASES)} = k GROUP BY rule, near""",
    "script_regions": f"""{_MIXED} SELECT doc_id, array_to_string([x FOR x IN [{', '.join(f"CASE WHEN regexp_matches(text, '{class_of(n)}') THEN '{n}' END" for n in sorted(RANGES))}] IF x IS NOT NULL], ',') AS scripts, len(k)::INT AS kana, coalesce(list_sum(list_transform(k, lambda x: length(x))), 0)::INT AS kana_size, len(h)::INT AS han, len(e)::INT AS either, coalesce(list_sum(list_transform(e, lambda x: length(x))), 0)::INT AS either_size
      FROM (SELECT *, regexp_extract_all(text, '{_q(sentences_sql("kana"))}') AS k, regexp_extract_all(text, '{_q(sentences_sql("han"))}') AS h, regexp_extract_all(text, '{_q(sentences_sql("kana", "han"))}') AS e FROM mixed WHERE text IS NOT NULL)""",
    "silenced_names": f"""{_MIXED}, k AS (SELECT *, regexp_extract_all(text, '{_q(sentences_sql("kana"))}') AS k FROM mixed),
      c AS (SELECT scope, len(regexp_extract_all(text, '{NAME}')) AS n, len(regexp_extract_all(array_to_string(k, ' '), '{NAME}')) AS silent, len(k) > 0 AND list_sum(list_transform(k, lambda x: length(x))) >= length(text) - 2 * len(k) AS whole FROM k)
      SELECT scope, coalesce(sum(CASE WHEN whole THEN 0 ELSE n - silent END), 0)::BIGINT AS chinese, coalesce(sum(n), 0)::BIGINT AS japanese FROM c GROUP BY scope""",
    "held_conversations": _HELD,
    "expired_stream": _HELD,
    "audit_trail": """WITH k AS (SELECT count(DISTINCT lang) AS k FROM documents) SELECT batch, CASE WHEN batch < 2 THEN k ELSE 0 END AS written, CASE WHEN batch > 0 THEN k ELSE 0 END AS dropped,
      CASE WHEN batch < 2 THEN '2026-01-01T00:00:00.000Z' END AS stamped, CASE WHEN batch < 2 THEN 'placeholder' END AS mode, CASE WHEN batch < 2 THEN 'queries' END AS by_whom, CASE WHEN batch < 2 THEN k END AS lines FROM k, (VALUES (0), (1), (2)) b(batch)""",
    "stored_mappings": _ALLOC + """, one AS (SELECT scope, type, count(*) AS n, count(*)::INT AS top, 1 AS version FROM (SELECT DISTINCT scope, type, value FROM ok WHERE turn % 2 = 0) GROUP BY ALL),
      two AS (SELECT scope, type, count(*) AS n, count(*)::INT AS top, 2 AS version FROM m GROUP BY ALL)
      SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT scope, type, n, top, 3 FROM two WHERE scope NOT IN ('de', 'fr')""",
    "session_turns": _ENTITIES + "SELECT lang AS scope, count(*) AS texts, count(*) AS unchanged FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT turn FROM blocked) GROUP BY lang",
    "admitted_hosts": r"""WITH hosts AS (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS h FROM pages UNION ALL SELECT unnest(regexp_extract_all(text, '[0-9]{1,3}(?:\.[0-9]{1,3}){3}')) FROM documents),
      x AS (SELECT h, regexp_matches(h, '^[0-9.]+$') AS ip, list_transform(string_split(h, '.'), lambda o: try_cast(o AS INT)) AS o FROM hosts),
      c AS (SELECT CASE WHEN h = 'spam-farm.example.org' THEN 'declared' WHEN ip THEN CASE WHEN o[1] = 127 AND h LIKE '127.%' THEN 'same_host' WHEN list_max(o) <= 255 AND (o[1] IN (0, 10, 127) OR o[1] >= 240 OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 198 AND o[2] IN (18, 19)) OR (o[1] = 192 AND o[2] = 0 AND o[3] IN (0, 2)) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113)) THEN 'private_network' ELSE 'external' END WHEN h NOT LIKE '%.%' THEN 'private_network' ELSE 'external' END AS class FROM x)
      SELECT class IN ('same_host', 'declared') AS same_host, class <> 'external' AS private_network, true AS anywhere, count(*) AS n FROM c GROUP BY ALL""",
    "record_modes": entities_sql(SLICE[:2]) + f""", k AS (SELECT scope, type, count(DISTINCT value) AS n FROM ok GROUP BY ALL), s AS (SELECT scope, sum(least(n, CASE type WHEN 'EMAIL' THEN {len(M.POOLS["EMAIL", "*"])} ELSE {len(M.POOLS["PHONE", "en"])} END)) AS stand_ins, sum(n) AS n FROM k GROUP BY scope)
      SELECT DISTINCT lang AS scope, CASE WHEN stand_ins > 0 THEN 'protection-scope/2' ELSE 'protection-scope/1' END AS contract, CASE WHEN stand_ins = n THEN 'surrogate' WHEN stand_ins > 0 THEN 'mixed' ELSE 'placeholder' END AS mode, coalesce(n - stand_ins, 0)::BIGINT AS tokens, coalesce(stand_ins, 0)::BIGINT AS stand_ins FROM documents LEFT JOIN s ON scope = lang""",
}
