"""Conversation state, the audit trail and the mapping store."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from veilframe.functions.shared import scratch
from veilframe.operators import mappings as M
from veilframe.operators import privacy as P
from veilframe.operators.rules import Rule
from veilframe.sources.audit import AuditTrail
from veilframe.sources.store import SCHEMA, Conflict, MappingStore
from veilframe.streaming import sessions as SS

IDLE = 100
BEGIN = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
USES = "key string, start timestamp, end timestamp"


def when(second):
    return None if second is None else BEGIN + datetime.timedelta(seconds=second)


def plain(uses):
    """(key, started, last_used, expires, uses), by a walk over each key's uses in order."""
    out = []
    for key in {u[0] for u in uses}:
        for _, s, e in sorted((u for u in uses if u[0] == key), key=lambda u: u[1]):
            reach = max(s + IDLE, s if e is None else e)
            if out and out[-1][0] == key and s < out[-1][3]:
                o = out[-1]
                out[-1] = (key, o[1], max(o[2], s), max(o[3], reach), o[4] + 1)
            else:
                out.append((key, s, s, reach, 1))
    return sorted(out, key=str)


def got(df):
    seconds = lambda t: int(t.replace(tzinfo=datetime.timezone.utc).timestamp() - BEGIN.timestamp())
    return sorted(((r["key"], seconds(r["started"]), seconds(r["last_used"]), seconds(r["expires"]), r["uses"]) for r in df.collect()), key=str)


def some_uses(seed, n=300):
    r = random.Random(seed)
    return [(r.choice(["a", "a", "b", None]), s := r.randint(0, 5000), r.choice([None, s, s + r.randint(0, 400)])) for _ in range(n)]


def test_conversations_against_a_walk(spark):
    for seed, span in ((1, 86_400), (2, 60), (3, 1)):
        uses = some_uses(seed)
        df = spark.createDataFrame([(k, when(s), when(e)) for k, s, e in uses] + [("z", None, None)], USES)
        assert got(SS.conversations(df, IDLE, span)) == plain(uses)
    assert SS.conversations(spark.createDataFrame([], USES)).count() == 0


def test_settling_in_any_order():
    r = random.Random(7)
    for _ in range(200):
        uses = [(s := r.randint(0, 300), s + r.randint(1, 40)) for _ in range(r.randint(1, 30))]
        whole = SS.settle([], uses)
        r.shuffle(uses)
        held = []
        for k in range(0, len(uses), 3):
            held = SS.settle(held, uses[k : k + 3])
        assert held == whole and sum(c[3] for c in held) == len(uses)


def test_a_stream_expires_what_a_batch_does_whatever_the_batches(spark):
    uses = some_uses(4)
    order = sorted(uses, key=lambda u: u[1] + random.Random(str(u)).randint(0, 1500))  # up to 1500 seconds late
    source, out, checkpoint = (scratch(spark, x) for x in ("uses", "expired", "stream"))
    size = 110
    parts = [order[k : k + size] for k in range(0, len(order), size)] + [[("end", 50_000, None)]]
    for part in parts:
        spark.createDataFrame([(k, when(s), when(e)) for k, s, e in part], USES).coalesce(1).write.mode("append").parquet(source)
        SS.write_expired(spark.readStream.schema(USES).parquet(source), out, checkpoint, "3000 seconds", IDLE).awaitTermination()
    assert got(spark.read.schema(SS.CLOSED + ", batch int").parquet(out)) == plain(uses)


def test_a_stream_keeps_conversations_apart_to_the_microsecond(spark):
    """Uses that begin just where a conversation ends begin another, ones a microsecond before don't; state is kept without Python."""
    at = lambda second, micros=0: when(second) + datetime.timedelta(microseconds=micros)
    uses = [("a", at(0), None), ("a", at(100), None), ("b", at(0), None), ("b", at(100, -1), None), ("c", at(0, 7), at(300, 3)), ("c", at(300, 3), None), ("d", at(0), at(300)), ("d", at(300, -1), None), (None, at(5), at(1)), ("z", None, None)]
    source, out, checkpoint = (scratch(spark, x) for x in ("uses", "expired", "stream"))
    for part in (uses[::2], uses[1::2], [("end", at(50_000), None)]):
        spark.createDataFrame(part, USES).write.mode("append").parquet(source)
        SS.write_expired(spark.readStream.schema(USES).parquet(source), out, checkpoint, "3000 seconds", IDLE).awaitTermination()
    rows = lambda df: sorted((str(r["key"]), r["started"], r["last_used"], r["expires"], r["uses"]) for r in df.collect())
    found = rows(spark.read.schema(SS.CLOSED + ", batch int").parquet(out))
    assert found == rows(SS.conversations(spark.createDataFrame(uses, USES), IDLE)) and [r[0] for r in found] == ["None", "a", "a", "b", "c", "c", "d"]
    expired = SS.expired_conversations(spark.readStream.schema(USES).parquet(source), "3000 seconds", IDLE)
    assert "PandasWithState" not in expired._jdf.queryExecution().logical().toString()
    with pytest.raises(ValueError, match="idle"):
        SS.expired_conversations(spark.readStream.schema(USES).parquet(source), "3000 seconds", 0)


def test_a_use_that_is_held_keeps_its_conversation(spark):
    df = spark.createDataFrame([("a", when(0), when(500)), ("a", when(499), None), ("a", when(599), None), ("b", when(0), None), ("b", when(100), None)], USES)
    assert got(SS.conversations(df, IDLE)) == [("a", 0, 499, 599, 2), ("a", 599, 599, 699, 1), ("b", 0, 0, 100, 1), ("b", 100, 100, 200, 1)]


def record(**more):
    return json.dumps({"contract": "restoration-scope/1", "scope": "s", "clean": True, "restored": [], "tampered": [], "unknown": []} | more)


def test_audit_trail(spark):
    rows = [("s", record()), ("s", record(by="x/1"))]
    bad = [("s", record(text="a value")), ("s", "no JSON"), ("s", "[1]"), ("s", '{"contract":"restoration-scope/1","scope":"s"}'), ("s", '{"a":1}'), ("s", None)]
    df = lambda r: spark.createDataFrame(r, "scope string, record string")
    trail = AuditTrail(scratch(spark, "audit"))
    for _ in range(2):
        assert trail.append(df(rows), 7) == trail.append(df(rows), 8) and trail.append(df(rows), 7).written == 2
    lines = trail.read(spark).collect()
    assert sorted(r["batch"] for r in lines) == [7, 7, 8, 8] and {r["record"] for r in lines} == {r[1] for r in rows}
    assert all(r["at"].endswith("Z") and len(r["at"]) == 24 for r in lines)
    for b in bad:
        with pytest.raises(Exception, match="audit"):
            trail.append(df([*rows, b]), 9)
    assert trail.read(spark).count() == 4  # a batch that fails leaves no line
    loose = AuditTrail(scratch(spark, "audit"), strict=False)
    counts = loose.append(df(rows + bad), 1)
    assert (counts.written, counts.dropped) == (2, 6) and loose.read(spark).count() == 2
    assert loose.append(df([]), 1).written == 0 and loose.read(spark).count() == 0


def test_an_audited_stream_writes_no_line_twice(spark):
    source, checkpoint = scratch(spark, "records"), scratch(spark, "stream")
    trail = AuditTrail(scratch(spark, "audit"))
    for k in range(3):
        spark.createDataFrame([("s", record(by=f"x/{k}"))], "scope string, record string").write.mode("append").parquet(source)
        trail.stream(spark.readStream.schema("scope string, record string").parquet(source), checkpoint).awaitTermination()
    assert trail.append(spark.createDataFrame([("s", record(by="x/0"))], "scope string, record string"), 0).written == 1  # the first batch again
    assert sorted(json.loads(r["record"])["by"] for r in trail.read(spark).collect()) == ["x/0", "x/1", "x/2"]


RULE = [Rule("EMPLOYEE_ID", "E-[0-9]+", 0.9, "custom", id="c.1")]


def decided(spark, *texts):
    return P.decide(P.detect(spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "scope string, turn long, text string"), RULE, normalize=False), P.Policy())


@pytest.mark.parametrize("late_first", [False, True])
def test_two_writers_never_give_a_number_twice(spark, late_first):
    store = MappingStore(spark, scratch(spark, "store"))
    store.allocate(decided(spark, "E-1"))
    base = store.version()
    one, two = (M.allocate(decided(spark, t), store.read(base)) for t in ("E-1 E-2", "E-3"))
    first, second = (two, one) if late_first else (one, two)
    assert store.commit(base, first, "allocate") == base + 1
    with pytest.raises(Conflict):
        store.commit(base, second, "allocate")
    store.allocate(decided(spark, "E-3" if not late_first else "E-1 E-2"))  # who was second reads again
    rows = store.read().collect()
    assert sorted(r["idx"] for r in rows) == [1, 2, 3] and {r["value"] for r in rows} == {"E-1", "E-2", "E-3"}
    assert next(r["idx"] for r in rows if r["value"] == "E-1") == 1


def test_versions_purge_and_retention(spark):
    store = MappingStore(spark, scratch(spark, "store"))
    assert store.version() == 0 and store.read().count() == 0
    row = lambda scope, idx, at: (scope, "PERSON", idx, f"i{idx}", f"v{idx}", None, when(at))
    store.commit(0, spark.createDataFrame([row("s", 1, 0), row("s", 2, 900), row("t", 1, 0)], SCHEMA), "import")
    store.retain(1000, F.lit(when(1000)))
    assert sorted((r["scope"], r["idx"]) for r in store.read().collect()) == [("s", 2)]
    store.purge(spark.createDataFrame([("s",)], "scope string"))
    assert store.read().count() == 0 and store.read(1).count() == 3 and store.manifest(3)["reason"] == "purge"
    assert store.vacuum() == 2 and store.read().count() == 0
    with pytest.raises(Conflict):
        store.attempts = 0
        store.change(lambda m: m, "nothing")


def test_modes_of_records(spark):
    d = decided(spark, "E-1 E-2", "E-3")
    maps = M.allocate(d)
    shown = lambda n: maps.withColumn("surface", F.when(F.col("idx") <= n, F.concat(F.lit("Avery "), "idx")))
    modes = {}
    for n in (0, 1, 3):
        r = json.loads(M.protection_record(d, shown(n), P.Policy(), by="x/1").first()["record"])
        modes[n] = (r["mode"], r["contract"], r["placeholders"], r.get("stand_ins"), r["by"])
        assert "Avery" not in json.dumps(r) and "E-1" not in json.dumps(r)
        assert AuditTrail(scratch(spark, "audit")).append(M.protection_record(d, shown(n), P.Policy()), 0).written == 1
    assert modes[0] == ("placeholder", "protection-scope/1", [{"kind": "EMPLOYEE_ID", "tokens": 3}], None, "x/1")
    assert modes[1][:3] == ("mixed", "protection-scope/2", [{"kind": "EMPLOYEE_ID", "tokens": 2}]) and modes[1][3] == [{"kind": "EMPLOYEE_ID", "count": 1}]
    assert modes[3][:3] == ("surrogate", "protection-scope/2", [])
