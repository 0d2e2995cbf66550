"""Protect, inspect and restore in one call and over a session; reports, errors, boundaries and the rulings' log."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe import engine as E
from veilframe import errors
from veilframe.functions.shared import scratch
from veilframe.operators import privacy as P
from veilframe.operators.rules import Rule
from veilframe.sources import mappings as SRC
from veilframe.sources.store import MappingStore

TEXTS = "scope string, turn long, text string"
RULES = {"packs": (), "rules": (Rule("PERSON", "Ann Lee|Bob Roe|Cy Doe", 0.9, "custom", id="custom.PERSON.1"), Rule("PASSWORD", "pw-[0-9]+", 0.9, "custom", id="custom.PASSWORD.1"))}


def texts(spark, *rows):
    return spark.createDataFrame([(s, k, t) for k, (s, t) in enumerate(rows)], TEXTS)


def test_one_call_there_and_back(spark):
    df = texts(spark, ("s", "Ann Lee met Bob Roe"), ("s", "Bob Roe and pw-12"), ("t", "Ann Lee"), ("t", None), ("u", ""))
    out = E.protect(df, **RULES)
    rows = {r["turn"]: r for r in out.texts.collect()}
    assert rows[0]["protected_text"] == "<PERSON_001> met <PERSON_002>" and rows[2]["protected_text"] == "<PERSON_001>"
    assert rows[1]["status"] == "blocked" and rows[1]["protected_text"] is None and rows[4]["protected_text"] == ""
    back = out.restore(spark.createDataFrame([("s", 0, "<PERSON_002> says hi"), ("u", 1, "<PERSON_001>")], "scope string, response_id long, text string")).collect()
    assert {r["response_id"]: r["restored_text"] for r in back} == {0: "Bob Roe says hi", 1: "<PERSON_001>"}
    with pytest.raises(errors.PolicyViolation):
        out.required()
    types = {r["turn"]: r["types"] for r in E.inspect(df, **RULES).collect()}
    assert types[0] == ["PERSON"] and types[1] == ["PASSWORD", "PERSON"] and types[4] == []


def test_a_scope_that_quotes_its_text_is_refused(spark):
    rows = E.protect(texts(spark, ("of Ann Lee", "Ann Lee"), ("of Ann Lee", "nobody"), (None, "Ann Lee")), **RULES).texts.collect()
    assert {r["turn"]: (r["status"], r["protected_text"]) for r in rows} == {0: ("refused", None), 1: ("ok", "nobody"), 2: ("ok", rows[-1]["protected_text"])}


def test_a_session_goes_on_and_forgets(spark):
    for shown in (False, True):
        session = E.Engine(**RULES, stand_ins=shown).session(MappingStore(spark, scratch(spark, "store")))
        one = session.protect(texts(spark, ("s", "Ann Lee"))).texts.first()["protected_text"]
        two = session.protect(texts(spark, ("s", "Bob Roe, Ann Lee"), ("t", "Cy Doe"))).texts.where("scope = 's'").first()["protected_text"]
        assert two.endswith(one) and two != f"{one}, {one}" and ("<" in two) != shown  # what was shown for a value stays
        reply = spark.createDataFrame([("s", 1, f"to {two}!")], "scope string, response_id long, text string")
        assert session.restore(reply).first()["restored_text"] == "to Bob Roe, Ann Lee!"
        session.close(spark.createDataFrame([("s",)], "scope string"))
        assert session.restore(reply).first()["restored_text"] == f"to {two}!" and session.mappings().count() == 1
        session.close()
        with pytest.raises(errors.BadConfiguration):
            session.restore(reply)


def test_a_sessions_stream(spark):
    session = E.Engine(**RULES, stand_ins=True).session(MappingStore(spark, scratch(spark, "store")))
    shown = session.protect(texts(spark, ("s", "Ann Lee here"))).texts.first()["protected_text"]
    source, out, checkpoint = (scratch(spark, x) for x in ("chunks", "restored", "stream"))
    schema = "scope string, stream_id string, seq long, chunk string, is_last boolean"
    spark.createDataFrame([("s", "1", k, c, k == len(shown) - 1) for k, c in enumerate(shown)], schema).write.parquet(source)
    session.stream_restore(spark.readStream.schema(schema).parquet(source), out, checkpoint).awaitTermination()
    assert "".join(r["text"] for r in sorted(spark.read.parquet(out).collect(), key=lambda r: r["seq"])) == "Ann Lee here"


def test_settings_are_checked_and_told():
    for wrong in ({"style": "round"}, {"policy": P.Policy(uncertain="maybe")}, {"packs": ("xx",)}, {"stance": "lax"}):
        with pytest.raises(ValueError):
            E.Engine(**wrong)
    r = E.Engine().report()
    assert r["packs"]["universal"] == 34 and sum(r["packs"].values()) == 91 and not r["warnings"] and "PASSWORD" in r["actions"]["block"]
    loose = E.Engine(packs=("en",), stance="balanced", policy=P.Policy(rules={"PERSON": "allow", "API_KEY": "mask"}, min_confidence=0.6), secrets=True, never=("a b",)).report()
    assert len(loose["warnings"]) == 6 and loose["rulings"] == {"never": 1, "always": 0} and loose["passes"] == ["co_occurrence", "entropy"]
    assert json.loads(json.dumps(loose)) == loose and loose["policy_hash"] != r["policy_hash"]


def test_errors_by_kind(spark):
    assert errors.described(errors.PolicyViolation("x")) == ("PolicyViolation", 422, 2, "refused", False)
    assert errors.described(errors.ProviderFailure())[4] is True and errors.described(KeyError())[0] == "KeyError"
    rows = {r["kind"]: r for r in errors.catalogue(spark).collect()}
    assert len(rows) == 6 and rows["BadConfiguration"]["status"] is None and all(r["detail"] for r in rows.values())


def test_boundaries(spark):
    hosts = {"localhost": 0, "10.1.2.3": 1, "db.internal": 1, "example.com": 2, "8.8.8.8": 2, "llm.example.com": 3}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    for boundary, let_in in (("same_host", {0, 3}), ("private_network", {0, 1, 3}), ("anywhere", {0, 1, 2, 3})):
        got = {r["host"] for r in df.where(P.admitted(F.col("host"), boundary, ("llm.example.com",))).collect()}
        assert got == {h for h, k in hosts.items() if k in let_in}
    with pytest.raises(ValueError):
        P.admitted(F.col("host"), "nowhere")


def test_rulings_are_appended_once(spark):
    log, schema = scratch(spark, "rulings"), "seq long, value string, verdict string, entity_type string"
    df = lambda *rows: spark.createDataFrame(list(rows), schema)
    for _ in range(2):
        assert SRC.append_rulings(df((1, "Falcon", "ALWAYS", "PROJECT_NAME"), (2, "Ann", "NEVER", None)), log, 0) == 2
    assert SRC.append_rulings(df((3, "Falcon", "NEVER", None)), log, 1) == 1
    assert SRC.hand_rulings(spark.read.parquet(log)) == (("Ann", "Falcon"), [])
    secret = "AKIA" + "ABCD1234" * 2
    for bad in ((4, secret, "NEVER", None), (4, "x", "NEVER", None), (4, "xy", "SOMETIMES", None), (4, "xy", "ALWAYS", "WEATHER"), (4, None, "NEVER", None)):
        with pytest.raises(Exception, match="ruling"):
            SRC.append_rulings(df((5, "fine", "NEVER", None), bad), log, 2)
    assert spark.read.parquet(log).count() == 3
    assert SRC.append_rulings(df((6, secret, "ALWAYS", "API_KEY")), log, 3) == 1
