"""Passes that are plugged in: recognizers, models, phone plans and the registry."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions.intervals import IntervalSet
from veilframe.operators import passes as X
from veilframe.operators import privacy as P
from veilframe.operators.rules import Rule

TEXTS = "scope string, turn long, text string"


def dets(spark, text, rules=(), **passes):
    return [(d["type"], d["value"], d["source"]) for d in P.detect(spark.createDataFrame([("s", 1, text)], TEXTS), list(rules), normalize=False, **passes).first()["dets"]]


def test_recognized():
    person = {"PER": "PERSON", "PERSON": "PERSON"}
    see = lambda found, join=False, least=0.0, taken=(): X.recognized("Jane Roe met Al", found, person, least, join, IntervalSet(taken))
    both = [("B-PER", 0, 4, 0.9), ("I-PER", 5, 8, 0.9), ("B-per", 13, 15, 0.2)]
    assert see(both) == [(0, 4, "PERSON"), (5, 8, "PERSON"), (13, 15, "PERSON")]
    assert see(both, join=True) == [(0, 8, "PERSON"), (13, 15, "PERSON")]
    assert see(both, least=0.5, join=True) == [(0, 8, "PERSON")]
    assert see(both, join=True, taken=[(7, 9)]) == [(13, 15, "PERSON")]  # an anchor has a part of it
    assert see([("PERSON", 0, 8, 1.0), ("PERSON", 5, 8, 1.0), ("GPE", 13, 15, 1.0)]) == [(0, 8, "PERSON")]
    for place in ((-1, 2), (3, 3), (10, 99)):
        with pytest.raises(ValueError):
            see([("PERSON", *place, 1.0)])


class Tagger:
    def entities(self, text):
        if "fail" in text:
            raise RuntimeError("no model")
        return [("PER", text.index(w), text.index(w) + len(w), 0.8) for w in ("Ann", "Bob") if w in text]


def test_recognizer_pass(spark):
    one = X.RecognizerPass(Tagger, "ner")
    assert dets(spark, "Ann and Bob", [Rule("EMPLOYEE_ID", "Ann and", 0.9, "custom", id="c.1")], passes=(one,)) == [("EMPLOYEE_ID", "Ann and", "custom"), ("PERSON", "Bob", "ner")]
    assert dets(spark, None, passes=(one,)) == [] == dets(spark, "", passes=(one,))
    with pytest.raises(Exception, match="no model"):
        dets(spark, "fail", passes=(one,))
    with pytest.raises(ValueError):
        X.RecognizerPass(Tagger, labels={"PER": "WEATHER"})
    with pytest.raises(ValueError):
        X.RecognizerPass(Tagger, min_score=2)


def test_answers():
    text = "Ann met Ann, id 7"
    assert X.answered('{"entities":[{"type":"name","value":"Ann","start":8}]}', text) == ([(8, 11, "PERSON")], 0)
    assert X.answered('x ```{"entities":[{"type":"PERSON","value":"Ann","start":3},{"type":"?","value":"Ann"},{"type":"PERSON","value":"Zoe"},{"type":"PERSON","value":7},5]}```', text) == ([(0, 3, "PERSON"), (8, 11, "PERSON")], 4)
    for raw in (None, "", "no", "{", '{"entities":5}', "[1]", '{"a":1}'):
        assert X.answered(raw, text) is None
    assert X.answered('{"entities":[]}', text) == ([], 0)


def test_model_pass_moves_windows_and_counts_what_they_share_once(spark):
    word = "Morgenstern"
    text = ("lorem ipsum dolor " * 7 + word + ". ") * 9
    script = lambda w: '{"entities":[{"type":"PERSON","value":"%s"}]}' % word
    found = [d["start"] for d in P.detect(spark.createDataFrame([("s", 1, text)], TEXTS), [], normalize=False, passes=(X.ModelPass(lambda: X.ScriptedProvider(script), size=300, overlap=150),)).first()["dets"]]
    at = [i for i in range(len(text)) if text.startswith(word, i)]
    assert sorted(found) == at and len(set(found)) == len(found)


def test_a_model_that_fails_takes_nothing_away(spark):
    rule = Rule("EMPLOYEE_ID", "E-[0-9]+", 0.9, "custom", id="c.1")
    broken = X.MODELS.passes("scripted", script={})
    prose = X.MODELS.passes("scripted", script=lambda w: "I'd rather not.")
    for passes in (broken, prose):
        assert dets(spark, "E-12 and Ann", [rule], passes=passes) == [("EMPLOYEE_ID", "E-12", "custom")]
    for script in ({}, lambda w: "I'd rather not."):
        with pytest.raises(Exception):
            dets(spark, "E-12", [rule], passes=X.MODELS.passes("scripted", script=script, require=True))
    df = spark.createDataFrame([("E-12 and Ann",), ("  ",), (None,)], "text string")
    asked = [r["a"] for r in df.select(prose[0].asked(F.col("text"), P._none()).alias("a")).collect()]
    assert asked[0]["unparsable"] == 1 and asked[0]["windows"] == 1 and asked[0]["failed"] is False and asked[1]["windows"] is None and asked[2]["windows"] is None
    assert df.select(broken[0].asked(F.col("text"), P._none()).alias("a")).first()["a"]["failed"] is True
    with pytest.raises(ValueError):
        X.ModelPass(lambda: None, size=100)


#: What numbers look like in public plans; all are set aside for fiction or made up within a plan.
PHONES = {
    "03-0000-0001": None, "090-1234-5678": "JP", "+81 90 1234 5678": "JP", "03-3123-4567": "JP", "0120-123-456": "JP", "050-1234-5678": "JP",
    "(212) 555-0142": "US", "+1 212 555 0142": "US", "1-212-555-0142": "US", "212-155-0142": None, "911-555-0142": None, "+1 211 555 0142": None,
    "020 7946 0958": "GB", "07400 123456": "GB", "+44 20 7946 0958": "GB", "01632 960123": "GB", "0808 157 0192": "GB",
    "138 1234 5678": "CN", "13812345678": "CN", "+86 138 1234 5678": "CN", "010-66554433": "CN", "0755-23456789": "CN", "+86 10 66554433": "CN", "12812345678": None,
    "12-34": None, "1234 5678 9012 3456 7890": None,
}


def test_phone_plans(spark):
    texts = [("s", k, f"call {p} now") for k, p in enumerate(PHONES)]
    rows = P.detect(spark.createDataFrame(texts, TEXTS), [], normalize=False, passes=X.PHONES.passes("plans")).collect()
    got = {list(PHONES)[r["turn"]]: next((d["rule"].removeprefix("phone.") for d in r["dets"] if d["value"] == list(PHONES)[r["turn"]]), None) for r in rows}
    assert got == PHONES | {"03-0000-0001": "JP"}
    assert dets(spark, "a 13812345678 b", passes=X.PHONES.passes("plans", strict=True)) == []
    assert dets(spark, "a 13812345678 b", passes=X.PHONES.passes("plans", regions=("US",))) == []
    assert dets(spark, "x13812345678", passes=X.PHONES.passes("plans")) == []
    with pytest.raises(ValueError):
        X.PhonePass(("XX",))


def test_registry():
    a = X.Algorithms("thing", "plain", {"plain": lambda: ()})
    a.register("more-of_it", lambda n=1: ("x",) * n)
    assert a.available() == ("plain", "more-of_it") and a.passes("more-of_it", n=2) == ("x", "x") and a.passes("plain") == ()
    for name in ("Plain", "", "a b", "more-"):
        with pytest.raises(ValueError):
            a.register(name, lambda: ())
    with pytest.raises(ValueError, match="available: plain"):
        a.passes("plian")
    with pytest.raises(ValueError):
        X.Algorithms("thing", "none", {})
