"""Claims, literals and what is built on them, against plain versions."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilframe.functions.intervals import IntervalSet, keepers
from veilframe.functions.literals import GAP, Literals
from veilframe.operators import privacy as P
from veilframe.operators import restore as R
from veilframe.operators.rules import Rule


def plain_spans(text, value, fold=False, wrapped=False):
    gap = rf"[^\S\r\n]{{0,{GAP}}}(?:\r\n|\r|\n)?[^\S\r\n]{{0,{GAP}}}"
    rx = gap.join(map(re.escape, (p for p in value.split(" ") if p))) if wrapped and " " in value else re.escape(value)
    left, right = r"(?<![A-Za-z0-9])" if re.match("[A-Za-z0-9]", value) else "", r"(?![A-Za-z0-9])" if re.search("[A-Za-z0-9]$", value) else ""
    return [m.span() for m in re.finditer(left + rx + right, text, re.I if fold else 0)]


def test_intervals_against_a_set_of_places():
    r = random.Random(1)
    for _ in range(300):
        held, plain = IntervalSet(), set()
        for _ in range(r.randint(1, 40)):
            a = r.randint(0, 60)
            b = a + r.randint(0, 8)
            assert held.overlaps(a, b) == bool(plain & set(range(a, b)))
            if r.random() < 0.5:
                held.add(a, b)
                plain |= set(range(a, b))
            else:
                assert held.claim(a, b) == (not plain & set(range(a, b)))
                if not plain & set(range(a, b)):
                    plain |= set(range(a, b))
        got = list(held)
        assert got == sorted(got) and all(x[1] < y[0] for x, y in zip(got, got[1:]))  # neighbours that touch are one
        assert {p for a, b in got for p in range(a, b)} == plain


def test_greedy_choice_against_brute_force_and_its_growth():
    r = random.Random(2)
    for _ in range(300):
        spans = [(a := r.randint(0, 30), a + r.randint(1, 9)) for _ in range(r.randint(0, 25))]
        ranks = [(a - b, r.randint(0, 2), k) for k, (a, b) in enumerate(spans)]
        kept = []
        for k in sorted(range(len(spans)), key=ranks.__getitem__):
            if all(spans[k][1] <= spans[j][0] or spans[j][1] <= spans[k][0] for j in kept):
                kept.append(k)
        assert sorted(keepers(spans, ranks)) == sorted(kept)

    def seconds(n):  # one run of overlapping spans over the whole text
        spans = [(3 * k, 3 * k + 4) for k in range(n)]
        ranks = [(k * 7919) % n for k in range(n)]
        began = time.perf_counter()
        keepers(spans, ranks)
        return time.perf_counter() - began

    seconds(1000)
    assert min(seconds(20_000) for _ in range(3)) < 8 * max(min(seconds(5_000) for _ in range(3)), 0.005)


@pytest.mark.parametrize("fold,wrapped", [(False, False), (True, False), (True, True)])
def test_literals_against_patterns(fold, wrapped):
    r = random.Random(3)
    words = ["ann", "Ann Lee", "a", "李明", "李", "x1", "-q-", "Ann", "b  c", "é"]
    for _ in range(400):
        values = r.sample(words, r.randint(1, 6))
        text = "".join(r.choice(["ann", "Ann", "Lee", "LEE", " ", "\n", "\r\n", "李明", "x1", "-q-", "a", "b", "c", "é", "1", ".", "  "]) for _ in range(r.randint(0, 25)))
        got = Literals(values, fold, wrapped)
        for k, v in enumerate(values):
            mine = sorted((s, e) for s, e, j in got.occurrences(text) if j == k)
            want = plain_spans(text, v, fold, wrapped)
            assert set(want) <= set(mine) and Literals([v], fold, wrapped).claimed(text, IntervalSet()) == [(s, e, 0) for s, e in want], (text, v)


def test_ten_thousand_rulings_cost_one_walk():
    values = [f"value{k}x" for k in range(10_000)]
    text = " ".join(values[::7]) + " 李明value1x李明 avalue2x"
    began = time.perf_counter()
    machine = Literals(values)
    found = machine.claimed(text, IntervalSet())
    assert len(found) == len(values[::7]) + 1 and time.perf_counter() - began < 5  # an ASCII edge touches Han, never a letter


def test_rulings_against_a_plain_walk(spark):
    r = random.Random(4)
    always = [("ann lee", "PERSON"), ("lee", "PERSON"), ("青空", "COMPANY_NAME"), ("x-1", "PROJECT_NAME")]
    texts = [" ".join(r.choice(["ann", "lee", "ann lee", "leeway", "青空", "青空lee", "x-1", "zz9"]) for _ in range(r.randint(0, 12))) for _ in range(60)] + [None, ""]
    rule = Rule("EMPLOYEE_ID", r"zz9 lee", 0.9, "custom", id="custom.EMPLOYEE_ID.1")
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "scope string, turn long, text string")
    for row in P.detect(df, [rule], normalize=False, always=always).collect():
        text = row["text"] or ""
        taken = [m.span() for m in re.finditer("zz9 lee", text)]
        want = []
        for v, kind in always:
            for s, e in plain_spans(text, v):
                if all(e <= a or b <= s for a, b in taken):
                    taken.append((s, e))
                    want.append((s, e, kind, text[s:e]))
        got = [(d["start"], d["end"], d["type"], d["value"]) for d in row["dets"] if d["source"] == "corrections"]
        assert sorted(got) == sorted(want), text
    with pytest.raises(ValueError):
        P.ruled_in(F.col("text"), F.col("dets"), [("a", "WEATHER")])
    with pytest.raises(ValueError):
        P.ruled_in(F.col("text"), F.col("dets"), [("a", "PERSON")] * (P.MOST_RULINGS + 1))


def test_rulings_out_spare_no_secret(spark):
    df = spark.createDataFrame([("s", 1, "aa bb")], "scope string, turn long, text string")
    rules = [Rule("PERSON", "aa", 0.9, "custom", id="c.1"), Rule("API_KEY", "bb", 0.9, "custom", id="c.2")]
    row = P.decide(P.detect(df, rules, normalize=False), P.Policy.permissive(), ("aa", "bb")).first()
    assert [e["type"] for e in row["entities"]] == ["API_KEY"]


def test_stand_ins_come_back_wrapped_and_in_any_case(spark):
    maps = spark.createDataFrame([("s", "PERSON", 1, "i", "Jane Roe", "Avery Lane"), ("s", "PERSON", 2, "j", "Al", "Avery Lane Hale"), ("t", "PERSON", 1, "k", "Bo", None)], "scope string, type string, idx int, identity string, value string, surface string")
    cases = {"avery\nlane!": "Jane Roe!", "Avery\n\nLane": "Avery\n\nLane", "AVERY LANE HALE": "Al", "Avery Lanes": "Avery Lanes", "Avery \r\n Lane <PERSON_001>": "Jane Roe Jane Roe", "": ""}
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(cases)] + [("t", 99, "Avery Lane"), (None, 98, "Avery Lane")], "scope string, response_id long, text string")
    got = {r["response_id"]: r["restored_text"] for r in R.restore(df, maps).collect()}
    assert [got[k] for k in range(len(cases))] == list(cases.values()) and got[99] == got[98] == "Avery Lane"
