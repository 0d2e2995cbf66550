"""Detection, resolution, allocation, protection and restoration on small texts."""

import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions.normalize import fold_text
from veilframe.operators import evaluate, mappings, payload, windows
from veilframe.operators import privacy as P
from veilframe.operators import restore as R
from veilframe.operators.rules import PACKS, Rule, custom_rules, rules_for
from veilframe.streaming import restore as S

TEXTS = [
    ("a", 1, "Write to ann@example.com or +44 20 7946 0958 now."),
    ("a", 2, "ann@example.com again, and bob@example.org; card 4111 1111 1111 1111."),
    ("a", 3, "card 4111 1111 1111 1112 is no card"),
    ("b", 1, "bob@example.org, <EMAIL_001> typed by hand"),
    ("b", 2, 'password = "Tr0ub4dor&3xyz"'),
    ("b", 3, None),
    ("b", 4, ""),
    ("c", 1, "ｂｏｂ＠example.com and bob@example.com"),
]
MAPS = "scope string, type string, idx int, identity string, value string"


@pytest.fixture(scope="module")
def decided(spark):
    texts = spark.createDataFrame(TEXTS, "scope string, turn long, text string")
    return P.decide(P.detect(texts, rules_for(("universal", "en"), "balanced")), P.Policy()).cache()


def kinds(decided):
    return {(r["scope"], r["turn"]): [(e["type"], e["value"]) for e in r["entities"] or []] for r in decided.collect()}


def test_detection(decided):
    found = kinds(decided)
    assert ("EMAIL", "ann@example.com") in found["a", 1] and any(t == "PHONE" for t, _ in found["a", 1])
    assert ("CREDIT_CARD", "4111 1111 1111 1111") in found["a", 2]
    assert not any(t == "CREDIT_CARD" for t, _ in found["a", 3])
    assert ("TEXT", "<EMAIL_001>") in found["b", 1]
    assert not found["b", 4] and not found["b", 3]
    status = {(r["scope"], r["turn"]): r["status"] for r in decided.collect()}
    assert status["b", 2] == "blocked" and status["a", 1] == "ok"


#: Positive and negative cases of the rules: text, type, value found or None.
CASES = [
    ("sk-" + "a1B2" * 8, "API_KEY", "sk-" + "a1B2" * 8), ("AKIA" + "ABCD1234" * 2, "API_KEY", "AKIA" + "ABCD1234" * 2), ("xAKIA" + "ABCD1234" * 2, "API_KEY", None),
    ("ghp_" + "a1" * 18, "ACCESS_TOKEN", "ghp_" + "a1" * 18), ("ghx_" + "a1" * 18, "ACCESS_TOKEN", None), ("xoxb-" + "1" * 12, "ACCESS_TOKEN", "xoxb-" + "1" * 12),
    ("-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----", "PRIVATE_KEY", "-----BEGIN PRIVATE KEY-----\nabc\n-----END PRIVATE KEY-----"), ("-----BEGIN PRIVATE KEY-----\nabc", "PRIVATE_KEY", None),
    ("postgres://u:p@db/x", "DATABASE_URL", "postgres://u:p@db/x"), ("the password is hunter2A", "PASSWORD", "hunter2A"), ("the password is wrong", "PASSWORD", None),
    ("https://wiki.corp/x", "INTERNAL_URL", "https://wiki.corp/x"), ("https://example.com/x", "INTERNAL_URL", None), ("at 10.0.0.7.", "INTERNAL_IP", "10.0.0.7"), ("at 8.8.8.8", "INTERNAL_IP", None),
    ("/home/ann/x", "PERSON", "ann"), ("/home/root/x", "PERSON", None), ('{"employee_id": "E-77"}', "EMPLOYEE_ID", "E-77"), ('{"lastName": "Doe"}', "PERSON", "Doe"), ('{"pastName": "Doe"}', "PERSON", None), ('{"last_name": "Doe"}', "PERSON", "Doe"),
    ("ticket AB-12345 open", "IDENTIFIER", "AB-12345"), ("see RFC-2606", "IDENTIFIER", None), ("090-1234-5678", "PHONE", "090-1234-5678"), ("138 1234 5678", "PHONE", "138 1234 5678"),
    ("SSN: 219-09-9999", "SSN", "219-09-9999"), ("000-12-3456", "SSN", None), ("at SW1A 1AA.", "POSTAL_CODE", "SW1A 1AA"), ("DOB: 1990-02-03", "DATE_OF_BIRTH", "1990-02-03"), ("12 Long Oak Street", "ADDRESS", "12 Long Oak Street"),
    ("with Acme Widgets Ltd today", "COMPANY_NAME", "Acme Widgets Ltd"), ("The Same Old Ltd", "COMPANY_NAME", None), ("Project Falcon", "PROJECT_NAME", "Falcon"), ("Dear Ann Lee,", "PERSON", "Ann Lee"), ("met Ann Lee there", "PERSON", "Ann Lee"), ("on Monday June", "PERSON", None),
    ("〒100-0001 東京", "POSTAL_CODE", "100-0001"), ("株式会社あ", "COMPANY_NAME", None), ("株式会社青空", "COMPANY_NAME", "株式会社青空"), ("月光銀行へ", "COMPANY_NAME", "月光銀行"), ("担当：山田太郎", "PERSON", "山田太郎"), ("、佐藤花子。", "PERSON", "佐藤花子"), ("ヤマダ・ハナコ", "PERSON", "ヤマダ・ハナコ"),
    ("案件「青空」は", "PROJECT_NAME", "青空"), ("会員番号：A-123", "EMPLOYEE_ID", "A-123"), ("番号 1234 5678 9018 です", "MY_NUMBER", "1234 5678 9018"), ("番号 1234 5678 9012 です", "MY_NUMBER", None),
    ("身份证 11010519491231002X。", "RESIDENT_ID", "11010519491231002X"), ("身份证 110105194912310021。", "RESIDENT_ID", None), ("王小明先生", "PERSON", "王小明"), ("项目“蓝天”", "PROJECT_NAME", "蓝天"), ("电话 13812345678。", "PHONE", "13812345678"), ("蓝天有限公司", "COMPANY_NAME", "蓝天有限公司"),
]


def test_each_rule_by_cases(spark):
    texts = spark.createDataFrame([("x", k, t) for k, (t, _, _) in enumerate(CASES)], "scope string, turn long, text string")
    got = {r["turn"]: {(d["type"], d["value"]) for d in r["dets"]} for r in P.detect(texts).collect()}
    for k, (text, kind, value) in enumerate(CASES):
        own = {v for t, v in got[k] if t == kind}
        assert (value in own) if value else not own, (text, kind, own)


def test_every_rule_finds_its_value_and_refuses_its_near_miss(spark):
    from veilframe.plans.rule_cases import CASES as EACH

    assert list(EACH) == [r.id for r in rules_for()]
    rows = [("x", 2 * k + j, t) for k, (text, _, miss) in enumerate(EACH.values()) for j, t in enumerate((text, miss))]
    got = {r["turn"]: {(d["rule"], d["value"]) for d in r["dets"]} for r in P.detect(spark.createDataFrame(rows, "scope string, turn long, text string")).collect()}
    missed = [rule for k, (rule, (_, value, _)) in enumerate(EACH.items()) if (rule, value) not in got[2 * k]]
    wrong = [rule for k, rule in enumerate(EACH) if any(r == rule for r, _ in got[2 * k + 1])]
    assert not missed and not wrong, (missed, wrong)


def test_all_rules_against_plain_regular_expressions(spark):
    """The same matches, in the same places, as Python's finditer gives for every rule over random pieces."""
    r = random.Random(5)
    pieces = [t for t, _, _ in CASES] + ["ann@example.com", "+1 555 010 0199", "4111111111111111", "a", " ", "\n", "é", "漢字", "かな", "1234567890", ", ", "x_1", "AB", "Zz Yy"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 8))) for _ in range(150)]
    rules = [x for x in rules_for() if not x.validator]
    python = lambda p: re.sub(r"\\p\{Is(\w+)\}", lambda m: {"Han": "\u2e80-\u2fd5\u3005\u3007\u3021-\u3029\u3038-\u303b\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff", "Hiragana": "\u3041-\u3096\u309d-\u309f", "Katakana": "\u30a1-\u30fa\u30fd-\u30ff\u31f0-\u31ff\uff66-\uff6f\uff71-\uff9d"}[m[1]], p)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    rows = df.select("k", *(F.transform(P.rule_hits(F.col("text"), x), lambda d: F.struct(d["start"], d["end"])).alias(f"r{i}") for i, x in enumerate(rules))).collect()
    for i, x in enumerate(rules):
        # classes inside classes need no brackets of their own, outside they do
        body = re.sub(r"(?<!\[)(?<!\[\^)((?:\\p\{Is\w+\}))(?![^\[]*\])", r"[\1]", x.pattern)
        if "[[" in body:
            continue
        rx = re.compile(python(body), re.ASCII)
        for row in rows:
            want = [m.span(2 if x.grouped else 0) for m in rx.finditer(texts[row["k"]])]
            assert [tuple(s) for s in row[f"r{i}"]] == want, (x.id, texts[row["k"]])


def test_resolution_against_brute_force(spark):
    r = random.Random(3)
    types = ["EMAIL", "PHONE", "PERSON", "SSN"]
    piles = []
    for k in range(200):
        pile = []
        for _ in range(r.randint(0, 7)):
            a = r.randint(0, 20)
            t = r.choice(types)
            pile.append((a, a + r.randint(1, 9), t, "v", r.choice([0.5, 0.7, 0.9]), r.choice("ab"), "r", P.ENTITY_TYPES[t][0], "PII"))
        piles.append((k, pile))
    df = spark.createDataFrame(piles, f"k int, dets {P.DETS}").select("k", "dets", P.resolved(F.col("dets")).alias("kept"), P.disjoint(P.resolved(F.col("dets"))).alias("fine"))
    for row in df.collect():
        kept = []
        for d in sorted(row["dets"], key=lambda d: (-(d["end"] - d["start"]), -d["severity"], -d["confidence"], d["start"], d["source"], d["type"])):
            if all(d["end"] <= k["start"] or k["end"] <= d["start"] for k in kept):
                kept.append(d)
        assert [tuple(k) for k in row["kept"]] == sorted(tuple(k) for k in kept) and row["fine"]


def test_passes_see_what_came_before(spark):
    secret = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [("s", 1, f"Dear Ann Lee, Ann Lee and annAnn Leeb; token {secret} or Kestrel; ａｎｎ"), ("s", 2, None), ("s", 3, f"sha256 {secret}")]
    rules = rules_for(("en",), "balanced")
    got = {r["turn"]: r["dets"] for r in P.detect(spark.createDataFrame(rows, "scope string, turn long, text string"), rules, co_occurrence=True, secrets=True, always=[("Kestrel", "PROJECT_NAME")]).collect()}
    assert [(d["value"], d["source"]) for d in got[1] if d["type"] == "PERSON"] == [("Ann Lee", "en"), ("Ann Lee", "co_occurrence")]
    assert [(d["value"], d["confidence"]) for d in got[1] if d["source"] == "entropy"] == [(secret, 0.7)]
    assert [d["confidence"] for d in got[3] if d["source"] == "entropy"] == [0.5]
    assert [(d["value"], d["source"]) for d in got[1] if d["type"] == "PROJECT_NAME"] == [("Kestrel", "corrections")]
    assert not got[2]
    for d in got[1]:
        assert rows[0][2][d["start"] : d["end"]] == d["value"]


def test_passes_over_parquet(spark, tmp_path):
    spark.createDataFrame([("s", 1, "Dear Ann Lee, Ann Lee 漢ａ")], "scope string, turn long, text string").write.parquet(str(tmp_path / "t"))
    d = P.decide(P.detect(spark.read.parquet(str(tmp_path / "t")), rules_for(), co_occurrence=True, secrets=True), P.Policy())
    assert sum(e["type"] == "PERSON" for e in d.first()["entities"]) == 2


def test_suppressed_pack(spark):
    rows = [("s", 1, "王小明先生。かなです、李小红先生。"), ("s", 2, "王小明先生です")]
    got = {r["turn"]: {d["value"] for d in r["dets"] if d["source"] == "zh"} for r in P.detect(spark.createDataFrame(rows, "scope string, turn long, text string"), rules_for(("zh",))).collect()}
    assert "王小明" in got[1] and "李小红" not in got[1] and not got[2]


def test_trace_tells_winner_and_reason(spark):
    rules = [Rule("EMAIL", r"[a-z]+@[a-z.]+", 1.0, need="@", id="e"), Rule("PERSON", r"[a-z]+(?=@)", 0.9, "custom", id="p")]
    t = P.trace(P.detect(spark.createDataFrame([("s", 1, "ann@example.com")], "scope string, turn long, text string"), rules), P.Policy(min_confidence=0.95))
    assert {(r["rule"], r["outcome"]) for r in t.collect()} == {("e", "kept"), ("p", "below_confidence")}
    t = P.trace(P.detect(spark.createDataFrame([("s", 1, "ann@example.com")], "scope string, turn long, text string"), rules), P.Policy(), never=("ann@example.com",))
    assert {(r["rule"], r["outcome"]) for r in t.collect()} == {("e", "corrected_away"), ("p", "kept")}


def test_scopes_that_quote(spark, decided):
    quoting = spark.createDataFrame([("to ann@example.com", 1, "ann@example.com"), ("x", 1, "ann@example.com")], "scope string, turn long, text string")
    found = P.quoting_scopes(P.decide(P.detect(quoting, rules_for(("universal",))), P.Policy()))
    assert [tuple(r) for r in found.collect()] == [("to ann@example.com", 1)]
    assert P.quoting_scopes(decided).count() == 0


def test_custom_rules_are_checked(spark):
    (rule,) = custom_rules(spark, [{"type": "PROJECT_NAME", "pattern": "operation [a-z]+"}])
    assert rule.id == "custom.PROJECT_NAME.1"
    for bad in ({"type": "NOPE", "pattern": "x"}, {"type": "EMAIL", "pattern": "x", "colour": 1}, {"type": "EMAIL", "pattern": "(?:a+)+b(?:a+)+c"}):
        with pytest.raises(Exception):  # noqa: B017
            custom_rules(spark, [bad])


def test_placeholders_are_dense_and_come_back(spark, decided):
    maps = mappings.allocate(decided).cache()
    rows = maps.collect()
    for key, own in itertools.groupby(sorted((r["scope"], r["type"], r["idx"]) for r in rows), lambda x: x[:2]):
        assert [x[2] for x in own] == list(range(1, 1 + sum((r["scope"], r["type"]) == key for r in rows)))
    assert [(r["identity"], r["value"]) for r in rows if r["scope"] == "c"] == [("bob@example.com", "ｂｏｂ＠example.com")]
    sent = mappings.protect(decided, maps, P.Policy()).where("status = 'ok' and protected_text is not null")
    assert not any("@" in r["protected_text"] for r in sent.collect())
    back = R.restore(sent.selectExpr("scope", "turn response_id", "protected_text text"), maps)
    original = {(s, t): x for s, t, x in TEXTS} | {("c", 1): "ｂｏｂ＠example.com and ｂｏｂ＠example.com"}
    assert all(r["restored_text"] == original[r["scope"], r["response_id"]] and r["is_clean"] for r in back.collect())
    again = mappings.allocate(decided, maps)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, rows))


def test_numbers_of_a_hot_group_span_tasks(spark):
    rows = [("hot" if k % 10 else "cold", k, k % 7) for k in range(2000)]
    got = mappings.numbered(spark.createDataFrame(rows, "scope string, turn long, x int").repartition(3), ["scope"], ["turn"]).collect()
    for scope in ("hot", "cold"):
        own = sorted((r["turn"], r["idx"]) for r in got if r["scope"] == scope)
        assert [i for _, i in own] == list(range(1, len(own) + 1))
    plan = mappings.numbered(spark.createDataFrame(rows, "scope string, turn long, x int"), ["scope"], ["turn"])._jdf.queryExecution().toString()
    assert "row_number" not in plan


def test_surrogates(spark, decided):
    texts = spark.createDataFrame(TEXTS, "scope string, turn long, text string")
    maps = mappings.allocate(decided)
    shown = mappings.with_surrogates(maps, texts).cache()
    assert {r["surface"] for r in shown.where("scope = 'a' and type = 'EMAIL'").collect()} == {"contact1@example.com", "contact2@example.com"}
    sent = mappings.protect(decided, shown, P.Policy()).where("status = 'ok' and protected_text is not null").cache()
    assert "contact1@example.com" in sent.where("scope = 'a' and turn = 1").first()["protected_text"]
    back = R.restore(sent.selectExpr("scope", "turn response_id", "replace(protected_text, 'contact', 'CONTACT') text"), shown)
    original = {(s, t): x for s, t, x in TEXTS} | {("c", 1): "ｂｏｂ＠example.com and ｂｏｂ＠example.com"}
    assert all(r["restored_text"] == original[r["scope"], r["response_id"]] for r in back.collect())
    taken = spark.createDataFrame([("z", "EMAIL", 1, "contact1@example.com", "contact1@example.com"), ("z", "EMAIL", 2, "q@example.org", "q@example.org")], MAPS)
    got = {r["idx"]: r["surface"] for r in mappings.with_surrogates(taken, texts).collect()}
    assert got == {1: "contact2@example.com", 2: "contact3@example.com"}


def test_no_scope_reads_anothers_mapping(spark, decided):
    maps = mappings.allocate(decided)
    r = R.restore(spark.createDataFrame([("other", 1, "see <EMAIL_001>")], "scope string, response_id long, text string"), maps).first()
    assert r["restored_text"] == "see <EMAIL_001>" and not r["is_clean"]


REPLIES = [
    ("to <EMAIL_001>.", "to x@example.com."), ("to [EMAIL_001].", "to x@example.com."), ("to {email-1}", "to x@example.com"), ("to EMAIL_001", "to x@example.com"), ("to < EMAIL _ 001 >!", "to x@example.com!"),
    ("＜EMAIL_001＞", "x@example.com"), ("**EMAIL_001**", "**x@example.com**"), ("EMAIL\n001", "x@example.com"), ("[EMAIL_001", "[x@example.com"), ("<EMAIL_001]", "<x@example.com]"),
    ("012EMAIL_001", "012EMAIL_001"), ("EMAIL_0012x", "EMAIL_0012x"), ("table-EMAIL_001", "table-EMAIL_001"), ("<EMAIL_000>", "<EMAIL_000>"), ("<EMAIL_009>", "<EMAIL_009>"), ("step 2 of 3", "step 2 of 3"), ("COVID-19", "COVID-19"), ("", ""), (None, ""),
    ("<EMAIL_002>", "<EMAIL_001>"),
]


def known(spark):
    return spark.createDataFrame([("s", "EMAIL", 1, "x@example.com", "x@example.com"), ("s", "EMAIL", 2, "<EMAIL_001>", "<EMAIL_001>"), ("s", "PERSON", 12, "Ann", "Ann")], MAPS)


def test_altered_tokens_are_restored_and_ordinary_text_is_not(spark):
    replies = spark.createDataFrame([("s", k, t) for k, (t, _) in enumerate(REPLIES)] + [(None, 99, "<EMAIL_001>"), ("s", None, "<EMAIL_001>")], "scope string, response_id long, text string")
    restored = R.restore(replies, known(spark)).cache()
    got = {(r["scope"], r["response_id"]): r for r in restored.collect()}
    for k, (_, want) in enumerate(REPLIES):
        assert got["s", k]["restored_text"] == want
    assert got["s", 0]["tampered"] == [] and got["s", 1]["tampered"] == ["EMAIL_001"] and got["s", 5]["tampered"] == ["EMAIL_001"]
    assert got["s", 14]["unknown"] == ["EMAIL_009"] and got["s", 15]["unknown"] == []
    assert got[None, 99]["restored_text"] == "<EMAIL_001>" and got["s", None]["restored_text"] == "x@example.com"
    missing = R.missing(replies, restored, known(spark)).where("response_id = 5").collect()
    assert {(r["type"], r["idx"]) for r in missing} == {("EMAIL", 2), ("PERSON", 12)}
    counts = {r["response_id"]: r["missing"] for r in R.missing_counts(restored, known(spark)).where("scope = 's'").collect()}
    assert counts[5] == 2 and counts[17] == 3


def test_missing_placeholders_are_counted_without_listing_them(spark):
    """The same numbers as the list has, also of replies that hold a token twice, none or all, of scopes without replies and of none;
    and 3,000 replies of a scope with 200,000 placeholders, 600 million rows if they were listed."""
    maps = spark.createDataFrame([(s, t, k, f"{t}{k}", f"{t}{k}") for s, t, n in (("s", "EMAIL", 4), ("s", "PERSON", 2), ("s", "A_B", 1), ("t", "EMAIL", 1), ("u", "EMAIL", 3), (None, "EMAIL", 2)) for k in range(1, n + 1)], "scope string, type string, idx int, identity string, value string")
    texts = [("s", 1, "<EMAIL_001> <EMAIL_001> email 2 <A_B_001>"), ("s", 2, None), ("s", 3, "[PERSON_002] <EMAIL_009> <A_B_001>"), ("t", 4, "<EMAIL_001>"), ("v", 5, "<EMAIL_001>"), (None, 6, "<EMAIL_001>")]
    replies = spark.createDataFrame(texts, "scope string, response_id long, text string")
    restored = R.restore(replies, maps)
    rows = lambda df: sorted((r["scope"], r["type"], r["n"]) for r in df.collect())
    listed = rows(R.missing(replies, restored, maps).groupBy("scope", "type").agg(F.count("*").alias("n")))
    assert rows(R.missing_by_type(restored, maps)) == listed == [("s", "A_B", 1), ("s", "EMAIL", 10), ("s", "PERSON", 5)]
    many = spark.range(1, 200_001).selectExpr("'s' scope", "'EMAIL' type", "cast(id as int) idx")
    held = spark.range(3_000).selectExpr("'s' scope", "id response_id", "array(format_string('EMAIL_%03d', id + 1), 'EMAIL_001') restored")
    assert rows(R.missing_by_type(held, many)) == [("s", "EMAIL", 3_000 * 200_000 - 5_999)]
    from veilframe.plans import whole

    plan = whole.missing_placeholders(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString() if os.path.isdir("/root/testdata/sf0.001") else ""
    assert "response_id" not in plan  # no row for each reply is joined to what its scope minted


def test_no_reply_carries_its_scopes_mappings(spark):
    replies = spark.createDataFrame([("s", 1, "<EMAIL_001>")], "scope string, response_id long, text string")
    plan = R.restore(replies, known(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert all("response_id" in line for line in plan.splitlines() if "collect_list" in line and "Aggregate" in line)


def pieces(text, cuts):
    context, held, out = "", "", []
    for k, (a, b) in enumerate(itertools.pairwise([0, *cuts, len(text)])):
        before = context
        context, held, released = S.cut(context, held, text[a:b], k == len(cuts))
        out.append((before, released))
    return out


def test_streams_equal_batches_at_random_cuts(spark):
    """20,000 random texts and cuts: segments restored one by one are the whole restored."""
    r = random.Random(7)
    atoms = ["EMAIL_001", "EMAIL", "_", "001", "1", "<", ">", "[", "]", " ", "  ", "-", "E", "M", "person", "012", "＜", "＞", "Ｅ", "é", "\u0301", "\n", "x", "PERSON_12", ", ", "\t", "a" * 70, "{", "}", "２"]
    cases = []
    for k in range(20_000):
        text = "".join(r.choice(atoms) for _ in range(r.randint(1, 12)))
        cuts = sorted(r.randint(0, len(text)) for _ in range(r.randint(0, 5)))
        cases.append((k, text, pieces(text, cuts)))
        assert "".join(x for _, x in cases[-1][2]) == text
        assert all(len(fold_text(x)[0]) <= S.HOLD + 40 for x in [text])
    whole = spark.createDataFrame([("s", k, t) for k, t, _ in cases], "scope string, response_id long, text string").repartition(8)
    want = {x["response_id"]: x["restored_text"] for x in R.restore(whole, known(spark)).collect()}
    segments = spark.createDataFrame([("s", str(k), n, c, t) for k, _, own in cases for n, (c, t) in enumerate(own)], "scope string, stream_id string, seq long, context string, text string").repartition(8)
    got = {}
    for x in S.restore_segments(segments, known(spark)).collect():
        got.setdefault(int(x["stream_id"]), {})[x["seq"]] = x["text"]
    different = [(t, own) for k, t, own in cases if "".join(v for _, v in sorted(got[k].items())) != want[k]]
    assert not different, different[:3]


def test_what_is_held_stays_small():
    held = context = ""
    r = random.Random(1)
    for _ in range(300):
        context, held, _ = S.cut(context, held, "".join(r.choice("ab _-<1\n") for _ in range(40)), False)
        assert len(held) <= S.HOLD
    assert S.cut("", "", "hello world this ", False)[1] != "hello world this "


def test_a_stream(spark, tmp_path):
    path = str(tmp_path)
    text = "Dear <PERSON_012>, [EMAIL_001] or <EMAIL_009>; step 2 < 3."
    chunks = [("s", "one", k, text[i : i + 3], i + 3 >= len(text)) for k, i in enumerate(range(0, len(text), 3))] + [("s", "two", 0, None, False), ("s", "two", 1, "EMAIL 1", True)]
    schema = "scope string, stream_id string, seq long, chunk string, is_last boolean"
    for part in (chunks[:7], chunks[7:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    S.restore_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"), known(spark), f"{path}/out", f"{path}/cp").awaitTermination()
    got = {}
    for r in spark.read.parquet(f"{path}/out").collect():
        got.setdefault(r["stream_id"], {})[r["seq"]] = r["text"]
    assert "".join(v for _, v in sorted(got["one"].items())) == "Dear Ann, x@example.com or <EMAIL_009>; step 2 < 3."
    assert "".join(v for _, v in sorted(got["two"].items())) == "x@example.com"


def test_strict_tokens(spark):
    rows = ["<EMAIL_001>", "<EMAIL_0>", "[EMAIL_001]", "<EMAIL_000>", "x<EMAIL_001>", None]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in rows], "t string").select(R.parse_token(F.col("t")).alias("t")).collect()]
    assert got == [("EMAIL", 1), None, None, None, None, None]


def test_windows_hold_every_place():
    r = random.Random(1)
    text = "".join(r.choice("ab .\n。") for _ in range(5000))
    cut = windows.windows(text, 500, 100)
    assert all(text[at : at + len(w)] == w and len(w) <= 500 for at, w in cut)
    assert cut[-1][0] + len(cut[-1][1]) == len(text)
    assert all(b[0] <= a[0] + len(a[1]) for a, b in itertools.pairwise(cut))
    assert windows.longest_whole(500, 100) == 100
    with pytest.raises(ValueError, match="64"):
        windows.longest_whole(100, 400)


def test_annotations():
    assert evaluate.parse_annotated("to [[EMAIL:a@b.c]] and [[?PERSON:Bo]]") == ("to a@b.c and Bo", [("EMAIL", 3, 8, False), ("PERSON", 13, 15, True)])
    for bad in ("[[EMAIL:]]", "[[EMAIL:a", "x]]"):
        with pytest.raises(ValueError, match="label"):
            evaluate.parse_annotated(bad)


def plain_score(length, gold, found):
    free, out = sorted(found, key=lambda p: (p[1], -p[2], p[0])), []
    for g in sorted(gold, key=lambda g: (g[1], g[2], g[0], g[3])):
        fit = [p for p in free if p[1] < g[2] and g[1] < p[2] and (g[3] or p[0] == g[0])]
        if g[3]:
            free = [p for p in free if p not in fit]
        else:
            out.append((g[0], "tp" if fit else "fn"))
            if fit:
                free.remove(fit[0])
    chars = lambda xs: {c for x in xs for c in range(x[1], x[2])}
    need, may, got = chars([g for g in gold if not g[3]]), chars([g for g in gold if g[3]]), chars(found)
    return sorted(out + [(p[0], "fp") for p in free]), (len(need), len(need - got), length - len(need) - len(may), len(got - need - may))


def test_scores_against_plain_python(spark):
    r = random.Random(11)
    samples, gold, found, want = [], [], [], {}
    for k in range(150):
        g, p, at = [], [], 0
        while at < 30:  # labels don't overlap
            at += r.randint(1, 6)
            end = at + r.randint(1, 6)
            g.append((r.choice("AB"), at, end, r.random() < 0.3))
            at = end
        for _ in range(r.randint(0, 5)):
            a = r.randint(0, 30)
            p.append((r.choice("AB"), a, a + r.randint(1, 8)))
        p = sorted(set(p))
        samples.append(("d", k, "x" * 60))
        gold += [("d", k, *x) for x in g]
        found += [("d", k, *x) for x in p]
        want[k] = plain_score(60, g, p)
    s = spark.createDataFrame(samples, "dataset string, sample_id long, text string")
    g = spark.createDataFrame(gold, "dataset string, sample_id long, type string, start int, end int, tolerated boolean")
    p = spark.createDataFrame(found, "dataset string, sample_id long, type string, start int, end int")
    got = {}
    for x in evaluate.matches(s, g, p).collect():
        got.setdefault(x["sample_id"], []).append((x["type"], x["outcome"]))
    cover = {x["sample_id"]: (x["sensitive"], x["leaked"], x["ordinary"], x["over"]) for x in evaluate.coverage(s, g, p).collect()}
    for k in want:
        assert (sorted(got.get(k, [])), cover[k]) == want[k]


def test_tolerated_labels_claim_in_their_place(spark):
    s = spark.createDataFrame([("d", 1, "x" * 9)], "dataset string, sample_id long, text string")
    g = spark.createDataFrame([("d", 1, "A", 0, 5, True), ("d", 1, "B", 5, 8, False)], "dataset string, sample_id long, type string, start int, end int, tolerated boolean")
    p = spark.createDataFrame([("d", 1, "B", 2, 6)], "dataset string, sample_id long, type string, start int, end int")
    assert [(r["type"], r["outcome"]) for r in evaluate.matches(s, g, p).collect()] == [("B", "fn")]


def test_datasets_that_prove_nothing(spark):
    rows = [("a", "others", "people", []), ("b", "authors", "people", []), ("c", "others", "rules", []), ("d", "others", "people", ["x"]), ("e", "others", "people", None)]
    got = {r["dataset"] for r in evaluate.no_evidence(spark.createDataFrame(rows, "dataset string, text_by string, labels_by string, rules_in_view array<string>")).collect()}
    assert got == {"b", "c", "d", "e"}


def test_payloads(spark):
    body = '{"model": "m", "messages": [{"role": "user", "content": "hi ann"}], "odd": "value"}'
    df = spark.createDataFrame([(1, body), (2, None), (3, "{"), (4, "7")], "payload_id long, payload string")
    got = {(r["payload_id"], r["status"], r["path"], r["where"], r["is_key"]) for r in payload.slots(df).collect()}
    assert {(1, "ok", '["messages", 0, "content"]', "content", False), (1, "ok", '["odd"]', None, False), (1, "ok", "[]", None, True), (2, "invalid", None, None, None), (3, "invalid", None, None, None)} <= got
    changed = spark.createDataFrame([(1, '["messages", 0, "content"]', "hi you"), (4, '["x"]', "y")], "payload_id long, path string, text string")
    back = {r["payload_id"]: r for r in payload.put_back(df, changed).collect()}
    assert '"content":"hi you"' in back[1]["payload"] and [back[k]["status"] for k in (1, 2, 3, 4)] == ["ok", "invalid", "invalid", "no_such_path"]
    assert back[3]["payload"] == "{" and back[2]["payload"] is None and back[4]["payload"] == "7"


def test_packs_are_named():
    assert set(PACKS) == {"universal", "en", "ja", "zh"} and len(rules_for()) == 91
    assert all(a.pattern == b.pattern for a, b in zip(rules_for(stance="balanced"), [r for r in rules_for() if r.tier == "core"]))
    with pytest.raises(ValueError, match="stance"):
        rules_for(stance="loud")


def test_places_are_worked_out_once_for_all_rules_of_a_pack(spark):
    d = P.detect(spark.createDataFrame([("s", 1, "x")], "scope string, turn long, text string"), rules_for())
    plan = d._jdf.queryExecution().analyzed().toString()
    assert plan.count("aggregate(split(") < 10 < len(rules_for())


def test_what_spares_walks_hides_no_hit(spark):
    from dataclasses import replace

    from veilframe.plans.rule_cases import CASES

    rows = [("s", k, str(t)) for k, case in enumerate(CASES.values()) for t in (case if isinstance(case, (tuple, list)) else (case,))]
    rows += [("s", 900, "Dr Jane Roe, Prof. Max Fry and Mrs Ann Lee of Acme Tools GmbH\ufdd0: ssn: 123-45-6789"), ("s", 901, None), ("s", 902, "")]
    texts = spark.createDataFrame(rows, "scope string, turn long, text string")
    bare = [replace(r, need=None, signs="", gate=None, digits=0) for r in rules_for()]
    found = [sorted(map(str, P.detect(texts, rules).select("turn", "dets").collect())) for rules in (rules_for(), bare)]
    assert found[0] == found[1] and sum("source=" in x for x in found[0]) > 50


def test_folding_a_long_text_costs_what_changes_in_it(spark):
    import unicodedata

    from veilframe.functions import normalize

    pieces = ["plain words, ", "é", "e\u0301", "Ａ１：", "ﬁ", "\u0301", "가", "a\u0323\u0307 ", "½", "\n", "漢字", "ｶﾞ", "x\uff9e", "\u2100", "\U0001d400"]
    rng = random.Random(5)
    for _ in range(2000):
        t = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
        folded, starts, ends = normalize.fold_text(t)
        out, i = [], 0
        while i < len(t):
            j = i + 1
            while j < len(t) and unicodedata.combining(unicodedata.normalize("NFKC", t[j])[:1] or "\0"):
                j += 1
            out += [(c, i, j) for c in unicodedata.normalize("NFKC", t[i:j])]
            i = j
        if starts is None:
            assert folded == t
        else:
            assert list(zip(folded, starts, ends, strict=True)) == out
    calls = []
    real = unicodedata.normalize
    normalize.unicodedata.normalize = lambda form, s: calls.append(s) or real(form, s)
    try:
        assert normalize.fold_text("plain words " * 1000 + "：")[0].endswith(" :")
    finally:
        normalize.unicodedata.normalize = real
    assert len(calls) < 10


def test_patterns_that_ask_for_the_rare_first_find_the_same(spark):
    """No rule looks back at every character of a text where a digit or capital must follow; hits are those of its pattern."""
    from veilframe.functions.spans import ready, seen_first

    assert seen_first(r"(?i)(?<![0-9])[0-9]{2,5}x") == r"(?i)[0-9](?<![0-9][0-9])[0-9]{1,4}x"
    assert seen_first(r"(?<![a-z])AB") == r"A(?<![a-z]A)B" and seen_first(r"(?<![a-z])[0-9]{1}b") == r"[0-9](?<![a-z][0-9])b"
    for same in (r"(?<![0-9])[0-9]{0,3}a", r"(?<![0-9])[0-9]*a", r"(?<![0-9])[0-9]{2,}a", r"(?<![0-9])A?b", r"(?<![a-z])[a-z]{3}", r"(?<!\p{IsHan})A", "ab"):
        assert seen_first(same) == same
    changed = [x for x in rules_for() if ready(x.pattern) != x.pattern and "\\p" not in x.pattern]
    assert {"en.PERSON.5", "universal.INTERNAL_IP.1", "universal.CREDIT_CARD.1"} <= {x.id for x in changed}
    r = random.Random(11)
    pieces = ["0", "1", "07", "90", "123", "4567", "-", ".", " ", "A", "AB", "Ann", "Lee", "x", "é", "漢", "10.0.0.1", "080-1234-5678", "SW1A 1AA", "ID-123", "123-45-6789", "12 Old Road", "4111 1111 1111 1111", "13912345678", "12345-6789"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    both = [F.struct(*(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for n, p in (("a", x.pattern), ("b", ready(x.pattern))))).alias(f"r{k}") for k, x in enumerate(changed)]
    out = df.select(*both).agg(*(F.struct(F.sum(F.size(f"r{k}.a")), F.sum((F.col(f"r{k}.a") != F.col(f"r{k}.b")).cast("int"))).alias(f"r{k}") for k in range(len(changed)))).first()
    assert [out[k][1] for k in range(len(changed))] == [0] * len(changed)
    assert sum(out[k][0] > 0 for k in range(len(changed))) >= 15


def test_exact_literals_lose_no_hit(spark):
    """Literals that spare a walk are in whatever their pattern finds; texts with them in another case are none."""
    rows = ["ask Mr. Bean, Mrs Low, Dr Who, Prof. Oak", "Dear Ann Lee, you", "Hi Bob, Hello Sue, me", "Thanks, Ann Lee", "Regards,\nAnn Lee", "Contact: Ann Lee", "Reported by: Ann Lee", "Project Hermes", "AKIA" + "A1" * 8, "ASIA" + "B2" * 8, "AIza" + "aB3-_" * 7, "ghs_" + "a1" * 18, "xoxb-" + "a1" * 10, "see Big Old PLC now, Tiny GmbH"]
    ids = [("en.PERSON.1", 4), ("en.PERSON.2", 1), ("en.PERSON.2", 2), ("en.PERSON.3", 1), ("en.PERSON.3", 1), ("en.PERSON.4", 1), ("en.PERSON.4", 1), ("en.PROJECT_NAME.1", 1), ("universal.API_KEY.3", 1), ("universal.API_KEY.3", 1), ("universal.API_KEY.4", 1), ("universal.ACCESS_TOKEN.1", 1), ("universal.ACCESS_TOKEN.3", 1), ("en.COMPANY_NAME.1", 2)]
    df = spark.createDataFrame([("s", k, t) for k, t in enumerate(rows)] + [("s", 100 + k, t.lower()) for k, t in enumerate(rows)], "scope string, turn long, text string")
    found = {x["turn"]: [d["rule"] for d in x["dets"]] for x in P.detect(df, [x for x in rules_for() if x.exact or x.id == "universal.ACCESS_TOKEN.1"]).collect()}
    assert [found[k].count(rule) for k, (rule, _) in enumerate(ids)] == [n for _, n in ids]
    assert all(rule not in found[100 + k] for k, (rule, _) in enumerate(ids) if rule not in ("universal.ACCESS_TOKEN.1", "universal.ACCESS_TOKEN.3"))
