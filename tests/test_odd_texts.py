"""Queries against their SQL on texts that the smallest tables don't hold."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilframe.operators import privacy as P
from veilframe.operators.rules import Rule
from veilframe.plans.catalogue import _table
from veilframe.streaming import restore as stream

from .test_queries import ORACLE_SQL, QUERIES, plain


def same_as_sql(spark, name: str, folder: str) -> None:
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLE_SQL[name]})").fetchall()
    got = [[plain(x) for x in r] for r in df.select(*cols).collect()]
    assert got
    assert sorted(map(str, got)) == sorted(str([plain(x) for x in r]) for r in want)


@pytest.fixture(scope="module")
def meeting(spark, tmp_path_factory):
    """A card that begins inside a longer phone number, a value that stands inside another before it, a token that is none of ours."""
    folder = str(tmp_path_factory.mktemp("meeting"))
    rows = [
        (0, "call +1 (269) 555-3296 4524132264652876 and on", "en"),
        (1, "joann@example.com knows ann@example.com, card 4111 1111 1111 1111", "en"),
        (2, "4111 1111 1111 1111, zoe@example.org, <EMAIL_001>", "en"),
        (3, "+49 30 1234567 or bob@example.com", "de"),
        (4, 'token = "' + "0a" * 20 + '" of bob@example.com', "de"),
        (5, None, "de"),
        *((k, f"contact{k}@example.net and joann@example.com", "en") for k in range(6, 70)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder


@pytest.mark.parametrize("name", ["missing_placeholders", "stored_mappings", "placeholder_rows", "placeholders_continued", "protection_records", "purged_scopes", "restoration_records", "restored_replies", "sealed_mappings"])
def test_rules_that_meet_are_resolved_in_sql_too(spark, meeting, name):
    same_as_sql(spark, name, meeting)


def test_a_place_that_the_model_tells_is_the_only_one_in_sql_too(spark, tmp_path):
    """The scripted model says place 7 of every window: there, and only there, its name counts."""
    rows = [(1, 0, "user", "xy and Tion Tion"), (1, 1, "user", "but it Tional, Tion"), (1, 2, "user", "so Tion, Tion"), (2, 0, "user", ("ab cd. Name " * 60))]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(0, "", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    same_as_sql(spark, "model_pass", str(tmp_path))


def test_more_rulings_than_a_hand_written_log_has(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("veilframe.sources.mappings.MOST_RULINGS", 3)
    words = ["thrillingly", "thunderstorm", "abcdefghij", "bcdefghijk", "cdefghijkl", "thousandfold"]
    rows = [(k, f"{w} and {words[k - 1]}, {w}x {w}1", "en") for k, w in enumerate(words)] + [(9, None, "en"), (11, "abcdefghij", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "hello")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    same_as_sql(spark, "ruled_texts", str(tmp_path))


def test_rulings_of_rows_are_those_of_a_list(spark):
    """Values of several words, of other scripts and inside others: joined to their texts, they find what one list finds."""
    texts = spark.createDataFrame([("s", 0, "Project Blue Sky, blue; 青山 and 青山仁. Blue Skylark #x1 tell ann"), (None, None, "Blue Sky"), ("s", 2, None)], "scope string, turn int, text string")
    rulings = [("Blue", "ALWAYS", "PERSON"), ("Blue Sky", "ALWAYS", "PROJECT_NAME"), ("青山", "ALWAYS", "PERSON"), ("#x1", "ALWAYS", "PERSON"), ("absent", "ALWAYS", "PERSON"), ("tell", "NEVER", None)]
    log = spark.createDataFrame(rulings, "value string, verdict string, entity_type string")
    rule = Rule("PERSON", r"(?<![a-z])[a-z]{4}(?![a-z])", 0.9, "custom", id="custom.PERSON.1")
    with_own = P.with_rulings(texts, log, P.detect(texts, [rule], normalize=False))
    got = P.decide(P.detect(with_own, [rule], normalize=False, always=F.col("_always")), P.Policy(), F.col("_never"))
    want = P.decide(P.detect(texts, [rule], normalize=False, always=sorted((v, t) for v, k, t in rulings if k == "ALWAYS")), P.Policy(), ("tell",))
    shown = lambda df: sorted(map(str, df.select("scope", "turn", "entities").collect()))
    assert shown(got) == shown(want)
    assert "Blue" in str(shown(got)) and "tell" not in str(shown(got))


def test_batches_for_python_dont_grow_with_a_task(spark, tmp_path):
    rows = [(k, f"text {k}", "en") for k in range(8000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    size = F.pandas_udf(lambda s: pd.Series([len(s)] * len(s)), "int")
    assert _table(spark, str(tmp_path), "documents").select(size("text").alias("n")).agg(F.max("n")).first()[0] <= 500


def test_a_batch_of_a_stream_is_cut_once(spark, tmp_path, monkeypatch):
    """Restoring reads the cut pieces several times; the stateful operator must not run for each reading."""
    plans, whole = [], stream.restore_segments
    monkeypatch.setattr(stream, "restore_segments", lambda pieces, maps: plans.append(pieces._jdf.queryExecution().toString()) or whole(pieces, maps))
    schema = "scope string, stream_id string, seq long, chunk string, is_last boolean"
    spark.createDataFrame([("s", "a", 0, "to <EMA", False), ("s", "a", 1, "IL_001> now", True)], schema).write.parquet(f"{tmp_path}/in")
    maps = spark.createDataFrame([("s", "EMAIL", 1, "a@example.com", "a@example.com")], "scope string, type string, idx int, identity string, value string")
    stream.restore_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), maps, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert "".join(r["text"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()) == "to a@example.com now"
    assert plans and not any("WithState" in p for p in plans)


def test_regions_are_whole_sentences_in_one_walk(spark, meeting):
    import re

    from veilframe.functions.scripts import BOUNDARIES, RANGES, regions

    texts = ["", ".", "です", "です。", "a です. b; 漢字！c", "。。です\n\nab cd: です」", "абв. abc です? ١ ﷐です", "x" * 3000 + ". " + "のa" * 2000 + "!" + "y. " * 3000, "漢。" * 500 + "no end"]
    ends = "[" + re.escape(BOUNDARIES) + "]"
    for scripts in (("kana",), ("han",), ("kana", "han"), ("latin",), ("arabic", "cyrillic")):
        df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", regions(F.col("t"), *scripts).alias("r"))
        for t, r in df.collect():
            want, at = [], 0
            for s in re.split(ends, t or ""):
                if any(a <= ord(c) <= b for c in s for k in scripts for a, b in RANGES[k]):
                    want.append((at, at + len(s)))
                at += len(s) + 1
            assert [(x["start"], x["end"]) for x in r] == want
    plan = QUERIES["script_regions"](spark, meeting)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(regexp_replace(") <= 3  # five walks before: kana, han, either, two of them twice


def test_script_tables_are_asked_beyond_ascii_only(spark):
    from veilframe.functions.spans import beyond_ascii, spans
    from veilframe.operators.rules import PACKS, rules_for

    every = "".join(chr(c) for c in [*range(0x20, 0x3400), *range(0x4E00, 0x4F00), *range(0xF900, 0xFFF0), 0x20000] if c not in (0xFDD0, 0xFDD1))
    df = spark.createDataFrame([(every,)], "t string")
    for p in (r"\p{IsHan}", r"[^\p{IsHan}a]", r"[\p{IsHiragana}\p{IsKatakana}ーA-Z]", r"(?<!\p{IsHan})\p{IsKatakana}", PACKS["ja"][1]):
        assert "&&" in beyond_ascii(p)
        old, new = df.select(F.regexp_extract_all("t", F.lit(p), F.lit(0)), F.transform(spans(F.col("t"), p), lambda x: x["value"])).first()
        assert old == new
    assert all(r"\p{Is" not in beyond_ascii(r.pattern).replace(r"&&\p{Is", "") for r in rules_for())
