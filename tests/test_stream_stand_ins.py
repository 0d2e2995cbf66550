"""Streamed stand-ins: whatever the cuts, what is found in the pieces is what is found in the whole."""

import random
import re
from pathlib import Path

import pytest

from veilframe.functions.intervals import IntervalSet
from veilframe.functions.shared import scratch, shared_folder
from veilframe.operators import restore as batch
from veilframe.operators.restore import restore, surface_literals
from veilframe.streaming import restore as stream
from veilframe.streaming.restore import cut, restore_stream

SURFACES = ("Avery Lane Hale", "contact12@example.com", "contact1@example.com", "Avery Lane", "Lane Doe", "5 Elm", "青山 仁", "仁子", "+1 555 0100", "x <A")
PARTS = ["Avery", "avery", "LANE", "Lane", "Hale", "Doe", "contact1", "contact12", "@example.com", ".", "com", " ", "\n", "\r\n", "青山", "仁", "子", "+1", "555", "0100", "<PERSON_001>", "PERSON", "_", "001", "5", "Elm", "x", "<A", "<", "s", "é", "  ", ", "]
TOKEN = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9]{0,62}[ \t]{0,4}[\s_-][ \t]{0,4}[0-9]{1,6}(?![A-Za-z0-9])")


def found(text):
    return sorted((a, b) for a, b, _ in surface_literals(SURFACES).claimed(text, IntervalSet(m.span() for m in TOKEN.finditer(text))))


@pytest.mark.parametrize("seed", range(4))
def test_random_cuts(seed):
    r = random.Random(seed)
    for _ in range(5000):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(1, 30)))
        at, context, held, pieces, got = 0, "", "", [], []
        while at < len(text):
            size = r.randint(1, r.choice([1, 3, 8, 30]))
            before, chunk = context, text[at : at + size]
            at += size
            context, held, out = cut(context, held, chunk, at >= len(text), SURFACES)
            lead = "" if before == "" else "0" if re.match("[A-Za-z0-9]", before) else " "
            got += [(a - len(lead) + sum(map(len, pieces)), b - len(lead) + sum(map(len, pieces))) for a, b in found(lead + out)]
            pieces.append(out)
        assert "".join(pieces) == text and sorted(got) == found(text), text


def test_what_may_still_grow_is_bounded():
    context, held, _ = cut("", "", "Avery", False, SURFACES)
    assert held == "Avery"
    context, held, out = cut(context, held, " " * 100, False, SURFACES)
    assert out.startswith("Avery") and len(held) < 20  # no name goes on behind so many blanks
    assert cut("", "", "Dear Avery La", False, SURFACES)[2] == "Dear "
    assert cut("", "", "Dear Avery La", False)[1] == "La"  # without stand-ins only tokens are waited for


def test_stream_equals_batch(spark):
    maps = spark.createDataFrame([("s", "PERSON", 1, "i", "Jane Roe", "Avery Lane"), ("s", "EMAIL", 1, "j", "a@b.org", "contact1@example.com"), ("t", "PERSON", 1, "k", "Bo", "Rowan Hale")], "scope string, type string, idx int, identity string, value string, surface string")
    texts = {("s", "1"): "Dear Avery Lane, hello avery\nlane <PERSON_001> contact1@example.com.", ("s", "2"): "contact1@example.comx Avery  LANE", ("t", "3"): "Avery Lane and Rowan Hale", ("u", "4"): "Rowan Hale", ("s", "5"): ""}
    r, rows = random.Random(5), []
    for (scope, stream), text in texts.items():
        at = seq = 0
        while at < len(text) or not seq:
            size = r.randint(1, 6)
            rows.append((scope, stream, seq, text[at : at + size], at + size >= len(text)))
            at, seq = at + size, seq + 1
    source, out, checkpoint = (scratch(spark, x) for x in ("chunks", "restored", "stream"))
    schema = "scope string, stream_id string, seq long, chunk string, is_last boolean"
    for part in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):  # two micro-batches and a restart between them
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        restore_stream(spark.readStream.schema(schema).parquet(source), maps, out, checkpoint).awaitTermination()
    got = {}
    for row in sorted(spark.read.parquet(out).collect(), key=lambda x: x["seq"]):
        got[row["scope"], row["stream_id"]] = got.get((row["scope"], row["stream_id"]), "") + row["text"]
    batch = restore(spark.createDataFrame([(s, i, t) for (s, i), t in texts.items()], "scope string, response_id string, text string"), maps).collect()
    assert got == {(x["scope"], x["response_id"]): x["restored_text"] for x in batch}
    assert got["s", "1"] == "Dear Jane Roe, hello Jane Roe Jane Roe a@b.org."


def test_a_chunk_of_prose_is_looked_at_where_a_token_may_begin(monkeypatch):
    """Only beginnings that reach the end are followed, and what is held is what following each of them gives."""
    asked, follow = [], stream._open
    monkeypatch.setattr(stream, "_open", lambda *x: asked.append(x[1]) or follow(*x))
    assert cut("", "", "some words, 12 of them - without any token in them <and> no more of " * 8, False)[1] == "of "
    assert len(asked) <= 2  # every word of the last 266 characters before
    monkeypatch.undo()
    r = random.Random(9)
    for _ in range(5000):
        view = "".join(r.choice([*PARTS, "-", "[", "]", ">", "\t", "\v", "12345678", "a_b"]) for _ in range(r.randint(1, 40)))
        last = r.randint(0, len(view))
        open_ = [m.start() for m in stream._STARTS.finditer(view, max(0, last - stream.HOLD), last) if follow(view, m.start(), last)]
        assert stream._token_from(view, None, last) == min([*open_, last])


def test_streams_share_keys_of_state_and_leave_nothing_behind(spark, monkeypatch):
    """300 streams over three batches, with two keys of state and more scopes than tasks hold: each comes back, one begins again after its end."""
    monkeypatch.setattr(stream, "KEYS", 2)
    monkeypatch.setattr(batch, "FEW_SCOPES", 3)
    maps = spark.createDataFrame([(f"s{k}", "PERSON", 1, "i", f"Jane {k}", "Avery Lane") for k in range(9)], "scope string, type string, idx int, identity string, value string, surface string")
    text = "Dear Avery Lane, <PERSON_001>, avery\nlane."
    rows = [[(None if k == 7 else f"s{k % 10}", str(k), part, text[part * 16 : part * 16 + 16], part == 2) for k in range(300)] for part in range(3)]
    rows[2].append(("s1", "1", 3, "Avery Lane", True))
    source, out, checkpoint = (scratch(spark, x) for x in ("chunks", "restored", "stream"))
    kept = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file://")).rglob("*") if p.name.startswith(("rdd-", "pieces"))}
    schema, before = "scope string, stream_id string, seq long, chunk string, is_last boolean", kept()
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = restore_stream(spark.readStream.schema(schema).parquet(source), maps, out, checkpoint)
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 0 and kept() == before
    got = {}
    for row in sorted(spark.read.parquet(out).collect(), key=lambda x: x["seq"]):
        got[row["stream_id"]] = got.get(row["stream_id"], "") + row["text"]
    name = lambda k: None if k == 7 or k % 10 == 9 else f"Jane {k % 10}"
    want = {str(k): text if name(k) is None else f"Dear {name(k)}, {name(k)}, {name(k)}." for k in range(300)}
    want["1"] += "Jane 1"
    assert got == want


def test_texts_without_numbers_meet_no_token(spark):
    """They are neither folded nor joined; digits that only folding shows count, and so do separators."""
    maps = spark.createDataFrame([("s", "EMAIL", 1, "j", "a@b.org")], "scope string, type string, idx int, identity string, value string")
    texts = ["EMAIL 1", "EMAIL 1", "EMAIL_¹", "EMAIL_１", "ＥＭＡＩＬ＿1", "EMAIL\v\t 1", "EMAIL①", "EMAIL ①", "email -\t001", "EMAIL", "é EMAIL", "EMAIL1", "", None, "<EMAIL_001>", "EMAIL ½"]
    df = restore(spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "scope string, response_id long, text string"), maps)
    got = {r["response_id"]: r["restored_text"] for r in df.collect()}
    assert [k for k, t in enumerate(texts) if got[k] != (t or "")] == [0, 1, 2, 3, 4, 5, 7, 8, 14, 15]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan
