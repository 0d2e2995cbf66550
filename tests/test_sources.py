"""Mappings at rest, audit lines, corrections, answers, datasets and file scans."""

import json

import pytest
from pyspark.sql import functions as F

from veilframe.operators import privacy as P
from veilframe.operators.rules import rules_for
from veilframe.sources import mappings as M

MAPS = "scope string, type string, idx int, identity string, value string"


def rows(spark):
    return spark.createDataFrame([("a", "EMAIL", 1, "x@example.com", "x@example.com"), ("b", "PERSON", 12, "Ann Lee", "Ann  Lee")], MAPS)


def test_sealed_and_plain(spark):
    key, other = F.lit(b"k" * 32), F.lit(b"o" * 32)
    sealed = M.seal(rows(spark), key).cache()
    assert sorted(map(tuple, M.unseal(sealed, key).collect())) == sorted(map(tuple, rows(spark).collect()))
    for bad in (M.unseal(sealed, other), M.unseal(sealed.withColumn("scope", F.lit("b")), key), M.unseal(sealed.withColumn("payload", F.reverse("payload")), key)):
        with pytest.raises(Exception, match="can't be read"):
            bad.collect()
    assert sorted(map(tuple, M.import_lines(M.export_lines(rows(spark))).collect())) == sorted(map(tuple, rows(spark).collect()))
    with pytest.raises(Exception, match="can't be read"):
        M.import_lines(M.export_lines(rows(spark)).select(F.replace("value", F.lit("<EMAIL"), F.lit("<PHONE")).alias("value"))).collect()


def test_audit_refuses_other_records(spark):
    good = spark.createDataFrame([("a", '{"contract":"protection-scope/1"}')], "scope string, record string")
    assert json.loads(M.audit_lines(good, "now").first()["value"])["record"]["contract"] == "protection-scope/1"
    with pytest.raises(Exception, match="audited"):
        M.audit_lines(good.withColumn("record", F.lit("{}")), "now").collect()


def test_rulings(spark):
    log = [(1, "ann", "NEVER", None), (2, "ann", "ALWAYS", "PERSON"), (3, "x", "NEVER", None), (4, "key", "NEVER", "API_KEY"), (5, "bob", "ALWAYS", "NOPE"), (6, "carl", "NEVER", "PERSON")]
    assert M.hand_rulings(spark.createDataFrame(log, "seq long, value string, verdict string, entity_type string")) == (("carl",), [("ann", "PERSON")])


def test_answers(spark):
    text = "Ann met Ann and Bob."
    raws = [
        '{"entities": [{"type": "name", "value": "Ann", "start": 0}, {"type": "PERSON", "value": "Eve"}]}', 'Here:\n```json\n{"entities": [{"type": "PERSON", "value": "Ann"}]}\n```',
        "sorry", '{"entities": [{"type": "PERSON", "value": "Bob", "start": 3}]}', None, '{"entities": []}',
    ]
    got = M.parse_answers(spark.createDataFrame([("s", k, text, r) for k, r in enumerate(raws)], "scope string, turn long, text string, raw string")).orderBy("turn").collect()
    places = [[(d["start"], d["end"], d["type"]) for d in r["dets"]] if r["dets"] is not None else None for r in got]
    assert places == [[(0, 3, "PERSON")], [(0, 3, "PERSON"), (8, 11, "PERSON")], None, [(16, 19, "PERSON")], None, []]
    assert [r["unparsable"] for r in got] == [False, False, True, False, True, False] and [r["rejected"] for r in got] == [1, 0, 0, 0, 0, 0]


def test_datasets(spark, tmp_path):
    body = {"format_version": 1, "name": "d", "locale": "en", "samples": [{"id": "1", "annotated": "to [[EMAIL:a@b.c]]"}, {"id": "2", "annotated": "none"}]}
    (tmp_path / "d.json").write_text(json.dumps(body))
    got = {r["sample_id"]: (r["text"], [tuple(g) for g in r["gold"]]) for r in M.read_datasets(spark, str(tmp_path)).collect()}
    assert got == {"1": ("to a@b.c", [("EMAIL", 3, 8, False)]), "2": ("none", [])}
    (tmp_path / "d.json").write_text(json.dumps(body | {"samples": [body["samples"][0]] * 2}))
    with pytest.raises(ValueError, match="repeats"):
        M.read_datasets(spark, str(tmp_path))
    (tmp_path / "d.json").write_text(json.dumps(body | {"format_version": 2}))
    with pytest.raises(Exception, match="can't be read"):
        M.read_datasets(spark, str(tmp_path)).collect()


def test_files(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\nmail = 'ann@example.com'\n")
    (tmp_path / "b.bin2").write_bytes(b"ab\0cd")
    (tmp_path / "c.png").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "e.txt").write_text("x" * 2000)
    (tmp_path / "f.log").write_text("bob@example.org")
    (tmp_path / "g.txt").write_bytes(b"\x10\x02 fine")
    (tmp_path / "empty").write_text("")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.js").write_text("y")
    scanned = M.files(spark, str(tmp_path), exclude=("*.log",), max_bytes=1000).cache()
    why = {r["path"].rsplit("/", 1)[1]: r["skip_reason"] for r in scanned.collect()}
    assert why == {"a.py": None, "b.bin2": "binary", "c.png": "suffix", "d.txt": "encoding", "e.txt": "size", "f.log": "excluded", "g.txt": None, "x.js": "directory"}
    found = M.lint(scanned, lambda t: P.detect(t, rules_for(("universal",))), ("EMAIL",)).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["line"], r["type"], r["preview"]) for r in found] == [("a.py", 2, "EMAIL", "a" + "*" * 14)]
