"""Mappings at rest, plain or sealed; audit lines; corrections; answers; labelled datasets; file scans."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


from veilframe.sources.audit import CONTRACTS
from veilframe.operators.evaluate import parse_annotated
from veilframe.operators.mappings import COLUMNS
from veilframe.operators.passes import ALIASES
from veilframe.operators.privacy import MOST_RULINGS, detect, detection, occurrences
from veilframe.operators.restore import parse_token
from veilframe.operators.rules import ENTITY_TYPES, rules_for

SCHEMA = "scope string, type string, idx int, identity string, value string"


def seal(mappings: DataFrame, key: Column) -> DataFrame:
    """(scope, payload): a scope's mappings, scope and format version inside the ciphertext.  The IV is random."""
    row = F.to_json(F.struct(F.lit(1).alias("format_version"), *COLUMNS))
    return mappings.select("scope", F.base64(F.aes_encrypt(row, key, F.lit("GCM"))).alias("payload"))


def unseal(sealed: DataFrame, key: Column) -> DataFrame:
    """Mappings again.  A wrong key, altered data and rows moved to another scope are one and the same error."""
    text = F.try_aes_decrypt(F.unbase64("payload"), key, F.lit("GCM")).cast("string")
    df = sealed.withColumn("m", F.from_json(text, f"format_version int, {SCHEMA}"))
    fine = F.col("m").isNotNull() & (F.col("m.format_version") == 1) & F.col("m.scope").eqNullSafe(F.col("scope"))
    return df.withColumn("m", F.when(fine, F.col("m")).otherwise(F.raise_error(F.lit("mappings can't be read")))).select("m.*").drop("format_version")


def export_lines(mappings: DataFrame) -> DataFrame:
    """(value): one plain JSON line a mapping, to be written where the user asks for plain text; format version 1."""
    token = F.format_string("<%s_%03d>", "type", "idx").alias("placeholder")
    return mappings.select(F.to_json(F.struct(F.lit(1).alias("format_version"), F.lit("plain values: keep this file as safe as they are").alias("warning"), "scope", token, F.col("type").alias("entity_type"), F.col("value").alias("original_value"), F.concat_ws(":", "type", "identity").alias("identity_key"))).alias("value"))


def import_lines(lines: DataFrame) -> DataFrame:
    """Mappings of exported lines; another version, a token that isn't exact or one of another type is an error.

    Allocation on top of them goes on behind their largest number.
    """
    df = lines.withColumn("m", F.from_json("value", "format_version int, scope string, placeholder string, entity_type string, original_value string, identity_key string"))
    df = df.withColumn("t", parse_token(F.col("m.placeholder")))
    fine = (F.col("m.format_version") == 1) & (F.col("t.type") == F.col("m.entity_type")) & F.col("m.original_value").isNotNull() & F.startswith(F.col("m.identity_key"), F.concat("t.type", F.lit(":")))
    df = df.withColumn("t", F.when(F.coalesce(fine, F.lit(False)), F.col("t")).otherwise(F.raise_error(F.lit("mappings can't be read")).cast("struct<type:string,idx:int>")))
    return df.select("m.scope", "t.type", "t.idx", F.col("m.identity_key").substr(F.length("t.type") + 2, F.length("m.identity_key")).alias("identity"), F.col("m.original_value").alias("value"))


def audit_lines(records: DataFrame, at: str) -> DataFrame:
    """(value): one JSON line a record (scope, record), stamped; a record of another contract is refused."""
    known = F.get_json_object("record", "$.contract").isin(*CONTRACTS)
    line = F.concat(F.lit('{"line":"audit-line/1","at":"'), F.lit(at), F.lit('","record":'), F.col("record"), F.lit("}"))
    return records.select(F.when(known, line).otherwise(F.raise_error(F.lit("not a record that is audited"))).alias("value"))


def last_rulings(corrections: DataFrame) -> DataFrame:
    """The last verdict on each value of an append-only log (seq, value, verdict, entity_type): NEVER or ALWAYS.

    Values under two characters, ALWAYS without a known type and NEVER on a secret are no rulings.
    """
    secret = [t for t, (_, c) in ENTITY_TYPES.items() if c == "SECRET"]
    fine = (F.length("value") >= 2) & F.when(F.col("verdict") == "ALWAYS", F.col("entity_type").isin(*ENTITY_TYPES)).otherwise(F.coalesce(~F.col("entity_type").isin(*secret), F.lit(True)))
    return corrections.where(fine).groupBy("value").agg(F.max_by(F.struct("verdict", "entity_type"), "seq").alias("r")).select("value", "r.*")


def append_rulings(corrections: DataFrame, path: str, batch: int) -> int:
    """Appends rulings (seq, value, verdict, entity_type, ...) to the log at ``path``, a folder a batch; the same batch again takes its own place.

    A value that rules find a secret in can't be ruled out, nor one of under two characters be ruled on: such a batch
    is an error and leaves nothing.  Returns how many rulings were appended.
    """
    numbered = corrections.withColumn("scope", F.lit("rulings")).withColumn("turn", F.col("seq")).withColumn("text", F.col("value"))
    secret = F.exists("dets", lambda d: d["category"] == "SECRET")
    seen = detect(numbered, rules_for()).withColumn("_why", F.when(~F.coalesce(F.col("verdict").isin("NEVER", "ALWAYS"), F.lit(False)), "no verdict").when(~F.coalesce(F.length("value") >= 2, F.lit(False)), "no value").when((F.col("verdict") == "NEVER") & secret, "a secret can't be ruled out").when((F.col("verdict") == "ALWAYS") & ~F.coalesce(F.col("entity_type").isin(*ENTITY_TYPES), F.lit(False)), "no type that is known"))
    fine = F.when(F.col("_why").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("ruling: "), "_why")))
    done = Observation()
    seen.withColumn("value", fine).select(*corrections.columns).observe(done, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch}")
    return done.get["n"]


def hand_rulings(corrections: DataFrame) -> tuple[tuple[str, ...], list[tuple[str, str]]]:
    """(values never to hide, (value, type) always to hide), for ``decide`` and ``detect``; more than MOST_RULINGS are an error."""
    rows = last_rulings(corrections).orderBy("value").limit(MOST_RULINGS + 1).collect()
    if len(rows) > MOST_RULINGS:
        raise ValueError("more rulings than a hand-written log has")
    return tuple(r["value"] for r in rows if r["verdict"] == "NEVER"), [(r["value"], r["entity_type"]) for r in rows if r["verdict"] == "ALWAYS"]


def parse_answers(answers: DataFrame) -> DataFrame:
    """(scope, turn, dets, unparsable, rejected) of what a model answered about texts: (scope, turn, text, raw).

    An answer is JSON with ``entities`` of type and value, bare, fenced or inside prose.  A type counts if it exists,
    maybe by another name; a value counts wherever it occurs in the text, at the place told if it is there.  What
    counts not is rejected; an answer without JSON is unparsable.
    """
    inner = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    listed = F.from_json(inner, "struct<entities:array<struct<type:string,value:string,start:int>>>")["entities"]
    names = F.create_map(*[F.lit(x) for pair in {**{t: t for t in ENTITY_TYPES}, **ALIASES}.items() for x in pair])
    severity, category = (F.create_map(*[F.lit(x) for t, v in ENTITY_TYPES.items() for x in (t, v[i])]) for i in (0, 1))
    df = answers.withColumn("_list", listed)

    def places(e: Column) -> Column:
        kind = names[F.upper(F.regexp_replace(e["type"], "[ -]", "_"))]
        there = F.col("text").substr(e["start"] + 1, F.length(e["value"])) == e["value"]
        told = F.array(F.struct(e["start"].alias("start"), (e["start"] + F.length(e["value"])).alias("end"), e["value"].alias("value")))
        where = F.when(F.coalesce(there, F.lit(False)), told).otherwise(occurrences(F.col("text"), e["value"]))
        hits = F.transform(where, lambda o: detection(o, kind, 0.6, "model", F.concat(F.lit("model."), kind), severity[kind], category[kind]))
        return F.when(kind.isNotNull() & (F.length(e["value"]) > 0), hits)

    df = df.withColumn("_hits", F.transform("_list", places))
    lost = F.size(F.filter("_hits", lambda h: F.coalesce(F.size(h) < 1, F.lit(True))))
    kept = F.array_distinct(F.flatten(F.filter("_hits", lambda h: h.isNotNull())))
    empty = F.col("_list").isNull()
    return df.select("scope", "turn", F.when(~empty, kept).alias("dets"), empty.alias("unparsable"), F.when(empty, 0).otherwise(lost).alias("rejected"))


def answer_key(model: Column, system: Column, user: Column) -> Column:
    return F.sha2(F.concat_ws("\0", model, system, user), 256)


def unanswered(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """questions (model, system, user, ...) with ``key``, once each, whose key the cache (key, text) doesn't have."""
    keyed = questions.withColumn("key", answer_key(F.col("model"), F.col("system"), F.col("user")))
    return keyed.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


DATASET = "format_version int, name string, locale string, samples array<struct<id:string,annotated:string,note:string>>"


def read_datasets(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, locale, sample_id, text, gold) of labelled JSON files; other versions, missing texts, broken marks and repeated ids are errors."""
    files_ = spark.read.option("multiLine", "true").option("mode", "FAILFAST").schema(DATASET).json(path)
    rows = files_.withColumn("s", F.explode("samples")).select("format_version", F.col("name").alias("dataset"), "locale", F.col("s.id").alias("sample_id"), F.col("s.annotated").alias("annotated"))
    fine = (F.col("format_version") == 1) & F.col("sample_id").isNotNull() & F.col("annotated").isNotNull()
    rows = rows.withColumn("annotated", F.when(F.coalesce(fine, F.lit(False)), F.col("annotated")).otherwise(F.raise_error(F.lit("dataset can't be read"))))
    twice = rows.groupBy("dataset", "sample_id").count().where("count > 1")
    if twice.limit(1).count():
        raise ValueError("a dataset repeats a sample's id")

    def parse(text: pd.Series) -> pd.DataFrame:
        out = [parse_annotated(t) for t in text]
        return pd.DataFrame({"text": [t for t, _ in out], "gold": [[{"type": g[0], "start": g[1], "end": g[2], "tolerated": g[3]} for g in gold] for _, gold in out]})

    parsed = F.pandas_udf(parse, "text string, gold array<struct<type:string,start:int,end:int,tolerated:boolean>>").asNondeterministic()("annotated")
    return rows.select("dataset", "locale", "sample_id", parsed.alias("p")).select("dataset", "locale", "sample_id", "p.text", "p.gold")


# Folders that hold no text of one's own, and suffixes of files that hold none.
SKIPPED = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", ".tox", ".nox", "dist", "build", "target", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".idea", ".eggs")
SUFFIXES = "png jpg jpeg gif webp ico pdf zip gz bz2 xz 7z tar whl so dll dylib exe bin class jar pyc woff woff2 ttf mp3 mp4 parquet sqlite".split()


def files(spark: SparkSession, path: str, exclude: tuple[str, ...] = (), max_bytes: int = 1_000_000) -> DataFrame:
    """(path, text, skip_reason) of every file below path that isn't empty; binary, large, excluded and tool-made files are named, not read.

    ``exclude`` are patterns with * and ? on the path below ``path`` or on the file's name.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    inside = "/(?:" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")/"
    glob = "|".join("".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() else rf"\{c}" for c in e) for e in exclude)
    reason = F.when(F.col("path").rlike(inside), "directory").when(F.col("path").rlike(rf"(?:^|/)(?:{glob})$") if exclude else F.lit(False), "excluded")
    reason = reason.when(F.col("path").rlike(r"(?i)\.(?:" + "|".join(SUFFIXES) + ")$"), "suffix").when(F.col("length") > max_bytes, "size")
    df = raw.select("path", "content", reason.alias("skip_reason"))
    content = F.when(F.col("skip_reason").isNull(), F.col("content"))
    nul = F.instr(F.hex(F.substring(content, 1, 8192)), "00") > 0  # a cheap hint, then the exact test
    nul = nul & (F.size(F.filter(F.sequence(F.lit(1), F.least(F.length(content), F.lit(8192))), lambda i: F.hex(F.substring(content, i, F.lit(1))) == "00")) > 0)
    text = F.when(F.is_valid_utf8(content), content.cast("string"))
    df = df.withColumn("skip_reason", F.coalesce("skip_reason", F.when((F.length(content) > 0) & F.coalesce(nul, F.lit(False)), "binary").when(~F.is_valid_utf8(content), "encoding")))
    return df.select("path", F.when(F.col("skip_reason").isNull(), text).alias("text"), "skip_reason")


def line_of(text: Column, start: Column) -> Column:
    """1-based line of a place."""
    head = text.substr(F.lit(1), start)
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1


def lint(scanned: DataFrame, detect_texts, types: tuple[str, ...] = ()) -> DataFrame:
    """(path, line, type, preview, rule) of what ``detect_texts`` finds in files (path, text), nothing resolved or decided."""
    from veilframe.functions.checks import preview

    found = detect_texts(scanned.where("skip_reason is null").select(F.lit("files").alias("scope"), F.col("path").alias("turn"), "text")).withColumn("d", F.explode("dets"))
    out = found.select(F.col("turn").alias("path"), line_of(F.col("text"), F.col("d.start")).alias("line"), F.col("d.type").alias("type"), preview(F.col("d.value")).alias("preview"), F.col("d.rule").alias("rule"))
    return out.where(F.col("type").isin(*types)) if types else out


