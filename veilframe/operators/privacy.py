"""Detection passes, resolution of overlaps and policy decisions, as column expressions over (scope, turn, text).

Everything up to the decision is one pass over a row and shuffles nothing.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from veilframe.functions.checks import VALIDATORS, preview
from veilframe.functions.intervals import FOUND, NUMBERS, IntervalSet, clear, let, places_with, settled_overlaps
from veilframe.functions.literals import Literals
from veilframe.functions.normalize import normalized, original_end, original_start
from veilframe.functions.scripts import class_of, everywhere, regions
from veilframe.functions.spans import SPAN, beyond_ascii, marked, overlap, ready, spans, spans_marked, unmarked

from .rules import ENTITY_TYPES, PACKS, SIGNS, Rule, rules_for

DETS = "array<struct<start:int,end:int,type:string,value:string,confidence:double,source:string,rule:string,severity:int,category:string>>"
PLACEHOLDER = r"<(?:{})_[0-9]{{3,6}}>".format("|".join(ENTITY_TYPES))


@dataclass(frozen=True)
class Policy:
    """Action of a type, else of its category, else the default.  Copies keep every field."""

    rules: dict[str, str] = field(default_factory=lambda: {"TEXT": "anonymize"})
    category_defaults: dict[str, str] = field(default_factory=lambda: {"SECRET": "block", "PII": "anonymize", "COMPANY_CONFIDENTIAL": "anonymize", "BUSINESS_SENSITIVE": "anonymize", "INTERNAL": "anonymize", "OTHER": "block"})
    default_action: str = "block"
    mask_token: str = "[REDACTED]"
    min_confidence: float = 0.0
    uncertain: str = "discard"

    @classmethod
    def permissive(cls) -> "Policy":
        """Everything is anonymized, nothing blocked."""
        return cls(rules={}, category_defaults={}, default_action="anonymize")

    def actions(self) -> dict[str, str]:
        return {t: self.rules.get(t, self.category_defaults.get(c, self.default_action)) for t, (_, c) in ENTITY_TYPES.items()}

    def digest(self) -> str:
        """SHA-256 of the settings as canonical JSON: equal policies, equal digests."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _none() -> Column:
    return F.array().cast(DETS)


def detection(span: Column, kind: str | Column, confidence: float | Column, source: str, rule: str | Column, severity: Column | None = None, category: Column | None = None) -> Column:
    """A span as one detection; severity and category are those of the type unless given."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    if isinstance(kind, str):
        severity, category = map(F.lit, ENTITY_TYPES[kind])
    return F.struct(span["start"], span["end"], col(kind).alias("type"), span["value"], col(confidence).cast("double").alias("confidence"), F.lit(source).alias("source"), col(rule).alias("rule"), severity.alias("severity"), category.alias("category"))


RULE = "array<struct<type:string,confidence:double,pack:string,id:string,severity:int,category:string,validator:string>>"


def signs_of(text: Column) -> Column:
    """What a text holds of the characters that rules name as ``signs``: in most texts nothing.  Scripts that packs ask for are among them."""
    return F.regexp_replace(text, "[^{}\\x{{2E80}}-\\x{{10FFFF}}]+".format("".join(rf"\x{{{ord(c):X}}}" for c in SIGNS)), "")


def _may(rule: Rule, text: Column, low: Column, run: Column, signs: Column) -> Column:
    """Whether a text can hold a hit of a rule: what it needs is there, and it matches at all, which in most texts it doesn't."""
    may = run >= rule.digits if rule.digits else F.lit(True)
    if rule.signs:
        may = may & signs.rlike("[{}]".format("".join(rf"\x{{{ord(c):X}}}" for c in rule.signs)))
    if rule.need:
        some = [low.contains(n) for n in ((rule.need,) if isinstance(rule.need, str) else rule.need)]
        may = may & functools.reduce(lambda a, b: a | b, some)
    if rule.exact:
        may = may & functools.reduce(lambda a, b: a | b, [text.contains(n) for n in rule.exact])
    if rule.gate:
        may = may & text.rlike(rule.gate)
    return may & text.rlike(ready(rule.pattern))


def rules_hits(text: Column, rules: list[Rule], low: Column | None = None, run: Column | None = None, signs: Column | None = None) -> Column:
    """array of detections of rules in an ``unmarked`` text, in their order; ``low`` is it in lower case, ``run`` its longest run of digits,
    ``signs`` its ``signs_of``.

    A copy of the text is marked for each rule that matches; places, checks and detections are worked out of those.
    """
    low, run, signs = F.lower(text) if low is None else low, longest_digits(text) if run is None else run, signs_of(text) if signs is None else signs
    matched = F.array(*(F.when(_may(r, text, low, run, signs), F.struct(F.lit(k).alias("k"), marked(text, r.pattern, r.grouped).alias("text"))) for k, r in enumerate(rules)))
    about = F.from_json(F.lit(json.dumps([{"type": r.type, "confidence": float(r.confidence), "pack": r.pack, "id": r.id, "severity": ENTITY_TYPES[r.type][0], "category": ENTITY_TYPES[r.type][1], "validator": r.validator} for r in rules])), RULE)
    checks = sorted({r.validator for r in rules if r.validator})

    def one(x: Column) -> Column:
        rule, hits = F.get(about, x["k"]), spans_marked(x["text"])
        if checks:
            right = lambda v: functools.reduce(lambda c, n: c.when(rule["validator"] == n, VALIDATORS[n](v)), checks, F.when(rule["validator"].isNull(), True))
            hits = F.filter(hits, lambda h: right(h["value"]))
        return F.transform(hits, lambda h: F.struct(h["start"], h["end"], rule["type"], h["value"], rule["confidence"], rule["pack"].alias("source"), rule["id"].alias("rule"), rule["severity"], rule["category"]))

    return F.flatten(F.transform(F.filter(matched, lambda x: x.isNotNull()), one)).cast(DETS)


def rule_hits(text: Column, rule: Rule, low: Column | None = None, run: Column | None = None, signs: Column | None = None) -> Column:
    """array of detections of one rule."""
    return rules_hits(text, [rule], low, run, signs)


def longest_digits(text: Column) -> Column:
    return F.array_max(F.transform(F.split(text, "[^0-9]+"), lambda x: F.length(x)))


def pack_hits(text: Column, rules: list[Rule], name: str, low: Column | None = None, run: Column | None = None, signs: Column | None = None) -> Column | None:
    """All hits of a pack's rules in texts that hold its scripts; None where none of the rules is of the pack."""
    trigger = PACKS[name][1] if name in PACKS else None
    own = [r for r in rules if r.pack == name]
    if not own:
        return None
    signs = signs_of(text) if signs is None else signs
    hits = rules_hits(text, own, low, run, signs)
    held = signs if trigger and r"\p{Is" in trigger else text  # CJK scripts begin beyond U+2E80
    return hits if trigger is None else F.when(held.rlike(beyond_ascii(trigger)), hits).otherwise(_none())


def literal_placeholders(text: Column) -> Column:
    """Token-shaped input is itself to be replaced, so it can't pass for one of ours."""
    return F.when(text.contains("_"), F.transform(spans(text, PLACEHOLDER), lambda x: detection(x, "TEXT", 1.0, "literal", "literal.TEXT"))).otherwise(_none())


@functools.lru_cache(maxsize=64)
def _built(rules: tuple[Rule, ...], name: str, session: object) -> Column | None:
    """``pack_hits`` over the columns that ``detect`` prepares; building it for many rules takes the driver some seconds."""
    return pack_hits(F.col("_plain"), list(rules), name, F.col("_low"), F.col("_run"), F.col("_signs"))


def _ruled_hits(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """df with ``_hits``: all hits of the rules, overlapping or not.

    Where a script silences a pack, hits that touch a sentence with that script are dropped, all of them where such
    sentences are the whole text.
    """
    text, parts = F.col("_text"), []
    for name, (_, _, silencer) in {**PACKS, "custom": ((), None, None)}.items():
        hits = _built(rules, name, df.sparkSession)
        if hits is None:
            continue
        if silencer:
            own, silent = F.col(f"_{name}"), F.col(f"_not_{name}")
            df = df.withColumn(f"_{name}", hits).withColumn(f"_not_{name}", F.when((F.size(own) > 0) & text.rlike(class_of(*silencer)), regions(text, *silencer)))
            kept = F.when(everywhere(silent, text), _none()).otherwise(unclaimed(own, F.coalesce(silent, F.array().cast(SPAN))))
            df = df.withColumn(f"_{name}", kept).drop(f"_not_{name}")
            hits = own
        parts.append(hits)
    hits = F.coalesce(F.concat(*parts), _none()) if parts else _none()
    return df.withColumn("_hits", hits).drop(*(f"_{n}" for n in PACKS))


#: Bound on values ruled in by hand: an automaton over so many is held by every task that looks for them.
MOST_RULINGS = 100_000


def _places(dets: Column) -> Column:
    return F.transform(dets, lambda d: F.struct(d["start"].alias("start"), d["end"].alias("end")))


def _span(text: Column, o: Column) -> Column:
    return F.struct(o["start"].alias("start"), o["end"].alias("end"), text.substr(o["start"] + 1, o["end"] - o["start"]).alias("value"))


def _taken(places) -> IntervalSet:
    return IntervalSet((p["start"], p["end"]) for p in places) if places is not None else IntervalSet()


@F.pandas_udf(FOUND)
def _find_seeds(text: pd.Series, seeds: pd.Series, taken: pd.Series) -> pd.Series:
    def one(t, names, claims):
        if t is None or names is None:
            return None
        order = sorted(range(len(names)), key=lambda k: (-len(names[k]["value"]), names[k]["start"]))
        first: dict[str, int] = {}
        for k in order:
            first.setdefault(names[k]["value"], k)
        which = list(first.values())
        return [(a, b, which[k]) for a, b, k in Literals(first).claimed(t, _taken(claims))]

    return pd.Series([one(*x) for x in zip(text, seeds, taken)], dtype=object)


@F.pandas_udf(NUMBERS)
def _free(places: pd.Series, taken: pd.Series) -> pd.Series:
    def one(spans, claims):
        if spans is None:
            return None
        held = _taken(claims)
        return [k for k, x in enumerate(spans) if not held.overlaps(x["start"], x["end"])]

    return pd.Series([one(*x) for x in zip(places, taken)], dtype=object)


_find_seeds, _free = _find_seeds.asNondeterministic(), _free.asNondeterministic()


def unclaimed(hits: Column, taken: Column) -> Column:
    """Spans of ``hits`` that overlap none of ``taken``; rows where either has none don't leave the JVM."""
    both = (F.size(hits) > 0) & (F.size(taken) > 0)
    free = _free(F.when(both, _places(hits)), F.when(both, _places(taken)))
    return let(F.struct(hits.alias("hits"), free.alias("free")), lambda x: F.when(x["free"].isNull(), x["hits"]).otherwise(F.transform(x["free"], lambda k: F.get(x["hits"], k))))


SEEDS = ("PERSON", "COMPANY_NAME", "PROJECT_NAME", "EMPLOYEE_ID")


def occurrences(text: Column, value: Column, fold_case: bool = False) -> Column:
    """Spans of a literal; where it begins or ends in an ASCII letter or digit, none may touch it there."""
    left = F.when(value.rlike("^[A-Za-z0-9]"), r"(?<![A-Za-z0-9])").otherwise("")
    right = F.when(value.rlike("[A-Za-z0-9]$"), r"(?![A-Za-z0-9])").otherwise("")
    literal = F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    return spans(text, F.concat(F.lit("(?iu)" if fold_case else ""), left, literal, right))


def co_occurrences(text: Column, dets: Column, min_confidence: float = 0.85, min_length: int = 2) -> Column:
    """Occurrences of confident names that nothing claims: the longest names first, then the earliest."""
    seeds = F.filter(dets, lambda d: d["type"].isin(*SEEDS) & (d["confidence"] >= min_confidence) & (F.length(d["value"]) >= min_length))
    asked = F.size(seeds) > 0
    bare = F.transform(seeds, lambda d: F.struct(d["start"].alias("start"), d["value"].alias("value")))
    found = _find_seeds(F.when(asked, text), F.when(asked, bare), F.when(asked, _places(dets)))

    def one(x: Column, o: Column) -> Column:
        s = F.get(x["seeds"], o["k"])
        return detection(_span(text, o), s["type"], s["confidence"], "co_occurrence", F.concat(F.lit("co_occurrence."), s["type"]), s["severity"], s["category"])

    return let(F.struct(seeds.alias("seeds"), found.alias("found")), lambda x: F.when(F.size(x["found"]) > 0, F.transform(x["found"], lambda o: one(x, o))).otherwise(_none()))


def entropy_runs(text: Column) -> Column:
    """Runs of high entropy."""
    return F.filter(spans(text, r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,200}={0,2}(?![A-Za-z0-9+/_=-])"), lambda x: VALIDATORS["high_entropy"](x["value"]))


def entropy_hits(text: Column, runs: Column, taken: Column) -> Column:
    """Runs of high entropy that nothing else claims; a hash word before one lowers its confidence, else a secret word raises it."""
    before = lambda x: F.lower(text.substr(F.greatest(x["start"] - 60, F.lit(0)) + 1, F.least(x["start"], F.lit(60))))
    level = lambda x: F.when(before(x).rlike(r"sha-?[0-9]|md5|checksum|commit|digest|hash"), 0.5).when(before(x).rlike(r"key|token|secret|password|credential"), 0.7).otherwise(0.5)
    return F.transform(unclaimed(runs, taken), lambda x: detection(x, "API_KEY", level(x), "entropy", "entropy.API_KEY"))


def _ruled(always: list[tuple[str, str]]) -> Callable:
    """Looks for all ruled values in one walk over a text, by an automaton built once a task."""

    @F.pandas_udf(places_with("type", StringType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        literals = Literals(v for v, _ in always)
        for texts, taken in batches:
            yield pd.Series([None if t is None else [(s, e, always[k][1]) for s, e, k in literals.claimed(t, _taken(p))] for t, p in zip(texts, taken)], dtype=object)

    return run.asNondeterministic()


@F.pandas_udf(places_with("type", StringType()))
def _ruled_in_row(text: pd.Series, taken: pd.Series, always: pd.Series) -> pd.Series:
    """The same where each text comes with the rulings that it may hold."""

    def one(t, claims, own):
        if t is None or own is None:
            return None
        return [(s, e, own[k]["type"]) for s, e, k in Literals(o["value"] for o in own).claimed(t, _taken(claims))]

    return pd.Series([one(*x) for x in zip(text, taken, always)], dtype=object)


_ruled_in_row = _ruled_in_row.asNondeterministic()


def ruled_in(text: Column, taken: Column, always: list[tuple[str, str]] | Column) -> Column:
    """Unclaimed occurrences of values that were ruled sensitive by hand, each of a known type, as certain.

    Values earlier in the list claim first.  More than ``MOST_RULINGS`` values, and types nobody knows, are errors.
    A column is each text's own list, as ``with_rulings`` makes it.
    """
    if isinstance(always, Column):
        asked = F.size(always) > 0
        types, found = set(ENTITY_TYPES), _ruled_in_row(F.when(asked, text), F.when(asked, _places(taken)), F.when(asked, always)).alias("found")
    else:
        if not always:
            return _none()
        if len(always) > MOST_RULINGS:
            raise ValueError(f"{len(always)} rulings are more than {MOST_RULINGS}; with_rulings takes any number")
        types, found = {k for _, k in always}, _ruled(list(always))(text, _places(taken)).alias("found")
    if unknown := types - set(ENTITY_TYPES):
        raise ValueError(f"unknown types: {sorted(unknown)}")
    kinds = F.create_map(*(x for k in sorted(types) for x in (F.lit(k), F.struct(F.lit(ENTITY_TYPES[k][0]).alias("severity"), F.lit(ENTITY_TYPES[k][1]).alias("category")))))
    one = lambda o: detection(_span(text, o), o["type"], 1.0, "corrections", F.concat(F.lit("corrections."), o["type"]), kinds[o["type"]]["severity"], kinds[o["type"]]["category"])
    return let(found, lambda x: F.when(F.size(x) > 0, F.transform(x, one)).otherwise(_none()))


_WORD = "^[A-Za-z0-9]+"


def with_rulings(texts: DataFrame, rulings: DataFrame, found: DataFrame) -> DataFrame:
    """texts with ``_always`` and ``_never``: of any number of rulings (value, verdict, entity_type) those that a text may hold.

    For ``detect(always=)`` and ``decide(never=)``, which look for them exactly; ``found`` is what rules detect in the
    same texts, for values ruled out.  Values ruled in are joined by how they begin: by their first word, which must
    be a whole word of the text, or else by two characters.  Rulings stay on the executors, whatever their number;
    (scope, turn) is the key of texts.
    """
    always = rulings.where("verdict = 'ALWAYS'").select(F.coalesce(F.nullif(F.regexp_extract("value", _WORD, 0), F.lit("")), F.substring("value", 1, 2)).alias("_key"), F.struct("value", F.col("entity_type").alias("type")).alias("_always"))
    odd = ~F.col("_key").rlike(_WORD)
    low, high, pairs = always.agg(F.min(F.when(~odd, F.length("_key"))), F.max(F.when(~odd, F.length("_key"))), F.max(odd)).first()
    keys = F.filter(F.split("text", "[^A-Za-z0-9]+"), lambda w: F.length(w).between(low, high)) if low else F.array().cast("array<string>")
    if pairs:
        two = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring("text", i, F.lit(2)))
        keys = F.concat(keys, F.when(F.length("text") > 1, F.filter(two, lambda k: ~k.rlike(_WORD))).otherwise(F.array().cast("array<string>")))
    held = texts.select("scope", "turn", F.explode(F.array_distinct(keys)).alias("_key")).join(always, "_key").select("scope", "turn", "_always", F.lit(None).cast("string").alias("_never"))
    out = found.select("scope", "turn", F.explode(F.array_distinct(F.transform("dets", lambda d: d["value"]))).alias("value")).join(rulings.where("verdict = 'NEVER'").select("value"), "value")
    held = held.unionByName(out.select("scope", "turn", F.lit(None).cast(held.schema["_always"].dataType).alias("_always"), F.col("value").alias("_never")))
    held = held.groupBy(F.col("scope").alias("_s"), F.col("turn").alias("_t")).agg(F.array_sort(F.collect_set("_always")).alias("_always"), F.collect_set("_never").alias("_never"))
    return texts.join(held, F.col("scope").eqNullSafe(F.col("_s")) & F.col("turn").eqNullSafe(F.col("_t")), "left").drop("_s", "_t")


def detect(texts: DataFrame, rules: list[Rule] | None = None, normalize: bool = True, co_occurrence: bool = False, secrets: bool = False, always: list[tuple[str, str]] | Column = (), passes: tuple = ()) -> DataFrame:
    """texts with ``dets``: candidates in places and values of the original text.  Null texts have none.

    Passes run in a fixed order, each seeing what the ones before found: rules, co-occurrence, high-entropy
    secrets, those plugged in (``passes``, in their order), values ruled in by hand.  They see the NFKC view; token-shaped literals are looked for in the original.
    """
    rules = rules_for() if rules is None else rules
    df = texts.withColumn("_norm", normalized(F.col("text"))) if normalize else texts
    df = df.withColumn("_text", F.coalesce(F.col("_norm.text"), "text") if normalize else F.col("text"))
    df = df.withColumn("_low", F.lower("_text")).withColumn("_run", longest_digits(F.col("_text")))
    text = F.col("_text")
    df = _ruled_hits(df.withColumn("_plain", unmarked(text)).withColumn("_signs", signs_of(text)), tuple(rules))
    if co_occurrence:
        df = df.withColumn("_hits", F.concat("_hits", F.coalesce(co_occurrences(text, F.col("_hits")), _none())))
    if secrets:
        df = df.withColumn("_runs", entropy_runs(text)).withColumn("_hits", F.concat("_hits", F.coalesce(entropy_hits(text, F.col("_runs"), F.col("_hits")), _none()))).drop("_runs")
    for p in passes:
        df = df.withColumn("_hits", F.concat("_hits", F.coalesce(p.run(text, F.col("_hits")), _none())))
    if isinstance(always, Column) or always:
        df = df.withColumn("_hits", F.concat("_hits", F.coalesce(ruled_in(text, F.col("_hits"), always), _none())))
    back = F.col("_hits")
    if normalize:
        moved = F.transform("_hits", lambda d: d.withField("start", original_start(F.col("_norm"), d["start"])).withField("end", original_end(F.col("_norm"), d["end"])))
        moved = F.transform(moved, lambda d: d.withField("value", F.col("text").substr(d["start"] + 1, d["end"] - d["start"])))
        back = F.when(F.col("_norm.text").isNull(), F.col("_hits")).otherwise(moved)
    return df.withColumn("dets", F.concat(back, F.coalesce(literal_placeholders(F.col("text")), _none()))).drop("_norm", "_text", "_plain", "_signs", "_low", "_run", "_hits")


def ruled_out(d: Column, never: tuple[str, ...] | Column) -> Column:
    """Whether a detection's value was ruled out by hand; a ruling never uncovers a secret."""
    if isinstance(never, Column):
        return F.coalesce(F.array_contains(never, d["value"]), F.lit(False)) & (d["category"] != "SECRET")
    return (d["value"].isin(list(never)) if never else F.lit(False)) & (d["category"] != "SECRET")


def corrected(dets: Column, never: tuple[str, ...] | Column) -> Column:
    """dets without values ruled out by hand."""
    return F.filter(dets, lambda d: ~ruled_out(d, never)) if isinstance(never, Column) or never else dets


def rank_key(d: Column) -> Column:
    """Longer, more severe, more confident, earlier, then source and type by name."""
    return F.struct((-(d["end"] - d["start"])).alias("length"), (-d["severity"]).alias("severity"), (-d["confidence"]).alias("confidence"), d["start"].alias("start"), d["source"].alias("source"), d["type"].alias("type"))


def ranked(dets: Column) -> Column:
    return F.transform(F.array_sort(F.transform(dets, lambda d: F.struct(rank_key(d).alias("key"), d.alias("d")))), lambda k: k["d"])


def resolved(dets: Column) -> Column:
    """Greedy in rank order: a candidate stays unless it overlaps one that stayed.  Losers block nothing."""
    return settled_overlaps(dets)


def disjoint(entities: Column) -> Column:
    """Whether spans are in order and none overlaps the next."""
    return clear(entities)


def trace(detected: DataFrame, policy: Policy, never: tuple[str, ...] | Column = ()) -> DataFrame:
    """A row per candidate and what became of it; for displaced ones who won and by which criterion.  Values leave as previews only."""
    sure = F.filter("dets", lambda d: d["confidence"] >= policy.min_confidence)
    df = detected.withColumn("_kept", ranked(resolved(corrected(sure, never)))).withColumn("d", F.explode("dets"))
    d = F.col("d")
    winner = F.filter("_kept", lambda k: overlap(k, F.col("d")))
    df = df.withColumn("_won", F.get(winner, F.lit(0)))
    w = F.col("_won")
    reason = F.when(w["end"] - w["start"] != d["end"] - d["start"], "length").when(w["severity"] != d["severity"], "severity").when(w["confidence"] != d["confidence"], "confidence").when(w["start"] != d["start"], "start").when(w["source"] != d["source"], "source").otherwise("type")
    outcome = F.when(d["confidence"] < policy.min_confidence, "below_confidence").when(ruled_out(d, never), "corrected_away").when(w == d, "kept").otherwise("displaced")
    df = df.withColumn("outcome", outcome)
    shown = F.when(F.col("outcome") == "displaced", F.struct(w["type"].alias("type"), w["start"].alias("start"), w["end"].alias("end"), reason.alias("reason")))
    return df.select("scope", "turn", d["start"].alias("start"), d["end"].alias("end"), d["type"].alias("type"), preview(d["value"]).alias("preview"), d["source"].alias("source"), d["rule"].alias("rule"), d["confidence"].alias("confidence"), "outcome", shown.alias("winner"))


def stance_gap(texts: DataFrame, packs: tuple[str, ...] = tuple(PACKS), **passes) -> DataFrame:
    """(scope, turn, type, start, rule) of what the recall-first stance finds and the balanced one doesn't."""
    if not passes:  # the balanced stance finds what its rules find of the same hits
        core = [r.id for r in rules_for(packs, "balanced")]
        key = lambda d: F.concat(d["type"], F.lit(":"), d["start"].cast("string"))
        both = detect(texts, rules_for(packs, "recall_first")).withColumn("_wide", F.filter("dets", lambda d: ~d["rule"].isin(core) & (d["source"] != "literal")))
        both = both.where(F.size("_wide") > 0).withColumn("_core", F.transform(F.filter("dets", lambda d: d["rule"].isin(core) | (d["source"] == "literal")), key))
        more = F.filter("_wide", lambda d: ~F.array_contains("_core", key(d)))
        return both.select("scope", "turn", F.explode(more).alias("d")).select("scope", "turn", "d.type", "d.start", "d.rule")
    found = [detect(texts, rules_for(packs, s), **passes).select("scope", "turn", F.explode("dets").alias("d")).select("scope", "turn", "d.type", "d.start", "d.rule") for s in ("recall_first", "balanced")]
    other = found[1].select(F.col("scope").alias("_s"), F.col("turn").alias("_t"), F.col("type").alias("_k"), F.col("start").alias("_p"))
    same = F.col("scope").eqNullSafe(F.col("_s")) & F.col("turn").eqNullSafe(F.col("_t")) & (F.col("type") == F.col("_k")) & (F.col("start") == F.col("_p"))
    return found[0].join(other, same, "left_anti")


def decide(detected: DataFrame, policy: Policy, never: tuple[str, ...] | Column = ()) -> DataFrame:
    """entities with actions, and status: ok, blocked or refused.  Order: floor, corrections, refusal, resolution, policy."""
    confident = F.filter("dets", lambda d: d["confidence"] >= policy.min_confidence)
    action = F.create_map(*[F.lit(x) for pair in policy.actions().items() for x in pair])
    df = detected.withColumn("_unsure", F.exists("dets", lambda d: d["confidence"] < policy.min_confidence) & F.lit(policy.uncertain == "refuse"))
    df = df.withColumn("_kept", resolved(corrected(confident, never)))
    df = df.withColumn("entities", F.transform("_kept", lambda d: d.withField("action", F.coalesce(F.element_at(action, d["type"]), F.lit(policy.default_action)))))
    status = F.when(F.col("_unsure"), "refused").when(F.exists("entities", lambda e: e["action"] == "block"), "blocked").otherwise("ok")
    return df.withColumn("status", status).drop("_unsure", "_kept", "dets")


def quoting_scopes(decided: DataFrame, shortest: int = 3) -> DataFrame:
    """(scope, turn) of texts whose scope's name holds a value that is not allowed to leave."""
    return decided.where(F.exists("entities", lambda e: (e["action"] != "allow") & (F.length(e["value"]) >= shortest) & F.col("scope").contains(e["value"]))).select("scope", "turn")


def inspect(decided: DataFrame) -> DataFrame:
    """(scope, turn, types): sorted distinct types that are not allowed; nothing is allocated."""
    found = F.filter("entities", lambda e: e["action"] != "allow")
    return decided.select("scope", "turn", F.array_sort(F.array_distinct(F.transform(found, lambda e: e["type"]))).alias("types"))


def counts(decided: DataFrame) -> DataFrame:
    """(scope, turn, entities, anonymized, masked_types, reversible, by_type) of each text."""
    df = decided.select("scope", "turn", F.col("entities").alias("_e"))
    of = lambda action: F.filter("_e", lambda e: e["action"] == action)
    df = df.withColumn("_types", F.array_sort(F.array_distinct(F.transform("_e", lambda e: e["type"]))))
    by_type = F.map_from_arrays("_types", F.transform("_types", lambda t: F.size(F.filter("_e", lambda e: e["type"] == t))))
    masked = F.array_sort(F.array_distinct(F.transform(of("mask"), lambda e: e["type"])))
    return df.select("scope", "turn", F.size("_e").alias("entities"), F.size(of("anonymize")).alias("anonymized"), masked.alias("masked_types"), (F.size(masked) == 0).alias("reversible"), by_type.alias("by_type"))


def host_class(host: Column, trusted: tuple[str, ...] = ()) -> Column:
    """same_host, private_network, declared or external, without asking any name server; a numeric last label that is no address is external."""
    h = F.lower(F.regexp_replace(F.regexp_replace(host, "[。．｡]", "."), r"\.$", ""))
    address = h.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    inside = F.when(h.startswith("127."), "same_host").when(VALIDATORS["private_ipv4"](h), "private_network").otherwise("external")
    return F.when(h.isin(*trusted) if trusted else F.lit(False), "declared").when(h.isin("localhost", "::1", "[::1]") | h.endswith(".localhost"), "same_host").when(address, inside).when(h.rlike(r"(?:^|\.)(?:0x[0-9a-f]*|[0-9]+)$"), "external").when(~h.contains(".") | h.rlike(r"\.(?:internal|local|lan|intranet|corp|home\.arpa)$"), "private_network").otherwise("external")


#: Classes of hosts that each boundary lets in.
BOUNDARIES = {"same_host": ("same_host", "declared"), "private_network": ("same_host", "private_network", "declared"), "anywhere": ("same_host", "private_network", "declared", "external")}


def admitted(host: Column, boundary: str = "private_network", trusted: tuple[str, ...] = ()) -> Column:
    """Whether an endpoint on a host may be sent texts that aren't protected yet."""
    if boundary not in BOUNDARIES:
        raise ValueError(f"unknown boundary {boundary!r}; known: {', '.join(BOUNDARIES)}")
    return host_class(host, trusted).isin(*BOUNDARIES[boundary])
