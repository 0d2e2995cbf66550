"""Passes that are plugged in behind the rules: recognizers, language models, phone numbers, and the registry of such.

A pass takes the text and what is claimed so far and gives detections to add; ``privacy.detect`` runs those it is
handed in their order, over the text the rules saw.  Recognizers and models are made once a worker and asked an Arrow
batch at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from veilframe.functions.intervals import IntervalSet, let, places_with
from veilframe.functions.literals import Literals
from veilframe.functions.spans import spans

from .privacy import ENTITY_TYPES, _none, _places, _span, detection, unclaimed
from .windows import longest_whole, windows


class Pass(Protocol):
    """What is plugged in: a name that detections carry as their source, and what to add."""

    name: str

    def run(self, text: Column, hits: Column) -> Column:
        """array of detections of ``text`` besides ``hits``.  A pass that can't do its work raises, it doesn't find nothing."""


class Recognizer(Protocol):
    """Reads a text and tells (label, start, end, score) of what it recognizes; it has no say in what the value is."""

    def entities(self, text: str) -> Iterable[tuple[str, int, int, float]]: ...


class Provider(Protocol):
    """Answers prompts (system, user), many at once, in their order."""

    def answers(self, prompts: list[tuple[str, str]]) -> list[str]: ...


class ScriptedProvider:
    """A provider that is told what to say: a function of the user's part of a prompt, or answers by their prompts.

    Where neither knows an answer it fails, as a model does that can't be reached.
    """

    def __init__(self, script: Callable[[str], str | None] | dict[str, str]):
        self.script = script.get if isinstance(script, dict) else script

    def answers(self, prompts: list[tuple[str, str]]) -> list[str]:
        said = [self.script(user) for _, user in prompts]
        if None in said:
            raise LookupError("the script has no answer to a prompt")
        return said


# recognizers

#: Labels that recognizers give people, and the types they stand for.
LABELS = {"PERSON": "PERSON", "PER": "PERSON"}


def recognized(text: str, found: Iterable[tuple[str, int, int, float]], labels: dict[str, str], min_score: float, join: bool, taken: IntervalSet) -> list[tuple[int, int, str]]:
    """(start, end, type) of what a recognizer found and nothing claims, the recognizer's own earlier finds included.

    Labels nobody mapped are left out, so are scores below the least.  ``B-`` and ``I-`` before a label are taken off;
    with ``join`` an ``I-`` that follows its like after one blank at most goes on with it.  A place outside the text is
    an error: what told it can't be trusted with the rest.
    """
    parts: list[tuple[int, int, str]] = []
    for label, start, end, score in found:
        if not 0 <= start < end <= len(text):
            raise ValueError("a recognizer told a place outside the text")
        label = label.upper()
        inside, label = label.startswith("I-"), label[2:] if label[:2] in ("B-", "I-") else label
        kind = labels.get(label)
        if kind is None or score < min_score:
            continue
        if join and inside and parts and parts[-1][2] == kind and 0 <= start - parts[-1][1] <= 1 and not text[parts[-1][1] : start].strip():
            parts[-1] = (parts[-1][0], end, kind)
        else:
            parts.append((start, end, kind))
    return [p for p in parts if taken.claim(p[0], p[1])]


def _intervals(places) -> IntervalSet:
    return IntervalSet((p["start"], p["end"]) for p in places) if places is not None else IntervalSet()


def _typed(text: Column, found: Column, source: str, confidence: float) -> Column:
    """Places with types, as detections of a source."""
    kinds = F.create_map(*(x for k, v in ENTITY_TYPES.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("severity"), F.lit(v[1]).alias("category")))))
    one = lambda o: detection(_span(text, o), o["type"], confidence, source, F.concat(F.lit(f"{source}."), o["type"]), kinds[o["type"]]["severity"], kinds[o["type"]]["category"])
    return let(found, lambda x: F.when(F.size(x) > 0, F.transform(x, one)).otherwise(_none()))


class RecognizerPass:
    """What a recognizer sees where nothing is claimed; ``make`` makes it, once a worker.  Its failure fails the query."""

    def __init__(self, make: Callable[[], Recognizer], name: str = "recognizer", labels: dict[str, str] | None = None, min_score: float = 0.0, confidence: float = 0.7, join: bool = False):
        self.labels = {k.upper(): v for k, v in (LABELS if labels is None else labels).items()}
        if unknown := set(self.labels.values()) - set(ENTITY_TYPES):
            raise ValueError(f"unknown types: {sorted(unknown)}")
        if not 0 <= min_score <= 1:
            raise ValueError(f"not a score: {min_score}")
        self.make, self.name, self.min_score, self.confidence, self.join = make, name, min_score, confidence, join

    def run(self, text: Column, hits: Column) -> Column:
        make, labels, least, join = self.make, self.labels, self.min_score, self.join

        @F.pandas_udf(places_with("type", StringType()))
        def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            recognizer = make()
            for texts, taken in batches:
                yield pd.Series([recognized(t, recognizer.entities(t), labels, least, join, _intervals(p)) if t else None for t, p in zip(texts, taken)], dtype=object)

        return _typed(text, find.asNondeterministic()(text, _places(hits)), self.name, self.confidence)


# language models

#: Names that models use for types.
ALIASES = {"NAME": "PERSON", "FULL_NAME": "PERSON", "ORGANIZATION": "COMPANY_NAME", "COMPANY": "COMPANY_NAME", "ORG": "COMPANY_NAME", "EMAIL_ADDRESS": "EMAIL", "PHONE_NUMBER": "PHONE", "TELEPHONE": "PHONE", "LOCATION": "ADDRESS", "DOB": "DATE_OF_BIRTH", "ZIP": "POSTAL_CODE", "ZIP_CODE": "POSTAL_CODE", "CREDIT_CARD_NUMBER": "CREDIT_CARD", "IP_ADDRESS": "INTERNAL_IP", "PROJECT": "PROJECT_NAME", "SECRET": "API_KEY", "TOKEN": "ACCESS_TOKEN"}
SYSTEM = "List the sensitive values of the text as JSON: {\"entities\": [{\"type\": ..., \"value\": ...}]}."


def answered(raw: str | None, text: str) -> tuple[list[tuple[int, int, str]], int] | None:
    """(places with types, how many entities count not) of a model's answer about a text; None for one without JSON.

    An answer is JSON with ``entities``, bare, fenced or inside prose.  A type counts if it exists, maybe by another
    name.  A value counts at the place told if it is there, else wherever it occurs.
    """
    inside = re.search(r"\{.*\}", raw or "", re.S)
    try:
        listed = json.loads(inside[0])["entities"] if inside else None
    except (ValueError, TypeError, KeyError):
        listed = None
    if not isinstance(listed, list):
        return None
    out, lost = [], 0
    for e in listed:
        kind, value = (e.get("type"), e.get("value")) if isinstance(e, dict) else (None, None)
        kind = re.sub("[ -]", "_", kind).upper() if isinstance(kind, str) else ""
        kind = kind if kind in ENTITY_TYPES else ALIASES.get(kind)
        if kind is None or not isinstance(value, str) or not value:
            lost += 1
            continue
        told = e.get("start")
        if isinstance(told, int) and told >= 0 and text[told : told + len(value)] == value:
            places = [(told, told + len(value))]
        else:
            places = [(s, t) for s, t, _ in Literals([value]).claimed(text, IntervalSet())]
        out += [(s, t, kind) for s, t in places]
        lost += not places
    return out, lost


class ModelPass:
    """What a language model finds where nothing is claimed, asked window by window; ``make`` makes it, once a worker.

    All windows of an Arrow batch are asked at once.  Finds move to their places in the text; what two windows share
    counts once.  A model only adds: where it fails or answers no JSON, a text keeps what it had - unless ``require``
    is set, then the query fails.
    """

    def __init__(self, make: Callable[[], Provider], name: str = "model", confidence: float = 0.6, require: bool = False, system: str = SYSTEM, size: int = 8000, overlap: int = 400):
        longest_whole(size, overlap)
        self.make, self.name, self.confidence, self.require, self.system, self.size, self.overlap = make, name, confidence, require, system, size, overlap

    def asked(self, text: Column, hits: Column) -> Column:
        """struct<found: places with types that nothing claims, windows, unparsable, rejected, failed> of a text; null for blank ones."""
        make, require, system, size, overlap = self.make, self.require, self.system, self.size, self.overlap
        kind = StructType([StructField("found", places_with("type", StringType())), *(StructField(n, IntegerType()) for n in ("windows", "unparsable", "rejected")), StructField("failed", BooleanType())])

        @F.pandas_udf(kind)
        def ask(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            provider = make()
            for texts, taken in batches:
                cut = [windows(t, size, overlap) if t and t.strip() else [] for t in texts]
                prompts = [(system, w) for pieces in cut for _, w in pieces]
                try:
                    said = provider.answers(prompts) if prompts else []
                    if len(said) != len(prompts):
                        raise ValueError(f"{len(said)} answers to {len(prompts)} prompts")
                    failed = False
                except Exception:
                    if require:
                        raise
                    said, failed = [None] * len(prompts), True
                rows, at = [], 0
                for pieces, places in zip(cut, taken):
                    if not pieces:
                        rows.append((None, None, None, None, None))
                        continue
                    found, unparsable, rejected = {}, 0, 0
                    for (offset, window), raw in zip(pieces, said[at : at + len(pieces)]):
                        told = answered(raw, window)
                        if told is None:
                            if require:
                                raise ValueError("a model's answer can't be read")
                            unparsable += 1
                            continue
                        found.update(dict.fromkeys((offset + s, offset + e, k) for s, e, k in told[0]))
                        rejected += told[1]
                    at += len(pieces)
                    held = _intervals(places)
                    rows.append(([f for f in found if not held.overlaps(f[0], f[1])], len(pieces), unparsable, rejected, failed))
                yield pd.DataFrame(rows, columns=[f.name for f in kind]).astype({"found": object, "failed": object} | dict.fromkeys(("windows", "unparsable", "rejected"), "Int32"))

        return ask.asNondeterministic()(text, _places(hits))

    def run(self, text: Column, hits: Column) -> Column:
        return _typed(text, self.asked(text, hits)["found"], self.name, self.confidence)


# phone numbers

#: Fixed values, of the public numbering plans: country code, the prefix of calls within the country, how numbers
#: behind it begin and how long they are, and the groups they are written in.
PLANS = {
    "JP": ("81", "0", "[789]0[1-9][0-9]{7}|50[1-9][0-9]{7}|800[0-9]{7}|120[0-9]{6}|[36][0-9]{8}|[1-9][1-9][0-9]{7}", r"(?:\+81[ .-]?|\(?0)(?:[5789]0\)?[ .-]?[0-9]{4}[ .-]?[0-9]{4}|(?:[1-9][1-9]|[36]|120|800)[0-9() .-]*)"),
    "US": ("1", "1?", "[2-9](?:[02-8][0-9]|1[02-9])[2-9](?:[02-9][0-9]|1[02-9])[0-9]{4}", r"(?:\+1[ .-]?|1[ .-])?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}"),
    "GB": ("44", "0", "7[1-57-9][0-9]{8}|2[03489][0-9]{8}|1[1-9][0-9]{7,8}|3[0-9]{9}|80[08][0-9]{6,7}", r"(?:\+44[ .-]?|\(?0)[0-9() .-]*"),
    "CN": ("86", "", "1[3-9][0-9]{9}|0(?:10|2[0-9])[2-9][0-9]{7}|0[3-9][1-9][0-9][2-9][0-9]{6,7}", r"(?:\+86[ .-]?)?(?:1[0-9]{2}[ -]?[0-9]{4}[ -]?[0-9]{4}|\(?0?[0-9]{2,3}\)?[ -]?[0-9]{7,8})"),
}
CANDIDATE = r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{1,5}(?:[ .-]?[0-9]{1,5}){1,5}(?![0-9A-Za-z])"


def plan_patterns(region: str) -> tuple[str, str, str]:
    """What the digits of a region's numbers look like, with its country code and within the country, and how they are written."""
    code, trunk, plan, form = PLANS[region]
    return f"^{code}(?:{plan if trunk else plan.replace('|0', '|')})$", f"^{trunk}(?:{plan})$", f"^(?:{form})$"


class PhonePass:
    """Numbers that a country's plan knows, in candidates of digits that nothing claims; the first region of the list wins.

    With ``strict`` a number must be written with a country code, or with separators.  A plan is a pattern over the
    digits alone: the trie of its area codes, with the length of what follows.
    """

    def __init__(self, regions: tuple[str, ...] = ("JP", "US", "GB", "CN"), strict: bool = False, confidence: float = 0.9, name: str = "phone"):
        if unknown := set(regions) - set(PLANS):
            raise ValueError(f"unknown regions: {sorted(unknown)}; known: {sorted(PLANS)}")
        self.regions, self.strict, self.confidence, self.name = tuple(regions), strict, confidence, name

    def region(self, value: Column) -> Column:
        """The first region whose plan knows a number; null where none does."""
        plus, digits = value.startswith("+"), F.regexp_replace(value, "[^0-9]", "")
        out = F.lit(None).cast("string")
        for r in reversed(self.regions):
            abroad, home, form = plan_patterns(r)
            known = F.when(plus, digits.rlike(abroad)).otherwise(digits.rlike(home)) & value.rlike(form)
            out = F.when(known, r).otherwise(out)
        return F.when(plus | value.rlike("[ .()-]") | F.lit(not self.strict), out)

    def run(self, text: Column, hits: Column) -> Column:
        found = F.filter(spans(text, CANDIDATE), lambda x: self.region(x["value"]).isNotNull())
        dets = F.transform(found, lambda x: detection(x, "PHONE", self.confidence, self.name, F.concat(F.lit(f"{self.name}."), self.region(x["value"]))))
        return F.when(text.rlike("[0-9]{3}"), unclaimed(dets, hits)).otherwise(_none())


# registry

class Algorithms:
    """Passes by name, of one kind.  A name nobody registered is an error, not the default."""

    def __init__(self, kind: str, default: str, makers: dict[str, Callable[..., Iterable[Pass]]]):
        self.kind, self.default, self._makers = kind, default, {}
        for name, make in makers.items():
            self.register(name, make)
        self.passes(default)

    def register(self, name: str, make: Callable[..., Iterable[Pass]]) -> None:
        """Adds a way, or puts it in the place of one of that name; names are words in lower case."""
        if not re.fullmatch("[a-z0-9]+(?:[-_][a-z0-9]+)*", name):
            raise ValueError(f"not a word in lower case: {name!r}")
        self._makers[name] = make

    def available(self) -> tuple[str, ...]:
        """All names, the default first."""
        return (self.default, *sorted(set(self._makers) - {self.default}))

    def passes(self, name: str, **settings) -> tuple[Pass, ...]:
        if name not in self._makers:
            raise ValueError(f"unknown {self.kind} algorithm {name!r}; available: {', '.join(self.available())}")
        return tuple(self._makers[name](**settings))


#: What recognizes names behind the rules: nothing, unless something is registered.
RECOGNIZERS = Algorithms("recognizer", "patterns", {"patterns": lambda: ()})
#: What looks for phone numbers behind the rules.
PHONES = Algorithms("phone", "patterns", {"patterns": lambda: (), "plans": lambda **settings: (PhonePass(**settings),)})
MODELS = Algorithms("model", "none", {"none": lambda: (), "scripted": lambda script, **settings: (ModelPass(lambda: ScriptedProvider(script), **settings),)})
