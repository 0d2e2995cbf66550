"""All matches of a pattern with their places, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"
#: Noncharacters that mark where a match begins and ends; in a text they stand for their neighbours.
_MARKS, _OTHERS = "\ufdd0\ufdd1", "\ufdd2\ufdd3"


def beyond_ascii(pattern: str) -> str:
    """The same pattern, in which only characters beyond ASCII are looked up in the tables of CJK scripts, which hold no other."""
    return re.sub(r"\\p\{Is(?:Han|Hiragana|Katakana)\}", lambda m: rf"[\x{{80}}-\x{{10FFFF}}&&{m[0]}]", pattern)


_BEHIND = re.compile(r"(\(\?i\))?\(\?<!(\[[^\]\\]+\])\)([A-Z0-9]|\[[A-Z0-9-]+\])(\{(\d+),?(\d*)\})?(?![*+?])")


def seen_first(pattern: str) -> str:
    """The same pattern, in which a rare character is asked for before what may not stand before it, not the other way round."""
    m = _BEHIND.match(pattern)
    if m is None or m[4] and (m[5] == "0" or "," in m[4] and not m[6]):
        return pattern
    few, many = int(m[5] or 1) - 1, int(m[6] or m[5] or 1) - 1
    rest = f"{m[3]}{{{few},{many}}}" if many else ""
    return f"{m[1] or ''}{m[3]}(?<!{m[2]}{m[3]}){rest}{pattern[m.end():]}"


def ready(pattern: str) -> str:
    """A pattern as it is run: it finds the same at less cost."""
    return seen_first(beyond_ascii(pattern))


def unmarked(text: Column) -> Column:
    """text in which the marks' neighbours stand for the marks: what ``spans`` walks over."""
    return F.when(text.contains(_MARKS[0]) | text.contains(_MARKS[1]), F.translate(text, _MARKS, _OTHERS)).otherwise(text)


def marked(plain: Column, pattern: str | Column, grouped: bool = False) -> Column:
    """An ``unmarked`` text with marks around every match."""
    rx = F.lit(ready(pattern)) if isinstance(pattern, str) else pattern
    return F.regexp_replace(plain, rx, F.lit(f"$1{_MARKS[0]}$2{_MARKS[1]}" if grouped else f"{_MARKS[0]}$0{_MARKS[1]}"))


def spans_marked(text: Column) -> Column:
    """What stands between marks, with its places in the text without them: one fold over the pieces adds up their lengths."""
    fold = F.aggregate(  # before, value, before, value, ..., rest
        F.split(text, f"[{_MARKS}]", -1),
        F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(SPAN).alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x)).alias("at"),
            (~acc["inside"]).alias("inside"),
            F.when(acc["inside"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x)).alias("end"), x.alias("value"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.contains(_MARKS[0]), fold).otherwise(F.array().cast(SPAN))


def spans(text: Column, pattern: str | Column, grouped: bool = False) -> Column:
    """Half-open code-point spans of every match, in order.

    ``grouped`` patterns are ``(prefix)(value)``: the span is the second group's.  One walk marks the matches, one
    fold over the pieces between marks adds up their lengths; texts without a match skip the fold.  Patterns must
    not match the empty string and look ahead rather than consume behind the value.  Null text has no spans.
    """
    return F.transform(F.array(marked(unmarked(text), pattern, grouped)), spans_marked)[0]


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def splice(text: Column, cuts: Column) -> Column:
    """text with each of the ordered, disjoint ``cuts`` (start, end, shown) put in its place."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(cuts, start, lambda a, c: F.struct(c["end"].alias("at"), F.concat(a["out"], text.substr(a["at"] + 1, c["start"] - a["at"]), c["shown"]).alias("out")))
    return F.concat(done["out"], text.substr(done["at"] + 1, F.length(text)))
