"""Restoring streamed replies: keyed state cuts them where no token can lie, the batch operator restores the pieces."""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilframe.functions.literals import GAP, combining_from, gaps_fit
from veilframe.functions.normalize import fold_text
from veilframe.functions.shared import removed, scratch
from veilframe.operators.restore import BLANKS, DIGITS, NAME, PART, PARTS, beside_scope, restore, scope_surfaces, surface_literals, surface_names

#: Fixed value: characters of the folded text that may be held back, for no token is longer.
HOLD = 266
#: Fixed value, part of the state: keys of state that streams are dealt over.  Calling Python for a key costs milliseconds.
KEYS = 4096


_STARTS = re.compile(r"[<\[{]|(?<![A-Za-z0-9])[A-Za-z]")


@functools.cache
def _some(chars: str, most: int) -> re.Pattern[str]:
    return re.compile(rf"[{chars}]{{0,{most}}}")


def _run(text: str, at: int, chars: str, most: int) -> int:
    return _some(chars, most).match(text, at).end()


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _open(text: str, at: int, limit: int) -> bool:
    """Whether what begins at ``at``, an opening bracket or a name, may be a token that goes on behind the text, or is one
    that goes beyond ``limit``."""
    n, blank, word = len(text), r" \t", "A-Za-z0-9"
    if text[at] in "<[{":
        at = _run(text, at + 1, blank, BLANKS)
        if at == n:
            return True
    if not (text[at].isascii() and text[at].isalpha()):
        return False
    at = _run(text, at, word, NAME + 1)
    for _ in range(PARTS + 2):
        if at == n:
            return True
        at = _run(text, at, blank, BLANKS)
        if at == n:
            return True
        joined = text[at] in "_-"
        if joined or text[at] in "\n\r\f\v":
            at += 1
        elif text[at - 1] not in " \t":
            return False
        at = _run(text, at, blank, BLANKS + 1)
        if at == n:
            return True
        if text[at] in "0123456789":
            end = _run(text, at, "0-9", DIGITS)
            if end == n or _word(text[end]):
                return end == n
            close = _run(text, end, blank, BLANKS)
            return close == n or (close + 1 if text[close] in ">]}" else end) > limit
        if not (joined and text[at].isascii() and text[at].isalpha()):
            return False
        at = _run(text, at, word, PART + 1)
    return False


def _word_char(c: str) -> bool:
    return c.isalnum() if c.isascii() else any(map(_word, unicodedata.normalize("NFKC", c)))


#: Backwards, what no token goes on behind: a letter that only blanks part from what is before it, a bracket, anything a token doesn't hold.
_BREAK = re.compile(r"[A-Za-z]\s+[^\s_<\[{-]|[^A-Za-z0-9 \t\n\r\f\v_-]", re.ASCII)


def _token_from(view: str, starts: list[int] | None, last: int) -> int:
    """The least place at or before ``last`` that doesn't cut a token, nor what may become one."""
    limit = bisect_left(starts, last) if starts else last
    low, high = max(0, limit - HOLD), min(limit, len(view))
    if m := _BREAK.search(view[low:high][::-1]):  # what begins before it ends before it
        low = high - 1 - m.start()
    for m in _STARTS.finditer(view, low, high):
        if _open(view, k := m.start(), limit):
            return min(last, starts[k] if starts else k)
    return last


def _whole_word(text: str, at: int) -> int:
    """``at``, or where the word begins that it would cut: what follows a number decides whether it ends a token."""
    back = at
    while 0 < back < len(text) and len(text) - back < HOLD and _word_char(text[back - 1]) and _word_char(text[back]):
        back -= 1
    return back


@functools.lru_cache(maxsize=64)
def _beginnings(surfaces: tuple[str, ...]) -> tuple[dict[str, list[str]], re.Pattern[str], int]:
    """Stand-ins by their first characters, a pattern of where one may begin, and how far the longest reaches."""
    firsts: dict[str, list[str]] = {}
    reach = 0
    for s in map(str.strip, surfaces):
        if s:
            firsts.setdefault(s[0].lower(), []).append(s)
            reach = max(reach, len(s) + s.count(" ") * (2 * GAP + 2))
    some = "|".join(map(re.escape, firsts)) or "(?!)"
    return firsts, re.compile(rf"(?:(?<![A-Za-z0-9])|(?![A-Za-z0-9]))(?i:{some})"), reach


def _surface_from(text: str, surfaces: tuple[str, ...]) -> int:
    """Where the suffix begins that is a stand-in's beginning, or all of one whose last edge isn't known yet."""
    firsts, may, reach = _beginnings(surfaces)
    for m in may.finditer(text, max(0, len(text) - reach)):
        at = m.start()
        if any(gaps_fit(text[at:], s) >= 0 for s in firsts.get(text[at].lower(), ())):
            return at
    return len(text)


def _uncut(text: str, at: int, surfaces: tuple[str, ...]) -> int:
    """``at``, or where the first stand-in begins that it would cut; none reaches farther than the longest does."""
    reach = _beginnings(surfaces)[2]
    low = max(0, at - reach - 1)
    found = surface_literals(surfaces).occurrences(text[low : at + reach + 1])
    return min([at, *(s + low for s, e, _ in found if s + low < at < e + low)])


def hold_from(text: str, surfaces: tuple[str, ...] = ()) -> int:
    """Where the suffix begins that a later chunk might still make a token or a stand-in of, or fold otherwise."""
    last = max(0, combining_from(text) - 1)  # marks may still follow the last character
    view, starts, _ = fold_text(text)
    at = _whole_word(text, _token_from(view, starts, last))
    if not surfaces:
        return at
    at = min(at, _surface_from(text, surfaces))
    while True:  # a place that cuts nothing: neither a stand-in, nor a token beside it, nor a word
        back = _whole_word(text, _token_from(view, starts, _uncut(text, at, surfaces)))
        if back == at:
            return at
        at = back


def cut(context: str, held: str, chunk: str, last: bool, surfaces: tuple[str, ...] = ()) -> tuple[str, str, str]:
    """(context, held, released): the context is the character released before, which a token must not follow."""
    text = held + chunk
    whole = context + text
    at = len(whole) if last else max(len(context), hold_from(whole, surfaces))
    released = whole[len(context) : at]
    return (whole[at - 1 : at] if at else ""), whole[at:], released


def segments(chunks: DataFrame, mappings: DataFrame | None = None) -> DataFrame:
    """(scope, stream_id, seq, context, text) of streamed chunks (scope, stream_id, seq, chunk, is_last).

    The texts of a stream together are its chunks together, however those were cut; no token lies across two of
    them, nor a stand-in that ``mappings`` shows in the stream's scope.  Chunks of a stream come in order of
    micro-batches; within one they are sorted.  A stream's state is one character and at most what may still become a
    token or a stand-in; it goes with the last chunk.  Streams are dealt over ``KEYS`` keys by their hashes, and a key's
    state has those that are open.  For separate runs of one stream (prose, arguments of calls) give each its own stream_id.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = {(scope, stream): (context, held) for scope, stream, context, held in json.loads(state.get[0])} if state.exists else {}
        streams: dict[tuple, list[tuple]] = {}
        for f in frames:
            for scope, stream, *row in zip(*(f[c].tolist() for c in ("scope", "stream_id", "seq", "chunk", "is_last", "names"))):
                streams.setdefault((scope, stream), []).append(row)
        out = []
        for stream, rows in streams.items():
            (context, held), done = open_.pop(stream, ("", "")), False
            for seq, chunk, last, names in sorted(rows, key=lambda r: r[0]):
                before = context
                context, held, text = cut(context, held, chunk or "", bool(last), surface_names(names))
                out.append((*stream, seq, before, text))
                done = done or bool(last)
            if not done:
                open_[stream] = (context, held)
        if open_:
            state.update((json.dumps([(*stream, *kept) for stream, kept in open_.items()]),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["scope", "stream_id", "seq", "context", "text"])

    rows = chunks.select("scope", "stream_id", "seq", "chunk", "is_last").withColumn("key", F.pmod(F.xxhash64("scope", "stream_id"), F.lit(KEYS)))
    if mappings is not None and "surface" in mappings.columns:
        rows = beside_scope(rows, scope_surfaces(mappings).select("scope", "names"), "stream_id")
    else:
        rows = rows.withColumn("names", F.lit(None).cast("string"))
    schema = "scope string, stream_id string, seq long, context string, text string"
    return rows.groupBy("key").applyInPandasWithState(run, schema, "open string", "append", GroupStateTimeout.NoTimeout)


def restore_segments(pieces: DataFrame, mappings: DataFrame) -> DataFrame:
    """(scope, stream_id, seq, text): segments restored by the batch operator, their contexts taken off again."""
    key = F.struct("stream_id", "seq", F.length("context").alias("skip"))
    # a letter before a segment is told by a digit: neither lets a token follow, and a digit begins none
    lead = F.when(F.col("context") == "", "").when(F.col("context").rlike("[A-Za-z0-9]"), "0").otherwise(" ")
    whole = pieces.select("scope", key.alias("response_id"), F.concat(lead, "text").alias("text"))
    text = F.col("restored_text").substr(F.col("response_id.skip") + 1, F.length("restored_text"))
    return restore(whole, mappings).select("scope", "response_id.stream_id", "response_id.seq", text.alias("text"))


def restore_stream(chunks: DataFrame, mappings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts writing (scope, stream_id, seq, text) below ``path``, a folder a micro-batch; run again, a batch is overwritten.

    Mappings are those known when the query starts.  What a batch cuts is kept in the shared folder until it is restored.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, cut = batch.sparkSession, scratch(batch.sparkSession, "pieces")
        try:  # read more than once: the stateful operator would run for each reading
            batch.write.option("compression", "zstd").parquet(cut)
            restore_segments(spark.read.schema(batch.schema).parquet(cut), mappings).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={number}")
        finally:
            removed(spark, cut)

    return segments(chunks, mappings).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
