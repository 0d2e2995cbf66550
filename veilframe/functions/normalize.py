"""NFKC with a way back to the original places."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NORMALIZED = "struct<text:string,starts:array<int>,ends:array<int>>"
ASCII = r"^\p{ASCII}*$"
_BEYOND = re.compile("[\u0300-\U0010ffff]")


_OTHER = re.compile("[^\x00-\x7f]+")


def _folded(text: str) -> tuple[str, np.ndarray | None, np.ndarray | None]:
    if text.isascii():
        return text, None, None
    marks = _BEYOND.search(text) and any(map(unicodedata.combining, text))  # none are below
    if unicodedata.is_normalized("NFKC", text) and not marks:
        return text, None, None
    out, starts, ends, at = [], [], [], 0
    for m in _OTHER.finditer(text):
        # runs of ASCII stay as they are, but for the last character, which a mark behind it may join
        i, stop = max(at, m.start() - 1), m.end()
        out.append(text[at:i])
        starts.append(np.arange(at, i, dtype=np.int32))
        ends.append(np.arange(at + 1, i + 1, dtype=np.int32))
        own, own_ends = [], []
        while i < stop:
            j = i + 1
            while j < stop and unicodedata.combining(unicodedata.normalize("NFKC", text[j])[:1] or "\0"):
                j += 1
            folded = unicodedata.normalize("NFKC", text[i:j])
            out.append(folded)
            own += [i] * len(folded)
            own_ends += [j] * len(folded)
            i = j
        starts.append(np.array(own, np.int32))
        ends.append(np.array(own_ends, np.int32))
        at = stop
    out.append(text[at:])
    starts.append(np.arange(at, len(text), dtype=np.int32))
    ends.append(np.arange(at + 1, len(text) + 1, dtype=np.int32))
    return "".join(out), np.concatenate(starts), np.concatenate(ends)


def fold_text(text: str) -> tuple[str, list[int] | None, list[int] | None]:
    """Folded text and, per folded character, the original span it came from; no maps where nothing changed.

    A character and the combining marks behind it fold together, so all characters of a fold share one span.
    """
    folded, starts, ends = _folded(text)
    return folded, None if starts is None else starts.tolist(), None if ends is None else ends.tolist()


def _fold(text: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if t is None or (f := _folded(t))[1] is None else f for t in text]
    return pd.DataFrame(rows, columns=["text", "starts", "ends"])


def _fold_value(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else unicodedata.normalize("NFKC", t) for t in text], dtype=object)


def normalized(text: Column) -> Column:
    """struct<text, starts, ends>, its fields null where folding changes nothing.

    Only texts with characters beyond ASCII go to Python, only changed ones come back.  Not deterministic in name,
    so the optimizer doesn't copy the call into the lambdas that use it.
    """
    udf = F.pandas_udf(_fold, NORMALIZED).asNondeterministic()
    return udf(F.when(~text.rlike(ASCII), text))


def folded_value(value: Column) -> Column:
    """NFKC of a short value, for a column of its own: it must not be used inside a lambda."""
    udf = F.pandas_udf(_fold_value, "string").asNondeterministic()
    return F.coalesce(udf(F.when(~value.rlike(ASCII), value)), value)


def original_start(norm: Column, start: Column) -> Column:
    return F.coalesce(F.get(norm["starts"], start), start)


def original_end(norm: Column, end: Column) -> Column:
    return F.coalesce(F.get(norm["ends"], end - 1), end)
