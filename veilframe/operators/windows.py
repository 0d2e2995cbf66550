"""Overlapping windows of long texts, cut at natural boundaries."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CUTS = (re.compile(r"\n\s*\n"), re.compile(r"\n"), re.compile(r"[。！？]|[.!?](?=\s)"))


def windows(text: str, size: int, overlap: int = 400) -> list[tuple[int, str]]:
    """(offset, slice): each slice at most ``size`` long, its end moved back to the best boundary in its last quarter."""
    if size < 1:
        raise ValueError("size must be positive")
    overlap, out, at = min(overlap, size // 2), [], 0
    while at < len(text):
        end = min(len(text), at + size)
        if end < len(text):
            low = at + size - size // 4
            for rx in _CUTS:
                if found := [m.end() for m in rx.finditer(text, low, end)]:
                    end = found[-1]
                    break
        out.append((at, text[at:end]))
        if end == len(text):
            break
        at = max(at + 1, end - overlap)
    return out


def longest_whole(size: int, overlap: int = 400) -> int:
    """Length up to which every value lies whole in some window; windows that promise less than 64 are refused."""
    whole = min(overlap, size // 2)
    if whole < 64:
        raise ValueError("windows must keep values of 64 characters whole")
    return whole


def explode_windows(texts: DataFrame, size: int = 8000, overlap: int = 400) -> DataFrame:
    """texts with a row per window: offset and window replace text."""
    cut = F.pandas_udf(lambda s: pd.Series([[{"offset": a, "window": w} for a, w in windows(t or "", size, overlap)] for t in s]), "array<struct<offset:int,window:string>>")
    return texts.withColumn("_w", F.explode(cut("text"))).drop("text").select("*", "_w.offset", "_w.window").drop("_w")
