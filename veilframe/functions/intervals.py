"""Claims on a text: sorted disjoint intervals, and who keeps a place when several want it.

Columns hand over bare places and ranks and get back which of them stay; what belongs to a place never leaves the
JVM.  Rows in which nothing overlaps are settled there and hand over nothing.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StructField, StructType

NUMBERS = ArrayType(IntegerType())


def places_with(name: str, kind: DataType) -> ArrayType:
    """array of struct<start, end, name>."""
    return ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField(name, kind)]))


#: Places and the number of what is there.
FOUND = places_with("k", IntegerType())


class IntervalSet:
    """Half-open intervals, kept sorted and disjoint; neighbours that touch become one.

    Asking costs a binary search, and so does claiming, whatever is already claimed.
    """

    def __init__(self, intervals: Iterable[tuple[int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(intervals):
            if end <= start:
                continue
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def overlaps(self, start: int, end: int) -> bool:
        k = bisect_right(self.ends, start)
        return start < end and k < len(self.starts) and self.starts[k] < end

    def add(self, start: int, end: int) -> None:
        if end <= start:
            return
        first, behind = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if first < behind:
            start, end = min(start, self.starts[first]), max(end, self.ends[behind - 1])
        self.starts[first:behind], self.ends[first:behind] = [start], [end]

    def claim(self, start: int, end: int) -> bool:
        """Takes the place if nothing overlaps it."""
        if self.overlaps(start, end):
            return False
        self.add(start, end)
        return True

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts, self.ends)


def runs(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Numbers of the spans, cut into runs that nothing overlaps across, in order of place."""
    out: list[list[int]] = []
    reach = -1
    for k in sorted(range(len(spans)), key=spans.__getitem__):
        start, end = spans[k]
        if not out or start >= reach:
            out.append([])
        out[-1].append(k)
        reach = max(reach, end)
    return out


def keepers(spans: list[tuple[int, int]], ranks: list) -> list[int]:
    """Numbers of the spans that greedy choice in order of rank keeps, in order of place.

    A span that only loses blocks nothing.  Only spans that overlap others are ranked.
    """
    kept: list[int] = []
    for run in runs(spans):
        if len(run) == 1:
            kept += run
            continue
        held = IntervalSet()
        kept += sorted((k for k in sorted(run, key=lambda k: (ranks[k], k)) if held.claim(*spans[k])), key=spans.__getitem__)
    return kept


@F.pandas_udf(NUMBERS)
def _keep(places: pd.Series) -> pd.Series:
    def one(rows) -> list[int] | None:
        if rows is None:
            return None
        spans = [(r["start"], r["end"]) for r in rows]
        ranks = [(r["start"] - r["end"], -r["severity"], -r["confidence"], r["start"], r["source"], r["type"]) for r in rows]
        return keepers(spans, ranks)

    return places.map(one)


#: Not deterministic to the optimizer, so that no filter on what is kept is worked out twice, below the other passes.
_keep = _keep.asNondeterministic()


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def clear(ordered: Column) -> Column:
    """Whether none of the spans, in order of place, overlaps the next."""
    ends = F.transform(F.slice(ordered, 1, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda d: d["end"])
    starts = F.transform(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), lambda d: d["start"])
    return F.forall(F.zip_with(ends, starts, lambda e, s: e <= s), lambda fine: fine)


def settled_overlaps(dets: Column) -> Column:
    """dets without those that lose their place: longer, more severe, more confident, earlier ones win, then source and
    type by name; in order of place.  Rows without overlaps don't leave the JVM."""
    ordered = F.array_sort(dets)
    bare = let(ordered, lambda o: F.when((F.size(o) > 1) & ~clear(o), F.transform(o, lambda d: F.struct(d["start"], d["end"], d["severity"], d["confidence"], d["source"], d["type"]))))
    return let(F.struct(ordered.alias("o"), _keep(bare).alias("kept")), lambda x: F.when(x["kept"].isNull(), x["o"]).otherwise(F.transform(x["kept"], lambda k: F.get(x["o"], k))))
