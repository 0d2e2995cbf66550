"""Packing documents into training windows by best fit, longest first.

A document longer than a window is first cut into full windows; what is left
joins the others.  Pieces go, longest first, into the tightest open window that
still holds them, which a segment tree indexed by remaining capacity finds.
Each task packs the pieces of its own partition, so packing moves no rows and no
group can grow beyond a partition; ids of windows hold the partition's number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bpe import by_library
from .common import give_back

#: Pieces that are packed at once; a partition with more is packed in several rounds.
ROUND = 250_000


class CapacityTree:
    """Counts of open windows by remaining capacity 0..size, with the least capacity >= n that has one."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += by
            k >>= 1

    def tightest(self, n: int) -> int:
        """-1 where no open window holds n."""
        k, count = self.leaves + n, self.count
        if not count[k]:
            while k & 1 or not count[k + 1]:  # up until a right sibling has some
                k >>= 1
                if k <= 1:
                    return -1
            k += 1
            while k < self.leaves:
                k = 2 * k if count[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and offset of each piece of 1..size ids; equal lengths in the order given."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, open_at = CapacityTree(size), {}
    made = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[k])
        left = tree.tightest(n)
        if left < 0:
            w, left, made = made, size, made + 1
        else:
            w = open_at[left].pop()
            tree.add(left, -1)
        window[k], offset[k] = w, size - left
        if left > n:
            open_at.setdefault(left - n, []).append(w)
            tree.add(left - n, 1)
    return window, offset


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every text is encoded whole with ``end_id`` appended, so null and empty texts are a piece of one id.  Repeated
    rows are packed as often as they stand; an empty table has no pieces; other columns are not read.
    """

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")

    def flush(pieces: list[tuple], base: int) -> tuple[dict, int]:
        window, offset = best_fit_decreasing(np.array([p[2] for p in pieces]), size)
        return dict(zip(names, map(list, zip(*pieces)))) | {"sequence_id": base + window, "offset": offset}, base + int(window.max()) + 1

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = by_library(tokenizer)
        end = bpe.pack([end_id])
        base, pieces = TaskContext.get().partitionId() << 40, []
        for f in batches:
            for key, b in zip(f["doc_id"].to_pylist(), bpe.encode_many(f["text"].to_pylist())):
                ids = np.frombuffer(b + end, bpe.dtype).astype("<u4")
                pieces += [(key, at, min(size, len(ids) - at), zlib.crc32(ids[at : at + size].tobytes()), len(ids)) for at in range(0, len(ids), size)]
            if len(pieces) >= ROUND:
                out, base = flush(pieces, base)
                pieces = []
                yield pa.RecordBatch.from_pydict(out, schema=kinds)
        bpe.forget()
        give_back()
        if pieces:
            yield pa.RecordBatch.from_pydict(flush(pieces, base)[0], schema=kinds)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
