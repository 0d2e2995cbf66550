"""Length-delimited binary records of token ids, with a separate offset index.

A record file holds frames: length (uint64), masked checksum of the length
(uint32), payload, masked checksum of the payload (uint32), all little-endian.
The checksum is CRC-32 rotated by 15 bits plus a constant, so that a checksum
stored inside a payload isn't taken for its own.  A payload is one sequence:
id (int64), a flag byte (bit 0: the id is null; bit 1: ids have 4 bytes rather
than 2), the ids.  Beside ``part-N.rec`` stands ``part-N.idx``: for each record
its id, its offset and its payload's length, three int64.  With it a reader
seeks any record, so shuffled reads need no scan.

Files are written to a name of the attempt's own and then moved, so a task that
is run again, or twice at once, leaves one whole file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import by_library
from .common import give_back, parts_for, scratch

_MASK = 0xA282EAD8  # fixed value
#: Bytes of text that a file is made of.
EACH = 64 << 20
_HEAD, _TAIL = 12, 4


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = len(payload).to_bytes(8, "little")
    return b"".join((length, masked(length).to_bytes(4, "little"), payload, masked(payload).to_bytes(4, "little")))


def serialize(key: int | None, ids: np.ndarray) -> bytes:
    wide = ids.dtype.itemsize == 4
    return (key or 0).to_bytes(8, "little", signed=True) + bytes([(key is None) | wide << 1]) + ids.tobytes()


def deserialize(payload: bytes) -> tuple[int | None, np.ndarray]:
    key = None if payload[8] & 1 else int.from_bytes(payload[:8], "little", signed=True)
    return key, np.frombuffer(payload, "<u4" if payload[8] & 2 else "<u2", offset=9)


def read_frame(stream) -> bytes | None:
    """The next payload; None at the end.  A cut or altered frame is an error."""
    head = stream.read(_HEAD)
    if not head:
        return None
    if len(head) < _HEAD or masked(head[:8]) != int.from_bytes(head[8:], "little"):
        raise ValueError("record length is damaged")
    payload = stream.read(n := int.from_bytes(head[:8], "little"))
    if len(payload) < n or masked(payload).to_bytes(_TAIL, "little") != stream.read(_TAIL):
        raise ValueError("record payload is damaged")
    return payload


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_sequences(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[dict]:
    """Encode every whole text, append ``end_id`` and write the sequences in ascending id order.

    Returns the manifest in file order: part, file, n_records, n_tokens, one entry a file.  Null text is a
    sequence of the end id alone; null ids come first; rows with equal ids all stay, ordered by a hash of their text
    and then by the text, over as many files as they take; an empty table makes files without records.  Other columns
    are not read.  A file holds about ``EACH`` bytes of text, unless ``parts`` says how many there are.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    parts = parts or parts_for(spark, rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0, EACH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = by_library(tokenizer)
        end = bpe.pack([end_id])
        part = TaskContext.get().partitionId()
        store, root = _store(path)
        store.create_dir(root, recursive=True)
        own, name = f"{root}/.{uuid.uuid4().hex}", f"part-{part:06d}"
        n = tokens = at = 0
        with store.open_output_stream(f"{own}.rec") as rec, store.open_output_stream(f"{own}.idx") as idx:
            for f in batches:
                for key, ids in zip(f["id"].to_pylist(), bpe.encode_many(f["text"].to_pylist())):
                    ids = np.frombuffer(ids + end, bpe.dtype)
                    payload = serialize(key, ids)
                    rec.write(frame(payload))
                    idx.write(np.array([key or 0, at, len(payload)], "<i8").tobytes())
                    at += _HEAD + len(payload) + _TAIL
                    n, tokens = n + 1, tokens + len(ids)
        bpe.forget()
        give_back()
        for kind in ("rec", "idx"):
            store.move(f"{own}.{kind}", f"{root}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"part": [part], "file": [name], "n_records": [n], "n_tokens": [tokens]})

    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text")
    found = rows.mapInArrow(run, "part long, file string, n_records long, n_tokens long").collect()  # one row a file
    return [r.asDict() for r in sorted(found, key=lambda r: r["part"])]


def scan(spark: SparkSession, path: str, manifest: list[dict]) -> DataFrame:
    """Per record, read back in file order: doc_id, start (ids of all records before it), n_tokens, ids_crc32."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(path)
        for f in frames:
            for name, start in zip(f["file"], f["start"]):
                out: list[tuple] = []
                with store.open_input_stream(f"{root}/{name}.rec", buffer_size=1 << 20) as rec:
                    while (payload := read_frame(rec)) is not None:
                        key, ids = deserialize(payload)
                        out.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        start += len(ids)
                        if len(out) >= 20_000:
                            yield _rows(out)
                            out = []
                if out:
                    yield _rows(out)

    starts = np.cumsum([0, *(m["n_tokens"] for m in manifest)]).tolist()
    files = spark.createDataFrame([(m["file"], s) for m, s in zip(manifest, starts)], "file string, start long")
    return files.repartition(max(1, len(manifest))).mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rows(out: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame(out, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
    return f.astype({"doc_id": "Int64"})


def read_shuffled(spark: SparkSession, path: str, manifest: list[dict], seed: int, per_task: int = 10_000) -> DataFrame:
    """(position, doc_id, ids): all records in an order shuffled by ``seed``, each sought through the offset index.

    Every file is cut into runs of ``per_task`` index entries; a record's position is a hash of seed, file and
    place, so the order spans all files and needs no list of records anywhere.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(path)
        for f in frames:
            for name, first in zip(f["file"], f["first"]):
                with store.open_input_file(f"{root}/{name}.idx") as idx:
                    idx.seek(first * 24)
                    index = np.frombuffer(idx.read(per_task * 24), "<i8").reshape(-1, 3)
                with store.open_input_file(f"{root}/{name}.rec") as rec:
                    out = []
                    for k in np.random.default_rng([seed, first]).permutation(len(index)).tolist():
                        rec.seek(int(index[k, 1]))
                        key, ids = deserialize(read_frame(rec))
                        out.append((f"{name}:{first + k}", key, ids.astype(np.int32)))
                yield pd.DataFrame(out, columns=["place", "doc_id", "ids"]).astype({"doc_id": "Int64"})

    runs = [(m["file"], first) for m in manifest for first in range(0, m["n_records"], per_task)]
    if not runs:
        return spark.createDataFrame([], "position long, doc_id long, ids array<int>")
    read = spark.createDataFrame(runs, "file string, first long").repartition(len(runs)).mapInPandas(run, "place string, doc_id long, ids array<int>")
    return read.select(F.xxhash64(F.lit(seed), "place").alias("position"), "doc_id", "ids").orderBy("position")


def sequences(docs: DataFrame, tokenizer: str) -> DataFrame:
    """op2: write all sequences into the shared folder and return what the files hold."""
    spark = docs.sparkSession
    path = scratch(spark, "sequences")
    return scan(spark, path, write_sequences(docs, path, tokenizer))
