"""Tokens, records and packing against the tokenizers library itself."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from veilframe.llm import bpe, packing, records
from veilframe.llm.common import scratch, tokenizer_path

ODD = [None, "", " ", "\n\n\t ", "a", "naïve café ünïcode", "日本語 текст 🙂🙂", "x" * 5000, "the " * 3000, "don't WON'T 12345 $$$ %%%", "\u0000�", "<|endoftext|> in a text", "é ​"]


def texts(seed=3, n=60):
    r = random.Random(seed)
    alphabet = "abc  the\n'sé日1.,-_<>|"
    return ODD + ["".join(r.choice(alphabet) for _ in range(r.randint(0, 400))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k * 7 % 101, t, "x", 1) for k, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, part int").repartition(5)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def encoded(library, docs):
    return {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()}


def pack4(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_same_ids_and_texts_as_the_library(docs, library):
    want = encoded(library, docs)
    got = {r["doc_id"]: r for r in bpe.digests(docs, tokenizer_path()).collect()}
    assert set(got) == set(want)
    for k, ids in want.items():
        assert got[k]["n_tokens"] == len(ids)
        assert got[k]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_records_come_back_in_order(docs, library):
    want = encoded(library, docs)
    start = 0
    got = sorted(map(tuple, records.sequences(docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    for (key, at, n, crc), k in zip(got, sorted(want), strict=True):
        ids = [*want[k], 0]
        assert (key, at, n, crc) == (k, start, len(ids), pack4(ids))
        start += len(ids)


def test_shuffled_reads_meet_every_record_once(spark, docs, library):
    path = scratch(spark, "test-records")
    manifest = records.write_sequences(docs, path, tokenizer_path())
    got = {r["doc_id"]: list(r["ids"]) for r in records.read_shuffled(spark, path, manifest, seed=5, per_task=7).collect()}
    assert got == {k: [*ids, 0] for k, ids in encoded(library, docs).items()}


def test_damage_is_noticed():
    import io

    whole = records.frame(b"payload")
    assert records.read_frame(io.BytesIO(whole)) == b"payload"
    assert records.read_frame(io.BytesIO(b"")) is None
    for k in range(len(whole)):
        with pytest.raises(ValueError, match="damaged"):
            records.read_frame(io.BytesIO(whole[:k] + bytes([whole[k] ^ 1]) + whole[k + 1 :]))
    with pytest.raises(ValueError, match="damaged"):
        records.read_frame(io.BytesIO(whole[:-1]))


def test_packing_loses_no_id(docs, library):
    want = encoded(library, docs)
    rows = packing.pack(docs, tokenizer_path(), size=64).collect()
    of, window = {}, {}
    for r in rows:
        of.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        window.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(of) == set(want)
    for k, pieces in of.items():
        ids, at = [*want[k], 1], 0
        for start, n, crc, total in sorted(pieces):
            assert (start, total) == (at, len(ids)) and crc == pack4(ids[at : at + n])
            at += n
        assert at == len(ids)
    for pieces in window.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 64


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_takes_the_tightest_window(seed):
    r = random.Random(seed)
    lengths = np.array([r.randint(1, 50) for _ in range(300)])
    window, offset = packing.best_fit_decreasing(lengths, 50)
    left: list[int] = []
    for k in np.argsort(-lengths, kind="stable"):
        fits = [x for x in left if x >= lengths[k]]
        w = int(window[k])
        if fits:
            assert left[w] == min(fits) and offset[k] == 50 - left[w]
            left[w] -= lengths[k]
        else:
            assert w == len(left) and offset[k] == 0
            left.append(50 - lengths[k])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(none, tokenizer_path()).count() == 0
    assert records.sequences(none, tokenizer_path()).count() == 0
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_large_ids_beside_null_ones(spark):
    big = 9007199254740993
    docs = spark.createDataFrame([(big, "a"), (None, "b"), (big, "a")], "doc_id long, text string").coalesce(1)
    path = tokenizer_path()
    for out in (bpe.digests(docs, path), bpe.encode_decode(docs, path), packing.pack(docs, path), records.sequences(docs, path)):
        assert sorted((r["doc_id"] for r in out.collect()), key=str) == [big, big, None]


def test_files_are_sized_by_bytes_even_of_one_id(spark, monkeypatch):
    """All rows have one id and differ in their text: they fill files alike, and come back whole."""
    monkeypatch.setattr(records, "EACH", 4000)
    docs = spark.createDataFrame([(7, f"text {k} " * 10) for k in range(800)] + [(None, "a"), (None, "b")], "doc_id long, text string")
    path = scratch(spark, "records")
    manifest = records.write_sequences(docs, path, tokenizer_path())
    sizes = [m["n_records"] for m in manifest]
    assert len(manifest) >= 15 and sum(sizes) == 802 and max(sizes) < 4 * 802 / len(sizes)
    back = records.scan(spark, path, manifest).collect()
    assert len(back) == 802 and sorted(r["start"] for r in back)[-1] + 1 < sum(m["n_tokens"] for m in manifest)
    assert [r["doc_id"] for r in sorted(back, key=lambda r: r["start"])][:3] == [None, None, 7]
