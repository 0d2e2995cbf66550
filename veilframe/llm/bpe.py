"""Byte-level BPE by forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so
the place between its bytes is a certain cut: the fragments on both sides encode
independently and their ids are concatenated.  Three guards keep a cut from
changing how the splitting pattern sees a fragment on its own: no cut follows
white space (``\\s+(?!\\S)`` looks ahead), none precedes an apostrophe
(contractions), none falls inside a UTF-8 character.

Fragments repeat, so their ids are kept in two bounded caches: words between
single spaces, and the pieces that forced cuts leave of a word.  A piece that is
in neither is encoded by ``encode_piece``: our own merges (op5), or whatever
``encoder`` is given (op2 and op9 hand in the tokenizers library).
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batches

#: The splitting pattern of this vocabulary family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries a cache may hold before it starts anew.
CACHE_WORDS = 400_000
#: Characters of the texts that are cut up at once.
GROUP = 2 << 20
_WIDE = "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBPE:
    """Encodes and decodes with one vocabulary file; ids are packed little-endian integers."""

    def __init__(self, path: str, encoder: Callable[[list[str]], list[list[int]]] | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        as_byte = byte_alphabet()
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.vocab = {bytes(as_byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t.encode() not in self.special}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for k, m in enumerate(spec["model"]["merges"] if encoder is None else ()):  # the library has its own
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[bytes(as_byte[c] for c in a), bytes(as_byte[c] for c in b)] = k
        self.dtype = np.dtype("<u2" if max(self.token) < 1 << 16 else "<u4")
        self.never = np.ones((256, 256), bool)
        for t in self.vocab:
            if len(t) > 1:
                a = np.frombuffer(t, np.uint8)
                self.never[a[:-1], a[1:]] = False
        spaces = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32]
        self.cuts = self.never.copy()
        self.cuts[spaces, :] = False
        self.cuts[:, 39] = False
        self.cuts[:, 0x80:0xC0] = False
        # A single space may be split at only after a byte that is no space and joins no space in any token.
        self._blank = bytes(32 if b in spaces or not self.never[b, 32] else b for b in range(256))
        self._special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self._marks = [m.decode() for m in self.special]
        self._pattern = regex.compile(PATTERN)
        self._encoder = encoder
        self.n_bytes = np.array([len(self.token.get(i, b"")) for i in range(max(self.token) + 1)])
        if encoder is None:
            self._rank_table()
        self._words: dict[bytes, bytes] = {}
        self._pieces: dict[bytes, bytes] = {}

    def pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _rank_table(self) -> None:
        """Merge ranks by pair of ids, as an open-addressed table that numpy can search."""
        self.top = len(self.rank)
        self.byte_id = np.array([self.vocab[bytes([b])] for b in range(256)], np.int64)
        self.merged = np.array([self.vocab[a + b] for a, b in self.rank], np.int64)
        keys = np.array([self.vocab[a] << 32 | self.vocab[b] for a, b in self.rank], np.int64)
        self.bits = max(8, int(len(keys)).bit_length() + 3)
        self.slot_key, self.slot_rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.top, np.int64)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.slot_key[at] < 0
            first = np.zeros(len(left), bool)
            first[np.unique(at, return_index=True)[1]] = True
            take = free & first
            self.slot_key[at[take]], self.slot_rank[at[take]] = keys[left[take]], left[take]
            left, at = left[~take], (at[~take] + ~(free & ~first)[~take]) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a << 32 | b
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], self.top)
        todo = np.flatnonzero((found != keys) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.slot_key[at[todo]]
            hit = found == keys[todo]
            out[todo[hit]] = self.slot_rank[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def merge_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units of the splitting pattern, one after another, and how many each has.
        In each round every unit merges its best-ranked pair wherever it stands."""
        name, own = np.arange(len(units)), np.repeat(np.arange(len(units)), np.fromiter(map(len, units), np.int64, len(units)))
        ids = self.byte_id[np.frombuffer(b"".join(units), np.uint8)]
        done = [(own[:0], ids[:0])]
        while len(ids):
            start = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            rank = np.full(len(ids), self.top)
            rank[:-1] = self._ranks(ids[:-1], ids[1:])
            rank[np.r_[start[1:], len(ids)] - 1] = self.top
            best = np.repeat(np.minimum.reduceat(rank, start), np.diff(np.r_[start, len(ids)]))
            over = best == self.top
            done.append((own[over], ids[over]))
            hit = (rank == best) & ~over
            if (hit[1:] & hit[:-1]).any():  # aaa: every second place of a run
                at = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], at, -1))
                hit &= (at - begin) % 2 == 0
            ids[hit] = self.merged[rank[hit]]
            keep = ~over & ~np.r_[False, hit[:-1]]
            ids, own = ids[keep], own[keep]
        of, flat = (np.concatenate(x) for x in zip(*done))
        return flat[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(name))

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each fragment, by our own merges."""
        plain = [p for p in pieces if len(p) <= 400 and p[p[0] == 32 :].isalpha()]  # one unit
        flat, n = self.merge_units(plain)
        known = dict(zip(plain, self._cut(flat, n)))
        other = [p for p in pieces if p not in known]
        units = [[u.encode() for u in self._pattern.findall(p.decode())] for p in other]
        short = [u for own in units for u in own if len(u) <= 400]
        by_unit = iter(self._cut(*self.merge_units(short)))
        for p, own in zip(other, units):
            known[p] = b"".join([next(by_unit) if len(u) <= 400 else self.pack(self._merge_long(u)) for u in own])
        return [known[p] for p in pieces]

    def _cut(self, ids: np.ndarray, n: np.ndarray) -> list[bytes]:
        packed, ends = ids.astype(self.dtype).tobytes(), (np.cumsum(n) * self.dtype.itemsize).tolist()
        return [packed[i:j] for i, j in zip([0, *ends], ends)]

    def _library_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each fragment, by the library.  Fragments that begin with a space and end at a forced cut
        before one are encoded as one text of many, and the ids parted again by their tokens' lengths."""
        ok = self.cuts[:, 32]
        joined = [p for p in pieces if len(p) > 1 and p[0] == 32 and p[1] != 32 and ok[p[-1]] and not _WIDE_SPACE.search(p[-3:])]
        alone = list(set(pieces).difference(joined))
        known = dict(zip(alone, map(self.pack, self._encoder([p.decode() for p in alone]))))
        groups = [joined[i : i + 256] for i in range(0, len(joined), 256)]
        for group, ids in zip(groups, self._encoder([b"".join(g).decode() for g in groups])):
            ends = np.cumsum(self.n_bytes[ids])
            stop = np.searchsorted(ends, np.cumsum([len(p) for p in group])) + 1
            known.update(zip(group, self._cut(np.array(ids), np.diff(stop, prepend=0))))
        return [known[p] for p in pieces]

    def _merge_long(self, word: bytes) -> list[int]:
        """One long unit without any forced cut, in n log n steps: a heap of pairs over a linked list."""
        import heapq

        parts: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after, before = [*range(1, len(word)), -1], [*range(-1, len(word) - 1)]
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(word) - 1) if (r := self.rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else -1
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (r := self.rank.get((parts[p], parts[q]))) is not None:
                    heapq.heappush(heap, (r, p, parts[p], parts[q]))
        return [self.vocab[p] for p in parts if p is not None]

    def split(self, text: bytes) -> list[bytes]:
        """The fragments between forced cuts; together they are the text."""
        if len(text) < 2:
            return [text] if text else []
        a = np.frombuffer(text, np.uint8)
        cut = self.cuts[a[:-1], a[1:]]
        for m in _WIDE_SPACE.finditer(text):
            cut[m.end() - 1 : m.end()] = False
        at = [0, *(np.flatnonzero(cut) + 1).tolist(), len(text)]
        return [text[i:j] for i, j in zip(at, at[1:])]

    def _learn(self, words: list[bytes]) -> None:
        """Put words into the cache, each by its pieces."""
        if not words:
            return
        if len(self._pieces) > 2 * CACHE_WORDS:
            self._pieces = {}
        whole = [w[1:] if w[:1] == b"\xfe" else b" " + w for w in words]
        joined = b"".join(whole)
        ends = np.cumsum(np.fromiter(map(len, whole), np.int64, len(whole)))
        a = np.frombuffer(joined, np.uint8)
        cut = np.empty(len(a), bool)
        cut[:-1] = self.cuts[a[:-1], a[1:]]
        for m in _WIDE_SPACE.finditer(joined):
            cut[m.end() - 1] = False
        cut[ends - 1] = True
        stop = np.flatnonzero(cut) + 1
        of_word = np.searchsorted(stop, ends, side="right").tolist()
        at = [0, *stop.tolist()]
        pieces = [joined[i:j] for i, j in zip(at, at[1:])]
        known = self._pieces
        if new := list({p for p in pieces if p not in known}):
            known.update(zip(new, self._library_pieces(new) if self._encoder else self.encode_pieces(new)))
        begin = 0
        for w, end in zip(words, of_word):
            self._words[w] = known[pieces[begin]] if end == begin + 1 else b"".join(map(known.__getitem__, pieces[begin:end]))
            begin = end

    def _fragments(self, text: str) -> list[bytes]:
        """Text between special tokens to fragments: split before single spaces, or else at every forced cut.
        A fragment is named by what follows its first space; one that doesn't begin with a space has 0xFE before it."""
        b = text.encode("utf-8", "surrogatepass")
        if b"  " in b.translate(self._blank) or not text.isascii() and any(c in text for c in _WIDE):
            return [f[1:] if f[0] == 32 else b"\xfe" + f for f in self.split(b)]
        own = b.split(b" ")
        if own[0]:
            own[0] = b"\xfe" + own[0]
            return own
        return own[1:]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null is empty.  Special tokens' strings become their ids, as by default."""
        out: list[bytes] = []
        i = 0
        while i < len(texts):  # about so many characters are cut up at once
            j, n = i, 0
            while j < len(texts) and n < GROUP:
                n += len(texts[j] or "") + 1
                j += 1
            out += self._encode_group(texts[i:j])
            i = j
        return out

    def _encode_group(self, texts: list[str | None]) -> list[bytes]:
        split: list[list[bytes]] = []
        marks = {}
        for t in texts:
            if t and any(m in t for m in self._marks):
                own: list[bytes] = []
                for k, part in enumerate(self._special.split(t.encode("utf-8", "surrogatepass"))):
                    if k % 2:
                        own.append(b"\xff" + part)  # no text has this byte
                        marks[b"\xff" + part] = self.pack([self.special[part]])
                    elif part:
                        own += self._fragments(part.decode("utf-8", "surrogatepass"))
                split.append(own)
            else:
                split.append(self._fragments(t) if t else [])
        seen = set().union(*split)
        fresh = seen.difference(self._words, marks)
        if len(self._words) + len(fresh) > CACHE_WORDS:
            self._words = {}
            fresh = seen.difference(marks)
        self._learn(list(fresh))
        self._words.update(marks)
        get = self._words.__getitem__
        return [b"".join(map(get, own)) for own in split]

    def forget(self) -> None:
        """Gives the caches' memory back: a worker goes on to other tasks, which need it."""
        self._words, self._pieces = {}, {}

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, bytes that are no UTF-8 replaced; special tokens stay."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def library_encoder(path: str) -> Callable[[list[str]], list[list[int]]]:
    """encode_batch of the tokenizers library on one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@functools.lru_cache(maxsize=4)
def by_own_merges(path: str) -> ByteBPE:
    return ByteBPE(path)


@functools.lru_cache(maxsize=4)
def by_library(path: str) -> ByteBPE:
    return ByteBPE(path, library_encoder(path))


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) of every whole text.

    Null text counts as empty: no ids, empty decoded text.  Rows stay as many as they are, repeated or not;
    other columns are not read, so none can clash.
    """

    def make():
        bpe = by_own_merges(path)

        def one(f: dict[str, list]) -> Iterator[dict[str, list]]:
            ids = [np.frombuffer(b, bpe.dtype) for b in bpe.encode_many(f["text"])]
            yield {"id": f["id"], "ids": [i.astype(np.int32) for i in ids], "decoded": [bpe.decode(i) for i in ids]}

        return one

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return by_batches(rows, make, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """op5's columns: token count, SHA-256 of the decimal ids joined by commas and of the decoded text.

    Digests are made beside the encoding, so the ids of a batch never leave the worker.
    """
    import hashlib

    def make():
        bpe = by_own_merges(path)
        decimal = {i: str(i) for i in bpe.token}
        sha = lambda b: hashlib.sha256(b).hexdigest()

        def one(f: dict[str, list]) -> Iterator[dict[str, list]]:
            n, ids_sha, text_sha = [], [], []
            for b in bpe.encode_many(f["text"]):
                ids = np.frombuffer(b, bpe.dtype).tolist()
                n.append(len(ids))
                ids_sha.append(sha(",".join(map(decimal.__getitem__, ids)).encode()))
                text_sha.append(sha(b"".join(map(bpe.token.__getitem__, ids)).decode("utf-8", "replace").encode()))
            yield {"doc_id": f["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return one

    return by_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
