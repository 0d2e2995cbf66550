"""Exact Jaccard join on word n-gram sets, by prefix filtering and a prefix tree.

1.  Every document's distinct shingles are hashed and ordered by hash.  By the
    extended prefix filter, two sets that reach the threshold share at least l
    elements among their first n - ceil(t n) + l.  These prefixes go, packed, to
    the partitions that own their hashes, which answer how many of a document's
    prefix elements any other document has too.  Where that is less than l, the
    document links with nothing.  An element that a batch of documents holds more
    than once is counted there and sent on once, so a passage found everywhere
    costs one entry a batch.
2.  Of the others, equal sets are collapsed to one class, and the count is taken
    once more over whole sets.  Elements that many of the remaining sets have come
    last in the order of their prefixes.  Classes that share an element of their
    plain prefix form clusters; sets of different clusters can't link.
3.  A cluster is dealt into blocks by the least element of a set, which near sets
    mostly share; where one element's sets are more than a block holds, they are
    salted by document into blocks of their own.  A block stores its sets in a
    trie along the global order and walks it once a set: overlaps are counted for
    a shared path once, and a subtree is left as soon as what remains can't reach
    the overlap that its lengths need.  Sets already linked with each other are
    not compared again.
4.  Where a cluster has several blocks, one set of each component found is joined
    again, until no block merges; then every set outside its cluster's largest
    component is walked through the cluster's other blocks.  So no link between
    different components is lost, and a huge group of near copies, which is one
    component by then, is not compared pair by pair.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, parts_for, scratch, settings, settled
from .components import components

WORDS = 5
#: Similarity in hundredths.
SIMILAR = 75
#: Share of a set by which its prefix is longer than needed for one common element.
EXTRA = 0.15
#: Documents that make an element hot: it comes last in the order that prefixes are taken in.
HOT = 64
#: Elements a block of a cluster holds, about.
BLOCK = 400_000
_U = np.uint64


@functools.lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.Generator(np.random.PCG64(20240607))
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    return r.integers(1, 1 << 64, 256, dtype=np.uint64) | _U(1), blank


_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW["p"]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, 1 << 20)
        for name, b in (("p", base), ("i", pow(base, -1, 1 << 64))):
            x = np.full(size, _U(b))
            x[0] = 1
            _POW[name] = np.multiply.accumulate(x)
    return _POW["p"][:n], _POW["i"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """Of each text its distinct hashed shingles in ascending order."""
    out: list[np.ndarray] = []
    group: list[bytes] = []
    size = 0
    for t in texts:
        group.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(group[-1])
        if size > 1 << 20:
            out += _group_sets(group, words)
            group, size = [], 0
    return out + (_group_sets(group, words) if group else [])


def _group_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    value, blank = _tables()
    ends = np.cumsum([len(t) + 1 for t in texts])
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    p, inv = _powers(len(a))
    no = blank[a]
    edge = np.flatnonzero(np.diff(no, prepend=True))
    start, stop = edge[::2], edge[1::2]
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(value[a] * p, out=total[1:])
    h = _mix((total[stop] - total[start]) * inv[start] + (stop - start).astype(np.uint64))
    first = np.searchsorted(start, ends - np.array([len(t) + 1 for t in texts]))
    last = np.searchsorted(start, ends)
    s = np.zeros(max(0, len(h) - words + 1), np.uint64)
    for k in range(words):
        s = s * _U(0xD6E8FEB86659FD93) + h[k : k + len(s)]
    s = _mix(s)
    sets = []
    for i, j in zip(first.tolist(), last.tolist()):
        if j - i >= words:
            sets.append(np.unique(s[i : j - words + 1]))
        elif j > i:
            one = np.array([j - i], np.uint64)
            for k in range(i, j):
                one = _mix(one * _U(0xA0761D6478BD642F) + h[k : k + 1])
            sets.append(one)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def needed(n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Least overlap of sets of these sizes at the threshold: the least o with 100 o >= t (n + m - o)."""
    return -(-SIMILAR * (n + other) // (100 + SIMILAR))


def prefix_length(n: int) -> int:
    """Elements among which two linked sets must share one."""
    return n - -(-SIMILAR * n // 100) + 1


def _extra(n: int) -> int:
    return max(1, int(EXTRA * n))


def shared_counts(docs: DataFrame, parts: int, whole: bool = False) -> DataFrame:
    """(doc_id, n, shared, hot): set size, how many elements other documents have too, and which of them are hot.

    From documents (doc_id, text) the long prefixes are compared.  With ``whole``, docs are sets (doc_id, elements),
    all of whose elements are compared, and ``hot`` lists the elements that HOT documents or more have.
    """
    repeat = HOT if whole else 2  # so many in a batch are counted there and sent on as one entry

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        batch = 0
        for f in frames:
            if not len(f):
                continue
            sets = [np.frombuffer(b, "<u8") for b in f["elements"]] if whole else shingle_sets(f["text"].tolist())
            ns = np.array([len(s) for s in sets])
            long = [n if whole else min(n, prefix_length(n) - 1 + _extra(n)) if n else 0 for n in ns.tolist()]
            tok = np.concatenate([s[:p] for s, p in zip(sets, long)])
            loc = np.repeat(np.arange(len(sets)), long)
            order = np.argsort(tok, kind="stable")
            tok, loc = tok[order], loc[order]
            begin = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.empty(0, np.int64)
            many = np.diff(np.r_[begin, len(tok)])
            times = np.repeat(many, many)
            again = times >= repeat
            here = np.bincount(loc[again], minlength=len(sets))
            hot = [(loc[again].astype("<i4").tobytes() + tok[again].astype("<u8").tobytes()) if whole else b""]
            keep = ~again
            keep[begin] = True
            loc, count = np.where(again, -1, loc)[keep].astype("<i2" if len(sets) < 1 << 15 else "<i4"), np.where(again, times, 1)[keep].astype("<i4")
            tok = tok[keep]
            part = ((tok & _U(0xFFFFFFFF)) * _U(parts) >> _U(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
            ids, sizes = f["doc_id"].to_numpy("<i8").tobytes(), ns.astype("<i4").tobytes()
            # the same ids may stand in several batches, so a batch's name has its place too
            place = np.array([TaskContext.get().partitionId(), batch], "<i8").tobytes()
            name = int.from_bytes(hashlib.blake2b(place + ids, digest_size=8).digest(), "little", signed=True)
            rows = []
            for k, (i, j) in enumerate(zip(cut, cut[1:])):
                own = k == batch % parts
                if j > i or own:
                    at = order[i:j]
                    rows.append((k, name, ids if own else b"", len(sets), sizes if own else b"", tok[at].astype("<u8").tobytes(), loc[at].tobytes(), count[at].tobytes() if whole else b"", here.astype("<i4").tobytes() if own else b"", hot[0] if own else b""))
            batch += 1
            give_back()
            yield pd.DataFrame(rows, columns=["part", "batch", "ids", "many", "ns", "tok", "loc", "count", "here", "hot"])

    def answer(f: pd.DataFrame) -> pd.DataFrame:
        tok = [np.frombuffer(b, "<u8") for b in f["tok"]]
        flat = np.concatenate(tok)
        order = np.argsort(flat, kind="stable")
        held = flat[order]
        begin = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.empty(0, np.int64)
        count = np.concatenate([np.frombuffer(b, "<i4") for b in f["count"]]).astype(np.int64) if whole else np.ones(len(flat), np.int64)
        total = np.empty(len(flat), np.int64)
        if len(flat):
            total[order] = np.repeat(np.add.reduceat(count[order], begin), np.diff(np.r_[begin, len(held)]))
        out, at = [], 0
        for t, loc, many, batch, ids, ns, here, hot in zip(tok, f["loc"], f["many"], f["batch"], f["ids"], f["ns"], f["here"], f["hot"]):
            loc = np.frombuffer(loc, "<i2" if many < 1 << 15 else "<i4")
            df = total[at : at + len(t)]
            at += len(t)
            waits = loc >= 0
            number = np.bincount(loc[(df > 1) & waits], minlength=many)
            if here:
                number = number + np.frombuffer(here, "<i4")
            busy = (df >= HOT) & waits if whole else np.zeros(len(t), bool)
            more = loc[busy].astype("<i4").tobytes() + t[busy].tobytes()
            some = np.flatnonzero(number)
            out.append((batch, ids, ns, some.astype("<i4").tobytes() + number[some].astype("<i4").tobytes(), [b for b in (more, hot) if b]))
        give_back()
        return pd.DataFrame(out, columns=["batch", "ids", "ns", "number", "hot"])

    def gather(f: pd.DataFrame) -> pd.DataFrame:
        """What all partitions answered one batch."""
        first = f[f["ids"].map(len) > 0]
        if not len(first):
            return pd.DataFrame({"doc_id": [], "n": [], "shared": [], "hot": []})
        ids, ns = np.frombuffer(first["ids"].iloc[0], "<i8"), np.frombuffer(first["ns"].iloc[0], "<i4")
        number = np.zeros(len(ids), np.int64)
        for b in f["number"]:
            n = len(b) // 8
            number += np.bincount(np.frombuffer(b, "<i4", n), np.frombuffer(b, "<i4", n, 4 * n), minlength=len(ids)).astype(np.int64)
        doc, element = [np.empty(0, np.int64)], [np.empty(0, "<u8")]
        for b in (x for own in f["hot"] for x in own):
            n = len(b) // 12
            doc.append(np.frombuffer(b, "<i4", n).astype(np.int64))
            element.append(np.frombuffer(b, "<u8", n, 4 * n))
        doc, element = np.concatenate(doc), np.concatenate(element)
        by = np.argsort(doc, kind="stable")
        cut = np.searchsorted(doc[by], np.arange(len(ids) + 1)).tolist()
        return pd.DataFrame({"doc_id": ids, "n": ns, "shared": number, "hot": [element[by[i:j]].tobytes() for i, j in zip(cut, cut[1:])]})

    sent = docs.mapInPandas(send, "part int, batch long, ids binary, many int, ns binary, tok binary, loc binary, count binary, here binary, hot binary")
    back = sent.groupBy("part").applyInPandas(answer, "batch long, ids binary, ns binary, number binary, hot array<binary>")
    back = back.groupBy("batch").applyInPandas(gather, "doc_id long, n long, shared long, hot binary")
    hot = [F.filter(F.collect_list("hot"), lambda b: F.length(b) > 0).alias("hot")] if whole else []
    return back.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("shared").alias("shared"), *hot)


class Trie:
    """Sets along the global order, paths without branches kept as one edge."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets])
        order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.root = self._build(order)

    def _build(self, order: list[int]) -> tuple:
        """(tokens of the edge, least size, largest size, sets that end here, children), built from the top down."""
        top: list = []
        todo = [(order, 0, top)]
        while todo:
            order, depth, into = todo.pop()
            a, b = self.sets[order[0]], self.sets[order[-1]]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[depth:m] != b[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            sizes = self.size[order]
            ends = [k for k in order if self.size[k] == end]
            rest = [k for k in order if self.size[k] > end]
            kids: list = []
            into.append((a[depth:end], int(sizes.min()), int(sizes.max()), ends, kids))
            i = 0
            while i < len(rest):
                j = i + 1
                while j < len(rest) and self.sets[rest[j]][end] == self.sets[rest[i]][end]:
                    j += 1
                todo.append((rest[i:j], end, kids))
                i = j
        return top[0]

    def matches(self, query: np.ndarray, skip) -> Iterator[int]:
        """Sets that reach the threshold with ``query``; ``skip(k)`` leaves one out before its overlap is known."""
        n = len(query)
        stack = [(self.root, 0, 0)]
        while stack:
            (edge, least, most, ends, kids), depth, overlap = stack.pop()
            if 100 * min(n, most) < SIMILAR * max(n, least) and (most < n or least > n):
                continue
            if not kids and all(skip(k) for k in ends):
                continue
            if len(edge):
                at = np.searchsorted(query, edge)
                overlap += int((query[np.minimum(at, n - 1)] == edge).sum())
                depth += len(edge)
                behind = n - int(np.searchsorted(query, edge[-1], side="right"))
            else:
                behind = n
            for k in ends:
                if not skip(k) and overlap >= needed(n, depth):
                    yield k
            if kids and overlap + min(behind, most - depth) >= needed(n, max(least, depth)):
                stack += [(kid, depth, overlap) for kid in kids]


def _find(root: list[int], k: int) -> int:
    while root[k] != k:
        root[k] = root[root[k]]
        k = root[k]
    return k


def join_block(f: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that connect all sets of a block which links connect: at most one less than it has sets."""
    ids = f["doc_id"].tolist()
    sets = [np.frombuffer(b, "<u8") for b in f["elements"]]
    root = list(range(len(ids)))
    links = []
    if len(ids) > 1:
        trie = Trie(sets)
        for i, s in enumerate(sets):
            for j in trie.matches(s, lambda k, i=i: k <= i or _find(root, k) == _find(root, i)):
                root[_find(root, j)] = _find(root, i)
                links.append((ids[i], ids[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def probe_block(f: pd.DataFrame) -> pd.DataFrame:
    """Links between a block's sets and the probes dealt to it, one for each component that a probe meets."""
    links: list[tuple] = []
    probes, held = f[f["probe"]], f[~f["probe"]]
    if len(probes) and len(held):
        trie = Trie([np.frombuffer(b, "<u8") for b in held["elements"]])
        ids, comp = held["doc_id"].tolist(), held["component"].tolist()
        for key, own, b in zip(probes["doc_id"], probes["component"], probes["elements"]):
            met = {own}
            for j in trie.matches(np.frombuffer(b, "<u8"), lambda k, met=met: comp[k] in met):
                met.add(comp[j])
                links.append((key, ids[j]))
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


#: Bytes up to which a side is broadcast, after its rows were written and their size was taken.
SMALL = 48 << 20


def _side(df: DataFrame, row_bytes: int = 96) -> DataFrame:
    """df settled, and marked to be broadcast if it is small; else Spark joins it by shuffling."""
    df = settled(df)
    return F.broadcast(df) if df.count() * row_bytes <= SMALL else df


def _sets_of(docs: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            sets = shingle_sets(f["text"].tolist())
            yield pd.DataFrame({"doc_id": f["doc_id"], "n": [len(s) for s in sets], "elements": [s.astype("<u8").tobytes() for s in sets]})

    return docs.mapInPandas(run, "doc_id long, n long, elements binary")


def _block_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    dealt = sets.select("doc_id", "elements").join(_side(members.select("doc_id", "cluster", "block")), "doc_id")
    return dealt.groupBy("cluster", "block").applyInPandas(lambda f: join_block(f), "a long, b long")


def _deal(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """members (doc_id, n, least, cluster) with blocks, about how many their cluster has, and the block of each.

    Sets with the same least element share a block, up to ``block`` elements; more than that are salted by doc_id.
    """
    by_least = members.groupBy("cluster", "least").agg(F.sum("n").alias("own"))
    size = by_least.groupBy("cluster").agg(F.ceil(F.sum("own") / F.lit(block)).cast("long").alias("blocks"))
    large = by_least.where(F.col("own") > block).select("cluster", "least", F.ceil(F.col("own") / F.lit(block)).cast("long").alias("salts"))
    dealt = members.join(size, "cluster").join(large, ["cluster", "least"], "left")
    alone = F.xxhash64("least", F.pmod(F.xxhash64("doc_id"), "salts"))
    return dealt.withColumn("block", F.when(F.col("salts").isNull(), F.pmod(F.xxhash64("least"), "blocks")).otherwise(alone)).drop("salts")


def links(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((doc_id, n) of every document, links (a, b) whose components are those of all links)."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    path = scratch(spark, "shingle-counts")
    shared_counts(rows, parts_for(spark, total, 16 << 20)).write.parquet(path)
    counts = spark.read.parquet(path)
    # A partner has at least ceil(t n) elements, so the two prefixes share what the smaller set's length asks for.
    partner = F.ceil(F.col("n") * SIMILAR / 100)
    maybe = counts.where((F.col("n") > 0) & (F.col("shared") >= F.greatest(F.lit(1), F.floor(partner * EXTRA))))
    sets = settled(_sets_of(rows.join(_side(maybe.select("doc_id")), "doc_id", "left_semi")))
    print_of = F.sha2("elements", 256)
    repeated = sets.groupBy("doc_id").count().where("count > 1")
    classes = settled(sets.groupBy(print_of.alias("print")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    copies = sets.select("doc_id", print_of.alias("print")).join(classes.where("copies > 1"), "print").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    one = classes.select(F.col("first").alias("doc_id"), "print").join(classes.groupBy("first").agg(F.min("print").alias("print")), ["print"], "left_semi")
    sets = sets.withColumn("print", print_of).join(_side(one, 192), ["doc_id", "print"], "left_semi").drop("print")
    if repeated.limit(1).count():
        sets = settled(sets.dropDuplicates(["doc_id"]))

    # Once more among these, over whole sets: a linked set shares its size times the threshold with some other.
    size = sets.agg(F.sum("n")).first()[0] or 0
    again = shared_counts(sets.select("doc_id", "elements"), parts_for(spark, 10 * size, 16 << 20), whole=True)
    near = again.where(F.col("shared") >= F.ceil(F.col("n") * SIMILAR / 100)).select("doc_id", "hot")
    sets = settled(sets.join(near, "doc_id"))  # the sets that are left, all that is moved from here on

    def prefixes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = []
            for b, n, hot in zip(f["elements"], f["n"], f["hot"]):
                e = np.frombuffer(b, "<u8")
                last = np.isin(e, np.concatenate([np.frombuffer(h, "<u8") for h in hot])) if len(hot) else np.zeros(n, bool)
                own.append(np.r_[e[~last], e[last]][: prefix_length(n)].view("<i8"))
            size = [len(x) for x in own]
            rest = [n - np.arange(k) for n, k in zip(f["n"], size)]  # elements from this one on
            yield pd.DataFrame({"doc_id": np.repeat(f["doc_id"].to_numpy(), size), "element": np.concatenate(own) if own else [], "rest": np.concatenate(rest) if own else []})

    prefix = settled(sets.select("doc_id", "n", "elements", "hot").mapInPandas(prefixes, "doc_id long, element long, rest int"))
    stars = prefix.groupBy("element").agg(F.min("doc_id").alias("a"), F.count("*").alias("many")).where("many > 1")
    together = prefix.join(stars, "element").select("a", F.col("doc_id").alias("b")).where("a <> b").distinct()
    cluster = components(together).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    least = F.substring("elements", 1, 8).alias("least")
    members = settled(_deal(cluster.join(sets.select("doc_id", "n", least), "doc_id"), block))
    found = settled(_block_links(members, sets))

    # Clusters of several blocks: join one set of each component again, until nothing merges.
    wide = settled(members.where("blocks > 1"))
    if wide.limit(1).count():
        while True:
            label = settled(_labels(wide, found))
            heads = label.groupBy("cluster", "component").agg(F.min(F.struct("n", "doc_id", "least")).alias("h")).select("cluster", "h.doc_id", "h.n", "h.least")
            heads = _deal(heads.join(heads.groupBy("cluster").count().where("count > 1").select("cluster"), "cluster"), block)
            more = settled(_block_links(heads, sets))
            if not more.limit(1).count():
                break
            found = settled(found.unionByName(more))
        size = label.groupBy("cluster", "component").count()
        main = size.groupBy("cluster").agg(F.max(F.struct("count", "component")).alias("m")).select("cluster", F.col("m.component").alias("main"))
        minor = label.join(main, "cluster").where("component <> main")
        # A probe goes to those blocks that hold a set of another component with an element of its prefix, if that
        # may be their first common one: sizes are near enough, and as much follows it in both as they must share.
        placed = prefix.join(_side(label.select("doc_id", "cluster", "block", "component", "n"), 128), "doc_id")
        # sets of about one size together, so that the filter by sizes stays sharp
        there = placed.groupBy("element", F.col("block").alias("to"), F.floor(F.log(1.2, "n")).alias("about")).agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least_n"), F.max("n").alias("most_n"), F.max("rest").alias("most_rest")
        )
        fits = (F.col("least_n") * SIMILAR <= 100 * F.col("n")) & (F.col("n") * SIMILAR <= 100 * F.col("most_n"))
        fits &= (100 + SIMILAR) * F.least("rest", "most_rest") >= SIMILAR * (F.col("n") + F.greatest("least_n", F.ceil(F.col("n") * SIMILAR / 100)))
        crossing = there.groupBy("element").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x <> y").select("element")
        other = (F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))
        probes = placed.join(minor.select("doc_id"), "doc_id", "left_semi").join(crossing, "element", "left_semi").join(there, "element").where("to <> block").where(other & fits)
        probes = probes.select("cluster", F.col("to").alias("block"), "doc_id", "component", F.lit(True).alias("probe")).distinct()
        probes = settled(probes)
        held = label.join(probes.select("cluster", "block").distinct(), ["cluster", "block"], "left_semi").select("cluster", "block", "doc_id", "component", F.lit(False).alias("probe"))
        met = sets.select("doc_id", "elements").join(_side(probes.unionByName(held), 128), "doc_id")
        cross = met.groupBy("cluster", "block").applyInPandas(lambda f: probe_block(f), "a long, b long")
        found = settled(found.unionByName(cross))
    return counts.select("doc_id", "n"), found.unionByName(copies)


def _labels(members: DataFrame, found: DataFrame) -> DataFrame:
    of = components(found).withColumnRenamed("node", "doc_id")
    return members.join(of, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def join(docs: DataFrame) -> DataFrame:
    """op8: doc_id, n_shingles, component_id of every document.

    Null, empty and wordless texts have no shingle and are alone.  doc_id is a key: rows that repeat it are one
    document, linked by any of its rows; rows without doc_id stay as many as they are, in no component (null).
    Equal sets always link.  Columns other than doc_id and text are not read; an empty table has no rows.
    """
    settings(docs.sparkSession)
    sizes, found = links(docs)
    of = components(found).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "component_id")
    named = sizes.join(of, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = docs.where("doc_id is null").select(F.lit(0).cast("long").alias("doc_id"), "text")
    return named.unionByName(_sets_of(nameless).select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh
  FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
k AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT k.b, r.c FROM r JOIN k ON k.a = r.v)
SELECT n.doc_id, n.n AS n_shingles, min(r.c) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY ALL
"""
