"""Trie of conversations that begin alike, swept from one global sort.

A conversation is a row: a 16-byte digest of (role, text) a turn, one behind the other, and the turns' sizes; texts
are not moved.  Rows are range-sorted by those keys and the id, so every node of the trie is one run of rows.  Each
task sweeps its rows with a stack: the longest common prefix of neighbours says which nodes close and which open.
Nodes on the path of a task's first or last row may go on in the task before or behind.  They leave the task as its
fringe, and the same sweep runs over the fringes of neighbouring tasks, ``GROUP`` at a time, until all are closed.
A node's ends are in order of ids, so a run of ends inside a task is hashed there; runs that touch a task's edge are
written as pieces of text and hashed as one stream.

Sweeps are written tables, so a lost executor's work is done again from the sorted rows alone, and nothing reaches
the driver but counts of tasks and bytes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, parts_for, scratch

#: A conversation goes on from the first of its five by so many turns at most.
FAMILY, MOST_SHARED = 5, 9
#: Bytes of a turn's digest; bytes of digests and sizes a task sorts; tasks whose fringes are stitched at once.
WIDTH, PART_BYTES, GROUP = 16, 32 << 20, 64
#: Characters of ids in one piece of a run that is hashed as a stream; rows a sweep gives on at once.
PIECE, ROWS = 1 << 20, 20_000
#: SHA-256 of nothing.
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, size long, ends_sha256 string"
SWEPT = f"kind int, part long, side int, {NODE}, parent_conv_id long, seq long, ids string"
FIELDS = ["node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "ends_sha256"]
#: Kinds of swept rows: a node that is done, one whose parent's conversation isn't known yet, a fringe, a piece of ends.
DONE, LOOSE, FRINGE, ENDS = range(4)
#: Sides of a fringe: the path that first and last row share, the rest of the first's, the rest of the last's.
BOTH, FIRST, LAST = range(3)


def digest(role: Column, text: Column) -> Column:
    """16 bytes that tell a turn from others; nulls are empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, key binary, sizes array<long>) of every conversation of ``turns`` (conv_id, turn, role, text).

    Turns are in order of turn, null first; turns of equal number in order of their digests.  A conversation is its
    family's first turns, as many as are shared, and its own behind as many.  The rows of a family are dealt
    together once.  Rows without conv_id belong to no conversation.
    """
    first = F.col("conv_id") - F.col("conv_id") % FAMILY
    one = F.struct(F.col("turn").isNotNull().alias("known"), "turn", digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").select("conv_id", first.alias("family"), one.alias("one"))
    own = rows.repartition("family").groupBy("family", "conv_id").agg(F.array_sort(F.collect_list("one")).alias("own"))
    lead = F.max(F.when(F.col("conv_id") == F.col("family"), F.slice("own", 1, MOST_SHARED - 1))).over(Window.partitionBy("family"))
    h = shared_turns(F.col("conv_id")).cast("int")
    none = F.filter("own", lambda x: F.lit(False))
    whole = own.withColumn("lead", lead).withColumn("all", F.concat(F.slice(F.coalesce("lead", none), F.lit(1), h), F.slice("own", h + 1, F.size("own"))))
    key = F.unhex(F.array_join(F.transform("all", lambda x: F.hex(x["digest"])), ""))
    return whole.select("conv_id", key.alias("key"), F.transform("all", lambda x: x["size"]).alias("sizes"))


class Node:
    """An open node: what its closed children and ends have added up to."""

    __slots__ = ("children", "conv", "ends", "key", "leaves", "n", "pending", "saved", "size")

    def __init__(self, key, size, conv=None, n=0, children=0, leaves=0, saved=0, ends=None):
        self.key, self.size, self.conv, self.n, self.children, self.leaves, self.saved, self.ends = key, size, conv, n, children, leaves, saved, ends
        self.pending = []

    def take(self, other: "Node") -> None:
        """What another task found of the same node."""
        self.add(other.conv, other.n)
        self.children += other.children
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends

    def add(self, conv, n: int) -> None:
        self.n += n
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv

    def closed(self, parent: "Node | None") -> None:
        """Counts for its subtree are whole now and go up."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size
        if parent is not None:
            parent.add(self.conv, self.n)
            parent.children += 1
            parent.leaves += self.leaves
            parent.saved += self.saved


class Sweep:
    """The stack over neighbouring paths.  ``close(depth, node, parent)`` is told of every node that is done."""

    def __init__(self, close, whole: bool = False):
        self.stack: list[Node] = []
        self.left: list[tuple[int, Node]] = []  # of the first path, left by the paths behind, deepest first
        self.edge = -1 if whole else math.inf  # nodes down to this depth are on the first path
        self.started = False
        self.close = close

    def advance(self, shared: int, path: list[Node]) -> None:
        """To the path that shares nodes down to depth ``shared`` with the one before and has ``path`` below."""
        while len(self.stack) > shared + 1:
            depth, node = len(self.stack) - 1, self.stack.pop()
            if depth <= self.edge:
                self.left.append((depth, node))
            else:
                parent = self.stack[-1] if self.stack else None
                node.closed(parent)
                self.close(depth, node, parent)
        if self.started:
            self.edge = min(self.edge, shared)
        self.started = True
        self.stack.extend(path)

    def fringe(self) -> Iterator[tuple[int, int, Node]]:
        """(side, depth, node) of all nodes that may go on in other tasks."""
        for depth, node in reversed(self.left):
            yield FIRST, depth, node
        for depth, node in enumerate(self.stack):
            yield (BOTH if depth <= self.edge else LAST), depth, node


def _row(kind: int, part: int, side, depth, node: Node | None, parent, parent_conv=None, seq=None, ids=None, key=None) -> tuple:
    if node is None:
        return (kind, part, None, key, None, None, None, None, None, None, None, None, None, None, seq, ids)
    return (kind, part, side, node.key, parent, depth, node.conv, node.n, node.children, node.leaves, node.saved, node.size, node.ends, parent_conv, seq, ids)


_COLUMNS = [f.split()[0] for f in SWEPT.split(", ")]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    f = pd.DataFrame.from_records(rows, columns=_COLUMNS)
    for c in ("kind", "side"):
        f[c] = f[c].astype("Int32")
    for c in ("part", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "parent_conv_id", "seq"):
        f[c] = f[c].astype("Int64")
    return f


def _names(key: bytes) -> list[bytes]:
    """Names of the nodes on a path, the root first: digests of their turns together."""
    h, names = hashlib.md5(), []
    names.append(h.digest())
    for k in range(0, len(key), WIDTH):
        h.update(key[k : k + WIDTH])
        names.append(h.copy().digest())
    return names


def _common(a: bytes, b: bytes) -> int:
    """How many turns two keys begin with alike."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // WIDTH
    x, y = np.frombuffer(a, np.uint8, most), np.frombuffer(b, np.uint8, most)
    return int(np.argmax(x != y)) // WIDTH


class Ends:
    """Ids of a run of equal keys: their hash so far, and those not yet written as a piece.

    Whether the run goes on in the next task is known at its end only, so long runs are written piece by piece; the
    pieces of a run that turns out to lie inside the task are not looked at.
    """

    def __init__(self):
        self.hash, self.held, self.size, self.pieces = hashlib.sha256(), [], 0, 0

    def add(self, conv: str) -> int:
        self.held.append(conv)
        self.size += len(conv) + 1
        return self.size

    def _take(self) -> str:
        ids = ",".join(self.held)
        self.hash.update(("," if self.pieces else "").encode() + ids.encode())
        self.held, self.size = [], 0
        return ids

    def rest(self, part: int, key: bytes) -> list[tuple]:
        if not self.held:
            return []
        row = _row(ENDS, part, None, None, None, None, seq=self.pieces, ids=self._take(), key=_names(key)[-1])
        self.pieces += 1
        return [row]

    def hexdigest(self) -> str:
        if self.held:
            self._take()
        return self.hash.hexdigest()


def _sweep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's sorted rows (key, conv_id, sizes) as nodes, fringe and pieces of ends."""
    part = TaskContext.get().partitionId()
    out: list[tuple] = []

    def close(depth: int, node: Node, parent: Node | None) -> None:
        for child_depth, child in node.pending:
            out.append(_row(DONE, part, None, child_depth, child, None, node.conv))
        node.pending = []
        node.ends = node.ends or NO_ENDS
        parent.pending.append((depth, node))

    sweep, first, last = Sweep(close), None, None
    ends = Ends()
    inner = False  # whether the run of ends began behind the task's first row

    for f in frames:
        for key, conv, sizes in zip(f["key"], f["conv_id"], f["sizes"]):
            key, conv = bytes(key), int(conv)
            if last is None:
                first = key
                sweep.advance(-1, [Node(None, 0), *(Node(None, int(s)) for s in sizes)])
            elif key != last:
                if inner:
                    sweep.stack[-1].ends = ends.hexdigest()
                else:
                    out.extend(ends.rest(part, last))
                ends, inner = Ends(), True
                shared = _common(last, key)
                sweep.advance(shared, [Node(None, int(s)) for s in sizes[shared:]])
            last = key
            sweep.stack[-1].add(conv, 1)
            if ends.add(str(conv)) >= PIECE:
                out.extend(ends.rest(part, key))
            if len(out) >= ROWS:
                yield _frame(out)
                out.clear()
    if last is not None:
        out.extend(ends.rest(part, last))
        names = {FIRST: _names(first), BOTH: _names(last), LAST: _names(last)}
        for side, depth, node in sweep.fringe():
            own = names[side]
            node.key = own[depth]
            for child_depth, child in node.pending:
                out.append(_row(LOOSE, part, None, child_depth, child, node.key))
            node.pending = []
            out.append(_row(FRINGE, part, side, depth, node, own[depth - 1] if depth else None))
            if len(out) >= ROWS:
                yield _frame(out)
                out.clear()
    if out:
        yield _frame(out)
    give_back()


def _stitcher(whole: bool):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        return _stitched(int(key[0]), f, whole)

    return run


def _stitched(part: int, f: pd.DataFrame, whole: bool) -> pd.DataFrame:
    """Fringes of neighbours as nodes that are done between them and one fringe; with ``whole`` nothing lies outside."""
    out: list[tuple] = []
    above: dict[bytes, bytes] = {}

    def close(depth: int, node: Node, parent: Node | None) -> None:
        out.append(_row(LOOSE, part, None, depth, node, None if parent is None else parent.key))

    sweep = Sweep(close, whole)
    f = f.sort_values(["part", "side", "depth"])
    for _, g in f.groupby("part", sort=True):
        paths: dict[int, list[Node]] = {BOTH: [], FIRST: [], LAST: []}
        for r in g.itertuples(index=False):
            conv = None if pd.isna(r.conv_id) else int(r.conv_id)
            paths[int(r.side)].append(Node(bytes(r.node), int(r.size), conv, int(r.n_convs), int(r.n_children), int(r.n_leaves), int(r.saved_tokens), None if pd.isna(r.ends_sha256) else r.ends_sha256))
            above[bytes(r.node)] = None if r.parent is None else bytes(r.parent)
        path = paths[BOTH] + paths[FIRST]
        shared = -1
        for a, b in zip(sweep.stack, path):
            if a.key != b.key:
                break
            a.take(b)
            shared += 1
        sweep.advance(shared, path[shared + 1 :])
        if paths[LAST] or paths[FIRST]:
            sweep.advance(len(paths[BOTH]) - 1, paths[LAST])
    if whole:
        sweep.advance(-1, [])
    for side, depth, node in sweep.fringe():
        out.append(_row(FRINGE, part, side, depth, node, above[node.key]))
    return _frame(out)


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(node, ends) of pieces sorted by node, task and place: each node's pieces as one stream."""
    node, h, out = None, None, []
    for f in frames:
        for name, ids in zip(f["node"], f["ids"]):
            name = bytes(name)
            if name != node:
                if h is not None:
                    out.append((node, h.hexdigest()))
                node, h = name, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        yield pd.DataFrame(out, columns=["node", "ends"])
        out = []
    if h is not None:
        yield pd.DataFrame([(node, h.hexdigest())], columns=["node", "ends"])


def sweep(conversations: DataFrame, parts: int, group: int = GROUP) -> DataFrame:
    """Nodes of the trie over ``conversations`` (conv_id long, key binary, sizes array<long>), as in ``trie``."""
    spark = conversations.sparkSession
    held, swept = scratch(spark, "conversations"), scratch(spark, "swept")
    conversations.write.parquet(held)  # so that bounds are drawn from, and rows dealt from, one and the same table
    rows = spark.read.parquet(held).repartitionByRange(parts, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    rows.select("key", "conv_id", "sizes").mapInPandas(_sweep, SWEPT).write.parquet(swept)
    swept_rows = spark.read.schema(SWEPT).parquet(swept)
    fringe, closed, left = swept_rows.where(F.col("kind") == FRINGE).select(F.lit(0).alias("at"), "part", "side", *FIELDS), [], parts
    while True:
        whole = left <= group
        path = scratch(spark, "stitched")
        fringe.withColumn("at", F.floor(F.col("part") / group).cast("long")).groupBy("at").applyInPandas(_stitcher(whole), SWEPT).write.parquet(path)
        done = spark.read.schema(SWEPT).parquet(path)
        closed.append(done.where(F.col("kind") == LOOSE).select(*FIELDS))
        if whole:
            break
        left = math.ceil(left / group)
        fringe = done.where(F.col("kind") == FRINGE).select(F.lit(0).alias("at"), "part", "side", *FIELDS)
    late = closed[0]
    for c in closed[1:]:
        late = late.unionByName(c)
    pieces = swept_rows.where(F.col("kind") == ENDS).select("node", "part", "seq", "ids")
    ends = pieces.repartition("node").sortWithinPartitions("node", "part", "seq").select("node", "ids").mapInPandas(_hashed, "node binary, ends string")
    # nodes that were open at some task's edge: their ends may have been hashed as a stream, their parents were such nodes too
    path = scratch(spark, "late")
    late.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "ends", F.lit(NO_ENDS))).drop("ends").write.parquet(path)
    late = spark.read.parquet(path)
    up = late.select(F.col("node").alias("parent"), F.col("conv_id").alias("_up"))
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    late = late.join(up, "parent", "left").withColumn("parent_conv_id", F.col("_up")).select(*out)
    # children are told their parent's conversation a task at a time, so no parent's children meet in one place
    known = swept_rows.where(F.col("kind") == FRINGE).select("part", F.col("node").alias("parent")).join(up, "parent")
    loose = swept_rows.where(F.col("kind") == LOOSE).join(known, ["part", "parent"])
    loose = loose.withColumn("parent_conv_id", F.col("_up")).select(*out)
    return swept_rows.where(F.col("kind") == DONE).select(*out).unionByName(loose).unionByName(late)


def trie(turns: DataFrame, group: int = GROUP, part_bytes: int = PART_BYTES) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256), a row a node, the root included; see ``rebuilt`` for what conversations are.

    ``turns`` (conv_id, turn, role, text) may hold nulls, repeated rows and other columns.  No conversations, no
    rows.  A conversation is one row of 24 bytes a turn, however long its texts are.
    """
    spark = turns.sparkSession
    held = scratch(spark, "rebuilt")
    rebuilt(turns).write.parquet(held)
    rows = spark.read.parquet(held)
    total = rows.agg(F.sum(F.length("key") * F.lit(1.5) + 8)).first()[0] or 0
    return sweep(rows, parts_for(spark, int(total), part_bytes), group)


def oracle_sql() -> str:
    """DuckDB SQL for ``trie``: every prefix of every conversation by itself, every node under each node above it."""
    steps = "list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"""
    WITH turn AS (SELECT conv_id, turn, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d, strlen(coalesce(text, '')) AS b FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, list({{'d': d, 'b': b}} ORDER BY turn IS NOT NULL, turn, d) AS own FROM turn GROUP BY conv_id),
    share AS (SELECT *, xor({steps}, 4294967295) % {MOST_SHARED} AS h FROM own),
    whole AS (SELECT s.conv_id, list_concat(coalesce(f.own, [])[1:s.h], s.own[s.h + 1:]) AS t FROM share s LEFT JOIN own f ON f.conv_id = s.conv_id - s.conv_id % {FAMILY}),
    cut AS (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS depth FROM whole),
    member AS (SELECT conv_id, depth, md5(array_to_string(list_transform(t[1:depth], lambda x: x.d), '')) AS node, CASE WHEN depth > 0 THEN md5(array_to_string(list_transform(t[1:depth - 1], lambda x: x.d), '')) END AS parent, CASE WHEN depth > 0 THEN t[depth].b ELSE 0 END AS b, depth = len(t) AS ends FROM cut),
    node AS (SELECT node, any_value(depth) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM member GROUP BY node),
    kids AS (SELECT parent AS node, count(*) AS n_children FROM node WHERE parent IS NOT NULL GROUP BY parent),
    below AS (SELECT m.node, count(*) FILTER (k.n_children IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.b) AS saved FROM node n JOIN member m ON m.conv_id = n.conv_id AND m.depth <= n.depth LEFT JOIN kids k ON k.node = n.node GROUP BY m.node)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
    FROM node n JOIN below b ON b.node = n.node LEFT JOIN kids k ON k.node = n.node LEFT JOIN node p ON p.node = n.parent"""


ORACLE_SQL = oracle_sql()
