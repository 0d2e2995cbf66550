"""The n-gram Jaccard join against all pairs."""

import random
import re

import pytest

from veilframe.llm import ngram_join


def brute(rows):
    sets = {}
    for key, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[key] = grams
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 75 * (len(sets[a]) + len(sets[b]) - o):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {(k, len(sets[k]), find(k)) for k in keys}


def corpus(seed, n=160):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(r.randint(6, 80))] for _ in range(12)]
    rows = []
    for k in range(n):
        t = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            t[r.randrange(len(t))] = word()
        if r.random() < 0.2:
            t = passage + t
        if r.random() < 0.1:
            t = [word() for _ in range(r.randint(1, 9))]
        rows.append((k, " ".join(w.upper() if r.random() < 0.1 else w for w in t)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "one two"), (n + 4, "ONE\ttwo"), (n + 5, "one two three four five"), (n + 6, "é É ü Ü ß")]


@pytest.mark.parametrize(("seed", "block"), [(1, 400_000), (2, 300)])
def test_same_components_as_all_pairs(spark, monkeypatch, seed, block):
    rows = corpus(seed)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, n string, cluster int").repartition(5)
    counts, found = ngram_join.links(docs, block)
    from veilframe.llm.components import components

    of = {r["node"]: r["component"] for r in components(found).collect()}
    got = {(r["doc_id"], r["n"], of.get(r["doc_id"], r["doc_id"])) for r in counts.collect()}
    assert got == brute(rows)


def test_empty_table_and_repeated_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.join(none).count() == 0
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.join(rows).collect()), key=str) == [(1, 2, 1), (2, 2, 1), (None, 2, None)]


@pytest.mark.parametrize("turned", [False, True])
def test_an_id_repeated_over_batches(spark, turned):
    """Two partitions of one and the same id: sizes are its largest text's, whichever comes first."""
    rows = [(5, "a b c d e f g h i"), (5, "a b c d e"), (6, "a b c d e f g h i")]
    parts = [spark.createDataFrame([r], "doc_id long, text string").coalesce(1) for r in (rows[::-1] if turned else rows)]
    docs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert sorted(map(tuple, ngram_join.join(docs).collect())) == [(5, 5, 5), (6, 5, 5)]


def test_large_groups_of_one_least_element_are_salted(spark):
    rows = [(k, 100, 7 if k < 500 else k, 0) for k in range(600)]
    dealt = ngram_join._deal(spark.createDataFrame(rows, "doc_id long, n long, least long, cluster long"), 5000)
    assert dealt.where("blocks <> 12").count() == 0
    assert max(r["count"] for r in dealt.where("least = 7").groupBy("block").count().collect()) <= 75


def test_trie_of_one_long_path():
    """A thousand nested sets are one branch a set: neither building nor walking is limited by depth."""
    import numpy as np

    base = np.arange(1, 3001, dtype=np.uint64)
    sets = [base[: 1000 + 2 * k] for k in range(1000)]
    found = set(ngram_join.Trie(sets).matches(sets[0], lambda k: False))
    assert found == {k for k, s in enumerate(sets) if 100 * 1000 >= 75 * len(s)}


def test_components_take_no_more_rounds_than_the_edges_ask_for(spark, monkeypatch):
    from veilframe.llm import components as C

    calls = []
    monkeypatch.setattr(C, "settled", lambda df: calls.append(1) or df.checkpoint(eager=True))
    path = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (7, 7)], "a long, b long").repartition(3)
    want = {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}
    monkeypatch.setattr(C, "AT_ONCE", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    assert {r["node"]: r["component"] for r in C.components(path).collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3000")
    calls.clear()
    monkeypatch.setattr(C, "AT_ONCE", 1 << 19)
    assert {r["node"]: r["component"] for r in C.components(path.coalesce(1)).collect()} == want
    assert len(calls) == 1
    assert C.components(path.limit(0)).collect() == []
