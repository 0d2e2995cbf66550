"""URL rules, the conversation trie and the filter audit against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from veilframe.llm import filter_audit, prefix_trie, url_rules


def rows_of(df, cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def by_sql(tmp_path, sql, cols, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    return sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall(), key=str)


# urls

def test_hosts_paths_and_listed_rules(spark):
    cases = {
        "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/EN/": ("example.net", "/EN/", "net/", "block"),
        "http://net/": ("net", "/", "net/", "block"),
        "http://planet/": ("planet", "/", None, None),
        "http://a.net": ("a.net", "", None, None),
        "http://a.net?x/": ("a.net", "", None, None),
        "x://y://z.net/": ("y:", "//z.net/", None, None),
        "http://Ö.Example.Com/de/": ("Ö.example.com", "/de/", "example.com/de/", "block"),
        "http://u@a.org:80/fr/": ("u@a.org:80", "/fr/", None, None),
        "http://a.org/fr/\nb": ("a.org", "/fr/\nb", "org/fr/", "allow"),
        "no url": ("", "", None, None), "": ("", "", None, None), "://": ("", "", None, None),
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").withColumn("h", url_rules.host(F.col("url"))).withColumn("p", url_rules.path(F.col("url")))
    got = {r["url"]: (r["h"], r["p"], r["l"] and r["l"]["rule"], r["l"] and r["l"]["verdict"]) for r in df.withColumn("l", url_rules.listed(F.col("h"), F.col("p"))).collect()}
    assert got == cases


def some_urls(seed, n=400):
    r = random.Random(seed)
    host = lambda: ".".join([*r.sample(["www", "m", "shop", "pills"], r.randint(0, 2)), r.choice(["example", "acme", "farm"]), r.choice(["net", "com", "org"])])
    url = lambda: f"{r.choice(['http', 'https'])}://{host()}/{r.choice(['en', 'de', 'fr', 'es'])}/{r.choice(['', 'win-7', 'a/b/c', '12.html'])}{r.choice(['', '?utm=1&ref=2', '?page=3', '#top'])}"
    urls = [url() for _ in range(n)]
    return [(k, u, k) for k, u in enumerate(urls + urls[:50] + [None, "", "no url", "http://x"])] + [(None, urls[0], 1), (3, urls[3], 2)]


@pytest.mark.parametrize("seed", [1, 2])
def test_mined_rules_against_all_combinations(spark, tmp_path, seed):
    pages = spark.createDataFrame(some_urls(seed), "page_id long, url string, tokens long").repartition(3)
    cols = ["page_id", "host", "path", "rule", "verdict"]
    got = rows_of(url_rules.judge(pages), cols)
    assert got == by_sql(tmp_path, url_rules.ORACLE_SQL, cols, pages=pages) and len(got) == pages.count()


def test_labels_rules_and_both_ways_to_match(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        labelled = spark.createDataFrame([(f"http://pills.{k}.com/buy/{k}", "block") for k in range(40)] + [(f"http://news.{k}.com/a/{k}", "allow") for k in range(60)] + [(None, "block"), ("http://x.com/buy", None)], "url string, label string")
        pages = spark.createDataFrame([(1, "http://pills.new.com/x"), (2, "http://good.com/buy/1"), (3, "http://news.com/"), (4, "http://other.org/"), (5, None)], "page_id long, url string")
        got = {r["page_id"]: (r["verdict"], r["rule"]) for r in url_rules.judge(pages, (), labelled).collect()}
        assert got == {1: ("block", None), 2: ("block", None), 3: ("allow", None), 4: ("allow", None), 5: ("allow", None)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_rules.judge(none).count() == 0
    assert url_rules.judge(pages.where("page_id = 4")).first()["verdict"] == "allow"  # nothing is labelled


def test_a_long_url_repeated_everywhere_doesnt_multiply(spark):
    deep = "http://a.net/" + "/".join(f"x{chr(97 + k)}" for k in range(26))
    pages = spark.createDataFrame([(k, deep) for k in range(60)] + [(100 + k, f"http://b{k}.com/de/") for k in range(30)], "page_id long, url string")
    rules = url_rules.mine(pages.select(url_rules.tokens(F.col("url")).alias("items"), F.lit("block").alias("label")))
    assert 0 < rules.select("items").distinct().count() < 50
    assert {r["verdict"] for r in url_rules.judge(pages).where("page_id < 100").collect()} == {"block"}


# conversations

def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    for c in turns:
        turns[c].sort(key=lambda t: (t[0], t[1], hashlib.md5((f"{len(t[2])}:" + t[2] + t[3]).encode()).digest()))
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        whole[c] = tuple(t[2:] for t in turns.get(first, [])[:h]) + tuple(t[2:] for t in turns[c][h:])
    members = defaultdict(list)
    for c, t in whole.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    def below(p):
        return [p] + [q for k in kids[p] for q in below(k)]

    out = []
    for p, m in members.items():
        under = below(p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), sum(not kids[q] for q in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def some_turns(seed, n=120):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        script = r.choice(["ab", "abc", "abcdefgh", "x", "abcdefghij"])
        many = len(script) if r.random() < 0.5 else r.randint(1, 12)
        for t in range(many):
            word = script[t % len(script)] if r.random() < 0.85 else r.choice("äöü")
            rows.append((c, None if r.random() < 0.03 else t, r.choice(["user", "user", None]), None if r.random() < 0.03 else word))
    rows += [rows[0], rows[0], (None, 1, "user", "lost"), (-7, 0, "user", "a"), (-5, 0, "user", "b")]
    return rows + [(1000 + 5 * k, t, "user", "hot") for k in range(40) for t in range(3)]


COLS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize(("seed", "parts", "group", "piece"), [(1, 1, 64, 1 << 20), (2, 7, 64, 12), (3, 40, 3, 1 << 20), (4, 150, 2, 5)])
def test_trie_against_plain_sets(spark, monkeypatch, seed, parts, group, piece):
    """One task, many, more tasks than distinct rows, stitched in one round and in many; runs of ends in pieces."""
    from pyspark import cloudpickle

    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    cloudpickle.register_pickle_by_value(prefix_trie)  # tasks see the patched piece
    try:
        turns = spark.createDataFrame([(*x, "e") for x in some_turns(seed)], "conv_id long, turn long, role string, text string, depth string")
        got = rows_of(prefix_trie.sweep(prefix_trie.rebuilt(turns), parts, group), COLS)
    finally:
        cloudpickle.unregister_pickle_by_value(prefix_trie)
    assert got == plain_trie(some_turns(seed))


def test_trie_sql_deep_and_empty(spark, tmp_path):
    turns = spark.createDataFrame(some_turns(5) + [(2000 + k, t, "user", "deep") for k in range(3) for t in range(700)], "conv_id long, turn long, role string, text string")
    got = rows_of(prefix_trie.trie(turns), COLS)
    assert got == by_sql(tmp_path, prefix_trie.ORACLE_SQL, COLS, conversations=turns)
    assert prefix_trie.trie(turns.where("false")).count() == 0
    one = rows_of(prefix_trie.trie(spark.createDataFrame([(1, 0, None, None)], "conv_id long, turn long, role string, text string")), COLS)
    assert one == plain_trie([(1, 0, None, None)])


# filters

def plain_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least = {}
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    fails = []
    for d, text, source in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": d is not None and d > least[text]}
        fails.append((source or "", {k for k in f if f[k]}, d in good, d in toxic))
    out, share = [], Counter()
    for part in {f[0] for f in fails}:
        own = [f for f in fails if f[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[part, f] += len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), sum(f in x[1] for x in own) - len(gone), sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone), f])
    return sorted((tuple([*o[:-1], share[o[0], o[-1]]]) for o in out), key=str)


def test_audit_against_plain_orders(spark, tmp_path):
    r = random.Random(6)
    long = " ".join(f"w{k}" for k in range(250))
    texts = [long, long + " $", long.upper(), "short", "short #", "", None, "a " * 300, "A B C " * 100, long + "\t\x0bx", "w w " * 150 + "*"]
    docs = [(k, r.choice(texts), r.choice(["s", "s", "t", None])) for k in range(250)] + [(5, long, "s"), (None, "short", "t"), (None, long, "u")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 0, 1])) for k in range(0, 200, 2)] + [(4, 1, 0), (None, 1, 1)]
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], "doc_id long, text string, source string, state int, part string").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    cols = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = rows_of(filter_audit.audit(d, lab), cols)
    want = plain_audit(docs, labels)
    assert got == want == by_sql(tmp_path, filter_audit.ORACLE_SQL, cols, documents=d, labels=lab)
    assert filter_audit.audit(d.where("false"), lab).count() == 0


def test_copies_are_told_hot_or_not(spark, monkeypatch):
    rows = [(k, "hot" if k % 3 else f"t{k % 40}") for k in range(300)]
    df = spark.createDataFrame([(k, t.encode()) for k, t in rows], "doc_id long, digest binary")
    for hot in (2, 1000):
        monkeypatch.setattr(filter_audit, "HOT", hot)
        got = {r["doc_id"]: r["E"] for r in filter_audit.repeats(df).collect()}
        least = {t: min(k for k, x in rows if x == t) for _, t in rows}
        assert got == {k: k > least[t] for k, t in rows}
