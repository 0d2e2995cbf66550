"""Models trained here: held-out accuracy, and statistics against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from veilframe.llm import embedding_forest, language, mixing, toxicity

STOCK = {"en": "the of and in to is that with for this", "de": "der die und nicht für über schön eine mit das", "fr": "le la été être que pour dans une avec où", "es": "el los qué niño año con una para está más"}


def corpus(n=240, seed=2):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        lang = r.choice(list(STOCK))
        words = [r.choice(STOCK[lang].split()) for _ in range(r.randint(5, 60))]
        toxic = r.random() < 0.3
        if toxic:
            words[r.randrange(len(words))] = "clown idiot"
        rows.append((k, " ".join(words), lang, int(toxic)))
    return rows


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "12345 !!!"), (904, "A" * 50_000), (905, "one\u0000two")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, lang, "x", 1.0, True) for k, t, lang, _ in corpus()] + [(k, t, None, None, None, None) for k, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, base double, training boolean").repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, t) for k, _, _, t in corpus()], "doc_id long, quality int, toxic int")


def held(k, of, which):
    return zlib.crc32(str(k).encode()) % of == which


def test_language_of_held_out_texts(docs):
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert len(got) == len(corpus()) + len(ODD)
    own = [(k, lang) for k, _, lang, _ in corpus() if held(k, 3, 1)]
    assert all(got[k]["held_out"] == held(k, 3, 1) for k in got)
    assert sum(got[k]["lang_pred"] == lang for k, lang in own) / len(own) > 0.95
    assert {got[k]["lang_pred"] for k in (900, 901, 902, 903)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_of_held_out_texts(docs, labels):
    got = {r["doc_id"]: r for r in toxicity.detect(docs, labels).collect()}
    assert len(got) == len(corpus()) + len(ODD)
    own = [(k, t) for k, _, _, t in corpus() if held(k, 4, 2)]
    assert sum(got[k]["predicted"] == t for k, t in own) / len(own) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_nothing_to_learn_from(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.detect(docs, none).collect())
    bare = docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r["lang_pred"] for r in language.identify(bare).collect()} == {"und"}
    empty = docs.limit(0)
    assert language.identify(empty).count() == toxicity.detect(empty, none).count() == mixing.score(empty).count() == 0


def test_unigram_base_and_learned_score(docs):
    texts = {k: t for k, t, _, _ in corpus()} | dict(ODD)
    tokens = {k: [*re.findall(rb"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or "").encode()), None] for k, t in texts.items()}
    count = Counter(w for k, own in tokens.items() if not held(k, 7, 2) for w in own)
    n, v = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in mixing.score(docs).collect()}
    assert set(got) == set(texts)
    for k, own in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(k, 7, 2), len(own), sum(count[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel_tol=1e-9)
        assert r["score"] < 0
    fold = [got[k] for k, _, _, _ in corpus() if held(k, 7, 2)]
    assert sum(r["score"] for r in fold) > sum(r["base_score"] for r in fold)


def brute_links(rows):
    good = {k: v for k, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    of = {k: label for k, _, label in rows}
    near = {k: [] for k, _, _ in rows}
    for a in good:
        for b in good:
            if a < b and of[a] == of[b] and len(good[a]) == len(good[b]):
                dot = sum(x * y for x, y in zip(good[a], good[b]))
                if dot / math.sqrt(sum(x * x for x in good[a]) * sum(x * x for x in good[b])) >= 0.98:
                    near[a].append(b)
                    near[b].append(a)
    out = {}
    for k in near:
        seen, stack = {k}, [k]
        while stack:
            for m in near[stack.pop()]:
                if m not in seen:
                    seen.add(m)
                    stack.append(m)
        out[k] = (len(near[k]), min(seen))
    return out


def test_forest_links_near_vectors(spark):
    r = random.Random(6)
    rows = []
    for k in range(60):
        base = [r.gauss(0, 1) for _ in range(16)]
        for j in range(r.choice([1, 1, 2, 6])):
            rows.append((len(rows), [x + r.gauss(0, 0.02) * (j > 1) for x in base], k % 3))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, [None] * 16, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([(*x, "x") for x in rows], "vec_id long, embedding array<float>, label int, component string").repartition(4)
    exact = [(k, list(v) if v is not None else None, label) for k, v, label, _ in df.collect()]
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in embedding_forest.link(df).collect()}
    want = brute_links(exact)
    assert set(got) == set(want)
    pairs = sum(a for a, _ in want.values())
    assert sum(a for a, _ in got.values()) >= 0.97 * pairs
    assert all(got[k][0] <= want[k][0] for k in want)
    assert embedding_forest.link(df.limit(0)).count() == 0


def test_forest_counts_every_pair_once_and_finds_nearly_all(spark):
    """Leaves of several levels, planted pairs and a large group of near copies, against all pairs."""
    import numpy as np

    r = np.random.default_rng(8)
    x = r.standard_normal((3000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    shift = r.standard_normal((900, 24)) / 24**0.5
    x[2100:] = x[:900] + shift * np.repeat([0.02, 0.12, 0.19], 300)[:, None]
    x[1200:1500] = x[1200] + 0.02 * r.standard_normal((300, 24))
    label = np.where(np.arange(3000) % 50 == 0, 1, 0)
    rows = [(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, label))] + [(None, x[0].tolist(), 0), (4000, None, 0), (4001, x[5].tolist(), None)]
    got = {q["vec_id"]: q for q in embedding_forest.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), leaf=100, block=130).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(near, False)
    found = sum(got[k]["n_links"] for k in range(3000))
    assert 0.95 * near.sum() <= found <= near.sum() and all(got[k]["n_links"] <= near[k].sum() for k in range(3000))
    assert all(near[k].any() or got[k]["component_id"] == k for k in range(3000))
    assert got[None]["n_links"] == got[4000]["n_links"] == got[4001]["n_links"] == 0 and got[4001]["component_id"] == 4001


def test_forest_finds_nearly_all_at_ten_levels(spark):
    """Leaves of eight of 8000 vectors, pairs planted at cosines down to the threshold, against all pairs."""
    import numpy as np

    r = np.random.default_rng(9)
    n, planted = 8000, 2400
    x = r.standard_normal((n, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[n - planted :] = x[:planted] + r.standard_normal((planted, 32)) / 32**0.5 * np.repeat([0.05, 0.12, 0.18, 0.195], planted // 4)[:, None]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.98
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = embedding_forest.link(df, leaf=8).agg({"n_links": "sum"}).first()[0]
    assert 0.9 * near.sum() <= found <= near.sum()


def test_tables_are_the_network():
    import numpy as np

    net = language.Network(["a", "b", "c"], seed=4)
    r = random.Random(4)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 2, 50, language.WINDOW - 3, language.WINDOW, 1000)]
    for t, p in zip(texts, net.tabled().probabilities(texts)):
        n = -(-(len(t) + language._PAD) // language.WINDOW)
        full = t.ljust(n * language.WINDOW, b"\0")
        sums, weights = np.zeros(3), 0.0
        for w in range(n):
            seen = full[w * language.WINDOW : (w + 1) * language.WINDOW + language._PAD]
            tops = []
            for width in language.WIDTHS:
                places = range(language.WINDOW if w < n - 1 else language.WINDOW - language._PAD)
                resp = [sum(net.p["embed"][seen[i + j]] @ net.p[f"k{width}"][j] for j in range(width)) for i in places]
                tops.append(np.max(resp, axis=0) + net.p[f"b{width}"])
            z = np.maximum(np.concatenate(tops), 0) @ net.p["out"] + net.p["bias"]
            z = np.exp(z - z.max())
            own = language.WINDOW if w < n - 1 else max(1, len(t) - (n - 1) * language.WINDOW)
            sums += own * z / z.sum()
            weights += own
        assert np.allclose(sums / weights, p, atol=1e-4)


def test_kneser_ney_by_dictionaries():
    """Differences of words against a plain recursion over counted grams."""
    toxic, plain = ["idiot clown idiot", "clowns"], ["the cow", "a clown in the circus", "the"]
    model = toxicity.Model(toxic, plain)
    k_max, d = toxicity.ORDER, toxicity.DISCOUNT
    padded = lambda w: bytes([2] * (k_max - 1)) + w + b"\3"
    seen = [Counter(w for t in texts for w in set(toxicity.words(t))) for texts in (toxic, plain)]
    grams = {k_max: {padded(w)[i - k_max : i] for c in seen for w in c for i in range(k_max, len(padded(w)) + 1)}}
    low = {}
    for k in range(k_max - 1, 0, -1):
        low[k] = Counter(g[1:] for g in grams[k + 1])
        grams[k] = set(low[k])

    def prob(gram, counts, k):
        rest = prob_low(gram[1:], k - 1) if k > 1 else 1 / 256
        own = {g: n for g, n in counts.items() if g[:-1] == gram[:-1]}
        if not own:
            return rest
        total = sum(own.values())
        if gram in own:
            return (own[gram] - d) / total + d * len(own) / total * rest
        return d * len(own) / total * rest

    def prob_low(gram, k):
        return prob(gram, low[k], k) if k else 1 / 256

    top = [Counter() for _ in seen]
    for counts, c in zip(top, seen):
        for w, n in c.items():
            for i in range(k_max, len(padded(w)) + 1):
                counts[padded(w)[i - k_max : i]] += n
    for word in (b"idiot", b"clown", b"clowning", b"zebra", b"the", b"cows"):
        p = padded(word)
        want = sum(math.log(prob(p[i - k_max : i], top[0], k_max)) - math.log(prob(p[i - k_max : i], top[1], k_max)) for i in range(k_max, len(p) + 1))
        assert abs(model.ratios([[word]])[0][0] - want) < 1e-6
