"""Toxicity by class-conditional Kneser-Ney models.

Two models of the letters of words, of toxic and of ordinary documents, are
compared.  Each predicts a letter from the letters before it in its word; what a
class hasn't seen backs off to shorter contexts, whose continuation counts both
classes share.  So a rare expression, or a new form of a known stem, weighs as
far as its class saw its parts, and no further.  A word counts once a document.
The difference of both log-likelihoods is taken per word: over the whole text
and over its most toxic stretches, since a few words among thousands make a text
toxic.  A logistic function, fitted on documents that the counts didn't see,
turns these into a score.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, settings
from .samples import labelled_sample

#: Documents of each class that the models are fitted on; of these, the share that fits the logistic function.
PER_CLASS = 4_000
CALIBRATE = 0.35
DISCOUNT = 0.75
#: Letters of the longest gram; words whose difference a task remembers; words of a stretch.
ORDER = 6
CACHE = 400_000
CHUNK = 1 << 20
STRETCH = 30
THRESHOLD = 0.3
_WORDS = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Lower-cased words without ASCII punctuation."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()


class Model:
    """Log-likelihood differences of words: positive where the toxic model finds a word likelier."""

    def __init__(self, toxic: Iterable[str | None], ordinary: Iterable[str | None]):
        counts: list[dict[bytes, int]] = [{}, {}]
        for seen, texts in zip(counts, (toxic, ordinary)):
            for t in texts:
                for w in set(words(t)):
                    seen[w] = seen.get(w, 0) + 1
        every = sorted(set().union(*counts))
        keys, times = self._gram_counts(every, [np.array([seen.get(w, 0) for w in every], float) for seen in counts])
        del every
        # Shared continuation counts: of each shorter gram, how many letters stand before it in some word of either class.
        self.low: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        longer = keys
        grams = {}
        for k in range(ORDER - 1, 0, -1):
            grams[k] = np.unique(longer & np.uint64((1 << 8 * k) - 1), return_counts=True)
            longer = grams[k][0]
        below = None
        for k in range(1, ORDER):
            gram, n = grams[k]
            below = self._level(gram, n.astype(float), k, below)
            self.low.append(below)
        self.top = []
        for n in times:
            self.top.append(self._level(keys[n > 0], n[n > 0], ORDER, below))
        self.known: dict[bytes, float] = {}
        self.weights = np.array([0.0, 1.0, 0.0, 0.0, 0.0])
        self.mean, self.sd = np.zeros(4), np.ones(4)

    @classmethod
    def _gram_counts(cls, words: list[bytes], weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Distinct longest grams of words, and how often each occurs by each of the weights; some words at a time."""
        grams, sums = [np.empty(0, np.uint64)], [[np.empty(0)] for _ in weights]
        for i in range(0, len(words), 50_000):
            part = slice(i, i + 50_000)
            some, inv = np.unique(cls._keys(words[part]), return_inverse=True)
            letters = [len(w) + 1 for w in words[part]]
            grams.append(some)
            for s, w in zip(sums, weights):
                s.append(np.bincount(inv, np.repeat(w[part], letters), minlength=len(some)))
        every, inv = np.unique(np.concatenate(grams), return_inverse=True)
        return every, [np.bincount(inv, np.concatenate(s), minlength=len(every)) for s in sums]

    @staticmethod
    def _keys(words: list[bytes]) -> np.ndarray:
        """The longest gram that ends at each letter of each word, end mark included, packed into an integer."""
        flat = np.frombuffer(b"".join(bytes([2] * (ORDER - 1)) + w + b"\3" for w in words), np.uint8)
        size = np.array([len(w) + ORDER for w in words], np.int64)
        begin = np.cumsum(size) - size
        letter = np.ones(len(flat), bool)
        for j in range(ORDER - 1):
            letter[begin + j] = False
        at = np.flatnonzero(letter)
        key = np.zeros(len(at), np.uint64)
        for k in range(ORDER):
            key |= flat[at - k].astype(np.uint64) << np.uint64(8 * k)
        return key

    def _level(self, gram: np.ndarray, n: np.ndarray, k: int, below) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(grams, log probability, contexts, log weight left to shorter ones)"""
        ctx = gram >> np.uint64(8)
        heads, inv = np.unique(ctx, return_inverse=True)
        total, kinds = np.bincount(inv, n, minlength=len(heads)), np.bincount(inv, minlength=len(heads))
        left = DISCOUNT * kinds / np.maximum(total, 1e-9)
        rest = np.exp(self._log(gram & np.uint64((1 << 8 * (k - 1)) - 1) if k > 1 else gram, k - 1)) if k > 1 else np.full(len(gram), 1 / 256)
        p = np.maximum(n - DISCOUNT, 0) / total[inv] + left[inv] * rest
        # contexts lose their last letter here: a context of order k is the k-1 letters before
        return gram, np.log(p), heads, np.log(left)

    def _log(self, key: np.ndarray, k: int) -> np.ndarray:
        """Shared log probability of grams of order k."""
        value = np.full(len(key), -np.log(256.0))
        for j in range(1, k + 1):
            value = self._step(self.low[j - 1], key & np.uint64((1 << 8 * j) - 1), value)
        return value

    @staticmethod
    def _step(level, key: np.ndarray, value: np.ndarray) -> np.ndarray:
        gram, log_p, heads, log_left = level
        if not len(gram):
            return value
        at = np.minimum(np.searchsorted(gram, key), len(gram) - 1)
        head = key >> np.uint64(8)
        to = np.minimum(np.searchsorted(heads, head), len(heads) - 1)
        return np.where(gram[at] == key, log_p[at], value + np.where(heads[to] == head, log_left[to], 0.0))

    def ratios(self, texts: list[list[bytes]]) -> list[list[float]]:
        """Difference of log-likelihoods of each word."""
        seen = set().union(*texts) if texts else set()
        new = [w for w in seen if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(seen)
        for i in range(0, len(new), 20_000):
            some = new[i : i + 20_000]
            key = self._keys(some)
            base = self._log(key & np.uint64((1 << 8 * (ORDER - 1)) - 1), ORDER - 1)
            llr = self._step(self.top[0], key, base) - self._step(self.top[1], key, base)
            size = np.array([len(w) + 1 for w in some])
            self.known.update(zip(new[i : i + 20_000], np.add.reduceat(llr, np.cumsum(size) - size).tolist()))
        get = self.known.__getitem__
        return [list(map(get, t)) for t in texts]

    def features(self, texts: list[list[bytes]]) -> np.ndarray:
        """A row per text: difference per word, that of its most toxic stretch, of its most toxic word, and how often words stand out."""
        out = np.zeros((len(texts), 4))
        some = [k for k, t in enumerate(texts) if t]
        if not some:
            return out
        n = np.array([len(texts[k]) for k in some])
        llr = np.fromiter((x for t in self.ratios([texts[k] for k in some]) for x in t), float, int(n.sum()))
        end = np.cumsum(n)
        begin = end - n
        total = np.r_[0, np.cumsum(llr)]
        place = np.arange(len(llr))
        stop = np.minimum(place + STRETCH, np.repeat(end, n))
        out[some, 0] = np.add.reduceat(llr, begin) / n
        out[some, 1] = np.maximum.reduceat((total[stop] - total[place]) / STRETCH, begin)
        out[some, 2] = np.maximum.reduceat(llr, begin)
        out[some, 3] = np.log1p(np.add.reduceat((llr > 3).astype(float), begin))
        return out

    def calibrate(self, texts: list[str | None], y: np.ndarray, odds: float) -> None:
        """Logistic weights by Newton's method; ``odds`` is the share of toxic rows before they were sampled."""
        x = np.concatenate([self.features([words(t) for t in texts[i : i + 100]]) for i in range(0, len(texts), 100)])
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = np.c_[np.ones(len(x)), (x - self.mean) / self.sd]
        w = np.where(y == 1, odds / max(y.mean(), 1e-9), (1 - odds) / max(1 - y.mean(), 1e-9))
        b = np.zeros(5)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
            g = x.T @ (w * (p - y)) + 1e-2 * b
            b -= np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(5), g)
        self.weights = b

    def scores(self, texts: list[list[bytes]]) -> np.ndarray:
        z = self.weights[0] + (self.features(texts) - self.mean) / self.sd @ self.weights[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Models from labelled documents outside the held-out fold; None where a class has none."""
    known = labels.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", F.col("toxic").cast("int").alias("label")).where("label in (0, 1)")
    sample = labelled_sample(docs, known, PER_CLASS)
    share = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not {0, 1} <= set(sample["label"]):
        return None
    texts, y = sample["text"].tolist(), sample["label"].to_numpy()
    later = np.random.default_rng(11).random(len(y)) < CALIBRATE
    if len(set(y[later])) < 2 or len(set(y[~later])) < 2:
        later = np.zeros(len(y), bool)
    # Texts are cut into words one after another: the driver holds words once each, not once an occurrence.
    model = Model(*([t for t, k, c in zip(texts, y, later) if k == want and not c] for want in (1, 0)))
    use = later if later.any() else ~later
    model.calibrate([t for t, c in zip(texts, use) if c], y[use], share[1] / (share[0] + share[1]))
    model.known = {}
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score and predicted; empty and null texts get the score of no evidence, and 0 where nothing was learned.

    Equal texts get equal scores, repeated rows stay, and a score at the threshold counts as toxic.  Columns of docs
    stay; of these, score and predicted are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by PER_CLASS documents
    keep = docs.drop("score", "predicted")

    def run(text: pd.Series) -> pd.Series:
        m, out, texts, i = held.value, [np.empty(0)], text.tolist(), 0
        while m is not None and i < len(texts):  # about so many characters are cut into words at once
            j, n = i, 0
            while j < len(texts) and n < CHUNK:
                n += len(texts[j] or "") + 1
                j += 1
            out.append(m.scores([words(t) for t in texts[i:j]]))
            i = j
        give_back()
        return pd.Series(np.concatenate(out) if m is not None else np.zeros(len(texts)))

    out = keep.withColumn("score", F.pandas_udf(run, "double")("text"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """op6: doc_id, held_out, score, predicted of every whole text."""
    settings(docs.sparkSession)
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
