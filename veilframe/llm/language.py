"""Language ID by a byte convolutional network trained in numpy.

Windows of fixed length cover the whole text.  Filters of several widths run
over embedded bytes, the maximum of each filter over a window feeds a softmax,
and a text's probabilities are the mean over its windows, weighted by their
bytes.  A filter's response is a sum of one term for each byte under it, so for
applying the network the terms of byte pairs are tabled once and a window costs
two look-ups a byte instead of a product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, give_back, settings
from .samples import labelled_sample

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 8
EMBED = 8
#: Training documents of each language; windows are drawn from the whole of their texts.
PER_LANGUAGE = 300
STEPS = 1_100
_PAD = max(WIDTHS) - 1


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def has_letter(text: str | None) -> bool:
    return bool(text) and (text[:64].isalpha() or any(map(str.isalpha, text)))


class Network:
    def __init__(self, labels: list[str], seed: int = 3):
        self.labels = labels
        r = np.random.default_rng(seed)
        self.p = {"embed": r.normal(0, 0.5, (256, EMBED)), "out": r.normal(0, 0.3, (FILTERS * len(WIDTHS), len(labels))), "bias": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"k{w}"] = r.normal(0, 0.35, (w, EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        e = self.p["embed"][x]
        tops, at = [], []
        for w in WIDTHS:
            r = sum(e[:, j : j + WINDOW] @ self.p[f"k{w}"][j] for j in range(w))
            at.append(r.argmax(axis=1))
            tops.append(np.take_along_axis(r, at[-1][:, None], axis=1)[:, 0] + self.p[f"b{w}"])
        h = np.maximum(np.concatenate(tops, axis=1), 0)
        z = h @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), at, h

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, at, h = self._forward(x)
        d = prob.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        g = {"out": h.T @ d, "bias": d.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        dh = (d @ self.p["out"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            own = dh[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{w}"] = own.sum(axis=0)
            g[f"k{w}"] = np.zeros_like(self.p[f"k{w}"])
            for j in range(w):
                seen = x[np.arange(len(x))[:, None], at[k] + j]  # bytes under the winning place of each filter
                g[f"k{w}"][j] = np.einsum("bfe,bf->ef", self.p["embed"][seen], own)
                np.add.at(g["embed"], seen, own[:, :, None] * self.p[f"k{w}"][j].T[None])
        return g

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.004, seed: int = 5) -> None:
        """Adam over batches of windows, each drawn at random from the whole of a text drawn at random."""
        r = np.random.default_rng(seed)
        room = np.array([-(-(len(t) + _PAD) // WINDOW) for t in texts])
        texts = [t.ljust(n * WINDOW + _PAD, b"\0") for t, n in zip(texts, room.tolist())]
        m, v = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}
        for t in range(1, steps + 1):
            of = r.integers(len(texts), size=batch)
            at = (r.random(batch) * room[of]).astype(np.int64) * WINDOW
            x = np.stack([np.frombuffer(texts[k], np.uint8, WINDOW + _PAD, i) for k, i in zip(of.tolist(), at.tolist())])
            for k, g in self._gradient(x, y[of]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def tabled(self) -> "Tables":
        return Tables(self)


class Tables:
    """The trained network as look-up tables of byte pairs."""

    def __init__(self, net: Network):
        term = {w: np.einsum("be,jef->jbf", net.p["embed"], net.p[f"k{w}"]) for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(1 << 16, -1)
        none = np.zeros((256, FILTERS))
        self.first = np.concatenate([pair(term[w][0], term[w][1]) for w in WIDTHS], axis=1).astype(np.float32)
        self.second = np.concatenate([pair(term[w][2], term[w][3] if w > 3 else none) for w in WIDTHS if w > 2], axis=1).astype(np.float32)
        self.skip = FILTERS * sum(w <= 2 for w in WIDTHS)
        self.base = np.concatenate([net.p[f"b{w}"] for w in WIDTHS])
        self.out, self.bias, self.labels = net.p["out"], net.p["bias"], net.labels

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """A row per text."""
        room = np.array([-(-(len(t) + _PAD) // WINDOW) for t in texts])
        flat = b"".join(t.ljust(n * WINDOW, b"\0") for t, n in zip(texts, room.tolist())) + bytes(4)
        a = np.frombuffer(flat, np.uint8).astype(np.int32)
        pair = a[:-1] << 8 | a[1:]
        n = len(a) - 4
        top = np.empty((n // WINDOW, self.first.shape[1]), np.float32)
        last = np.cumsum(room)  # the last places of a text see the next one's bytes; they have no response
        for i in range(0, len(top), 128):
            j = min(len(top), i + 128)
            r = self.first[pair[i * WINDOW : j * WINDOW]]
            r[:, self.skip :] += self.second[pair[i * WINDOW + 2 : j * WINDOW + 2]]
            ends = last[(last > i) & (last <= j)] - i
            r = r.reshape(j - i, WINDOW, -1)
            r[ends - 1, -_PAD:] = -1e9
            r.max(axis=1, out=top[i:j])
        z = np.maximum(top + self.base, 0) @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        begin = np.r_[0, last[:-1]]
        weight = np.full(len(top), float(WINDOW))
        weight[last - 1] = np.maximum(1, np.array([len(t) for t in texts]) - (room - 1) * WINDOW)
        return np.add.reduceat(z * weight[:, None], begin) / np.add.reduceat(weight, begin)[:, None]


def fit(docs: DataFrame) -> Tables | None:
    """A network for the languages of the documents outside the held-out fold; None where none has a language."""
    known = docs.where((fold(F.col("doc_id"), 3) != 1) & F.col("text").isNotNull()).select("doc_id", F.col("lang").alias("label"))
    sample = labelled_sample(docs, known, PER_LANGUAGE)
    sample = sample[[has_letter(t) for t in sample["text"]]]
    if not len(sample):
        return None
    labels = sorted(set(sample["label"]))
    net = Network(labels)
    net.train([_bytes(t) for t in sample["text"]], np.searchsorted(labels, sample["label"].to_numpy()))
    return net.tabled()


def predict(docs: DataFrame, model: Tables | None) -> DataFrame:
    """docs with lang_pred and score.

    Null texts and texts without a letter are ``und`` with score 0, as is every text where nothing could be
    learned.  Equal texts get equal predictions and repeated rows stay; of languages with equal probability the
    first by name is told.  Columns of docs stay; of these, lang_pred and score are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # some MB, whatever the table
    keep = docs.drop("lang_pred", "score")

    def run(text: pd.Series) -> pd.DataFrame:
        m, out = held.value, []
        texts = [(_bytes(t) if m is not None and has_letter(t) else None) for t in text]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size < 1 << 19):
                size += len(texts[j] or b"")
                j += 1
            some = [t for t in texts[i:j] if t is not None]
            prob = iter(m.probabilities(some) if some else [])
            for t in texts[i:j]:
                p = None if t is None else next(prob)
                out.append(("und", 0.0) if p is None else (m.labels[int(p.argmax())], float(min(1.0, p.max()))))
            i = j
        give_back()
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    guess = F.pandas_udf(run, "lang_pred string, score double")
    return keep.withColumn("_guess", guess("text")).select(*keep.columns, "_guess.lang_pred", "_guess.score")


def identify(docs: DataFrame) -> DataFrame:
    """op1: doc_id, held_out, lang_pred, score of every whole text."""
    settings(docs.sparkSession)
    out = predict(docs.select("doc_id", "text"), fit(docs.select("doc_id", "text", "lang")))
    return out.select(F.col("doc_id"), (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
