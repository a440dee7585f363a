"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained in numpy.

A word's bag is the word and its character 3- to 6-grams with border marks, hashed into buckets;
a window of words is the average of its bags' embeddings, and a linear softmax tells toxic from
clean. Embeddings and softmax are trained jointly, so a misspelling or an inflection never seen
scores by the n-grams it shares. A label holds for a whole text while the insult may be one word of
thousands: all windows of clean texts are clean, and of a toxic text the windows that score highest
so far are taken for toxic, from round to round. A text's score is a logistic of its highest
window, fitted on the training texts; window scores are linear in the bags, so each distinct word
is hashed once a worker and texts of any length are read whole.

``fit`` takes a bounded sample of labelled rows, ``max_rows`` a class and ``max_bytes`` in all, in
the order of a hash of the id. Null and empty texts score as a text without any sign. Repeated rows are scored each;
labels for one id that differ count each; without labels of both classes every score is the share
of toxic labels (0 without any). Texts of any length are scored whole, an empty table gives an empty
result, and only id, text and the label are read, so extra columns and their names do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 1500
#: Characters of the sample that the driver holds.
MAX_BYTES = 32 << 20
BUCKETS = 1 << 17
DIM = 8
WINDOW = 4
STORE = 400_000


def bag(word: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the word and its 3- to 6-grams of characters."""
    w = f"<{word.decode('utf-8', 'replace')}>"
    grams = {w, *(w[i : i + k] for k in range(3, 7) for i in range(len(w) - k + 1))}
    return np.fromiter((zlib.crc32(g.encode()) % buckets for g in grams), np.int64, len(grams))


_STRIP = bytes(range(33, 48)) + b":;<=>?@[]^_`{|}~\\"


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation at their ends."""
    return [x for w in (text or "").lower().encode().split() if (x := w.strip(_STRIP))]


@dataclass
class Model:
    """A window's logit is sum(weight of its buckets) / count + bias; a text's, slope * top + shift."""

    weight: np.ndarray
    bias: float
    slope: float
    shift: float
    window: int = WINDOW

    def scorer(self):
        store: dict[bytes, tuple[float, int]] = {}
        weight = self.weight

        def of(w: bytes) -> tuple[float, int]:
            if len(store) > STORE:
                store.clear()
            b = bag(w, len(weight))
            out = store[w] = (float(weight[b].sum()), len(b))
            return out

        def top(text: str | None) -> float:
            ws = tokens(text)
            if not ws:
                return self.bias
            pairs = np.array([store.get(w) or of(w) for w in ws])
            total = np.zeros((len(ws) + 1, 2))
            np.cumsum(pairs, axis=0, out=total[1:])
            k = min(self.window, len(ws))
            s = total[k:] - total[:-k]
            return float((s[:, 0] / s[:, 1]).max()) + self.bias

        def score(text: str | None) -> float:
            return float(1 / (1 + np.exp(-np.clip(self.slope * top(text) + self.shift, -40, 40))))

        score.top = top  # type: ignore[attr-defined]
        return score


def _windows(texts: list[str], buckets: int, window: int):
    """Flat bucket ids, window lengths, and the text number of each window."""
    store: dict[bytes, np.ndarray] = {}
    flat, lengths, owner = [], [], []
    for k, t in enumerate(texts):
        ws = tokens(t)
        for i in range(0, len(ws), window):
            part = []
            for w in ws[i : i + window]:
                b = store.get(w)
                if b is None:
                    b = store[w] = bag(w, buckets).astype(np.int32)
                part.append(b)
            one = np.concatenate(part)
            flat.append(one)
            lengths.append(len(one))
            owner.append(k)
    if not flat:
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(flat), np.array(lengths), np.array(owner)


def train(texts: list[str], labels: list[int], buckets: int = BUCKETS, dim: int = DIM, window: int = WINDOW, rounds: int = 4, epochs: int = 2, rate: float = 2.0, seed: int = 7) -> Model:
    """Joint training of embeddings and softmax over windows, with the toxic windows re-chosen each round."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        share = float(y.mean()) if len(y) else 0.0
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(buckets), 0.0, 0.0, float(np.log(p / (1 - p))), window)
    rng = np.random.default_rng(seed)
    flat, lengths, owner = _windows(texts, buckets, window)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    soft, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    square = np.full(buckets, 1e-3, np.float32)

    def by_window(value: np.ndarray) -> np.ndarray:
        """Means over windows of a value a bucket, a few windows at a time."""
        out = np.empty(len(lengths))
        for lo in range(0, len(out), 50_000):
            hi = min(lo + 50_000, len(out))
            out[lo:hi] = np.add.reduceat(value[flat[starts[lo] : starts[hi]]], starts[lo:hi] - starts[lo])
        return out / lengths

    # to begin with: smoothed log odds of a bucket by the texts it occurs in
    seen = np.zeros((2, buckets), np.int64)
    ends = np.searchsorted(owner, np.arange(len(y) + 1))
    for k in range(len(y)):
        seen[y[k], np.unique(flat[starts[ends[k]] : starts[ends[k + 1]]])] += 1
    n0, n1 = (y == 0).sum(), (y == 1).sum()
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    sure = odds * np.minimum(1, np.sqrt(seen[0] + seen[1]) / 3)
    logit = by_window((np.maximum(sure, 0) ** 2).astype(np.float32))

    for r in range(rounds):
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, owner, logit)
        # of a toxic text the best window and those near it
        near = logit >= best[owner] - np.abs(best[owner]) * 0.25
        positive = (y[owner] == 1) & near
        clean = np.flatnonzero(y[owner] == 0)
        hard = clean[np.argsort(-logit[clean], kind="stable")[: 2 * positive.sum()]]
        easy = rng.choice(clean, min(len(clean), 8 * int(positive.sum()) + 1000), replace=False)
        use = np.concatenate([np.flatnonzero(positive), hard, easy])
        target = (y[owner[use]] == 1).astype(np.int64)
        for _ in range(epochs):
            order = rng.permutation(len(use))
            for lo in range(0, len(order), 256):
                w = use[order[lo : lo + 256]]
                t = target[order[lo : lo + 256]]
                count = lengths[w]
                at = np.repeat(starts[w] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                ids = flat[at]
                row = np.repeat(np.arange(len(w)), count)
                first = np.concatenate([[0], np.cumsum(count)[:-1]])
                h = np.add.reduceat(emb[ids], first, axis=0) / count[:, None]
                z = h @ soft + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                d = p
                d[np.arange(len(w)), t] -= 1
                weight = np.where(t == 1, max(1.0, (target == 0).sum() / max(1, target.sum()) / 2), 1.0)
                d *= weight[:, None]
                g_soft, g_bias = h.T @ d / len(w), d.mean(axis=0)
                if not soft.any():
                    soft[:] = rng.uniform(-0.5, 0.5, soft.shape)
                g_h = (d @ soft.T) / count[:, None]
                soft -= 0.5 * g_soft
                bias -= 0.5 * g_bias
                uniq, inverse = np.unique(ids, return_inverse=True)
                g = np.zeros((len(uniq), dim), np.float32)
                np.add.at(g, inverse, g_h[row])
                square[uniq] += (g**2).mean(axis=1)
                emb[uniq] -= rate * 0.1 * g / np.sqrt(square[uniq])[:, None]
        weight1 = (emb @ (soft[:, 1] - soft[:, 0])).astype(np.float64)
        b = float(bias[1] - bias[0])
        logit = by_window(weight1.astype(np.float32)) + b
    model = Model(weight1, b, 1.0, 0.0, window)
    score = model.scorer()
    tops = np.array([score.top(t) for t in texts])
    model.slope, model.shift = _logistic(tops, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic over one feature, each class weighing the same."""
    mean, scale = float(x.mean()), float(x.std()) or 1.0
    u, a, b = (x - mean) / scale, 1.0, 0.0
    w = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -40, 40)))
        v = w * p * (1 - p) + 1e-9
        g = np.array([(w * (p - y) * u).sum() + 1e-3 * a, (w * (p - y)).sum()])
        h = np.array([[(v * u * u).sum() + 1e-3, (v * u).sum()], [(v * u).sum(), v.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    return float(max(a, 1e-3) / scale), float(b - max(a, 1e-3) * mean / scale)


def held_out(fold: int = 5, rest: int = 0):
    """Whether an id's crc32 as text leaves ``rest`` modulo ``fold``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == rest, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, label: str = "toxic", max_bytes: int = MAX_BYTES) -> Model:
    """Train on the labelled texts outside the held-out fold: at most ``max_rows`` of a class, in the order of
    a hash of the id, and as many of these as have ``max_bytes`` together, in that order too."""
    rows = labels.filter(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    kept = rows.filter("y = 0").orderBy(*order).limit(max_rows).unionByName(rows.filter("y = 1").orderBy(*order).limit(max_rows))
    sample = docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "y", F.xxhash64("text"))
    texts, ys, size = [], [], 0
    for r in sample.toLocalIterator():
        size += len(r.text or "")
        if size > max_bytes and texts:
            break
        texts.append(r.text or "")
        ys.append(r.y)
    return train(texts, ys)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted per row."""
    send = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: a number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = send.value.scorer()
        for b in batches:
            s = [of(t.as_py()) for t in b.column(2)]
            cols = [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
