"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text's words are read in overlapping windows that cover all of it.  A word's
inputs come from the word itself and from its characters: log odds of the label
for the hashed word, and the mean and largest log odds of its hashed 4-, 6- and
8-byte grams, all counted on the training sample.  A gated recurrent network reads each
window in both directions, attention pools its states, and a logit comes out.
A text's score combines its largest and mean window logits by a learned
logistic step.

Only texts have labels, so training picks windows: of a toxic text the one that
the network (at first: its inputs) finds most toxic, of a clean one its most toxic
and some others.  While training, a text's inputs are counted on the other half
of the sample, so the network can't trust words that it saw in one text only.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh
from .quality import adam, logistic, score, sigmoid
from .sampling import drawn_rows, learn
from .textkit import ALNUM, Words, batches

WINDOW, HOP, UNITS, BUCKETS = 24, 16, 10, 1 << 16
#: Windows that go through the network at a time.
ROWS = 4096
#: Bytes of the character grams.
GRAMS = (4, 6, 8)
INPUTS = 2 + 2 * len(GRAMS)

__all__ = ["BiGRU", "fit", "score", "train"]


def grams(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-byte grams of the words, each with one neighbouring byte on either side, and where each word's begin."""
    b = np.concatenate([[32], np.frombuffer(w.plain.tobytes().translate(ALNUM), np.uint8), np.full(n, 32)]).astype(np.uint32)
    code = b[: len(b) - n + 1].copy()
    for i in range(1, n):
        code = code * np.uint32(16777619) ^ b[i : len(b) - n + 1 + i]
    many = np.maximum(1, w.ends - w.starts + 3 - n)
    first = np.cumsum(many) - many
    at = np.arange(int(many.sum())) + np.repeat(w.starts - first, many)  # one byte before each word, as b is shifted by one
    found = ((code[at] * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)
    short = w.ends - w.starts + 2 < n  # no gram fits: the word itself stands for it
    found[first[short]] = (w.hashes[short] >> np.uint64(32)).astype(np.int64) & (BUCKETS - 1)
    return found, first


def buckets(w: Words) -> tuple:
    return (w.hashes >> np.uint64(48)).astype(np.int64), *(grams(w, n) for n in GRAMS)


def log_odds(raws: list[bytes], y: np.ndarray, smooth: float = 2.0) -> np.ndarray:
    """Log odds of the label for words and grams, by the number of texts that have them."""
    counts = np.zeros((2, 1 + len(GRAMS), BUCKETS))
    for at, part in batches(raws):
        w = Words(part, ALNUM, fold=True)
        word, *pieces = buckets(w)
        spread = [(word, w.text), *((g, np.repeat(w.text, np.diff(np.append(first, len(g))))) for g, first in pieces)]
        for i, (bucket, text) in enumerate(spread):
            both = np.unique(text * BUCKETS + bucket)
            of = y[at + both // BUCKETS]
            for label in (0, 1):
                counts[label, i] += np.bincount((both % BUCKETS)[of == label], minlength=BUCKETS)
    n = np.bincount(y, minlength=2)
    share = smooth / max(1, n.sum())
    rate = [(counts[k] + smooth * n[k] / max(1, n.sum())) / (n[k] + n[k] * share) for k in (0, 1)]
    return np.clip(np.log(rate[1] / rate[0]), -4, 4).astype(np.float32) if n.min() else np.zeros((1 + len(GRAMS), BUCKETS), np.float32)


def inputs(w: Words, odds: np.ndarray) -> np.ndarray:
    """Inputs of each word; a last row of zeros pads windows."""
    x = np.zeros((len(w.starts) + 1, INPUTS), np.float32)
    if len(w.starts):
        word, *pieces = buckets(w)
        x[:-1, 0] = odds[0][word]
        for i, (g, first) in enumerate(pieces, 1):
            v = odds[i][g]
            x[:-1, 2 * i - 1] = np.maximum.reduceat(v, first)
            x[:-1, 2 * i] = np.add.reduceat(v, first) / np.diff(np.append(first, len(g)))
        x[:-1, -1] = np.minimum(w.ends - w.starts, 20) / 10
    return x


def windows(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word places of each window (-1 pads), and each window's text; a text without words has one empty window."""
    n = np.diff(w.cuts)
    many = np.maximum(1, -(-(n - (WINDOW - HOP)) // HOP))
    text = np.repeat(np.arange(len(n)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    place = (nth * HOP)[:, None] + np.arange(WINDOW)
    return np.where(place < n[text][:, None], w.cuts[:-1][text][:, None] + place, -1), text


def near(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the input rows that some windows read (one run of them), and the windows' places in these."""
    low, high = int(at.max(initial=-1, where=at >= 0)), -1
    if low >= 0:
        low, high = int(at.min(initial=low, where=at >= 0)), low
    else:
        low = 0
    return np.concatenate([x[low : high + 1], x[-1:]]), np.where(at >= 0, at - low, -1)


def own_rows(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The input rows of windows that lie anywhere, each window with its own, and the places in these."""
    return np.concatenate([x[at.ravel()], x[-1:]]), np.where(at >= 0, np.arange(at.size).reshape(at.shape), -1)


def _blank(rng) -> dict[str, np.ndarray]:
    draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"attend": draw(2 * UNITS, 1), "out": draw(2 * UNITS, 1), "out_b": np.zeros(1, np.float32)}
    for way in "fb":
        w |= {f"x{way}": draw(INPUTS, 3 * UNITS), f"b{way}": np.zeros(3 * UNITS, np.float32), f"u{way}": draw(UNITS, 3 * UNITS)}
    return w


@dataclass
class BiGRU:
    odds: np.ndarray = field(default_factory=lambda: np.zeros((1 + len(GRAMS), BUCKETS), np.float32))
    weights: dict[str, np.ndarray] = field(default_factory=lambda: _blank(np.random.default_rng(9)))
    combine: np.ndarray = field(default_factory=lambda: np.zeros(4))

    def _read(self, x: np.ndarray, at: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        w, u = self.weights, UNITS
        ahead = x @ w[f"x{way}"] + w[f"b{way}"]
        h = np.zeros((len(at), u), np.float32)
        states = np.empty((WINDOW, len(at), u), np.float32)
        for t in range(WINDOW) if way == "f" else reversed(range(WINDOW)):
            a, back = ahead[at[:, t]], h @ w[f"u{way}"]
            gates = 0.5 + 0.5 * np.tanh(0.5 * (a[:, : 2 * u] + back[:, : 2 * u]))
            z, r = gates[:, :u], gates[:, u:]
            n = np.tanh(a[:, 2 * u :] + r * back[:, 2 * u :])
            live = (at[:, t] >= 0)[:, None]
            g = (1 - z) * live
            if keep is not None:
                keep.append((t, h, z, r, n, back[:, 2 * u :], g, live))
            h = h + g * (n - h)
            states[t] = h
        return states

    def forward(self, x: np.ndarray, at: np.ndarray, keep: bool = False):
        kept = {"f": [], "b": []}
        s = np.concatenate([self._read(x, at, way, kept[way] if keep else None) for way in "fb"], 2)
        a = np.where((at >= 0).T, (s @ self.weights["attend"])[:, :, 0], np.float32(-30))
        a = np.exp(a - a.max(0))
        a /= a.sum(0)
        c = (a[:, :, None] * s).sum(0)
        return (c @ self.weights["out"])[:, 0] + self.weights["out_b"][0], (kept, s, a, c)

    def gradients(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, u = self.weights, UNITS
        logit, (kept, s, a, c) = self.forward(x, at, True)
        dz = ((sigmoid(logit) - y) * weight / len(y)).astype(np.float32)[:, None]
        g = {"out": c.T @ dz, "out_b": dz.sum(0)}
        dc = dz @ w["out"].T
        da = (s * dc).sum(2)
        dl = a * (da - (a * da).sum(0))
        g["attend"] = np.einsum("tnu,tn->u", s, dl)[:, None].astype(np.float32)
        ds = a[:, :, None] * dc + dl[:, :, None] * w["attend"][:, 0]
        for way, low in (("f", 0), ("b", u)):
            gx, gb, gu = np.zeros_like(w[f"x{way}"]), np.zeros_like(w[f"b{way}"]), np.zeros_like(w[f"u{way}"])
            dh = np.zeros((len(at), u), np.float32)
            for t, h, z, r, n, back, gate, live in reversed(kept[way]):
                dh = dh + ds[t][:, low : low + u]
                dn = dh * gate * (1 - n * n)
                dzz = -dh * (n - h) * live * z * (1 - z)
                dr = dn * back * r * (1 - r)
                rec = np.concatenate([dzz, dr, dn * r], 1)
                own = np.concatenate([dzz, dr, dn], 1)
                gu += h.T @ rec
                gx += x[at[:, t]].T @ own
                gb += own.sum(0)
                dh = dh * (1 - gate) + rec @ w[f"u{way}"].T
            g |= {f"x{way}": gx, f"b{way}": gb, f"u{way}": gu}
        return g

    def logits(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(*near(x, at[i : i + ROWS]))[0] for i in range(0, len(at), ROWS)])

    def features(self, raws: list[bytes], odds: np.ndarray | None = None) -> np.ndarray:
        """Per text: 1, the largest and the mean window logit, and the log of the number of windows."""
        out = np.empty((len(raws), 4))
        for first, part in batches(raws):
            w = Words(part, ALNUM, fold=True)
            at, text = windows(w)
            z = self.logits(inputs(w, self.odds if odds is None else odds), at)
            begin = np.searchsorted(text, np.arange(len(part)))
            many = np.diff(np.append(begin, len(text)))
            out[first : first + len(part)] = np.stack([np.ones(len(part)), np.maximum.reduceat(z, begin), np.add.reduceat(z, begin) / many, np.log(many)], 1)
        return out

    def scores(self, raws: list[bytes]) -> np.ndarray:
        return sigmoid(self.features(raws) @ self.combine) if raws else np.zeros(0)


def train(rows: list[tuple[bytes, int]], epochs: int = 5, others: int = 2, batch: int = 128, seed: int = 13) -> BiGRU:
    """Fit on whole texts with labels 0 and 1."""
    model = BiGRU()
    y = np.array([label for _, label in rows], np.int64)
    if len(set(y.tolist())) < 2:
        share = y.mean() if len(y) else 0.5
        model.combine[0] = np.log((share + 0.01) / (1.01 - share))
        return model
    raws = [r for r, _ in rows]
    rng = np.random.default_rng(seed)
    half = np.arange(len(rows)) % 2
    model.odds = log_odds(raws, y)
    folds = []
    for k in (0, 1):
        mine = np.flatnonzero(half == k)
        rest = np.flatnonzero(half != k)
        odds = log_odds([raws[i] for i in rest], y[rest])
        w = Words([raws[i] for i in mine], ALNUM, fold=True)
        at, text = windows(w)
        folds.append((inputs(w, odds), at, text, y[mine], odds, mine))
    # both halves in one table of inputs
    xa, xb = folds[0][0], folds[1][0]
    x = np.concatenate([xa[:-1], xb])
    at = np.concatenate([folds[0][1], np.where(folds[1][1] >= 0, folds[1][1] + len(xa) - 1, -1)])
    text = np.concatenate([folds[0][2], folds[1][2] + len(folds[0][3])])
    label = np.concatenate([folds[0][3], folds[1][3]])
    begin = np.searchsorted(text, np.arange(len(label)))
    heat = np.where(at >= 0, (x[:, 0] + x[:, 1])[at], -9).max(1)
    weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean()))

    def steps():
        z = heat
        for epoch in range(epochs):
            if epoch:
                z = model.logits(x, at)
            order = np.lexsort((-z, text))
            picks = [order[begin]]  # the hottest window of each text
            clean = np.flatnonzero(label[text] == 0)
            picks.append(rng.choice(clean, min(len(clean), others * len(label))))
            picks = rng.permutation(np.concatenate(picks))
            for i in range(0, len(picks), batch):
                p = picks[i : i + batch]
                yield model.gradients(*own_rows(x, at[p]), label[text[p]], weight[text[p]])

    adam(model, steps(), rate=1e-2)
    found = np.empty((len(rows), 4))
    for _, _, _, _, odds, mine in folds:
        found[mine] = model.features([raws[i] for i in mine], odds)
    # both labels weigh the same, however few texts are toxic
    model.combine = logistic(found, y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    return model


def fit(docs: DataFrame, labels: DataFrame, usable, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: tuple[int, int] = (2400, 1600)) -> BiGRU:
    """Learn from a bounded sample of labelled rows (``per_label`` of labels 0 and 1) that ``usable(doc_id column)`` admits.

    Null texts and null or other labels don't teach; without two labels every text scores their share (a half without any).
    Other columns play no part.
    """
    return learn(drawn_rows(docs, labels.where(F.col(label).isin(0, 1)), label, usable, {0: per_label[0], 1: per_label[1]}, doc_id, text), train)


def drop_toxic(docs: DataFrame, model: BiGRU, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Rows whose whole text scores below the threshold, with all their columns."""
    copy, mark = fresh(docs, "text_copy"), fresh(docs, "toxicity")
    marked = score(docs.withColumn(copy, F.col(text)), model, copy, mark)
    return marked.where(F.col(mark) < threshold).select(docs.columns)
