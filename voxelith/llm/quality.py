"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  Each byte
is embedded; learned filters eight bytes wide slide over a chunk in steps of
two; their largest and mean responses over the chunk feed a small hidden layer that
gives the chunk's logit.  A text's probability combines the mean and the
extremes of its chunk logits by a learned logistic step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, replaced
from .sampling import drawn_rows, learn

WIDTH, STRIDE, EMBED, FILTERS, HIDDEN = 8, 2, 6, 24, 16
CHUNK, HOP = 512, 480
#: Chunks that go through the network at a time.
ROWS = 256


def chunk_starts(n: int) -> np.ndarray:
    """Starts of the overlapping chunks that cover n bytes (one chunk for an empty text)."""
    return np.arange(0, max(1, n - (CHUNK - HOP)), HOP)


def chunks(raw: bytes) -> np.ndarray:
    """Codes 1 to 256 of the bytes of each chunk, 0 behind the end."""
    starts = chunk_starts(len(raw))
    padded = np.zeros(int(starts[-1]) + CHUNK, np.int16)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    padded[: len(raw)] += 1
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[starts]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class ByteCNN:
    weights: dict[str, np.ndarray]
    combine: np.ndarray = field(default_factory=lambda: np.array([0.0, 1.0, 0.0, 0.0]))

    @classmethod
    def start(cls, seed: int = 5) -> ByteCNN:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        embed = (0.5 * rng.standard_normal((257, EMBED))).astype(np.float32)
        embed[0] = 0
        return cls({"embed": embed, "conv": draw(WIDTH * EMBED, FILTERS), "conv_b": np.zeros(FILTERS, np.float32), "hid": draw(2 * FILTERS, HIDDEN), "hid_b": np.zeros(HIDDEN, np.float32), "out": draw(HIDDEN, 1), "out_b": np.zeros(1, np.float32)})

    def forward(self, codes: np.ndarray):
        w = self.weights
        n = len(codes)
        x = w["embed"][codes].reshape(n, CHUNK * EMBED)
        steps = (CHUNK - WIDTH) // STRIDE + 1
        cols = np.lib.stride_tricks.as_strided(x, (n, steps, WIDTH * EMBED), (x.strides[0], STRIDE * EMBED * 4, 4))
        cols = np.ascontiguousarray(cols).reshape(n * steps, WIDTH * EMBED)
        conv = (cols @ w["conv"]).reshape(n, steps, FILTERS) + w["conv_b"]
        np.maximum(conv, 0, out=conv)
        live = np.minimum(steps, np.maximum(1, ((codes > 0).sum(1) + STRIDE - 1) // STRIDE)).astype(np.float32)
        pooled = np.concatenate([conv.max(1), conv.sum(1) / live[:, None]], 1)
        hid = np.maximum(pooled @ w["hid"] + w["hid_b"], 0)
        return (hid @ w["out"])[:, 0] + w["out_b"][0], (cols, conv, live, pooled, hid)

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(codes[at : at + ROWS])[0] for at in range(0, len(codes), ROWS)])

    def gradients(self, codes: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        z, (cols, conv, live, pooled, hid) = self.forward(codes)
        n, steps, _ = conv.shape
        dz = ((sigmoid(z) - y) * weight / n).astype(np.float32)[:, None]
        g = {"out": hid.T @ dz, "out_b": dz.sum(0)}
        dh = (dz @ w["out"].T) * (hid > 0)
        g |= {"hid": pooled.T @ dh, "hid_b": dh.sum(0)}
        dp = dh @ w["hid"].T
        dc = np.repeat((dp[:, FILTERS:] / live[:, None])[:, None, :], steps, 1)
        at = conv.argmax(1)
        i, f = np.ogrid[:n, :FILTERS]
        dc[i, at, f] += dp[:, :FILTERS]
        dc = (dc * (conv > 0)).reshape(n * steps, FILTERS)
        g |= {"conv": cols.T @ dc, "conv_b": dc.sum(0)}
        dx = (dc @ w["conv"].T).reshape(n, steps, WIDTH, EMBED)
        de = np.zeros((n, CHUNK, EMBED), np.float32)
        for o in range(WIDTH):
            de[:, o : o + STRIDE * steps : STRIDE] += dx[:, :, o]
        flat = codes.reshape(-1)
        g["embed"] = np.stack([np.bincount(flat, de[:, :, e].reshape(-1), minlength=257) for e in range(EMBED)], 1).astype(np.float32)
        g["embed"][0] = 0
        return g

    def features(self, raw: bytes) -> np.ndarray:
        starts = chunk_starts(len(raw))
        mean = low = high = None
        for at in range(0, len(starts), ROWS):  # some chunks at a time: a long text needs little memory
            part = starts[at : at + ROWS]
            z = self.logits(chunks(raw[int(part[0]) : int(part[-1]) + CHUNK])[: len(part)])
            mean = z.sum() + (mean or 0)
            low, high = (z.min(), z.max()) if low is None else (min(low, z.min()), max(high, z.max()))
        return np.array([1.0, mean / len(starts), low, high])

    def score(self, raw: bytes) -> float:
        return float(sigmoid(self.features(raw) @ self.combine))


def adam(model, batches, rate: float = 3e-3):
    """Adam over an iterator of gradient dictionaries."""
    m = {k: np.zeros_like(v) for k, v in model.weights.items()}
    v = {k: np.zeros_like(x) for k, x in model.weights.items()}
    for t, g in enumerate(batches, 1):
        for k, w in model.weights.items():
            m[k] += 0.1 * (g[k] - m[k])
            v[k] += 0.001 * (g[k] * g[k] - v[k])
            w -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(w.dtype)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 30, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps; rows may count unequally."""
    w = np.zeros(x.shape[1])
    c = np.ones(len(x)) if weight is None else weight / weight.mean()
    for _ in range(rounds):
        p = sigmoid(x @ w)
        h = x.T @ (x * (c * p * (1 - p))[:, None]) + ridge * len(x) * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (c * (p - y)) + ridge * len(x) * w)
    return w


def train(rows: list[tuple[bytes, int]], epochs: int = 6, per_text: int = 3, batch: int = 64, seed: int = 11) -> ByteCNN:
    """Fit the network on chunks of the sample's texts, then the combining step on whole texts."""
    model = ByteCNN.start()
    if len({y for _, y in rows}) < 2:
        share = sum(y for _, y in rows) / len(rows) if rows else 0.5
        model.combine = np.array([np.log((share + 0.01) / (1.01 - share)), 0.0, 0.0, 0.0])
        return model
    rng = np.random.default_rng(seed)
    all_chunks = [chunks(r) for r, _ in rows]
    labels = np.array([y for _, y in rows], np.float32)
    share = labels.mean()
    weights = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))

    def batches():
        for _ in range(epochs):
            picks = np.array([(i, c) for i, x in enumerate(all_chunks) for c in rng.permutation(len(x))[:per_text]])
            rng.shuffle(picks)
            for at in range(0, len(picks), batch):
                part = picks[at : at + batch]
                yield model.gradients(np.stack([all_chunks[i][c] for i, c in part]), labels[part[:, 0]], weights[part[:, 0]])

    adam(model, batches())
    model.combine = logistic(np.array([model.features(r) for r, _ in rows]), labels)
    return model


def fit(docs: DataFrame, labels: DataFrame, usable, doc_id: str = "doc_id", text: str = "text", label: str = "quality", per_label: int = 900) -> ByteCNN:
    """Learn from a bounded sample of labelled rows (``per_label`` of each label) that ``usable(doc_id column)`` admits.

    Null texts and null or other labels don't teach; without two labels every text scores their share (a half without any).
    Other columns play no part.
    """
    return learn(drawn_rows(docs, labels.where(F.col(label).isin(0, 1)), label, usable, per_label, doc_id, text), train)


def score(docs: DataFrame, model, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` without the text, with a score from 0 to 1 of each whole text (null counts as empty).

    Every row comes back; an input column named like the score is replaced.
    """
    docs = replaced(docs, into)
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).withColumn(into, F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [x or b"" for x in b.column(0).cast(pa.large_binary()).to_pylist()]
            many = getattr(sent.value, "scores", None)
            got = many(raws) if many else [sent.value.score(r) for r in raws]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.float64())], names=[*keep, into])

    return bounded_batches(docs).select(F.col(text).cast("string"), *keep).mapInArrow(run, schema)
