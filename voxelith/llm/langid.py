"""Language identification by nearest centroid.

A text becomes a vector of hashed byte 1- to 4-grams, weighted by
``log(1 + count) * idf`` and scaled to length one.  The document frequencies
behind the idf are counted over all texts.  Each language gets several
centroids: spherical k-means over a bounded sample of its labelled texts.  A
text's language is that of the centroid with the largest cosine; it is marked
as rejected where that cosine lies below the language's own limit, a low
quantile of its sample's cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, replaced
from .sampling import sample

DIMS = 4096
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in (9, 10, 11, 12, 13) else b for b in range(256))
#: Bytes of one text that are counted at a time.
STEP = 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counts(raw: bytes) -> np.ndarray:
    """Counts of hashed byte 1- to 4-grams over the whole text."""
    out = np.zeros(DIMS, np.int64)
    folded = raw.translate(_FOLD)
    for at in range(0, max(1, len(folded)), STEP):
        b = np.frombuffer(folded[max(0, at - 3) : at + STEP], np.uint8).astype(np.uint32)
        lead = at - max(0, at - 3)
        code = np.zeros(len(b), np.uint32)
        for n in range(4):
            code = (code[:-1] if n else code) * np.uint32(257) + b[n:] + np.uint32(1)
            fresh = code[max(0, lead - n) :]  # grams that end in this step
            out += np.bincount(((fresh * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) ^ n, minlength=DIMS)
    return out


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[int, np.ndarray]:
    """How many texts there are, and how many have each hashed n-gram, over all of them."""
    cols = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMS + 1, np.int64)
        for b in batches:
            for raw in b.column(0).cast(pa.large_binary()):
                df[:DIMS] += counts(raw.as_py()) > 0
                df[DIMS] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(df)], names=["gram", "n"])

    got = bounded_batches(cols).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS + 1, np.int64)
    for r in got:
        out[r["gram"]] = r["n"]
    return int(out[DIMS]), out[:DIMS]


def vector(raw: bytes, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts(raw)).astype(np.float32) * idf
    length = float(np.sqrt((v * v).sum()))
    return v / length if length else v


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    at = [int(rng.integers(len(x)))]
    while len(at) < min(k, len(x)):  # the point farthest from all chosen
        at.append(int((x @ x[at].T).max(1).argmin()))
    c = x[at].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        for j in range(len(c)):
            if (near == j).any():
                m = x[near == j].mean(0)
                c[j] = m / max(1e-12, float(np.sqrt((m * m).sum())))
    return c


@dataclass
class LangModel:
    idf: np.ndarray
    langs: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray
    limits: np.ndarray  # least cosine of each language

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language (``und`` for null, for texts without letters, and without any learned language), cosine, rejected."""
        if text is None or not self.langs or not has_letter(text):
            return "und", 0.0, True
        s = self.centroids @ vector(text.encode(), self.idf)
        best = int(s.argmax())
        lang = int(self.of[best])
        return self.langs[lang], float(min(1.0, max(0.0, s[best]))), bool(s[best] < self.limits[lang])


def fit(docs: DataFrame, usable, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = 400, centroids: int = 4, quantile: float = 0.002) -> LangModel:
    """Learn from rows with a language that ``usable(doc_id column)`` admits; document frequencies are over all of these rows.

    Centroids come from a sample of ``per_lang`` texts a language.  Null texts and texts without a letter teach no language; an empty table gives a
    model that calls everything ``und``.  Other columns play no part.
    """
    teach = docs.where(F.col(lang).isNotNull() & usable(F.col(doc_id)))
    n, df = document_frequencies(teach, text)
    idf = (np.log((1 + n) / (1 + df)) + 0.05).astype(np.float32)
    rows = [(t, y) for t, y in sample(docs, None, lang, usable, per_lang, doc_id, text) if has_letter(t)]
    langs = sorted({y for _, y in rows})
    of, cents, limits = [], [], []
    for i, y in enumerate(langs):
        x = np.array([vector(t.encode(), idf) for t, z in rows if z == y])
        c = spherical_kmeans(x, centroids)
        of += [i] * len(c)
        cents.append(c)
        limits.append(float(np.quantile((x @ c.T).max(1), quantile)))
    return LangModel(idf, langs, np.array(of, np.int64), np.concatenate(cents) if cents else np.zeros((0, DIMS), np.float32), np.array(limits))


def predict(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    Every row comes back; empty texts and texts without a letter are ``und`` with score 0.
    Input columns of these names are replaced.  The model's size depends on its parameters and the number of languages only.
    """
    docs = replaced(docs, "lang_pred", "score", "rejected")
    keep = [c for c in docs.columns if c != text]
    schema = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "rejected": F.lit(True)}).schema
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [sent.value.predict(x.as_py()) for x in b.column(0)]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *cols], names=[*keep, "lang_pred", "score", "rejected"])

    return bounded_batches(docs).select(F.col(text).cast("string"), *keep).mapInArrow(run, schema)
