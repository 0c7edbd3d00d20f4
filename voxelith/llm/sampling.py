"""Bounded training samples of labelled rows.

Rows are drawn by a hash of their id, so a sample is the same at every run and
on any number of executors; for each label at most about ``per_label`` rows of
at most ``most_chars`` characters are taken, and about ``most_rows`` in all (the only bounds; everything that is
scored or counted covers all rows and whole texts).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRAWS = 1 << 30


def _draw(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(DRAWS))


def drawn_rows(docs: DataFrame, labels: DataFrame | None, label: str, usable, per_label: dict | int, doc_id: str = "doc_id", text: str = "text", most_chars: int = 20_000, most_rows: int = 8_000) -> DataFrame:
    """``(sample_id, sample_text, sample_label)`` of the sample.

    Other columns don't matter.  ``labels(doc_id, label)`` is joined, or ``docs`` has the label itself if it is
    None; ``usable(doc_id column)`` says which rows may teach.
    """
    docs = docs.select(doc_id, text, label) if labels is None else docs.select(doc_id, text)
    known = (docs if labels is None else labels).where(F.col(label).isNotNull() & usable(F.col(doc_id)))
    known = known.select(F.col(doc_id).alias("sample_id"), F.col(label).alias("sample_label"))
    counts = {r[0]: r[1] for r in known.groupBy("sample_label").count().collect()}
    if len(counts) > 1000:
        raise ValueError("more than 1000 labels")
    want = per_label if isinstance(per_label, dict) else dict.fromkeys(counts, per_label)
    shrink = min(1.0, most_rows / max(1, sum(min(n, want.get(v, 0)) for v, n in counts.items())))
    cut = F.lit(0)
    for value, n in counts.items():
        cut = F.when(F.col("sample_label") == F.lit(value), F.lit(min(DRAWS, int(DRAWS * shrink * want.get(value, 0) / n)))).otherwise(cut)
    drawn = known.where(_draw(F.col("sample_id")) < cut)
    fine = F.col(text).isNotNull() & (F.length(text) <= most_chars)
    if labels is None:
        rows = docs.where(F.col(label).isNotNull() & usable(F.col(doc_id)) & fine).withColumnsRenamed({doc_id: "sample_id", label: "sample_label"}).where(_draw(F.col("sample_id")) < cut)
    else:
        # a bounded table: about per_label rows for each label
        rows = docs.where(fine).join(F.broadcast(drawn.dropDuplicates(["sample_id"])), F.col(doc_id) == F.col("sample_id"))
    return rows.select("sample_id", F.col(text).alias("sample_text"), "sample_label")


def ordered(rows) -> list[tuple[str, object]]:
    """``(text, label)`` in the order of the draw."""
    return [(t, y) for _, t, y in sorted(rows, key=lambda r: (hash_order(str(r[0])), str(r[0]), r[1]))]


def sample(*args, **params) -> list[tuple[str, object]]:
    """``(text, label)`` of ``drawn_rows``, on the driver."""
    return ordered(tuple(r) for r in drawn_rows(*args, **params).collect())


def learn(rows: DataFrame, train):
    """``train`` on the sample, in one task: neither the texts nor what training needs burden the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        model = train([(t.encode(), int(y)) for t, y in ordered(got)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    got = rows.repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(got[0]) if got else train([])


def hash_order(x: str) -> int:
    import zlib

    return zlib.crc32(x.encode())
