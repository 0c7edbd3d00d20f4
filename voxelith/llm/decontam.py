"""Benchmark decontamination by winnowing.

Documents and benchmark items are cut into words and hashed into k-grams; of
each ``span - k + 1`` neighbouring k-gram hashes the smallest is kept.  Texts
that share ``span`` words then share a kept hash (the guarantee of winnowing).
Documents look their kept hashes up among the benchmark's; each hit is extended
left and right, word by word on the texts themselves, and counts if the run
reaches ``span`` words.  Items of fewer words than ``span`` are one window of
their own length and are looked up by exact n-gram.

The benchmark's index is sent to the executors in blocks of at most
``block_words`` words (a bounded broadcast; the driver holds one block at a time).  A
larger benchmark takes more passes over the documents, each of which writes them with
the hits so far.  The documents are never shuffled.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, fresh, materialise, replaced
from .textkit import ALNUM, Words, ngrams, winnow
from .textkit import batches as runs_of


def word_list(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(ALNUM).split()


class Index:
    """Kept hashes and words of one block of benchmark items."""

    def __init__(self, items: list[tuple[object, bytes]], span: int, k: int):
        self.span, self.k = span, k
        self.ids = [i for i, _ in items]
        self.words = [word_list(t) for _, t in items]
        at: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short: dict[int, dict[tuple[bytes, ...], list[int]]] = defaultdict(lambda: defaultdict(list))
        for n, (_, t) in enumerate(items):
            if 0 < len(self.words[n]) < span:
                short[len(self.words[n])][tuple(self.words[n])].append(n)
            elif self.words[n]:
                grams = ngrams(Words([t], ALNUM, fold=True).hashes, k)
                for p in winnow(grams, span - k + 1).tolist():
                    at[int(grams[p])].append((n, p))
        self.at = dict(at)
        self.short = {n: dict(x) for n, x in short.items()}
        self.keys = np.sort(np.array(list(self.at), np.uint64))
        self.short_keys = {n: np.sort(np.array([ngrams(Words([b" ".join(w)], ALNUM, fold=True).hashes, n)[0] for w in x], np.uint64)) for n, x in self.short.items()}

    def hits(self, raws: list[bytes | None]) -> Iterator[tuple[int, list[tuple[int, int]], set[int]]]:
        """Per text: its words, its hit runs ``[start, end)``, and the items (by place) that occur in it."""
        w = Words(raws, ALNUM, fold=True)

        def whole(places: np.ndarray, n: int) -> np.ndarray:
            return places[w.text[places] == w.text[places + n - 1]]

        grams = ngrams(w.hashes, self.k)
        kept = winnow(grams, self.span - self.k + 1)
        kept = whole(kept[_among(self.keys, grams[kept])], self.k)
        seeds: dict[int, list[int]] = defaultdict(list)
        for t, p in zip(w.text[kept].tolist(), kept.tolist(), strict=True):
            seeds[t].append(p)
        short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, keys in self.short_keys.items():
            found = whole(np.flatnonzero(_among(keys, ngrams(w.hashes, n))), n)
            for t, p in zip(w.text[found].tolist(), found.tolist(), strict=True):
                short[t].append((n, p))
        for t, raw in enumerate(raws):
            first, n = int(w.cuts[t]), int(w.cuts[t + 1] - w.cuts[t])
            if t in seeds or t in short:
                yield n, *self._extend(word_list(raw), [(p - first, int(grams[p])) for p in seeds.get(t, ())], [(k, p - first) for k, p in short.get(t, ())])
            else:
                yield n, [], set()

    def _extend(self, words: list[bytes], seeds: list[tuple[int, int]], short: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], set[int]]:
        runs: set[tuple[int, int]] = set()
        found: set[int] = set()
        done: dict[tuple[int, int], int] = {}  # item and diagonal: up to where it is settled
        for p, gram in seeds:
            for item, q in self.at[gram]:
                if done.get((item, p - q), -1) > p:
                    continue
                other = self.words[item]
                a, b = p, q
                while a and b and words[a - 1] == other[b - 1]:
                    a, b = a - 1, b - 1
                c, d = p, q
                while c < len(words) and d < len(other) and words[c] == other[d]:
                    c, d = c + 1, d + 1
                done[item, p - q] = c
                if c - a >= self.span:
                    runs.add((a, c))
                    found.add(item)
        for n, p in short:
            for item in self.short[n].get(tuple(words[p : p + n]), ()):
                runs.add((p, p + n))
                found.add(item)
        return united(runs), found


def _among(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(keys) or not len(x):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def united(runs) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item_id: str, text: str, span: int, k: int, block_words: int) -> Iterator[Index]:
    block: list[tuple[object, bytes]] = []
    size = 0
    for row in benchmark.select(item_id, text).toLocalIterator():
        raw = (row[1] or "").encode()
        if block and size + len(raw) // 2 > block_words:
            yield Index(block, span, k)
            block, size = [], 0
        block.append((row[0], raw))
        size += len(raw) // 2 + 1
    yield Index(block, span, k)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5, block_words: int = 1_000_000, into: str = "contamination") -> DataFrame:
    """``docs`` with a struct ``(n_words long, runs array<struct<start,end>>, items array<string>)``.

    A null or empty text has no words and no hits; a null item has none either.
    Items are named by their id as text and listed once, sorted; a null id is left out
    of the list though its words are hit.  Every input row gives one row; all columns are kept.
    """
    docs = replaced(docs, into)
    if not 1 <= k <= span:
        raise ValueError("k must lie between 1 and span")
    kind = "struct<n_words:long,runs:array<struct<start:long,end:long>>,items:array<string>>"
    schema = docs.withColumn(into, F.lit(None).cast(kind)).schema
    at = docs.columns.index(text)
    target = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])

    names = [*docs.columns, into]

    def scan(sent, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                found = []
                raws = b.column(at).cast(pa.large_binary()).to_pylist()
                before = [None] * b.num_rows if first else b.column(b.num_columns - 1).to_pylist()
                hits = (x for _, part in runs_of(raws) for x in index.hits(part))
                for (n, runs, items), old in zip(hits, before, strict=True):
                    ids = {str(index.ids[i]) for i in items if index.ids[i] is not None}
                    if old:
                        runs = united([*runs, *((r["start"], r["end"]) for r in old["runs"])])
                        ids |= set(old["items"])
                    found.append({"n_words": n, "runs": [{"start": s, "end": e} for s, e in runs], "items": sorted(ids)})
                yield pa.RecordBatch.from_arrays([*(b.columns if first else b.columns[:-1]), pa.array(found, target)], names=names)

        return run

    out, path = bounded_batches(docs), None
    context = docs.sparkSession.sparkContext
    for n, index in enumerate(_blocks(benchmark, item_id, item_text, span, k, block_words)):
        if n:  # a pass is over before the next block comes to the driver
            done, after = materialise(out, "hits")
            if path:
                discard(docs.sparkSession, path)
            out, path = done, after
        out = out.mapInArrow(scan(context.broadcast(index), not n), schema)
    return out


def n_hit(col: str) -> Column:
    """Hit words of a contamination struct (its runs don't overlap)."""
    return F.aggregate(F.col(f"{col}.runs"), F.lit(0).cast("long"), lambda s, r: s + r["end"] - r["start"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """Rows without any hit; the columns stay as they are."""
    mark = fresh(docs, "contamination")
    return contamination(docs, benchmark, into=mark, **params).where(F.size(f"{mark}.runs") == 0).drop(mark)


def digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
