"""Exact top-k search by the threshold algorithm.

Vectors are scaled to whole numbers, so scores are exact.  Candidates are
stored in blocks; each block keeps its rows sorted along every dimension.  For
a query the lists are walked in step from the end that raises the score
(descending where the query is positive, ascending where it is negative).  Rows
seen are scored in full; the bound is the score of an imaginary row made of the
values at the walk's front.  When the bound falls below the kth best score, no
unseen row can enter the result and the walk stops.  The kth best of the blocks
a task has done carries over to the next, so later blocks stop sooner.

Query blocks (``query_block`` queries at most on average) meet candidate blocks
by an equi-join on query block and salt, so neither side is sent whole to
anybody; each task returns k rows for each query, and a partial rank limit cuts
them again before the last shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise


def integral(df: DataFrame, vector: str, scale: int) -> DataFrame:
    """Replace the vector by whole numbers ``floor(scale * x)``; rows that are null or hold null or non-finite parts go."""
    x = F.col(vector)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    fine = x.isNotNull() & ~F.exists(F.transform(x, lambda v: v.cast("double")), bad)
    return df.where(fine).withColumn(vector, F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")))


def matrix(lists) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(width, row places, int64 matrix)`` for each width among list values."""
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()
    widths = np.diff(offsets)
    return [(int(w), at := np.flatnonzero(widths == w), flat[offsets[at][:, None] + np.arange(w)]) for w in np.unique(widths)]


LONG = (1 << 63) - 1


class Block:
    """Candidates of one width, sorted along each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((*x.T[::-1], ids))
        ids, x = ids[order], x[order]
        new = np.ones(len(ids), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)  # repeated rows count once
        self.ids, self.x = ids[new], x[new]
        self.most = max(abs(int(self.x.min(initial=0))), abs(int(self.x.max(initial=0))))
        self.exact = self.x.astype(np.float64)  # products stay whole below 2**53
        self.low, self.high = (f(self.x, axis=0, initial=0) for f in (np.min, np.max))
        self.lists = np.argsort(self.x, axis=0, kind="stable").astype(np.int32)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Integer inner products; those beyond the range of a long are the nearest long."""
        most = self.most * max(map(abs, q.tolist()), default=0) * max(1, len(q))
        if most < 1 << 53:
            return (self.exact[rows] @ q.astype(np.float64)).astype(np.int64)
        if most < 1 << 63:
            return self.x[rows] @ q
        return np.array([min(LONG, max(-LONG - 1, v)) for v in (self.x[rows].astype(object) @ q.astype(object)).tolist()], np.int64)

    def bound(self, q: np.ndarray) -> int:
        """No row scores more: the best value of each dimension (zero at least, where a block is on one side of it)."""
        return min(LONG, sum(max(a * int(x), b * int(x)) for a, b, x in zip(self.low.tolist(), self.high.tolist(), q.tolist(), strict=True)))

    def search(self, own: int, q: np.ndarray, k: int, best: list[tuple[int, int]], first: int = 16) -> list[tuple[int, int]]:
        """Merge this block into ``best``, pairs of (-score, id) in order."""
        n = len(self.ids)
        if len(best) == k and self.bound(q) < -best[-1][0]:
            return best
        dims = np.flatnonzero(q)
        if not len(dims):  # every score is zero: smallest ids win
            return sorted(set(best) | {(0, i) for i in np.unique(self.ids[self.ids != own])[:k].tolist()})[:k]
        up = q[dims] > 0
        seen = np.zeros(n, bool)
        depth, step = 0, first
        while depth < n:
            end = min(n, depth + step)
            ranks = np.arange(depth, end)
            at = np.where(up, n - 1 - ranks[:, None], ranks[:, None])
            rows = self.lists[at, dims]
            new = np.unique(rows[~seen[rows]])
            seen[new] = True
            new = new[self.ids[new] != own]
            if len(new):
                s = self.scores(new, q)
                if len(new) > k:  # of equal scores the smaller ids, which come first
                    low = np.partition(s, len(s) - k)[len(s) - k]
                    above, tied = s > low, np.flatnonzero(s == low)[:k]
                    pick = np.concatenate([np.flatnonzero(above), tied])
                    new, s = new[pick], s[pick]
                best = sorted({*best, *((-v, i) for v, i in zip(s.tolist(), self.ids[new].tolist(), strict=True))})[:k]
            front = self.x[rows[-1], dims]
            bound = min(LONG, max(-LONG - 1, sum(a * b for a, b in zip(front.tolist(), q[dims].tolist(), strict=True))))
            if len(best) == k and bound < -best[-1][0]:
                break
            depth, step = end, step * 2
        return best


def topk(queries: DataFrame, candidates: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024, query_block: int = 4096, block: int = 8192, salts: int = 32) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k largest integer inner products, ties to the smaller id.

    A candidate with the query's own id is left out, and vectors of another
    width than the query's don't compare.  Ids are whole numbers; rows with a null
    id take no part.  Rows that repeat an id and vector count once.  Scores beyond the range of a long are
    the nearest long, and tie there.  Other columns play no part; empty tables give no rows.
    """
    clean = lambda df: integral(df.select(F.col(vec_id).cast("long").alias(vec_id), vector).where(F.col(vec_id).isNotNull()), vector, scale)
    asked, _ = materialise(clean(queries), "queries")
    blocks = max(1, -(-asked.count() // query_block))
    asked = asked.distinct().select(F.pmod(F.xxhash64(vec_id, vector), F.lit(blocks)).alias("qb"), F.struct(F.col(vec_id).alias("id"), F.col(vector).alias("x")).alias("q"))
    asked = asked.groupBy("qb").agg(F.collect_list("q").alias("queries"))
    asked = asked.select("qb", "queries", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(ids, lists):
            return pa.RecordBatch.from_arrays([pa.array([int(ids[0]) % salts], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([lists], pa.list_(pa.list_(pa.int64())))], names=["salt", "ids", "vectors"])

        ids, lists = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            lists += b.column(1).to_pylist()
            while len(ids) >= block:
                yield out(ids[:block], lists[:block])
                ids, lists = ids[block:], lists[block:]
        if ids:
            yield out(ids, lists)

    stored = clean(candidates).mapInArrow(gather, "salt int, ids array<long>, vectors array<array<long>>")
    met = stored.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("qb")).join(asked.hint("shuffle_hash"), ["qb", "salt"])

    def results(best: dict) -> Iterator[pa.RecordBatch]:
        rows = [(own, i, -s) for (own, _), found in best.items() for s, i in found]
        for at in range(0, len(rows), 50_000):
            cols = list(zip(*rows[at : at + 50_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_id", "vec_id", "score"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, bytes], list[tuple[int, int]]] = {}
        for b in batches:
            for row in range(b.num_rows):
                ids = np.array(b.column("ids")[row].values)
                parts = {w: Block(ids[at], x) for w, at, x in matrix(b.column("vectors")[row].values)}
                asked = b.column("queries")[row].values
                qids = asked.field("id").to_numpy()
                for w, at, x in matrix(asked.field("x")):
                    if w in parts:
                        for own, q in zip(qids[at].tolist(), x, strict=True):
                            key = (own, q.tobytes())
                            best[key] = parts[w].search(own, q, k, best.get(key, []))
                if len(best) > 4 * query_block:  # what a task keeps is bounded; the final rank is over all results
                    yield from results(best)
                    best = {}
        yield from results(best)

    found = met.select("ids", "vectors", "queries").mapInArrow(search, "query_id long, vec_id long, score long").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
