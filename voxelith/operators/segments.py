"""Segments: exclusive ranges by priority, edits, and the plan that turns a range into final runs."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import components as C
from . import morphology as M
from . import runs as R


def _code(x: float, up: bool) -> int:
    """Place in the order of all 32-bit floats of the first one at or above ``x`` (or the last at or below)."""
    f = np.float32(x)
    if up and f < x:
        f = np.nextafter(f, np.float32(np.inf))
    elif not up and f > x:
        f = np.nextafter(f, np.float32(-np.inf))
    bits = int((f + np.float32(0)).view(np.int32))
    return bits if bits >= 0 else -(bits & 0x7FFFFFFF)


def _value(code: int) -> float:
    return float(np.int32(abs(code)).view(np.float32)) * (1 if code >= 0 else -1)


def above(x: float) -> float:
    """The next 32-bit float."""
    return _value(_code(x, up=False) + 1)


def below(x: float) -> float:
    return _value(_code(x, up=True) - 1)


@dataclass(frozen=True)
class Segment:
    key: str
    low: float
    high: float
    active: bool = True
    opening: int = 0
    closing: int = 0
    min_voxels: int = 0
    holes: bool = False
    surface_mm: float = 0
    thickness_mm: float = 0
    edited: bool = False

    @property
    def adds(self) -> bool:
        """May hold voxels outside its range."""
        return self.closing > 0 or self.holes

    @property
    def plain(self) -> bool:
        """Nothing but its range decides its voxels."""
        return not (self.adds or self.opening or self.min_voxels or self.surface_mm or self.thickness_mm or self.edited)


@dataclass
class Effective:
    low: float
    high: float
    empty: bool = False
    dropped: list[tuple[float, float]] = field(default_factory=list)
    sources: list[str] = field(default_factory=list)


def _free_pieces(first: int, last: int, edges: np.ndarray, owned: np.ndarray) -> list[tuple[int, int, slice]]:
    """Maximal stretches of unowned cells in ``[first, last]``, cell i being ``edges[i]`` to ``edges[i + 1] - 1``."""
    lo, hi = np.searchsorted(edges, [first, last + 1])
    change = np.flatnonzero(np.diff(np.concatenate([[True], owned[lo:hi], [True]]))) + lo
    return [(int(edges[a]), int(edges[b]) - 1, slice(a, b)) for a, b in zip(change[::2], change[1::2], strict=True)]


def exclusive_ranges(segments: list[Segment], priority: bool = True) -> dict[str, Effective]:
    """Ranges after higher segments took theirs; ``segments`` from top to bottom.

    All bounds cut the line of 32-bit floats into cells.  From the top on, each active plain segment comes to own the cells of the piece
    that it keeps: of what is still free in its range, the piece around the range's middle, or else the
    longest.  A segment's ``sources`` are those above whose final voxels no range describes, see ``_by_voxel``.
    """
    codes = [(_code(s.low, up=True), _code(s.high, up=False)) for s in segments]
    edges = np.unique([x for lo, hi in codes for x in (lo, hi + 1)]).astype(np.int64)
    owned = np.zeros(max(0, len(edges) - 1), bool)
    nobody = np.zeros_like(owned)
    out: dict[str, Effective] = {}
    for s, (first, last) in zip(segments, codes, strict=True):
        pieces = _free_pieces(first, last, edges, owned if priority and s.active else nobody)
        spans = [(float(s.low) if lo == first else _value(lo), float(s.high) if hi == last else _value(hi)) for lo, hi, _ in pieces]
        if not spans:
            out[s.key] = Effective(float(s.low), below(s.low), empty=True)
            continue
        middle = (s.low + s.high) / 2
        best = max(range(len(spans)), key=lambda n: (spans[n][0] <= middle <= spans[n][1], spans[n][1] - spans[n][0], -n))
        out[s.key] = Effective(*spans[best], dropped=[x for n, x in enumerate(spans) if n != best])
        if s.active and s.plain:
            owned[pieces[best][2]] = True
    live = [s for s in segments if s.active and not out[s.key].empty] if priority else []
    for n, s in enumerate(live):
        out[s.key].sources = [u.key for u in live[:n] if _by_voxel(u, out[u.key], s, out[s.key])]
    return out


def _by_voxel(upper: Segment, its: Effective, lower: Segment, own: Effective) -> bool:
    """Whether the final voxels of ``upper`` must be taken from ``lower`` one by one."""
    if lower.adds or upper.adds:
        return True
    return not upper.plain and max(its.low, own.low) <= min(its.high, own.high)


def depends_on(ranges: dict[str, Effective], key: str) -> set[str]:
    """Segments that change when ``key`` does: the closure of the sources."""
    out, todo = set(), [key]
    while todo:
        now = todo.pop()
        for other, e in ranges.items():
            if now in e.sources and other not in out:
                out.add(other)
                todo.append(other)
    return out


def final_runs(voxels: DataFrame, grids: DataFrame, segments: list[Segment], spacing, priority: bool = True, edits: DataFrame | None = None) -> dict[str, DataFrame]:
    """Runs of each active segment: range, minus its sources, post-processing, minus the sources again if it adds, edits.

    Each segment is one scan with its range as a pushed-down filter; ``edits(segment, kind, series_id, k, j, x0, x1)`` has kinds keep and exclude.
    """
    ranges = exclusive_ranges(segments, priority)
    out: dict[str, DataFrame] = {}
    for s in segments:
        e = ranges[s.key]
        if not s.active:
            continue
        runs = R.from_voxels(voxels, F.lit(False) if e.empty else S.inside(F.col("hu"), e.low, e.high))
        for u in e.sources:
            runs = R.subtract(runs, out[u])
        air = R.from_voxels(voxels, F.col("hu") < s.low) if s.surface_mm > 0 else None
        runs = M.postprocess(runs, grids, spacing, air, s.surface_mm, s.thickness_mm, s.opening, s.closing, s.holes, s.min_voxels)
        for u in e.sources if s.adds else ():
            runs = R.subtract(runs, out[u])
        out[s.key] = apply_edits(runs, edits.where(F.col("segment") == s.key)) if edits is not None else runs
    return out


def apply_edits(runs: DataFrame, edits: DataFrame) -> DataFrame:
    """Intersect with what is kept (if anything is) and subtract what is excluded."""
    keep = edits.where("kind = 'keep'").select(*R.ROW, "x0", "x1")
    gone = edits.where("kind = 'exclude'").select(*R.ROW, "x0", "x1")
    kept = R.intersect(runs, keep) if keep.take(1) else runs.select(*R.ROW, "x0", "x1")
    return R.subtract(kept, gone)


def class_at(voxels: DataFrame, ranges: list[tuple[str, float, float]]) -> DataFrame:
    """The first segment, in pick order, whose range holds the voxel (null for none)."""
    key = F.coalesce(*(F.when(S.inside(F.col("hu"), low, high), name) for name, low, high in ranges))
    return voxels.withColumn("segment", key)


def inherit_regions(components: DataFrame, old: DataFrame, most: int = 64) -> DataFrame:
    """New components matched to old regions by shared voxels: the first old region (smallest order) passes its id on once.

    ``components`` are labelled runs, ``old(series_id, region_id, ord, k, j, x0, x1)``; the largest ``most`` per series come back.
    """
    a, b = components.alias("a"), old.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in R.ROW] + [F.col("a.x0") <= F.col("b.x1"), F.col("b.x0") <= F.col("a.x1")]
    met = a.join(b, on).groupBy("a.series_id", "comp_id").agg(F.min_by("region_id", "ord").alias("region_id"))
    sized = C.sizes(components).join(met, ["series_id", "comp_id"], "left")
    first = F.row_number().over(Window.partitionBy("series_id", "region_id").orderBy(F.desc("voxels"), "comp_id"))
    ranked = sized.withColumn("inherits", F.col("region_id").isNotNull() & (first == 1))
    order = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("voxels"), "comp_id"))
    return ranked.withColumn("rank", order).where(F.col("rank") <= most)


class EditLog:
    """Versions of an edit table with undo and redo; each version is a DataFrame and stays as it is."""

    def __init__(self, start: DataFrame, most: int = 20):
        self.now, self._past, self._next, self._most = start, [], [], most

    def add(self, segment: str, kind: str, runs: DataFrame) -> DataFrame:
        rows = runs.select(F.lit(segment).alias("segment"), F.lit(kind).alias("kind"), *R.ROW, "x0", "x1")
        self._past = [*self._past, self.now][-self._most :]
        self._next, self.now = [], self.now.unionByName(rows)
        return self.now

    def undo(self) -> DataFrame:
        if self._past:
            self._next.append(self.now)
            self.now = self._past.pop()
        return self.now

    def redo(self) -> DataFrame:
        if self._next:
            self._past.append(self.now)
            self.now = self._next.pop()
        return self.now

    def reset(self, segment: str) -> DataFrame:
        """Take all edits of a segment away, as one step that can be undone."""
        self._past = [*self._past, self.now][-self._most :]
        self._next, self.now = [], self.now.where(F.col("segment") != segment)
        return self.now
