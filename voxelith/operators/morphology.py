"""Morphology of run masks with the six-neighbour cross, and offset balls.

Erosion and dilation shift whole runs, never voxels: a dilation is the union of
the runs grown by one and of their copies in the four neighbouring rows; an erosion is
the dilation of the complement, where everything outside the volume counts as
background.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components as C
from . import runs as R


def _inside(runs: DataFrame, grids: DataFrame) -> DataFrame:
    r = runs.join(grids, "series_id").where("k >= 0 and k < d and j >= 0 and j < h and x1 >= 0 and x0 < w")
    return r.select(*R.ROW, F.greatest("x0", F.lit(0)).alias("x0"), F.least("x1", F.col("w") - 1).alias("x1"))


def _spread(runs: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """Copies of the runs moved by (dk, dj) and grown by an x-reach."""
    moves = F.explode(F.array(*(F.struct(F.lit(dk).alias("dk"), F.lit(dj).alias("dj"), F.lit(dx).alias("dx")) for dk, dj, dx in offsets)))
    m = runs.select(*R.ROW, "x0", "x1", moves.alias("m"))
    return m.select("series_id", (F.col("k") + F.col("m.dk")).alias("k"), (F.col("j") + F.col("m.dj")).alias("j"), (F.col("x0") - F.col("m.dx")).alias("x0"), (F.col("x1") + F.col("m.dx")).alias("x1"))


CROSS = [(0, 0, 1), (0, 1, 0), (0, -1, 0), (1, 0, 0), (-1, 0, 0)]


def dilate(runs: DataFrame, grids: DataFrame, radius: int = 1) -> DataFrame:
    for _ in range(radius):
        runs = R.merge(_inside(_spread(runs, CROSS), grids))
    return runs


def erode(runs: DataFrame, grids: DataFrame, radius: int = 1) -> DataFrame:
    wide = grids.select("series_id", (F.col("w") + 2).alias("w"), (F.col("h") + 2).alias("h"), (F.col("d") + 2).alias("d"))
    one = lambda df, by: df.select("series_id", (F.col("k") + by).alias("k"), (F.col("j") + by).alias("j"), (F.col("x0") + by).alias("x0"), (F.col("x1") + by).alias("x1"))
    for _ in range(radius):
        outside = R.complement(one(runs, 1), wide)  # one voxel of background all around
        runs = R.subtract(runs, one(R.merge(_inside(_spread(outside, CROSS), wide)), -1))
    return runs


def opening(runs: DataFrame, grids: DataFrame, radius: int = 1) -> DataFrame:
    return dilate(erode(runs, grids, radius), grids, radius)


def closing(runs: DataFrame, grids: DataFrame, radius: int = 1) -> DataFrame:
    return erode(dilate(runs, grids, radius), grids, radius)


#: Fixed value: what a reach may miss of a whole voxel by rounding.
ROUNDING = 1e-9


def ball(radius_mm: float, spacing: tuple[float, float, float]) -> list[tuple[int, int, int]]:
    """Row spans of an ellipsoid of voxels: (dk, dj, x-reach)."""
    dj, dk = (np.arange(-n, n + 1) for n in (int(radius_mm / s + ROUNDING) for s in spacing[1:]))
    left = radius_mm**2 - (dk[:, None] * spacing[2]) ** 2 - (dj[None, :] * spacing[1]) ** 2
    reach = (np.sqrt(left.clip(min=0)) / spacing[0] + ROUNDING).astype(int)
    return [(int(dk[z]), int(dj[y]), int(reach[z, y])) for z, y in np.argwhere(left >= -ROUNDING)]


def near(runs: DataFrame, grids: DataFrame, radius_mm: float, spacing: tuple[float, float, float]) -> DataFrame:
    """All voxels within a distance of the mask."""
    return R.merge(_inside(_spread(runs, ball(radius_mm, spacing)), grids))


def box(runs: DataFrame, grids: DataFrame, radius: int) -> DataFrame:
    """Dilation by a cube (26 neighbours for radius 1)."""
    span = range(-radius, radius + 1)
    return R.merge(_inside(_spread(runs, [(dk, dj, radius) for dk in span for dj in span]), grids))


def strip_surface(runs: DataFrame, air: DataFrame, grids: DataFrame, surface_mm: float, spacing) -> DataFrame:
    """Drop voxels within ``surface_mm`` of air."""
    return R.subtract(runs, near(air, grids, surface_mm, spacing)) if surface_mm > 0 else runs


def open_ball(runs: DataFrame, grids: DataFrame, thickness_mm: float, spacing) -> DataFrame:
    """Opening by a ball of diameter ``thickness_mm``: regions thinner than that go.  Outside the volume nothing erodes."""
    if thickness_mm <= 0:
        return runs
    gone = near(R.complement(runs, grids), grids, thickness_mm / 2, spacing)
    core = R.subtract(runs, gone)
    return R.intersect(runs, near(core, grids, thickness_mm / 2, spacing))


def distance_layers(runs: DataFrame, air: DataFrame, grids: DataFrame, spacing, layers: int = 8) -> DataFrame:
    """Disjoint runs with ``layer``: 1..layers voxels (of the finest in-plane step) from air, ``layers + 1`` beyond."""
    step = min(spacing[0], spacing[1])
    left, out = runs, None
    for n in range(1, layers + 1):
        close = near(air, grids, n * step, spacing)
        part = R.intersect(left, close).withColumn("layer", F.lit(n))
        left = R.subtract(left, close)
        out = part if out is None else out.unionByName(part)
    return out.unionByName(left.withColumn("layer", F.lit(layers + 1)))


def postprocess(runs: DataFrame, grids: DataFrame, spacing, air: DataFrame | None = None, surface_mm: float = 0, thickness_mm: float = 0, opening_radius: int = 0, closing_radius: int = 0, holes: bool = False, min_voxels: int = 0) -> DataFrame:
    """Thin regions, opening, closing, hole filling, small components: always in this order."""
    if air is not None:
        runs = strip_surface(runs, air, grids, surface_mm, spacing)
    runs = open_ball(runs, grids, thickness_mm, spacing)
    runs = opening(runs, grids, opening_radius) if opening_radius else runs
    runs = closing(runs, grids, closing_radius) if closing_radius else runs
    runs = C.fill_holes(runs, grids) if holes else runs
    return C.at_least(runs, grids, min_voxels) if min_voxels > 0 else runs
