"""Six-connected components of run masks.

A volume is cut into slabs of slices.  Each slab's runs are joined into pieces by one task (a slab has as
many runs as its slices hold, however deep the volume); the pieces that touch across slabs are then joined by
star rounds over piece numbers.  Small and large volumes take the same path.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialise
from . import runs as R
from .graph import connected_components, lowest_roots

#: A node is ``series_id << 40 | linear index of the run's first voxel``.
SHIFT = 40


def nodes(runs: DataFrame, grids: DataFrame) -> DataFrame:
    at = (F.col("k").cast("long") * F.col("h") + F.col("j")) * F.col("w") + F.col("x0")
    return runs.join(grids.select("series_id", "w", "h"), "series_id").withColumn("node", F.shiftleft(F.col("series_id").cast("long"), SHIFT) + at).drop("w", "h")


def edges(numbered: DataFrame) -> DataFrame:
    """Runs that touch across rows or slices: equal row keys after a shift, and a closed overlap."""
    a = numbered.select("series_id", "k", "j", "x0", "x1", F.col("node").alias("u"))
    step = F.explode(F.array(F.struct((F.col("k") + 1).alias("k"), F.col("j").alias("j")), F.struct(F.col("k").alias("k"), (F.col("j") + 1).alias("j"))))
    b = numbered.select("series_id", step.alias("to"), F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("node").alias("v"))
    b = b.select("series_id", "to.k", "to.j", "y0", "y1", "v")
    return a.join(b, ["series_id", "k", "j"]).where("x0 <= y1 and y0 <= x1").select("u", "v")


def _touching(runs: pd.DataFrame, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs, sorted by (k, j, x0), that touch the run in the next row or, if ``across``, in the next slice."""
    k, j, x0, x1 = (runs[c].to_numpy(np.int64) for c in ("k", "j", "x0", "x1"))
    wide, tall = int(x1.max()) + 2, int(j.max() - j.min()) + 2  # a gap after each row and slice
    row = (k - k.min()) * tall + j - j.min()
    start, end = row * wide + x0, np.maximum.accumulate(row * wide + x1)
    us, vs = [], []
    for step in (1, tall)[: 2 if across else 1]:
        to = (row + step) * wide
        first, last = np.searchsorted(end, to + x0), np.searchsorted(start, to + x1, "right")
        many = np.maximum(0, last - first)
        u = np.repeat(np.arange(len(row)), many)
        v = np.arange(len(u)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        fits = (x0[v] <= x1[u]) & (x0[u] <= x1[v])
        us.append(u[fits])
        vs.append(v[fits])
    return np.concatenate(us), np.concatenate(vs)


def _pieces(numbered: DataFrame, slab: int, across: bool = True) -> DataFrame:
    """``(series_id, k, j, x0, x1, node, piece)``: runs joined inside slabs of ``slab`` slices; a piece is its smallest node."""
    base = numbered.select("series_id", "k", "j", "x0", "x1", "node", F.floor(F.col("k") / slab).alias("slab"))
    schema = base.drop("slab").withColumn("piece", F.col("node")).schema

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["k", "j", "x0"], ignore_index=True).drop(columns="slab")
        nodes, at = np.unique(pdf["node"].to_numpy(), return_inverse=True)
        u, v = _touching(pdf, across)
        return pdf.assign(piece=nodes[lowest_roots(at[u], at[v], len(nodes))][at])

    return base.groupBy("series_id", "slab").applyInPandas(solve, schema)


def label(runs: DataFrame, grids: DataFrame, slab: int = 64) -> DataFrame:
    """Runs with ``comp_id``: the linear index of the component's first voxel."""
    numbered = nodes(runs, grids)
    pieces, _ = materialise(_pieces(numbered, slab), "pieces")
    low = pieces.where(F.col("k") % slab == slab - 1).select("series_id", (F.col("k") + 1).alias("k"), "j", F.col("x0").alias("y0"), F.col("x1").alias("y1"), F.col("piece").alias("u"))
    high = pieces.where(F.col("k") % slab == 0).select("series_id", "k", "j", "x0", "x1", F.col("piece").alias("v"))
    stars = connected_components(low.join(high, ["series_id", "k", "j"]).where("x0 <= y1 and y0 <= x1").select("u", "v"))
    roots = pieces.select("node", "piece").dropDuplicates(["node"]).join(stars.withColumnRenamed("node", "piece"), "piece", "left")
    roots = roots.select("node", F.coalesce("root", "piece").alias("root"))
    index = F.col("root").bitwiseAND(F.lit((1 << SHIFT) - 1))
    return numbered.join(roots, "node").select(*runs.columns, index.alias("comp_id"))


def exterior_air(air: DataFrame, grids: DataFrame) -> DataFrame:
    """Runs of air that are linked to the border of their own slice (a flood in two dimensions)."""
    pieces = _pieces(nodes(air, grids), 1, across=False).join(grids.select("series_id", "w", "h"), "series_id")
    edge = (F.col("x0") == 0) | (F.col("x1") == F.col("w") - 1) | (F.col("j") == 0) | (F.col("j") == F.col("h") - 1)
    open_ = pieces.groupBy("series_id", "piece").agg(F.bool_or(edge).alias("open")).where("open")
    return pieces.join(open_, ["series_id", "piece"], "left_semi").select(*R.ROW, "x0", "x1")


def sizes(labelled: DataFrame) -> DataFrame:
    return R.count(labelled, "series_id", "comp_id")


def at_voxel(labelled: DataFrame, series_id: int, i: int, j: int, k: int) -> DataFrame:
    """The component that holds a voxel."""
    seed = labelled.where((F.col("series_id") == series_id) & (F.col("k") == k) & (F.col("j") == j) & F.lit(i).between(F.col("x0"), F.col("x1")))
    return labelled.join(seed.select("series_id", "comp_id"), ["series_id", "comp_id"], "left_semi")


def near_voxel(labelled: DataFrame, series_id: int, i: int, j: int, k: int, reach: int = 2) -> DataFrame:
    """The component of the first voxel met in growing cubes of up to ``reach`` around a voxel; each cube is walked in scan order."""
    dx = F.greatest(F.lit(0), F.col("x0") - i, i - F.col("x1"))
    dist = F.greatest(dx, F.abs(F.col("j") - j), F.abs(F.col("k") - k))
    close = labelled.where((F.col("series_id") == series_id) & (F.abs(F.col("k") - k) <= reach) & (F.abs(F.col("j") - j) <= reach) & (dx <= reach))
    seed = close.groupBy("series_id").agg(F.min_by("comp_id", F.struct(dist, "k", "j", "x0")).alias("comp_id"))
    return labelled.join(seed, ["series_id", "comp_id"], "left_semi")


def at_least(runs: DataFrame, grids: DataFrame, voxels: int) -> DataFrame:
    """Runs of components of at least so many voxels."""
    lab = label(runs, grids)
    keep = sizes(lab).where(F.col("voxels") >= voxels)
    return lab.join(keep, ["series_id", "comp_id"], "left_semi").select(*R.ROW, "x0", "x1")


def fill_holes(runs: DataFrame, grids: DataFrame) -> DataFrame:
    """Background that no face of the volume reaches becomes part of the mask."""
    background = label(R.complement(runs, grids), grids)
    closed = R.touches_border(background, grids, "comp_id").where("not touches")
    holes = background.join(closed, ["series_id", "comp_id"], "left_semi")
    return R.union(runs, holes)


def representative(labelled: DataFrame) -> DataFrame:
    """A voxel inside each component: middle non-empty slice, its middle run, that run's middle."""
    from pyspark.sql import Window

    by = ["series_id", "comp_id"]
    w = Window.partitionBy(*by)
    s = labelled.withColumn("_s", F.dense_rank().over(w.orderBy("k")) - 1)
    s = s.withColumn("_n", F.max("_s").over(w) + 1).where(F.col("_s") == F.floor(F.col("_n") / 2))
    r = s.withColumn("_r", F.row_number().over(w.orderBy("j", "x0")) - 1).withColumn("_m", F.count("*").over(w)).where(F.col("_r") == F.floor(F.col("_m") / 2))
    return r.select(*by, F.floor((F.col("x0") + F.col("x1")) / 2).cast("int").alias("i"), "j", "k")
