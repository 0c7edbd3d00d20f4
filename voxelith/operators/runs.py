"""Masks as intervals: ``runs(series_id, k, j, x0, x1)``, both ends included.

All set operations are one sweep over interval ends inside a row of voxels
(series, k, j): a single shuffle, windows on the same keys, no voxel ever
expanded.  Rows of voxels are short, so no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW = ("series_id", "k", "j")


def _w(by: tuple[str, ...] = ()):
    return Window.partitionBy(*ROW, *by)


def from_voxels(voxels: DataFrame, keep: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Maximal runs of the voxels (that ``keep`` admits), separately for each value of ``by``."""
    v = (voxels if keep is None else voxels.where(keep)).select(*ROW, *by, "i")
    nth = F.row_number().over(Window.partitionBy(*ROW, *by).orderBy("i"))
    v = v.withColumn("_g", F.col("i") - nth)
    return v.groupBy(*ROW, *by, "_g").agg(F.min("i").alias("x0"), F.max("i").alias("x1")).drop("_g")


def to_voxels(runs: DataFrame) -> DataFrame:
    return runs.select(*[c for c in runs.columns if c not in ("x0", "x1")], F.explode(F.sequence("x0", "x1")).alias("i"))


def merge(runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Join runs that overlap or touch, separately for each value of ``by``."""
    w = _w(by).orderBy("x0", "x1")
    before = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = runs.select(*ROW, *by, "x0", "x1", F.when(F.col("x0") <= before + 1, 0).otherwise(1).alias("_new"))
    numbered = flagged.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*ROW, *by, "_g").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_g")


def _sweep(a: DataFrame, b: DataFrame, want, by: tuple[str, ...] = ()) -> DataFrame:
    def ends(df: DataFrame, which: str) -> DataFrame:
        n = lambda v, of: F.lit(v if which == of else 0)
        start = df.select(*ROW, *by, F.col("x0").alias("x"), n(1, "a").alias("da"), n(1, "b").alias("db"))
        stop = df.select(*ROW, *by, (F.col("x1") + 1).alias("x"), n(-1, "a").alias("da"), n(-1, "b").alias("db"))
        return start.union(stop)

    e = ends(a, "a").union(ends(b, "b")).groupBy(*ROW, *by, "x").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    w = _w(by).orderBy("x")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    e = e.select(*ROW, *by, F.col("x").alias("x0"), (F.lead("x").over(w) - 1).alias("x1"), (F.sum("da").over(upto) > 0).alias("ina"), (F.sum("db").over(upto) > 0).alias("inb"))
    return merge(e.where(want(F.col("ina"), F.col("inb")) & F.col("x1").isNotNull()).select(*ROW, *by, "x0", "x1"), by)


def union(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*ROW, "x0", "x1")
    for m in masks[1:]:
        out = out.union(m.select(*ROW, "x0", "x1"))
    return merge(out)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sweep(a, b, lambda x, y: x & y)


def subtract(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return _sweep(a, b, lambda x, y: x & ~y, by)


def universe(grids: DataFrame) -> DataFrame:
    """One full run for each row of each volume; ``grids(series_id, w, h, d)``."""
    rows = grids.select("series_id", "w", "h", F.explode(F.sequence(F.lit(0), F.col("d") - 1)).alias("k"))
    rows = rows.select("series_id", "k", F.explode(F.sequence(F.lit(0), F.col("h") - 1)).alias("j"), "w")
    return rows.select(*ROW, F.lit(0).alias("x0"), (F.col("w") - 1).alias("x1"))


def complement(runs: DataFrame, grids: DataFrame) -> DataFrame:
    return subtract(universe(grids), runs)


def count(runs: DataFrame, *by: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("voxels"))


def contains(points: DataFrame, runs: DataFrame) -> DataFrame:
    """``points(series_id, k, j, i, ...)`` with ``inside boolean``."""
    r = runs.select(*ROW, "x0", "x1").withColumn("inside", F.lit(True))
    hit = points.join(r, list(ROW), "left").where(F.col("inside").isNull() | F.col("i").between(F.col("x0"), F.col("x1")))
    found = hit.where("inside").select(*points.columns).distinct().withColumn("inside", F.lit(True))
    return points.join(found, points.columns, "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """Runs of ``a`` that share a voxel with ``b``."""
    b = b.select(*ROW, F.col("x0").alias("b0"), F.col("x1").alias("b1")).alias("b")
    a = a.alias("a")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ROW] + [F.col("a.x0") <= F.col("b.b1"), F.col("b.b0") <= F.col("a.x1")]
    return a.join(b, on, "left_semi")


def touches_border(runs: DataFrame, grids: DataFrame, *by: str) -> DataFrame:
    """Whether each group reaches a face of its volume."""
    at = (F.col("k") == 0) | (F.col("k") == F.col("d") - 1) | (F.col("j") == 0) | (F.col("j") == F.col("h") - 1) | (F.col("x0") == 0) | (F.col("x1") == F.col("w") - 1)
    return runs.join(grids, "series_id").groupBy("series_id", *by).agg(F.bool_or(at).alias("touches"))


def plane_pixels(runs: DataFrame, grid: tuple[int, int, int], plane: str, index: int) -> DataFrame:
    """Set pixels ``(row, col)`` of one plane; coronal and sagittal images show high k at the top."""
    d = grid[2]
    if plane == "axial":
        return to_voxels(runs.where(F.col("k") == index)).select("series_id", F.col("j").alias("row"), F.col("i").alias("col"))
    if plane == "coronal":
        return to_voxels(runs.where(F.col("j") == index)).select("series_id", (d - 1 - F.col("k")).alias("row"), F.col("i").alias("col"))
    hit = runs.where(F.lit(index).between(F.col("x0"), F.col("x1")))
    return hit.select("series_id", (d - 1 - F.col("k")).alias("row"), F.col("j").alias("col"))


def invalid(runs: DataFrame, grids: DataFrame) -> DataFrame:
    """Runs outside their volume or with swapped ends."""
    bad = (F.col("k") < 0) | (F.col("k") >= F.col("d")) | (F.col("j") < 0) | (F.col("j") >= F.col("h")) | (F.col("x0") < 0) | (F.col("x0") > F.col("x1")) | (F.col("x1") >= F.col("w"))
    return runs.join(grids, "series_id").where(bad).select(runs.columns)
