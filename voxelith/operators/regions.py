"""Regions of an analysis: adding, merging, trimming after edits, and selecting with a lasso.

``regions(series_id, region_id long, segments array<string>, selected, visible, merged boolean)`` says what regions there
are; ids of a series grow as regions are made.  ``runs(series_id, region_id, k, j, x0, x1)`` has their voxels; regions may
overlap.  All steps work on the regions of any number of series at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import components as C
from . import geometry as G
from . import runs as R

META = ("series_id", "region_id", "segments", "selected", "visible", "merged")
KEY = ["series_id", "region_id"]
RUN = ("series_id", "region_id", "k", "j", "x0", "x1")


def sized(regions: DataFrame, runs: DataFrame, voxel_mm3: float) -> DataFrame:
    """The regions with ``voxels`` and ``mm3``; those without a voxel are gone."""
    return regions.join(R.count(runs, *KEY), KEY).withColumn("mm3", F.col("voxels") * voxel_mm3)


def _numbered(regions: DataFrame, new: DataFrame) -> DataFrame:
    """``new(series_id, _order, ...)`` with ids after the last of its series."""
    last = regions.groupBy("series_id").agg(F.max("region_id").alias("_last"))
    nth = F.row_number().over(Window.partitionBy("series_id").orderBy("_order"))
    return new.join(last, "series_id", "left").withColumn("region_id", F.coalesce("_last", F.lit(0)) + nth).drop("_last")


def add(regions: DataFrame, runs: DataFrame, new: DataFrame, new_runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add ``new(series_id, new_id, segments, merged)`` with ``new_runs(series_id, new_id, k, j, x0, x1)``, selected and shown.

    One that shares a voxel with a region of its (first) segment is not added; the first such region is selected and shown instead.
    """
    old = runs.join(regions.select(*KEY, "segments"), KEY).alias("o")
    own = new_runs.join(new.select("series_id", "new_id", F.col("segments")[0].alias("segment")), ["series_id", "new_id"]).alias("n")
    on = [F.col(f"o.{c}") == F.col(f"n.{c}") for c in R.ROW] + [F.col("o.x0") <= F.col("n.x1"), F.col("n.x0") <= F.col("o.x1")]
    met = own.join(old, on).where(F.array_contains("o.segments", F.col("n.segment")))
    met = met.groupBy("n.series_id", "new_id").agg(F.min("region_id").alias("region_id"))
    again = met.select(*KEY).distinct().withColumn("_again", F.lit(True))
    kept = regions.join(again, KEY, "left")
    hit = F.coalesce("_again", F.lit(False))
    kept = kept.withColumn("selected", F.col("selected") | hit).withColumn("visible", F.col("visible") | hit)
    fresh = _numbered(regions, new.join(met, ["series_id", "new_id"], "left_anti").withColumn("_order", F.col("new_id")))
    fresh = fresh.withColumn("selected", F.lit(True)).withColumn("visible", F.lit(True))
    added = new_runs.join(fresh.select("series_id", "new_id", "region_id"), ["series_id", "new_id"]).select(*RUN)
    return kept.select(*META).unionByName(fresh.select(*META)), runs.select(*RUN).unionByName(added)


def merge_selected(regions: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The selected regions of each series become one of their union and of all their segments; a single selected one stays as it is."""
    many = regions.where("selected").groupBy("series_id").agg(F.count("*").alias("n")).where("n > 1").select("series_id")
    gone = regions.where("selected").join(many, "series_id", "left_semi")
    apart = gone.select("series_id", "region_id", F.posexplode("segments").alias("at", "segment"))
    first = apart.groupBy("series_id", "segment").agg(F.min(F.struct("region_id", "at")).alias("at"))
    names = first.groupBy("series_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "segment"))), lambda s: s["segment"]).alias("segments"))
    one = _numbered(regions, names.withColumn("_order", F.lit(0)))
    one = one.select("series_id", "region_id", "segments", *(F.lit(True).alias(c) for c in META[3:]))
    union = R.merge(runs.join(gone.select(*KEY), KEY, "left_semi")).join(one.select(*KEY), "series_id")
    left = regions.join(gone.select(*KEY), KEY, "left_anti")
    rest = runs.join(gone.select(*KEY), KEY, "left_anti")
    return left.select(*META).unionByName(one), rest.select(*RUN).unionByName(union.select(*RUN))


def trim(regions: DataFrame, runs: DataFrame, segment: str, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cut the regions of just this segment to its ``edits(kind, series_id, k, j, x0, x1)``; those left without a voxel go.

    Kind ``keep``, if a series has any, is all that stays of its regions; kind ``exclude`` goes from them.
    """
    own = regions.where((F.size("segments") == 1) & (F.col("segments")[0] == segment)).select(*KEY)
    mine, others = runs.join(own, KEY, "left_semi").select(*RUN), runs.join(own, KEY, "left_anti").select(*RUN)
    keep = R.merge(edits.where("kind = 'keep'")).select(*R.ROW, F.col("x0").alias("y0"), F.col("x1").alias("y1"))
    limited = keep.select("series_id").distinct()
    inside = mine.join(keep, list(R.ROW)).where("x0 <= y1 and y0 <= x1").select("series_id", "region_id", "k", "j", F.greatest("x0", "y0").alias("x0"), F.least("x1", "y1").alias("x1"))
    cut = inside.unionByName(mine.join(limited, "series_id", "left_anti"))
    rows = cut.select(*R.ROW, "region_id").distinct()
    gone = edits.where("kind = 'exclude'").select(*R.ROW, "x0", "x1").join(rows, list(R.ROW))
    cut = R.subtract(cut, gone, ("region_id",)).select(*RUN)
    empty = own.join(cut.select(*KEY).distinct(), KEY, "left_anti")
    return regions.join(empty, KEY, "left_anti").select(*META), others.unionByName(cut)


def _pieces(runs: DataFrame, grids: DataFrame, by: str, loop, matrix) -> DataFrame:
    """Runs with ``comp_id`` and ``inside``, whether the whole component lies in the loop, for each value of ``by`` apart.

    Each value counts as a volume of its own: its rank in its series and the series number make the number of that volume.
    """
    names = runs.select("series_id", by).distinct()
    most = names.groupBy("series_id").count().agg(F.max("count")).first()[0] or 1
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(by)) - 1
    names = names.withColumn("_volume", (F.col("series_id") * F.lit(most) + rank).cast("int"))
    apart = runs.join(names, ["series_id", by]).select(F.col("_volume").alias("series_id"), "k", "j", "x0", "x1")
    volumes = names.join(grids, "series_id").select(F.col("_volume").alias("series_id"), "w", "h", "d")
    labelled = C.label(apart, volumes)
    found = labelled.join(G.runs_in_polygon(labelled, loop, matrix), ["series_id", "comp_id"])
    return found.withColumnRenamed("series_id", "_volume").join(names, "_volume").drop("_volume")


def lasso_select(regions: DataFrame, runs: DataFrame, segment_runs: DataFrame, grids: DataFrame, loop, matrix) -> tuple[DataFrame, DataFrame]:
    """Add one region for each segment of ``segment_runs(segment, series_id, k, j, x0, x1)``: its components wholly inside the loop."""
    inside = _pieces(segment_runs, grids, "segment", loop, matrix).where("inside")
    found = inside.groupBy("series_id", "segment").agg(F.count_distinct("comp_id").alias("n"))
    new = found.select("series_id", F.col("segment").alias("new_id"), F.array("segment").alias("segments"), (F.col("n") > 1).alias("merged"))
    return add(regions, runs, new, inside.select("series_id", F.col("segment").alias("new_id"), "k", "j", "x0", "x1"))


def lasso_deselect(regions: DataFrame, runs: DataFrame, grids: DataFrame, loop, matrix, segments: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Components of selected regions (of these segments) that lie wholly inside the loop leave the selection.

    A region of which all components do is deselected; of one of which some do they become a new region, not selected.
    """
    chosen = regions.where("selected")
    if segments is not None:
        chosen = chosen.where(F.arrays_overlap("segments", F.array(*map(F.lit, segments))))
    pieces = _pieces(runs.join(chosen.select(*KEY), KEY, "left_semi"), grids, "region_id", loop, matrix)
    of = lambda c, name: F.count_distinct(F.when(c, F.col("comp_id"))).alias(name)
    counts = pieces.groupBy(*KEY).agg(of(F.col("inside"), "n_in"), of(~F.col("inside"), "n_out")).where("n_in > 0")
    split = counts.where("n_out > 0").withColumnRenamed("region_id", "of")
    split = _numbered(regions, split.withColumn("_order", F.col("of")))
    met = regions.join(counts, KEY, "left")
    selected = F.col("selected") & ~F.coalesce(F.col("n_out") == 0, F.lit(False))
    merged = F.when(F.col("n_out") > 0, F.col("n_out") > 1).otherwise(F.col("merged"))
    kept = met.withColumn("selected", selected).withColumn("merged", merged).select(*META)
    source = regions.select("series_id", F.col("region_id").alias("of"), "segments", "visible")
    new = split.join(source, ["series_id", "of"]).select("series_id", "region_id", "segments", F.lit(False).alias("selected"), "visible", (F.col("n_in") > 1).alias("merged"))
    torn = pieces.withColumnRenamed("region_id", "of").join(split.select("series_id", "of", "region_id"), ["series_id", "of"])
    torn = torn.select("series_id", F.when(F.col("inside"), F.col("region_id")).otherwise(F.col("of")).alias("region_id"), "k", "j", "x0", "x1")
    rest = runs.join(split.select("series_id", F.col("of").alias("region_id")), KEY, "left_anti").select(*RUN)
    return kept.unionByName(new), rest.unionByName(torn)
