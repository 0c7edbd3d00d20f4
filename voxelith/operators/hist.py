"""One-unit histograms ``hist(series_id, [segment,] bin, n)`` and statistics on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from . import runs as R

PERCENTILES = (5, 25, 50, 75, 95)


def histogram(voxels: DataFrame, *by: str) -> DataFrame:
    """Counts of each bin; values are rounded half up and clamped to the end bins, NaN and null are left out."""
    v = voxels.where(F.col("hu").isNotNull() & ~F.isnan(F.col("hu").cast("double")))
    return v.groupBy("series_id", *by, S.hu_to_bin(F.col("hu")).alias("bin")).agg(F.count("*").alias("n"))


def in_runs(voxels: DataFrame, runs: DataFrame) -> DataFrame:
    """Voxels inside a mask: runs are expanded to voxels of their rows and joined on the full key."""
    return voxels.join(R.to_voxels(runs.select(*R.ROW, "x0", "x1")), [*R.ROW, "i"], "left_semi")


def merge(*hists: DataFrame, by: tuple[str, ...] = ("series_id",)) -> DataFrame:
    out = hists[0]
    for h in hists[1:]:
        out = out.unionByName(h)
    return out.groupBy(*by, "bin").agg(F.sum("n").cast("long").alias("n"))


def scale(hist: DataFrame, k: float) -> DataFrame:
    return hist.withColumn("n", S.round_half_up(F.col("n") * k).cast("long"))


def in_range(hist: DataFrame, low: float, high: float) -> DataFrame:
    """The histogram of a plain range is a slice of the whole one (no second scan of the voxels)."""
    import math

    first, last = math.ceil(low - 0.5), math.floor(high + 0.5)
    if first > last or last < S.HIST_MIN or first > S.HIST_MAX:
        return hist.where(F.lit(False))
    place = lambda v: min(max(v - S.HIST_MIN, 0), S.HIST_BINS - 1)
    return hist.where(F.col("bin").between(place(first), place(last)))


def stats(hist: DataFrame, *by: str) -> DataFrame:
    """Count, mean, population deviation, extremes and nearest-rank percentiles of the bins' values."""
    keys = ["series_id", *by]
    h = hist.where("n > 0").withColumn("v", S.bin_to_hu(F.col("bin")))
    totals = h.groupBy(*keys).agg(F.sum("n").alias("count"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    cum = h.withColumn("_c", F.sum("n").over(w)).join(totals, keys)
    at = lambda p: F.min(F.when(F.col("_c") >= F.greatest(F.lit(1), F.ceil(F.col("count") * p / 100)), F.col("v"))).alias(f"p{p}")
    sd = F.sqrt(F.sum(F.col("n") * (F.col("v") - F.col("mean")) * (F.col("v") - F.col("mean"))) / F.first("count")).alias("sd")
    return cum.groupBy(*keys).agg(*(F.first(c).alias(c) for c in ("count", "mean", "min", "max")), sd, *(at(p) for p in PERCENTILES))


def rebinned(hist: DataFrame, low: int, high: int, columns: int) -> DataFrame:
    v = S.bin_to_hu(F.col("bin"))
    return hist.where(v.between(low, high)).groupBy("series_id", S.rebin(v, low, high, columns).alias("col")).agg(F.sum("n").cast("long").alias("n"))


def draft(voxels: DataFrame, d: int, slices: int = 80, least: int = 240) -> DataFrame:
    """Every so many slices of a deep volume, for a first estimate."""
    step = -(-d // slices) if d >= least else 1
    return voxels.where(F.col("k") % step == 0)


def profile_stats(samples: DataFrame, value: Column, *by: str) -> DataFrame:
    """Exact mean, deviation and extremes of raw values; percentiles from one-unit bins."""
    s = samples.where(value.isNotNull() & ~F.isnan(value)).withColumn("hu", value)
    exact = s.groupBy(*by).agg(F.count("*").alias("count"), F.avg("hu").alias("mean"), F.stddev_pop("hu").alias("sd"), F.min("hu").alias("min"), F.max("hu").alias("max"))
    binned = stats(histogram(s.withColumn("series_id", F.lit(0)), *by), *by)
    return exact.join(binned.select(*by, *(f"p{p}" for p in PERCENTILES)), list(by))


def nearest_line(lines: DataFrame, x: Column, tolerance: float = 6) -> DataFrame:
    """Per series of ``lines(series_id, line, at)``: the line nearest to ``x`` within the tolerance; of equally near ones the first."""
    away = F.abs(F.col("at") - x)
    return lines.where(away <= tolerance).groupBy("series_id").agg(F.min_by("line", F.struct(away, "line")).alias("line"))


def process_stats(before: DataFrame, after: DataFrame, body: DataFrame, total: int) -> DataFrame:
    """Per series: voxels before and after post-processing, of the body, of the result inside the body, and the volume's."""
    count = lambda runs, name: R.count(runs, "series_id").withColumnRenamed("voxels", name)
    out = count(before, "before").join(count(after, "after"), "series_id", "full").join(count(body, "body"), "series_id", "full")
    out = out.join(count(R.intersect(after, body), "inside_body"), "series_id", "full")
    names = ("before", "after", "body", "inside_body")
    return out.select("series_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names), F.lit(total).cast("long").alias("total"))


def volume_mm3(voxels: Column, *spacing: Column) -> Column:
    """Null where a spacing is unknown, not finite or not positive."""
    usable = F.lit(True)
    out = voxels.cast("double")
    for s in spacing:
        usable = usable & F.coalesce((s > 0) & (s < float("inf")), F.lit(False))
        out = out * s
    return F.when(usable, out)
