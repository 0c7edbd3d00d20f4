"""Voxel relations: boxes, planes, lookups, bricks, extremes; and a volume made from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ("series_id", "k", "j", "i")


def from_events(spark: SparkSession, sf_dir: str, width: int = 10, height: int = 10, intercept: int = -1000) -> DataFrame:
    """Events as a dense volume: the id numbers the voxels in scan order, ten times the value is the raw number."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    n = F.col("event_id")
    raw = F.floor(F.col("value") * 10).cast("int")
    at = lambda c, name: c.cast("int").alias(name)
    return e.select(F.lit(1).alias("series_id"), at(F.expr(f"event_id div {width * height}"), "k"), at(F.expr(f"(event_id div {width}) % {height}"), "j"), at(n % width, "i"), raw.alias("raw"), (raw + intercept).cast("double").alias("hu"))


def grids(voxels: DataFrame) -> DataFrame:
    """Dimensions of each volume."""
    return voxels.groupBy("series_id").agg(*((F.max(v) + 1).cast("int").alias(n) for v, n in zip("ijk", "whd", strict=True)))


def box(voxels: DataFrame, i: tuple[int, int], j: tuple[int, int], k: tuple[int, int]) -> DataFrame:
    """Voxels of an inclusive box; all three filters reach the scan."""
    return voxels.where(F.col("k").between(*k) & F.col("j").between(*j) & F.col("i").between(*i))


def plane(voxels: DataFrame, kind: str, index: int, d: int) -> DataFrame:
    """``(row, col, hu)``; coronal and sagittal images have the last slice on top."""
    if kind == "axial":
        return voxels.where(F.col("k") == index).select("series_id", F.col("j").alias("row"), F.col("i").alias("col"), "hu")
    fixed, across = ("j", "i") if kind == "coronal" else ("i", "j")
    return voxels.where(F.col(fixed) == index).select("series_id", (d - 1 - F.col("k")).alias("row"), F.col(across).alias("col"), "hu")


def shrunk_plane(pixels: DataFrame, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Nearest-neighbour reduction: output pixel ``o`` shows source ``o * size div to``; each source pixel finds its outputs itself."""
    out = pixels
    for c, n, m in (("row", size[0], to[0]), ("col", size[1], to[1])):
        first = F.ceil(F.col(c) * m / n)
        last = F.ceil((F.col(c) + 1) * m / n) - 1
        out = out.where(first <= last).withColumn(c, F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    return out


def bricks(voxels: DataFrame, side: int = 8) -> DataFrame:
    """Least and largest value of each brick: an index to skip data by."""
    cell = [F.floor(F.col(c) / side).cast("int").alias(f"b{c}") for c in ("k", "j", "i")]
    return voxels.groupBy("series_id", *cell).agg(F.min("hu").alias("lo"), F.max("hu").alias("hi"), F.count("*").alias("n"))


def extremes(voxels: DataFrame) -> DataFrame:
    return voxels.groupBy("series_id").agg(F.min("hu").alias("lo"), F.max("hu").alias("hi"), F.count("*").alias("n"))
