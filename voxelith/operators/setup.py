"""What is set up once for a volume: windows, default class ranges, reduced sizes, shown segments."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default class ranges for CT-like volumes (None: the volume's own limit) and as shares of the range for others.
CT_RANGES = {"lung": (-950, -300), "fat": (-250, -50), "soft": (-50, 350), "bone": (350, None), "contrast": (300, None)}
SHARES = {"lung": (0.03, 0.18), "fat": (0.0, 0.22), "soft": (0.22, 0.58), "bone": (0.58, 1.0), "contrast": (0.58, 1.0)}


def window(low: float, high: float, center: float | None = None, width: float | None = None) -> tuple[float, float]:
    """Centre and width from the metadata, else the full range."""
    high = high if high > low else low + 1
    fine = lambda v: v is not None and math.isfinite(v)
    return (center if fine(center) else (low + high) / 2), (width if fine(width) and width > 0 else max(high - low, 1e-6))


def default_ranges(low: float, high: float) -> dict[str, tuple[float, float]]:
    if low <= -500 and high >= 1000:
        return {k: (max(low, a), high if b is None else min(high, b)) for k, (a, b) in CT_RANGES.items()}
    return {k: (low + (high - low) * a, low + (high - low) * b) for k, (a, b) in SHARES.items()}


def reduced_size(dims: tuple[int, int, int], most_bytes: int = 0, most_side: float = math.inf, in_plane: int = 0) -> tuple[int, int, int]:
    """Size of a reduced copy (two bytes a voxel) under limits of bytes, side and in-plane side."""
    scale = 1.0
    if in_plane > 0 and max(dims[:2]) > in_plane:
        scale = min(scale, in_plane / max(dims[:2]))
    if 0 < most_bytes < math.prod(dims) * 2:
        scale = min(scale, (most_bytes / (math.prod(dims) * 2)) ** (1 / 3) * 0.965)
    if max(dims) > most_side:
        scale = min(scale, most_side / max(dims))
    size = [max(1, math.floor(n * scale)) for n in dims]
    while most_bytes > 0 and math.prod(size) * 2 > most_bytes and max(size) > 1:
        size[size.index(max(size))] -= 1
    return tuple(size)


def area_average(voxels: DataFrame, dims: tuple[int, int, int], to: tuple[int, int, int], value: str = "hu") -> DataFrame:
    """Mean of each cell of a coarser grid whose sizes need not divide."""
    cell = [F.floor((F.col(c) * t + t - 1) / n).cast("int").alias(c) if t != n else F.col(c) for c, n, t in zip("ijk", dims, to, strict=True)]
    return voxels.groupBy("series_id", *cell[::-1]).agg(F.avg(value).alias(value))


def resampled_runs(runs: DataFrame, dims: tuple[int, int, int], to: tuple[int, int, int]) -> DataFrame:
    """Runs on a grid of another size: each new row and slice shows the nearest old one, ends are mapped by bounds."""
    spark = runs.sparkSession

    def table(n: int, m: int, old: str, new: str) -> DataFrame:
        pairs = spark.range(m).select(F.col("id").cast("int").alias(new))
        place = F.floor(F.col(new).cast("long") * (n - 1) / (m - 1) + 0.5).cast("int") if m > 1 else F.lit(0)
        return pairs.withColumn(old, place)

    def bound(x: Column, n: int, m: int, upper: bool) -> Column:
        """How many new places map below x (or to x at most)."""
        if m <= 1:
            return F.when(x >= 0, 1).otherwise(0) if upper else F.when(x > 0, 1).otherwise(0)
        edge = (x + 0.5 if upper else x - 0.5) * (m - 1) / (n - 1)
        return F.least(F.greatest(F.ceil(edge), F.lit(0)), F.lit(m)).cast("int")

    (w, h, d), (tw, th, td) = dims, to
    moved = runs.select("series_id", F.col("k").alias("ok"), F.col("j").alias("oj"), bound(F.col("x0"), w, tw, False).alias("x0"), (bound(F.col("x1"), w, tw, True) - 1).alias("x1"))
    moved = moved.where("x0 <= x1").join(table(h, th, "oj", "j"), "oj").join(table(d, td, "ok", "k"), "ok")
    from .runs import merge

    return merge(moved.select("series_id", "k", "j", "x0", "x1"))


def mask_bricks(runs: DataFrame, side: int = 8) -> DataFrame:
    """``runs(..., segment int)`` -> bit set of the segments that each brick holds."""
    cells = F.explode(F.sequence(F.floor(F.col("x0") / side).cast("int"), F.floor(F.col("x1") / side).cast("int")))
    b = runs.select("series_id", F.floor(F.col("k") / side).cast("int").alias("bk"), F.floor(F.col("j") / side).cast("int").alias("bj"), cells.alias("bi"), F.expr("shiftleft(1, segment)").alias("bit"))
    return b.groupBy("series_id", "bk", "bj", "bi").agg(F.bit_or("bit").alias("segments"))


def shown_slots(order: list[str], on: set[str], slots: int = 4) -> list[str]:
    """The first keys fill the slots; a later one that is on takes the slot of the first that is off."""
    out = list(order[:slots])
    for extra in order[slots:]:
        free = next((i for i, k in enumerate(out) if k not in on), None)
        if extra in on and free is not None:
            out[free] = extra
    return out


def nearest_distance(bytes_by_class: list[Column], shown: list[bool]) -> Column:
    """Smallest distance byte of the shown classes (255 for none)."""
    return F.least(F.lit(255), F.lit(255), *(c for c, on in zip(bytes_by_class, shown, strict=True) if on))


def spacing_note(checked: DataFrame) -> DataFrame:
    """What to say about each series' spacing (null where all is well); from ``series.spacing``."""
    mm = F.format_string("%.3f", F.col("spacing"))
    parts = F.array_compact(F.array(F.when(F.col("missing") > 0, F.format_string("%d missing", "missing")), F.when(F.col("duplicates") > 0, F.format_string("%d duplicate", "duplicates")), F.when(F.col("uneven"), F.lit("uneven"))))
    how = F.when(F.col("basis") == "fit", "gap-corrected fit").when(F.col("basis") == "span", "mean over the span").when(F.col("basis") == "first-gap", "first gap").otherwise("tag")
    text = F.concat(F.lit("spacing is inconsistent: "), F.array_join(parts, ", "), F.lit("; using the "), how, F.coalesce(F.concat(F.lit(" of "), mm, F.lit(" mm")), F.lit("")))
    return checked.withColumn("note", F.when(F.size(parts) > 0, text))
