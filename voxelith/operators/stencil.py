"""Small neighbourhood filters as windows over voxels: ``voxels(series_id, k, j, i, hu)``.

Each axis is one window over the other two, so a pass is three shuffles that
Catalyst can see through; chains of filters and wide kernels go through slabs
(``slabs.py``) with one shuffle in all.  Both give the same values.  A voxel is
interior if it has all six neighbours.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = {"i": ("k", "j"), "j": ("k", "i"), "k": ("j", "i")}


def along(axis: str):
    return Window.partitionBy("series_id", *AXES[axis]).orderBy(axis)


def with_neighbours(voxels: DataFrame, value: str = "hu") -> DataFrame:
    """Six neighbour columns ``i0 i1 j0 j1 k0 k1`` (null outside the volume) and ``interior``."""
    out = voxels
    for axis in AXES:
        out = out.withColumn(f"{axis}0", F.lag(value).over(along(axis))).withColumn(f"{axis}1", F.lead(value).over(along(axis)))
    return out.withColumn("interior", reduce(lambda a, b: a & b, (F.col(f"{a}{s}").isNotNull() for a in AXES for s in "01")))


NEIGHBOURS = [f"{a}{s}" for a in AXES for s in "01"]


def _pointwise(voxels: DataFrame, new: Column) -> DataFrame:
    keys = [c for c in voxels.columns if c != "hu"]
    return with_neighbours(voxels).select(*keys, F.when(F.col("interior"), new).otherwise(F.col("hu")).alias("hu"))


def gaussian(voxels: DataFrame, strength: float = 0.4, passes: int = 2, sp=(1, 1, 1)) -> DataFrame:
    """Per axis ``v (1 - s) + s (before + 2 v + after) / 4``; the edge repeats."""
    keys = [c for c in voxels.columns if c != "hu"]
    for _ in range(max(1, passes)):
        for axis, weight in zip(AXES, sp, strict=True):
            v, s = F.col("hu"), strength * weight
            before, after = (F.coalesce(f("hu").over(along(axis)), v) for f in (F.lag, F.lead))
            voxels = voxels.select(*keys, (v * (1 - s) + (before + 2 * v + after) * 0.25 * s).alias("hu"))
    return voxels


def median7(voxels: DataFrame, strength: float = 0.4, passes: int = 2) -> DataFrame:
    mid = F.element_at(F.array_sort(F.array("hu", *NEIGHBOURS)), 4)
    for _ in range(max(1, passes)):
        voxels = _pointwise(voxels, F.col("hu") * (1 - strength) + mid * strength)
    return voxels


def _mean6() -> Column:
    return reduce(lambda a, b: a + b, (F.col(c) for c in NEIGHBOURS)) / 6


def spike_hole(voxels: DataFrame, strength: float = 0.5, threshold: float = 100) -> DataFrame:
    """Pull a voxel that sticks out of an even neighbourhood towards its mean; ``corrected`` marks it."""
    n = [F.col(c) for c in NEIGHBOURS]
    gap, blend = F.col("hu") - _mean6(), 0.2 + 0.75 * strength
    odd = F.col("interior") & (F.greatest(*n) - F.least(*n) <= threshold * (0.55 + 0.35 * strength)) & (F.abs(gap) > threshold)
    target = _mean6() + F.signum(gap) * threshold * 0.08
    keys = [c for c in voxels.columns if c != "hu"]
    out = with_neighbours(voxels).withColumn("corrected", F.coalesce(odd, F.lit(False)))
    return out.select(*keys, F.when(F.col("corrected"), F.col("hu") * (1 - blend) + target * blend).otherwise(F.col("hu")).alias("hu"), "corrected")


def diffusion_rate(strength: float) -> float:
    return min(0.06 + (1 / 7 - 0.06) * min(1.0, max(0.0, strength)), 1 / 7)


def anisotropic(voxels: DataFrame, strength: float = 0.45, kappa: float = 60, iterations: int = 4, sp=(1, 1, 1)) -> DataFrame:
    weights = [w for w in sp for _ in "01"]
    flux = lambda c, w: w * F.exp(-(F.col(c) - F.col("hu")) * (F.col(c) - F.col("hu")) / max(kappa * kappa, 1e-6)) * (F.col(c) - F.col("hu"))
    new = F.col("hu") + diffusion_rate(strength) * reduce(lambda a, b: a + b, (flux(c, w) for c, w in zip(NEIGHBOURS, weights, strict=True)))
    for _ in range(max(1, iterations)):
        voxels = _pointwise(voxels, new)
    return voxels


def total_variation(voxels: DataFrame, weight: float = 0.12, iterations: int = 8, eps: float = 1, sp=(1, 1, 1)) -> DataFrame:
    weights = [w for w in sp for _ in "01"]
    flux = lambda c, w: w * (F.col(c) - F.col("hu")) / F.sqrt((F.col(c) - F.col("hu")) * (F.col(c) - F.col("hu")) + eps * eps)
    new = F.col("hu") + min(0.18, 0.02 + weight * 0.45) * reduce(lambda a, b: a + b, (flux(c, w) for c, w in zip(NEIGHBOURS, weights, strict=True)))
    for _ in range(max(1, iterations)):
        voxels = _pointwise(voxels, new)
    return voxels


def box_blur(voxels: DataFrame, radius: int = 1, into: str = "blur") -> DataFrame:
    """Mean over the cube clipped to the volume: separable running sums and counts."""
    out = voxels.withColumn("_s", F.col("hu").cast("double")).withColumn("_n", F.lit(1))
    for axis in AXES:
        w = along(axis).rowsBetween(-radius, radius)
        out = out.withColumn("_s", F.sum("_s").over(w)).withColumn("_n", F.sum("_n").over(w))
    return out.withColumn(into, F.col("_s") / F.col("_n")).drop("_s", "_n")


def unsharp(voxels: DataFrame, radius: int = 1, amount: float = 0.8, threshold: float = 60) -> DataFrame:
    detail = F.col("hu") - F.col("blur")
    keys = [c for c in voxels.columns if c != "hu"]
    return box_blur(voxels, radius).select(*keys, F.when(F.abs(detail) >= threshold, F.col("hu") + amount * detail).otherwise(F.col("hu")).alias("hu"))


def sigmoid(voxels: DataFrame, strength: float = 0.5, center: float = 0, width: float = 300) -> DataFrame:
    """Steepen values around ``center`` inside the window; outside they stay."""
    half, g = max(1.0, width / 2), max(0.0, strength) * 6
    if g <= 1e-4:
        return voxels
    t = (F.col("hu") - center) / half
    curved = center + half * F.tanh(g * t) / F.tanh(F.lit(g))
    return voxels.withColumn("hu", F.when((t > -1) & (t < 1), curved).otherwise(F.col("hu")))


def bilateral(voxels: DataFrame, strength: float = 0.8, spatial_sigma: float = 1.2, sigma: float = 50, radii=(1, 1, 1), sp=(1, 1, 1)) -> DataFrame:
    """One pass with fixed radii.

    Each axis gathers, for each distance along it, the values that the axes before gathered there, so no voxel is sent to
    all that it reaches.  Frames go by place: places without a voxel that lie in reach get a row for the next axes, and
    what repeats a place counts as often as it does.
    """
    place = ("series_id", "k", "j", "i")
    out, lists = voxels.select(*place, "hu", F.lit(True).alias("_real")), {0.0: "hu"}
    for n, (axis, r, weight) in enumerate(zip(AXES, radii, sp, strict=True)):
        frames = {d: along(axis).rangeBetween(d, d) for d in range(-r, r + 1)}
        if n < 2:
            gaps = F.array_compact(F.array(F.lit(0), *(F.when(F.count(F.lit(1)).over(w) == 0, d) for d, w in frames.items() if d)))
            out = out.select("*", gaps.alias("_gaps")).select("*", F.explode("_gaps").alias("_to"))
            own = F.col("_to") == 0
            at = [(F.col(c) + F.col("_to")).alias(c) if c == axis else F.col(c) for c in place]
            out = out.select(*at, *(F.when(own, F.col(c)).alias(c) for c in dict.fromkeys(("hu", "_real", *lists.values()))))
        found: dict[float, list[Column]] = {}
        for d, w in frames.items():
            for far, c in lists.items():
                # rows of one place hold equal lists from the first axis on
                one = F.first(c).over(w) if n else F.collect_list(c).over(w)
                found.setdefault(far + d * d / weight, []).append(F.coalesce(one, F.array().cast("array<double>")))
        out = out.select(*place, "hu", "_real", *(F.concat(*cs).alias(f"_v{m}") for m, cs in enumerate(found.values())))
        lists = {far: f"_v{m}" for m, far in enumerate(found)}

    def add(far: float):
        weigh = lambda v: math.exp(-far / (2 * spatial_sigma**2)) * F.exp(-(v - F.col("hu")) * (v - F.col("hu")) / (2 * sigma * sigma))
        step = lambda acc, v, w: F.struct((acc["v"] + w * v).alias("v"), (acc["w"] + w).alias("w"))
        return lambda acc, v: step(acc, v, weigh(v))

    sums = F.struct(F.lit(0.0).alias("v"), F.lit(0.0).alias("w"))
    for far, c in lists.items():
        sums = F.aggregate(F.col(c), sums, add(far))
    # the last window has all rows of a place in one task already
    mean = out.where("_real").select(*place, "hu", sums.alias("s")).groupBy(*place).agg((F.sum("s.v") / F.sum("s.w")).alias("m"), F.first("hu").alias("hu"))
    return mean.select(*place, (F.col("hu") * (1 - strength) + F.col("m") * strength).alias("hu"))


def area_average(voxels: DataFrame, factor: int = 2) -> DataFrame:
    """Downsample by whole factors: the mean of each block."""
    cells = [F.floor(F.col(c) / factor).cast("int").alias(c) for c in ("k", "j", "i")]
    return voxels.groupBy("series_id", *cells).agg(F.avg("hu").alias("hu"))


def exposed_faces(voxels: DataFrame, keep: Column) -> DataFrame:
    """Bit set of faces between a voxel of the class and what is not: -x +x -y +y -z +z."""
    v = with_neighbours(voxels.withColumn("_in", F.coalesce(keep, F.lit(False)).cast("int")), "_in").where("_in = 1")
    bits = reduce(lambda a, b: a + b, (F.when(F.coalesce(F.col(c), F.lit(0)) == 0, 1 << n).otherwise(0) for n, c in enumerate(NEIGHBOURS)))
    return v.select("series_id", "k", "j", "i", bits.cast("int").alias("faces")).where("faces > 0")
