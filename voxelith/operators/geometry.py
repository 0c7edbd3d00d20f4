"""Lines, polygons, rays and cuts over voxels and points."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S

KEY = ["series_id", "k", "j", "i"]


def inside_polygon(x: Column, y: Column, loop: list[tuple[float, float]]) -> Column:
    """Even-odd test against a closed loop."""
    hits = []
    for (ax, ay), (bx, by) in zip(loop, loop[-1:] + loop[:-1], strict=True):
        if ay != by:
            hits.append(((F.lit(ay) > y) != (F.lit(by) > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax))
    return reduce(lambda a, b: a != b, hits, F.lit(False))


def project(x: Column, y: Column, z: Column, matrix: list[list[float]]) -> tuple[Column, Column]:
    """Screen position by a 4x4 matrix; null behind the eye."""
    row = lambda r: matrix[r][0] * x + matrix[r][1] * y + matrix[r][2] * z + matrix[r][3]
    w = row(3)
    ok = w > 1e-9
    return F.when(ok, row(0) / w), F.when(ok, row(1) / w)


def runs_in_polygon(runs: DataFrame, loop, matrix, every: int = 4, by: str = "comp_id") -> DataFrame:
    """Components that lie fully inside a lasso on the screen (run ends and every fourth voxel are tested)."""
    steps = F.array_distinct(F.concat(F.sequence("x0", "x1", F.lit(every)), F.array("x1")))
    p = runs.select("series_id", by, "k", "j", F.explode(steps).alias("i"))
    px, py = project(F.col("i").cast("double"), F.col("j").cast("double"), F.col("k").cast("double"), matrix)
    hit = F.coalesce(inside_polygon(px, py, loop), F.lit(False))
    return p.groupBy("series_id", by).agg(F.bool_and(hit).alias("inside"))


def line_samples(lines: DataFrame, spacing: tuple[float, float, float], most: int = 4096) -> DataFrame:
    """``lines(series_id, line_id, ax..az, bx..bz)`` in voxels -> evenly spaced samples with ``q, dist_mm, x, y, z``.

    As many as the finest step demands, two at least for a line of some length, ``most`` at the most.
    """
    length = S.distance_mm([F.col(f"a{c}") for c in "xyz"], [F.col(f"b{c}") for c in "xyz"], spacing)
    n = F.least(F.lit(most), F.ceil(length / min(spacing) - 1e-9) + 1).cast("int")
    s = lines.withColumn("_mm", length).withColumn("_n", F.greatest(n, F.lit(1)))
    s = s.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = F.when(F.col("_n") > 1, F.col("q") / (F.col("_n") - 1)).otherwise(0.0)
    at = [(F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * t).alias(c) for c in "xyz"]
    return s.select("series_id", "line_id", "q", (F.col("_mm") * t).alias("dist_mm"), *at)


def sample(samples: DataFrame, voxels: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """Trilinear value at each sample, the edge repeated: eight corners joined on voxel keys."""
    corners = []
    for dz in (0, 1):
        for dy in (0, 1):
            for dx in (0, 1):
                parts = []
                for c, d, n in (("x", dx, dims[0]), ("y", dy, dims[1]), ("z", dz, dims[2])):
                    v = S.clamp(F.col(c), 0.0, float(n - 1))
                    low = F.floor(v)
                    parts.append((F.least(low + d, F.lit(n - 1)).cast("int"), (v - low) if d else 1 - (v - low)))
                (i, wi), (j, wj), (k, wk) = parts
                corners.append(F.struct(i.alias("i"), j.alias("j"), k.alias("k"), (wi * wj * wk).alias("w")))
    keys = [c for c in samples.columns if c not in ("x", "y", "z")]
    s = samples.select("*", F.explode(F.array(*corners)).alias("c")).select(*samples.columns, "c.i", "c.j", "c.k", "c.w").where("w > 0")
    got = s.join(voxels.select(*KEY, "hu"), KEY)
    return got.groupBy(*keys).agg(F.sum(F.col("w") * F.col("hu")).alias("hu"))


def coarse_profile(lines: DataFrame, voxels: DataFrame, dims: tuple[int, int, int], spacing, most: int = 192) -> DataFrame:
    """A quick profile from the slices that ``voxels`` happens to hold: at most ``most`` samples a line.

    A sample between two slices of which one is missing takes the other's value; with neither it is null.
    """
    w, h, d = dims
    s = line_samples(lines, spacing, most)
    z = S.clamp(F.col("z"), 0.0, float(d - 1))
    low = F.floor(z)
    part = F.when(z - low > 1e-9, z - low).otherwise(0.0)
    near = F.array(F.struct(low.alias("k"), (1 - part).alias("wk")), F.struct((low + 1).alias("k"), part.alias("wk")))
    flat = s.withColumn("_s", F.explode(near)).where("_s.wk > 0")
    flat = flat.select("series_id", "line_id", "q", F.col("_s.k").alias("slice"), F.col("_s.wk").alias("wk"), "x", "y", F.col("_s.k").cast("double").alias("z"))
    got = sample(flat, voxels, (w, h, d))
    # corners weigh 1 within a slice, so what the slices at hand weigh together is their share
    hu = got.groupBy("series_id", "line_id", "q").agg((F.sum(F.col("wk") * F.col("hu")) / F.sum("wk")).alias("hu"))
    return s.select("series_id", "line_id", "q", "dist_mm").join(hu, ["series_id", "line_id", "q"], "left")


def nearest_sample(samples: DataFrame, at_mm: float) -> DataFrame:
    """The sample closest to a distance along each line; ties go to the lower."""
    return samples.groupBy("series_id", "line_id").agg(F.min_by("q", F.struct(F.abs(F.col("dist_mm") - at_mm), "q")).alias("q"))


def ray_steps(rays: DataFrame, step: float = 0.5) -> DataFrame:
    """``rays(ray_id, series_id, ox..oz, dx..dz, reach)`` in voxels -> half-voxel steps with their voxel."""
    s = rays.withColumn("n", F.explode(F.sequence(F.lit(0), F.floor(F.col("reach") / step).cast("int"))))
    t = F.col("n") * step
    at = [F.floor(F.col(f"o{c}") + F.col(f"d{c}") * t + 0.5).cast("int").alias(v) for c, v in zip("xyz", "ijk", strict=True)]
    return s.select("ray_id", "series_id", t.alias("t"), *at)


def first_hit(rays: DataFrame, voxels: DataFrame, solid: Column, step: float = 0.5) -> DataFrame:
    """Nearest solid voxel along each ray (null t if none)."""
    hits = ray_steps(rays, step).join(voxels.where(solid).select(*KEY), KEY)
    best = hits.groupBy("ray_id").agg(F.min(F.struct("t", "k", "j", "i")).alias("h")).select("ray_id", "h.t", "h.k", "h.j", "h.i")
    return rays.select("ray_id").join(best, "ray_id", "left")


def hidden_points(rays: DataFrame, voxels: DataFrame, solid: Column, margin: float = 1.0) -> DataFrame:
    """Whether something solid lies between the eye and each point (``reach`` is the point's distance)."""
    return first_hit(rays, voxels, solid).join(rays.select("ray_id", "reach"), "ray_id").select("ray_id", (F.col("t").isNotNull() & (F.col("t") < F.col("reach") - margin)).alias("hidden"))


def plane_relation(a: Column, b: Column, at: float) -> Column:
    """A line against a plane at one coordinate: on, cross or none."""
    on = (F.floor(a + 0.5) == at) & (F.floor(b + 0.5) == at)
    return F.when(on, "on").when((F.least(a, b) <= at) & (F.greatest(a, b) >= at), "cross").otherwise("none")


def cut_prism(voxels: DataFrame, stroke: list[tuple[float, float, float]], direction: tuple[float, float, float], kerf: float, depth: float, spacing: tuple[float, float, float]) -> DataFrame:
    """Voxels of the prism that a stroke (mm) sweeps along ``direction`` for ``depth``, ``kerf`` wide, and half a voxel diagonal around."""
    size = math.sqrt(sum(c * c for c in direction))
    n = tuple(c / size for c in direction)
    margin = 0.5 * math.sqrt(sum(s * s for s in spacing))
    p = [F.col(c) * s for c, s in zip("ijk", spacing, strict=True)]
    inner = lambda u, v: sum(a * b for a, b in zip(u, v, strict=True))
    hit = F.lit(False)
    for a, b in zip(stroke, stroke[1:], strict=False):
        flat = [y - x for x, y in zip(a, b, strict=True)]
        along = [c - inner(flat, n) * m for c, m in zip(flat, n, strict=True)]
        length = math.sqrt(inner(along, along))
        if length < 1e-12:
            continue
        u = [c / length for c in along]
        v = [n[1] * u[2] - n[2] * u[1], n[2] * u[0] - n[0] * u[2], n[0] * u[1] - n[1] * u[0]]
        r = [x - c for x, c in zip(p, a, strict=True)]
        alpha, beta, gamma = (sum((x * c for x, c in zip(r[1:], w[1:], strict=True)), r[0] * w[0]) for w in (u, v, n))
        hit = hit | (alpha.between(-margin, length + margin) & (F.abs(beta) <= kerf / 2 + margin) & gamma.between(-margin, depth + margin))
    return voxels.where(hit)
