"""Surfaces: voxel faces as triangles, welding, volume, smoothing, iso-surfaces."""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Corner offsets (x, y, z) of the two triangles of each face, outward: -x +x -y +y -z +z.
_QUADS = (((0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0)), ((1, 0, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1)), ((0, 0, 0), (1, 0, 0), (1, 0, 1), (0, 0, 1)), ((0, 1, 0), (0, 1, 1), (1, 1, 1), (1, 1, 0)), ((0, 0, 0), (0, 1, 0), (1, 1, 0), (1, 0, 0)), ((0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)))
CORNERS = [f"{c}{n}" for n in range(3) for c in "xyz"]


def triangles(faces: DataFrame, spacing) -> DataFrame:
    """``faces(series_id, k, j, i, faces)`` -> two triangles for each exposed face, corners on the voxel grid in mm."""
    options = []
    for bit, q in enumerate(_QUADS):
        for part in ((q[0], q[1], q[2]), (q[0], q[2], q[3])):
            at = [((F.col(v) + o) * float(s)).alias(f"{c}{n}") for n, p in enumerate(part) for c, v, o, s in zip("xyz", "ijk", p, spacing, strict=True)]
            options.append(F.when(F.col("faces").bitwiseAND(F.lit(1 << bit)) != 0, F.struct(*at)))
    t = faces.select("series_id", F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("t"))
    return t.select("series_id", "t.*")


def signed_volume(tris: DataFrame) -> DataFrame:
    """Enclosed volume of closed surfaces: the sum of a . (b x c) / 6."""
    a, b, c = ([F.col(f"{d}{n}") for d in "xyz"] for n in range(3))
    cross = [b[1] * c[2] - b[2] * c[1], b[2] * c[0] - b[0] * c[2], b[0] * c[1] - b[1] * c[0]]
    return tris.groupBy("series_id").agg(F.abs(F.sum(a[0] * cross[0] + a[1] * cross[1] + a[2] * cross[2]) / 6).alias("volume"), F.count("*").alias("triangles"))


def weld(tris: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Indexed form: vertices ``(series_id, vertex_id, x, y, z)`` and triangles of their ids; equal corners (and -0) are one.

    The id is a hash of the position, so no global numbering is needed.
    """
    pos = [F.struct(*((F.col(f"{c}{n}") + F.lit(0.0)).alias(c) for c in "xyz")) for n in range(3)]
    ids = [F.xxhash64("series_id", p["x"], p["y"], p["z"]) for p in pos]
    indexed = tris.select("series_id", *(i.alias(f"v{n}") for n, i in enumerate(ids)), *(p.alias(f"p{n}") for n, p in enumerate(pos)))
    corners = indexed.select("series_id", F.explode(F.array(*(F.struct(F.col(f"v{n}").alias("vertex_id"), F.col(f"p{n}").alias("p")) for n in range(3)))).alias("c"))
    vertices = corners.select("series_id", "c.vertex_id", "c.p.x", "c.p.y", "c.p.z").distinct()
    return vertices, indexed.select("series_id", "v0", "v1", "v2")


def taubin(vertices: DataFrame, tris: DataFrame, strength: float = 0.6, rounds: int = 2) -> DataFrame:
    """Smoothing that doesn't shrink: steps towards the neighbours' mean by 0.34 s, then back by 0.36 s."""
    e = [tris.select("series_id", F.col(f"v{a}").alias("vertex_id"), F.col(f"v{b}").alias("other")) for a, b in permutations(range(3), 2)]
    edges = e[0]
    for x in e[1:]:
        edges = edges.union(x)
    edges = edges.distinct()
    for step in [0.34 * strength, -0.36 * strength] * rounds:
        near = edges.join(vertices.select("series_id", F.col("vertex_id").alias("other"), "x", "y", "z"), ["series_id", "other"])
        mean = near.groupBy("series_id", "vertex_id").agg(*(F.avg(c).alias(f"m{c}") for c in "xyz"))
        vertices = vertices.join(mean, ["series_id", "vertex_id"], "left").select("series_id", "vertex_id", *((F.col(c) + step * (F.coalesce(f"m{c}", c) - F.col(c))).alias(c) for c in "xyz"))
    return vertices


def isosurface(field: np.ndarray, iso: float = 0.5) -> np.ndarray:
    """Triangles ``(n, 3, 3)`` (x, y, z) of the iso-surface of a scalar field, by marching tetrahedra.

    Each cell is split into the six tetrahedra around its main diagonal; the surface faces away from high values.
    """
    d, h, w = field.shape
    order = [np.array(p) for p in permutations(np.eye(3, dtype=int))]
    out = []
    base = np.stack(np.meshgrid(np.arange(d - 1), np.arange(h - 1), np.arange(w - 1), indexing="ij"), -1).reshape(-1, 3)
    for p in order:
        corner = np.stack([base + np.concatenate([np.zeros((1, 3), int), np.cumsum(p, 0)])[n] for n in range(4)], 1)
        value = field[corner[..., 0], corner[..., 1], corner[..., 2]]
        high = value >= iso
        for case in range(1, 15):
            up = [n for n in range(4) if case >> n & 1]
            sel = (high == [n in up for n in range(4)]).all(1)
            if not sel.any():
                continue
            low = [n for n in range(4) if n not in up]
            c, v = corner[sel].astype(float), value[sel]

            def cut(a, b, c=c, v=v):
                t = (iso - v[:, a]) / (v[:, b] - v[:, a])
                return c[:, a] + t[:, None] * (c[:, b] - c[:, a])

            if len(up) in (1, 3):
                one, rest = (up[0], low) if len(up) == 1 else (low[0], up)
                parts = [np.stack([cut(one, r) for r in rest], 1)]
            else:
                q = [cut(up[0], low[0]), cut(up[0], low[1]), cut(up[1], low[1]), cut(up[1], low[0])]
                parts = [np.stack([q[0], q[1], q[2]], 1), np.stack([q[0], q[2], q[3]], 1)]
            inner = c[:, up].mean(1)
            for t in parts:
                n = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
                turned = ((t.mean(1) - inner) * n).sum(1) < 0
                t[turned] = t[turned][:, ::-1]
                out.append(t)
    tri = np.concatenate(out) if out else np.zeros((0, 3, 3))
    return tri[:, ::-1, ::-1] if len(tri) else tri
