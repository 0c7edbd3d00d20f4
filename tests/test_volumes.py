"""Run algebra, components, morphology, kernels and segments against brute force on seeded noise."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.functions import display as Di
from voxelith.functions import scalar as S
from voxelith.operators import components as C
from voxelith.operators import geometry as G
from voxelith.operators import hist as H
from voxelith.operators import kernels as K
from voxelith.operators import mesh as Me
from voxelith.operators import morphology as M
from voxelith.operators import runs as R
from voxelith.operators import segments as Sg
from voxelith.operators import setup as Su
from voxelith.operators import slabs
from voxelith.operators import stencil as St
from voxelith.operators import volume as V
from voxelith.plans.filters import Pipeline, Stage, resolve

RUN = "series_id int, k int, j int, x0 int, x1 int"
VOX = "series_id int, k int, j int, i int, hu double"


def lcg(n, seed):
    out, s = [], seed
    for _ in range(n):
        s = (s * 1103515245 + 12345) % (1 << 31)
        out.append(s / (1 << 31))
    return np.array(out)


def voxels(spark, *volumes):
    return spark.createDataFrame([(s, int(k), int(j), int(i), float(a[k, j, i])) for s, a in enumerate(volumes) for k, j, i in np.ndindex(a.shape)], VOX)


def runs_of(spark, *masks):
    v = voxels(spark, *masks)
    return R.from_voxels(v, F.col("hu") > 0)


def mask_of(runs, shape, series=0):
    out = np.zeros(shape, bool)
    for r in runs.where(F.col("series_id") == series).collect():
        assert not out[r["k"], r["j"], r["x0"] : r["x1"] + 1].any()
        out[r["k"], r["j"], r["x0"] : r["x1"] + 1] = True
    return out


@pytest.fixture(scope="module")
def noise(spark):
    a, b = (lcg(12 * 12 * 6, s).reshape(6, 12, 12) > 0.55 for s in (7, 9))
    grids = spark.createDataFrame([(0, 12, 12, 6), (1, 12, 12, 6)], "series_id int, w int, h int, d int")
    return a, b, runs_of(spark, a, b).persist(), runs_of(spark, b, a).persist(), grids


def test_hand_written_runs(spark):
    a = spark.createDataFrame([(0, 0, 0, 0, 4)], RUN)
    b = spark.createDataFrame([(0, 0, 0, 3, 7), (0, 0, 1, 0, 0)], RUN)
    rows = lambda df: sorted(tuple(r)[2:] for r in df.collect())
    assert rows(R.union(a, b)) == [(0, 0, 7), (1, 0, 0)]
    assert rows(R.intersect(a, b)) == [(0, 3, 4)]
    assert rows(R.subtract(a, b)) == [(0, 0, 2)]
    touching = spark.createDataFrame([(0, 0, 0, 5, 6), (0, 0, 0, 0, 4), (0, 0, 0, 1, 2)], RUN)
    assert rows(R.merge(touching)) == [(0, 0, 6)]
    assert R.union(a.limit(0), b.limit(0)).count() == 0
    grids = spark.createDataFrame([(0, 5, 2, 1)], "series_id int, w int, h int, d int")
    assert R.invalid(b, grids).count() == 1


def test_set_algebra(noise):
    a, b, ra, rb, grids = noise
    for s, (x, y) in enumerate(((a, b), (b, a))):
        assert (mask_of(R.union(ra, rb), a.shape, s) == (x | y)).all()
        assert (mask_of(R.intersect(ra, rb), a.shape, s) == (x & y)).all()
        assert (mask_of(R.subtract(ra, rb), a.shape, s) == (x & ~y)).all()
        assert (mask_of(R.complement(ra, grids), a.shape, s) == ~x).all()
    assert {r["series_id"]: r["voxels"] for r in R.count(ra, "series_id").collect()} == {0: a.sum(), 1: b.sum()}


def flood(m):
    lab, n = np.zeros(m.shape, int), 0
    for p in zip(*np.nonzero(m), strict=True):
        if not lab[p]:
            n += 1
            todo = [p]
            lab[p] = n
            while todo:
                q = todo.pop()
                for axis, step in itertools.product(range(3), (-1, 1)):
                    r = list(q)
                    r[axis] += step
                    r = tuple(r)
                    if all(0 <= c < s for c, s in zip(r, m.shape, strict=True)) and m[r] and not lab[r]:
                        lab[r] = n
                        todo.append(r)
    return lab


def test_components(noise, spark):
    a, b, ra, _, grids = noise
    lab = C.label(ra, grids).persist()
    for s, m in enumerate((a, b)):
        want = sorted(np.unique(flood(m), return_counts=True)[1][1:].tolist())
        assert sorted(r["voxels"] for r in C.sizes(lab).where(F.col("series_id") == s).collect()) == want
    assert (mask_of(C.at_least(ra, grids, 4), a.shape) == np.isin(flood(a), [n for n, c in zip(*np.unique(flood(a), return_counts=True), strict=True) if n and c >= 4])).all()
    by_slabs = C.label(ra, grids, slab=2)
    assert by_slabs.exceptAll(lab).count() == 0 and by_slabs.count() == lab.count()
    outside = flood(~a)
    rim = np.ones(a.shape, bool)
    rim[1:-1, 1:-1, 1:-1] = False
    assert (mask_of(C.fill_holes(ra, grids), a.shape) == (a | ~np.isin(outside, np.unique(outside[rim & ~a])))).all()
    two = spark.createDataFrame([(0, 0, 0, 0, 2), (0, 1, 0, 0, 2), (0, 0, 0, 7, 8)], RUN)
    small = spark.createDataFrame([(0, 10, 2, 2)], "series_id int, w int, h int, d int")
    parts = C.label(two, small)
    assert sorted(r["voxels"] for r in C.sizes(parts).collect()) == [2, 6]
    assert C.near_voxel(parts, 0, 4, 1, 0).agg(F.max("comp_id")).first()[0] == 0
    assert {tuple(r)[1:] for r in C.representative(parts).collect()} == {(0, 1, 0, 1), (7, 7, 0, 0)}
    assert C.label(ra.limit(0), grids).count() == 0


def test_exterior_air(noise):
    a, _, ra, _, grids = noise
    want = np.zeros(a.shape, bool)
    for k in range(len(a)):
        plane = flood(a[k : k + 1])[0]
        rim = np.ones(plane.shape, bool)
        rim[1:-1, 1:-1] = False
        want[k] = a[k] & np.isin(plane, np.unique(plane[rim & a[k]]))
    assert (mask_of(C.exterior_air(ra, grids), a.shape) == want).all()


def test_lines_process_statistics_and_extents(spark):
    lines = spark.createDataFrame([(0, 1, 10.0), (0, 2, 14.0), (0, 3, 30.0), (1, 1, 50.0)], "series_id int, line int, at double")
    assert [tuple(r) for r in H.nearest_line(lines, F.lit(12.0)).collect()] == [(0, 1)]
    runs = lambda *x: spark.createDataFrame([(0, 0, 0, *r) for r in x], RUN)
    got = H.process_stats(runs((0, 9)), runs((0, 4), (8, 9)), runs((3, 8)), 100).first()
    assert tuple(got) == (0, 10, 7, 6, 3, 100)
    row = spark.range(1).select(
        H.volume_mm3(F.lit(8), F.lit(0.5), F.lit(2.0)).alias("mm3"), H.volume_mm3(F.lit(8), F.lit(0.0)).alias("none"),
        Di.oversize(Di.extents_mm([F.lit(n) for n in (10, 20, 400)], [F.lit(1.0)] * 3)).alias("over"), Di.extents_mm([F.lit(1)] * 3, [F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0)]).alias("unknown"),
    ).first()
    assert tuple(row) == (8.0, None, True, None)


def test_exclusive_ranges_leave_no_float_to_two():
    rng = np.random.default_rng(3)
    for _ in range(200):
        segs = [Sg.Segment(str(n), *sorted(rng.integers(-20, 20, 2).tolist())) for n in range(5)]
        found = [e for e in Sg.exclusive_ranges(segs).values() if not e.empty]
        for x in np.arange(-21, 21, 0.5):
            assert sum(e.low <= x <= e.high for e in found) <= 1
        for s, e in zip(segs, Sg.exclusive_ranges(segs).values(), strict=True):
            assert e.empty or s.low <= e.low <= e.high <= s.high


def cross(m, grow):
    p = np.pad(m, 1, constant_values=False)
    parts = [p[1:-1, 1:-1, 1:-1], *K.six(p)]
    return np.any(parts, 0) if grow else np.all(parts, 0)


def test_morphology(noise):
    a, _, ra, _, grids = noise
    assert (mask_of(M.dilate(ra, grids), a.shape) == cross(a, True)).all()
    assert (mask_of(M.erode(ra, grids), a.shape) == cross(a, False)).all()
    assert (mask_of(M.closing(ra, grids, 2), a.shape) == cross(cross(cross(cross(a, True), True), False), False)).all()
    sp = (0.04, 0.04, 0.08)
    far = K.squared_distance(~a, sp)
    assert (mask_of(M.strip_surface(ra, R.complement(ra, grids), grids, 0.08, sp), a.shape) == (a & (far > 0.08**2 + 1e-9))).all()
    core = a & (far > 0.06**2 + 1e-9)
    opened = a & (K.squared_distance(core, sp) <= 0.06**2 + 1e-9)
    assert (mask_of(M.open_ball(ra, grids, 0.12, sp), a.shape) == opened).all()
    lay = {r["layer"]: r["n"] for r in M.distance_layers(ra, R.complement(ra, grids), grids, sp, 3).groupBy("series_id", "layer").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("n")).where("series_id = 0").collect()}
    steps = np.sqrt(far[a]) / 0.04
    want = {n: int(((steps > n - 1 + 1e-6) & (steps <= n + 1e-6)).sum()) for n in (1, 2, 3)} | {4: int((steps > 3 + 1e-6).sum())}
    assert lay == {k: v for k, v in want.items() if v}
    assert (mask_of(M.box(ra, grids, 1), a.shape) == np.any([np.pad(a, 1)[1 + z : 7 + z, 1 + y : 13 + y, 1 + x : 13 + x] for z, y, x in itertools.product((-1, 0, 1), repeat=3)], 0)).all()


def test_distance_against_brute_force():
    m = lcg(5 * 6 * 7, 3).reshape(5, 6, 7) > 0.8
    at = np.argwhere(m)
    sp = (0.5, 0.7, 1.1)
    for p in np.ndindex(m.shape):
        want = min((((np.array(p) - q) * sp[::-1]) ** 2).sum() for q in at)
        assert K.squared_distance(m, sp)[p] == pytest.approx(want)
    z, y, x = np.indices((16, 16, 16))
    ball = (z - 7.5) ** 2 + (y - 7.5) ** 2 + (x - 7.5) ** 2 <= 25
    c = K.chamfer_bytes(ball)
    true = np.sqrt(np.where(ball, K.squared_distance(~ball), K.squared_distance(ball)))
    assert (c <= true + 1e-9).all() and c.max() > 3


# --- filters ---------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def block():
    return np.round(lcg(7 * 6 * 5, 5).reshape(7, 6, 5) * 800 - 400)


@pytest.mark.parametrize("key,params", [("gaussian", {"strength": 0.4, "passes": 2}), ("median", {"strength": 0.7, "passes": 1}), ("spikeHole", {"strength": 0.5, "thresholdHU": 250}), ("anisotropic", {"strength": 0.5, "kappaHU": 90, "iterations": 2}), ("tv", {"weight": 0.2, "iterations": 2, "epsHU": 1}), ("unsharp", {"radius": 1, "amount": 0.8, "thresholdHU": 60}), ("sigmoid", {"strength": 0.5, "center": 0, "width": 300})])
def test_windows_equal_kernels(spark, block, key, params):
    v = voxels(spark, block)
    p = params
    df = {
        "gaussian": lambda: St.gaussian(v, p["strength"], p["passes"]), "median": lambda: St.median7(v, p["strength"], p["passes"]), "spikeHole": lambda: St.spike_hole(v, p["strength"], p["thresholdHU"]), "anisotropic": lambda: St.anisotropic(v, p["strength"], p["kappaHU"], p["iterations"]),
        "tv": lambda: St.total_variation(v, p["weight"], p["iterations"], p["epsHU"]), "unsharp": lambda: St.unsharp(v, p["radius"], p["amount"], p["thresholdHU"]), "sigmoid": lambda: St.sigmoid(v, p["strength"], p["center"], p["width"]),
    }[key]()
    got = np.zeros_like(block)
    for r in df.collect():
        got[r["k"], r["j"], r["i"]] = r["hu"]
    assert np.allclose(got, K.KERNELS[key](block, params), atol=1e-9)


def slow_nlm(a, h, sp):
    (sx, sy, sz), (px, py, pz) = K.nlm_radii(1, 1, sp)
    arms = [(0, 0, 0)] + [(z, y, x) for z, y, x in itertools.product(range(-pz, pz + 1), range(-py, py + 1), range(-px, px + 1)) if (z != 0) + (y != 0) + (x != 0) == 1]
    at = lambda p: a[tuple(min(max(c, 0), n - 1) for c, n in zip(p, a.shape, strict=True))]
    out = np.zeros_like(a)
    for p in np.ndindex(a.shape):
        total, mass = a[p], 1.0
        for o in itertools.product(range(-sz, sz + 1), range(-sy, sy + 1), range(-sx, sx + 1)):
            q = tuple(c + d for c, d in zip(p, o, strict=True))
            if any(o) and all(0 <= c < n for c, n in zip(q, a.shape, strict=True)):
                w = np.exp(-sum((at([c + d for c, d in zip(p, r, strict=True)]) - at([c + d for c, d in zip(q, r, strict=True)])) ** 2 for r in arms) / len(arms) / h**2)
                total, mass = total + w * a[q], mass + w
        out[p] = total / mass
    return out


def test_wide_kernels(block):
    for sp in ((1, 1, 1), (1, 1, 0.16)):
        assert np.allclose(K.nlm(block, {"hHU": 200, "sp": sp}), slow_nlm(block, 200, sp))
    flat = np.full((7, 7, 7), 120.0)
    for key, kernel in K.KERNELS.items():
        if key != "sigmoid":
            assert np.allclose(kernel(flat, {}), flat), key
    spike = np.full((7, 7, 7), 100.0)
    spike[3, 3, 3] = 3000
    assert K.spike_hole(spike, {})[3, 3, 3] == pytest.approx(3000 * 0.425 + 108 * 0.575)
    assert (np.diff(K.sigmoid(np.linspace(-300, 300, 200)[None, None], {})) >= 0).all()
    assert K.weights((1, 1, 1.0001)) is None and K.weights((0.5, 0.5, 1.25)) == (1, 1, 0.16) and K.weights((1, 0, 1)) is None
    assert K.smooth_field(flat > 0, 0.6).shape == (9, 9, 9)


def test_slabs_equal_whole_volume(spark, block):
    deep = np.concatenate([block, block[::-1], block + 5, block])
    v = voxels(spark, deep, block)
    chain = Pipeline().add("spikeHole").add("nlm").add("gaussian", passes=2).add("anisotropic", iterations=3).add("bilateral", passes=1).add("unsharp", radius=2)
    stages = chain.compiled((0.5, 0.5, 1.0))
    got = slabs.to_voxels(slabs.run(slabs.from_voxels(v, 5, 6), V.grids(v), stages, depth=4)).collect()
    want = []
    for a in (deep, block):
        for key, p in stages:
            a = K.KERNELS[key](a, p).astype(np.float32)
        want.append(a)
    assert len(got) == deep.size + block.size
    assert max(abs(r["hu"] - want[r["series_id"]][r["k"], r["j"], r["i"]]) for r in got) < 1e-2


def test_distance_over_planes(spark, block):
    far = block + 5000
    got = slabs.squared_distance(slabs.from_voxels(voxels(spark, block, far), 5, 6), 300, 400, (0.5, 0.7, 1.1)).collect()
    want = K.squared_distance((block >= 300) & (block <= 400), (0.5, 0.7, 1.1))
    assert len(got) == 2 * block.size
    for r in got:
        assert r["d2"] == (pytest.approx(want[r["k"], r["j"], r["i"]]) if r["series_id"] == 0 else 1e20)


def test_filter_plan():
    with pytest.raises(ValueError):
        Stage("gaussian", {"strength": 2})
    with pytest.raises(ValueError):
        Stage("blur")
    p = Pipeline().add("gaussian", strength=0).add("tv").add("nlm", searchRadius=2)
    assert [k for k, _ in p.compiled()] == ["tv", "nlm"] and p.reach() == 8 + 3
    assert p.signature() != p.move(1, 2).signature() and p.signature((1, 1, 2)) != p.signature()
    assert "sp" not in Pipeline().add("median").compiled((1, 1, 2))[0][1]
    assert resolve("unsharp", {"threshold": 0}, (0, 1000)) == ({"threshold": 0, "thresholdHU": 0.0}, [])
    assert resolve("nlm", {"strength": 0.5}, (-1000, 1000))[0]["hHU"] == pytest.approx(146)
    assert resolve("tv", {}, None) == ({"epsHU": 1}, ["epsHU"]) and resolve("tv", {"epsHU": 3}) == ({"epsHU": 3}, [])


# --- segments --------------------------------------------------------------------------------------------------------


def test_exclusive_ranges():
    e = Sg.exclusive_ranges([Sg.Segment("a", 100, 200), Sg.Segment("b", 0, 300), Sg.Segment("c", 120, 180), Sg.Segment("d", -50, 50, active=False)])
    assert (e["b"].low, e["b"].high) in [(0.0, Sg.below(100)), (Sg.above(200), 300.0)] and len(e["b"].dropped) == 1
    assert e["c"].empty and e["c"].high < 120 and (e["d"].low, e["d"].high) == (-50, 50)
    s = [Sg.Segment("x", 0, 10, opening=1), Sg.Segment("y", 5, 20), Sg.Segment("z", 30, 40, holes=True), Sg.Segment("w", 50, 60)]
    e = Sg.exclusive_ranges(s)
    assert e["y"].sources == ["x"] and e["z"].sources == ["x", "y"] and e["w"].sources == ["z"]
    assert Sg.depends_on(e, "x") == {"y", "z", "w"}
    assert all(not v.sources for v in Sg.exclusive_ranges(s, priority=False).values())
    assert Sg.above(1.0) == float(np.nextafter(np.float32(1), np.float32(2))) and Sg.above(0.1) > 0.1 > Sg.below(0.1)


def test_segments_share_no_voxel(spark, noise):
    grids = noise[4].where("series_id = 0")
    v = voxels(spark, np.round(lcg(12 * 12 * 6, 7).reshape(6, 12, 12) * 100))
    segs = [Sg.Segment("a", 60, 100, closing=1), Sg.Segment("b", 40, 80), Sg.Segment("c", 0, 90, min_voxels=3)]
    got = {k: mask_of(r, (6, 12, 12)) for k, r in Sg.final_runs(v, grids, segs, (1, 1, 1)).items()}
    assert not (got["a"] & got["b"]).any() and not (got["a"] & got["c"]).any() and not (got["b"] & got["c"]).any()
    assert got["a"].any() and got["b"].any() and got["c"].any()


def test_edits_and_undo(spark, noise):
    a, b, ra, rb, _ = noise
    log = Sg.EditLog(spark.createDataFrame([], "segment string, kind string, " + RUN))
    assert (mask_of(Sg.apply_edits(ra, log.now), a.shape) == a).all()
    log.add("s", "exclude", rb)
    assert (mask_of(Sg.apply_edits(ra, log.now), a.shape) == (a & ~b)).all()
    log.undo()
    assert (mask_of(Sg.apply_edits(ra, log.now), a.shape) == a).all()
    assert (mask_of(Sg.apply_edits(ra, log.redo()), a.shape) == (a & ~b)).all()


def test_regions_are_inherited(spark, noise):
    a, _, ra, _, grids = noise
    lab = C.label(ra, grids).where("series_id = 0")
    old = lab.select("series_id", F.concat(F.lit("r"), F.col("comp_id").cast("string")).alias("region_id"), F.col("comp_id").alias("ord"), "k", "j", "x0", "x1")
    out = Sg.inherit_regions(lab, old, most=5).collect()
    assert len(out) == 5 and all(r["region_id"] == f"r{r['comp_id']}" and r["inherits"] for r in out)


# --- geometry and meshes ------------------------------------------------------------------------------------------------


def test_linear_field_is_sampled_exactly(spark):
    z, y, x = np.indices((4, 3, 4))
    v = voxels(spark, 10.0 * x + 100.0 * y + 1000.0 * z)
    lines = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 3.0, 2.0, 3.0), (0, 1, 1.5, 1.5, 1.5, 1.5, 1.5, 1.5)], "series_id int, line_id int, ax double, ay double, az double, bx double, by double, bz double")
    s = G.line_samples(lines, (0.1, 0.2, 0.5))
    for r in G.sample(s, v, (4, 3, 4)).join(s, ["series_id", "line_id", "q"]).collect():
        assert r["hu"] == pytest.approx(10 * r["x"] + 100 * r["y"] + 1000 * r["z"])
    n = int(np.ceil(np.hypot(np.hypot(0.3, 0.4), 1.5) / 0.1 - 1e-9)) + 1
    assert s.where("line_id = 0").count() == n and s.where("line_id = 1").count() == 1


def test_polygons_rays_and_cuts(spark):
    pts = spark.createDataFrame([(5.0, 5.0), (11.0, 5.0), (1.0, 1.0)], "x double, y double")
    square = [(0, 0), (10, 0), (10, 10), (0, 10)]
    assert [r[0] for r in pts.select(G.inside_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, False, True]
    u = [(0, 0), (10, 0), (10, 10), (8, 10), (8, 2), (2, 2), (2, 10), (0, 10)]
    assert [r[0] for r in pts.select(G.inside_polygon(F.col("x"), F.col("y"), u)).collect()] == [False, False, True]
    solid = np.zeros((4, 4, 8))
    solid[2, 1, 5] = 1
    v = voxels(spark, solid)
    rays = spark.createDataFrame([(0, 0, 0.0, 1.0, 2.0, 1.0, 0.0, 0.0, 7.0), (1, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 7.0)], "ray_id int, series_id int, ox double, oy double, oz double, dx double, dy double, dz double, reach double")
    hit = {r["ray_id"]: (r["t"], r["i"]) for r in G.first_hit(rays, v, F.col("hu") > 0).collect()}
    assert hit == {0: (4.5, 5), 1: (None, None)}
    assert {r["ray_id"]: r["hidden"] for r in G.hidden_points(rays, v, F.col("hu") > 0).collect()} == {0: True, 1: False}
    assert [r[0] for r in pts.select(G.plane_relation(F.col("x"), F.col("y"), 5)).collect()] == ["on", "cross", "none"]
    ident = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    r = R.from_voxels(v, F.col("hu") > 0).withColumn("comp_id", F.lit(1))
    assert G.runs_in_polygon(r, square, ident).first()["inside"]


def test_surfaces(spark, tmp_path):
    from voxelith.sources import stl

    m = np.zeros((3, 3, 3))
    m[1, 1, 1] = m[1, 1, 2] = 1
    tris = Me.triangles(St.exposed_faces(voxels(spark, m), F.col("hu") > 0), (1, 2, 3)).persist()
    row = Me.signed_volume(tris).first()
    assert row["volume"] == pytest.approx(12) and row["triangles"] == 20
    vertices, faces = Me.weld(tris)
    assert vertices.count() == 12 and faces.count() == 20
    assert Me.taubin(vertices, faces).count() == 12
    path = str(tmp_path / "a.stl")
    assert stl.write(tris, path) == 20
    back = stl.read(open(path, "rb").read())
    assert len(open(path, "rb").read()) == 84 + 50 * 20
    assert abs(np.einsum("ni,ni->", back[:, 0], np.cross(back[:, 1], back[:, 2])) / 6) == pytest.approx(12)
    z, y, x = np.indices((12, 12, 12))
    ball = 1 / (1 + np.exp((np.sqrt((z - 5.5) ** 2 + (y - 5.5) ** 2 + (x - 5.5) ** 2) - 4) * 4))
    t = Me.isosurface(ball)
    volume = np.einsum("ni,ni->", t[:, 0], np.cross(t[:, 1], t[:, 2])) / 6
    assert abs(volume) == pytest.approx(4 / 3 * np.pi * 64, rel=0.05)


def test_rounding_and_nan(spark):
    df = spark.createDataFrame([(v,) for v in (-5000.0, -1024.0, 3071.0, 9999.0, 10.4, 10.6, -2.5, float("nan"))], "hu double").selectExpr("1 as series_id", "hu")
    from voxelith.operators import hist as H

    got = {r["bin"] - 1024: r["n"] for r in H.histogram(df).collect()}
    assert got == {-1024: 2, 3071: 2, 10: 1, 11: 1, -2: 1}
    assert df.where(S.inside(F.col("hu"), 0, 1e9)).count() == 4
    assert H.in_range(H.histogram(df), 20, 5).count() == 0


# --- regions ----------------------------------------------------------------------------------------------------------------


def test_regions_are_added_once_and_split_by_the_loop(spark):
    from voxelith.operators import regions as Rg

    meta = spark.createDataFrame([(1, 1, ["a"], False, False, False), (2, 1, ["a"], True, True, False)], "series_id int, region_id long, segments array<string>, selected boolean, visible boolean, merged boolean")
    run = "series_id int, region_id long, k int, j int, x0 int, x1 int"
    runs = spark.createDataFrame([(1, 1, 0, 0, 0, 3), (2, 1, 0, 0, 0, 1), (2, 1, 0, 0, 5, 6), (2, 1, 0, 0, 8, 8)], run)
    new = spark.createDataFrame([(1, "x", ["a"], False), (1, "y", ["b"], True)], "series_id int, new_id string, segments array<string>, merged boolean")
    new_runs = spark.createDataFrame([(1, "x", 0, 0, 3, 5), (1, "y", 0, 0, 3, 5)], "series_id int, new_id string, k int, j int, x0 int, x1 int")
    m, r = Rg.add(meta, runs, new, new_runs)
    assert {(x["series_id"], x["region_id"], *x["segments"], x["selected"], x["visible"], x["merged"]) for x in m.collect()} == {
        (1, 1, "a", True, True, False), (2, 1, "a", True, True, False), (1, 2, "b", True, True, True)}
    assert r.count() == 5
    grids = spark.createDataFrame([(1, 9, 1, 1), (2, 9, 1, 1)], "series_id int, w int, h int, d int")
    ident = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
    box = lambda x: [(-1, -1), (x, -1), (x, 1), (-1, 1)]
    m2, r2 = Rg.lasso_deselect(meta, runs, grids, box(6.5), ident)
    rows = {(x["series_id"], x["region_id"]): (x["selected"], x["merged"]) for x in m2.collect()}
    assert rows == {(1, 1): (False, False), (2, 1): (True, False), (2, 2): (False, True)}
    assert {(x["region_id"], x["x0"]) for x in r2.where("series_id = 2").collect()} == {(1, 8), (2, 0), (2, 5)}
    m3, r3 = Rg.lasso_deselect(meta, runs, grids, box(8.5), ident)
    assert m3.where("selected").count() == 0 and m3.count() == 2 and r3.count() == 4
    m4, _ = Rg.lasso_deselect(meta, runs, grids, box(8.5), ident, ["b"])
    assert m4.where("selected").count() == 1
    empty = spark.createDataFrame([], "kind string, series_id int, k int, j int, x0 int, x1 int")
    assert Rg.trim(meta, runs, "a", empty)[1].count() == 4
    gone = spark.createDataFrame([("exclude", 1, 0, 0, 0, 8), ("keep", 2, 0, 0, 5, 8)], empty.schema)
    m5, r5 = Rg.trim(meta, runs, "a", gone)
    assert [x["series_id"] for x in m5.collect()] == [2] and {x["x0"] for x in r5.collect()} == {5, 8}
    single, _ = Rg.merge_selected(meta, runs)
    assert single.count() == 2


def test_reset_of_edits_can_be_undone(spark):
    log = Sg.EditLog(spark.createDataFrame([], "segment string, kind string, series_id int, k int, j int, x0 int, x1 int"))
    row = spark.createDataFrame([(0, 0, 0, 1, 2)], RUN)
    log.add("a", "keep", row)
    log.add("b", "keep", row)
    assert [r["segment"] for r in log.reset("a").collect()] == ["b"]
    assert log.undo().count() == 2 and log.redo().count() == 1


def test_steps_are_exact_and_zero_needs_all_digits(spark):
    spans = [0.035, 0.07, 0.0007, 0.014, 7e-9, 0.0, -0.07, 350.0, 1e9]
    df = spark.createDataFrame([(n, s) for n, s in enumerate(spans)], "n int, span double").orderBy("n")
    assert [r[0] for r in df.select(Di.value_step(F.col("span"))).collect()] == [5e-05, 1e-04, 1e-06, 2e-05, 1e-06, 1e-06, 1e-04, 0.5, 2e6]
    steps = [0.0, 1e-9, 0.001, 0.05, 0.5, 1.0, 20.0]
    df = spark.createDataFrame([(n, s) for n, s in enumerate(steps)], "n int, step double").orderBy("n")
    assert [r[0] for r in df.select(Di.digits(F.col("step"))).collect()] == [4, 4, 3, 2, 1, 0, 0]


def test_resampling_of_many_slices(spark):
    """Place times size passes 2^31 here."""
    d, td = 60000, 36000
    runs = spark.createDataFrame([(1, k, 9, 0, 9) for k in (0, 3, 30000, d - 2, d - 1)], RUN)
    got = sorted((r["k"], r["j"], r["x0"], r["x1"]) for r in Su.resampled_runs(runs, (10, 10, d), (7, 4, td)).collect())
    shown = {k: (2 * k * (d - 1) + td - 1) // (2 * (td - 1)) for k in range(td)}
    assert got == [(k, 3, 0, 6) for k, old in shown.items() if old in (0, 3, 30000, d - 2, d - 1)]


def test_bilateral_without_a_join_on_gaps_and_repeats(spark, tmp_path):
    """Sent to all that they reach, voxels were joined with a broadcast of all voxels."""
    a = {p: 400 * x for p, x in zip(np.ndindex(5, 4, 6), lcg(120, 8).tolist(), strict=True) if sum(p) % 7 != 3}
    rows = [(1, *p, v) for p, v in a.items()] + [(1, 2, 2, 2, a[2, 2, 2]), (1, 0, 0, 40, 7.0)]
    spark.createDataFrame(rows, VOX).write.parquet(str(tmp_path / "v"))
    v = spark.read.parquet(str(tmp_path / "v"))
    for radii, sp in (((1, 1, 1), (1, 1, 1)), ((2, 1, 1), (0.5, 1, 2))):
        out = St.bilateral(v, radii=radii, sp=sp)
        assert "Join" not in spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
        got = {(r["k"], r["j"], r["i"]): r["hu"] for r in out.collect()}
        assert len(got) == out.count() == len(a) + 1
        for (k, j, i), hu in {r[1:4]: r[4] for r in rows}.items():
            num = den = 0.0
            for _, bk, bj, bi, b in rows:
                dk, dj, di = bk - k, bj - j, bi - i
                if abs(dk) <= radii[2] and abs(dj) <= radii[1] and abs(di) <= radii[0]:
                    w = np.exp(-(di * di / sp[0] + dj * dj / sp[1] + dk * dk / sp[2]) / (2 * 1.2**2) - (b - hu) ** 2 / (2 * 50**2))
                    num, den = num + w * b, den + w
            assert got[k, j, i] == pytest.approx(0.2 * hu + 0.8 * num / den)
