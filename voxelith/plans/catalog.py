"""Queries over the operators, each with DuckDB SQL that shares no code with it.

The canonical volume V is derived from the event table (see ``volume.from_events``);
values that go through ``exp`` and the like are rounded to four decimals on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import display as Di
from ..functions import scalar as S
from ..operators import components as C
from ..operators import geometry as G
from ..operators import hist as H
from ..operators import mesh as Me
from ..operators import morphology as M
from ..operators import notes as N
from ..operators import regions as Rg
from ..operators import runs as R
from ..operators import segments as Sg
from ..operators import series as Se
from ..operators import setup as Su
from ..operators import slabs
from ..operators import stencil as St
from ..operators import volume as V
from .filters import Pipeline

SPACING = (0.5, 0.5, 1.25)
LOW, HIGH = -250, 3071
SEGMENTS = [Sg.Segment("bone", 300, 3071), Sg.Segment("soft", -200, 299), Sg.Segment("fat", -600, -150), Sg.Segment("lung", -900, -500)]

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_V = "V AS (SELECT 1 AS s, (event_id // 100)::INT AS k, ((event_id // 10) % 10)::INT AS j, (event_id % 10)::INT AS i, floor(value * 10)::INT AS raw, (floor(value * 10) - 1000)::DOUBLE AS hu FROM events), D AS (SELECT max(k) + 1 AS d FROM V)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql if sql.lstrip().upper().startswith("WITH") and "V AS" in sql else f"WITH {_V} {sql}"
        return f

    return add


def vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.from_events(spark, sf_dir)


def mask(spark: SparkSession, sf_dir: str, low: float = LOW, high: float = HIGH) -> DataFrame:
    return R.from_voxels(vol(spark, sf_dir), S.inside(F.col("hu"), low, high))


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.grids(vol(spark, sf_dir))


def r4(c: Column) -> Column:
    return F.floor(c * 1e4 + 0.5) / 1e4


def _r4(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


def _islands(cond_sql: str) -> str:
    """Runs of a set of voxels given as a SELECT of k, j, i."""
    return f"SELECT k, j, min(i)::INT AS x0, max(i)::INT AS x1 FROM (SELECT k, j, i, i - row_number() OVER (PARTITION BY k, j ORDER BY i) AS g FROM ({cond_sql})) GROUP BY k, j, g"


def _rows(df: DataFrame) -> DataFrame:
    return df.select("k", "j", "x0", "x1")


_A, _B = f"SELECT k, j, i FROM V WHERE hu BETWEEN {LOW} AND {HIGH}", "SELECT k, j, i FROM V WHERE hu BETWEEN -700 AND -100"

# --- calibration, windows, planes ------------------------------------------------------------


@query("SELECT k, j, i, hu, least(greatest(floor((hu - (40 - 200.0)) * 255 / 400 + 0.5), 0), 255)::INT AS grey FROM V")
def calibrate_window(spark, sf_dir):
    return vol(spark, sf_dir).select("k", "j", "i", S.calibrate(F.col("raw"), 1.0, -1000.0).alias("hu"), S.window_grey(F.col("hu"), 40, 400).alias("grey"))


@query("SELECT k, j, i, hu FROM V WHERE k BETWEEN 2 AND 5 AND j BETWEEN 1 AND 8 AND i BETWEEN 3 AND 6")
def region_box(spark, sf_dir):
    return V.box(vol(spark, sf_dir), (3, 6), (1, 8), (2, 5)).select("k", "j", "i", "hu")


@query("SELECT min(hu) AS lo, max(hu) AS hi, count(*) AS n FROM V")
def volume_extremes(spark, sf_dir):
    return V.extremes(vol(spark, sf_dir)).select("lo", "hi", "n")


@query('SELECT j AS "row", i AS col, hu FROM V WHERE k = 4')
def plane_axial(spark, sf_dir):
    return V.plane(vol(spark, sf_dir), "axial", 4, 0).select("row", "col", "hu")


def _depth(spark, sf_dir) -> int:
    return grid(spark, sf_dir).first()["d"]


@query('SELECT (d - 1 - k)::INT AS "row", i AS col, hu FROM V, D WHERE j = 3')
def plane_coronal(spark, sf_dir):
    return V.plane(vol(spark, sf_dir), "coronal", 3, _depth(spark, sf_dir)).select("row", "col", "hu")


@query('SELECT (d - 1 - k)::INT AS "row", j AS col, hu FROM V, D WHERE i = 7')
def plane_sagittal(spark, sf_dir):
    return V.plane(vol(spark, sf_dir), "sagittal", 7, _depth(spark, sf_dir)).select("row", "col", "hu")


@query('SELECT o.o::INT AS "row", p.p::INT AS col, hu FROM range(4) o(o), range(7) p(p), V WHERE k = 4 AND j = o.o * 10 // 4 AND i = p.p * 10 // 7')
def plane_shrunk(spark, sf_dir):
    return V.shrunk_plane(V.plane(vol(spark, sf_dir), "axial", 4, 0), (10, 10), (4, 7)).select("row", "col", "hu")


@query("SELECT k, j, i, hu FROM V WHERE (k, j, i) IN ((0, 0, 0), (4, 5, 6), (9, 9, 9))")
def sample_hu(spark, sf_dir):
    return vol(spark, sf_dir).where("(k = 0 and j = 0 and i = 0) or (k = 4 and j = 5 and i = 6) or (k = 9 and j = 9 and i = 9)").select("k", "j", "i", "hu")


@query("SELECT k // 8 AS bk, j // 8 AS bj, i // 8 AS bi, min(hu) AS lo, max(hu) AS hi, count(*) AS n FROM V GROUP BY 1, 2, 3")
def bricks(spark, sf_dir):
    return V.bricks(vol(spark, sf_dir)).select("bk", "bj", "bi", "lo", "hi", "n")


@query("SELECT k, j, i, least(greatest(floor((hu + 1024) / 0.5 + 0.5) + 100, 0), 65535)::INT AS word, CASE WHEN (raw & 4095) >= 2048 THEN (raw & 4095) - 4096 ELSE raw & 4095 END AS stored FROM V")
def pack_words(spark, sf_dir):
    return vol(spark, sf_dir).select("k", "j", "i", S.encode_u16(F.col("hu"), 0.5, -1024, 100).alias("word"), S.stored_value(F.col("raw"), 12, 11, True).alias("stored"))


@query("SELECT k, j, i, ((CASE WHEN hu BETWEEN 300 AND 3071 THEN 1 ELSE 0 END) + (CASE WHEN hu BETWEEN -200 AND 299 THEN 2 ELSE 0 END) + (CASE WHEN hu BETWEEN -600 AND -150 THEN 4 ELSE 0 END))::INT AS bits, least(greatest(floor((0.5 + least(hu + 600, -150 - hu) / 2048) * 255 + 0.5), 0), 255)::INT AS cls FROM V")
def segment_bits(spark, sf_dir):
    return vol(spark, sf_dir).select("k", "j", "i", S.segment_bits(F.col("hu"), [(300, 3071), (-200, 299), (-600, -150)]).alias("bits"), S.class_byte(F.col("hu"), -600, -150).alias("cls"))


@query("SELECT k, j, i, (CASE WHEN hu BETWEEN -600 AND -150 THEN floor(g1 * (1 - 0.5) + 200 * 0.5 + 0.5) ELSE g1 END)::INT AS grey FROM (SELECT *, CASE WHEN hu BETWEEN -900 AND -500 THEN floor(g * (1 - 0.25) + 90 * 0.25 + 0.5) ELSE g END AS g1 FROM (SELECT *, least(greatest(floor((hu + 160) * 255 / 400 + 0.5), 0), 255) AS g FROM V))")
def overlay(spark, sf_dir):
    hu = F.col("hu")
    layer = lambda lo, hi, v, a: F.struct(S.inside(hu, lo, hi).alias("on"), F.lit(float(v)).alias("value"), F.lit(a).alias("alpha"))
    return vol(spark, sf_dir).select("k", "j", "i", S.blend(S.window_grey(hu, 40, 400), F.array(layer(-900, -500, 90, 0.25), layer(-600, -150, 200, 0.5))).alias("grey"))


@query("SELECT k, j, i, CASE WHEN hu BETWEEN 300 AND 3071 THEN 'bone' WHEN hu BETWEEN -200 AND 299 THEN 'soft' WHEN hu BETWEEN -600 AND -150 THEN 'fat' WHEN hu BETWEEN -900 AND -500 THEN 'lung' END AS segment FROM V")
def segment_at_voxel(spark, sf_dir):
    return Sg.class_at(vol(spark, sf_dir), [(s.key, s.low, s.high) for s in SEGMENTS]).select("k", "j", "i", "segment")


_P = [n * s for n, s in zip((10, 10, 10), SPACING, strict=True)]


@query(f"SELECT k, j, i, i * 0.5::DOUBLE AS xmm, k * 1.25::DOUBLE AS zmm, {_r4(f'((i + 0.5) * 0.5 - {_P[0] / 2}) * (3.3 / greatest({_P[0]}, d * 1.25::DOUBLE))')} AS lx, {_r4(f'-((j + 0.5) * 0.5 - {_P[1] / 2}) * (3.3 / greatest({_P[0]}, d * 1.25::DOUBLE))')} AS ly, i::DOUBLE AS back FROM V, D")
def coordinates(spark, sf_dir):
    i, j, k = (F.col(c).cast("double") for c in "ijk")
    mm = S.voxel_to_mm(i, j, k, SPACING)
    dims = (10, 10, _depth(spark, sf_dir))
    x, y, z = S.voxel_to_local(i, j, k, dims, SPACING)
    back = S.local_to_voxel(x, y, z, dims, SPACING)[0]
    return vol(spark, sf_dir).select("k", "j", "i", mm[0].alias("xmm"), mm[2].alias("zmm"), r4(x).alias("lx"), r4(y).alias("ly"), r4(back).alias("back"))


@query("SELECT event_id, user_id::VARCHAR || '-' || event_type AS name, printf('%.2f mm', value) AS mm, substr(regexp_replace(regexp_replace(props, '[^A-Za-z0-9_\\-]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 60) AS file, replace(replace(replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM events")
def text_helpers(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("name"), S.format_mm(F.col("value")).alias("mm"), S.file_name(F.col("props")).alias("file"), S.escape_html(F.col("props")).alias("html"))


@query("""SELECT t AS id, (list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(t, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 8)::INT AS colour
    FROM (SELECT DISTINCT event_type || user_id AS t FROM events)""")
def point_colours(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.concat("event_type", F.col("user_id").cast("string")).alias("id")).distinct()
    return t.select("id", S.palette_index(F.col("id")).alias("colour"))


# --- runs -------------------------------------------------------------------------------------


@query(_islands(_A))
def threshold_runs(spark, sf_dir):
    return _rows(mask(spark, sf_dir))


@query(f"SELECT k, j, min(i)::INT AS x0, max(i)::INT AS x1, c AS cls FROM (SELECT *, i - row_number() OVER (PARTITION BY k, j, c ORDER BY i) AS g FROM (SELECT *, floor(hu / 300)::INT AS c FROM V)) GROUP BY k, j, c, g")
def class_runs(spark, sf_dir):
    v = vol(spark, sf_dir).withColumn("cls", F.floor(F.col("hu") / 300).cast("int"))
    return R.from_voxels(v, by=("cls",)).select("k", "j", "x0", "x1", "cls")


def _pair(spark, sf_dir):
    return mask(spark, sf_dir), mask(spark, sf_dir, -700, -100)


@query(_islands(f"{_A} UNION {_B}"))
def runs_union(spark, sf_dir):
    return _rows(R.union(*_pair(spark, sf_dir)))


@query(_islands(f"{_A} INTERSECT {_B}"))
def runs_intersect(spark, sf_dir):
    return _rows(R.intersect(*_pair(spark, sf_dir)))


@query(_islands(f"{_A} EXCEPT {_B}"))
def runs_subtract(spark, sf_dir):
    return _rows(R.subtract(*_pair(spark, sf_dir)))


@query(_islands(f"SELECT k, j, i FROM V EXCEPT {_A}"))
def runs_complement(spark, sf_dir):
    return _rows(R.complement(mask(spark, sf_dir), grid(spark, sf_dir)))


@query(f"SELECT k, j, i, hu BETWEEN {LOW} AND {HIGH} AS inside FROM V")
def runs_contains(spark, sf_dir):
    points = vol(spark, sf_dir).select("series_id", "k", "j", "i")
    return R.contains(points, mask(spark, sf_dir)).select("k", "j", "i", "inside")


@query(f"SELECT DISTINCT a.* FROM ({_islands(_A)}) a JOIN ({_islands(_B)}) b ON a.k = b.k AND a.j = b.j AND a.x0 <= b.x1 AND b.x0 <= a.x1")
def runs_overlap(spark, sf_dir):
    return _rows(R.overlapping(*_pair(spark, sf_dir)))


@query(f"SELECT count(*) AS voxels, count(*) * 0.3125::DOUBLE AS mm3 FROM ({_A})")
def run_volume(spark, sf_dir):
    return R.count(mask(spark, sf_dir)).select("voxels", (F.col("voxels") * SPACING[0] * SPACING[1] * SPACING[2]).alias("mm3"))


@query(f"SELECT (d - 1 - k)::INT AS \"row\", i AS col FROM ({_A}), D WHERE j = 5")
def mask_plane(spark, sf_dir):
    return R.plane_pixels(mask(spark, sf_dir), (10, 10, _depth(spark, sf_dir)), "coronal", 5).select("row", "col")


_CC = "A AS ({a}), adj AS (SELECT k * 100 + j * 10 + i AS u, k * 100 + (j + 1) * 10 + i AS v FROM A WHERE (k, j + 1, i) IN (SELECT (k, j, i) FROM A) UNION ALL SELECT k * 100 + j * 10 + i, (k + 1) * 100 + j * 10 + i FROM A WHERE (k + 1, j, i) IN (SELECT (k, j, i) FROM A) UNION ALL SELECT k * 100 + j * 10 + i, k * 100 + j * 10 + i + 1 FROM A WHERE (k, j, i + 1) IN (SELECT (k, j, i) FROM A)), e AS (SELECT u, v FROM adj UNION ALL SELECT v, u FROM adj), reach(n, m) AS (SELECT k * 100 + j * 10 + i, k * 100 + j * 10 + i FROM A UNION SELECT e.v, r.m FROM reach r JOIN e ON e.u = r.n), comp AS (SELECT n, min(m)::BIGINT AS comp_id FROM reach GROUP BY n)"


def _cc(a: str, tail: str) -> str:
    return f"WITH RECURSIVE {_V}, {_CC.format(a=a)} {tail}"


@query(_cc(_A, "SELECT comp_id, count(*) AS voxels, count(*) * 0.3125::DOUBLE AS mm3 FROM comp GROUP BY comp_id"))
def components(spark, sf_dir):
    lab = C.label(mask(spark, sf_dir), grid(spark, sf_dir))
    return C.sizes(lab).select("comp_id", "voxels", (F.col("voxels") * SPACING[0] * SPACING[1] * SPACING[2]).alias("mm3"))


@query(_cc(_A, "SELECT comp_id, count(*) AS voxels, count(*) * 0.3125::DOUBLE AS mm3 FROM comp GROUP BY comp_id ORDER BY voxels DESC, comp_id LIMIT 10"))
def largest_structures(spark, sf_dir):
    return components(spark, sf_dir).orderBy(F.desc("voxels"), "comp_id").limit(10)


@query(_cc(_A, _islands("SELECT n // 100 AS k, (n // 10) % 10 AS j, n % 10 AS i FROM comp WHERE comp_id IN (SELECT comp_id FROM comp GROUP BY comp_id HAVING count(*) >= 5)").replace("SELECT k, j, min", "SELECT k::INT AS k, j::INT AS j, min", 1)))
def components_min_size(spark, sf_dir):
    return _rows(C.at_least(mask(spark, sf_dir), grid(spark, sf_dir), 5))


@query(_cc(_A, "SELECT comp_id, bool_or(n // 100 IN (0, d - 1) OR (n // 10) % 10 IN (0, 9) OR n % 10 IN (0, 9)) AS touches FROM comp, D GROUP BY comp_id"))
def components_at_border(spark, sf_dir):
    g = grid(spark, sf_dir)
    return R.touches_border(C.label(mask(spark, sf_dir), g), g, "comp_id").select("comp_id", "touches")


@query(_cc(_A, "SELECT (n // 100)::INT AS k, ((n // 10) % 10)::INT AS j, (n % 10)::INT AS i FROM comp WHERE comp_id = (SELECT comp_id FROM comp WHERE n = (SELECT min(k * 100 + j * 10 + i) FROM A WHERE k = 3))"))
def component_at_voxel(spark, sf_dir):
    lab = C.label(mask(spark, sf_dir), grid(spark, sf_dir)).persist()
    at = lab.where("k = 3").agg(F.min(F.struct("j", "x0")).alias("p")).first()["p"]
    return R.to_voxels(C.at_voxel(lab, 1, at["x0"], at["j"], 3)).select("k", "j", "i")


_DENSE = "SELECT k, j, i FROM V WHERE hu BETWEEN -970 AND 3071"
_HOLLOW = "SELECT k, j, i FROM V EXCEPT (SELECT k, j, i FROM V WHERE hu BETWEEN -970 AND 3071)"


@query(_cc(_HOLLOW, _islands(f"{_DENSE} UNION SELECT (n // 100)::INT, ((n // 10) % 10)::INT, (n % 10)::INT FROM comp WHERE comp_id NOT IN (SELECT comp_id FROM comp, D WHERE n // 100 IN (0, d - 1) OR (n // 10) % 10 IN (0, 9) OR n % 10 IN (0, 9))")))
def hole_fill(spark, sf_dir):
    return _rows(C.fill_holes(mask(spark, sf_dir, -970, HIGH), grid(spark, sf_dir)))


# --- morphology ---------------------------------------------------------------------------------

_N6 = "(VALUES (0,0,0),(0,0,1),(0,0,-1),(0,1,0),(0,-1,0),(1,0,0),(-1,0,0)) o(dk, dj, di)"


def _dil(a: str) -> str:
    return f"SELECT DISTINCT (k + dk)::INT AS k, (j + dj)::INT AS j, (i + di)::INT AS i FROM ({a}), {_N6}, D WHERE k + dk BETWEEN 0 AND d - 1 AND j + dj BETWEEN 0 AND 9 AND i + di BETWEEN 0 AND 9"


def _ero(a: str) -> str:
    return f"SELECT (k + dk)::INT AS k, (j + dj)::INT AS j, (i + di)::INT AS i FROM ({a}), {_N6}, D WHERE k + dk BETWEEN 0 AND d - 1 AND j + dj BETWEEN 0 AND 9 AND i + di BETWEEN 0 AND 9 GROUP BY 1, 2, 3 HAVING count(*) = 7"


@query(_islands(_dil(_A)))
def dilate(spark, sf_dir):
    return _rows(M.dilate(mask(spark, sf_dir), grid(spark, sf_dir)))


_WIDE = "SELECT k, j, i FROM V WHERE hu BETWEEN -985 AND 3071"


@query(_islands(_ero(_WIDE)))
def erode(spark, sf_dir):
    return _rows(M.erode(mask(spark, sf_dir, -985), grid(spark, sf_dir)))


@query(_islands(_dil(_ero(_WIDE))))
def opening(spark, sf_dir):
    return _rows(M.opening(mask(spark, sf_dir, -985), grid(spark, sf_dir)))


@query(_islands(_ero(_dil(_A))))
def closing(spark, sf_dir):
    return _rows(M.closing(mask(spark, sf_dir), grid(spark, sf_dir)))


def _near(a: str, mm: float) -> str:
    offs = ", ".join(f"({dk},{dj},{di})" for dk, dj, r in M.ball(mm, SPACING) for di in range(-r, r + 1))
    return f"SELECT DISTINCT (k + dk)::INT AS k, (j + dj)::INT AS j, (i + di)::INT AS i FROM ({a}), (VALUES {offs}) o(dk, dj, di), D WHERE k + dk BETWEEN 0 AND d - 1 AND j + dj BETWEEN 0 AND 9 AND i + di BETWEEN 0 AND 9"


_AIR = "SELECT k, j, i FROM V WHERE hu < -940"


@query(_islands(f"{_A} EXCEPT ({_near(_AIR, 0.5)})"))
def strip_surface(spark, sf_dir):
    v = vol(spark, sf_dir)
    return _rows(M.strip_surface(mask(spark, sf_dir), R.from_voxels(v, F.col("hu") < -940), grid(spark, sf_dir), 0.5, SPACING))


@query(_islands(f"({_WIDE}) INTERSECT ({_near(f'{_WIDE} EXCEPT (' + _near(f'SELECT k, j, i FROM V EXCEPT ({_WIDE})', 0.5) + ')', 0.5)})"))
def open_ball(spark, sf_dir):
    return _rows(M.open_ball(mask(spark, sf_dir, -985), grid(spark, sf_dir), 1.0, SPACING))


@query(f"SELECT layer, count(*) AS voxels FROM (SELECT a.k, a.j, a.i, coalesce(min(ceil(sqrt(least(x, 1e9)) / 0.5 - 1e-9)) FILTER (x <= 1.0 + 1e-9), 3)::INT AS layer FROM ({_A}) a LEFT JOIN (SELECT a.k, a.j, a.i, (a.k - b.k) ** 2 * 1.5625 + (a.j - b.j) ** 2 * 0.25 + (a.i - b.i) ** 2 * 0.25 AS x FROM ({_A}) a JOIN ({_AIR}) b ON a.k = b.k AND abs(a.j - b.j) <= 2 AND abs(a.i - b.i) <= 2) n ON n.k = a.k AND n.j = a.j AND n.i = a.i GROUP BY 1, 2, 3) GROUP BY layer")
def distance_layers(spark, sf_dir):
    v = vol(spark, sf_dir)
    lay = M.distance_layers(mask(spark, sf_dir), R.from_voxels(v, F.col("hu") < -940), grid(spark, sf_dir), SPACING, layers=2)
    return lay.groupBy("layer").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("voxels"))


# --- filters --------------------------------------------------------------------------------------

_L = "lag(hu) OVER wi AS i0, lead(hu) OVER wi AS i1, lag(hu) OVER wj AS j0, lead(hu) OVER wj AS j1, lag(hu) OVER wk AS k0, lead(hu) OVER wk AS k1"
_WIN = "WINDOW wi AS (PARTITION BY k, j ORDER BY i), wj AS (PARTITION BY k, i ORDER BY j), wk AS (PARTITION BY j, i ORDER BY k)"
_NB = f"NB AS (SELECT *, i0 IS NOT NULL AND i1 IS NOT NULL AND j0 IS NOT NULL AND j1 IS NOT NULL AND k0 IS NOT NULL AND k1 IS NOT NULL AS inner_ FROM (SELECT *, {_L} FROM V {_WIN}))"
_SIX = ["i0", "i1", "j0", "j1", "k0", "k1"]


def _local(new: str) -> str:
    return f"WITH {_V}, {_NB} SELECT k, j, i, {_r4(f'CASE WHEN inner_ THEN {new} ELSE hu END')} AS hu FROM NB"


def _out(df: DataFrame) -> DataFrame:
    return df.select("k", "j", "i", r4(F.col("hu")).alias("hu"))


def _axis(src: str, axis: str, others: str) -> str:
    return f"SELECT k, j, i, hu * 0.6 + (coalesce(lag(hu) OVER w, hu) + 2 * hu + coalesce(lead(hu) OVER w, hu)) * 0.25 * 0.4 AS hu FROM {src} WINDOW w AS (PARTITION BY {others} ORDER BY {axis})"


_GAUSS = f"WITH {_V}, g1 AS ({_axis('V', 'i', 'k, j')}), g2 AS ({_axis('g1', 'j', 'k, i')}), g3 AS ({_axis('g2', 'k', 'j, i')}) SELECT k, j, i, {_r4('hu')} AS hu FROM g3"


@query(_GAUSS)
def gaussian(spark, sf_dir):
    return _out(St.gaussian(vol(spark, sf_dir), 0.4, 1))


@query(_local(f"hu * 0.6 + list_sort([hu, {', '.join(_SIX)}])[4] * 0.4"))
def median7(spark, sf_dir):
    return _out(St.median7(vol(spark, sf_dir), 0.4, 1))


_MEAN = f"(({' + '.join(_SIX)}) / 6)"


@query(_local(f"CASE WHEN greatest({', '.join(_SIX)}) - least({', '.join(_SIX)}) <= 400 * 0.725 AND abs(hu - {_MEAN}) > 400 THEN hu * (1 - 0.575) + ({_MEAN} + sign(hu - {_MEAN}) * 32) * 0.575 ELSE hu END"))
def spike_hole(spark, sf_dir):
    return _out(St.spike_hole(vol(spark, sf_dir), 0.5, 400))


@query(_local("hu + " + str(min(0.06 + (1 / 7 - 0.06) * 0.45, 1 / 7)) + " * (" + " + ".join(f"exp(-({c} - hu) * ({c} - hu) / 3600.0) * ({c} - hu)" for c in _SIX) + ")"))
def anisotropic(spark, sf_dir):
    return _out(St.anisotropic(vol(spark, sf_dir), 0.45, 60, 1))


@query(_local("hu + 0.074 * (" + " + ".join(f"({c} - hu) / sqrt(({c} - hu) * ({c} - hu) + 1.0)" for c in _SIX) + ")"))
def total_variation(spark, sf_dir):
    return _out(St.total_variation(vol(spark, sf_dir), 0.12, 1))


_BOX = "BX AS (SELECT a.k, a.j, a.i, any_value(a.hu) AS hu, sum(b.hu) / count(*) AS blur FROM V a JOIN (SELECT k + dk AS k, j + dj AS j, i + di AS i, hu FROM V, range(-1, 2) x(dk), range(-1, 2) y(dj), range(-1, 2) z(di)) b ON a.k = b.k AND a.j = b.j AND a.i = b.i GROUP BY 1, 2, 3)"


@query(f"WITH {_V}, {_BOX} SELECT k, j, i, {_r4('blur')} AS hu FROM BX")
def box_blur(spark, sf_dir):
    return _out(St.box_blur(vol(spark, sf_dir)).withColumn("hu", F.col("blur")))


@query(f"WITH {_V}, {_BOX} SELECT k, j, i, {_r4('CASE WHEN abs(hu - blur) >= 60 THEN hu + 0.8 * (hu - blur) ELSE hu END')} AS hu FROM BX")
def unsharp(spark, sf_dir):
    return _out(St.unsharp(vol(spark, sf_dir)))


@query(f"SELECT k, j, i, {_r4('CASE WHEN (hu + 700) / 150 > -1 AND (hu + 700) / 150 < 1 THEN -700 + 150 * tanh(3 * (hu + 700) / 150) / tanh(3.0) ELSE hu END')} AS hu FROM V")
def sigmoid(spark, sf_dir):
    return _out(St.sigmoid(vol(spark, sf_dir), 0.5, -700, 300))


_BIL = "SELECT a.k, a.j, a.i, any_value(a.hu) AS hu, sum(w * v) / sum(w) AS m FROM (SELECT a.k, a.j, a.i, a.hu, b.hu AS v, exp(-((dk * dk + dj * dj + di * di)::DOUBLE / 2.88)) * exp(-(b.hu - a.hu) * (b.hu - a.hu) / 5000.0) AS w FROM V a, range(-1, 2) x(dk), range(-1, 2) y(dj), range(-1, 2) z(di), V b WHERE b.k = a.k + dk AND b.j = a.j + dj AND b.i = a.i + di) a GROUP BY 1, 2, 3"


@query(f"SELECT k, j, i, {_r4('hu * (1 - 0.8) + m * 0.8')} AS hu FROM ({_BIL})")
def bilateral(spark, sf_dir):
    return _out(St.bilateral(vol(spark, sf_dir)))


@query(f"SELECT k // 2 AS k, j // 2 AS j, i // 2 AS i, {_r4('avg(hu)')} AS hu FROM V GROUP BY 1, 2, 3")
def area_average(spark, sf_dir):
    return _out(St.area_average(vol(spark, sf_dir)))


def _planes(spark, sf_dir):
    v = vol(spark, sf_dir)
    return slabs.from_voxels(v, 10, 10), V.grids(v)


@query(_GAUSS.replace("floor((hu) * 1e4 + 0.5) / 1e4", "floor(hu + 0.4901)"))
def gaussian_slabs(spark, sf_dir):
    """The same filter through slabs in 32-bit floats (compared away from the rounding border)."""
    p, g = _planes(spark, sf_dir)
    return slabs.to_voxels(slabs.run(p, g, [("gaussian", {"strength": 0.4, "passes": 1})])).select("k", "j", "i", F.floor(F.col("hu") + 0.4901).cast("double").alias("hu"))


@query()
def filter_chain(spark, sf_dir):
    """Spikes, non-local means, diffusion, total variation and unsharp masking in one shuffle, with anisotropic spacing."""
    p, g = _planes(spark, sf_dir)
    chain = Pipeline().add("spikeHole").add("nlm").add("anisotropic").add("bilateral", passes=1).add("tv", iterations=2).add("unsharp").add("sigmoid")
    return slabs.to_voxels(chain.run(p, g, 10, 10, SPACING)).select("k", "j", "i", r4(F.col("hu")).alias("hu"))


@query(f"SELECT v.k, v.j, v.i, {_r4('min((v.i - f.i) ** 2 * 0.25 + (v.j - f.j) ** 2 * 0.25 + (v.k - f.k) ** 2 * 1.5625)')} AS d2 FROM V v, (SELECT k, j, i FROM V WHERE hu BETWEEN 0 AND 3071) f GROUP BY 1, 2, 3")
def distance_to_class(spark, sf_dir):
    """Exact distance transform of a sparse class."""
    p, _ = _planes(spark, sf_dir)
    return slabs.squared_distance(p, 0, HIGH, SPACING).select("k", "j", "i", r4(F.col("d2")).alias("d2"))


# --- histograms and profiles ------------------------------------------------------------------------

_BIN = "HB AS (SELECT least(greatest(floor(hu + 0.5) + 1024, 0), 4095)::INT AS bin, count(*) AS n FROM V GROUP BY 1)"


@query(f"WITH {_V}, {_BIN} SELECT bin, n FROM HB")
def histogram(spark, sf_dir):
    return H.histogram(vol(spark, sf_dir)).select("bin", "n")


@query(f"WITH {_V}, {_BIN} SELECT bin, n FROM HB WHERE bin BETWEEN 424 AND 924")
def hist_in_range(spark, sf_dir):
    return H.in_range(H.histogram(vol(spark, sf_dir)), -600, -100).select("bin", "n")


@query(f"SELECT (floor(hu + 0.5) + 1024)::INT AS bin, count(*) AS n FROM V JOIN ({_A}) a USING (k, j, i) GROUP BY 1")
def hist_in_runs(spark, sf_dir):
    return H.histogram(H.in_runs(vol(spark, sf_dir), mask(spark, sf_dir))).select("bin", "n")


_PCT = ", ".join(f"min(v) FILTER (c >= greatest(1, ceil(t * {p} / 100.0)))::INT AS p{p}" for p in H.PERCENTILES)
_STATS = f"X AS (SELECT bin - 1024 AS v, n, sum(n) OVER (ORDER BY bin) AS c, sum(n) OVER () AS t, sum(n * (bin - 1024)) OVER () / sum(n) OVER () AS mean FROM HB) SELECT any_value(t)::BIGINT AS count, {_r4('any_value(mean)')} AS mean, {_r4('sqrt(sum(n * (v - mean) * (v - mean)) / any_value(t))')} AS sd, min(v)::INT AS min, max(v)::INT AS max, {_PCT} FROM X"


@query(f"WITH {_V}, {_BIN}, {_STATS}")
def hist_stats(spark, sf_dir):
    s = H.stats(H.histogram(vol(spark, sf_dir)))
    return s.select("count", r4(F.col("mean")).alias("mean"), r4(F.col("sd")).alias("sd"), "min", "max", *(f"p{p}" for p in H.PERCENTILES))


@query(f"WITH {_V}, {_BIN} SELECT floor((bin - 1024 + 1000) * 50 / 2001)::INT AS col, sum(n)::BIGINT AS n FROM HB WHERE bin - 1024 BETWEEN -1000 AND 1000 GROUP BY 1")
def hist_rebin(spark, sf_dir):
    return H.rebinned(H.histogram(vol(spark, sf_dir)), -1000, 1000, 50).select("col", "n")


@query("SELECT event_type AS segment, least(greatest(floor(floor(value * 10) - 1000 + 0.5) + 1024, 0), 4095)::INT AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def hist_by_class(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(1).alias("series_id"), F.col("event_type").alias("segment"), (F.floor(F.col("value") * 10) - 1000).cast("double").alias("hu"))
    return H.histogram(e, "segment").select("segment", "bin", "n")


@query(f"WITH {_V}, HD AS (SELECT (floor(hu + 0.5) + 1024)::INT AS bin, count(*) AS n FROM V, D WHERE k % (CASE WHEN d >= 240 THEN (d + 79) // 80 ELSE 1 END) = 0 AND hu < 3071 GROUP BY 1) SELECT bin, floor(n * 1.5 + 0.5)::BIGINT AS n FROM HD")
def hist_draft(spark, sf_dir):
    v = H.draft(vol(spark, sf_dir), _depth(spark, sf_dir)).where("hu < 3071")
    return H.scale(H.histogram(v), 1.5).select("bin", "n")


_LINES = [(0, 0.0, 0.0, 0.0, 9.0, 9.0, 9.0), (1, 1.0, 8.0, 2.0, 8.0, 1.0, 2.0), (2, 4.5, 4.5, 0.0, 4.5, 4.5, 9.0)]


def _samples(spark):
    lines = spark.createDataFrame([(1, *r) for r in _LINES], "series_id int, line_id int, ax double, ay double, az double, bx double, by double, bz double")
    return G.line_samples(lines, SPACING)


_LP = "ln(line_id, a_x, a_y, a_z, b_x, b_y, b_z) AS (VALUES " + ", ".join(f"({r[0]}, {', '.join(f'{v}::DOUBLE' for v in r[1:])})" for r in _LINES) + "), lm AS (SELECT *, sqrt((a_x - b_x) ** 2 * 0.25 + (a_y - b_y) ** 2 * 0.25 + (a_z - b_z) ** 2 * 1.5625) AS mm FROM ln), sm AS (SELECT *, ceil(mm / 0.5 - 1e-9)::INT + 1 AS n FROM lm), sq AS (SELECT line_id, q, mm * q / (n - 1) AS dist, a_x + (b_x - a_x) * (q / (n - 1)) AS x, a_y + (b_y - a_y) * (q / (n - 1)) AS y, a_z + (b_z - a_z) * (q / (n - 1)) AS z FROM (SELECT *, unnest(range(n)) AS q FROM sm)), cn AS (SELECT *, least(floor(x) + dx, 9) AS i, least(floor(y) + dy, 9) AS j, least(floor(z) + dz, 9) AS k, (CASE dx WHEN 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) * (CASE dy WHEN 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE dz WHEN 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END) AS wt FROM sq, range(2) a(dx), range(2) b(dy), range(2) c(dz)), pr AS (SELECT line_id, q::INT AS q, any_value(dist) AS dist, sum(wt * hu) AS hu FROM cn JOIN V USING (i, j, k) WHERE wt > 0 GROUP BY 1, 2)"


@query(f"WITH {_V}, {_LP} SELECT line_id, q, {_r4('dist')} AS dist_mm, floor(hu * 100 + 0.5) / 100 AS hu FROM pr")
def line_profile(spark, sf_dir):
    got = G.sample(_samples(spark), vol(spark, sf_dir), (10, 10, 10))
    return got.select("line_id", "q", r4(F.col("dist_mm")).alias("dist_mm"), (F.floor(F.col("hu") * 100 + 0.5) / 100).alias("hu"))


@query(f"WITH {_V}, {_LP} SELECT line_id, count(*) AS count, floor(avg(hu) * 100 + 0.5) / 100 AS mean, floor(stddev_pop(hu) * 100 + 0.5) / 100 AS sd FROM pr GROUP BY 1")
def profile_stats(spark, sf_dir):
    got = G.sample(_samples(spark), vol(spark, sf_dir), (10, 10, 10))
    s = H.profile_stats(got, F.col("hu"), "line_id")
    return s.select("line_id", "count", (F.floor(F.col("mean") * 100 + 0.5) / 100).alias("mean"), (F.floor(F.col("sd") * 100 + 0.5) / 100).alias("sd"))


@query(f"WITH {_V}, {_LP} SELECT line_id, q::INT AS q FROM (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY abs(dist - 3.1), q) AS n FROM sq) WHERE n = 1")
def nearest_sample(spark, sf_dir):
    return G.nearest_sample(_samples(spark), 3.1).select("line_id", "q")


# --- geometry --------------------------------------------------------------------------------------------

_LOOP = [(1.5, 1.5), (8.5, 1.5), (8.5, 8.5), (5.0, 4.0), (1.5, 8.5)]


def _lasso_sql() -> str:
    parts = [f"((({ay} > y) <> ({by} > y)) AND x < ({bx - ax}) * (y - {ay}) / ({by - ay}) + {ax})::INT" for (ax, ay), (bx, by) in zip(_LOOP, _LOOP[-1:] + _LOOP[:-1], strict=True) if ay != by]
    return f"SELECT k, j, i, ({' + '.join(parts)}) % 2 = 1 AS inside FROM (SELECT *, i::DOUBLE AS x, j::DOUBLE AS y FROM V)"


@query(_lasso_sql())
def lasso_points(spark, sf_dir):
    return vol(spark, sf_dir).select("k", "j", "i", G.inside_polygon(F.col("i").cast("double"), F.col("j").cast("double"), _LOOP).alias("inside"))


@query("SELECT j * 10 + i AS ray_id, min(k)::DOUBLE AS t FROM V WHERE hu >= -100 GROUP BY 1")
def ray_first_hit(spark, sf_dir):
    """Rays along z through every column; a hit is the first solid voxel."""
    v, reach = vol(spark, sf_dir), float(_depth(spark, sf_dir) - 1)
    rays = v.where("k = 0").select((F.col("j") * 10 + F.col("i")).alias("ray_id"), "series_id", F.col("i").cast("double").alias("ox"), F.col("j").cast("double").alias("oy"), F.lit(0.0).alias("oz"), F.lit(0.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(1.0).alias("dz"), F.lit(reach).alias("reach"))
    hit = G.first_hit(rays, v, S.at_least(F.col("hu"), -100), step=1.0)
    return hit.where("t is not null").select("ray_id", "t")


@query("SELECT k, j, i FROM V WHERE abs(j * 0.5 - 2.0) <= 0.25 + m() AND i * 0.5 - 1.0 BETWEEN -m() AND 2.0 + m() AND k * 1.25 BETWEEN -m() AND 3.0 + m()".replace("m()", str(0.5 * (0.25 + 0.25 + 1.5625) ** 0.5)))
def cut_voxels(spark, sf_dir):
    cut = G.cut_prism(vol(spark, sf_dir), [(1.0, 2.0, 0.0), (3.0, 2.0, 0.0)], (0, 0, 1), 0.5, 3.0, SPACING)
    return cut.select("k", "j", "i")


_FACES = f"F AS (SELECT k, j, i, ((i = 0 OR NOT coalesce(i0 BETWEEN {LOW} AND {HIGH}, false))::INT + 2 * (NOT coalesce(i1 BETWEEN {LOW} AND {HIGH}, false))::INT + 4 * (NOT coalesce(j0 BETWEEN {LOW} AND {HIGH}, false))::INT + 8 * (NOT coalesce(j1 BETWEEN {LOW} AND {HIGH}, false))::INT + 16 * (NOT coalesce(k0 BETWEEN {LOW} AND {HIGH}, false))::INT + 32 * (NOT coalesce(k1 BETWEEN {LOW} AND {HIGH}, false))::INT)::INT AS faces FROM NB WHERE hu BETWEEN {LOW} AND {HIGH})"


@query(f"WITH {_V}, {_NB}, {_FACES} SELECT * FROM F WHERE faces > 0")
def exposed_faces(spark, sf_dir):
    return St.exposed_faces(vol(spark, sf_dir), S.inside(F.col("hu"), LOW, HIGH)).select("k", "j", "i", "faces")


@query(f"WITH {_V}, {_NB}, {_FACES} SELECT {_r4(f'(SELECT count(*) FROM ({_A})) * 0.3125')} AS volume, (sum(bit_count(faces)) * 2)::BIGINT AS triangles FROM F")
def mesh_volume(spark, sf_dir):
    """The closed surface encloses exactly the mask's voxels."""
    f = St.exposed_faces(vol(spark, sf_dir), S.inside(F.col("hu"), LOW, HIGH))
    return Me.signed_volume(Me.triangles(f, SPACING)).select(r4(F.col("volume")).alias("volume"), "triangles")


# --- series quality -------------------------------------------------------------------------------------------


def _ordered(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    o = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("series_id"), o.alias("ord"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("position"), F.col("event_id").cast("double").alias("instance"), F.col("event_id").cast("int").alias("read_idx"))


_GAPS = "O AS (SELECT user_id AS s, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, epoch_us(ts) / 1e6 AS p FROM events), G1 AS (SELECT *, abs(p - lag(p) OVER (PARTITION BY s ORDER BY ord)) AS gap FROM O), RF AS (SELECT s, coalesce(quantile_cont(gap, 0.5) FILTER (gap > 0.001), quantile_cont(gap, 0.5)) AS ref FROM G1 GROUP BY s), G2 AS (SELECT *, CASE WHEN gap IS NULL THEN 'first' WHEN gap <= greatest(0.001, 0.05 * ref) THEN 'duplicate' WHEN gap > 1.5 * ref THEN 'missing' ELSE 'regular' END AS kind FROM G1 JOIN RF USING (s)), G3 AS (SELECT *, CASE WHEN kind = 'missing' THEN greatest(1, floor(gap / ref + 0.5) - 1)::INT ELSE 0 END AS missing FROM G2), G4 AS (SELECT *, (sum(missing) OVER (PARTITION BY s ORDER BY ord))::INT AS shift FROM G3)"


@query(f"WITH {_V}, {_GAPS} SELECT s AS series_id, ord::INT AS ord, kind, missing, shift FROM G4")
def slice_gaps(spark, sf_dir):
    return Se.gaps(_ordered(spark, sf_dir)).select("series_id", "ord", "kind", "missing", "shift")


@query(f"WITH {_V}, {_GAPS} SELECT s AS series_id, count(*) AS slices, count(*) FILTER (kind = 'duplicate') AS duplicates, sum(missing)::BIGINT AS missing, floor(coalesce(quantile_cont(gap, 0.5) FILTER (kind = 'regular'), max(ref)) * 1e3 + 0.5) / 1e3 AS median_gap, CASE WHEN count(*) < 2 OR max(ref) IS NULL OR max(ref) <= 0.001 THEN 'tag' WHEN sum(missing) > 0 THEN 'fit' ELSE 'span' END AS basis FROM G4 GROUP BY s")
def series_spacing(spark, sf_dir):
    s = Se.spacing(Se.gaps(_ordered(spark, sf_dir)))
    return s.select("series_id", "slices", "duplicates", "missing", (F.floor(F.col("median_gap") * 1e3 + 0.5) / 1e3).alias("median_gap"), "basis")


@query(f"WITH {_V}, {_GAPS} SELECT s AS series_id, floor(regr_slope(p - p0, (ord + shift)::DOUBLE) + 0.5) AS spacing FROM (SELECT *, min(p) OVER (PARTITION BY s) AS p0, sum(missing) OVER (PARTITION BY s) AS m, count(*) OVER (PARTITION BY s) AS c FROM G4) WHERE m > 0 AND c > 1 AND ref > 0.001 GROUP BY s")
def spacing_fit(spark, sf_dir):
    o = _ordered(spark, sf_dir)
    o = o.withColumn("position", F.col("position") - F.min("position").over(Window.partitionBy("series_id")))
    return Se.spacing(Se.gaps(o)).where("basis = 'fit'").select("series_id", F.floor(F.col("spacing") + 0.5).cast("double").alias("spacing"))


@query(f"WITH {_V}, {_GAPS} SELECT s AS series_id, min(event_id)::INT AS read_idx FROM (SELECT *, sum((kind <> 'duplicate')::INT) OVER (PARTITION BY s ORDER BY ord) AS run FROM G4) GROUP BY s, run")
def dedupe_slices(spark, sf_dir):
    return Se.drop_duplicates(Se.gaps(_ordered(spark, sf_dir))).select("series_id", "read_idx")


# --- segments ---------------------------------------------------------------------------------------------------


@query("SELECT segment, count(*) AS voxels FROM (SELECT CASE WHEN hu BETWEEN 300 AND 3071 THEN 'bone' WHEN hu BETWEEN -200 AND 299 THEN 'soft' WHEN hu BETWEEN -600 AND -150 THEN 'fat' WHEN hu BETWEEN -900 AND -500 THEN 'lung' END AS segment FROM V) WHERE segment IS NOT NULL GROUP BY segment")
def exclusive_segments(spark, sf_dir):
    got = Sg.final_runs(vol(spark, sf_dir), grid(spark, sf_dir), SEGMENTS, SPACING)
    out = None
    for key, runs in got.items():
        one = R.count(runs).select(F.lit(key).alias("segment"), "voxels")
        out = one if out is None else out.union(one)
    return out


_OPEN = _dil(_ero("SELECT k, j, i FROM V WHERE hu BETWEEN -985 AND -400"))


@query(f"SELECT 'low' AS segment, count(*) AS voxels FROM ({_OPEN}) UNION ALL SELECT 'rest', count(*) FROM (SELECT k, j, i FROM V WHERE hu BETWEEN -1000 AND 0 EXCEPT ({_OPEN}))")
def segments_by_voxel(spark, sf_dir):
    """A processed segment takes its final voxels, not its range, from the one below."""
    segs = [Sg.Segment("low", -985, -400, opening=1), Sg.Segment("rest", -1000, 0)]
    got = Sg.final_runs(vol(spark, sf_dir), grid(spark, sf_dir), segs, SPACING)
    return R.count(got["low"]).select(F.lit("low").alias("segment"), "voxels").union(R.count(got["rest"]).select(F.lit("rest").alias("segment"), "voxels"))


@query(_islands(f"({_A} INTERSECT SELECT k, j, i FROM V WHERE k < 8) EXCEPT SELECT k, j, i FROM V WHERE j = 4"))
def edited_runs(spark, sf_dir):
    v, m = vol(spark, sf_dir), mask(spark, sf_dir)
    log = Sg.EditLog(spark.createDataFrame([], "segment string, kind string, series_id int, k int, j int, x0 int, x1 int"))
    log.add("a", "keep", R.from_voxels(v, F.col("k") < 8))
    log.add("a", "exclude", R.from_voxels(v, F.col("j") == 4))
    log.add("a", "exclude", R.from_voxels(v, F.col("j") == 5))
    return _rows(Sg.apply_edits(m, log.undo()))


# --- points and measurements -------------------------------------------------------------------------------------------


def _points(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type = 'click'")
    return e.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("point_id"), (F.col("event_id") % 10).cast("int").alias("i"), F.expr("event_id div 10 % 10").cast("int").alias("j"), F.expr("event_id div 100").cast("int").alias("k"))


def _pairs(spark, sf_dir):
    p = _points(spark, sf_dir).withColumn("b", F.lead("point_id").over(Window.partitionBy("series_id").orderBy("point_id")))
    return p.where("b is not null").select(F.col("point_id").alias("id"), F.col("point_id").alias("a"), "b")


_PT = "PT AS (SELECT user_id AS s, event_id AS p, event_id % 10 AS i, (event_id // 10) % 10 AS j, event_id // 100 AS k FROM events WHERE event_type = 'click'), MS AS (SELECT p AS id, p AS a, lead(p) OVER (PARTITION BY s ORDER BY p) AS b FROM PT)"


@query(f"WITH {_V}, {_PT} SELECT id, a, b, {_r4('sqrt((x.i - y.i) ** 2 * 0.25 + (x.j - y.j) ** 2 * 0.25 + (x.k - y.k) ** 2 * 1.5625)')} AS mm FROM MS JOIN PT x ON x.p = a JOIN PT y ON y.p = b")
def measure_distances(spark, sf_dir):
    return N.measured(_pairs(spark, sf_dir), _points(spark, sf_dir), SPACING).select("id", "a", "b", r4(F.col("mm")).alias("mm"))


@query(f"WITH {_V}, {_PT} SELECT id, a, b FROM MS WHERE b IS NOT NULL AND a % 3 <> 0 AND b % 3 <> 0")
def measure_cascade(spark, sf_dir):
    return N.cascade(_pairs(spark, sf_dir), _points(spark, sf_dir).where("point_id % 3 <> 0")).select("id", "a", "b")


@query(f"WITH {_V}, {_PT} SELECT coalesce(n.p, o.p) AS id, CASE WHEN o.p IS NULL THEN 'added' WHEN n.p IS NULL THEN 'removed' ELSE 'changed' END AS change FROM (SELECT p, i % 3 AS g FROM PT WHERE p % 5 <> 0) o FULL JOIN (SELECT p, i % 2 AS g FROM PT WHERE p % 7 <> 0) n ON o.p = n.p WHERE o.p IS NULL OR n.p IS NULL OR o.g <> n.g")
def point_changes(spark, sf_dir):
    p = _points(spark, sf_dir)
    old = p.where("point_id % 5 <> 0").select(F.col("point_id").alias("id"), (F.col("i") % 3).alias("signature"))
    return N.changes(old, p.where("point_id % 7 <> 0").select(F.col("point_id").alias("id"), (F.col("i") % 2).alias("signature"))).select("id", "change")


@query(f"WITH {_V}, {_PT} SELECT q.k AS plane_id, p AS point_id, PT.k = q.k AS exact, abs(PT.k - q.k)::INT AS away FROM PT JOIN (SELECT DISTINCT s, k FROM PT) q ON q.s = PT.s AND abs(PT.k - q.k) <= 3")
def plane_markers(spark, sf_dir):
    p = _points(spark, sf_dir)
    planes = p.select("series_id", "k").distinct().select(F.col("k").cast("long").alias("plane_id"), "series_id", "k")
    return N.markers(p, planes).select("plane_id", "point_id", "exact", F.col("away").cast("int").alias("away"))


@query("WITH V AS (SELECT 1), O AS (SELECT 'p' || event_id AS id, event_id::DOUBLE AS t FROM events WHERE value < 60), NW AS (SELECT 'p' || event_id AS id, CASE WHEN event_id % 2 = 0 THEN event_id + 0.5 ELSE event_id END::DOUBLE AS t FROM events WHERE value >= 20) SELECT id AS point_id, t AS text FROM O UNION ALL SELECT CASE WHEN O.id IS NULL THEN NW.id ELSE NW.id || '_' END, NW.t FROM NW LEFT JOIN O ON O.id = NW.id WHERE O.id IS NULL OR O.t <> NW.t")
def merge_points(spark, sf_dir):
    """Values of 20 to 60 come twice, events of even numbers with another text; those are renamed."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("point_id")
    text = F.col("event_id").cast("double")
    old = e.where("value < 60").select(name, text.alias("text"))
    new = e.where("value >= 20").select(name, F.when(F.col("event_id") % 2 == 0, text + 0.5).otherwise(text).alias("text"))
    return N.merge_points(old, new)[0].select("point_id", "text")


# --- showing values, reduced copies --------------------------------------------------------------------------


_TINT = "'#' || lpad(printf('%x', event_id * 7919 % 16777216), 6, '0')"


@query(f"""SELECT event_id, CASE WHEN part <= 1 THEN pw WHEN part <= 2 THEN 2 * pw WHEN part <= 5 THEN 5 * pw ELSE 10 * pw END AS step, CASE WHEN value >= 1 THEN 0 ELSE least(greatest(ceil(-log10(value)), 0), 4) END::INT AS digits,
    CASE WHEN event_id = 0 THEN '0 B' WHEN event_id * 97 < 1024 THEN printf('%.0f B', (event_id * 97)::DOUBLE) WHEN event_id * 97 < 1048576 THEN printf('%.2f KiB', floor(event_id * 97 / 10.24::DOUBLE + 0.5) / 100) ELSE printf('%.2f MiB', floor(event_id * 97 / 10485.76::DOUBLE + 0.5) / 100) END AS size,
    {_TINT} AS tint, (0.2126 * (event_id * 7919 % 16777216 // 65536) + 0.7152 * (event_id * 7919 % 16777216 // 256 % 256) + 0.0722 * (event_id * 7919 % 256)) / 255 > 0.45 AS dark
    FROM (SELECT *, tg / pw AS part FROM (SELECT *, pow(10.0, floor(log10(tg))) AS pw FROM (SELECT *, greatest(value / 700, 1e-6) AS tg FROM events)))""")
def display_values(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    tint = F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("event_id") * 7919 % 16777216)), 6, "0"))
    return e.select("event_id", Di.value_step(F.col("value")).alias("step"), Di.digits(F.col("value")).alias("digits"), Di.byte_size(F.col("event_id") * 97).alias("size"), Di.colour(tint).alias("tint"), Di.dark_ink(Di.rgb(tint)).alias("dark"))


@query("SELECT k, j, i, floor(avg(hu) * 1e4 + 0.5) / 1e4 AS hu FROM (SELECT floor((k * t + t - 1) / d)::INT AS k, floor((j * 7 + 6) / 10)::INT AS j, i, hu FROM V, (SELECT d, d * 2 // 5 AS t FROM D)) GROUP BY 1, 2, 3")
def area_average_uneven(spark, sf_dir):
    d = _depth(spark, sf_dir)
    return _out(Su.area_average(vol(spark, sf_dir), (10, 10, d), (10, 7, d * 2 // 5)))


@query(f"SELECT k // 8 AS bk, j // 8 AS bj, i // 8 AS bi, bit_or(1 << s)::INT AS segments FROM (SELECT 0 AS s, k, j, i FROM ({_A}) UNION ALL SELECT 1, k, j, i FROM ({_B})) GROUP BY 1, 2, 3")
def mask_bricks(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    both = a.withColumn("segment", F.lit(0)).unionByName(b.withColumn("segment", F.lit(1)))
    return Su.mask_bricks(both).select("bk", "bj", "bi", "segments")


@query(_islands(f"SELECT t.k::INT AS k, u.j::INT AS j, v.i::INT AS i FROM (SELECT unnest(range(m)) AS k, d, m FROM (SELECT d, d * 3 // 5 AS m FROM D)) t, range(4) u(j), range(7) v(i), ({_A}) a WHERE a.k = floor(t.k * (t.d - 1) / (t.m - 1) + 0.5) AND a.j = floor(u.j * 9 / 3 + 0.5) AND a.i = floor(v.i * 9 / 6 + 0.5)"))
def resampled_runs(spark, sf_dir):
    d = _depth(spark, sf_dir)
    return _rows(Su.resampled_runs(mask(spark, sf_dir), (10, 10, d), (7, 4, d * 3 // 5)))


# --- regions, edits of points, series tables -----------------------------------------------------------------


_AIR = "SELECT k, j, i FROM V WHERE hu BETWEEN -1000 AND -300"


@query(f"""WITH RECURSIVE {_V}, A AS MATERIALIZED ({_AIR}), X(k, j, i) AS (SELECT k, j, i FROM A WHERE j IN (0, 9) OR i IN (0, 9)
    UNION SELECT A.k, A.j, A.i FROM X JOIN A ON A.k = X.k AND abs(A.j - X.j) + abs(A.i - X.i) = 1) {_islands("SELECT k, j, i FROM X")}""")
def exterior_air(spark, sf_dir):
    return _rows(C.exterior_air(mask(spark, sf_dir, -1000, -300), grid(spark, sf_dir)))


@query(f"SELECT event_id, CASE WHEN value > 50 THEN {_r4('event_id * (value - 50) * 0.5 * 1.25')} END AS mm3 FROM events")
def physical_volume(spark, sf_dir):
    """Null where the spacing is not positive."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", r4(H.volume_mm3(F.col("event_id"), F.col("value") - 50, F.lit(0.5), F.lit(1.25))).alias("mm3"))


@query("SELECT user_id AS series_id, event_id AS line FROM events WHERE abs(value - 50) <= 6 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 50), event_id) = 1")
def nearest_line(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return H.nearest_line(e.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("line"), F.col("value").alias("at")), F.lit(50.0))


@query(f"""SELECT (SELECT count(*) FROM ({_A})) AS before, (SELECT count(*) FROM ({_A}) WHERE j <> 4) AS after, (SELECT count(*) FROM ({_B})) AS body,
    (SELECT count(*) FROM (SELECT k, j, i FROM ({_A}) WHERE j <> 4 INTERSECT {_B})) AS inside_body, (d * 100)::BIGINT AS total FROM D""")
def process_stats(spark, sf_dir):
    a, b = _pair(spark, sf_dir)
    return H.process_stats(a, a.where("j <> 4"), b, 100 * _depth(spark, sf_dir)).drop("series_id")


def _regions(spark, sf_dir):
    """Region 1 and 3 are parts of one segment, region 2 is another segment that overlaps them; all are selected."""
    a, b = _pair(spark, sf_dir)
    runs = a.withColumn("region_id", F.when(F.col("j") < 5, 1).otherwise(3)).unionByName(b.withColumn("region_id", F.lit(2)))
    names = [(1, 1, ["a"]), (1, 2, ["b"]), (1, 3, ["a"])]
    meta = spark.createDataFrame(names, "series_id int, region_id long, segments array<string>")
    for c in ("selected", "visible", "merged"):
        meta = meta.withColumn(c, F.lit(c != "merged"))
    return meta, runs.select("series_id", F.col("region_id").cast("long").alias("region_id"), "k", "j", "x0", "x1")


def _shown(regions, runs):
    return Rg.sized(regions, runs, 0.3125).select("region_id", F.array_join("segments", "+").alias("segments"), "selected", "merged", "voxels", "mm3")


_REG = f"RG AS (SELECT CASE WHEN j < 5 THEN 1 ELSE 3 END AS region_id, k, j, i FROM ({_A}) UNION ALL SELECT 2, k, j, i FROM ({_B}))"
_SHOWN = "count(*) AS voxels, count(*) * 0.3125::DOUBLE AS mm3"


@query(f"WITH {_V}, {_REG} SELECT region_id::BIGINT AS region_id, CASE WHEN region_id = 2 THEN 'b' ELSE 'a' END AS segments, true AS selected, false AS merged, {_SHOWN} FROM RG WHERE region_id = 2 OR (k < 7 AND i <> 3 AND j <> 2) GROUP BY region_id")
def trimmed_regions(spark, sf_dir):
    v = vol(spark, sf_dir)
    parts = [("keep", F.col("k") < 7), ("exclude", F.col("i") == 3), ("exclude", F.col("j") == 2)]
    edits = [R.from_voxels(v, c).withColumn("kind", F.lit(kind)) for kind, c in parts]
    return _shown(*Rg.trim(*_regions(spark, sf_dir), "a", edits[0].unionByName(edits[1]).unionByName(edits[2])))


@query(f"SELECT 4::BIGINT AS region_id, 'a+b' AS segments, true AS selected, true AS merged, {_SHOWN} FROM ({_A} UNION {_B})")
def merged_regions(spark, sf_dir):
    return _shown(*Rg.merge_selected(*_regions(spark, sf_dir)))


_SPOTS, _BOX = "SELECT k, j, i FROM V WHERE hu BETWEEN -900 AND -750", [(-0.5, -0.5), (5.5, -0.5), (5.5, 6.5), (-0.5, 6.5)]
_SAME = [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]]
_INSIDE = "P AS (SELECT comp_id, bool_and(n % 10 < 5.5 AND (n // 10) % 10 < 6.5) AS inside, count(*) AS n FROM comp GROUP BY comp_id)"


@query(_cc(_SPOTS, f", {_INSIDE} SELECT 1::BIGINT AS region_id, 's' AS segments, true AS selected, count(*) > 1 AS merged, sum(n)::BIGINT AS voxels, sum(n) * 0.3125::DOUBLE AS mm3 FROM P WHERE inside HAVING count(*) > 0"))
def lasso_regions(spark, sf_dir):
    """What lies wholly inside a loop on the image becomes a region."""
    meta, runs = _regions(spark, sf_dir)
    spots = mask(spark, sf_dir, -900, -750).withColumn("segment", F.lit("s"))
    return _shown(*Rg.lasso_select(meta.where("false"), runs.where("false"), spots, grid(spark, sf_dir), _BOX, _SAME))


@query(_cc(_SPOTS, f""", {_INSIDE} SELECT CASE WHEN inside THEN 2 ELSE 1 END::BIGINT AS region_id, 's' AS segments, NOT inside AS selected, count(*) > 1 AS merged, sum(n)::BIGINT AS voxels,
    sum(n) * 0.3125::DOUBLE AS mm3 FROM P GROUP BY inside"""))
def lasso_split(spark, sf_dir):
    """A selected region that lies partly inside the loop is split in two."""
    meta = spark.createDataFrame([(1, 1, ["s"], True, True, True)], "series_id int, region_id long, segments array<string>, selected boolean, visible boolean, merged boolean")
    runs = mask(spark, sf_dir, -900, -750).withColumn("region_id", F.lit(1).cast("long"))
    return _shown(*Rg.lasso_deselect(meta, runs, grid(spark, sf_dir), _BOX, _SAME))


@query(f"""WITH {_V}, {_PT} SELECT p AS point_id, CASE WHEN p % 5 = 0 THEN 'n' || p ELSE 't' || p END AS text, CASE WHEN p % 3 = 0 THEN i + 1 ELSE i END::INT AS i, j::INT AS j, k::INT AS k,
    CASE WHEN p % 4 = 0 THEN '#00ff7f' WHEN p % 4 = 2 THEN NULL ELSE '#123456' END AS colour FROM PT WHERE p % 11 <> 0""")
def point_edits(spark, sf_dir):
    """Texts, places and colours change; blank texts, places that are no numbers and other colours are refused; some points go."""
    p = _points(spark, sf_dir)
    n = F.col("point_id")
    p = p.withColumn("text", F.concat(F.lit("t"), n.cast("string"))).withColumn("colour", F.lit("#123456"))
    texts = p.select("point_id", F.when(n % 5 == 0, F.concat(F.lit("n"), n.cast("string"))).otherwise(" ").alias("text"))
    places = p.select("point_id", F.when(n % 3 == 0, F.col("i") + 0.5).otherwise(F.lit(float("nan"))).alias("i"), F.col("j") + 0.4, F.col("k") - 0.5).toDF("point_id", "i", "j", "k")
    tints = p.select("point_id", F.when(n % 4 == 0, " #00FF7F ").when(n % 4 == 2, "").otherwise("red").alias("colour"))
    out = N.coloured(N.moved(N.with_text(p, texts), places), tints)
    return N.without(out, p.where(n % 11 == 0), "point_id").select("point_id", "text", "i", "j", "k", "colour")


@query(f"WITH {_V}, {_PT} SELECT id, a, b FROM MS WHERE b IS NOT NULL")
def measurement_restore(spark, sf_dir):
    """Measurements that were taken away come back once, whatever their id or the order of their points; none between series does."""
    p, all_ = _points(spark, sf_dir), _pairs(spark, sf_dir)
    turned = all_.select((-F.col("id") - 1).alias("id"), F.col("b").alias("a"), F.col("a").alias("b"))
    across = p.where("series_id % 2 = 0").alias("x").join(p.where("series_id % 2 = 1").alias("y"), F.expr("x.point_id = y.point_id - 1"))
    across = across.select(F.expr("-1000000000 - x.point_id").alias("id"), F.col("x.point_id").alias("a"), F.col("y.point_id").alias("b"))
    left = all_.where("id % 3 <> 0")
    back = all_.unionByName(turned.where("a % 3 <> 0 and b % 3 <> 0")).unionByName(across)
    known = left.unionByName(all_.where("id % 3 = 0"))
    return N.add_measurements(left, back.join(known.select("id"), "id", "left_semi").unionByName(across), p, most=1 << 30, one_series=True)


@query(f"""WITH {_V}, {_PT} SELECT id, CASE WHEN id % 3 = 0 THEN floor((id % 7 + 0.12345) * 1000 + 0.5) / 1000 WHEN id % 3 = 1 THEN NULL ELSE 1.0 END::DOUBLE AS di,
    CASE WHEN id % 3 = 1 THEN NULL WHEN id % 3 = 0 THEN -2.5 ELSE 1.0 END::DOUBLE AS dk FROM MS WHERE b IS NOT NULL""")
def label_offsets(spark, sf_dir):
    """Every third label moves, every third goes back, and for the rest the move is out of reach."""
    one = F.struct(*(F.lit(1.0).alias(c) for c in "ijk"))
    m = _pairs(spark, sf_dir).withColumn("offset", F.when(F.col("id") >= 0, one))
    kind = F.col("id") % 3
    to = lambda v: F.when(kind == 0, v).when(kind == 2, 2e4)
    edits = m.select("id", to(F.col("id") % 7 + 0.12345).alias("i"), to(F.lit(0.0)).alias("j"), to(F.lit(-2.5)).alias("k"))
    return N.with_label_offset(m, edits).select("id", F.col("offset.i").alias("di"), F.col("offset.k").alias("dk"))


@query(f"""SELECT line_id, q, CASE WHEN lo % 3 = 1 THEN hi_hu WHEN f > 1e-9 AND (lo + 1) % 3 <> 1 THEN {_r4('lo_hu * (1 - f) + hi_hu * f')} ELSE lo_hu END AS hu
    FROM (SELECT a.j * 10 + a.i AS line_id, q::INT AS q, lo, f, a.hu AS lo_hu, CASE WHEN f > 1e-9 AND (lo + 1) % 3 <> 1 THEN b.hu END AS hi_hu
          FROM (SELECT q, floor(z)::INT AS lo, z - floor(z) AS f FROM (SELECT q, 9.0::DOUBLE * (q / 23.0::DOUBLE) AS z FROM range(24) r(q))) s
          JOIN V a ON a.k = lo LEFT JOIN V b ON b.k = lo + 1 AND b.j = a.j AND b.i = a.i)""")
def coarse_profile(spark, sf_dir):
    """Lines along z through every pixel, of which every third slice is not at hand."""
    v = vol(spark, sf_dir)
    ends = {"ax": "i", "ay": "j", "az": "0", "bx": "i", "by": "j", "bz": "9"}
    lines = v.where("k = 0").select("series_id", (F.col("j") * 10 + F.col("i")).alias("line_id"), *(F.expr(e).cast("double").alias(c) for c, e in ends.items()))
    got = G.coarse_profile(lines, v.where("k % 3 <> 1"), (10, 10, _depth(spark, sf_dir)), SPACING)
    return got.select("line_id", "q", r4(F.col("hu")).alias("hu"))


@query(f"""WITH {_V}, {_GAPS}, K AS (SELECT s, min(event_id) AS event_id, min(ord) AS place FROM (SELECT *, sum((kind <> 'duplicate')::INT) OVER (PARTITION BY s ORDER BY ord) AS run FROM G4) GROUP BY s, run)
    SELECT 'x::' || s AS series_id, count(*) AS slices, max(8 + event_id % 3)::INT AS "rows", max(6 + event_id % 5)::INT AS columns, CAST(arg_min(event_id % 7, place) FILTER (event_id % 7 > 0) AS DOUBLE) AS window_width,
    min(-100.0 - event_id % 3)::DOUBLE AS min_hu FROM K GROUP BY s""")
def grouped_series(spark, sf_dir):
    """Each user's events as the slices of a series, one for each place."""
    o = _ordered(spark, sf_dir)
    n = F.col("read_idx")
    fixed = {"orientation": "array(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)", "pos": "array(0.0, 0.0, position)", "pixel_spacing": "array(0.5, 0.5)", "description": "'d'", "modality": "'CT'", "study_uid": "'x'"}
    tags = {"bits": "16", "bits_stored": "12", "signed": "0", "smallest": "0", "largest": "1000", "slope": "1.0", "window_center": "40.0", "spacing_between": "cast(null as double)", "thickness": "1.0"}
    s = o.select("read_idx", "instance", F.col("series_id").cast("string").alias("series_uid"), *(F.expr(e).alias(c) for c, e in (fixed | tags).items()))
    s = s.withColumn("rows", 8 + n % 3).withColumn("columns", 6 + n % 5).withColumn("window_width", (n % 7).cast("double")).withColumn("intercept", (-100 - n % 3).cast("double"))
    return Se.group(s)[1].select("series_id", "slices", "rows", "columns", "window_width", "min_hu")
