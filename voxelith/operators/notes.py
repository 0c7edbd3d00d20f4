"""Points and measurements as relations: validity, merging, numbering, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

MOST_TEXT, MOST_MEASUREMENTS = 2000, 500


def measured(measurements: DataFrame, points: DataFrame, spacing) -> DataFrame:
    """Measurements whose two points exist in one series, with their distance."""
    p = points.select("series_id", "point_id", "i", "j", "k")
    a = p.toDF("series_id", "a", "ai", "aj", "ak")
    b = p.toDF("series_b", "b", "bi", "bj", "bk")
    both = measurements.join(a, "a").join(b, "b").where("series_id = series_b")
    mm = S.distance_mm([F.col(f"a{c}") for c in "ijk"], [F.col(f"b{c}") for c in "ijk"], spacing)
    return both.select("series_id", "id", "a", "b", mm.alias("mm"))


def one_per_pair(measurements: DataFrame) -> DataFrame:
    """Of measurements between the same two points, in either order, the first id stays."""
    pair = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("id")
    return measurements.withColumn("_n", F.row_number().over(pair)).where("_n = 1").drop("_n")


def in_one_series(measurements: DataFrame, points: DataFrame) -> DataFrame:
    """Measurements between two different points of one series."""
    of = points.select("point_id", "series_id")
    both = of.toDF("a", "_sa"), of.toDF("b", "_sb")
    met = measurements.where("a <> b").join(both[0], "a").join(both[1], "b")
    return met.where("_sa = _sb").select(measurements.columns)


def cascade(measurements: DataFrame, points: DataFrame) -> DataFrame:
    """What is left when points went: both ends must exist."""
    ids = points.select("point_id")
    return measurements.join(ids.toDF("a"), "a", "left_semi").join(ids.toDF("b"), "b", "left_semi")


def add_measurements(old: DataFrame, new: DataFrame, points: DataFrame, most: int = MOST_MEASUREMENTS, one_series: bool = False) -> DataFrame:
    """Old ones and those new ones whose pair and id are new, in id order up to the limit.

    With ``one_series``, measurements between points of two series are refused.
    """
    pair = lambda df: df.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    fresh = one_per_pair(in_one_series(new, points) if one_series else cascade(new, points)).join(old.select("id"), "id", "left_anti")
    fresh = fresh.withColumn("p", F.least("a", "b")).withColumn("q", F.greatest("a", "b")).join(pair(old).distinct(), ["p", "q"], "left_anti")
    both = old.select("id", "a", "b", F.lit(0).alias("_new")).unionByName(fresh.select("id", "a", "b", F.lit(1).alias("_new")))
    return both.orderBy("_new", "id").limit(most).drop("_new")


def merge_points(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Union of two sets of points; a new point with a taken id and another content is renamed.  Also the rename map.

    An identical point merges into the one that is there; renamed ids get underscores until they are free.
    """
    cols = [c for c in old.columns if c != "point_id"]
    same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in cols]
    equal = same[0]
    for s in same[1:]:
        equal = equal & s
    met = new.alias("n").join(old.alias("o"), F.col("n.point_id") == F.col("o.point_id"), "left")
    state = met.select("n.*", F.when(F.col("o.point_id").isNull(), "new").when(equal, "same").otherwise("clash").alias("state"))
    ids = old.select("point_id").unionByName(new.select("point_id")).distinct()
    clash = state.where("state = 'clash'").select("point_id").distinct()
    stem = F.regexp_replace("point_id", "_+$", "")
    longest = ids.groupBy(stem.alias("stem")).agg(F.max(F.length("point_id") - F.length(stem)).alias("tail"))
    nth = F.row_number().over(Window.partitionBy("stem").orderBy("point_id"))
    renamed = clash.withColumn("stem", stem).join(longest, "stem").select("point_id", F.expr(f"concat(stem, repeat('_', int(tail) + {1})) ").alias("base"), nth.alias("nth"))
    names = renamed.select("point_id", F.concat("base", F.expr("repeat('_', nth - 1)")).alias("new_id"))
    fresh = state.where("state <> 'same'").join(names, "point_id", "left").select(F.coalesce("new_id", "point_id").alias("point_id"), *cols)
    return old.unionByName(fresh), names


def unique_ids(rows: DataFrame, order: str) -> DataFrame:
    """First row of an id keeps it, later ones get underscores."""
    n = F.row_number().over(Window.partitionBy("id").orderBy(order))
    return rows.withColumn("_n", n).withColumn("id", F.concat("id", F.expr("repeat('_', _n - 1)"))).drop("_n")


def next_number(rows: DataFrame, column: str) -> DataFrame:
    return rows.agg((F.coalesce(F.max(column), F.lit(0)) + 1).alias("next"))


def usable_text(text: Column) -> Column:
    """Trimmed and cut to the limit; null where nothing is left."""
    cut = F.trim(F.substring(text, 1, MOST_TEXT))
    return F.when(cut != "", cut)


def with_text(points: DataFrame, edits: DataFrame) -> DataFrame:
    """New texts, cut to the limit, from ``edits(point_id, text)``; a blank one is refused."""
    text = F.substring("text", 1, MOST_TEXT)
    new = edits.where(F.trim(text) != "").select("point_id", text.alias("_text"))
    return points.join(new, "point_id", "left").withColumn("text", F.coalesce("_text", "text")).select(points.columns)


def moved(points: DataFrame, edits: DataFrame) -> DataFrame:
    """New positions, rounded half up to a voxel, from ``edits(point_id, i, j, k)``; one that is not finite is refused."""
    axes = "ijk"
    finite = lambda c: F.coalesce(F.abs(F.col(c).cast("double")) < float("inf"), F.lit(False))
    new = edits.where(finite("i") & finite("j") & finite("k"))
    new = new.select("point_id", *(S.round_half_up(F.col(c).cast("double")).cast("int").alias(f"_{c}") for c in axes))
    met = points.join(new, "point_id", "left")
    for c in axes:
        met = met.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)))
    return met.select(points.columns)


def coloured(points: DataFrame, edits: DataFrame) -> DataFrame:
    """Colours ``#rrggbb`` from ``edits(point_id, colour)``; null or empty takes a colour away, anything else is refused."""
    c = F.lower(F.trim("colour"))
    none = F.coalesce(F.col("colour") == "", F.lit(True))
    new = edits.where(none | c.rlike("^#[0-9a-f]{6}$")).select("point_id", F.when(~none, c).alias("_colour"), F.lit(True).alias("_set"))
    met = points.join(new, "point_id", "left")
    return met.withColumn("colour", F.when(F.col("_set"), F.col("_colour")).otherwise(F.col("colour"))).select(points.columns)


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def restored(rows: DataFrame, back: DataFrame, key: str = "point_id") -> DataFrame:
    """Put removed rows back at their place ``ord``; rows whose id is there again stay out.

    Rows that come back take their place before those that stand there now; ``ord`` is counted anew from 0 in each series.
    """
    w = Window.partitionBy("series_id")
    fresh = back.join(rows.select(key), key, "left_anti")
    # the nth row to come back goes to its place among all rows: as many rows stand before it as its place says
    nth = F.row_number().over(w.orderBy("ord", key)) - 1
    came = fresh.withColumn("_at", F.col("ord") - nth).withColumn("_old", F.lit(0))
    both = rows.withColumn("_at", F.col("ord")).withColumn("_old", F.lit(1)).unionByName(came.select(*rows.columns, "_at", "_old"))
    place = F.row_number().over(w.orderBy("_at", "_old", "ord", key)) - 1
    return both.withColumn("_n", place).withColumn("ord", F.col("_n").cast(rows.schema["ord"].dataType)).select(rows.columns)


#: Fixed value: a label moves at most this many voxels from its line.
LABEL_REACH = 1e4


def with_label_offset(measurements: DataFrame, edits: DataFrame, reach: float = LABEL_REACH) -> DataFrame:
    """Label offsets in voxels, to three decimals, from ``edits(id, i, j, k)``; three nulls take an offset away, out of reach is refused.

    ``measurements`` has ``offset struct<i double, j double, k double>``.
    """
    axes = [F.col(c).cast("double") for c in "ijk"]
    none, ok = F.lit(True), F.lit(True)
    for c in axes:
        none, ok = none & c.isNull(), ok & F.coalesce(F.abs(c) <= reach, F.lit(False))
    offset = F.struct(*((F.floor(c * 1000 + 0.5) / 1000).alias(n) for c, n in zip(axes, "ijk", strict=True)))
    new = edits.where(none | ok).select("id", F.when(ok, offset).alias("_offset"), F.lit(True).alias("_set"))
    met = measurements.join(new, "id", "left")
    return met.withColumn("offset", F.when(F.col("_set"), F.col("_offset")).otherwise(F.col("offset"))).select(measurements.columns)


def decision(same: Column, only_spacing: Column, old_spacing: Column, confirmed: Column) -> Column:
    """What to do with a saved project: apply it if all fits; if just the slice spacing differs and is the one that was once computed, ask; else reject."""
    no = F.lit(False)
    asked = F.when(F.coalesce(confirmed, no), "apply").otherwise("cancel")
    return F.when(F.coalesce(same, no), "apply").when(F.coalesce(only_spacing & old_spacing, no), asked).otherwise("reject")


def changes(saved: DataFrame, now: DataFrame, key: str = "id", signature: str = "signature") -> DataFrame:
    """``added``, ``removed`` and ``changed`` rows against a saved state."""
    s, n = saved.select(F.col(key).alias("sk"), F.col(signature).alias("ss")), now.select(F.col(key).alias("nk"), F.col(signature).alias("ns"))
    what = F.when(F.col("sk").isNull(), "added").when(F.col("nk").isNull(), "removed").when(~F.col("ss").eqNullSafe(F.col("ns")), "changed")
    return s.join(n, F.col("sk") == F.col("nk"), "full").select(F.coalesce("nk", "sk").alias(key), what.alias("change")).where("change is not null")


def markers(points: DataFrame, planes: DataFrame, reach: int = 3) -> DataFrame:
    """Points on each plane ``planes(plane_id, series_id, k)`` or within some slices of it: a band join made equi by exploding the band."""
    band = planes.withColumn("pk", F.explode(F.sequence(F.col("k") - reach, F.col("k") + reach))).withColumnRenamed("k", "plane_k")
    hit = points.join(band, (points["series_id"] == band["series_id"]) & (points["k"] == band["pk"]))
    return hit.select("plane_id", "point_id", (F.col("pk") == F.col("plane_k")).alias("exact"), F.abs(F.col("pk") - F.col("plane_k")).alias("away"))


def alike(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Equal up to a relative tolerance; null matches nothing."""
    return F.coalesce(F.abs(a - b) <= tolerance * F.greatest(F.lit(1.0), F.abs(a)), F.lit(False))


def match_series(saved: DataFrame, here: DataFrame, exact: list[str], close: list[str]) -> DataFrame:
    """Pairs of saved and present series with equal and nearly equal fingerprints."""
    s, h = saved.alias("s"), here.alias("h")
    on = [F.col(f"s.{c}") == F.col(f"h.{c}") for c in exact] + [alike(F.col(f"s.{c}"), F.col(f"h.{c}")) for c in close]
    return s.join(h, on).select(F.col("s.series_id").alias("saved_id"), F.col("h.series_id").alias("series_id"))
