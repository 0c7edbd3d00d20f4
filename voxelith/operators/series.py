"""Series assembly and slice-gap quality, for any number of series at once.

``slices`` has a row for each slice: series key, position vector, orientation,
instance number, read index and tags.  All steps are windows over a series; a
series has as many rows as a scan has slices, so no window is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the gap analysis (mm and fractions).
DUPLICATE_MM, DUPLICATE_PART = 1e-3, 0.05
MISSING_TIMES = 1.5
UNEVEN_PART, UNEVEN_MM = 0.01, 2e-3
TAG_PART = 0.02
SAME_DIRECTION = 0.9999


def dot(a: Column, b: Column) -> Column:
    return sum((a[n] * b[n] for n in range(1, 3)), a[0] * b[0])


def normal_of(o: Column) -> Column:
    """Unit cross product of the row and column directions; null if they are missing or parallel."""
    n = [o[1] * o[5] - o[2] * o[4], o[2] * o[3] - o[0] * o[5], o[0] * o[4] - o[1] * o[3]]
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    return F.when((F.size(o) >= 6) & (size > 1e-6), F.array(*(x / size for x in n)))


def with_position(slices: DataFrame, key: str = "series_id") -> DataFrame:
    """Add ``normal`` (of the series), ``position`` along it and ``mixed`` (orientations disagree or only some are set)."""
    w = Window.partitionBy(key)
    own = slices.withColumn("_n", normal_of(F.col("orientation")))
    first = F.min_by("_n", F.when(F.col("_n").isNotNull(), F.col("read_idx"))).over(w)
    s = own.withColumn("_f", first)
    ax = [F.abs(F.col("_f")[n]) for n in range(3)]
    along = dot(F.col("pos"), F.col("_f"))
    order = F.coalesce(F.col("instance"), F.col("read_idx").cast("double"))
    cov = F.covar_pop(along, order).over(w)
    by_read = F.covar_pop(along, F.col("read_idx").cast("double")).over(w)
    n = F.count(along).over(w)
    cov = F.when(F.abs(cov * n) < 1e-12, by_read).otherwise(cov)
    flip = F.when((ax[2] >= ax[0]) & (ax[2] >= ax[1]), F.col("_f")[2] < 0).otherwise((n >= 2) & (cov < 0))
    s = s.withColumn("normal", F.when(F.coalesce(flip, F.lit(False)), F.transform("_f", lambda x: -x)).otherwise(F.col("_f")))
    odd = F.col("_f").isNotNull() & (F.col("_n").isNull() | (F.abs(dot(F.col("_n"), F.col("_f"))) < SAME_DIRECTION))
    s = s.withColumn("mixed", F.bool_or(odd).over(w))
    return s.withColumn("position", F.when(F.col("normal").isNotNull(), dot(F.col("pos"), F.col("normal"))).otherwise(F.col("pos")[2])).drop("_n", "_f")


def gaps(ordered: DataFrame, key: str = "series_id") -> DataFrame:
    """Classify the gap before each slice; ``ordered(key, ord, position)`` -> adds gap, ref, kind, missing, shift.

    Kinds: ``first``, ``duplicate``, ``missing``, ``regular``.  ``shift`` counts missing slices before a slice.
    """
    w, o = Window.partitionBy(key), Window.partitionBy(key).orderBy("ord")
    g = ordered.withColumn("gap", F.abs(F.col("position") - F.lag("position").over(o)))
    real = F.expr(f"percentile(CASE WHEN gap > {DUPLICATE_MM} THEN gap END, 0.5)").over(w)
    g = g.withColumn("ref", F.coalesce(real, F.expr("percentile(gap, 0.5)").over(w)))
    dup = F.col("gap") <= F.greatest(F.lit(DUPLICATE_MM), DUPLICATE_PART * F.col("ref"))
    lost = F.col("gap") > MISSING_TIMES * F.col("ref")
    kind = F.when(F.col("gap").isNull(), "first").when(dup, "duplicate").when(lost, "missing").otherwise("regular")
    n = F.greatest(F.lit(1), F.floor(F.col("gap") / F.col("ref") + 0.5) - 1)
    g = g.withColumn("kind", kind).withColumn("missing", F.when(F.col("kind") == "missing", n).otherwise(0).cast("int"))
    return g.withColumn("shift", F.sum("missing").over(o.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))


def spacing(classified: DataFrame, key: str = "series_id") -> DataFrame:
    """Per series: counts by kind, median gap, evenness, and the spacing with what it rests on.

    Without missing slices the spacing is the whole span over the steps, with missing ones a least-squares
    slope against the corrected index.  A series of duplicates only has none of its own (``basis`` tag), nor has
    a single slice.  Frames with made-up positions (``synthetic``, if there is such a column) are not judged (frames); without any position
    the basis is none; with some only, it is the first gap, if both first slices have a position.
    """
    c = classified.withColumn("_at", (F.col("ord") - F.min("ord").over(Window.partitionBy(key)) + F.col("shift")).cast("double"))
    of = lambda k: F.count_if(F.col("kind") == k).cast("long")
    made = F.coalesce(F.bool_or("synthetic"), F.lit(False)) if "synthetic" in classified.columns else F.lit(False)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("ord"))
    c = c.withColumn("_nth", nth)
    early = lambda n: F.max(F.when(F.col("_nth") == n, F.col("position")))
    reg = F.expr("CASE WHEN kind = 'regular' THEN gap END")
    out = c.groupBy(key).agg(
        F.count("*").alias("slices"), of("duplicate").alias("duplicates"), F.sum("missing").cast("long").alias("missing"),
        F.expr("coalesce(percentile(CASE WHEN kind = 'regular' THEN gap END, 0.5), max(ref))").alias("median_gap"),
        (F.coalesce(F.max(reg) - F.min(reg), F.lit(0.0))).alias("_range"),
        F.abs(F.regr_slope("position", "_at")).alias("_fit"),
        F.abs(F.max_by("position", "ord") - F.min_by("position", "ord")).alias("_span"),
        F.max("ref").alias("_ref"), made.alias("_made"), F.count("position").alias("_have"), F.abs(early(2) - early(1)).alias("_first"),
    )
    usable = (F.col("slices") >= 2) & (F.col("_ref") > DUPLICATE_MM)
    some = F.when(F.col("_first") > DUPLICATE_MM, "first-gap").otherwise("tag")
    basis = F.when(F.col("slices") < 2, "tag").when(F.col("_made"), "frames").when(F.col("_have") == 0, "none").when(F.col("_have") < F.col("slices"), some)
    basis = basis.when(~F.coalesce(usable, F.lit(False)), "tag").when(F.col("missing") > 0, "fit").otherwise("span")
    out = out.withColumn("basis", basis)
    used = F.when(F.col("basis") == "fit", F.col("_fit")).when(F.col("basis") == "span", F.col("_span") / (F.col("slices") - 1)).when(F.col("basis") == "first-gap", F.col("_first"))
    uneven = F.col("_range") > F.greatest(UNEVEN_PART * F.col("median_gap"), F.lit(UNEVEN_MM))
    return out.select(key, "slices", "duplicates", "missing", "median_gap", uneven.alias("uneven"), "basis", used.alias("spacing"))


def tag_mismatch(spacing_tag: Column, median_gap: Column) -> Column:
    return spacing_tag.isNotNull() & (F.abs(median_gap - spacing_tag) > TAG_PART * median_gap)


def drop_duplicates(classified: DataFrame, key: str = "series_id") -> DataFrame:
    """Of each run of slices at one position the smallest instance number stays, then the smallest read index."""
    run = F.count_if(F.col("kind") != "duplicate").over(Window.partitionBy(key).orderBy("ord"))
    c = classified.withColumn("_run", run)
    best = F.row_number().over(Window.partitionBy(key, "_run").orderBy(F.col("instance").asc_nulls_last(), "read_idx"))
    only = F.max("ref").over(Window.partitionBy(key)) <= DUPLICATE_MM  # a series of duplicates only keeps all
    return c.withColumn("_keep", (best == 1) | F.coalesce(only, F.lit(False))).where("_keep").drop("_run", "_keep")


def group(slices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slices (as ``read_headers`` gives them) to series: the kept slices with ``ord``, and a row for each series.

    Slices stand in order of their position along the normal, or else of their instance number, which also orders
    frames with made-up positions.  Of slices at one position one stays, see ``drop_duplicates``.  The spacing is the
    measured one, or else the tag's (between slices, thickness, 1).  Series with most slices come first.
    """
    s = slices if "synthetic" in slices.columns else slices.withColumn("synthetic", F.lit(False))
    s = with_position(s.withColumn("series_id", F.concat_ws("::", "study_uid", "series_uid")))
    made = F.bool_or("synthetic").over(Window.partitionBy("series_id"))
    number = F.coalesce("instance", F.lit(0.0))
    at = F.when(made, number).otherwise(F.coalesce("position", number))
    order = lambda: F.row_number().over(Window.partitionBy("series_id").orderBy(at, "read_idx")) - 1
    single = drop_duplicates(gaps(s.withColumn("ord", order()))).drop("gap", "ref", "kind", "missing", "shift")
    kept = gaps(single.withColumn("ord", order()))
    first = lambda c, ok=None: F.min_by(c, F.when(F.col(c).isNotNull() if ok is None else ok, F.col("ord"))).alias(c)
    head = lambda c: F.min_by(c, "ord")
    out = kept.groupBy("series_id").agg(
        head("description").alias("description"), head("modality").alias("modality"), F.max("rows").alias("rows"), F.max("columns").alias("columns"), F.max("bits").alias("bits"),
        first("window_center"), first("window_width", F.col("window_width") > 0), F.coalesce(head(F.col("pixel_spacing")[1]), F.lit(1.0)).alias("spacing_x"),
        F.coalesce(head(F.col("pixel_spacing")[0]), F.lit(1.0)).alias("spacing_y"), head(F.coalesce(F.when(F.col("spacing_between") > 0, F.col("spacing_between")), F.when(F.col("thickness") > 0, F.col("thickness")), F.lit(1.0))).alias("_tag"),
    )
    out = out.join(spacing(kept), "series_id").join(value_range(kept, "series_id"), "series_id")
    size = F.col("rows").cast("long") * F.col("columns") * F.col("slices") * F.when(F.col("fits_int16"), 2).otherwise(4)
    out = out.withColumn("spacing_z", F.coalesce("spacing", "_tag")).withColumn("decoded_bytes", size).drop("_tag", "spacing")
    return kept, out.orderBy(F.desc("slices"), "series_id")


def value_range(slices: DataFrame, *by: str) -> DataFrame:
    """Least and largest value from the tags through slope and intercept, or from the stored bits."""
    signed = F.col("signed") == 1
    bits = F.coalesce("bits_stored", "bits")
    half = F.pow(F.lit(2.0), bits - 1)
    wrap = lambda c: F.when(signed & (F.col(c) >= half), F.col(c) - 2 * half).otherwise(F.col(c).cast("double"))
    tags = F.col("smallest").isNotNull() & F.col("largest").isNotNull()
    low = F.when(tags, wrap("smallest")).otherwise(F.when(signed, -half).otherwise(0.0))
    high = F.when(tags, wrap("largest")).otherwise(F.when(signed, half - 1).otherwise(2 * half - 1))
    a, b = low * F.col("slope") + F.col("intercept"), high * F.col("slope") + F.col("intercept")
    whole = (F.floor("slope") == F.col("slope")) & (F.floor("intercept") == F.col("intercept"))
    fits = whole & (F.least(a, b) >= -32768) & (F.greatest(a, b) <= 32767)
    return slices.groupBy(*by).agg(F.min(F.least(a, b)).alias("min_hu"), F.max(F.greatest(a, b)).alias("max_hu"), F.bool_and(fits).alias("fits_int16"))
