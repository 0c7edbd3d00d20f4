"""Slice files, archives, caches, notes, series quality and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import notes as N
from voxelith.operators import series as Se
from voxelith.sources import dicom, project
from voxelith.sources.cache import ResultCache, key
from voxelith.streaming import slices as stream


def folder(path, n=12, size=16, uid="1.2.3.4", step=0.2):
    path.mkdir(parents=True)
    for k in range(n):
        j, i = np.indices((size, size))
        raw = (((size * j + i + k) % 7) * 200).astype(np.int16)
        meta = {"series_uid": uid, "instance": k + 1, "pos": [0, 0, round(k * step, 6)], "orientation": [1, 0, 0, 0, 1, 0]}
        (path / f"{k:03}.dcm").write_bytes(dicom.write(meta, raw))


def test_folder_of_slices(spark, tmp_path):
    folder(tmp_path / "a")
    folder(tmp_path / "b", 6, 8, "1.2.9.5", 0.5)
    (tmp_path / "a" / "notes.txt").write_text("no slice")
    h = dicom.read_headers(spark, str(tmp_path)).persist()
    assert h.where("error is not null").count() == 1
    good = h.where("error is null")
    assert {(r["series_uid"], r["count"]) for r in good.groupBy("series_uid").count().collect()} == {("1.2.3.4", 12), ("1.2.9.5", 6)}
    s = Se.with_position(good.withColumnRenamed("series_uid", "series_id")).persist()
    assert {tuple(r["normal"]) for r in s.collect()} == {(0, 0, 1)} and not any(r["mixed"] for r in s.collect())
    ordered = s.selectExpr("series_id", "position", "instance", "read_idx", "path", "row_number() over (partition by series_id order by position) - 1 as ord")
    sp = {r["series_id"]: r for r in Se.spacing(Se.gaps(ordered)).collect()}
    assert sp["1.2.3.4"]["spacing"] == pytest.approx(0.2) and sp["1.2.3.4"]["basis"] == "span" and not sp["1.2.3.4"]["uneven"]
    planes = dicom.read_planes(spark, str(tmp_path), ordered.where("series_id = '1.2.3.4'").selectExpr("path", "1 as series_id", "ord as k")).collect()
    assert len(planes) == 12
    p = next(r for r in planes if r["k"] == 3)
    a = np.frombuffer(p["data"], np.float32).reshape(16, 16)
    assert a[2, 5] == ((16 * 2 + 5 + 3) % 7) * 200 - 1024
    r = Se.value_range(good, "series_uid").collect()
    assert all(x["fits_int16"] for x in r) and {(x["min_hu"], x["max_hu"]) for x in r} == {(-3072.0, 1023.0)}


def test_decoding(spark):
    v = (np.arange(15).reshape(3, 5) * 4099 % 65536).astype(np.uint16)
    for kind in (np.uint16, np.int16):
        data = dicom.write({"slope": 0.5, "intercept": -1024}, v.astype(kind))
        assert np.allclose(dicom.decode(data, dicom.header(data)), v.astype(kind).astype(float) * 0.5 - 1024)
    with pytest.raises(ValueError):
        dicom.header(b"x" * 200)
    meta = dicom.header(data) | {"transfer_syntax": "1.2.840.10008.1.2.4.90"}
    with pytest.raises(dicom.UnsupportedTransferSyntax):
        dicom.decode(data, meta)

    def pack(b):
        return b"".join(bytes([0]) + bytes([x]) for x in b)

    high, low = pack((v >> 8).astype(np.uint8).tobytes()), pack((v & 255).astype(np.uint8).tobytes())
    frame = struct.pack("<16I", 2, 64, 64 + len(high), *[0] * 13) + high + low
    body = struct.pack("<HHI", 0xFFFE, 0xE000, 0) + struct.pack("<HHI", 0xFFFE, 0xE000, len(frame)) + frame
    meta = {"rows": 3, "columns": 5, "bits": 16, "samples": 1, "signed": 0, "slope": 1.0, "intercept": 0.0, "pixel_offset": 0, "transfer_syntax": dicom.RLE}
    assert (dicom.decode(body, meta) == v).all()
    assert dicom.unpack_bits(bytes([254, 7, 128, 1, 1, 2]), 5) == bytes([7, 7, 7, 1, 2])
    frames = spark.createDataFrame([("s", 3, dicom.RLE, None, 2.0, 5.0, [0.0, 0.0, 1.0]), ("t", 3, dicom.EXPLICIT_LE, None, 2.0, 5.0, [0.0, 0.0, 1.0])], "series_uid string, frames int, transfer_syntax string, spacing_between double, thickness double, instance double, pos array<double>")
    got = dicom.expand_frames(frames).where("series_uid = 's'").orderBy("frame").collect()
    assert [r["pos"][2] for r in got] == [1, 3, 5] and [r["instance"] for r in got] == [5, 6, 7]
    assert dicom.expand_frames(frames).count() == 4


def gap_case(spark, positions, instances=None):
    positions = [None if p is None else float(p) for p in positions]
    rows = [(1, n, p, float((instances or range(len(positions)))[n]), n) for n, p in enumerate(positions)]
    return Se.gaps(spark.createDataFrame(rows, "series_id int, ord int, position double, instance double, read_idx int"))


@pytest.mark.parametrize("positions,missing,duplicates,basis,spacing", [([0, 0.5, 1, 2, 2.5, 3], 1, 0, "fit", 0.5), ([0, 0.5, 0.5, 1, 1.5], 0, 1, "span", 0.375), ([0, 1, 2, 5, 6], 2, 0, "fit", 1.0), ([0, 1, 2], 0, 0, "span", 1.0), ([3, 3, 3], 0, 2, "tag", None), ([1], 0, 0, "tag", None), ([None, None], 0, 0, "none", None), ([1, 3, None], 0, 0, "first-gap", 2.0), ([1, None, 2], 0, 0, "tag", None)])
def test_gaps(spark, positions, missing, duplicates, basis, spacing):
    r = Se.spacing(gap_case(spark, positions)).first()
    assert (r["missing"], r["duplicates"], r["basis"]) == (missing, duplicates, basis)
    assert r["spacing"] == (pytest.approx(spacing) if spacing else None)


def test_duplicate_slices(spark):
    kept = Se.drop_duplicates(gap_case(spark, [0, 0.5, 0.5, 1, 1.5], [0, 9, 4, 2, 3]))
    assert sorted(r["ord"] for r in kept.collect()) == [0, 2, 3, 4]
    assert Se.drop_duplicates(gap_case(spark, [3, 3, 3])).count() == 3


def test_archives():
    runs = [(0, 0, 1, 3), (0, 2, 0, 7), (2, 5, 4, 4)]
    data = project.encode_runs(runs, 3)
    assert project.decode_runs(data, 8, 6, 3) == runs
    for bad, w in ((b"XXXX" + data[4:], 8), (data[:-4], 8), (data[:8], 8), (data, 7)):
        with pytest.raises(project.ProjectError):
            project.decode_runs(bad, w, 6, 3)
    packed = project.pack({"name": "x"}, {"edits/a.bin": data})
    assert project.unpack(packed)[1] == {"edits/a.bin": data}
    for bad in (b"nozip", project.pack({"format": "other"}, {}), project.pack({"version": 99}, {})):
        with pytest.raises(project.ProjectError):
            project.unpack(bad)
    with pytest.raises(project.ProjectError):
        project.from_entries({"a": b""})
    assert project.from_entries({"dir/project.json": b'{"format": "voxelith-project"}', "dir/x": b"1"})[1] == {"x": b"1"}
    assert project.file_name("__ä b/c-d__") == "b_c-d"


def test_result_cache(spark, tmp_path):
    c = ResultCache(spark, str(tmp_path / "cache"))
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("n")
    for _ in range(2):
        assert c.get("d", {"a": 1}, make).count() == 3
    assert len(made) == 1 and c.lookup("d", {"a": 2}) is None
    c.get("d", {"a": 2}, make)
    assert c.prune_others("d", {"a": 2}) == 1 and c.lookup("d", {"a": 2}) is not None
    assert c.prune("d", 0) == 1 and key({"a": 1, "b": 2}) == key({"b": 2, "a": 1})
    c.clear()


def test_notes(spark):
    points = spark.createDataFrame([(1, f"p{n}", n, 2 * n, 3 * n) for n in range(4)] + [(2, "q", 0, 0, 0)], "series_id int, point_id string, i int, j int, k int")
    m = spark.createDataFrame([("m1", "p1", "p2"), ("m2", "p2", "p1"), ("m3", "p0", "gone"), ("m4", "p0", "q")], "id string, a string, b string")
    got = {r["id"]: r["mm"] for r in N.measured(m, points, (0.1, 0.2, 0.5)).collect()}
    assert got == {"m1": pytest.approx((0.01 + 0.16 + 2.25) ** 0.5), "m2": got["m1"]}
    assert [r["id"] for r in N.one_per_pair(m).orderBy("id").collect()] == ["m1", "m3", "m4"]
    old = m.where("id = 'm1'")
    assert sorted(r["id"] for r in N.add_measurements(old, m, points).collect()) == ["m1", "m4"]
    a = spark.createDataFrame([("a", 1), ("b", 2), ("a_", 3)], "point_id string, v int")
    b = spark.createDataFrame([("a", 9), ("b", 2), ("c", 4)], "point_id string, v int")
    merged, names = N.merge_points(a, b)
    assert {tuple(r) for r in merged.collect()} == {("a", 1), ("b", 2), ("a_", 3), ("a__", 9), ("c", 4)}
    assert [tuple(r) for r in names.collect()] == [("a", "a__")]
    t = spark.createDataFrame([("  x ",), ("   ",), ("y" * 3000,)], "t string")
    assert [len(r[0]) if r[0] else None for r in t.select(N.usable_text(F.col("t"))).collect()] == [1, None, 2000]
    ids = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "id string, n int")
    assert {r["id"] for r in N.unique_ids(ids, "n").collect()} == {"a", "a_", "b"}
    assert N.next_number(ids, "n").first()[0] == 4 and N.next_number(ids.limit(0), "n").first()[0] == 1
    s = spark.createDataFrame([(1, "u", 0.5), (2, "u", 0.6)], "series_id int, uid string, sx double")
    assert [tuple(r) for r in N.match_series(s, s.withColumn("sx", F.col("sx") + 1e-6), ["uid"], ["sx"]).orderBy("saved_id").collect()] == [(1, 1), (2, 2)]


def test_stream_of_slices(spark, tmp_path):
    rows = [(1, n, n * 0.5, f"2024-01-01 00:0{n}:00") for n in range(5)] + [(1, 2, 1.0, "2024-01-01 00:02:00"), (2, 0, 9.0, "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "series_id int, instance int, position double, t string").selectExpr("series_id", "instance", "position", "cast(t as timestamp) ts").write.parquet(str(tmp_path / "in"))
    out = stream.progress(stream.source(spark, str(tmp_path / "in")))
    stream.run_available(out, "slices_seen", str(tmp_path / "cp"), "update")
    got = {(r["series_id"], r["slices"], r["low"], r["high"]) for r in spark.table("slices_seen").collect()}
    assert (1, 5, 0.0, 2.0) in got


def test_rows_come_back_to_their_place(spark):
    rows = spark.createDataFrame([(1, "a", 0), (1, "c", 1), (1, "e", 2)], "series_id int, point_id string, ord int")
    back = spark.createDataFrame([(1, "b", 1), (1, "d", 3), (1, "c", 0)], "series_id int, point_id string, ord int")
    assert [r["point_id"] for r in N.restored(rows, back).orderBy("ord").collect()] == ["a", "b", "c", "d", "e"]
    p = spark.createDataFrame([("apply", True, None, None, None), ("apply", False, True, True, True), ("cancel", False, True, True, None), ("reject", None, True, False, True), ("reject", False, None, True, True)], "want string, s boolean, o boolean, l boolean, c boolean")
    assert all(r[0] == r[1] for r in p.select("want", N.decision(F.col("s"), F.col("o"), F.col("l"), F.col("c"))).collect())


def test_series_are_grouped(spark, tmp_path):
    folder(tmp_path / "a")
    folder(tmp_path / "b", 6, 8, "1.2.9.5", 0.5)
    again = tmp_path / "b" / "again.dcm"
    again.write_bytes((tmp_path / "b" / "003.dcm").read_bytes())
    kept, series = Se.group(dicom.read_headers(spark, str(tmp_path)))
    rows = series.collect()
    assert [(r["series_id"], r["slices"], r["rows"], r["window_width"], r["spacing_y"]) for r in rows] == [("1.2.3::1.2.3.4", 12, 16, 400, 0.1), ("1.2.3::1.2.9.5", 6, 8, 400, 0.1)]
    assert [r["spacing_z"] for r in rows] == [pytest.approx(0.2), pytest.approx(0.5)]
    assert sorted(r["ord"] for r in kept.where("series_id = '1.2.3::1.2.9.5'").collect()) == list(range(6))
    assert Se.group(dicom.read_headers(spark, str(tmp_path)).where("false"))[1].collect() == []


def test_bad_slices_and_rows_of_slices(spark, tmp_path):
    folder(tmp_path / "a", 3)
    whole = (tmp_path / "a" / "001.dcm").read_bytes()
    (tmp_path / "a" / "001.dcm").write_bytes(whole[:-10])
    (tmp_path / "a" / "bad.dcm").write_bytes(b"nothing")
    numbered = spark.read.format("binaryFile").load(str(tmp_path / "a")).selectExpr("path", "1 as series_id", "cast(row_number() over (order by path) - 1 as int) as k")
    rows = {r["k"]: r for r in dicom.read_planes(spark, str(tmp_path), numbered, errors=True).collect()}
    assert {k: r["error"] for k, r in rows.items()} == {0: None, 1: "pixels are cut short", 2: None, 3: "no DICM mark"}
    assert rows[1]["data"] is None and len(rows[2]["data"]) == 16 * 16 * 4
    with pytest.raises(Exception, match="cut short"):
        dicom.read_planes(spark, str(tmp_path), numbered.where("k < 3")).collect()
    some = dicom.read_planes(spark, str(tmp_path), numbered.where("k < 3"), rows=(2, 5)).collect()
    assert len(some) == 3 and all((r["h"], r["w"]) == (3, 16) for r in some)
    meta = dicom.header(whole)
    assert (dicom.decode(whole, meta)[2:5] == dicom.decode(whole, meta, rows=(2, 5))).all()
    with pytest.raises(ValueError):
        dicom.decode(whole, meta, rows=(16, 20))
