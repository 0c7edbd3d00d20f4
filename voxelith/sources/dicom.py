"""Reading DICOM slice files: headers to rows, pixels to planes.

Files are scanned with Spark's ``binaryFile`` source; a NumPy/struct parser runs
where the bytes lie.  A bad file becomes a row with ``error`` instead of failing the
job.  Native (uncompressed) syntaxes and RLE are decoded; other compressed syntaxes
raise ``UnsupportedTransferSyntax`` because their codecs are not available here.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.slabs import PLANES

EXPLICIT_LE, IMPLICIT_LE, EXPLICIT_BE, RLE = "1.2.840.10008.1.2.1", "1.2.840.10008.1.2", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.5"
NATIVE = (IMPLICIT_LE, EXPLICIT_LE, EXPLICIT_BE)
#: Transfer syntaxes with encapsulated pixel data.
COMPRESSED = (
    RLE, "1.2.840.10008.1.2.4.50", "1.2.840.10008.1.2.4.51", "1.2.840.10008.1.2.4.57", "1.2.840.10008.1.2.4.70", "1.2.840.10008.1.2.4.80",
    "1.2.840.10008.1.2.4.81", "1.2.840.10008.1.2.4.90", "1.2.840.10008.1.2.4.91", "1.2.840.10008.1.2.4.201", "1.2.840.10008.1.2.4.202", "1.2.840.10008.1.2.4.203",
)
_LONG = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UC", b"UR", b"UT", b"UN"}
PIXELS = (0x7FE0, 0x0010)

HEADER = (
    "study_uid string, series_uid string, description string, modality string, rows int, columns int, bits int, bits_stored int, high_bit int, signed int, samples int, "
    "photometric string, planar_config int, frames int, pixel_spacing array<double>, thickness double, spacing_between double, instance double, pos array<double>, orientation array<double>, "
    "slope double, intercept double, window_center double, window_width double, smallest int, largest int, pixel_offset long, pixel_length long, transfer_syntax string, path string, read_idx int, error string"
)


class UnsupportedTransferSyntax(ValueError):
    pass


def elements(data: bytes) -> Iterator[tuple[tuple[int, int], bytes, int, int, bool]]:
    """``(tag, vr, offset, length, big-endian)`` of the top-level elements up to the pixels."""
    if data[128:132] != b"DICM":
        raise ValueError("no DICM mark")
    at, syntax, meta = 132, EXPLICIT_LE, True
    while at + 8 <= len(data):
        order = "<"
        group = struct.unpack_from("<H", data, at)[0]
        if meta and group != 2:
            meta = False
        if not meta and syntax == EXPLICIT_BE:
            order = ">"
        group, element = struct.unpack_from(order + "HH", data, at)
        if not meta and syntax == IMPLICIT_LE:
            vr, length, body = b"", struct.unpack_from("<I", data, at + 4)[0], at + 8
        else:
            vr = data[at + 4 : at + 6]
            if vr in _LONG:
                length, body = struct.unpack_from(order + "I", data, at + 8)[0], at + 12
            else:
                length, body = struct.unpack_from(order + "H", data, at + 6)[0], at + 8
        yield (group, element), vr, body, length, order == ">"
        if (group, element) == (2, 0x10):
            syntax = data[body : body + length].rstrip(b"\0 ").decode()
        if (group, element) == PIXELS:
            return
        if length == 0xFFFFFFFF:  # a sequence of undefined length: up to its delimiter
            end = data.find(struct.pack(order + "HHI", 0xFFFE, 0xE0DD, 0), body)
            if end < 0:
                raise ValueError("sequence without end")
            at = end + 8
        else:
            at = body + length


def _numbers(text: str, n: int) -> list[float] | None:
    try:
        out = [float(x) for x in text.split("\\")]
    except ValueError:
        return None
    return out if len(out) >= n and all(np.isfinite(out)) else None


def header(data: bytes, path: str = "", read_idx: int = 0) -> dict | None:
    """One row of ``HEADER``; None without a series UID."""
    got: dict[tuple[int, int], tuple[bytes, bytes, bool]] = {}
    pixels = (None, None)
    for tag, vr, at, length, big in elements(data):
        if tag == PIXELS:
            pixels = (at, len(data) - at if length == 0xFFFFFFFF else length)
        elif length <= 4096:
            got[tag] = (vr, data[at : at + length], big)
    text = lambda g, e: got[g, e][1].decode("latin-1").strip("\0 ") or None if (g, e) in got else None
    number = lambda g, e: (_numbers(text(g, e) or "", 1) or [None])[0]
    many = lambda g, e, n: (_numbers(text(g, e) or "", n) or [None] * n)[:n] if _numbers(text(g, e) or "", n) else None

    def short(g, e, default=None):
        if (g, e) not in got or len(got[g, e][1]) < 2:
            return default
        return struct.unpack_from(">H" if got[g, e][2] else "<H", got[g, e][1])[0]

    uid = text(0x20, 0x0E)
    if not uid:
        return None
    slope, intercept = number(0x28, 0x1053), number(0x28, 0x1052)
    bits = short(0x28, 0x100, 16)
    return {
        "study_uid": text(0x20, 0x0D), "series_uid": uid, "description": text(0x08, 0x103E), "modality": text(0x08, 0x60), "rows": short(0x28, 0x10), "columns": short(0x28, 0x11),
        "bits": bits, "bits_stored": short(0x28, 0x101, bits), "high_bit": short(0x28, 0x102, short(0x28, 0x101, bits) - 1), "signed": short(0x28, 0x103, 0), "samples": short(0x28, 0x02, 1), "photometric": text(0x28, 0x04),
        "planar_config": short(0x28, 0x06, 0), "frames": int(number(0x28, 0x08) or 1), "pixel_spacing": many(0x28, 0x30, 2), "thickness": number(0x18, 0x50), "spacing_between": number(0x18, 0x88),
        "instance": number(0x20, 0x13), "pos": many(0x20, 0x32, 3), "orientation": many(0x20, 0x37, 6), "slope": 1.0 if slope is None else slope, "intercept": 0.0 if intercept is None else intercept,
        "window_center": number(0x28, 0x1050), "window_width": number(0x28, 0x1051), "smallest": short(0x28, 0x106), "largest": short(0x28, 0x107),
        "pixel_offset": pixels[0], "pixel_length": pixels[1], "transfer_syntax": text(0x02, 0x10) or EXPLICIT_LE, "path": path, "read_idx": read_idx, "error": None,
    }


def fragments(data: bytes, at: int) -> list[bytes]:
    """Fragments of encapsulated pixels after the offset table."""
    out = []
    while at + 8 <= len(data):
        group, element, length = struct.unpack_from("<HHI", data, at)
        if (group, element) != (0xFFFE, 0xE000):
            break
        out.append(data[at + 8 : at + 8 + length])
        at += 8 + length
    return out[1:]


def unpack_bits(data: bytes, size: int) -> bytes:
    """PackBits run-length decoding."""
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def decode(data: bytes, meta: dict, frame: int = 0, rows: tuple[int, int] | None = None) -> np.ndarray:
    """Calibrated float32 plane of one frame, or just its rows from the first up to before the last of ``rows``.

    Of native pixels only the bytes of those rows are touched; run-length segments are decoded up to their end.
    """
    h, w, bits, syntax = meta["rows"], meta["columns"], meta["bits"], meta["transfer_syntax"]
    if bits not in (8, 16) or (meta["samples"] or 1) != 1:
        raise UnsupportedTransferSyntax("only 8 or 16 bits and one sample a pixel")
    size = h * w * bits // 8
    first, last = (0, h) if rows is None else (max(0, rows[0]), min(h, rows[1]))
    if meta["pixel_offset"] is None or first >= last:
        raise ValueError("no pixels" if meta["pixel_offset"] is None else "no such rows")
    if syntax in NATIVE:
        at = meta["pixel_offset"] + frame * size
        raw = data[at + first * w * bits // 8 : at + last * w * bits // 8]
        if len(raw) < (last - first) * w * bits // 8:
            raise ValueError("pixels are cut short")
    elif syntax == RLE:
        part = fragments(data, meta["pixel_offset"])[frame]
        n, *offsets = struct.unpack_from("<16I", part)
        ends = [*offsets[1:n], len(part)]
        segments = [unpack_bits(part[a:b], last * w)[first * w :] for a, b in zip(offsets[:n], ends, strict=False)]
        if any(len(s) < (last - first) * w for s in segments):
            raise ValueError("pixels are cut short")
        raw = np.stack([np.frombuffer(s, np.uint8) for s in reversed(segments)], 1).tobytes()  # most significant first
    else:
        raise UnsupportedTransferSyntax(syntax)
    kind = ("i" if meta["signed"] else "u") + str(bits // 8)
    v = np.frombuffer(raw, (">" if syntax == EXPLICIT_BE else "<") + kind)
    return (v.astype(float) * meta["slope"] + meta["intercept"]).astype(np.float32).reshape(last - first, w)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file below ``path``; files that are no slices have ``error``.  Pixels are not kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.strip().split(" ")[0] for c in HEADER.split(", ")]
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    row = header(bytes(content), p)
                    rows.append(row or {"path": p, "error": "no series UID"})
                except (ValueError, struct.error, IndexError) as e:
                    rows.append({"path": p, "error": str(e)})
            yield pd.DataFrame([{n: r.get(n) for n in names} for r in rows], columns=names).astype(object).where(lambda x: x.notna(), None)

    return files.select("path", "content").mapInPandas(run, HEADER).withColumn("read_idx", F.row_number().over(Window.partitionBy("series_uid").orderBy("path")) - 1)


def expand_frames(slices: DataFrame) -> DataFrame:
    """Compressed multi-frame files become a row for each frame, with a made-up position along z."""
    n = F.when(F.col("transfer_syntax").isin(*COMPRESSED), F.greatest(F.coalesce("frames", F.lit(1)), F.lit(1))).otherwise(1)
    s = slices.withColumn("frame", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("synthetic", n > 1)
    dz = F.when(F.col("spacing_between") > 0, F.col("spacing_between")).when(F.col("thickness") > 0, F.col("thickness")).otherwise(1.0)
    moved = F.array(F.col("pos")[0], F.col("pos")[1], F.col("pos")[2] + F.col("frame") * dz)
    return s.withColumn("pos", F.when(F.col("synthetic") & F.col("pos").isNotNull(), moved).otherwise(F.col("pos"))).withColumn("instance", F.when(F.col("synthetic"), F.coalesce("instance", F.lit(0.0)) + F.col("frame")).otherwise(F.col("instance")))


def read_planes(spark: SparkSession, path: str, numbered: DataFrame, rows: tuple[int, int] | None = None, errors: bool = False) -> DataFrame:
    """Decoded planes (or rows of them); ``numbered(path, series_id, k[, frame])`` says which slice a file is.

    A file that cannot be decoded fails the job, or, with ``errors``, becomes a row without pixels whose ``error`` says why.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    frame = "frame" if "frame" in numbered.columns else F.lit(0).alias("frame")
    met = files.join(numbered.select("path", "series_id", "k", frame), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content, s, k, f in zip(pdf["content"], pdf["series_id"], pdf["k"], pdf["frame"], strict=True):
                row, why = {"series_id": [np.int32(s)], "k": [np.int32(k)]}, None
                try:
                    meta = header(bytes(content))
                    if meta is None:
                        raise ValueError("no series UID")
                    a = decode(bytes(content), meta, int(f), rows)
                    row |= {"w": [np.int32(a.shape[1])], "h": [np.int32(a.shape[0])], "data": [a.tobytes()]}
                except (ValueError, struct.error, IndexError) as e:
                    if not errors:
                        raise
                    why = str(e) or type(e).__name__
                    row |= {"w": [np.int32(0)], "h": [np.int32(0)], "data": [None]}
                yield pd.DataFrame(row | {"error": [why]} if errors else row)

    return met.select("content", "series_id", "k", "frame").mapInPandas(run, PLANES + ", error string" if errors else PLANES)


def write(meta: dict, pixels: np.ndarray) -> bytes:
    """A minimal explicit little-endian slice file, for tests and synthetic series."""

    def element(g: int, e: int, vr: bytes, body: bytes) -> bytes:
        body += (b"\0" if vr in (b"UI", b"OW") else b" ") * (len(body) % 2)
        if vr in _LONG:
            return struct.pack("<HH2sHI", g, e, vr, 0, len(body)) + body
        return struct.pack("<HH2sH", g, e, vr, len(body)) + body

    text = lambda v: "\\".join(format(x, "g") for x in v).encode() if isinstance(v, (list, tuple)) else str(v).encode()
    h, w = pixels.shape
    signed = int(pixels.dtype.kind == "i")
    tags = [
        (0x08, 0x60, b"CS", text(meta.get("modality", "CT"))), (0x18, 0x50, b"DS", text(meta.get("thickness", 0.1))), (0x20, 0x0D, b"UI", text(meta.get("study_uid", "1.2.3"))), (0x20, 0x0E, b"UI", text(meta.get("series_uid", "1.2.3.4"))),
        (0x20, 0x13, b"IS", text(meta.get("instance", 1))), (0x20, 0x32, b"DS", text(meta.get("pos", [0, 0, 0]))), *([(0x20, 0x37, b"DS", text(meta["orientation"]))] if meta.get("orientation") else []),
        (0x28, 0x02, b"US", struct.pack("<H", 1)), (0x28, 0x04, b"CS", b"MONOCHROME2"), (0x28, 0x10, b"US", struct.pack("<H", h)), (0x28, 0x11, b"US", struct.pack("<H", w)), (0x28, 0x30, b"DS", text(meta.get("pixel_spacing", [0.1, 0.1]))),
        (0x28, 0x100, b"US", struct.pack("<H", 8 * pixels.itemsize)), (0x28, 0x101, b"US", struct.pack("<H", meta.get("bits_stored", 12))), (0x28, 0x103, b"US", struct.pack("<H", signed)),
        (0x28, 0x1050, b"DS", text(meta.get("window_center", 40))), (0x28, 0x1051, b"DS", text(meta.get("window_width", 400))), (0x28, 0x1052, b"DS", text(meta.get("intercept", -1024))), (0x28, 0x1053, b"DS", text(meta.get("slope", 1))),
    ]
    head = element(0x02, 0x10, b"UI", EXPLICIT_LE.encode())
    return b"\0" * 128 + b"DICM" + head + b"".join(element(*t) for t in tags) + element(*PIXELS, b"OW", pixels.astype(pixels.dtype.newbyteorder("<")).tobytes())
