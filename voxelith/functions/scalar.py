"""Scalar expressions over voxels, coordinates and notes.

Rounding is half up (``floor(x + 0.5)``) throughout, also below zero, and
comparisons never hold for NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIST_MIN, HIST_MAX = -1024, 3071
HIST_BINS = HIST_MAX - HIST_MIN + 1


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def at_least(x: Column, low) -> Column:
    """``x >= low``, false for NaN (which sorts above all numbers in Spark)."""
    return (x >= low) & ~F.isnan(x.cast("double"))


def inside(x: Column, low, high) -> Column:
    """Inclusive range test, false for NaN."""
    return at_least(x, low) & (x <= high)


def calibrate(raw: Column, slope=1.0, intercept=0.0) -> Column:
    return raw * F.lit(slope) + F.lit(intercept)


def window_grey(hu: Column, center: float, width: float) -> Column:
    """Window/level: 0..255."""
    return clamp(round_half_up((hu - (center - width / 2)) * 255 / max(width, 1)), 0, 255).cast("int")


def hu_to_bin(hu: Column) -> Column:
    return clamp(round_half_up(hu) - HIST_MIN, 0, HIST_BINS - 1).cast("int")


def bin_to_hu(b: Column) -> Column:
    return b + HIST_MIN


def rebin(hu: Column, low: int, high: int, columns: int) -> Column:
    return F.floor((hu - low) * columns / (high - low + 1)).cast("int")


def segment_bits(hu: Column, ranges) -> Column:
    """Bit s is set where range s contains the value."""
    out = F.lit(0)
    for s, (low, high) in enumerate(ranges):
        out = out + F.when(inside(hu, low, high), 1 << s).otherwise(0)
    return out.cast("int")


def class_byte(hu: Column, low: float, high: float) -> Column:
    """Signed closeness to the class border as a byte: 128 and above is inside."""
    return clamp(round_half_up((0.5 + F.least(hu - low, F.lit(float(high)) - hu) / 2048) * 255), 0, 255).cast("int")


def edited_class_byte(byte: Column, mask: Column) -> Column:
    """A mask overrides the range: 0 outside, at least 191 inside; null keeps the byte."""
    return F.when(mask.isNull(), byte).when(mask, F.greatest(byte, F.lit(191))).otherwise(0).cast("int")


def encode_u16(hu: Column, slope: float, intercept: float, bias: int) -> Column:
    return clamp(round_half_up((hu - intercept) / slope) + bias, 0, 65535).cast("int")


def stored_value(word: Column, bits_stored: int, high_bit: int, signed: bool) -> Column:
    """The bit window of a 16-bit word, sign-extended."""
    v = F.shiftrightunsigned(word.bitwiseAND(F.lit(0xFFFF)), high_bit - bits_stored + 1).bitwiseAND(F.lit((1 << bits_stored) - 1))
    return (F.when(v >= 1 << (bits_stored - 1), v - (1 << bits_stored)).otherwise(v) if signed else v).cast("int")


def blend(base: Column, layers: Column) -> Column:
    """Paint ``array<struct<on, value, alpha>>`` over a grey value in order, rounding at each step."""
    return F.aggregate(layers, base.cast("double"), lambda acc, s: F.when(s["on"], F.floor(acc * (1 - s["alpha"]) + s["value"] * s["alpha"] + 0.5).cast("double")).otherwise(acc)).cast("int")


def segment_alpha(opacity: Column, k: float = 0.65) -> Column:
    return F.least(F.lit(max(0.75, k)), opacity * k)


def voxel_to_mm(i: Column, j: Column, k: Column, spacing) -> tuple[Column, Column, Column]:
    return i * spacing[0], j * spacing[1], k * spacing[2]


def voxel_to_local(i: Column, j: Column, k: Column, dims, spacing) -> tuple[Column, Column, Column]:
    """Scene coordinates: voxel centres, the longest side 3.3 units, centred, y upwards."""
    size = [n * s for n, s in zip(dims, spacing, strict=True)]
    scale = 3.3 / max(size)
    x, y, z = (((c + 0.5) * s - p / 2) * scale for c, s, p in zip((i, j, k), spacing, size, strict=True))
    return x, -y, z


def local_to_voxel(x: Column, y: Column, z: Column, dims, spacing) -> tuple[Column, Column, Column]:
    size = [n * s for n, s in zip(dims, spacing, strict=True)]
    scale = 3.3 / max(size)
    return tuple((c / scale + p / 2) / s - 0.5 for c, s, p in zip((x, -y, z), spacing, size, strict=True))


def distance_mm(a, b, spacing) -> Column:
    return F.sqrt(sum(((p - q) * s) * ((p - q) * s) for p, q, s in zip(a, b, spacing, strict=True)))


def escape_html(s: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def file_name(s: Column, most: int = 60) -> Column:
    """Everything but word characters and dashes becomes ``_``; none at the ends."""
    return F.substring(F.regexp_replace(F.regexp_replace(s, r"[^A-Za-z0-9_\-]+", "_"), r"^_+|_+$", ""), 1, most)


def format_mm(mm: Column) -> Column:
    return F.concat(F.format_string("%.2f", mm.cast("double")), F.lit(" mm"))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over the characters' code points."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))


def palette_index(text: Column, colours: int = 8) -> Column:
    return (fnv1a(text) % colours).cast("int")

