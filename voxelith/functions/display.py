"""Scalars around showing values: digits, sizes, colours, slider steps, places on planes, rays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import clamp, round_half_up


def value_step(span: Column) -> Column:
    """A step of 1, 2 or 5 times a power of ten, about a 700th of the span."""
    target = F.greatest(F.abs(span) / 700, F.lit(1e-6))
    # read from text: Java's pow is one place off at some powers of ten
    power = F.concat(F.lit("1e"), F.floor(F.log10(target)).cast("string")).cast("double")
    part = target / power
    return power * F.when(part <= 1, 1).when(part <= 2, 2).when(part <= 5, 5).otherwise(10)


def digits(step: Column) -> Column:
    """Decimals that a step needs, four at most (a step of 0 needs them all)."""
    return F.when(step >= 1, 0).when(step == 0, 4).otherwise(clamp(F.ceil(-F.log10(step)), 0, 4)).cast("int")


def byte_size(n: Column) -> Column:
    unit = F.least(F.floor(F.log(n.cast("double")) / F.log(F.lit(1024.0))), F.lit(3))
    value = n / F.pow(F.lit(1024.0), unit)
    name = F.element_at(F.array(*map(F.lit, ("B", "KiB", "MiB", "GiB"))), unit.cast("int") + 1)
    text = F.when(unit == 0, F.format_string("%.0f", value)).otherwise(F.format_string("%.2f", value))
    return F.when(F.coalesce(n, F.lit(0)) == 0, "0 B").otherwise(F.concat_ws(" ", text, name))


def snap(value: Column, low: float, high: float, step: float) -> Column:
    """The slider step nearest to a value, inside the range."""
    places = max(0, len(f"{step:.8f}".rstrip("0").split(".")[1]))
    return clamp(F.round(low + round_half_up((clamp(value, low, high) - low) / step) * step, places), low, high)


def colour(text: Column) -> Column:
    """``#rrggbb`` in lower case; null for anything else."""
    t = F.lower(F.trim(text))
    return F.when(t.rlike("^#[0-9a-f]{6}$"), t)


def rgb(hex_colour: Column) -> Column:
    part = lambda at: F.conv(F.substring(hex_colour, at, 2), 16, 10).cast("int")
    return F.array(part(2), part(4), part(6))


def darker(c: Column) -> Column:
    """The same hue at 80 % brightness."""
    return F.transform(c, lambda x: round_half_up(x * 0.8).cast("int"))


def dark_ink(c: Column) -> Column:
    """Whether text on this colour should be dark."""
    return (0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2]) / 255 > 0.45


def point_number(text: Column) -> Column:
    """The number in the automatic name of a point, at least 1; null for other texts."""
    n = F.regexp_extract(F.trim(text), r"^(?i:VR ポイント|VR point)\s+(\d+)$", 1)
    return F.when(n != "", F.greatest(n.cast("long"), F.lit(1)))


def plane_fraction(plane: str, i: Column, j: Column, k: Column, dims) -> tuple[Column, Column]:
    """Where a voxel lies in a plane's image, from 0 to 1."""
    w, h, d = dims
    if plane == "axial":
        return (i + 0.5) / w, (j + 0.5) / h
    across, n = (i, w) if plane == "coronal" else (j, h)
    return (across + 0.5) / n, (d - 1 - k + 0.5) / d


def inside_volume(i: Column, j: Column, k: Column, dims, margin: float = 0.5) -> Column:
    a, b, c = ((v >= -margin) & (v <= n - 1 + margin) for v, n in zip((i, j, k), dims, strict=True))
    return a & b & c


def ray_plane(o, d, p, n) -> Column:
    """Distance along a ray to a plane; null if they are parallel or it lies behind."""
    dot = lambda u, v: sum((a * b for a, b in zip(u[1:], v[1:], strict=True)), u[0] * v[0])
    den = dot(d, n)
    t = dot([a - b for a, b in zip(p, o, strict=True)], n) / den
    return F.when((F.abs(den) >= 1e-9) & (t > 0), t)


def ray_sphere(o, d, c, radius: float) -> Column:
    """Distance along a unit ray to a sphere; null for a miss, and for spheres behind the start."""
    dot = lambda u, v: sum((a * b for a, b in zip(u[1:], v[1:], strict=True)), u[0] * v[0])
    r = [a - b for a, b in zip(o, c, strict=True)]
    b = dot(r, d)
    disc = b * b - dot(r, r) + radius * radius
    near = -b - F.sqrt(F.greatest(disc, F.lit(0.0)))
    return F.when((disc >= 0) & (near > 0), near)


#: Fixed value: a volume longer than this (mm) is shown reduced.
OVERSIZE_MM = 300.0


def extents_mm(dims: list[Column], spacing: list[Column]) -> Column:
    """Physical size along x, y and z; null unless all three are known, finite and positive."""
    sizes = F.array(*((d * s).cast("double") for d, s in zip(dims, spacing, strict=True)))
    return F.when(F.forall(sizes, lambda x: F.coalesce((x > 0) & (x < float("inf")), F.lit(False))), sizes)


def oversize(extents: Column) -> Column:
    return F.coalesce(F.array_max(extents) / 1000 > OVERSIZE_MM / 1000 + 1e-9, F.lit(False))


def step_delta(offset, step) -> tuple[Column, ...]:
    """A voxel offset as a vector of a view whose space changes by ``step`` a voxel along each axis."""
    return tuple(o * s for o, s in zip(offset, step, strict=True))


def offset_from_delta(delta, step) -> tuple[Column, ...]:
    """The voxel offset of a view's vector; 0 along an axis without a step."""
    return tuple(F.when(s != 0, d / s).otherwise(0.0) for d, s in zip(delta, step, strict=True))
