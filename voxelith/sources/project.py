"""Project archives: a JSON document and binary run masks in a zip file."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
from collections.abc import Iterable

FORMAT, VERSION = "voxelith-project", 1
#: Fixed value: the mark that starts a run mask.
MAGIC = b"VLR1"


class ProjectError(ValueError):
    pass


def encode_runs(rows: Iterable[tuple[int, int, int, int]], slices: int) -> bytes:
    """``(k, j, x0, x1)`` in order -> mark, slice count, offsets in words, triples; little-endian words."""
    by: list[list[int]] = [[] for _ in range(slices)]
    for k, j, x0, x1 in sorted(rows):
        by[k] += (j, x0, x1)
    offsets = [0]
    for r in by:
        offsets.append(offsets[-1] + len(r))
    words = [*offsets, *(v for r in by for v in r)]
    return MAGIC + struct.pack(f"<{len(words) + 1}I", slices, *words)


def decode_runs(data: bytes, w: int, h: int, slices: int) -> list[tuple[int, int, int, int]]:
    """The inverse, with every count and bound checked."""
    if len(data) < 8 or len(data) % 4 or data[:4] != MAGIC:
        raise ProjectError("no run mask")
    words = struct.unpack(f"<{len(data) // 4}I", data)[1:]
    if words[0] != slices:
        raise ProjectError(f"{words[0]} slices instead of {slices}")
    body = words[slices + 2 :]
    if len(words) < slices + 2:
        raise ProjectError("cut short")
    out = []
    for k in range(slices):
        a, b = words[1 + k], words[2 + k]
        if b < a or b > len(body) or (b - a) % 3:
            raise ProjectError("bad offsets")
        for n in range(a, b, 3):
            j, x0, x1 = body[n : n + 3]
            if j >= h or x0 > x1 or x1 >= w:
                raise ProjectError(f"a run leaves slice {k}")
            out.append((k, j, x0, x1))
    return out


def pack(project: dict, binaries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("project.json", json.dumps({"format": FORMAT, "version": VERSION, **project}))
        for name, data in binaries.items():
            z.writestr(name, data)
    return out.getvalue()


def unpack(data: bytes) -> tuple[dict, dict[str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            entries = {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
    except zipfile.BadZipFile as e:
        raise ProjectError("no zip file") from e
    return from_entries(entries)


def from_entries(entries: dict[str, bytes]) -> tuple[dict, dict[str, bytes]]:
    """Accepts the archive's files at the top or in one folder."""
    at = min((n for n in entries if n.rsplit("/", 1)[-1] == "project.json"), key=len, default=None)
    if at is None:
        raise ProjectError("project.json is missing")
    try:
        project = json.loads(entries[at])
    except ValueError as e:
        raise ProjectError("project.json can't be read") from e
    if not isinstance(project, dict) or project.get("format") != FORMAT:
        raise ProjectError("another format")
    if project.get("version", 0) > VERSION:
        raise ProjectError("a newer version")
    top = at[: -len("project.json")]
    return project, {n[len(top) :]: v for n, v in entries.items() if n.startswith(top) and n != at}


def file_name(text: str, most: int = 60) -> str:
    return re.sub(r"[^\w\-]+", "_", text, flags=re.ASCII).strip("_")[:most]
