"""Binary STL from a triangle table: a header, a count, fifty bytes for each triangle."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..operators.mesh import CORNERS


def records(tri: np.ndarray) -> bytes:
    n = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    size = np.sqrt((n * n).sum(1, keepdims=True))
    out = np.zeros(len(tri), np.dtype([("v", "<f4", 12), ("a", "<u2")]))
    out["v"] = np.concatenate([np.divide(n, size, out=np.zeros_like(n), where=size > 0)[:, None], tri], 1).reshape(-1, 12)
    return out.tobytes()


def encoded(tris: DataFrame) -> DataFrame:
    """Blocks of encoded triangles, made where they lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)], "data": [records(pdf[CORNERS].to_numpy(float).reshape(-1, 3, 3))]})

    return tris.select(*CORNERS).mapInPandas(run, "n long, data binary")


def write(tris: DataFrame, path: str, name: str = "surface") -> int:
    """One local STL file; blocks stream through the driver one partition at a time."""
    blocks = encoded(tris).persist()
    count = blocks.agg({"n": "sum"}).first()[0] or 0
    with open(path, "wb") as f:
        f.write(name.encode()[:80].ljust(80, b"\0") + struct.pack("<I", count))
        for row in blocks.select("data").toLocalIterator():
            f.write(row["data"])
    blocks.unpersist()
    return count


def read(data: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", data, 80)
    return np.frombuffer(data, np.dtype([("v", "<f4", 12), ("a", "<u2")]), n, 84)["v"].reshape(n, 4, 3)[:, 1:]
