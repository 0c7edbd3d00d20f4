"""Results kept as Parquet under the hash of what made them."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FORMAT = 1


def key(parts: dict) -> str:
    return hashlib.sha256(json.dumps({"format": FORMAT, **parts}, sort_keys=True).encode()).hexdigest()


class ResultCache:
    """A folder of entries ``<dataset>/<key>/{data,meta}``; an entry exists once Spark's writer has committed both."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def lookup(self, dataset: str, parts: dict) -> DataFrame | None:
        at = f"{self.root}/{dataset}/{key(parts)}"
        return self.spark.read.parquet(f"{at}/data") if self._fs().exists(self._path(f"{at}/meta/_SUCCESS")) else None

    def get(self, dataset: str, parts: dict, make: Callable[[], DataFrame]) -> DataFrame:
        hit = self.lookup(dataset, parts)
        if hit is not None:
            return hit
        at = f"{self.root}/{dataset}/{key(parts)}"
        make().write.mode("overwrite").parquet(f"{at}/data")
        self.spark.createDataFrame([(json.dumps(parts, sort_keys=True), time.time())], "parts string, made double").write.mode("overwrite").parquet(f"{at}/meta")
        return self.spark.read.parquet(f"{at}/data")

    def _entries(self, dataset: str) -> list[tuple[str, int]]:
        fs, at = self._fs(), self._path(f"{self.root}/{dataset}")
        return [(s.getPath().toString(), s.getModificationTime()) for s in fs.listStatus(at)] if fs.exists(at) else []

    def prune(self, dataset: str, keep: int) -> int:
        """Delete the oldest entries beyond ``keep``; how many went."""
        old = sorted(self._entries(dataset), key=lambda e: -e[1])[keep:]
        for path, _ in old:
            self._fs().delete(self._path(path), True)
        return len(old)

    def prune_others(self, dataset: str, parts: dict) -> int:
        """Delete entries of a dataset that other settings made."""
        other = [p for p, _ in self._entries(dataset) if not p.endswith(key(parts))]
        for path in other:
            self._fs().delete(self._path(path), True)
        return len(other)

    def clear(self) -> None:
        self._fs().delete(self._path(self.root), True)
