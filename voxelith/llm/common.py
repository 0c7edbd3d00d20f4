"""What the corpus operators share: tables in the shared folder, row keys, reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import discard, materialise, shared_dir

__all__ = ["ascii_lower", "bounded_batches", "discard", "doc_crc", "fresh", "join_hot", "materialise", "read", "replaced", "shared_dir"]

#: A key is hot if it has over one in so many rows, so there are fewer hot keys than this.
HOT_SHARE = 1000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def doc_crc(doc_id: Column) -> Column:
    """CRC-32 of the id written as text (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet (names are case-insensitive)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def replaced(df: DataFrame, *names: str) -> DataFrame:
    """The frame without columns of these names: an operator's own columns replace those that clash."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def bounded_batches(df: DataFrame, rows: int = 512, size: int = 16 << 20) -> DataFrame:
    """The frame itself, after limiting the session's Arrow batches, so that Python holds few texts at once.

    A batch ends at ``rows`` rows or ``size`` bytes (a longer text is alone).  Spark reads both settings when it plans a
    query, so they stay set for the session; a session that asks for less keeps its own.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        now = conf.get(name).rstrip("bB")
        if not now.isdecimal() or not 0 < int(now) <= most:
            conf.set(name, most)
    return df


def join_hot(big: DataFrame, small: DataFrame, key: str, counts: DataFrame | None = None, how: str = "left") -> DataFrame:
    """Left (or inner) join of ``big``, whose keys may be very unequal, with ``small``, which has one row a key.

    Keys that hold over one in ``HOT_SHARE`` of ``big``'s rows are fewer than ``HOT_SHARE``, whatever the
    input, so their rows of ``small`` are broadcast and theirs of ``big`` stay where they are; all others
    are shuffled by key.  ``big`` must be a stored table (it is read twice); ``counts(key, n)`` says how
    many of its rows have each key, counted here if not given.
    """
    if counts is None:
        counts = big.groupBy(key).agg(F.count("*").alias("n"))
    total = big.count()
    hot = [r[0] for r in counts.where((F.col("n") * HOT_SHARE > total) & F.col(key).isNotNull()).select(key).collect()]
    if not hot:
        return big.join(small, key, how)
    known = F.col(key).isin(hot)
    near = big.where(known).join(F.broadcast(small.where(known)), key, how)
    return near.unionByName(big.where(known.isNull() | ~known).join(small, key, how))
