"""Connected components of an edge table, entirely in Spark.

Alternating large-star and small-star steps turn every component into a star
around its smallest node in a logarithmic number of rounds.  Every step is a
map-side combined ``min`` and an equi-join, so a hub with very many
neighbours is pre-aggregated or split by adaptive execution, never gathered.
Each round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import discard, materialise


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u long, v long)`` -> ``(node, root)`` for every node but the roots.

    ``root`` is the smallest node of the component.  Self-loops, repeated edges
    and edges with a null end are allowed and ignored; no edges give no rows.
    """
    spark = edges.sparkSession
    stars = (
        edges.where(F.col("u") != F.col("v"))
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    stars, path = materialise(stars, "stars")
    seen = _digest(stars)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after, after_path = materialise(_small_star(_large_star(stars)), "stars")
        discard(spark, path)
        stars, path = after, after_path
        now = _digest(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _digest(stars: DataFrame) -> tuple[int, int]:
    """Row count and an order-free hash: equal before and after a round means settled."""
    row = stars.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)).alias("h")).first()
    return row["n"], row["h"] or 0


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return low.select("u", F.col("m").alias("v")).union(rest).distinct()


def lowest_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of n nodes' components, for a bounded list of edges ``(a, b)`` in one task.

    The smallest label known at either end of an edge goes to both ends' roots, then labels are followed to their end.
    """
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new
