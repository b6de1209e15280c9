"""Connected components of a link table, by alternating star contractions.

A vertex's links are only reduced to their minimum, before and after a shuffle, and joined with that one row; of a join whose
one vertex is hot the adaptive planner splits the links' side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import discard, materialize

MAX_TURNS = 64


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
    return row["n"], row["h"] or 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every vertex of edges: component is the smallest id connected with it.

    Each turn hangs every vertex's larger neighbours below its smallest one (large star), then its smaller neighbours and
    itself (small star); both are a grouped minimum and a join. It ends when the links no longer change: each is then
    (vertex, component). Links to itself, repeated and null links are left out.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = materialize(links, "cc-links")
    before = _state(links)
    for _ in range(MAX_TURNS):
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large, "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = materialize(small, "cc-links")
        discard(large)
        discard(links)
        links, state = after, _state(after)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {MAX_TURNS} turns")
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def nearby_labels(edges: DataFrame, a: str, b: str, steps: int = 2) -> DataFrame:
    """(id, component) of every vertex: the smallest id within a few links. Vertices of one component may differ in it, those of
    different components never agree."""
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = both.union(both.select("v", "u"))
    labels = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    for _ in range(steps):
        labels = both.join(labels.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("m").alias("m"))
    return labels.select(F.col("u").alias("id"), F.col("m").alias("component"))
