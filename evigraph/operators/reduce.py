"""Keyed reductions with a defined winner: first facts, duplicate rejection, worst states, latest pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key, the first in the given total order; unlike dropDuplicates the same one on every run."""
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return first.select(*keys, "_r.*").select(rows.columns)


def reject_duplicates(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of keys that occur once, rows of keys that occur more often with their count as n_claims): no key of the
    second kind has a winner. Keys are counted map-side; null keys are equal to each other."""
    own = [f"_k{i}" for i in range(len(keys))]
    counts = rows.groupBy(*(F.col(k).alias(x) for k, x in zip(keys, own, strict=True))).agg(F.count("*").alias("n_claims"))
    same = [F.col(k).eqNullSafe(F.col(x)) for k, x in zip(keys, own, strict=True)]
    once = rows.join(counts.where("n_claims = 1"), same, "left_semi")
    return once, rows.join(counts.where("n_claims > 1"), same).drop(*own)


def ranked(value: Column, order: list[str]) -> Column:
    """The place of a value in a declared order from 0 on; values outside it have none."""
    return F.element_at(F.create_map(*(F.lit(x) for k, v in enumerate(order) for x in (v, k))), value)


def worst_state(rows: DataFrame, keys: list[str], state: str, order: list[str]) -> DataFrame:
    """The state of the highest rank in each group."""
    worst = rows.groupBy(*keys).agg(F.max(ranked(F.col(state), order)).alias("_r"))
    return worst.select(*keys, F.element_at(F.array(*map(F.lit, order)), F.col("_r") + 1).alias(state))


def latest(rows: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """The payload with the greatest order in each group, and conflicts: how many payloads share that order beyond one.

    A conflict means that the source broke its promise of one payload a version; callers must refuse such rows.
    """
    by_version = rows.groupBy(*keys, *order).agg(F.min(F.struct(*payload)).alias("_p"), F.max(F.struct(*payload)).alias("_q"))
    best = by_version.groupBy(*keys).agg(F.max(F.struct(*order, "_p", "_q")).alias("_m"))
    return best.select(*keys, *(F.col(f"_m.{c}").alias(c) for c in order), *(F.col(f"_m._p.{c}").alias(c) for c in payload), (F.col("_m._p") != F.col("_m._q")).alias("conflict"))
