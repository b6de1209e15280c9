"""Ledger reconciliation: an ordered fold of before/after transitions over each input's baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reconcile(transitions: DataFrame, keys: list[str], sequence: str, before: str, after: str, baseline: DataFrame, state: str) -> DataFrame:
    """(keys, expected, broken_at): the state each input should be in, and the first transition that breaks its chain.

    A transition applies if its before equals the state so far; the state after a chain that holds is its last after, so
    each link is checked against its neighbour by a window over the sequence, without a fold that must run row by row.
    Behind a break the state stays as it was. Inputs without transitions keep their baseline; unknown ones start as null.
    """
    order = W.partitionBy(*keys).orderBy(sequence)
    base = baseline.select(*keys, F.col(state).alias("_base"))
    rows = transitions.join(base, keys, "left")
    previous = F.coalesce(F.lag(F.struct(F.col(after).alias("v"))).over(order), F.struct(F.col("_base").alias("v")))["v"]
    rows = rows.withColumn("_ok", previous.eqNullSafe(F.col(before)))
    bad = rows.groupBy(*keys).agg(F.min(F.when(~F.col("_ok"), F.col(sequence))).alias("broken_at"))
    rows = rows.join(bad, keys).where(F.col("broken_at").isNull() | (F.col(sequence) < F.col("broken_at")))
    final = rows.groupBy(*keys).agg(F.max(F.struct(F.col(sequence), F.col(after).alias("v"))).alias("_m"))
    out = base.join(final, keys, "full").join(bad, keys, "full")
    return out.select(*keys, F.when(F.col("_m").isNotNull(), F.col("_m.v")).otherwise(F.col("_base")).alias("expected"), "broken_at")
