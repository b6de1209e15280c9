"""States of capabilities: what their own evidence lacks, and what those lack that they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import MAX_ROUNDS
from .reduce import ranked

#: States from the best on.
STATES = ["complete", "incomplete", "unavailable", "failed"]


def own_states(declared: DataFrame, capability: str, records: DataFrame, gaps: DataFrame, advisory: str) -> DataFrame:
    """(capability, state, n_required, n_advisory) of every declared capability, by itself.

    records(capability, state) are states that were observed; the worst counts. gaps(capability, advisory boolean) are
    limitations: a required one makes a capability incomplete at least, an advisory one only counts. A declared capability
    without a record is unavailable. Gaps are counted before they meet capabilities, so a hot one costs a row a task.
    """
    rank = F.max(ranked(F.col("state"), STATES))
    seen = records.groupBy(capability).agg(rank.alias("_seen"))
    soft = F.coalesce(F.col(advisory), F.lit(False))
    lack = gaps.groupBy(capability).agg(F.count_if(~soft).alias("n_required"), F.count_if(soft).alias("n_advisory"))
    rows = declared.select(capability).distinct().join(seen, capability, "left").join(lack, capability, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    worst = F.greatest(F.coalesce("_seen", F.lit(STATES.index("unavailable"))), F.when(zero("n_required") > 0, 1).otherwise(0))
    return rows.select(capability, F.get(F.array(*map(F.lit, STATES)), worst).alias("state"), zero("n_required").alias("n_required"), zero("n_advisory").alias("n_advisory"))


def folded(states: DataFrame, capability: str, needs: DataFrame, needed: str) -> DataFrame:
    """(capability, state, effective): the worst state among a capability and all that it needs, directly or through others.

    needs(capability, needed) may have circles. A worsening travels along needs until it meets one at least as bad, so each
    capability is written once for each rank it takes, four times at most, however many ways lead to it. What is needed and
    not declared is unavailable.
    """
    rank = states.select(F.col(capability).alias("node"), ranked(F.col("state"), STATES).alias("rank"))
    edges = needs.select(F.col(capability).alias("src"), F.col(needed).alias("dst")).where("src is not null and dst is not null").distinct()
    absent = edges.select(F.col("dst").alias("node")).distinct().join(rank, "node", "left_anti").withColumn("rank", F.lit(STATES.index("unavailable")))
    edges, steps = edges.checkpoint(), [rank.unionByName(absent).checkpoint()]
    front = steps[0].where("rank > 0")
    for _ in range(MAX_ROUNDS):
        now = reduce(DataFrame.unionByName, steps).groupBy("node").agg(F.max("rank").alias("_now"))
        told = front.join(edges, front.node == edges.dst).groupBy(F.col("src").alias("node")).agg(F.max("rank").alias("rank"))
        front = told.join(now, "node").where("rank > _now").select("node", "rank").checkpoint()
        if front.isEmpty():
            break
        steps.append(front)
    else:
        raise RuntimeError(f"the fold did not end in {MAX_ROUNDS} rounds")
    worst = now.select(F.col("node").alias(capability), F.get(F.array(*map(F.lit, STATES)), F.col("_now")).alias("effective"))
    return states.select(capability, "state").join(worst, capability)
