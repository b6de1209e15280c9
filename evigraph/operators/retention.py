"""Retention plans: what an age limit would delete, what protects the rest, and whether a plan still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integrity import symmetric_difference


def protection_reasons(runs: DataFrame, run: str, owner: str, order: list[str], finished: str, completed: str, pins: DataFrame) -> DataFrame:
    """(run, reason), one row a reason: latest-attempt and latest-completed of each owner, pinned, in-progress."""
    key = F.struct(*order)
    top = lambda rows, why: rows.groupBy(owner).agg(F.max_by(run, key).alias(run)).select(run, F.lit(why).alias("reason"))
    found = top(runs, "latest-attempt").union(top(runs.where(completed), "latest-completed"))
    found = found.union(pins.select(run).distinct().join(runs.select(run), run, "left_semi").select(run, F.lit("pinned")))
    return found.union(runs.where(F.col(finished).isNull()).select(run, F.lit("in-progress"))).distinct()


def plan(runs: DataFrame, run: str, finished: str, cutoff, reasons: DataFrame, tombstones: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, exclusions) of the runs that finished strictly before the cutoff: a run with any reason is excluded, with its
    sorted reasons, the others are items. Runs that are gone already are neither; a run without an end is not old."""
    old = runs.where(F.col(finished).isNotNull() & (F.col(finished) < F.lit(cutoff)))
    if tombstones is not None:
        old = old.join(tombstones.select(run), run, "left_anti")
    why = reasons.groupBy(run).agg(F.array_sort(F.collect_set("reason")).alias("reasons"))
    items = old.join(why, run, "left_anti")
    return items, old.join(why, run)


def still_holds(planned: DataFrame, recomputed: DataFrame) -> bool:
    """Whether a plan's items or exclusions are what a new plan would have; otherwise the plan is stale."""
    return symmetric_difference(planned, recomputed).isEmpty()


def live(rows: DataFrame, key: str, tombstones: DataFrame) -> DataFrame:
    """Adds state: pruned or pruning by the row's tombstone(state), else live."""
    marks = tombstones.select(F.col(key), F.col("state").alias("_s"))
    return rows.join(marks, key, "left").withColumn("state", F.coalesce("_s", F.lit("live"))).drop("_s")


def checked_delete(rows: DataFrame, key: str, digest: str, plan_items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, plan items that no longer match): a row goes only if its digest is the planned one."""
    planned = plan_items.select(F.col(key), F.col(digest).alias("_planned"))
    stay = rows.join(planned.withColumnRenamed("_planned", digest), [key, digest], "left_anti")
    wrong = planned.join(rows.select(key, digest), key, "left").where(~F.col("_planned").eqNullSafe(F.col(digest)))
    return stay, wrong.select(key, F.col("_planned").alias("planned"), F.col(digest).alias("found"))
