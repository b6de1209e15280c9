"""Fixpoints driven by demand: resolve, list what is still needed, fetch it, and resolve again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..sources.state import drop, keep, new_folder
from .identity import set_identity

MAX_ROUNDS = 1_000
#: Demands that the message of a stall names.
NAMED = 10


class Stalled(RuntimeError):
    """What waits asks for nothing new and comes back to where it was: it would go on for ever."""


def fixpoint(pending: DataFrame, request: Sequence[str], keys: Sequence[str], inputs: DataFrame, resolve: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]], fetch: Callable[[DataFrame], DataFrame], max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The results of all requests, whose inputs become known on the way.

    inputs holds what is known, one row a key. resolve(pending, inputs) gives (results, requests that still wait), the latter
    with the keys that they need next; fetch(keys) observes them, and must have a row for each, found or not. Only what waits
    goes into the next round, and a round fetches only what none before it did. Without a new key a round may still move
    requests on among the known ones; once they all wait for what they waited for before, the round raises Stalled. That is
    told by one identity of (request, keys), kept from the rounds 1, 2, 4, 8, .. without a new key, so a circle of any length
    is found in three times its length. What a round finds and fetches is added to two tables in the shared folder, so that it
    is written once, and plans and their estimates stay as small as in the first round; only identities and the keys named
    reach the driver.
    """
    spark = pending.sparkSession
    held, ended, waits = (new_folder(spark, name) for name in ("known", "done", "waiting"))
    wanted, known, idle, mark = keep(pending, f"{waits}-0"), keep(inputs, held), 0, None
    for k in range(max_rounds):
        found, waiting = resolve(wanted, known)
        done = keep(found, ended)
        wanted = keep(waiting, f"{waits}-{k + 1}")
        drop(spark, f"{waits}-{k}")
        if wanted.isEmpty():
            return done
        asked = wanted.select(*keys).distinct()
        new = keep(asked.join(known.select(*keys), list(keys), "left_anti"), f"{waits}-new-{k}")
        if not new.isEmpty():
            known, idle, mark = keep(fetch(new).select(inputs.columns), held), 0, None
            drop(spark, f"{waits}-new-{k}")
            continue
        now = set_identity(wanted, [*request, *keys]).first()["identity"]
        if now == mark:
            named = [", ".join(map(str, row)) for row in asked.orderBy(*keys).limit(NAMED).collect()]
            raise Stalled(f"known, but asked for again and again: {'; '.join(named)}")
        idle += 1
        mark = now if idle & (idle - 1) == 0 else mark
    raise RuntimeError(f"no end in {max_rounds} rounds")
