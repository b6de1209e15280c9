"""Reconciliation of a ledger as its transitions arrive, with a state for each input that outlives the query."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .latest import BATCH, pointers

STATE = "expected string, broken_at long, last long, late long"


def _advance(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Carries an input over new transitions in the order of their sequence. One that is not behind the last is late: it is
    counted and changes nothing, as what it would change has been told already."""
    held = state.getOption
    expected, broken, last, late = held if held is not None else (None, None, None, 0)
    rows = [row for part in parts for row in zip(*(part[c].tolist() for c in ("sequence", "before", "after", "baseline")), strict=True)]
    rows.sort(key=lambda row: row[0])
    first = held is None
    for sequence, before, after, base in rows:
        if first:
            expected, first = _text(base), False
        if last is not None and sequence <= last:
            late += 1
            continue
        last = int(sequence)
        if broken is None:
            if _text(before) == expected:
                expected = _text(after)
            else:
                broken = last
    state.update((expected, broken, last, late))
    yield pd.DataFrame({"key": [key[0]], "expected": [expected], "broken_at": pd.array([broken], dtype="Int64"), "last": pd.array([last], dtype="Int64"), "late": [late]})


def _text(x: object) -> str | None:
    return None if x is None or x != x else str(x)


def reconciled(stream: DataFrame, key: str, sequence: str, before: str, after: str, baseline: str | None = None) -> DataFrame:
    """(key, expected, broken_at, last, late) of each input whose transitions arrive: the state it should be in, and the first
    transition that does not follow from it. A stateful operator for update mode.

    Transitions of one input must arrive in the order of their sequence from batch to batch; within a batch they are sorted.
    baseline is a column with the state before an input's first transition. What a key has in one batch is brought together, so
    the size of batches (files or offsets a trigger) bounds memory.
    """
    base = F.col(baseline) if baseline else F.lit(None)
    rows = stream.select(F.col(key).alias("key"), F.col(sequence).cast("long").alias("sequence"), F.col(before).cast("string").alias("before"), F.col(after).cast("string").alias("after"), base.cast("string").alias("baseline"))
    kind = stream.schema[key].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(_advance, f"key {kind}, expected string, broken_at long, last long, late long", STATE, "update", GroupStateTimeout.NoTimeout)


def follow(stream: DataFrame, key: str, sequence: str, before: str, after: str, folder: str, checkpoint: str, baseline: str | None = None) -> StreamingQuery:
    """Writes the inputs that each micro-batch touches below folder; started again with the same checkpoint it goes on from the
    state it has kept."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch}")

    out = reconciled(stream, key, sequence, before, after, baseline)
    return out.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ledger_state(moved: DataFrame, keys: Sequence[str] = ("key",)) -> DataFrame:
    """The inputs as they are now."""
    return pointers(moved, keys)
