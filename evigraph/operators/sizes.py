"""How many tasks a table by keys needs."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows that one task groups or joins at most, if keys are spread evenly: some hundred bytes each are held in memory.
ROWS = 1 << 20


def tasks(rows: int) -> int:
    return max(1, -(-rows // ROWS))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df in partitions by keys, so many that none has many more than ROWS.

    The adaptive planner sizes partitions by their compressed bytes: of narrow rows with repetitive values it puts many millions
    into one task, which a hash table or a sort then holds at their full width. A given number is left as it is.
    """
    return df.repartition(tasks(rows), *keys)
