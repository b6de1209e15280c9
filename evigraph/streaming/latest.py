"""Latest pointers over a stream of versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

BATCH = "batch"


def versions(stream: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Per key the greatest order seen, its payload, and whether payloads of that order differ, as a streaming aggregate for
    update mode.

    The state of a key is three greatest values, kept by Spark and summed within each task first, so a hot key moves a row a
    task. A late version changes nothing, an equal one with the same payload neither; one with another payload is a conflict,
    told by the least and the greatest hash that go with the greatest order. Keys are never given up: a pointer has no end.
    """
    own = F.xxhash64(F.to_json(F.struct(*payload), {"ignoreNullFields": "false"})).bitwiseAND(F.lit((1 << 62) - 1))
    rows = stream.select(*keys, F.struct(*order).alias("_o"), F.struct(*payload).alias("_p"), own.alias("_h"))
    return rows.groupBy(*keys).agg(F.max(F.struct("_o", "_p")).alias("_m"), F.max(F.struct("_o", "_h")).alias("_a"), F.max(F.struct("_o", (-F.col("_h")).alias("_h"))).alias("_z")).select(
        *keys, *(F.col(f"_m._o.{c}").alias(c) for c in order), *(F.col(f"_m._p.{c}").alias(c) for c in payload), (F.col("_a._h") != -F.col("_z._h")).alias("conflict")
    )


def follow(stream: DataFrame, keys: Sequence[str], order: Sequence[str], payload: Sequence[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the pointers that each micro-batch moves below folder, and ends when all that is there now has been read.

    A batch that is repeated after a failure overwrites what it wrote before, so a restart loses and doubles nothing.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/{BATCH}={batch}")

    moved = versions(stream, keys, order, payload)
    return moved.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pointers(moved: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The pointers as they are now: of each key what the last batch that moved it says."""
    rest = [c for c in moved.columns if c not in (*keys, BATCH)]
    last = moved.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(BATCH)).alias("_r"))
    return last.select(*keys, "_r.*")
