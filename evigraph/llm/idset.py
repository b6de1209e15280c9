"""A set of ids as a filter of bounded size, so that rows of long texts are only shuffled when their id may be in the set."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tokens import mix64

#: Bits at most: 8 MB to each task, whatever the number of ids. A fuller filter lets more rows through, never fewer.
MAX_BITS = 1 << 26
#: Bytes that move between executors at a time while a filter is built.
PIECE = 1 << 16


def places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    h = mix64(ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64(bits - 1)
    return [(x & mask).astype(np.int64) for x in (h, h >> np.uint64(19), h >> np.uint64(38))]


def _fill(bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in places(batch.column(0).to_numpy(zero_copy_only=False), bits):
                np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        pieces = [(k, held[k : k + PIECE]) for k in range(0, len(held), PIECE)]
        pieces = [(k // PIECE, piece.tobytes()) for k, piece in pieces if piece.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pieces], pa.int32()), pa.array([x for _, x in pieces], pa.binary())], names=["piece", "bits"])

    return run


def _unite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            more = np.frombuffer(bits, np.uint8)
            pieces[k] = pieces[k] | more if k in pieces else more
    yield pa.RecordBatch.from_arrays([pa.array(list(pieces), pa.int32()), pa.array([x.tobytes() for x in pieces.values()], pa.binary())], names=["piece", "bits"])


def build(ids: DataFrame) -> bytes:
    """The filter of a one-column table of non-null long ids. Executors unite the pieces of it; MAX_BITS at most reach the driver."""
    bits = min(MAX_BITS, 1 << max(12, (16 * ids.count()).bit_length()))
    held = np.zeros(bits // 8, np.uint8)
    pieces = ids.mapInArrow(_fill(bits), "piece int, bits binary").repartition("piece").mapInArrow(_unite, "piece int, bits binary")
    for row in pieces.collect():
        held[row["piece"] * PIECE :][: len(row["bits"])] |= np.frombuffer(bytes(row["bits"]), np.uint8)
    return held.tobytes()


def may_hold(held: bytes, column: pa.Array) -> np.ndarray:
    """Whether each id may be in the set; a null id is not."""
    known = np.frombuffer(held, np.uint8)
    out = np.array(column.is_valid(), bool) if not isinstance(column, pa.Array) else column.is_valid().to_numpy(zero_copy_only=False).copy()
    ids = column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    for at in places(ids, 8 * len(known)):
        out &= (known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return out


def _select(held, id_at: int, inside: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(held.value, batch.column(id_at)) == inside))

    return run


def split(rows: DataFrame, id_col: str, held: bytes) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in the set, all other rows)."""
    sent, at = rows.sparkSession.sparkContext.broadcast(held), rows.columns.index(id_col)
    return rows.mapInArrow(_select(sent, at, True), rows.schema), rows.mapInArrow(_select(sent, at, False), rows.schema)
