"""Words of whole texts as 64-bit hashes, computed by numpy over the bytes of Arrow batches.

A batch is cut into slices of at most SLICE_BYTES of text (one text at least), so memory depends on neither batch nor
table size. Only A-Z is lower-cased, and words are runs of the bytes of one of two alphabets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher: every bit of the input reaches every bit of the result."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def _space_table() -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


def _letter_table() -> np.ndarray:
    """Digits, letters and every byte of a character beyond ASCII."""
    table = np.zeros(256, dtype=bool)
    table[48:58] = table[65:91] = table[97:123] = table[128:] = True
    return table


LOWER, SAME = _lower_table(), np.arange(256, dtype=np.uint8)
SPACE, LETTERS = _space_table(), _letter_table()
BYTE_HASH = mix64(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
_STEP = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.full(n, _STEP, dtype=np.uint64))


_POWERS = _powers(256)


@dataclass
class Slice:
    """Texts rows[first:last] of a batch: bytes, byte offsets by text, and words (start, end, hash) with offsets by text."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    word_offsets: np.ndarray

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.last - self.first), np.diff(self.word_offsets))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null text is an empty one."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(column: pa.Array, word_bytes: np.ndarray = SPACE, fold: np.ndarray = LOWER, size: int = SLICE_BYTES) -> Iterator[Slice]:
    data, offsets = texts(column)
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield _words(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], word_bytes, fold)
        first = last


def _words(first: int, last: int, data: np.ndarray, offsets: np.ndarray, word_bytes: np.ndarray, fold: np.ndarray) -> Slice:
    global _POWERS
    inside = word_bytes[data]
    edge = np.zeros(len(data) + 1, dtype=bool)  # a text's first byte starts a word, whatever came before
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    lengths = ends - starts
    if len(starts):
        longest = int(lengths.max())
        if longest > len(_POWERS):
            _POWERS = _powers(1 << longest.bit_length())
        at = np.flatnonzero(inside)
        with np.errstate(over="ignore"):
            values = BYTE_HASH[fold[data[at]]] * _POWERS[at - np.repeat(starts, lengths)]
            firsts = np.cumsum(lengths) - lengths
            hashes = mix64(np.add.reduceat(values, firsts) + lengths.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Slice(first, last, data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each run of n words, wherever it starts; runs over the end of a text are for the caller to leave out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = hashes[: len(hashes) - n + 1].copy()
        for k in range(1, n):
            total = total * U(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
        return mix64(total + U(n))


def gram_ok(part: Slice, n: int) -> np.ndarray:
    """For each run of n words in the slice, whether it lies in one text."""
    if len(part.hashes) < n:
        return np.zeros(0, bool)
    of = part.text_of_word()
    return of[: len(of) - n + 1] == of[n - 1 :]


def shingle_sets(part: Slice, n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-word shingles as sorted hashes; a text of fewer words has its whole sequence as the only one."""
    runs = grams(part.hashes, n)
    for k in range(part.last - part.first):
        a, b = part.word_offsets[k], part.word_offsets[k + 1]
        if b - a >= n:
            yield np.unique(runs[a : b - n + 1])
        elif b > a:
            yield grams(part.hashes[a:b], int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    """int64 lists of hashes."""
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
