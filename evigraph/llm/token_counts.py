"""Token counts by offset-mapped attribution: a document is encoded once, and its tokens are dealt to its sections.

A byte-level vocabulary gives every token's length in bytes, so running sums of lengths are token spans in the whole text.
They are joined with section spans by binary search. A token that lies in several sections goes by the rule named.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bound_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this public vocabulary splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "majority")
_CACHE: dict[int, tuple] = {}


def _encoder(data: bytes):
    """The encoder and the byte length of each token, made once in a worker."""
    key = hash(data)
    if key not in _CACHE:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _CACHE[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths
    return _CACHE[key]


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte bounds 0, ..., n of the lines of a text; a line holds the line feed that ends it. No bytes: no line."""
    bounds = np.concatenate([[0], np.flatnonzero(data == 10) + 1, [len(data)]])
    return np.unique(bounds) if len(data) else np.zeros(1, np.int64)


def deal(token_ends: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens lie in several.

    token_ends: running sums of token lengths; bounds: section k is bytes bounds[k] to bounds[k + 1]. start, end: the section
    of a token's first or last byte. majority: the section with most of its bytes; of equal ones the first.
    """
    n = len(bounds) - 1
    if not len(token_ends) or n < 1:
        return np.zeros(max(n, 0), np.int64), 0
    starts = np.concatenate([[0], token_ends[:-1]])
    first = np.searchsorted(bounds, starts, side="right") - 1
    last = np.searchsorted(bounds, token_ends - 1, side="right") - 1
    crossing = np.flatnonzero(first != last)
    own = last.copy() if rule == "end" else first.copy()
    if rule == "majority":
        for k in crossing.tolist():
            inside = bounds[first[k] : last[k] + 2].clip(starts[k], token_ends[k])
            own[k] = first[k] + int(np.argmax(np.diff(inside)))
    return np.bincount(own, minlength=n), len(crossing)


def _byte_bounds(data: np.ndarray, chars: list[int]) -> np.ndarray:
    """Byte offsets of code point offsets."""
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    return begins[np.clip(np.array(chars, np.int64), 0, len(begins) - 1)]


def _count(data, rule: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(data.value)
        for batch in batches:
            totals, crossings, dealt = [], [], []
            for k in range(batch.num_rows):
                text = batch.column(1)[k].as_py() or ""
                raw = np.frombuffer(text.encode(), np.uint8)
                own = batch.column(2)[k].as_py() if batch.num_columns > 2 else None
                bounds = line_bounds(raw) if own is None else _byte_bounds(raw, [0, *sorted(x for x in own if x is not None), len(text)])
                ids = np.asarray(encoder.encode_ordinary(text), np.int64)
                ends = np.cumsum(lengths[ids])
                if len(raw) != (ends[-1] if len(ends) else 0):
                    raise ValueError("token spans do not cover the text")
                counts, crossing = deal(ends, bounds, rule)
                totals.append(len(ids))
                crossings.append(crossing)
                dealt.append(counts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals, pa.int64()), pa.array(crossings, pa.int64()), pa.array(dealt, pa.list_(pa.int64()))],
                names=["doc_id", "n_tokens", "n_crossing", "section_tokens"],
            )

    return run


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, rule: str = "majority", cuts: str | None = None) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_tokens, n_sections, n_crossing and section_tokens, in section order.

    Sections are lines with their line feed, or the pieces between the code point offsets in the array column ``cuts``.
    n_tokens is the sum of section_tokens. Null and empty texts have no token and no section (with cuts: sections without
    tokens). A null offset is no cut, and a null array says that sections are lines. Offsets beyond the text cut at its
    end. Repeated rows count each for itself. Texts of any length are encoded whole. Other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(vocabulary, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *([F.col(cuts)] if cuts else []))
    found = rows.mapInArrow(_count(data, rule), f"doc_id {kind}, n_tokens bigint, n_crossing bigint, section_tokens array<bigint>")
    return found.withColumn("n_sections", F.size("section_tokens").cast("long"))
