"""Keyset pages over a total order: no offset is ever counted, and a cursor is bound to what it was made for."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

PAGE = 100
SCHEMA = "cursor.v1"


class CursorError(ValueError):
    """The cursor is malformed, belongs to another scope, or its anchor row is gone."""


@dataclass(frozen=True)
class Scope:
    """What a page is a page of: a source (run or revision) and the name of its order."""

    source: str
    ordering: str


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    truncated: bool
    next_cursor: str | None


def encode_cursor(scope: Scope, anchor: Sequence) -> str:
    body = {"schema": SCHEMA, "source": scope.source, "ordering": scope.ordering, "filters": {}, "anchor": list(anchor)}
    return base64.urlsafe_b64encode(json.dumps(body, separators=(",", ":"), sort_keys=True, default=str).encode()).decode().rstrip("=")


def decode_cursor(cursor: str, scope: Scope) -> list:
    try:
        body = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        found = (body["schema"], body["source"], body["ordering"], body["filters"])
        anchor = body["anchor"]
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("malformed cursor") from e
    if found != (SCHEMA, scope.source, scope.ordering, {}):
        raise CursorError("cursor belongs to another source or order")
    return anchor


def sort_key(columns: Sequence[tuple[str, bool]]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in columns]


def after(rows: DataFrame, columns: Sequence[tuple[str, bool]], anchor: Sequence) -> DataFrame:
    """The rows strictly behind an anchor's values, as a lexicographic comparison that the scan can use: the first column's
    bound stands alone in a conjunct."""
    first, up = columns[0]
    lit = [F.lit(v).cast(rows.schema[c].dataType) for (c, _), v in zip(columns, anchor, strict=True)]
    later = F.lit(False)
    for k in reversed(range(len(columns))):
        c, ascending = columns[k]
        ahead = F.col(c) > lit[k] if ascending else F.col(c) < lit[k]
        later = ahead | ((F.col(c) == lit[k]) & later)
    bound = F.col(first) >= lit[0] if up else F.col(first) <= lit[0]
    return rows.where(bound & later)


def page(rows: DataFrame, columns: Sequence[tuple[str, bool]], scope: Scope, cursor: str | None = None, size: int = PAGE) -> Page:
    """A page in a total order of non-null columns, given as (name, ascending). One row more than a page is looked for, which
    tells whether the page is truncated. The cursor's anchor row must still exist."""
    if cursor is not None:
        anchor = decode_cursor(cursor, scope)
        if len(anchor) != len(columns):
            raise CursorError("malformed cursor")
        same = [F.col(c) == F.lit(v).cast(rows.schema[c].dataType) for (c, _), v in zip(columns, anchor, strict=True)]
        if not rows.where(_all(same)).head(1):
            raise CursorError("the cursor's row is gone")
        rows = after(rows, columns, anchor)
    found = rows.orderBy(*sort_key(columns)).limit(size + 1).collect()
    kept = found[:size]
    spark = rows.sparkSession
    truncated = len(found) > size
    last = encode_cursor(scope, [kept[-1][c] for c, _ in columns]) if truncated else None
    return Page(spark.createDataFrame(kept, rows.schema), truncated, last)


def _all(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def tagged(parts: Sequence[DataFrame]) -> DataFrame:
    """Several tables as one to page through, in the order given: tag comes first in the sort."""
    out = parts[0].withColumn("tag", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        out = out.unionByName(part.withColumn("tag", F.lit(k)), allowMissingColumns=True)
    return out


def tagged_page(parts: Sequence[DataFrame], columns: Sequence[Sequence[tuple[str, bool]]], scope: Scope, cursor: str | None = None, size: int = PAGE) -> Page:
    """A page over several tables, one behind the other, each in a total order of its own columns; rows come with their tag.

    A cursor names the table of the last row shown and that row's order columns, which must still be there. Tables before it
    are not read, the one it is in from there on, and a later one only as far as the page still has room.
    """
    tag, kept, truncated, last = 0, [], False, None
    ordered = [[*own] for own in columns]
    if cursor is not None:
        anchor = decode_cursor(cursor, scope)
        if not anchor or anchor[0] not in range(len(parts)) or len(anchor) != 1 + len(ordered[anchor[0]]):
            raise CursorError("malformed cursor")
        tag, values = anchor[0], anchor[1:]
        same = [F.col(c) == F.lit(v).cast(parts[tag].schema[c].dataType) for (c, _), v in zip(ordered[tag], values, strict=True)]
        if not parts[tag].where(_all(same)).head(1):
            raise CursorError("the cursor's row is gone")
    for k in range(tag, len(parts)):
        rows = after(parts[k], ordered[k], values) if cursor is not None and k == tag else parts[k]
        found = rows.orderBy(*sort_key(ordered[k])).limit(size + 1 - len(kept)).collect()
        truncated = len(kept) + len(found) > size
        found = found[: size - len(kept)]
        kept += [(k, r) for r in found]
        if found:
            last = [k, *(found[-1][c] for c, _ in ordered[k])]
        if truncated:
            break
    spark = parts[0].sparkSession
    shown = [spark.createDataFrame([r for t, r in kept if t == k], part.schema) for k, part in enumerate(parts)]
    return Page(tagged(shown), truncated, encode_cursor(scope, last) if truncated else None)


def probe(rows: DataFrame, size: int = PAGE) -> DataFrame:
    """(shown, total, truncated) of a table at a page size."""
    counted = rows.agg(F.count("*").alias("total"))
    return counted.select(F.least("total", F.lit(size)).cast("long").alias("shown"), "total", (F.col("total") > size).alias("truncated"))
