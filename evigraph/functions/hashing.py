"""Content identities: sha256 over length-prefixed frames, and the encodings of cursors and paths."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def _binary(value: Column) -> Column:
    return value.cast("string").cast("binary")


def frame(value: Column) -> Column:
    """The length of the bytes as a big-endian 64-bit integer, then the bytes, as hex."""
    raw = _binary(value)
    return F.concat(F.lpad(F.lower(F.hex(F.octet_length(raw).cast("long"))), 16, "0"), F.lower(F.hex(raw)))


def content_identity(*values: Column, prefix: str = "") -> Column:
    """prefix and the lower-case sha256 of the framed values; a null value makes the identity null."""
    return F.concat(F.lit(prefix), F.sha2(F.unhex(F.concat(*map(frame, values))), 256))


def tree_identity(entries: Column) -> Column:
    """The identity of a set of (name, digest, size) structs: sorted, framed, hashed; order of arrival does not matter."""
    one = lambda e: F.concat(frame(e["name"]), frame(e["digest"]), frame(e["size"].cast("string")))
    return F.sha2(F.unhex(F.array_join(F.transform(F.array_sort(entries), one), "")), 256)


def base64_text(raw: Column) -> Column:
    """Standard base64 on one line, whatever the session's chunking."""
    return F.regexp_replace(F.base64(raw), "[\r\n]", "")


def base64_url(raw: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(base64_text(raw), "+/", "-_"), F.lit("="))
