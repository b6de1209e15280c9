"""Identities of sets of any size, from sums that add up in any order: no set is sorted or gathered in one place.

A member's SHA-256 is cut into eight numbers of 32 bits. The sums of these numbers, with the count, stand for a set: they are
summed before a shuffle, two parts of a set are added, and order does not matter. A set is held as the sums of its BUCKETS hash
ranges and one identity over them, so two sets are told apart by one value, and where they differ by a few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import hashing

#: Hash ranges of a set: by the first two hexadecimal digits.
BUCKETS = 256
LANES = 8
#: How an analysis met one of its inputs.
SOURCE, PRESENT, MISSING, NON_REGULAR, UNREADABLE = "source", "config-present", "missing", "non-regular", "unreadable"
STATES = (SOURCE, PRESENT, MISSING, NON_REGULAR, UNREADABLE)
INPUT = ("path", "state", "payload_sha256", "physical_id")


def member_digest(*values: Column) -> Column:
    """The SHA-256 of framed values; unlike content_identity a null value has a frame of its own and the digest is never null."""
    frames = [F.coalesce(hashing.frame(v), F.lit("f" * 16)) for v in values]
    return F.sha2(F.unhex(F.concat(*frames)), 256)


def _lanes(digest: Column) -> list[Column]:
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(LANES)]


def _sums(rows: DataFrame, keys: Sequence[str], digest: str) -> DataFrame:
    """(keys, n, sums): the eight sums as text."""
    total = F.concat_ws(".", *(F.sum(x).cast("string") for x in _lanes(F.col(digest))))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), total.alias("sums"))


def set_buckets(rows: DataFrame, members: Sequence[str], keys: Sequence[str] = (), distinct: bool = True) -> DataFrame:
    """(keys, bucket, n, digest) of the sets of members that rows with equal keys make: one row a hash range that has any.

    Equal members count once, or as often as they occur if distinct is false, which spares a shuffle.
    """
    held = rows.select(*keys, member_digest(*map(F.col, members)).alias("_d"))
    held = held.distinct() if distinct else held
    held = held.withColumn("bucket", F.conv(F.substring("_d", 1, 2), 16, 10).cast("int"))
    return _sums(held, [*keys, "bucket"], "_d").select(*keys, "bucket", "n", F.sha2(F.concat("sums", F.lit("|"), "n"), 256).alias("digest"))


def of_buckets(buckets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, identity) of set_buckets(): BUCKETS digests at most are read in their order. Without keys an empty set has an
    identity too."""
    line = F.concat_ws(":", "bucket", "digest")
    entries = F.transform(F.array_sort(F.collect_list(F.struct(F.col("bucket").alias("b"), line.alias("t")))), lambda x: x["t"])
    out = buckets.groupBy(*keys).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(F.array_join(entries, ","), 256).alias("identity"))
    return out.select(*keys, "n", "identity")


def set_identity(rows: DataFrame, members: Sequence[str], keys: Sequence[str] = (), distinct: bool = True) -> DataFrame:
    """(keys, n, identity) of the sets of members; see set_buckets()."""
    return of_buckets(set_buckets(rows, members, keys, distinct), keys)


def changed_members(before: DataFrame, after: DataFrame, members: Sequence[str]) -> DataFrame:
    """(members, side) of what only one of two sets has. Only the hash ranges whose digests differ are compared row by row."""
    differs = set_buckets(before, members).alias("a").join(set_buckets(after, members).alias("b"), "bucket", "full")
    differs = differs.where(~F.col("a.digest").eqNullSafe(F.col("b.digest"))).select("bucket")
    bucket = F.conv(F.substring(member_digest(*map(F.col, members)), 1, 2), 16, 10).cast("int")
    some = lambda df: df.select(*members, bucket.alias("bucket")).join(differs, "bucket", "left_semi").select(*members)
    a, b = some(before), some(after)
    return a.exceptAll(b).distinct().withColumn("side", F.lit("before")).union(b.exceptAll(a).distinct().withColumn("side", F.lit("after")))


def semantic_inputs(sources: DataFrame, observations: DataFrame) -> DataFrame:
    """All that an analysis has read, as one table of INPUT columns without repeats.

    sources(path, payload_sha256, physical_id) are files that were analysed. observations(path, state, payload_sha256,
    physical_id, detail) are configuration files that were asked for, found or not: a missing one has neither digest nor file,
    one that is not regular no digest, and an unreadable one has the digest of why.
    """
    read = sources.select("path", F.lit(SOURCE).alias("state"), "payload_sha256", "physical_id")
    state = F.col("state")
    digest = F.when(state == PRESENT, F.col("payload_sha256")).when(state == UNREADABLE, F.sha2(F.coalesce("detail", F.lit("")).cast("binary"), 256))
    asked = observations.select("path", "state", digest.alias("payload_sha256"), F.when(state != MISSING, F.col("physical_id")).alias("physical_id"))
    return read.unionByName(asked).distinct()


def directory_identities(files: DataFrame, parts: str, digest: str, size: str) -> DataFrame:
    """(path, depth, identity, n_entries, n_files, bytes) of every directory above files(parts array, digest, size).

    From the deepest level up: a directory is the set of its entries, each with its kind, name, digest and size, where those of
    a directory are its own identity and the bytes below it. Entries are summed where they are read, so a directory of any
    number of entries takes one row a task. The root is the empty array; a file without components is left out.
    """
    name = lambda p: F.element_at(p, -1)
    up = lambda p: F.slice(p, 1, F.size(p) - 1)
    held = files.where(F.size(parts) > 0).select(up(F.col(parts)).alias("path"), F.lit("file").alias("kind"), name(F.col(parts)).alias("name"), F.col(digest).alias("digest"), F.col(size).cast("long").alias("size"), F.lit(1).cast("long").alias("n_files"))
    held = held.withColumn("_d", member_digest(*map(F.col, ("kind", "name", "digest", "size"))))
    sums = [F.sum(x).alias(f"_{k}") for k, x in enumerate(_lanes(F.col("_d")))]
    totals = [F.count("*").alias("n_entries"), F.sum("n_files").alias("n_files"), F.sum("size").alias("bytes")]
    direct = held.groupBy("path").agg(*sums, *totals).checkpoint()
    deepest = direct.agg(F.max(F.size("path"))).first()[0]
    found: list[DataFrame] = []
    below: DataFrame | None = None
    for depth in range(-1 if deepest is None else deepest, -1, -1):
        level = direct.where(F.size("path") == depth)
        if below is not None:
            entries = below.select(up(F.col("path")).alias("path"), F.lit("directory").alias("kind"), name(F.col("path")).alias("name"), F.col("identity").alias("digest"), F.col("bytes").alias("size"), "n_files")
            entries = entries.withColumn("_d", member_digest(*map(F.col, ("kind", "name", "digest", "size"))))
            level = level.unionByName(entries.groupBy("path").agg(*sums, *totals))
            level = level.groupBy("path").agg(*(F.sum(c).alias(c) for c in level.columns if c != "path"))
        text = F.concat(F.concat_ws(".", *(f"_{k}" for k in range(LANES))), F.lit("|"), "n_entries", F.lit("|"), "bytes")
        below = level.select("path", F.lit(depth).alias("depth"), F.sha2(text, 256).alias("identity"), "n_entries", "n_files", "bytes").checkpoint()
        found.append(below)
    if not found:
        return direct.select("path", F.lit(0).alias("depth"), F.lit("").alias("identity"), "n_entries", "n_files", "bytes")
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out
