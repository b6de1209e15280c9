"""WARC archives with revisit resolution, through Spark's own writers and readers.

Records are written by the text writer whose line end is the record end CRLF CRLF, so the files are committed task by task
to any store that Spark writes to, and a lost executor's files are written again. Headers, not payloads, meet by payload
digest; of equal payloads one stays a response and the others become revisit records that name it. Compressed archives are
read through the text reader with the same line end, record by record, so memory holds a record and not a file.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import idset
from .runtime import bound_batches, fresh, materialize, new_path

#: Payloads below this many bytes are always written in full.
MIN_REVISIT = 1000
#: Records in one file at most: a file is read by one task.
FILE_RECORDS = 2000
END = b"\r\n\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_length bigint, refers_to string, payload binary"


def plan_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type and refers_to to pages(page_id, url, html).

    Digests and ids are grouped first, with partial sums. Pages whose digest is not among the repeated ones pass with the
    scan. Of the others the payload is dropped before they are shuffled wherever a larger id with the same payload is seen
    in the same batch, so a payload of very many copies moves once a batch; a revisit's payload is null. Of rows that
    repeat the largest page_id of a payload all are responses. A null page_id never is what others refer to, unless no
    other page has its payload. Other columns stay; columns with the names added here are replaced.
    """
    bound_batches(pages.sparkSession)
    rows = pages.withColumn("payload", F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")).drop("html")
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = rows.where(F.col("payload_bytes") >= min_bytes)
    d, top, h = fresh(rows, "_d", "_first", "_h")
    first = large.groupBy(F.col("payload_digest").alias(d)).agg(F.max("page_id").alias(top), F.count("*").alias("n")).where("n > 1").drop("n")
    first = materialize(first, "warc-first")
    held = idset.build(first.select(F.xxhash64(d).alias("h")))
    keyed = rows.withColumn(h, F.when(F.col("payload_bytes") >= min_bytes, F.xxhash64("payload_digest")))
    some, rest = idset.split(keyed, h, held)
    names = some.columns
    schema = StructType([StructField(f.name, f.dataType, True) for f in some.schema])  # a payload may become null
    some = some.mapInArrow(_drop_known_revisits(*(names.index(x) for x in ("page_id", "payload", "payload_digest"))), schema)
    found = some.join(first, F.col("payload_digest") == F.col(d), "left").drop(d, h)
    revisit = F.col(top).isNotNull() & ~F.col("page_id").eqNullSafe(F.col(top))
    full, none = F.lit("response"), F.lit(None).cast(pages.schema["page_id"].dataType)
    found = found.withColumns({"record_type": F.when(revisit, "revisit").otherwise(full), "refers_to": F.when(revisit, F.col(top))}).drop(top)
    found = found.withColumn("payload", F.when(F.col("record_type") == "response", F.col("payload")))
    return found.unionByName(rest.drop(h).withColumns({"record_type": full, "refers_to": none}))


def _drop_known_revisits(id_at: int, payload_at: int, digest_at: int):
    """Payloads of rows that are not of the largest id of their digest in the batch become null: they are revisits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, digests = batch.column(id_at).to_pylist(), batch.column(digest_at).to_pylist()
            best: dict = {}
            for i, d in zip(ids, digests, strict=True):
                if best.get(d) is None or (i is not None and i > best[d]):
                    best[d] = i
            keep = pa.array([i == best[d] for i, d in zip(ids, digests, strict=True)], pa.bool_())
            columns = list(batch.columns)
            columns[payload_at] = pc.if_else(keep, columns[payload_at], pa.scalar(None, columns[payload_at].type))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def record_text(record_id, record_type, uri, digest, length, refers_to, payload, compact: bool = True):
    """One record without its end: header lines, an empty line, the block. Null lines are left out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    safe = F.regexp_replace(uri, "[\r\n]", "%0A")
    urn = lambda x: F.concat(F.lit("<urn:page:"), x.cast("string"), F.lit(">"))
    block = F.when(record_type == "revisit", F.lit("").cast("binary")).otherwise(payload)
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        line("WARC-Type", record_type),
        line("WARC-Record-ID", urn(F.coalesce(record_id.cast("string"), F.lit("")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", safe),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        line("WARC-Refers-To", urn(refers_to)),
        F.when(record_type == "revisit", line("WARC-Profile", F.lit(PROFILE))),
        line("X-Payload-Length", length),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(block)),
    )
    return F.concat(head.cast("binary"), F.lit("\r\n\r\n").cast("binary"), block).cast("string")


def write(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes records as planned by plan_revisits: fresh headers, payloads of responses only."""
    c = F.col
    text = record_text(c("page_id"), c("record_type"), c("url"), c("payload_digest"), c("payload_bytes"), c("refers_to"), c("payload"))
    out = records.select(text.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression)
    out.option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple]:
    """The records of one archive file, plain or gzip (one or many members); raises on a broken record."""
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            one = zlib.decompressobj(31)
            parts.append(one.decompress(data))
            if not one.eof:
                raise ValueError("gzip member ends too early")
            data = one.unused_data
        data = b"".join(parts)
    records = Records()
    records.add(data)
    yield from records.whole()
    records.close()


class Records:
    """Takes an archive's bytes piece by piece and gives its records, keeping no more than the one that is not yet whole."""

    def __init__(self):
        self.held, self.need, self.passed = bytearray(), 1, 0

    def add(self, data: bytes) -> None:
        self.held += data

    def whole(self) -> Iterator[tuple]:
        at = 0
        while len(self.held) - at >= self.need:
            end = self.held.find(END, at)
            if not self.held.startswith((b"WARC/", b"WARC/"[: len(self.held) - at]), at):
                raise ValueError(f"no record at byte {self.passed + at}")
            if end < 0:
                break
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in self.held[at:end].decode().split("\r\n")[1:])}
            size = int(head["content-length"])
            self.need = end + 8 + size - at
            if len(self.held) - at < self.need:
                break
            payload = bytes(self.held[end + 4 : end + 4 + size])
            if self.held[end + 4 + size : end + 8 + size] != END:
                raise ValueError(f"record at byte {self.passed + at} does not end where it says")
            digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
            if head["warc-type"] != "revisit" and digest and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"payload of record at byte {self.passed + at} does not have its digest")
            length = int(head.get("x-payload-length", size))
            yield (_bare(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"), digest, length, _bare(head.get("warc-refers-to")), payload)
            at, self.need = end + 8 + size, 1
        del self.held[:at]
        self.passed += at

    def close(self) -> None:
        if self.held:
            raise ValueError(f"record at byte {self.passed} ends too early")


def _bare(urn: str | None) -> str | None:
    return urn.removeprefix("<urn:page:").removesuffix(">") if urn is not None else None


_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
_NAMES = ["record_id", "record_type", "target_uri", "payload_digest", "payload_length", "refers_to", "payload"]


def _batched(records: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for row in records:
        rows.append(row)
        size += len(row[-1])
        if size > 4_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _parse_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _batched(row for batch in batches for value in batch.column(0) for row in parse(value.as_py()))


def _parse_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, piece): the pieces of each file between record ends, in order."""

    def last(records: Records) -> Iterator[tuple]:
        # whether a record end follows the last piece is not told: it is where a record still waits for it
        if records.held:
            records.add(END)
            yield from records.whole()
        records.close()

    def rows() -> Iterator[tuple]:
        name, records = None, Records()
        for batch in batches:
            for file, piece in zip(batch.column(0), batch.column(1), strict=True):
                if (file := file.as_py()) != name:
                    yield from last(records)
                    name, records = file, Records()
                else:
                    records.add(END)
                records.add(piece.as_py())
                yield from records.whole()
        yield from last(records)

    yield from _batched(rows())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of every archive file below path; payload digests are checked.

    A gzip file is one task's stream of records. A plain file is one row of a task (2 GB at most), for streams of those would
    be cut between tasks at any byte.
    """
    bound_batches(spark)
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "part-*[!z]").load(path).select("content")
    packed = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "part-*.gz").text(path)
    packed = packed.select(F.col("_metadata.file_path"), F.col("value").cast("binary"))
    return plain.mapInArrow(_parse_files, SCHEMA).unionByName(packed.mapInArrow(_parse_pieces, SCHEMA))


def resolve(records: DataFrame) -> DataFrame:
    """Joins revisit records with the responses they refer to: payload and length are then those of the original."""
    revisits = records.where("record_type = 'revisit'").drop("payload", "payload_length")
    originals = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("_d"), F.col("record_id").alias("_r"))
    originals = originals.agg(F.first("payload").alias("payload"), F.max("payload_length").alias("payload_length"))
    full = revisits.join(originals, (F.col("payload_digest") == F.col("_d")) & (F.col("refers_to") == F.col("_r")), "left").drop("_d", "_r")
    return records.where("record_type <> 'revisit'").unionByName(full)


def round_trip(pages: DataFrame) -> DataFrame:
    """The op7 contract: pages are written as deduplicated archives in the shared folder, and read back from there.

    An empty or null html is an empty payload; url may be null. An empty table gives an archive without records. Length and
    digest are of the payload that was read, for a revisit that of the response it names; one that names none is an error.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(plan_revisits(pages.select("page_id", "url", "html")), path)
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.when(F.length(c) > 0, F.col(c).cast(kind))
    # of each payload only what is asked of it goes on, so that resolving moves no payloads
    measured = F.struct(F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("digest"))
    found = resolve(materialize(read(spark, path).withColumn("payload", measured), "warc-records"))
    lost = F.raise_error(F.concat(F.lit("no response for the revisit record "), F.coalesce("record_id", F.lit(""))))
    payload = F.when(F.col("payload").isNull(), lost).otherwise(F.col("payload"))
    return found.withColumn("payload", payload).select(
        page("record_id").alias("page_id"),
        F.col("payload.bytes").alias("payload_bytes"),
        F.col("payload.digest").alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages
), w AS (
  SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM w
"""
