"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words its source has sent up to and including it, divided by
the source's target. Copies are then range-sorted by that time over all sources and the mix is cut at the total budget.
A source whose target exceeds its size sends its documents again, up to ``max_repeats`` times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .runtime import materialize, space_words

MAX_REPEATS = 3
#: Slices of a source's shuffled order. Only sums of slices are ever brought together, so a hot source spreads over all tasks.
SLICES = 1024
#: Ranges of finish time whose sums the driver compares, twice in a row.
RANGES = 4096
#: Columns of the result.
ADDED = ("source_size", "target", "copies", "taken")


def text_size(text: Column) -> Column:
    return F.size(space_words(text)).cast("long")


def shuffle_key(key: Column) -> Column:
    """The place of a document in its source's shuffled order: the first 60 bits of the md5 of its id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Column | None = None, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row a source.

    Sources in code point order, null last, weigh 1, 2, 3, repeating, unless ``weights`` gives another expression over
    ``rank``. A target stops at ``max_repeats`` times the size; the excess goes to the others by weight. With caps sorted
    by cap/weight, the first source whose fair level is below its own ratio fixes the level of all that follow, so one
    running sum replaces the rounds of resharing. A source of no words has target 0.
    """
    order = W.orderBy(F.col("source").isNull(), F.col("source"))
    weight = weights if weights is not None else (F.col("rank") - 1) % 3 + 1
    ranked = sizes.withColumn("rank", F.row_number().over(order)).withColumn("weight", weight.cast("long"))
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(max_repeats).cast("long"))
    capped = capped.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    levelled = capped.select(
        "*",
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("weight_before"),
        F.sum("source_size").over(everything).alias("all_size"),
        F.sum("weight").over(everything).alias("all_weight"),
    ).withColumn("level", (F.col("all_size") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
    fair = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(everything)["level"]
    filled = F.least(F.col("cap").cast("double"), fair * F.col("weight"))
    return levelled.select("source", "source_size", F.coalesce(filled, F.lit(0.0)).alias("target"))


def mix(sized: DataFrame, targets: DataFrame | None = None, max_repeats: int = MAX_REPEATS, slices: int = SLICES) -> DataFrame:
    """Adds source_size, target, copies and taken to sized(doc_id, source, size, ...).

    taken is the number of words of the document in the mix, repeats counted, at most max_repeats * size.
    Null sources are one source of their own. Documents of no words take nothing. Rows that repeat an id are separate
    documents next to each other in the order. An empty table gives an empty result.
    Columns of other names pass through, whatever their names, and are written to the shared folder, so leave long texts
    out. Columns source_size, target, copies and taken of the input are replaced.
    """
    own = [c for c in sized.columns if c.lower() in ("doc_id", "source", "size")]
    others = [c for c in sized.columns if c not in own and c.lower() not in ADDED]
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("_rest")] if others else []
    by_slice = F.floor(F.col("_h") / F.lit((1 << 60) // slices)).cast("int")
    base = sized.select(*own, *rest, shuffle_key(F.col("doc_id")).alias("_h")).withColumn("_slice", by_slice)
    base = materialize(base, "mix-sizes")
    sums = base.groupBy("source", "_slice").agg(F.sum("size").alias("_sum"))
    if targets is None:
        totals = base.groupBy("source").agg(F.sum("size").alias("source_size"))
        targets = source_targets(totals, max_repeats=max_repeats)
    running = W.partitionBy("source").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("source", "_slice", F.coalesce(F.sum("_sum").over(running), F.lit(0)).alias("_before"))
    offsets = offsets.join(targets.withColumnRenamed("source", "_src"), F.col("source").eqNullSafe(F.col("_src"))).drop("_src")
    offsets = offsets.withColumnsRenamed({"source": "_src", "_slice": "_s"})
    placed = base.join(offsets, F.col("source").eqNullSafe(F.col("_src")) & (F.col("_slice") == F.col("_s"))).drop("_src", "_s")
    inside = W.partitionBy("source", "_slice").orderBy("_h", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("_cum", F.col("_before") + F.sum("size").over(inside)).drop("_before", "_slice")
    placed = materialize(placed, "mix-placed")
    cut = _budget_cut(placed, max_repeats)
    key = ("_h", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    copies = sum(((F.col("size") > 0) & (F.struct(_finish(F.lit(e)), *key) <= cut)).cast("int") for e in range(max_repeats))
    out = placed.withColumn("copies", F.coalesce(copies, F.lit(0)))
    out = out.withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
    kept = [F.col(c) if c in own else F.col(f"_rest.`{c}`") for c in sized.columns if c in own or c in others]
    return out.select(*kept, *ADDED)


def _finish(copy: Column) -> Column:
    sent = copy.cast("long") * F.col("source_size") + F.col("_cum")
    return F.when(F.col("target") > 0, sent / F.col("target")).otherwise(F.lit(float("inf")))


def _budget_cut(placed: DataFrame, max_repeats: int) -> Column:
    """The last (finish time, shuffle key, id) of the globally sorted copies that the total budget covers, as a literal.

    The sort is by ranges of finish time: the sums of coarse ranges, then of fine ranges within one of them, find the one
    fine range in which the budget ends, and only its copies are sorted row by row. The driver sees at most RANGES sums.
    """
    copies = (
        placed.where("size > 0")
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
        .select(_finish(F.col("_copy")).alias("_f"), "_h", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "size")
    )
    room = placed.agg(F.sum("size")).first()[0] or 0
    low, width = 0.0, 2.0
    for _ in range(2):
        step = width / RANGES
        place = F.least(F.floor((F.col("_f") - F.lit(low)) / F.lit(step)), F.lit(RANGES - 1))
        inside = copies.where((F.col("_f") >= F.lit(low)) & (F.col("_f") < F.lit(low + width if width < 2 else float("inf"))))
        at = 0
        for at, size in sorted(inside.groupBy(place.alias("_at")).agg(F.sum("size")).collect()):
            if size > room:
                break
            room -= size
        else:
            at += 1
        low, width = low + at * step, step
    order = W.orderBy("_f", "_h", "_id").rowsBetween(W.unboundedPreceding, 0)
    tail = copies.where((F.col("_f") >= F.lit(low)) & (F.col("_f") < F.lit(low + width)))
    tail = tail.withColumn("_in", F.sum("size").over(order))
    found = tail.where(F.col("_in") <= F.lit(room)).agg(F.max(F.struct("_f", "_h", "_id")).alias("m")).first()
    last = found["m"] if found and found["m"] else (low, -1, "")
    return F.struct(F.lit(float(last[0])), F.lit(int(last[1])).cast("long"), F.lit(last[2]))


def mix_documents(docs: DataFrame) -> DataFrame:
    """The op3 contract over documents: doc_id, size, source_size, target, taken, and copies."""
    sized = docs.select("doc_id", "source", text_size(F.col("text")).alias("size"))
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(concat('0x', substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM s
), w AS (
  SELECT *, (rank - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM r
), v AS (
  SELECT *, cap / weight AS ratio FROM w
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))
          / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM v WINDOW b AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), f AS (
  SELECT level AS fair FROM l WHERE level <= ratio ORDER BY ratio, rank LIMIT 1
), t AS (
  SELECT source, source_size, coalesce(least(CAST(cap AS DOUBLE), fair * weight), 0) AS target FROM l CROSS JOIN f
), c AS (
  SELECT d.*, t.source_size, t.target,
         sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT c.*, copy, CAST(copy * source_size + cum AS DOUBLE) / target AS finish
  FROM c CROSS JOIN (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0
), o AS (
  SELECT *, sum(size) OVER (ORDER BY finish, h, coalesce(CAST(doc_id AS VARCHAR), '') ROWS UNBOUNDED PRECEDING) AS sent FROM e
), k AS (
  SELECT doc_id, h, cum, count(*) AS copies FROM o WHERE sent <= (SELECT sum(size) FROM d) GROUP BY doc_id, h, cum
)
SELECT c.doc_id, c.size, c.source_size, c.target, CAST(c.size * coalesce(k.copies, 0) AS BIGINT) AS taken,
       CAST(coalesce(k.copies, 0) AS INTEGER) AS copies
FROM c LEFT JOIN k ON c.doc_id = k.doc_id AND c.h = k.h AND c.cum = k.cum AND c.size > 0
"""
