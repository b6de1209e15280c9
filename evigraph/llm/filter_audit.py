"""Audit of how filters interact: what each of them removes, alone and in every order.

A row's failures are a mask of bits. A filter of repeated texts needs to know whether a smaller id has the same text: rows are
range-sorted by text fingerprint, text and id, and each is compared with its predecessor; what a task cannot see, the run that
goes on from the task before, is settled by one row a task. Masks are then summed to counters by part: they add up, so a part
of any size is summed before it is shuffled, and every order of the filters is worked out from its few counters alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.pandas.types import to_arrow_schema

from . import idset
from .runtime import bound_batches, materialize, space_words

#: The filters in the order of their bits; E is that of repeated texts.
LETTERS = "ABCDE"


def failures(text: Column) -> dict[str, Column]:
    """The filters that one text decides: whether it fails."""
    words = space_words(text)
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _repeats(held) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Leaves the text (last column) only where the fingerprint (first column) may be that of several rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = pa.array(idset.may_hold(held.value, batch.column(0)))
            text = pc.if_else(may, batch.column(batch.num_columns - 1), pa.scalar(None, batch.schema.field(batch.num_columns - 1).type))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=batch.schema.names)

    return run


def _predecessors(schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows (task, id, part, mask, print, text) in order of print, text and id: (task, id, part, mask, later, head, ends).

    later says that a smaller id of this task has the same text; head that the row is of the task's first run and has that
    run's smallest id. One row more a task holds its ends: the first and the last text by SHA-256, the smallest ids of their
    runs, and whether they are one run. Null ids are neither smaller nor later than others.
    """
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, least, runs, first = None, None, 0, None
        for batch in batches:
            out = []
            for task, one, part, mask, mark, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (mark, text) != key:
                    key, least, runs = (mark, text), one, runs + 1
                    first = first or (task, digest(text), one)
                known = one is not None and least is not None
                out.append((task, one, part, mask, known and one > least, known and runs == 1 and one == least, None))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
        if first:
            ends = {"first": first[1], "last": digest(key[1]), "begin": first[2], "least": least, "one_run": runs == 1}
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((first[0], None, None, None, False, False, ends), schema, strict=True)], schema=schema)

    return run


def _continued(ends: Iterable[Row]) -> list[int]:
    """The tasks whose first run goes on from the task before, where it has a smaller id; ends are those of all tasks in order."""
    found, text, smallest = [], None, None
    for x in ends:
        least = x["least"]
        if x["first"] == text:
            if smallest is not None and x["begin"] is not None and smallest < x["begin"]:
                found.append(x["task"])
            least = smallest if x["one_run"] else least
        text, smallest = x["last"], least
    return found


def mark(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(id, part, mask) of each row: bit k of mask is set if the row fails the k-th filter, A to E.

    A null text is empty and equals other empty ones, a null part is the empty string. A row with a null id fails by other
    filters only; of rows with equal ids none is smaller. Repeated rows each count, other columns are not looked at, whatever
    their names, texts are looked at whole. A text that may be of several rows (a filter of bounded size says so) moves once, to
    be sorted; of all others only the mask is kept.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    prints = rows.select(F.xxhash64("text").alias("print")).groupBy("print").agg(F.count("*").alias("n"))
    held = spark.sparkContext.broadcast(idset.build(prints.where("n > 1").select("print")))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(failures(F.col("text")).values())), F.lit(0))
    rows = rows.select(F.xxhash64("text").alias("print"), "id", "part", bits.cast("int").alias("mask"), "text")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialize(rows.mapInArrow(_repeats(held), f"print long, id {kind}, part string, mask int, text string"), "audit-rows")
    some = rows.where("text is not null").withColumn("md5", F.md5(F.col("text").cast("binary")))
    some = some.repartitionByRange("print", "md5", F.col("id").asc_nulls_last()).sortWithinPartitions("print", "md5", "text", F.col("id").asc_nulls_last())
    some = some.select(F.spark_partition_id().alias("task"), "id", "part", "mask", "print", "text")
    schema = f"task int, id {kind}, part string, mask int, later boolean, head boolean, ends struct<first:string,last:string,begin:{kind},least:{kind},one_run:boolean>"
    seen = materialize(some.mapInArrow(_predecessors(to_arrow_schema(spark.createDataFrame([], schema).schema)), schema), "audit-seen")
    ends = seen.where("ends is not null").select("task", "ends.*").orderBy("task").collect()  # one row a task
    heads = F.col("head") & F.col("task").isin(_continued(ends))
    known = seen.where("ends is null").select("id", "part", F.when(F.col("later") | heads, F.col("mask").bitwiseOR(F.lit(1 << 4))).otherwise(F.col("mask")).alias("mask"))
    return rows.where("text is null").select("id", "part", "mask").unionByName(known)


def count(marked: DataFrame, labels: DataFrame, label_id: str = "doc_id", good: Column | None = None, toxic: Column | None = None) -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of each part have each mask, and how many of them are labelled so.

    An id with several labels counts if any says so. Rows are summed before they move, so a part of any size is as good as one.
    """
    good = F.col("quality") == 1 if good is None else good
    toxic = F.col("toxic") == 1 if toxic is None else toxic
    one = labels.groupBy(F.col(label_id).alias("id")).agg(F.max(F.coalesce(good, F.lit(False))).alias("good"), F.max(F.coalesce(toxic, F.lit(False))).alias("toxic"))
    rows = marked.join(one.where("good or toxic"), "id", "left")
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def audit(counters: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row a part, order of the filters and step, from counters of masks (2 ** filters at most a part).

    kept, removed and redundant tell what the step's filter leaves, removes, and would have removed had no earlier one;
    unique_fails what fails it alone; good_lost and toxic_lost the labelled rows it removes; shapley what it removes, summed over
    all orders: a row that fails k filters is removed by each of them in one k-th of the orders.
    """
    bits = {x: 1 << k for k, x in enumerate(letters)}
    orders = ["".join(x) for x in permutations(letters)]
    held = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    rows = held.select("part", "held", F.explode(F.array(*map(F.lit, orders))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    gone = F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)
    own = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    rows = rows.withColumns({"before": sum((F.when(gone.contains(x), b).otherwise(0) for x, b in bits.items()), F.lit(0)), "own": sum((F.when(own == x, b).otherwise(0) for x, b in bits.items()), F.lit(0))})
    has = lambda x, mask: x["mask"].bitwiseAND(F.col(mask)) != 0
    removed = lambda x: has(x, "own") & ~has(x, "before")
    share = lambda x: F.lit(len(orders)) / F.bit_count(x["mask"])
    total = lambda value: F.aggregate("held", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(value(x), F.lit(0)).cast("long"))
    return rows.select(
        "part", "filter_order", "step",
        total(lambda x: F.when(~has(x, "own") & ~has(x, "before"), x["n"])).alias("kept"),
        total(lambda x: F.when(removed(x), x["n"])).alias("removed"),
        total(lambda x: F.when(has(x, "own") & has(x, "before"), x["n"])).alias("redundant"),
        total(lambda x: F.when(x["mask"] == F.col("own"), x["n"])).alias("unique_fails"),
        total(lambda x: F.when(removed(x), x["good"])).alias("good_lost"),
        total(lambda x: F.when(removed(x), x["toxic"])).alias("toxic_lost"),
        total(lambda x: F.when(has(x, "own"), x["n"] * share(x))).alias("shapley"),
    )


def _oracle() -> str:
    orders = ", ".join(f"('{''.join(x)}')" for x in permutations(LETTERS))
    bit = lambda x: f"(1 << (ascii({x}) - 65))"
    before = f"list_sum([0] || list_transform(range(1, step), lambda i: {bit('filter_order[i]')}))"
    return f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \t-\r]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    m AS (SELECT doc_id, part, CAST(len(ws) < 50 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 65 * len(ws) AS INT)
        + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS INT) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(least < doc_id, false) AS INT) AS mask FROM w),
    l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1),
    c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
    o(filter_order) AS (VALUES {orders}), s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
    b AS (SELECT *, CAST({bit('filter_order[step]')} AS INT) AS own, CAST({before} AS INT) AS gone FROM s)
    SELECT part, filter_order, step, CAST(coalesce(sum(n) FILTER (mask & (own | gone) = 0), 0) AS BIGINT) AS kept,
      CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & gone = 0), 0) AS BIGINT) AS removed,
      CAST(coalesce(sum(n) FILTER (mask & own <> 0 AND mask & gone <> 0), 0) AS BIGINT) AS redundant,
      CAST(coalesce(sum(n) FILTER (mask = own), 0) AS BIGINT) AS unique_fails,
      CAST(coalesce(sum(good) FILTER (mask & own <> 0 AND mask & gone = 0), 0) AS BIGINT) AS good_lost,
      CAST(coalesce(sum(toxic) FILTER (mask & own <> 0 AND mask & gone = 0), 0) AS BIGINT) AS toxic_lost,
      CAST(coalesce(sum(n * 120 // bit_count(CASE WHEN mask = 0 THEN 1 ELSE mask END)) FILTER (mask & own <> 0), 0) AS BIGINT) AS shapley
    FROM c CROSS JOIN b GROUP BY part, filter_order, step"""


ORACLE = _oracle()
