"""Benchmark decontamination by winnowing.

Of the K-gram hashes of a text the smallest in each window of WINDOW consecutive ones is kept, all of them on a tie. Two
texts that share LENGTH = K + WINDOW - 1 words in a row therefore keep a common hash. Documents and benchmark items are joined
on these fingerprints. A fingerprint carries the words that any window around it can have, so each meeting is extended word
by word where it is met; runs of LENGTH words or more are hits. Every shared window has a fingerprint of its own, so the
union of the runs is exactly the set of shared windows. Items of fewer words than LENGTH are joined as a whole by their hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import idset, tokens
from .runtime import bound_batches, fresh, materialize

LENGTH, K = 10, 5
WINDOW = LENGTH - K + 1
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnow(hashes: np.ndarray, ok: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions whose hash is the smallest of a window that holds it. ok: whether the K-gram lies in one text."""
    n = len(hashes)
    if n < window:
        return np.zeros(0, np.int64)
    held = np.where(ok, hashes, LAST)
    least = held[: n - window + 1].copy()
    for k in range(1, window):
        np.minimum(least, held[k : n - window + 1 + k], out=least)
    kept = np.zeros(n, bool)
    for k in range(window):
        kept[k : n - window + 1 + k] |= held[k : n - window + 1 + k] == least
    return np.flatnonzero(kept & ok)


def _around(words: np.ndarray, of: np.ndarray, at: np.ndarray, outside: int) -> np.ndarray:
    """For each K-gram position its words and the LENGTH - K before and behind it; outside stands for those of another text."""
    place = at[:, None] + np.arange(K - LENGTH, LENGTH)
    inside = (place >= 0) & (place < len(words))
    place = np.clip(place, 0, max(len(words) - 1, 0))
    return np.where(inside & (of[place] == of[at][:, None]), words[place], np.uint64(outside))


def _prints(part: tokens.Slice, outside: int, sizes: tuple[int, ...], whole: bool, held=None) -> tuple[np.ndarray, ...]:
    """(text, size, print, position, words around) of the texts of a slice, by text.

    Size 0 marks winnowed K-grams of texts of LENGTH words or more. Size n marks n-grams: with whole, that of each text that has
    just n words, else all of them. Only prints that the filter may hold, if one is given.
    """
    words, of = part.hashes, part.text_of_word()
    counts = np.diff(part.word_offsets)
    found = []
    for n in (0, *sizes):
        grams = tokens.grams(words, n or K)
        at = winnow(grams, tokens.gram_ok(part, K) & (counts[of[: len(grams)]] >= LENGTH)) if not n else np.flatnonzero(tokens.gram_ok(part, n) & (~np.bool_(whole) | (counts[of[: len(grams)]] == n)))
        if held is not None and len(at):
            at = at[idset.may_hold(held, pa.array(_filed(grams[at], n)))]
        around = _around(words, of, at, outside) if not n else np.zeros((len(at), 0), np.uint64)
        found += [(int(of[i]), n, int(g), int(i - part.word_offsets[of[i]]), x) for i, g, x in zip(at.tolist(), grams[at].view(np.int64).tolist(), around.view(np.int64), strict=True)]
    found.sort(key=lambda x: x[0])
    return found


def _filed(prints: np.ndarray, n: int) -> np.ndarray:
    """Prints as the filter has them, apart by size."""
    return tokens.mix64(prints ^ tokens.mix64(np.array([n + 1], np.uint64))).view(np.int64)


def _item_prints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, text) to (item, size, print, filed, around)."""
    for batch in batches:
        for part in tokens.slices(batch.column(1), tokens.LETTERS):
            rows = _prints(part, 1, tuple(range(1, LENGTH)), True)
            items = batch.column(0).slice(part.first, part.last - part.first).take(pa.array([r[0] for r in rows], pa.int64()))
            filed = [int(_filed(np.array([r[2]], np.int64).view(np.uint64), r[1])[0]) for r in rows]
            yield pa.RecordBatch.from_arrays([items, pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64()), pa.array(filed, pa.int64()), pa.array([r[4] for r in rows], pa.list_(pa.int64()))], names=["item", "size", "print", "filed", "around"])


_PRINT = pa.struct([("size", pa.int32()), ("print", pa.int64()), ("at", pa.int32()), ("around", pa.list_(pa.int64()))])


def _document_prints(held, sizes: tuple[int, ...]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row1, row2, doc_id, text) to (row1, row2, doc_id, n_words, prints): prints that the filter of item prints may hold."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch.column(3), tokens.LETTERS):
                n = part.last - part.first
                prints: list[list] = [[] for _ in range(n)]
                for text, size, value, at, around in _prints(part, 0, sizes, False, held.value):
                    prints[text].append({"size": size, "print": value, "at": at, "around": around})
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(part.first, n) for c in range(3)), pa.array(np.diff(part.word_offsets), pa.int64()), pa.array(prints, pa.list_(_PRINT))], names=["row1", "row2", "doc_id", "n_words", "prints"])

    return run


def _extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Meetings (row1, row2, item, size, at, mine, theirs) of equal prints to hits (row1, row2, item, first, last): the run of equal
    words around a K-gram, if it has LENGTH words, and the whole n-gram of a shorter item."""
    for batch in batches:
        size, at = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 4))
        long = np.flatnonzero(size == 0)
        first, last = at.copy(), at + size
        if len(long):
            width = 2 * LENGTH - K
            mine, theirs = (batch.column(c).take(pa.array(long)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for c in (5, 6))
            same = mine == theirs
            side = LENGTH - K
            back = np.cumprod(same[:, :side][:, ::-1], axis=1).sum(axis=1)
            ahead = np.cumprod(same[:, side + K :], axis=1).sum(axis=1)
            whole = same[:, side : side + K].all(axis=1) & (back + K + ahead >= LENGTH)
            first[long], last[long] = at[long] - back, np.where(whole, at[long] + K + ahead, -1)
        keep = pa.array(last >= 0)
        yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in range(3)), pa.array(first.astype(np.int32)).filter(keep), pa.array((last - 1).astype(np.int32)).filter(keep)], names=["row1", "row2", "item", "first", "last"])


def _keyed(docs: DataFrame, row: tuple[str, str] = ("row1", "row2")) -> DataFrame:
    """docs with two hashes of id and text, by which rows are told apart, in columns of the given names."""
    doc, text = F.col("doc_id").cast("string"), F.col("text").cast("string")
    return docs.withColumns({row[0]: F.xxhash64(doc.isNull(), doc, text), row[1]: F.xxhash64(F.lit(1), text, doc)})


def _meet(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every row with its number of words, hits(row1, row2, item, first, last)): documents and items joined by fingerprint.

    The benchmark's prints are a table. A filter of bounded size made of them lets few prints of other documents through to
    the join; where it is too full for a very large benchmark, more rows move and the result is the same.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    items = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    theirs = materialize(items.mapInArrow(_item_prints, "item string, size int, print long, filed long, around array<long>"), "decontaminate-items")
    sizes = tuple(sorted(r["size"] for r in theirs.where("size > 0").select("size").distinct().collect()))  # nine at most
    held = spark.sparkContext.broadcast(idset.build(theirs.select("filed")))
    rows = _keyed(docs.select("doc_id", "text")).select("row1", "row2", "doc_id", F.col("text").cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row1 long, row2 long, doc_id {kind}, n_words long, prints array<struct<size:int,print:long,at:int,around:array<long>>>"
    mine = materialize(rows.mapInArrow(_document_prints(held, sizes), schema), "decontaminate-prints")
    held.unpersist()
    told = mine.where("size(prints) > 0").select("row1", "row2", F.explode("prints").alias("p")).select("row1", "row2", "p.size", "p.print", "p.at", F.col("p.around").alias("mine"))
    met = told.join(theirs.select("size", "print", "item", F.col("around").alias("theirs")), ["size", "print"])
    hits = met.select("row1", "row2", "item", "size", "at", "mine", "theirs").mapInArrow(_extend, "row1 long, row2 long, item string, first int, last int")
    return mine.drop("prints"), hits


def find_contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_words, hits (positions of hit words) and items (ids whose windows occur).

    Words are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. A window is LENGTH consecutive
    words of an item, or all words of a shorter one; items without words have none. Null and empty texts have no words and
    no hits. Null item ids name no item, though their windows hit. Rows that repeat an id are told apart by their text, and
    repeated rows have the same hits each; equal item ids count once. Texts of any length are read whole; other columns are
    not read. Empty tables of documents or items give no row, or no hits.
    """
    rows, hits = _meet(docs, benchmark)
    hits = materialize(hits.distinct(), "decontaminate-hits")
    row = ["row1", "row2"]
    places = hits.select(*row, "first", "last").distinct().select(*row, F.explode(F.sequence("first", "last")).alias("at")).distinct()
    places = places.groupBy(*row).agg(F.array_sort(F.collect_list("at")).alias("_hits"))
    names = hits.where("item is not null").select(*row, "item").distinct().groupBy(*row).agg(F.array_sort(F.collect_list("item")).alias("_items"))
    found = rows.join(places.join(names, row, "left"), row, "left")
    return found.select("doc_id", "n_words", F.coalesce("_hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The op6 contract."""
    found = find_contamination(docs, benchmark)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, with all their columns; null and empty texts stay, as do
    repeated rows and null ids that are clean, and of an empty table or benchmark nothing goes. Long texts are looked at whole;
    other columns may have any names. Only rows that may be hit are shuffled."""
    _, hits = _meet(docs, benchmark)
    row = fresh(docs, "row1", "row2")
    hit = hits.select("row1", "row2").distinct().toDF(*row)
    hit = materialize(hit, "decontaminate-hit")
    some, rest = idset.split(_keyed(docs, row), row[0], idset.build(hit.select(row[0])))
    return rest.unionByName(some.join(hit, row, "left_anti")).select(*(F.col(f"`{c}`") for c in docs.columns))


def sha256_of(items: Iterable[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), ig AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM iw WHERE len(w) > 0)
), dn AS (
  SELECT DISTINCT n FROM ig
), dg AS (
  SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw CROSS JOIN dn WHERE len(w) >= n)
), m AS (
  SELECT doc_id, p, dg.n AS n, item_id FROM dg JOIN ig ON dg.n = ig.n AND dg.g = ig.g
), h AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN i ON d.doc_id = i.doc_id
"""
