"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; each is set if it is set in over half of the hashes of a text's word shingles. Fingerprints that
differ in MAX_BITS bits at most are linked. The bits are cut into segments whose radii sum to MAX_BITS - (segments - 1): of two
linked fingerprints some segment differs by its radius at most. Each fingerprint is filed in a table under every segment, and
fetches the entries within the segment's small Hamming ball; what meets is verified over all 64 bits.

Equal fingerprints are one class before anything is compared. A bucket of the index gives no pairs: its members are joined by a
spanning forest of their links, so the links written grow with the members. Buckets beyond LIMIT members are not gathered; their
members are linked exactly through the points they share within half the distance, in so many rows a member as such a ball has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .components import components
from .runtime import bound_batches, materialize

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
#: Members of a bucket that one task compares with each other.
LIMIT = 1 << 14
#: Fingerprints up to which three segments are used; beyond, two of 32 bits keep the buckets small.
FEW = 1 << 28
#: Words of a text that are hashed at a time.
BLOCK = 1 << 16
U = np.uint64


def fingerprint(data: bytes, starts: np.ndarray, ends: np.ndarray, n: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text given as its words, joined by one space each, and where they start and end."""
    words = len(starts)
    if not words:
        return 0
    size = min(n, words)
    total, votes = words - size + 1, np.zeros(64, np.int64)
    hashed, view = xxhash.xxh64_intdigest, memoryview(data)
    for k in range(0, total, BLOCK):
        last = min(total, k + BLOCK)
        runs = zip(starts[k:last].tolist(), ends[k + size - 1 : last + size - 1].tolist(), strict=True)
        values = np.fromiter((hashed(view[a:b], SEED) for a, b in runs), "<u8", last - k)
        votes += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > total, bitorder="little")
    return int(bits.view("<u8")[0])


def _joined(part: tokens.Slice, k: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A text's words, A-Z lower-cased, with one space between them."""
    a, b = part.word_offsets[k], part.word_offsets[k + 1]
    starts, ends = part.starts[a:b], part.ends[a:b]
    if a == b:
        return b"", starts, ends
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1]
    text = part.data[starts[0] : ends[-1]]
    inside = np.zeros(len(text) + 1, np.int32)
    inside[starts - starts[0]] += 1
    inside[ends - starts[0]] -= 1
    keep = np.cumsum(inside[:-1]).astype(bool)
    out = np.full(int(at[-1] + lengths[-1]), 0x20, np.uint8)
    hole = np.ones(len(out), bool)
    hole[at[1:] - 1] = False
    out[hole] = tokens.LOWER[text[keep]]
    return out.tobytes(), at, at + lengths


def _fingerprints(n: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(*_joined(part, k), n) for part in tokens.slices(batch.column(1)) for k in range(part.last - part.first)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, "<u8").view("<i8"), pa.int64())], names=["id", "fp"])

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """(id, fp) of each row: the 64 bits as a signed long. A text of fewer than n words is one shingle; one without words, empty
    or null, has 0. Texts of any length are hashed in blocks."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints(n), f"id {docs.schema[id_col].dataType.simpleString()}, fp long")


def segments(count: int, max_bits: int = MAX_BITS) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of the segments for so many fingerprints."""
    m = min(3 if count <= FEW else 2, max_bits + 1)
    bounds = [64 * k // m for k in range(m + 1)]
    return [(a, b - a, (max_bits - k) // m) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def _ball(bits: int, radius: int) -> np.ndarray:
    """All masks of up to radius of so many bits, the empty one first."""
    return np.array([sum(1 << k for k in chosen) for r in range(radius + 1) for chosen in combinations(range(bits), r)], U)


def _entries(parts: list[tuple[int, int, int]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(segment, key, fp, own) of each fingerprint: own entries under its segments, and the keys it fetches. Of two fingerprints
    at a distance in a segment the one with the smaller segment fetches, so a meeting is looked for from one side."""
    balls = [_ball(bits, radius)[1:] for _, bits, radius in parts]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for k, ((first, bits, _), ball) in enumerate(zip(parts, balls, strict=True)):
                mine = (fps >> U(first)) & U((1 << bits) - 1)
                rows = [(mine, fps, np.ones(len(fps), bool))]
                for mask in ball:
                    key = mine ^ mask
                    up = key > mine
                    rows.append((key[up], fps[up], np.zeros(int(up.sum()), bool)))
                key, fp, own = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k, np.int32)), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(own)], names=["segment", "key", "fp", "own"])

    return run


def _forest(members: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints."""
    left = members
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = np.bitwise_count(left ^ one) <= max_bits
            if near.any():
                found = left[near]
                queue.extend(found)
                left = left[~near]
                yield from ((int(one), int(x)) for x in found.view(np.int64))


def _links(max_bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(U)
            sizes = np.diff(offsets)
            pair = offsets[:-1][sizes == 2]
            a, b = flat[pair], flat[pair + 1]
            near = np.bitwise_count(a ^ b) <= max_bits
            out_a, out_b = [a[near].view(np.int64)], [b[near].view(np.int64)]
            for k in np.flatnonzero(sizes > 2):
                if found := list(_forest(np.unique(flat[offsets[k] : offsets[k + 1]]), max_bits)):
                    ends = np.array([(np.uint64(x).view(np.int64), y) for x, y in found], np.int64)
                    out_a.append(ends[:, 0])
                    out_b.append(ends[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a), pa.int64()), pa.array(np.concatenate(out_b), pa.int64())], names=["a", "b"])

    return run


def _points(radius: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    ball = _ball(64, radius)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(U)
            for k in range(0, len(fps), 256):
                some = fps[k : k + 256]
                yield pa.RecordBatch.from_arrays([pa.array((some[:, None] ^ ball[None, :]).ravel().view(np.int64)), pa.array(np.repeat(some, len(ball)).view(np.int64))], names=["point", "fp"])

    return run


def hub_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) that link distinct fingerprints(fp) exactly as all their links do, for an even max_bits.

    Two fingerprints are within max_bits just if some point is within half of it of both, so each is linked with the least
    fingerprint around every point of its ball. The rows are a fixed number a fingerprint, however close they are.
    """
    if max_bits % 2:
        raise ValueError("points half-way need an even distance")
    near = fps.select("fp").mapInArrow(_points(max_bits // 2), "point long, fp long")
    least = near.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a < z").drop("z")
    return near.join(least, "point").where("a < fp").select("a", F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, limit: int = LIMIT) -> DataFrame:
    """(a, b) between distinct fingerprints(fp): a set of true links that connects whatever all links connect."""
    fps = materialize(fps.select("fp"), "simhash-fps")
    parts = segments(fps.count(), max_bits)
    entries = fps.mapInArrow(_entries(parts), "segment int, key long, fp long, own boolean")
    sizes = entries.groupBy("segment", "key").agg(F.count("*").alias("n"), F.max("own").alias("met"))
    crowded = materialize(sizes.where(F.col("met") & (F.col("n") > limit)).select("segment", "key"), "simhash-crowded")
    hot = not crowded.isEmpty()
    small = entries.join(crowded, ["segment", "key"], "left_anti") if hot else entries
    buckets = small.groupBy("segment", "key").agg(F.collect_list("fp").alias("fps"), F.max("own").alias("met"))
    found = buckets.where(F.col("met") & (F.size("fps") > 1)).select("fps").mapInArrow(_links(max_bits), "a long, b long")
    if hot:
        members = entries.join(crowded, ["segment", "key"], "left_semi").select("fp").distinct()
        found = found.union(hub_links(materialize(members, "simhash-members"), max_bits))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, limit: int = LIMIT) -> DataFrame:
    """(id_col, fingerprint, component_id) of each row: its fingerprint as 16 hexadecimal digits, and the smallest id that links
    of max_bits differing bits reach.

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Repeated rows stay; a null id is
    linked but never the smallest unless a component has no other. Other columns are not looked at, whatever their names; an
    empty table gives none.
    """
    prints = materialize(fingerprints(docs, id_col, text, n), "simhash-docs")
    classes = materialize(prints.groupBy("fp").agg(F.min("id").alias("least")), "simhash-classes")
    found = materialize(links(classes, max_bits, limit), "simhash-links")
    groups = components(found, "a", "b").withColumnRenamed("id", "fp")
    named = classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    roots = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.select("fp", "component").join(roots, "component").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), shown.alias("fingerprint"), "component_id")


def _oracle() -> str:
    """DuckDB SQL of near_duplicates(documents): XXH64 from its definition, in 128-bit arithmetic, and every pair of fingerprints."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
    m = "18446744073709551616::UHUGEINT"
    low = lambda x: f"(({x}) % {m})"
    turn = lambda x, r: f"(({x}) * {1 << r}::UHUGEINT % {m} + ({x}) // {1 << (64 - r)}::UHUGEINT)"
    xor = lambda a, b: f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"
    word = lambda at, size: "('0x' || " + " || ".join(f"h[2 * ({at}) + {2 * k + 1}:2 * ({at}) + {2 * k + 2}]" for k in reversed(range(size))) + ")::UBIGINT::UHUGEINT"
    fold = lambda start, items, body: f"list_reduce([{start}] || list_transform({items}), lambda a, k: {body})"
    once = lambda a, k: low(f"{turn(low(f'{a} + ({k}) * {p2}'), 31)} * {p1}")
    lanes = [f"({SEED}::UHUGEINT + {p1} + {p2}) % {m}", f"({SEED}::UHUGEINT + {p2}) % {m}", f"{SEED}::UHUGEINT", f"({SEED}::UHUGEINT + {m} - {p1}) % {m}"]
    lanes = ", ".join(fold(v, f"range(0, n // 32), lambda i: {word(f'32 * i + {8 * j}', 8)}", once("a", "k")) + f" AS v{j}" for j, v in enumerate(lanes))
    merged = low(" + ".join(turn(f"v{j}", r) for j, r in enumerate((1, 7, 12, 18))))
    for j in range(4):
        merged = f"({xor(merged, once('0::UHUGEINT', f'v{j}'))} * {p1} + {p4}) % {m}"
    eights = fold("a0", f"range(n // 32 * 4, n // 8), lambda i: {word('8 * i', 8)}", low(f"{turn(xor('a', once('0::UHUGEINT', 'k')), 27)} * {p1} + {p4}"))
    four = low(f"{turn(xor('a1', low(f'{word("n // 8 * 8", 4)} * {p1}')), 23)} * {p2} + {p3}")
    ones = fold("a2", f"range(n // 4 * 4, n), lambda i: {word('i', 1)}", low(f"{turn(xor('a', low(f'k * {p5}')), 11)} * {p1}"))
    end = [("a4", xor("a3", f"a3 // {1 << 33}") + f" * {p2} % {m}"), ("a5", xor("a4", f"a4 // {1 << 29}") + f" * {p3} % {m}"), ("a6", xor("a5", f"a5 // {1 << 32}"))]
    votes = " + ".join(f"CASE WHEN 2 * count(*) FILTER (g[{k}] = '1') > count(*) THEN {1 << k}::UHUGEINT ELSE 0::UHUGEINT END" for k in range(64))
    votes = votes.replace("g[", "b[64 - ")
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({lower}, '[ \\t-\\r]+'), lambda x: x <> '') AS ws FROM documents),
    s AS (SELECT r, unnest(list_transform(range(1, greatest(len(ws) - {SHINGLE_WORDS - 2}, 2)), lambda i: array_to_string(ws[i:i + {SHINGLE_WORDS - 1}], ' '))) AS t FROM w WHERE len(ws) > 0),
    d AS (SELECT t, hex(t) AS h, length(hex(t)) // 2 AS n FROM (SELECT DISTINCT t FROM s)),
    l AS (SELECT *, {lanes} FROM d),
    x0 AS (SELECT t, h, n, (CASE WHEN n >= 32 THEN {merged} ELSE {SEED}::UHUGEINT + {p5} END + n::UHUGEINT) % {m} AS a0 FROM l),
    x1 AS (SELECT *, {eights} AS a1 FROM x0), x2 AS (SELECT *, CASE WHEN n % 8 >= 4 THEN {four} ELSE a1 END AS a2 FROM x1),
    x3 AS (SELECT *, {ones} AS a3 FROM x2), x4 AS (SELECT *, {end[0][1]} AS a4 FROM x3), x5 AS (SELECT *, {end[1][1]} AS a5 FROM x4),
    x6 AS (SELECT t, lpad(bin(({end[2][1]})::UBIGINT), 64, '0') AS b FROM x5),
    f AS (SELECT r, ({votes})::UBIGINT AS fp FROM s JOIN x6 USING (t) GROUP BY r),
    p AS (SELECT doc_id, coalesce(fp, 0::UBIGINT) AS fp FROM w LEFT JOIN f USING (r)),
    c AS (SELECT fp, min(doc_id) AS least FROM p GROUP BY fp),
    k AS (SELECT a.fp AS a, b.fp AS b FROM c a JOIN c b ON bit_count(xor(a.fp, b.fp)) <= {MAX_BITS}),
    go(a, b) AS (SELECT fp, fp FROM c UNION SELECT go.a, k.b FROM go JOIN k ON go.b = k.a),
    g AS (SELECT a AS fp, min(least) AS component_id FROM go JOIN c ON c.fp = go.b GROUP BY a)
    SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM p JOIN g USING (fp)"""


ORACLE = _oracle()
