"""N-gram Jaccard join: documents linked by the similarity of their sets of word n-grams, and the groups links make.

N-grams are 64-bit hashes, and the order of those is the global order of n-grams. Links are decided on whole sets of these
hashes, so results are exact up to their collision. The steps, each a distributed table in the shared folder:

1. One pass hashes every text to its set's size and 128-bit fingerprint. Texts with equal sets form a class, whose smallest
   id stands for it from here on. The same pass keeps a mark of the set: the ordered set cut into ranges of the global order,
   four bits for each range. Two sets that differ in d n-grams differ in at most d ranges of their marks.
2. Sets of sizes a and b that link differ in at most k(a, b) n-grams. Cut into P > k ranges, they agree in P - k whole
   ranges at least. A set's tokens are its ranges with what is in them; of two sets that link, the fullest range that both
   share is among the k + 1 fullest of either. Rows (token, class) of these are dealt by token and those of one class drop
   out. A token holds several n-grams at once, so common n-grams and common passages do not bring unlike sets together.
   Rows that share a token within one batch are known to be shared there and are dealt at random: a hot token is one row a batch.
3. Each class is checked with one hub, the most central class of its tokens, so the number of pairs follows the number of
   classes; the links found join classes to components. This is repeated while many pairs of different components are left.
4. Classes at a token that is not in one component go into two prefix trees of their marks, one of the largest component
   and one of the others. The second is traversed against itself and against the first: all below two nodes share the
   differences counted up to there, and two subtrees are left as soon as what differs is more than sets of that size may
   (what agrees so far and all that remains is less than required). Large groups are cut into cells of bounded size.
5. The pairs that the trees leave are checked on whole sets, again in a prefix tree for each hub.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import idset, tokens
from .components import components, nearby_labels
from .runtime import bound_batches, discard, materialize

U = np.uint64
#: Ranges for each one that may differ: in tokens, and in marks.
SPREAD, FINE = 1.3, 4
#: Ranges of a mark at least and at most; a coarser mark only leaves more pairs to check on whole sets.
LEAST_MARK, MARK = 512, 1 << 14
#: Sets below this size have single n-grams as tokens: their ranges would often be empty.
TINY = 20
#: Tokens that a task looks through for shared ones at a time.
LOOK = 400_000
#: Sets in one tree at most, about: of a hub, and of one side of a token's cell.
TREE, CELL = 256, 1024
#: Rounds of hubs at most; the pairs left for each row, and the pairs for each link that a round has found, at which no further
#: round is worth it. Pairs that are left then all go through the trees.
ROUNDS, FEW, PAYS = 6, 4, 50
#: Ranges of a mark in one step down a tree; groups of so few rows are compared in one step.
STEP, FLAT = 32, 24
#: Pairs of nodes that a tree join looks at, at a time.
WINDOW = 1 << 15


def required(a, b, num: int, den: int):
    """The overlap that sets of sizes a and b need so that den * overlap >= num * union."""
    return -((-num * (a + b)) // (den + num))


def may_differ(a, b, num: int, den: int):
    """The n-grams at most that are in only one of two linked sets of sizes a and b."""
    return (a + b) * (den - num) // (den + num)


@lru_cache
def _bands() -> np.ndarray:
    """The first sizes of bands, each about 1.5 times the one before."""
    at = [1]
    while at[-1] < 1 << 40:
        at.append(max(at[-1] + 1, -(-at[-1] * 3 // 2)))
    return np.array(at, np.int64)


def bands(size: int, num: int, den: int) -> range:
    """The bands in which a set meets its partners, from its own down: a pair meets in the band of its smaller set."""
    own, last = (int(np.searchsorted(_bands(), x, side="right")) - 1 for x in (size, max(1, -(-num * size // den))))
    return range(own, last - 1, -1)


@lru_cache(maxsize=4096)
def _band(band: int, num: int, den: int) -> tuple[int, int]:
    """The largest size of a pair's smaller set in a band, and the most n-grams that a pair differs in."""
    top = int(_bands()[band + 1]) - 1
    return top, may_differ(top, top * den // num, num, den)


@lru_cache(maxsize=256)
def _edges(n: int) -> np.ndarray:
    """The first hash of each of n equal ranges but the first."""
    return np.arange(1, n, dtype=np.uint64) * U((1 << 64) // n) if n > 1 else np.zeros(0, U)


def _ranges(values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, hash) of the n-grams of a sorted set in each of n ranges of the global order."""
    ends = np.concatenate([[0], np.searchsorted(values, _edges(n)), [len(values)]])
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, U), np.cumsum(tokens.mix64(values + U(0x51ED270B0A1F39C1)), dtype=U)])[ends]
        return np.diff(ends), sums[1:] - sums[:-1]


def mark(values: np.ndarray, band: int, num: int, den: int) -> bytes:
    """The set as four bits for each range of the global order: equal sets of n-grams in a range have equal bits."""
    n = FINE * (_band(band, num, den)[1] + 1)
    _, sums = _ranges(values, min(MARK, max(LEAST_MARK, -(-n // STEP) * STEP)))
    bits = (tokens.mix64(sums) >> U(60)).astype(np.uint8)
    return (bits[::2] << 4 | bits[1::2]).tobytes()


def unpacked(marks: np.ndarray) -> np.ndarray:
    """Marks, one a row, with a byte for each range."""
    return np.stack([marks >> 4, marks & 15], axis=2).reshape(len(marks), -1)


def band_tokens(values: np.ndarray, band: int, num: int, den: int) -> np.ndarray:
    """The tokens by which a set meets its partners in a band."""
    size, (top, most) = len(values), _band(band, num, den)
    with np.errstate(over="ignore"):
        salt = tokens.mix64(np.array([band], np.uint64) + U(0xC2B2AE3D27D4EB4F))
        if top < TINY:
            return tokens.mix64(values[: size + (-num * size) // den + 1] ^ salt)
        counts, sums = _ranges(values, int(np.ceil((most + 1) * SPREAD)))
        found = tokens.mix64(sums ^ tokens.mix64(salt + np.arange(len(sums), dtype=U)))
        own = may_differ(size, min(top, size) if size > top else size * den // num, num, den) + 1
        return found[np.lexsort((found, -counts))[:own]]


def _fingerprint(values: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        one = int(tokens.mix64(values ^ U(0xA5A5A5A5DEADBEEF)).sum(dtype=U))
        two = int(tokens.mix64(values + U(0x165667B19E3779F9)).sum(dtype=U))
    return int(U(one).view(np.int64)), int(U(two).view(np.int64))


def _signatures(n: int, num: int, den: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch.column(1)):
                sizes, prints, marks = [], [], []
                for values in tokens.shingle_sets(part, n):
                    sizes.append(len(values))
                    prints.append(_fingerprint(values))
                    marks.append([mark(values, band, num, den) for band in bands(len(values), num, den)] if len(values) else [])
                m = len(sizes)
                ids = batch.column(0).slice(part.first, m).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1)), pa.array(marks, pa.list_(pa.binary()))], names=["id", "n_shingles", "f1", "f2", "marks"])

    return run


def _token_lists(n: int, num: int, den: int, held, inside: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts (id, text) whose id may be in the filter, or may not, to (id, lower, token): lower counts bands below the set's own."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(idset.may_hold(held.value, batch.column(0)) == inside))
            waiting, count = [], 0
            for part in tokens.slices(batch.column(1)):
                ids = batch.column(0).slice(part.first, part.last - part.first).cast(pa.int64()).to_pylist()
                for i, values in zip(ids, tokens.shingle_sets(part, n), strict=True):
                    for lower, band in enumerate(bands(len(values), num, den) if len(values) else ()):
                        if not _band(band, num, den)[1]:  # sets that link are equal here, and those are one class already
                            continue
                        waiting.append((i, lower, band_tokens(values, band, num, den)))
                        count += len(waiting[-1][2])
                if count >= LOOK:
                    yield _flat(waiting)
                    waiting, count = [], 0
            if waiting:
                yield _flat(waiting)

    return run


def _flat(lists: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(x[2]) for x in lists]
    flat = np.concatenate([x[2] for x in lists]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([x[0] for x in lists], np.int64), sizes)), pa.array(np.repeat(np.array([x[1] for x in lists], np.int8), sizes)), pa.array(flat)], names=["id", "lower", "token"])


def _dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows (id, lower, token) to (at, id, lower, known, token): at says where the row is dealt to. Of the rows of a token that
    are several here, which are known to be shared, one goes to the token's place, the others anywhere."""
    flat = batch.column(2).to_numpy(zero_copy_only=False)
    order = np.argsort(flat, kind="stable")
    again = np.zeros(len(flat), bool)
    again[order[1:]] = flat[order[1:]] == flat[order[:-1]]
    known = again.copy()
    known[order[:-1]] |= again[order[1:]]
    with np.errstate(over="ignore"):
        anywhere = tokens.mix64(flat.view(U) + tokens.mix64(batch.column(0).to_numpy(zero_copy_only=False).view(U)))
    at = np.where(again, anywhere.view(np.int64), flat)
    return pa.RecordBatch.from_arrays([pa.array(at), batch.column(0), batch.column(1), pa.array(known), pa.array(flat, mask=~again)], names=["at", "id", "lower", "known", "token"])


def _pre_aggregated(rows: Callable) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            yield _dealt(batch)

    return run


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (at, token) to those (token, id, lower) whose token is not alone; one row is carried between batches."""
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if last is None else [last, batch]).combine_chunks()
        away = table.column("token").is_valid().to_numpy()
        at = table.column("at").to_numpy()
        same = (at[1:] == at[:-1]) & ~away[1:] & ~away[:-1]
        keep = table.column("known").to_numpy()
        keep = keep.copy() if not keep.flags.writeable else keep
        keep[1:] |= same
        keep[:-1] |= same
        table = table.set_column(table.schema.get_field_index("known"), "known", pa.array(keep))
        last = table.slice(len(table) - 1).to_batches()[0] if len(table) else None
        yield from _kept(table.slice(0, max(0, len(table) - 1)), keep[:-1])
    if last is not None:
        yield from _kept(pa.Table.from_batches([last]), last.column("known").to_numpy(zero_copy_only=False))


def _kept(table: pa.Table, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = table.filter(pa.array(keep))
    yield from pa.table({"token": pc.coalesce(table.column("token"), table.column("at")), "id": table.column("id"), "lower": table.column("lower")}).to_batches()


class Trie:
    """Marks of equal length as a prefix tree: rows sorted, and for each depth the first row of every node. A tree of step as
    long as the marks is a root with a leaf for each row."""

    def __init__(self, marks: np.ndarray, step: int = STEP):
        if step == marks.shape[1]:
            self.depth, self.order, self.steps, self.split = 1, np.arange(len(marks)), marks[:, None], np.zeros(len(marks), int)
            return
        self.order = np.argsort(np.ascontiguousarray(marks).view(f"V{marks.shape[1]}").ravel(), kind="stable")
        steps = marks[self.order].reshape(len(marks), -1, step)
        differ = (steps[1:] != steps[:-1]).any(axis=2)
        self.depth = steps.shape[1]
        split = np.where(differ.any(axis=1), differ.argmax(axis=1), self.depth) if len(marks) > 1 else np.zeros(0, int)
        self.split = np.concatenate([[-1], split])  # the depth at which a row leaves the one before it
        self.steps = steps

    def children(self, nodes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first child's place, number of children) of nodes, given by their first rows, and the rows of all children at a depth.
        At the last depth every row is a child of its own."""
        rows = np.flatnonzero(self.split <= depth) if depth < self.depth - 1 else np.arange(len(self.split))
        parents = np.flatnonzero(self.split < depth) if depth else np.zeros(1, int)
        at = np.searchsorted(rows, parents)
        counts = np.diff(np.append(at, len(rows)))
        which = np.searchsorted(parents, nodes)
        return at[which], counts[which], rows


def trie_pairs(one: Trie, two: Trie | None, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (i, j) of rows whose marks differ in at most `most` ranges, of one and two or, for two None, both of one, each pair
    once; and in how many they differ."""
    other = one if two is None else two
    found = [np.zeros((3, 0), int)]
    waiting = [_below(one, other, np.zeros((3, 1), int), 0, most, two is None)]
    while waiting:
        pairs = next(waiting[-1], None)
        if pairs is None:
            waiting.pop()
        elif len(waiting) == one.depth:
            found.append(pairs if two is not None else pairs[:, pairs[0] != pairs[1]])
        elif pairs.shape[1]:
            waiting.append(_below(one, other, pairs, len(waiting), most, two is None))
    u, v, apart = np.concatenate(found, axis=1)
    return one.order[u], other.order[v], apart


def _below(one: Trie, other: Trie, pairs: np.ndarray, depth: int, most: int, same: bool) -> Iterator[np.ndarray]:
    """Pairs of children of pairs (u, v, apart) of nodes, in windows of bounded size, without those too far apart."""
    u, v, apart = pairs
    ua, un, urows = one.children(u, depth)
    va, vn, vrows = other.children(v, depth)
    ends = np.cumsum(un * vn)
    for lo in range(0, int(ends[-1]) if len(ends) else 0, WINDOW):
        at = np.arange(lo, min(lo + WINDOW, int(ends[-1])))
        pair = np.searchsorted(ends, at, side="right")
        place = at - (ends - un * vn)[pair]
        cu, cv = urows[ua[pair] + place // vn[pair]], vrows[va[pair] + place % vn[pair]]
        if same:  # below a node paired with itself, each pair of children once
            keep = (u[pair] != v[pair]) | (cu <= cv)
            pair, cu, cv = pair[keep], cu[keep], cv[keep]
        now = apart[pair] + np.count_nonzero(one.steps[cu, depth] != other.steps[cv, depth], axis=1)
        keep = now <= most
        yield np.stack([cu[keep], cv[keep], now[keep]])


def _tries(num: int, den: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (token, cell, own, inside, id, component, size, block, mark) sorted by token and cell, to pairs (a, b) of different
    components that marks do not rule out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            by_length: dict[int, list[int]] = {}
            for k, m in enumerate(rows[8]):
                by_length.setdefault(len(m), []).append(k)
            found = []
            for places in by_length.values():
                marks = unpacked(np.frombuffer(b"".join(rows[8][k] for k in places), np.uint8).reshape(len(places), -1))
                found += _cell([np.array([rows[c][k] for k in places], np.int64) for c in (4, 5, 6, 7)], np.array([rows[3][k] for k in places], bool), marks, rows[2][0], num, den)
            if sum(map(len, found)):
                yield _pairs(np.concatenate(found))

    return run


def _cell(columns: list[np.ndarray], inside: np.ndarray, marks: np.ndarray, own: bool, num: int, den: int) -> list[np.ndarray]:
    """Columns ids, component, size and block. inside: in the largest component of the token. Outer rows meet the inner ones and,
    if own, each other; without inner ones and if not own, those of one block meet those of the other."""
    ids, component, size, block = columns
    outer, inner = np.flatnonzero(~inside), np.flatnonzero(inside)
    if not own and not len(inner):
        outer, inner = outer[block[outer] == block[outer].min()], outer[block[outer] != block[outer].min()]
    if not len(outer):
        return []
    most = int(may_differ(size.max(), size.max(), num, den))
    step = marks.shape[1] if len(ids) <= FLAT else STEP
    trie = Trie(marks[outer], step)
    met = [(inner, trie_pairs(trie, Trie(marks[inner], step), most))] if len(inner) else []
    met += [(outer, trie_pairs(trie, None, most))] if own else []
    found = []
    for places, (i, j, apart) in met:
        i, j = outer[i], places[j]
        a, b = size[i], size[j]
        keep = (component[i] != component[j]) & (ids[i] != ids[j]) & (np.minimum(a, b) * den >= np.maximum(a, b) * num) & (apart <= may_differ(a, b, num, den))
        i, j = ids[i[keep]], ids[j[keep]]
        found.append(np.stack([np.maximum(i, j), np.minimum(i, j)], axis=1))
    return found


def _groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The columns of each run of rows that are equal in the first columns; a run is one group of bounded size."""
    group, rows = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_pylist() for c in batch.columns]
        heads = np.stack([np.array(c) for c in columns[:keys]])
        cuts = [0, *(np.flatnonzero((heads[:, 1:] != heads[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns[:keys])
            if key == group:
                for old, new in zip(rows, columns, strict=True):
                    old += new[a:b]
            else:
                if rows is not None:
                    yield rows
                group, rows = key, [c[a:b] for c in columns]
    if rows is not None:
        yield rows


def _sets(n: int, held) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(idset.may_hold(held.value, batch.column(0))))
            for part in tokens.slices(batch.column(1)):
                found = list(tokens.shingle_sets(part, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(found)).cast(pa.int64()), tokens.lists(found)], names=["id", "keys"])

    return run


class Path:
    """The path of a prefix tree to the last set visited, with the overlap with one hub counted along it."""

    BLOCK = 64

    def __init__(self, hub: np.ndarray, num: int, den: int):
        self.hub, self.num, self.den = hub, num, den
        self.path = np.zeros(0, np.uint64)
        self.overlap = np.zeros(1, np.int64)  # overlap[d]: of the first d of the path; as far as it was counted

    def links(self, keys: np.ndarray) -> bool:
        """Whether the set links with the hub. Sets must come in sorted order."""
        size, most = len(keys), len(self.hub)
        need = int(required(size, most, self.num, self.den))
        if min(size, most) < need:
            return False
        m = min(size, len(self.path), len(self.overlap) - 1)
        differ = np.flatnonzero(keys[:m] != self.path[:m])
        shared = int(differ[0]) if len(differ) else m
        self.path, counted = keys, [self.overlap[: shared + 1]]
        depth, have = shared, int(self.overlap[shared])
        while depth < size and have + min(size - depth, most - int(np.searchsorted(self.hub, keys[depth]))) >= need:
            block = keys[depth : depth + self.BLOCK]
            at = np.minimum(np.searchsorted(self.hub, block), most - 1)
            upto = have + np.cumsum(self.hub[at] == block)
            counted.append(upto)
            depth, have = depth + len(block), int(upto[-1])
        self.overlap = np.concatenate(counted)
        return depth == size and have >= need


def _check(num: int, den: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (hub, part, id, keys) sorted by hub, part; those with id null hold the hub's own sets. Yields the pairs that link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, hubs = None, [], []

        def close() -> list[tuple[int, int]]:
            out = []
            members.sort(key=lambda x: x[1].astype(">u8").tobytes())
            for keys in hubs:
                tree = Path(keys, num, den)
                out += [(i, group[0]) for i, own in members if tree.links(own)]
            return out

        for batch in batches:
            values = batch.column(3)
            flat = values.values.to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = values.offsets.to_numpy()
            found = []
            for k, (hub, part, i) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if (hub, part) != group:
                    found += close()
                    group, members, hubs = (hub, part), [], []
                keys = flat[offsets[k] : offsets[k + 1]].copy()
                hubs.append(keys) if i is None else members.append((i, keys))
            yield _pairs(np.array(found, np.int64).reshape(-1, 2))
        yield _pairs(np.array(close(), np.int64).reshape(-1, 2))

    return run


def _pairs(found: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["a", "b"])


class NgramJoin:
    """classes: (f1, f2, n_shingles, rep, members); signatures: (id, n_shingles, f1, f2, marks) of every row; links: (a, b) between
    representatives, enough of them to connect what links connect; labels: (rep, component) of linked representatives."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100):
        self.spark, self.n, self.num, self.den = docs.sparkSession, n, num, den
        bound_batches(self.spark)
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        self.known = self.texts.where("id is not null")
        self.signatures = materialize(self.texts.mapInArrow(_signatures(n, num, den), "id long, n_shingles long, f1 long, f2 long, marks array<binary>"), "ngram-signatures")
        real = self.signatures.where("n_shingles > 0 and id is not null")
        self.classes = materialize(real.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("rep"), F.count("*").alias("members")), "ngram-classes")
        self._run()

    def _run(self) -> None:
        """Rounds of hubs go on while they pay: while many pairs of different components are left, and most of what hubs can
        still link is not yet linked."""
        rows, links = self._rows(), self._repeated()
        rows, tested, left, pays = rows.withColumn("component", F.col("id")), None, None, True
        for turn in range(ROUNDS):
            pairs = self._hubs(rows, tested)
            found = self._verify(pairs)
            tested = pairs if tested is None else tested.union(pairs)
            links = links.union(found)
            pays = found.count() * PAYS >= pairs.count()
            if turn and not pays:
                break
            rows, left, count = self._open(rows, links)
            if left <= FEW * count:
                break
        if left is None:
            rows, left, count = self._open(rows, links)
        if left:
            links = links.union(self._verify(self._across(rows)))
        discard(rows)
        self.links = links
        self.labels = components(links, "a", "b").withColumnRenamed("id", "rep")

    def _rows(self) -> DataFrame:
        """(token, id, lower) of the tokens that several representatives have."""
        reps = self.classes.select(F.col("rep").alias("id")).distinct()
        copies = self.classes.where("members > 1").select("f1", "f2", "n_shingles")
        copies = self.signatures.where("id is not null").join(copies, ["f1", "f2", "n_shingles"], "left_semi").select("id")
        held = self.spark.sparkContext.broadcast(idset.build(materialize(copies, "ngram-copies")))
        lists = [_token_lists(self.n, self.num, self.den, held, inside) for inside in (False, True)]
        alone = self.known.mapInArrow(_pre_aggregated(lists[0]), "at long, id long, lower byte, known boolean, token long")
        some = self.known.mapInArrow(lists[1], "id long, lower byte, token long").join(reps, "id", "left_semi")
        some = some.select(F.col("token").alias("at"), "id", "lower", F.lit(False).alias("known"), F.lit(None).cast("long").alias("token"))
        rows = alone.unionByName(some).repartition("at").sortWithinPartitions("at", "token")
        rows = materialize(rows.mapInArrow(_shared, "token long, id long, lower byte"), "ngram-rows")
        held.unpersist()
        return rows

    def _repeated(self) -> DataFrame:
        """Links between the classes that one id is in."""
        again = self.signatures.where("n_shingles > 0 and id is not null").groupBy("id").agg(F.min("f1").alias("p"), F.max("f1").alias("q"), F.min("f2").alias("r"), F.max("f2").alias("s")).where("p <> q or r <> s").select("id")
        of = self.signatures.where("n_shingles > 0").join(again, "id", "left_semi").select("id", "f1", "f2", "n_shingles")
        of = of.join(self.classes, ["f1", "f2", "n_shingles"]).select(F.col("rep").alias("a"), F.col("id").alias("b"))
        return materialize(of.where("a <> b").distinct(), "ngram-links")

    def _open(self, rows: DataFrame, links: DataFrame) -> tuple[DataFrame, float, int]:
        """The rows of tokens whose classes are not all known to be in one component, with component and the group's figures; the
        pairs of different components at one token, and the number of rows.

        What is known here is cheap and may split a component, which only leaves more pairs to check; components themselves
        are made once, at the end.
        """
        labels = nearby_labels(links, "a", "b").withColumnRenamed("id", "rep")
        own = rows.select("token", "id", "lower").join(labels, F.col("id") == F.col("rep"), "left")
        own = materialize(own.select("token", "id", "lower", F.coalesce("component", "id").alias("component")), "ngram-rows")
        groups = own.groupBy("token", "component").agg(F.count("*").alias("k")).groupBy("token").agg(F.sum("k").alias("n"), F.max(F.struct("k", "component")).alias("top"), F.sum(F.col("k").cast("double") * F.col("k")).alias("q"))
        groups = groups.where("top.k < n").select("token", "n", F.col("top.k").alias("k"), F.col("top.component").alias("largest"), ((F.col("n").cast("double") * F.col("n") - F.col("q")) / 2).alias("left"))
        out = materialize(own.join(groups, "token"), "ngram-rows")
        found = out.agg(F.sum(F.col("left") / F.col("n")), F.count("*")).first()
        discard(own, rows)
        return out, found[0] or 0, found[1]

    def _hubs(self, rows: DataFrame, tested: DataFrame | None) -> DataFrame:
        """(a, b) for every class a its hub b: the most central class of a token is the one that shares most tokens with others,
        and of such classes of another component a class takes the one that it meets most often."""
        counts = rows.groupBy("token").agg(F.count("*").alias("others"))
        scores = rows.join(counts, "token").groupBy("id").agg(F.sum("others").alias("score"))
        central = rows.join(scores, "id").groupBy("token").agg(F.max(F.struct("score", "id", "component")).alias("hub"))
        met = rows.join(central, "token").where("hub.component <> component").groupBy(F.col("id").alias("a"), F.col("hub.id").alias("b")).agg(F.count("*").alias("times"), F.max("hub.score").alias("score"))
        if tested is not None:
            met = met.join(tested, ["a", "b"], "left_anti")
        return materialize(met.groupBy("a").agg(F.max(F.struct("times", "score", "b")).alias("x")).select("a", "x.b"), "ngram-pairs")

    def _across(self, rows: DataFrame) -> DataFrame:
        """Pairs of different components that the trees of marks leave. Groups of more than CELL rows are cut into blocks, of inner
        rows (of the largest component) and of outer ones; a cell is two blocks, one at least of outer rows."""
        outer, inner = (F.ceil(x / F.lit(CELL)).cast("long") for x in (F.col("n") - F.col("k"), F.col("k")))
        block = lambda blocks: F.pmod(F.xxhash64("id"), blocks)
        upto = lambda blocks: F.sequence(F.lit(0).cast("long"), blocks - 1)
        rows = rows.withColumns({"inside": F.col("component") == F.col("largest"), "o": outer, "i": inner}).withColumn("block", F.when(F.col("inside"), block(F.col("i"))).otherwise(block(F.col("o"))))
        # cell numbers: first outer with outer (x, y), x <= y, then outer with inner
        cell = lambda number, own: F.struct(number.alias("cell"), own.alias("own"))
        with_outer = F.transform(upto(F.col("o")), lambda x: cell(F.least(x, F.col("block")) * F.col("o") + F.greatest(x, F.col("block")), x == F.col("block")))
        with_inner = F.transform(upto(F.col("i")), lambda x: cell(F.col("o") * F.col("o") + F.col("block") * F.col("i") + x, F.lit(False)))
        inners = F.transform(upto(F.col("o")), lambda x: cell(F.col("o") * F.col("o") + x * F.col("i") + F.col("block"), F.lit(False)))
        cells = F.when(F.col("n") <= CELL, F.array(cell(F.lit(-1).cast("long"), F.lit(True)))).when(F.col("inside"), inners).otherwise(F.concat(with_outer, with_inner))
        marks = self.signatures.where("n_shingles > 0 and id is not null").select(F.col("id").alias("_id"), F.col("n_shingles").alias("size"), "marks")
        rows = rows.join(marks, F.col("id") == F.col("_id")).where("lower < size(marks)")
        rows = rows.withColumn("_", F.explode(cells)).select("token", "_.cell", "_.own", "inside", "id", "component", "size", "block", F.element_at("marks", F.col("lower") + 1).alias("mark"))
        rows = rows.repartition("token", "cell").sortWithinPartitions("token", "cell")
        return materialize(rows.mapInArrow(_tries(self.num, self.den), "a long, b long").distinct(), "ngram-pairs")

    def _verify(self, pairs: DataFrame) -> DataFrame:
        """Those pairs that link, decided on whole sets. A hub of very many members has several trees."""
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ngram-ids")
        held = self.spark.sparkContext.broadcast(idset.build(ids))
        sets = self.known.mapInArrow(_sets(self.n, held), "id long, keys array<long>")
        sets = materialize(sets.join(ids, "id", "left_semi"), "ngram-sets")
        held.unpersist()
        parts = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / F.lit(TREE)).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
        members = pairs.join(sets, pairs.a == sets.id).join(parts, F.col("b") == F.col("hub")).select("hub", part.alias("part"), "id", "keys")
        hubs = sets.join(parts, sets.id == parts.hub).select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("id"), "keys")
        trees = members.unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part")
        found = materialize(trees.mapInArrow(_check(self.num, self.den), "a long, b long"), "ngram-links")
        discard(sets, ids)
        return found

    def documents(self) -> DataFrame:
        """One row for each row of the input: id, n_shingles, component_id, class_id and class_size."""
        labelled = self.classes.join(self.labels, "rep", "left").select("f1", "f2", "n_shingles", "rep", "members", F.coalesce("component", "rep").alias("_c"))
        out = self.signatures.drop("marks").join(labelled, ["f1", "f2", "n_shingles"], "left")
        return out.select("id", "n_shingles", F.coalesce("_c", "id").alias("component_id"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("members", F.lit(1)).alias("class_size"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """For each row: its id, n_shingles, component_id (the smallest id that links reach), class_id (the smallest id of an
    equal set) and class_size.

    Words are runs of ``[^\\x20\\x09-\\x0D]`` after A-Z is lower-cased. A text of fewer than n words is one shingle. Null
    texts and those without words have no shingle, link with nothing and are their own component. A row with a null id is
    linked to its class but never names a component; without one its component is null. Rows that repeat an id stand for
    one document: what either links with is one component. Other columns of docs are not read.
    """
    return NgramJoin(docs, id_col, text_col, n, num, den).documents().withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component, that of the smallest id, and all columns.

    Rows that repeat a kept id are one row afterwards, the smallest as a struct. Rows with a null id stay, and so do rows whose
    text is null, empty or without words; long texts count whole. An empty table stays one. Other columns may have any names,
    but their types must be ordered for ids that repeat. Only rows whose id is in a component of several, or repeated, are
    shuffled; all others pass with the scan.
    """
    found = NgramJoin(docs, id_col, text_col, n, num, den).documents().where("id is not null")
    found = found.groupBy("id").agg(F.count("*").alias("n"), F.min("component_id").alias("c")).where("n > 1 or c <> id")
    found = materialize(found, "ngram-contested").alias("found")
    some, rest = idset.split(docs, id_col, idset.build(found.select("id")))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    some = some.select(whole).alias("some").join(found, F.col(f"some.row.`{id_col}`").cast("long") == F.col("found.id"), "left").where("c is null or c = id")
    one = some.where("n is null or n = 1").select("row.*")
    again = some.where("n > 1").groupBy("found.id").agg(F.min("row").alias("row")).select("row.*")
    return rest.unionByName(one).unionByName(again)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM g GROUP BY doc_id
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)
), r(a, c) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.c = l.a
), m AS (
  SELECT a, min(c) AS component_id FROM r GROUP BY a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, coalesce(min(n.doc_id) OVER k, d.doc_id) AS class_id, CASE WHEN n.n IS NULL THEN 1 ELSE count(*) OVER k END AS class_size
FROM d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id WINDOW k AS (PARTITION BY coalesce(n.h, CAST(d.doc_id AS VARCHAR)))
"""
