"""N-gram join, decontamination, WARC and the pipeline: against brute force and on edge cases."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from evigraph.llm import components, decontaminate, idset, ngram_join, tokens, warc

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = ["", " \t\n", "a", "A a\x0b", "É é x", "w\x00w w", "x" * 3000, "  tab\tand\x85next", "1,2;3 a-b", "日本 語"]


@pytest.mark.parametrize(("table", "pattern"), [(tokens.SPACE, SPACE), (tokens.LETTERS, LETTERS)])
@pytest.mark.parametrize("size", [1, 1_500_000])
def test_words_are_those_of_the_pattern(table, pattern, size):
    texts = [*ODD, None, *ODD[::-1]]
    got = []
    for part in tokens.slices(pa.array(texts), table, size=size):
        for k in range(part.last - part.first):
            a, b = part.word_offsets[k], part.word_offsets[k + 1]
            got.append([bytes(part.data[s:e]).decode().translate(LOW) for s, e in zip(part.starts[a:b], part.ends[a:b], strict=True)])
    assert got == [pattern.findall((t or "").translate(LOW)) for t in texts]


def test_equal_words_have_equal_hashes_wherever_they_stand():
    one = next(tokens.slices(pa.array(["The THE the the.", "the"])))
    assert len({int(x) for x in one.hashes[[0, 1, 2, 4]]}) == 1 and one.hashes[3] != one.hashes[0]


def brute_components(rows, n, num, den):
    sets = []
    for i, t in rows:
        w = SPACE.findall((t or "").translate(LOW))
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and den * len(a & b) >= num * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


def near_texts(seed, groups=12, size=7):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(r.randint(1, 6)))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(r.choice([4, 30, 120]))]
        for _ in range(r.randint(1, size)):
            own = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                own[r.randrange(len(own))] = word()
            out.append(" ".join(w.upper() if r.random() < 0.05 else w for w in own) + r.choice(["", " ", "\n"]))
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80)])
def test_components_against_all_pairs(spark, n, num):
    texts = near_texts(n) + ODD + [None]
    ids = random.Random(1).sample(range(10_000), len(texts))
    rows = list(zip(ids, texts, strict=True))
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, size int, id string")
    found = ngram_join.ngram_components(df, n=n, num=num, den=100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, n, num, 100) and len(found) == len(rows)
    kept = {r.doc_id for r in ngram_join.keep_one(df, n=n, num=num, den=100).collect()}
    assert kept == {c for _, c in brute_components(rows, n, num, 100).values()}


@pytest.mark.parametrize("rounds", [0, 1])
def test_pairs_of_the_tries_make_all_links(spark, monkeypatch, rounds):
    """Without rounds of hubs, or with one, and with cells and trees of few sets, components stay the same."""
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "TREE", 2)
    monkeypatch.setattr(ngram_join, "CELL", 3)
    monkeypatch.setattr(ngram_join, "LOOK", 50)
    rows = list(enumerate(near_texts(8, groups=4, size=25)))
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), num=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 3, 80, 100)


def test_an_id_in_several_classes_joins_them(spark):
    a, b, c = ("alpha beta gamma delta", "one two three four", "red green blue white")
    rows = [(3, a), (5, a), (5, b), (4, b), (5, c), (9, "none of these at all")]
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (4, 3), (5, 3), (5, 3), (5, 3), (9, 9)]


def test_join_of_copies_null_ids_and_nothing(spark):
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "A b c d"), (9, "a b c d "), (7, None), (None, None), (3, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(df).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (9, 2, 5), (7, 0, 7), (None, 0, None), (3, 1, 3)], key=str)
    assert sorted((r.doc_id, r.text) for r in ngram_join.keep_one(df).where("doc_id is not null").collect()) == [(3, "q"), (5, "a b c d"), (7, None)]
    assert ngram_join.ngram_components(df.limit(0)).collect() == []


def near_sets(r, size, count):
    base = np.unique(r.integers(0, 2**63, size).astype(np.uint64))
    own = lambda: np.unique(np.concatenate([r.choice(base, int(len(base) * r.uniform(0.75, 1)), replace=False), r.integers(0, 2**63, r.integers(0, 1 + size // 6)).astype(np.uint64)]))
    return [base, *(own() for _ in range(count))]


def test_a_path_agrees_with_sets():
    r = np.random.default_rng(3)
    for _ in range(60):
        hub, *sets = near_sets(r, 200, 12)
        tree = ngram_join.Path(hub, 80, 100)
        for s in sorted(sets, key=lambda x: x.astype(">u8").tobytes()):
            assert tree.links(s) == (100 * len(np.intersect1d(s, hub)) >= 80 * len(np.union1d(s, hub)))


@pytest.mark.parametrize(("num", "den"), [(80, 100), (90, 100), (1, 2), (100, 100)])
def test_sets_that_link_share_a_token_and_marks_leave_them(num, den):
    r = np.random.default_rng(num)
    linked = 0
    for size in [1, 2, 3, 5, 8, 12, 19, 20, 22, 27, 40, 60, 90, 300]:
        for _ in range(12):
            sets = near_sets(r, size, 5)
            for one, two in itertools.combinations(sets, 2):
                small, large = sorted((one, two), key=len)
                if not len(small) or den * len(np.intersect1d(one, two)) < num * len(np.union1d(one, two)):
                    continue
                linked += 1
                band = ngram_join.bands(len(small), num, den)[0]
                assert band in ngram_join.bands(len(large), num, den)
                assert set(ngram_join.band_tokens(one, band, num, den).tolist()) & set(ngram_join.band_tokens(two, band, num, den).tolist())
                marks = ngram_join.unpacked(np.stack([np.frombuffer(ngram_join.mark(x, band, num, den), np.uint8) for x in (one, two)]))
                apart = int((marks[0] != marks[1]).sum())
                assert apart <= ngram_join.may_differ(len(one), len(two), num, den)
                i, j, d = ngram_join.trie_pairs(ngram_join.Trie(marks), None, apart)
                assert (set(i.tolist() + j.tolist()), d.tolist()) == ({0, 1}, [apart])
    assert linked > 100


@pytest.mark.parametrize("most", [0, 3, 20, 200])
def test_tries_find_the_pairs_that_differ_little(most):
    r = np.random.default_rng(most)
    base = r.integers(0, 16, (3, 160)).astype(np.uint8)
    marks = np.concatenate([np.where(r.random((20, 160)) < r.random((20, 1)) * 0.3, r.integers(0, 16, (20, 160)), b) for b in base] + [base, base]).astype(np.uint8)
    apart = (marks[:, None] != marks[None]).sum(axis=2)
    i, j, d = ngram_join.trie_pairs(ngram_join.Trie(marks), None, most)
    got = {(min(x, y), max(x, y)): z for x, y, z in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)}
    assert len(got) == len(i) and got == {(x, y): apart[x, y] for x in range(len(marks)) for y in range(x + 1, len(marks)) if apart[x, y] <= most}
    i, j, d = ngram_join.trie_pairs(ngram_join.Trie(marks[:30]), ngram_join.Trie(marks[30:]), most)
    got = {(x, y + 30): z for x, y, z in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)}
    assert got == {(x, y): apart[x, y] for x in range(30) for y in range(30, len(marks)) if apart[x, y] <= most}


def test_rows_of_a_token_alone_drop_out():
    r = np.random.default_rng(1)
    flat = np.concatenate([r.integers(0, 40, 60), r.integers(100, 2**62, 60)])
    rows = [(i, t) for i, t in enumerate(flat.tolist())]
    dealt = []
    for part in (rows[:50], rows[50:90], rows[90:]):
        batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([0] * len(part), pa.int8()), pa.array([x[1] for x in part])], names=["id", "lower", "token"])
        dealt += ngram_join._dealt(batch).to_pylist()
    schema = pa.schema([("at", pa.int64()), ("id", pa.int64()), ("lower", pa.int8()), ("known", pa.bool_()), ("token", pa.int64())])
    dealt.sort(key=lambda x: (x["at"], x["token"] is not None))
    batches = [pa.RecordBatch.from_pylist(dealt[k : k + 7], schema) for k in range(0, len(dealt), 7)]
    got = sorted((x["id"], x["token"]) for b in ngram_join._shared(batches) for x in b.to_pylist())
    assert got == [(i, t) for i, t in rows if flat.tolist().count(t) > 1]


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)] + [(200, k) for k in range(201, 260)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.id: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_id_filter_never_loses_an_id(spark):
    held = idset.build(spark.range(0, 5000, 7).toDF("id"))
    hit = idset.may_hold(held, pa.array([*range(5000), None]))
    assert all(hit[0:5000:7]) and not hit[5000] and hit.sum() < 1500


def brute_hits(text, items):
    words = LETTERS.findall((text or "").translate(LOW))
    hit, names = set(), set()
    for name, item in items:
        w = LETTERS.findall((item or "").translate(LOW))
        n = min(len(w), 10)
        for p in range(len(w) - n + 1) if w else []:
            for q in range(len(words) - n + 1):
                if words[q : q + n] == w[p : p + n]:
                    hit.update(range(q, q + n))
                    names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("bits", [idset.MAX_BITS, 64])
def test_contamination_against_all_windows(spark, bits, monkeypatch):
    """With a filter that lets only what may meet through, and with one that is full."""
    monkeypatch.setattr(idset, "MAX_BITS", bits)
    r = random.Random(6)
    word = lambda: r.choice(["ab", "cd", "ef", "gh", "Éi", "k9"])
    items = [(i, " ".join(word() for _ in range(r.choice([3, 9, 10, 11, 30])))) for i in range(14)] + [(50, None), (51, ""), (52, "., !"), (10, "ab cd ef gh ab cd ef gh ab cd ef")]
    docs = []
    for i in range(60):
        text = " ".join(word() for _ in range(r.randint(0, 40)))
        if i % 2:
            w = LETTERS.findall(r.choice(items[:14])[1])
            a = r.randrange(len(w))
            text += ", ".join(["", *w[a : a + r.randint(5, 20)]]).upper() + ". " + text[:30]
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "..."), (103, "ab " * 20000), (5, docs[5][1])]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_contamination(df, bench).collect()
    want = {i: brute_hits(t, items) for i, t in docs if i != 103}
    got = {x.doc_id: (x.n_words, len(x.hits), len(x.items), decontaminate.sha256_of(x.items), bool(x.hits)) for x in found}
    assert len(found) == len(docs) and {k: v for k, v in got.items() if k != 103} == want
    digest = {x.doc_id: (x.n_words, x.n_hit, x.n_items, x.items_sha256, x.contaminated) for x in decontaminate.contamination_digest(df, bench).collect()}
    assert digest == got
    kept = {x.doc_id for x in decontaminate.keep_clean(df, bench).collect()}
    assert kept == {k for k, v in got.items() if not v[4]}


def test_contamination_without_items_or_documents(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(x.n_hit, x.items_sha256) for x in decontaminate.contamination_digest(df, none).collect()] == [(0, decontaminate.sha256_of([]))]
    assert decontaminate.contamination_digest(df.limit(0), none).collect() == [] and decontaminate.keep_clean(df, none).count() == 1


def test_winnowing_keeps_a_print_of_every_shared_span():
    r = np.random.default_rng(1)
    for _ in range(50):
        shared = r.integers(0, 2**63, 10).astype(np.uint64)
        sides = [np.concatenate([r.integers(0, 2**63, r.integers(0, 30)).astype(np.uint64), shared, r.integers(0, 2**63, r.integers(0, 30)).astype(np.uint64)]) for _ in range(2)]
        prints = []
        for words in sides:
            g = tokens.grams(words, decontaminate.K)
            at = decontaminate.winnow(g, np.ones(len(g), bool))
            assert len(at) < len(g) or len(g) < 12
            prints.append(set(g[at].tolist()))
        assert prints[0] & prints[1]


PAGES = [
    (1, "http://a/", "x" * 1000), (2, "http://b/", "x" * 1000), (3, None, "x" * 1000), (4, "http://c/", "small"), (5, "http://d/", "small"),
    (6, "http://e/\r\nEvil: 1", "line\r\n\r\nWARC/1.1\r\n" * 100), (7, "http://f/", None), (8, "http://g/", ""), (9, "http://h/", "é" * 600), (9, "http://h/", "é" * 600), (10, "http://i/", "z" * 999),
    (11, "http://j/", "z" * 999), (12, "http://k/", "q" * 300_000),
]


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*p, "x", 5) for p in PAGES], "page_id long, url string, html string, payload string, record_type long")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        first = max(j for j, _, h in PAGES if (h or "").encode() == raw) if len(raw) >= 1000 else i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    assert got == sorted(want, key=str)
    for compression in ("none", "gzip"):
        path = f"file://{tmp_path}/{compression}"
        warc.write(warc.plan_revisits(df), path, compression)
        records = warc.read(spark, path)
        assert records.count() == len(PAGES) and records.where("record_type = 'revisit'").where("length(payload) > 0").count() == 0
        full = {int(r.record_id): bytes(r.payload).decode() for r in warc.resolve(records).collect()}
        assert full == {i: h or "" for i, _, h in PAGES}


def test_warc_of_many_copies_and_odd_ids(spark):
    """Only one payload a batch moves; null and repeated ids, and payloads that hold the record end."""
    same, odd = "same " * 400, "a\r\n\r\nWARC/1.1\r\n\r\n" * 100 + "\r\n"
    rows = [*((k, None, same) for k in range(40)), (39, None, same), (None, None, same), (70, None, odd), (71, "u", odd), (80, None, "\r\n"), (None, None, "n" * 2000), (None, None, "n" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    plan = warc.plan_revisits(df).collect()
    assert len(plan) == len(rows) and sum(r.record_type == "revisit" for r in plan) == 41
    assert all((r.payload is None) == (r.record_type == "revisit") for r in plan)
    got = warc.round_trip(df).collect()
    assert {r.page_id for r in got if r.record_type == "response"} == {39, 71, 80, None} and sum(r.page_id == 39 for r in got) == 2
    assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {*((k, 39) for k in range(39)), (None, 39), (70, 71)}
    assert all(r.payload_digest == hashlib.sha1(h.encode()).hexdigest() for r in got for i, _, h in rows if i == r.page_id and i is not None)


def test_warc_records_come_out_of_any_pieces():
    good = b"".join(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (k, len(b), b) for k, b in enumerate([b"", b"\r\n\r\n", b"WARC/1.1\r\n\r\n", b"x" * 3000]))
    for size in (1, 7, 64, 10000):
        records, got = warc.Records(), []
        for k in range(0, len(good), size):
            records.add(good[k : k + size])
            got += [(r[0], len(r[-1])) for r in records.whole()]
        records.close()
        assert got == [("0", 0), ("1", 4), ("2", 12), ("3", 3000)]


def test_warc_refuses_broken_archives():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [r[0] for r in warc.parse(good * 2)] == ["1", "1"]
    for bad in (good[:-5], good.replace(b"3", b"9"), b"x" + good, good.replace(b"Content", b"WARC-Payload-Digest: sha1:00\r\nContent")):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_warc_of_nothing(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(df).collect() == []
