"""Conversation repair, filter audit and SimHash near-duplicates: against brute force, over hot keys, and on edge cases."""

import hashlib
import heapq
import itertools
import random
import re
from collections import Counter
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from evigraph.llm import conversation_repair, decontaminate, filter_audit, ngram_join, simhash_dedup, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@contextmanager
def many_tasks(spark, n=13):
    """Sorted rows go to n tasks, however few they are."""
    keys = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def faults(rows):
    """rows(turn, role, text) in order -> faults."""
    seen, out = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """(cost, edits, roles and texts): a search over whole edit sequences, the cheapest first, then the ASCII-least."""
    bad = faults(rows)
    keep = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    put = {"": "user", "s": "user", "a": "user", "u": "assistant"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, edits, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, edits, made
        if (i, state) in done:
            continue
        done.add((i, state))
        role = put[state]
        heapq.heappush(heap, (cost + 3, edits + "I", i, role[0], (*made, (role, ""))))
        if i < len(rows):
            _, own, text = rows[i]
            heapq.heappush(heap, (cost + 4, edits + "D", i + 1, state, made))
            if bad[i] not in ("blank", "duplicate"):
                cut = 3 * (bad[i] == "truncated")
                heapq.heappush(heap, (cost + cut + 3, edits + "R", i + 1, role[0], (*made, (role, text))))
                if (state, own[:1]) in keep:
                    heapq.heappush(heap, (cost + cut, edits + "K", i + 1, keep[state, own[:1]], (*made, (own, text))))
    raise AssertionError


def ordered(rows):
    some = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(some, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2][:64], hashlib.md5(x[2].encode()).hexdigest()))


def brute_result(rows):
    rows = ordered(rows)
    bad, turns = Counter(faults(rows)), [t for t, _, _ in rows if t is not None]
    cost, edits, made = brute_repair(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    text = "\n".join(f"{r}:{t}" for r, t in made)
    return gaps, bad["blank"], bad["duplicate"], bad["truncated"], illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest()


def conversations(r, n, long=0):
    out = []
    texts = ["Yes.", "no", "", " \t", "What?", "a.b", "Fine! \n", None, "x" * 70 + "1.", "x" * 70 + "2."]
    for c in range(n):
        for k in range(r.randint(0, 7)):
            out.append((c, r.choice([k, k, k, 2 * k, None]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), r.choice(texts)))
    for k in range(long):
        out.append((n // 2, k // 2, ["user", "assistant"][k % 2] if r.random() < 0.8 else r.choice(["system", "user", "tool"]), r.choice([f"text {k}.", f"text {k // 9}.", f"cut {k}", ""])))
    out += [(None, 0, "user", "q"), (None, 1, "assistant", "a.")]
    return out


@pytest.mark.parametrize("long", [0, 3000])
def test_repair_against_a_search(spark, long):
    rows = conversations(random.Random(5 + long), 60, long)
    df = spark.createDataFrame([(*x, 1, "p") for x in rows], "conv_id long, turn long, role string, text string, at int, part string")
    with many_tasks(spark):
        got = {x[0]: tuple(x[1:]) for x in conversation_repair.repair(df).collect()}
        turns = conversation_repair.repaired_turns(df).collect()
    want = {}
    for c in {x[0] for x in rows}:
        want[c] = brute_result([x[1:] for x in rows if x[0] == c])
    assert got == want
    for c in want:
        mine = [x for x in sorted((x for x in turns if x.conv_id == c), key=lambda x: (x.part, x.no, x.at))]
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in mine).encode()).hexdigest() == want[c][-1]
        assert "".join(x.edit for x in mine) == want[c][-2].replace("D", "")


def test_damage_and_empty_tables(spark):
    schema = "conv_id string, turn int, role string, text string"
    rows = [("a", k, "user", "So. It! Is?") for k in range(60)] + [(None, None, None, None)]
    got = conversation_repair.damage(spark.createDataFrame(rows, schema)).collect()
    import zlib

    for k in range(60):
        kind = zlib.crc32(f"a:{k}".encode()) % 20
        mine = [x for x in got if x.turn == k]
        assert len(mine) == (2 if kind == 3 else 1) and mine[0].gone == (kind == 0)
        assert mine[0].text == ("" if kind in (0, 1) else "So It Is" if kind == 2 else "So. It! Is?")
    assert [(x.role, x.text) for x in got if x.conv_id is None][0][0] in (" ", "user")
    none = conversation_repair.repair(spark.createDataFrame([], schema))
    assert none.collect() == [] and none.columns[0] == "conv_id"
    gone = spark.createDataFrame([("z", 1, "user", "x", True)], schema + ", gone boolean")
    assert [tuple(x) for x in conversation_repair.repair(gone).collect()] == [("z", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def brute_masks(rows):
    out = []
    for i, text, _ in rows:
        text = text or ""
        words = WORD.findall(text)
        mask = len(words) < 50
        mask |= 2 * (100 * len(set(words)) < 65 * len(words))
        mask |= 4 * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text))
        mask |= 8 * bool(re.search(r"[#$%&*|]", text))
        mask |= 16 * (i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows))
        out.append(mask)
    return out


def documents(r, n):
    out = []
    for k in range(n):
        text = " ".join(r.choice("abcdefghij") * r.randint(1, 3) + (str(k) if r.random() < 0.9 else "") for _ in range(r.randint(0, 90)))
        text = text.upper() if r.random() < 0.1 else text
        out.append((k, text + r.choice(["", "", " #1"]), r.choice(["a", "b", None, ""])))
    hot = "the same text " * 30
    out += [(n + k, hot, "hot") for k in range(n)] + [(n + 3, hot, "hot"), (None, hot, "hot"), (None, None, None), (5, "", None), (2, None, "b"), (7, " \n", "b")]
    return out


@pytest.mark.parametrize("tasks", [1, 13])
def test_filter_audit_against_plain_counts(spark, tasks):
    r = random.Random(tasks)
    rows = documents(r, 120)
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1])) for i in [*range(0, 240, 2), 4, 4, None]]
    df = spark.createDataFrame([(*x, 3, "z") for x in rows], "doc_id long, text string, source string, mask int, print string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    with many_tasks(spark, tasks):
        marked = filter_audit.mark(df)
        masks = brute_masks(rows)
        want = Counter((i, s or "", m) for (i, _, s), m in zip(rows, masks, strict=True))
        assert Counter(map(tuple, marked.collect())) == want
        got = {(x.part, x.filter_order, x.step): tuple(x[3:]) for x in filter_audit.audit(filter_audit.count(marked, known)).collect()}
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in range(2))
    orders = ["".join(x) for x in itertools.permutations("ABCDE")]
    assert len(got) == 600 * len({s or "" for *_, s in rows})
    parts, removed = {}, Counter()
    for (i, _, s), m in zip(rows, masks, strict=True):
        parts.setdefault(s or "", []).append((i, m))
    for part, own in parts.items():
        for order in orders:
            left = own
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                out = [x for x in left if x[1] & bit]
                left = [x for x in left if not x[1] & bit]
                removed[part, letter] += len(out)
                numbers = len(left), len(out), sum(bool(m & bit) for _, m in own) - len(out), sum(m == bit for _, m in own)
                assert got[part, order, step][:6] == (*numbers, sum(i in good for i, _ in out), sum(i in toxic for i, _ in out))
    assert all(x[6] == removed[part, order[step - 1]] for (part, order, step), x in got.items())


def test_filter_audit_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.count(filter_audit.mark(df), known)).collect() == []


def brute_print(text, n=4):
    words = WORD.findall((text or "").translate(LOW))
    runs = [" ".join(words[k : k + n]) for k in range(max(len(words) - n + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, bits):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= bits:
            root[find(a)] = find(b)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def test_simhash_against_brute_force(spark):
    r = random.Random(2)
    rows = []
    for k in range(150):
        words = [f"W{r.randint(0, 400)}" for _ in range(r.choice([0, 1, 3, 4, 5, 60, 300]))]
        rows.append((k, r.choice([" ", "\t\n"]).join(words)))
        if words and k % 3 == 0:
            rows.append((1000 + k, " ".join(words[:-1] + ["other"]).upper()))
    rows += [(9, rows[9][1]), (None, "Ünï cödé wörds hére now"), (2000, "ünï cödé wörds hére now"), (2001, None), (2002, " \x0b"), (2003, "x" * 100_000)]
    df = spark.createDataFrame([(*x, "q", 1) for x in rows], "doc_id long, text string, fp string, id int")
    got = sorted(map(tuple, simhash_dedup.near_duplicates(df).collect()), key=str)
    prints = [brute_print(t) for _, t in rows]
    groups = brute_components([i for i, _ in rows], prints, 4)
    assert got == sorted(((i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, groups, strict=True)), key=str)
    assert len(set(groups)) < len({i for i, _ in rows}) - 40
    assert simhash_dedup.near_duplicates(df.limit(0)).collect() == []


@pytest.mark.parametrize(("few", "limit"), [(1 << 28, 1 << 14), (0, 1 << 14), (1 << 28, 3)])
def test_links_connect_what_all_links_connect(spark, monkeypatch, few, limit):
    """Clusters around centres at distances about the limit, by three and two segments, and with crowded buckets."""
    monkeypatch.setattr(simhash_dedup, "FEW", few)
    r = random.Random(few + limit)
    prints = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = r.getrandbits(64)
        for _ in range(20):
            prints.add(centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 4))))
    prints = sorted(prints)
    signed = [int(np.uint64(x).view(np.int64)) for x in prints]
    found = simhash_dedup.links(spark.createDataFrame([(x,) for x in signed], "fp long"), limit=limit).collect()
    place = {x: k for k, x in enumerate(signed)}
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in found:
        a, b = place[a], place[b]
        assert (prints[a] ^ prints[b]).bit_count() <= 4
        root[find(a)] = find(b)
    assert len({find(k) for k in range(len(prints))}) == len(set(brute_components(list(range(len(prints))), prints, 4)))
    assert {(x, find(k)) for k, x in enumerate(brute_components(list(range(len(prints))), prints, 4))}.__len__() == len({find(k) for k in range(len(prints))})


def test_radii_find_every_distance():
    for count in (1, 1 << 40):
        for bits in range(8):
            parts = simhash_dedup.segments(count, bits)
            assert sum(b for _, b, _ in parts) == 64 and sum(r + 1 for *_, r in parts) == bits + 1


def test_stages_with_names_of_their_own_columns(spark):
    """Columns that have the names that the work uses come back as they were; small sets that cannot link have no tokens."""
    names = ["_n", "_c", "_id", "n", "c", "id", "row", "row1", "row2", "_d", "_h", "_first", "h", "found", "a b"]
    body = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(k, t, f"<p>{'x' * 1000}</p>", *(f"{c}{k}" for c in names)) for k, t in enumerate([body, body.upper(), "short words", None, "", body + " more", "x y z"])] + [(1, "again", None, *names)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "html", *names])
    kept = ngram_join.keep_one(df).collect()
    assert sorted(x.doc_id for x in kept) == [0, 2, 3, 4, 6] and all(tuple(x) == rows[x.doc_id] for x in kept)
    clean = decontaminate.keep_clean(df, spark.createDataFrame([(1, body)], "item_id int, text string")).collect()
    assert sorted(map(str, map(tuple, clean))) == sorted(str(x) for x in rows if x[1] is None or "twelve" not in x[1].lower())
    pages = df.withColumnRenamed("doc_id", "page_id").drop("text")
    plan = warc.plan_revisits(pages).collect()
    assert sorted(x.page_id for x in plan if x.record_type == "revisit") == [0, 1, 2, 3, 4, 5]
    assert all([x[c] for c in names] in ([f"{c}{x.page_id}" for c in names], names) for x in plan)
    assert all(x.refers_to == 6 for x in plan if x.record_type == "revisit")
    texts = pa.array([" ".join(f"w{k}" for k in range(n)) for n in (4, 5, 9, 10, 40)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), texts], names=["id", "text"])
    held = spark.sparkContext.broadcast(b"\xff" * 512)
    dealt = [x for b in ngram_join._token_lists(3, 90, 100, held, True)([batch]) for x in b.column(0).to_pylist()]
    assert set(dealt) == {3, 4}  # up to seven n-grams only equal sets link
