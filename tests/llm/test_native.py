"""Mixing, URL rules, quality rules: against brute force and on nulls, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evigraph.llm import mixing, quality_rules, url_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else share[s] for s in order}
        capped |= over


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size int, target string")
    return mixing.mix_documents(df).collect()


def test_mix_against_brute_force(spark):
    r = random.Random(3)
    rows = []
    for i in range(400):
        source = r.choice(["a", "a", "a", "b", "c", "d", None])
        rows.append((i, source, " ".join("w" * r.randint(1, 5) for _ in range(r.randint(0, 9 if source == "d" else 40))), 7, "x"))
    rows += [(None, "b", "one two", 0, ""), (500, "c", None, 0, ""), (900, "a", "x y z", 0, ""), (900, "a", "x y z", 0, "")]
    sizes = Counter()
    for _, s, t, *_ in rows:
        sizes[s] += len(WORDS.findall(t or ""))
    want = brute_targets(sizes)
    copies, cum = [], Counter()
    key = lambda i: int(hashlib.md5(b"" if i is None else str(i).encode()).hexdigest()[:15], 16)
    sized = sorted(((s, key(i), -1 if i is None else i, len(WORDS.findall(t or "")), i) for i, s, t, *_ in rows), key=lambda x: (str(x[0]), *x[1:4]))
    for s, h, _, n, i in sized:
        cum[s] += n
        if n:
            copies += [((e * sizes[s] + cum[s]) / want[s], h, "" if i is None else str(i), n) for e in range(3)]
    left, taken = sum(sizes.values()), Counter()
    for _, _, i, n in sorted(copies):
        if n > left:
            break
        left -= n
        taken[i] += n
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    by_id, by_source = Counter(), Counter()
    names = {i: s for i, s, *_ in rows}
    for x in got:
        assert x.taken == x.size * x.copies <= 3 * x.size
        assert x.source_size == sizes[names[x.doc_id]] and math.isclose(x.target, want[names[x.doc_id]])
        by_id["" if x.doc_id is None else str(x.doc_id)] += x.taken
        by_source[names[x.doc_id]] += x.taken
    assert +by_id == +taken
    assert all(abs(by_source[s] - want[s]) <= 2 * 40 for s in sizes)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixed(spark, rows[::-1])), key=str)


def test_mix_of_nothing_and_of_wordless_documents(spark):
    assert mixed(spark, []) == []
    got = mixed(spark, [(1, "a", "", 0, ""), (2, None, None, 0, "")])
    assert {(x.doc_id, x.taken, x.target) for x in got} == {(1, 0, 0.0), (2, 0, 0.0)}


def test_mix_with_columns_of_any_name(spark):
    plain = [(k, "ab"[k % 2], k % 5) for k in range(40)]
    want = {x.doc_id: (x.target, x.copies, x.taken) for x in mixing.mix(spark.createDataFrame(plain, "doc_id long, source string, size long")).collect()}
    names = "_h string, doc_id long, `a.b` int, source string, size long, _slice int, _cum int, _src string, _rest int, Target string, taken int"
    df = spark.createDataFrame([(f"h{k}", k, k, s, n, 2, 3, "s", 5, "old", 7) for k, s, n in plain], names)
    got = mixing.mix(df)
    assert got.columns == ["_h", "doc_id", "a.b", "source", "size", "_slice", "_cum", "_src", "_rest", "source_size", "target", "copies", "taken"]
    rows = got.collect()
    assert {x.doc_id: (x.target, x.copies, x.taken) for x in rows} == want
    assert all((x._h, x["a.b"], x._slice, x._cum, x._src, x._rest) == (f"h{x.doc_id}", x.doc_id, 2, 3, "s", 5) for x in rows)


def brute_place(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute_rule(host, path):
    fits = [r for r in ("net/", "example.net/en/", "example.com/de/", "org/fr/") if (host == (h := r.partition("/")[0]) or host.endswith("." + h)) and path.startswith("/" + r.partition("/")[2])]
    return max(fits, key=len, default=None)


URLS = [None, "", "nothing", "http://", "http://A.NET/x", "http://net/", "http://net", "http://xnet/", "https://example.net/en/1", "https://sub.Example.NET/en/", "https://example.net/english", "x://a://b.net/",
        "http://a.org/fr/x?ref=1", "http://example.com/de/", "http://example.com/de", "http://example.com/x?utm_source=1", "http://a.example.com/login", "http://a.com?page=3", "http://a.com/?page=3&x", "http://a.com/\nb?ref=2",
        "HTTP://net:80/", "http://a.net#f/", "http://é.org/fr/", "http://example.com/de/" + "z" * 5000]


def test_urls_against_brute_force(spark):
    df = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS * 2)], "page_id int, url string, rule string")
    for got in url_rules.judge(df, url_rules.PLACE_RULES, url_rules.URL_PATTERNS).collect():
        host, path = brute_place(got.url)
        rule = brute_rule(host, path)
        verdict = {"net/": "block", "example.com/de/": "block", None: None}.get(rule, "allow")
        if rule is None:
            verdict = "block" if any(re.search(p.regex.replace("$", r"\Z"), got.url or "") for p in url_rules.URL_PATTERNS) else "allow"
        assert (got.host, got.path, got.rule, got.verdict) == (host, path, rule, verdict), got.url


def test_url_join_agrees_with_inline(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    patterns = [*url_rules.URL_PATTERNS, url_rules.url_pattern("^x|/e?n?glish", "block", []), url_rules.url_pattern("^$", "block", [])]
    cols = ["page_id", "host", "path", "rule", "verdict"]
    a = url_rules.judge(df, url_rules.PLACE_RULES, patterns).select(cols).collect()
    b = url_rules.judge_by_join(df, url_rules.rule_table(spark, [*url_rules.PLACE_RULES, *patterns])).select(cols).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    assert [r.verdict for r in sorted(a, key=lambda r: r.page_id) if r.page_id in (0, 1, 11)] == ["block", "block", "block"]


@pytest.mark.parametrize("bound", [200, 2])
def test_urls_with_columns_of_any_name(spark, monkeypatch, bound):
    monkeypatch.setattr(url_rules, "MAX_INLINE_RULES", bound)
    plain = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = url_rules.judge(plain, url_rules.PLACE_RULES, url_rules.URL_PATTERNS).select(cols).collect()
    extra = ["_tokens", "_candidates", "_fits", "_best", "_u", "_b", "_t"]
    clash = plain.selectExpr("*", *(f"'kept' as {c}" for c in extra), "'old' as Host", "1 as verdict")
    got = url_rules.judge(clash, url_rules.PLACE_RULES, url_rules.URL_PATTERNS)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, want))
    assert sorted(c.lower() for c in got.columns) == sorted(["page_id", "url", *extra, "host", "path", "rule", "verdict"])
    assert {tuple(r) for r in got.select(extra).collect()} == {("kept",) * len(extra)}


def test_rules_beyond_the_inline_bound_judge_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id int, url string")
    cols = ["page_id", "host", "path", "rule", "verdict"]
    want = url_rules.judge(df, url_rules.PLACE_RULES, url_rules.URL_PATTERNS).select(cols).collect()
    monkeypatch.setattr(url_rules, "MAX_INLINE_RULES", 2)
    got = url_rules.judge(df, url_rules.PLACE_RULES, url_rules.URL_PATTERNS).select(cols).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_only_candidates_run(spark):
    """The rule's regular expression would fit, but its token is not in the URL."""
    rule = url_rules.url_pattern("abc", "block", ["zzz"])
    df = spark.createDataFrame([(1, "http://abc/"), (2, "http://abc/zzz")], "page_id int, url string")
    assert {(r.page_id, r.verdict) for r in url_rules.judge(df, [], [rule]).collect()} == {(1, "allow"), (2, "block")}
    assert url_rules.judge(df.limit(0), url_rules.PLACE_RULES, []).collect() == []


def test_index_files_a_rule_under_its_rarest_token():
    assert url_rules.rarest(url_rules.PLACE_RULES, {"example": 9, "com": 5, "de": 2, "net": 1, "en": 7, "org": 0, "fr": 3}) == {"net": [0, 1], "de": [2], "org": [3]}


def brute_statistics(text):
    text = text or ""
    w = WORDS.findall(text)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t ", "a", "a b c", "a b c a b c", "x " * 200, "l\nl\n\nl \nl", "é ñ #* é ñ #* é ñ", "a\x0bb\x0cc\rd", "a\u00a0b \u2003c", "|".join("ab" for _ in range(90)), "one two three four " * 3000, "\n".join(["same line here"] * 70)]


def test_statistics_against_brute_force(spark):
    r = random.Random(5)
    texts = TEXTS + [" ".join(r.choice("abcde") for _ in range(r.randint(0, 60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id int, text string, repeat_ratio double")
    for row in quality_rules.text_statistics(df).collect():
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == brute_statistics(texts[row.doc_id]), texts[row.doc_id]


def test_rules_learn_what_marks_low_quality(spark):
    r = random.Random(1)
    clean = lambda: " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(r.randint(60, 90)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        text = clean()
        rows.append((i, " ".join(w + ("%%%" if r.random() < 0.5 else "") for w in text.split()) if bad else text, 3))
        if i < 300:
            labels.append((i, 0 if bad else 1))
    labels += [(None, 0), (7, None), (1, 0), (1, 1), (99999, 0)]
    docs = spark.createDataFrame(rows + [(None, None, 0), (3, rows[3][1], 3)], "doc_id long, text string, rule int")
    judged, rules = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert rules and all(len(x) <= quality_rules.MAX_CONDITIONS for x in rules)
    got = {x.doc_id: x for x in judged.collect()}
    assert sum(not got[i].kept for i in range(0, 400, 4)) >= 95
    assert all(got[i].kept for i in range(400) if i % 4)
    assert got[None].base_failed and not got[None].kept and judged.count() == 402


def test_rules_without_labels_are_the_base_rules(spark):
    docs = spark.createDataFrame([(1, "w " * 10), (2, " ".join(f"w{i}" for i in range(60)))], "doc_id long, text string")
    judged, rules = quality_rules.judge(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert rules == [] and {(x.doc_id, x.kept) for x in judged.collect()} == {(1, False), (2, True)}
    assert quality_rules.judge(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int"))[0].collect() == []


def test_fold_is_crc32_of_the_id_as_text(spark):
    from evigraph.llm.runtime import fold

    got = spark.range(50).select("id", fold(F.col("id"), 3).alias("f")).collect()
    assert all(x.f == zlib.crc32(str(x.id).encode()) % 3 for x in got)
