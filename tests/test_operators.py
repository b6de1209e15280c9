"""One rule a test, on rows written by hand."""

import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evigraph.functions import hashing, paths
from evigraph.operators import delta, fanin, graph, integrity, ledger, lookup, paging, reduce, retention


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_fan_in_counts_by_lane_and_drops_unknown_uses(spark):
    defs = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "a"), (None, "z")], "mod string, name string")
    exact = spark.createDataFrame([("m", "a", False), ("m", "a", True), ("x", "y", False), (None, "z", False)], "mod string, name string, is_test boolean")
    broad = spark.createDataFrame([("m", True), ("m", False), ("m", False)], "mod string, is_test boolean")
    got = fanin.fan_in(defs, ["mod", "name"], exact, broad, ["mod"])
    assert rows(got, "mod", "name", *fanin.COUNTERS) == [("m", "a", 1, 1, 2, 1, 0), ("m", "b", 0, 0, 2, 1, 0), ("n", "a", 0, 0, 0, 0, 0), (None, "z", 0, 0, 0, 0, 0)]


def test_unused_keeps_test_only_uses_and_leaves_declarations(spark):
    defs = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", False)], "name string, decl boolean")
    exact = spark.createDataFrame([("a", True), ("a", True), ("b", False)], "name string, is_test boolean")
    got = fanin.unused(fanin.fan_in(defs, ["name"], exact), F.col("decl"))
    assert rows(got, "name", "claim") == [("a", "used only by tests (2)"), ("d", "no use found")]


def test_disposition_by_roles(spark):
    df = spark.createDataFrame(list(itertools.product([False, True], repeat=2)), "g boolean, v boolean")
    got = {(r.g, r.v): (r.d.kind, r.d.reason) for r in df.select("g", "v", fanin.disposition(F.col("g"), F.col("v")).alias("d")).collect()}
    assert got == {(False, False): ("actionable", None), (True, False): ("review-only", "generated"), (False, True): ("review-only", "vendored"), (True, True): ("review-only", "generated-vendored")}


def test_first_candidate_wins_whatever_the_rows_order(spark):
    reqs = spark.createDataFrame([(1, ["x", "b", "a"]), (2, ["q"]), (3, [None, "a"]), (4, [])], "id int, c array<string>")
    targets = spark.createDataFrame([("a", "A"), ("b", "B"), ("a", "A2")], "path string, t string")
    assert rows(lookup.first_candidate(reqs, "id", "c", targets, "path", "t"), "id", "target", "stage") == [(1, "B", 1), (2, None, None), (3, "A", 1), (4, None, None)]


def test_nearest_ancestor_is_by_component(spark):
    files = spark.createDataFrame([(["a", "bc", "f"],), (["a", "b", "f"],), (["z"],), ([],), (None,)], "p array<string>")
    roots = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b"],)], "r array<string>")
    got = {tuple(r.p) if r.p is not None else None: r.owner for r in lookup.nearest_ancestor(files, "p", roots, "r").collect()}
    assert got == {("a", "bc", "f"): ["a"], ("a", "b", "f"): ["a", "b"], ("z",): None, (): None, None: None}


def test_longest_pattern_prefers_exact_then_prefix_then_first(spark):
    df = spark.createDataFrame([("lib/x",), ("lib/y",), ("lib",), ("libq",), ("lx",)], "t string")
    got = {r.t: (r.matched, r.mapped) for r in lookup.longest_pattern(df, "t", [("l*", "1/*"), ("lib/*", "2/*"), ("lib/x", "3"), ("l*x", "4/*")]).collect()}
    assert got == {"lib/x": ("lib/x", "3"), "lib/y": ("lib/*", "2/y"), "lib": ("l*", "1/ib"), "libq": ("l*", "1/ibq"), "lx": ("l*", "1/x")}


def test_duplicates_have_no_winner(spark):
    df = spark.createDataFrame([("w", "a", 1), ("w", "a", 2), ("w", "b", 3), (None, "a", 4), (None, "a", 5)], "ws string, name string, id int")
    once, many = reduce.reject_duplicates(df, ["ws", "name"])
    assert rows(once, "id") == [(3,)]
    assert rows(many, "id", "n_claims") == [(1, 2), (2, 2), (4, 2), (5, 2)]


def test_latest_reports_conflicting_payloads(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c"), ("j", 5, "x"), ("j", 5, "x")], "k string, seq int, p string")
    got = {r.k: (r.seq, r.conflict) for r in reduce.latest(df, ["k"], ["seq"], ["p"]).collect()}
    assert got == {"k": (2, True), "j": (5, False)}


def test_worst_state(spark):
    df = spark.createDataFrame([("a", "complete"), ("a", "unavailable"), ("a", "incomplete"), ("b", "complete")], "k string, s string")
    assert rows(reduce.worst_state(df, ["k"], "s", ["complete", "incomplete", "unavailable"]), "k", "s") == [("a", "unavailable"), ("b", "complete")]


FACT = "k string, targets array<string>, affected array<string>, confidence int, evidence string"


def facts(spark, data):
    return spark.createDataFrame(data, FACT)


def compare(spark, base, current, **more):
    return delta.lifecycle(facts(spark, base), facts(spark, current), ["k"], ["targets", "affected"], ["confidence"], ["evidence"], **more)


def test_delta_classes(spark):
    base = [("same", ["a"], [], 1, "e"), ("gone", ["a"], [], 1, "e"), ("more", ["a"], [], 1, "e"), ("less", ["a", "b"], [], 1, "e"), ("swap", ["a"], [], 1, "e"), ("proof", ["a"], [], 1, "e"), ("rank", ["a"], [], 1, "e")]
    now = [("same", ["a"], [], 1, "e"), ("new", ["a"], [], 1, "e"), ("more", ["a", "b"], [], 1, "e"), ("less", ["a"], [], 1, "e"), ("swap", ["b"], [], 1, "e"), ("proof", ["a"], [], 1, "f"), ("rank", ["a"], [], 2, "e")]
    got = {r["k"]: (r["class"], r["regressions"], r["improvements"], r["incomparable"]) for r in compare(spark, base, now).collect()}
    assert got == {
        "same": ("unchanged", [], [], []),
        "gone": ("resolved", [], [], []),
        "new": ("introduced", [], [], []),
        "more": ("regressed", ["targets+b"], [], []),
        "less": ("improved", [], ["targets-b"], []),
        "swap": ("changed-incomparable", ["targets+b"], ["targets-a"], []),
        "proof": ("changed-incomparable", [], [], ["evidence"]),
        "rank": ("improved", [], ["confidence"], []),
    }


def test_delta_without_baseline(spark):
    assert {r["class"] for r in compare(spark, [], [("a", [], [], 1, "e")], baseline_available=False).collect()} == {"baseline-unavailable"}


fact = st.tuples(st.lists(st.sampled_from("abc"), unique=True), st.lists(st.sampled_from("xy"), unique=True), st.one_of(st.none(), st.integers(0, 2)), st.sampled_from(["e", "f", None]))
MIRROR = {"regressed": "improved", "improved": "regressed", "introduced": "resolved", "resolved": "introduced"}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), fact), st.one_of(st.none(), fact)), min_size=1, max_size=30))
def test_delta_is_total_and_antisymmetric(spark, pairs):
    side = lambda n: [(str(k), *p[n]) for k, p in enumerate(pairs) if p[n] is not None]
    if not side(0) and not side(1):
        return
    there = {r["k"]: r["class"] for r in compare(spark, side(0), side(1)).collect()}
    back = {r["k"]: r["class"] for r in compare(spark, side(1), side(0)).collect()}
    assert set(there) == {k for k, *_ in side(0)} | {k for k, *_ in side(1)}
    assert back == {k: MIRROR.get(v, v) for k, v in there.items()}


def test_merge_is_independent_of_order_and_counts_missing_values(spark):
    data = [("k", ["b", "a"], 2, "x"), ("k", ["c"], 1, None), ("k", ["a"], 3, "x")]
    for order in (data, data[::-1]):
        df = spark.createDataFrame(order, "k string, t array<string>, r int, v string").repartition(3)
        assert [tuple(r) for r in delta.merge_facts(df, ["k"], ["t"], ["r"], ["v"]).collect()] == [("k", ["a", "b", "c"], 1, [None, "x"])]


@pytest.mark.parametrize(("raised", "decision"), [([], "allow"), (["finding-warnings"], "allow-with-warnings"), (["opacity-introduced", "finding-warnings"], "incomplete"), (["unplanned-write", "analysis-failed"], "deny"), (["protected-input-changed", "unplanned-write"], "stale")])
def test_decision_is_the_strongest_effect(spark, raised, decision):
    df = spark.createDataFrame([(s, 1) for s in raised], "signal string, n long")
    assert tuple(delta.decide(df).first()) == (decision, len(raised))


def test_signals_of_one_delta_may_be_several(spark):
    df = compare(spark, [("k", ["a"], [], 2, "e")], [("k", ["b"], [], 1, "f")])
    got = {r.signal: r.n for r in delta.signals(df, ["confidence"]).collect()}
    assert got == {"adverse-fact-regressed": 1, "lifecycle-evidence-regressed": 1, "lifecycle-delta-incomparable": 1}


def test_pages_visit_every_row_once(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(101)], "a int, id int").repartition(5)
    columns, scope = [("a", False), ("id", True)], paging.Scope("run-1", "a-desc")
    seen, cursor, sizes = [], None, []
    while True:
        p = paging.page(df, columns, scope, cursor, 37)
        part = [(r.a, r.id) for r in p.rows.collect()]
        sizes.append(len(part))
        seen += part
        cursor = p.next_cursor
        if not p.truncated:
            break
    assert sizes == [37, 37, 27] and cursor is None
    assert seen == sorted(seen, key=lambda x: (-x[0], x[1])) and len(set(seen)) == 101


def test_cursor_is_bound_to_scope_and_row(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "id int")
    cursor = paging.page(df, [("id", True)], paging.Scope("r1", "o"), None, 2).next_cursor
    for bad, scope in ((cursor, paging.Scope("r2", "o")), (cursor, paging.Scope("r1", "p")), ("!!", paging.Scope("r1", "o"))):
        with pytest.raises(paging.CursorError):
            paging.page(df, [("id", True)], scope, bad, 2)
    with pytest.raises(paging.CursorError):
        paging.page(df.where("id <> 1"), [("id", True)], paging.Scope("r1", "o"), cursor, 2)


def test_closure_ends_on_cycles(spark):
    from evigraph.sources.state import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("d", "d"), (None, "a")], "u string, v string")
    seeds = spark.createDataFrame([("a",), ("d",)], "node string")
    assert rows(graph.reachable(graph.undirected(links, "u", "v"), seeds), "node", "distance") == [("a", 0), ("b", 1), ("c", 1), ("d", 0)]


def test_overlaps_by_path_either_way_and_physical_id(spark):
    a = spark.createDataFrame([(1, ["s"], "f1"), (2, ["s", "x", "y"], "f2"), (3, ["q"], "f9")], "k int, p array<string>, f string")
    b = spark.createDataFrame([(7, ["s", "x"], "f3"), (8, ["sx"], "f9")], "k int, p array<string>, f string")
    assert rows(graph.overlaps(a, b, "k", "p", "f"), "left", "right") == [(1, 7), (2, 7), (3, 8)]


def test_retention_reasons_and_strict_cutoff(spark):
    runs = spark.createDataFrame([("r1", "o", 1, 10, "C"), ("r2", "o", 2, 20, "F"), ("r3", "o", 3, None, "R"), ("r4", "o", 4, 5, "F"), ("r5", "o", 5, 6, "F"), ("r0", "o", 0, 30, "F")], "run string, owner string, seq int, finished long, state string")
    pins = spark.createDataFrame([("r5",), ("zz",)], "run string")
    why = retention.protection_reasons(runs, "run", "owner", ["seq"], "finished", "state = 'C'", pins)
    items, kept = retention.plan(runs, "run", "finished", 30, why)
    assert rows(items, "run") == [("r2",), ("r4",)]
    assert {r.run: r.reasons for r in kept.collect()} == {"r1": ["latest-completed"], "r5": ["latest-attempt", "pinned"]}
    assert retention.still_holds(items.select("run"), items.select("run"))
    assert not retention.still_holds(items.select("run"), kept.select("run"))


def test_checked_delete_refuses_changed_rows(spark):
    data = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, sha string")
    plan = spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "k string, sha string")
    stay, wrong = retention.checked_delete(data, "k", "sha", plan)
    assert rows(stay, "k") == [("b",), ("c",)]
    assert rows(wrong, "k", "planned", "found") == [("b", "x", "2"), ("d", "4", None)]


def test_ledger_breaks_at_the_first_wrong_link(spark):
    t = spark.createDataFrame([("p", 1, "a", "b"), ("p", 2, "b", "c"), ("q", 3, "a", "b"), ("q", 4, "z", "c"), ("q", 5, "c", "d")], "k string, seq int, before string, after string")
    base = spark.createDataFrame([("p", "a"), ("q", "a"), ("r", "a")], "k string, s string")
    assert rows(ledger.reconcile(t, ["k"], "seq", "before", "after", base, "s"), "k", "expected", "broken_at") == [("p", "c", None), ("q", "b", 4), ("r", "a", None)]


def test_paths(spark):
    df = spark.createDataFrame([("a/b", "./../c"), ("a", "../../x"), ("", "./q"), ("a/b", "../")], "d string, s string")
    got = [r[0] for r in df.select(paths.resolve_relative(paths.components(F.col("d")), F.col("s"))).collect()]
    assert got == [["a", "c"], None, ["q"], ["a"]]
    names = spark.createDataFrame([("react",), ("react/x",), ("@s/p/q",), ("@s",), ("./a",), ("/a",), ("#x",)], "s string")
    assert [r[0] for r in names.select(paths.package_name(F.col("s"))).collect()] == ["react", "react", "@s/p", None, None, None, None]
    order = spark.createDataFrame([("a/b",), ("z",), ("a",), ("aa",), ("é",)], "p string").orderBy(paths.canonical(paths.components(F.col("p"))))
    assert [r.p for r in order.collect()] == ["a", "z", "aa", "é", "a/b"]


def test_star_patterns(spark):
    df = spark.createDataFrame([("a/x/b", "a/*/b"), ("ab", "a*b"), ("a", "a*a"), ("a*b", "a*"), ("q", "q")], "t string, p string")
    assert [r[0] for r in df.select(paths.star_capture(F.col("t"), F.col("p"))).collect()] == ["x", "", None, "*b", None]
    assert spark.range(1).select(paths.star_replace(F.lit("d/*/*.js"), F.lit("x"))).first()[0] == "d/x/*.js"


def test_candidates_follow_extension_and_namespace(spark):
    df = spark.createDataFrame([("a/x.js", False, True), ("a/x.mjs", True, True), ("a/x", False, True), ("a/x", False, False), ("a/x.css", False, True)], "p string, t boolean, bare boolean")
    got = [r[0] for r in df.select(paths.candidate_paths(F.col("p"), F.col("t"), F.col("bare"))).collect()]
    assert got[0] == ["a/x.ts", "a/x.tsx", "a/x.js", "a/x.jsx"]
    assert got[1] == ["a/x.mts", "a/x.d.mts", "a/x.mjs"]
    assert got[2] == ["a/x.ts", "a/x.tsx", "a/x.js", "a/x.jsx"]
    assert got[3] == ["a/x"] and got[4] == ["a/x.css"]


def test_roles_kinds_and_globs(spark):
    df = spark.createDataFrame([("src/a.test.ts",), ("tests/a.ts",), ("src/a.d.mts",), ("src/testing.ts",), ("a.css",)], "p string")
    parts = paths.components(F.col("p"))
    assert [tuple(r) for r in df.select(integrity.test_like(parts), integrity.source_kind(F.col("p"))).collect()] == [(True, "ts"), (True, "ts"), (False, "declaration"), (False, "ts"), (False, None)]
    marks = spark.createDataFrame([("// @generated\nx",), ("/* a\n * @generated */",), ("const a = 1 // @generated",), ("x" * 3000 + "// @generated",)], "t string")
    assert [r[0] for r in marks.select(integrity.generated(F.col("t"))).collect()] == [True, True, False, False]
    globs = spark.createDataFrame([("packages/a",), ("packages/a/b",), ("x/y/z",), ("packages/old",)], "p string")
    assert [r[0] for r in globs.select(integrity.member(F.col("p"), ["packages/*", "x/**"], ["packages/old"])).collect()] == [True, False, True, False]


def test_identities_are_framed(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "x")], "x string, y string")
    got = [r[0] for r in df.select(hashing.content_identity(F.col("x"), F.col("y"), prefix="p-")).collect()]
    assert got[0] != got[1] and got[2] is None and got[0].startswith("p-") and len(got[0]) == 66
    assert spark.range(1).select(hashing.base64_url(F.lit("\xff" * 80).cast("binary"))).first()[0].count("\n") == 0


def test_closure_report_and_scopes(spark):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "c int"), spark.createDataFrame([(1,)], "p int")
    assert rows(integrity.closure_report([("x", child, parent, "c", "p"), ("y", child.where("c = 1"), parent, "c", "p")]), "check", "misses") == [("x", 2), ("y", 0)]
    assert rows(integrity.outside_scope(child, child.where("c = 1"), ["c"]), "c") == [(2,), (None,)]
    assert integrity.outside_scope(child, child.limit(0), ["c"], everything=parent).count() == 0
