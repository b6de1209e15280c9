"""Gate operators on small tables: nulls, repeats, empty sides."""

from evigraph.operators import delta, gates, graph


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_closing_inputs_know_what_was_fixed(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1), ("e", 1), ("g", 1)], "path string, h int")
    now = spark.createDataFrame([("a", 2), ("b", 2), ("c", 2), ("d", 2), ("f", 2), ("g", 1), (None, 3), ("n", 5)], "path string, h int")
    leased = spark.createDataFrame([("a",), ("a",)], "path string")
    fixed = spark.createDataFrame([("c", 2), ("d", 3), ("f", 2), ("a", 9)], "path string, h int")
    assert rows(gates.closing_inputs(base, now, "path", ["h"], leased, fixed)) == [
        ("a", "changed", "leased"), ("b", "changed", "unplanned"), ("c", "changed", "settled"), ("d", "changed", "protected"), ("e", "removed", "unplanned"), ("n", "added", "unplanned")]
    assert rows(gates.closing_signals(gates.closing_inputs(base, now, "path", ["h"], leased, fixed))) == [("protected-input-changed", 1), ("unplanned-write", 3)]
    assert rows(gates.closing_signals(gates.closing_inputs(base, base, "path", ["h"], leased, fixed))) == []


def test_references_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(gates, "BLOCK", 3)
    moves = spark.createDataFrame([("x" if s % 4 else "g2", s) for s in range(1, 20)], "gate string, seq long")
    held = spark.createDataFrame([("g1", 0), ("g2", 5), ("g3", 18), ("g4", 90)], "gate string, base long")
    want = sorted([("g1", s) for s in range(1, 20)] + [("g2", s) for s in range(6, 20) if s % 4] + [("g3", 19)], key=str)
    found = gates.attach(moves, held, "gate", "seq", "base")
    assert rows(found) == want
    have = spark.createDataFrame([*[x for x in want if x != ("g3", 19)], ("g4", 3), ("g1", 1)], "gate string, seq long")
    assert rows(gates.reference_faults(have, found, "gate", "seq")) == [("g1", 1, "duplicate"), ("g3", 19, "missing"), ("g4", 3, "unknown")]
    assert rows(gates.attach(moves.limit(0), held, "gate", "seq", "base")) == []


def test_bindings_bijections_and_conflicts(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, k string")
    held = spark.createDataFrame([("a", 10), ("b", 20), ("b", 21)], "k string, t int")
    assert rows(gates.bind_one(asked, held, ["k"], "t").select("id", "binding", "outcome")) == [(1, 10, "bound"), (2, None, "several"), (3, None, "none"), (4, None, "none")]
    assert rows(gates.bijection_faults(asked.select("k").where("k is not null"), held.select("k"), ["k"])) == [("b", "repeated"), ("c", "missing")]
    values = spark.createDataFrame([(1, "x"), (1, "x"), (2, "x"), (2, None), (3, None)], "k int, v string")
    assert rows(gates.conflicts(values, ["k"], "v")) == [(2, 2)]


def test_plans_and_tombstones(spark):
    plans = spark.createDataFrame([("p1", "planned"), ("p2", "confirmed"), ("p3", "planned"), ("p4", "confirmed")], "plan string, state string")
    done = spark.createDataFrame([("p1", "create"), ("p2", "create"), ("p2", "confirm"), ("p3", "create"), ("p3", "create"), ("p4", "create"), ("p9", "create")], "plan string, kind string")
    assert rows(gates.plan_closure(plans, done, "plan", "kind", "state")) == [("p3", "creations"), ("p4", "confirmation"), ("p9", "unknown-plan")]
    marks = spark.createDataFrame([(1, "d", "pruned"), (2, "x", "pruned"), (3, "d", "pruned"), (4, "d", "pruning"), (5, "d", "pruned")], "k int, d string, state string")
    items = spark.createDataFrame([(k, "d") for k in (1, 2, 3, 4)], "k int, d string")
    live = spark.createDataFrame([(3,)], "k int")
    assert rows(gates.tombstone_faults(marks, items, live, "k", "d", "state")) == [(2, "other-digest"), (3, "still-there"), (4, "already-gone"), (5, "not-planned")]


def test_facts_are_merged_by_distinct_members(spark):
    found = spark.createDataFrame([("k", ["b", "a"], 3, None), ("k", ["a"], 2, "v"), (None, None, 1, "w"), ("e", [], None, None)], "k string, s array<string>, r int, v string")
    assert rows(delta.merge_facts(found, ["k"], ["s"], ["r"], ["v"])) == sorted([("k", ["a", "b"], 2, [None, "v"]), (None, [], 1, ["w"]), ("e", [], None, [None])], key=str)


def test_decisions_by_key_and_isolated_nodes(spark):
    raised = spark.createDataFrame([(1, "finding-warnings"), (1, "unplanned-write"), (2, "never heard"), (3, None), (4, "analysis-contract-changed")], "k int, signal string")
    assert rows(delta.decide(raised, ["k"])) == [(1, "deny", 2), (2, "allow", 1), (3, "allow", 0), (4, "stale", 1)]
    nodes, links = spark.createDataFrame([(1,), (2,), (3,), (3,)], "n int"), spark.createDataFrame([(1, 2), (2, 1), (3, 3), (1, None)], "a int, b int")
    assert rows(graph.adjacency(nodes, "n", links, "a", "b")) == [(1, [2]), (2, [1]), (3, [])]


def test_closures_of_long_chains(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(graph, "MERGE", 3)
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = spark.createDataFrame([(k, k + 1) for k in range(9)] + [(9, 4)], "src long, dst long")
    seeds = spark.createDataFrame([(2,), (None,)], "node long")
    assert rows(graph.reachable(links, seeds)) == [(k, k - 2) for k in range(2, 10)]
    both = graph.undirected(links, "src", "dst")
    want = {2: 0, 3: 1, 1: 1, 4: 2, 0: 2, 5: 3, 9: 3, 6: 4, 8: 4, 7: 5}
    assert dict(rows(graph.reachable(both, seeds, symmetric=True))) == want
