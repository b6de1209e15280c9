"""Set identities, protection, demand, capabilities, payloads, aliases, patterns, plan pages and streams on small cases."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from evigraph.functions import paths
from evigraph.operators import capabilities, delta, demand, gates, graph, identity, lookup, paging
from evigraph.sources.state import ensure_checkpoint_dir
from evigraph.streaming import latest, reconcile


@pytest.fixture(autouse=True)
def checkpoints(spark):
    ensure_checkpoint_dir(spark)


def one(df):
    return df.first()["identity"]


def test_identity_of_a_set_has_no_order_and_adds_up(spark):
    rows = [(f"p{k}", None if k % 7 == 0 else f"v{k % 5}") for k in range(500)]
    df = lambda xs: spark.createDataFrame(xs, "p string, v string")
    same = one(identity.set_identity(df(rows), ["p", "v"]))
    assert one(identity.set_identity(df(rows[::-1] + rows[:9]).repartition(7), ["p", "v"])) == same
    assert one(identity.set_identity(df(rows[1:]), ["p", "v"])) != same
    assert one(identity.set_identity(df([("", None)]), ["p", "v"])) != one(identity.set_identity(df([(None, "")]), ["p", "v"]))
    assert identity.set_identity(df([]), ["p"]).first()["n"] == 0
    assert one(identity.set_identity(df(rows + rows), ["p", "v"], distinct=False)) != same
    other = rows[:-1] + [("p499", "changed"), ("new", None)]
    got = {tuple(r) for r in identity.changed_members(df(rows), df(other), ["p", "v"]).collect()}
    assert got == {("p499", "v4", "before"), ("p499", "changed", "after"), ("new", None, "after")}


def test_states_of_inputs(spark):
    sources = spark.createDataFrame([("a.ts", "d1", "1:1"), ("a.ts", "d1", "1:1")], "path string, payload_sha256 string, physical_id string")
    asked = [("x.json", "config-present", "d", "1:2", None), ("y.json", "missing", "d", "1:3", None), ("z", "non-regular", "d", "1:4", None), ("u", "unreadable", None, "1:5", "why")]
    got = {r.path: r for r in identity.semantic_inputs(sources, spark.createDataFrame(asked, "path string, state string, payload_sha256 string, physical_id string, detail string")).collect()}
    assert len(got) == 5 and got["a.ts"].state == "source" and got["x.json"].payload_sha256 == "d"
    assert (got["y.json"].payload_sha256, got["y.json"].physical_id, got["z"].payload_sha256) == (None, None, None)
    assert len(got["u"].payload_sha256) == 64 and got["u"].physical_id == "1:5"


def test_directories_of_any_size(spark):
    files = spark.range(200_000).select(F.array(F.lit("big"), F.concat(F.lit("f"), "id")).alias("parts"), F.sha2(F.col("id").cast("string"), 256).alias("d"), F.col("id").alias("s"))
    more = spark.createDataFrame([(["a", "b", "c"], "x", 3), (["a", "f"], "y", 4), (["top"], "z", 5), ([], "no", 1)], "parts array<string>, d string, s long")
    read = lambda df: {"/".join(r.path): r for r in identity.directory_identities(df, "parts", "d", "s").collect()}
    got, moved = read(files.union(more)), read(files.union(more.replace("x", "w", "d")))
    assert {k: (r.depth, r.n_entries, r.n_files) for k, r in got.items()} == {"": (0, 3, 200_003), "a": (1, 2, 2), "a/b": (2, 1, 1), "big": (1, 200_000, 200_000)}
    assert got[""].bytes == 12 + 199_999 * 100_000
    assert {k for k in got if got[k].identity != moved[k].identity} == {"", "a", "a/b"}
    assert read(more.where(F.size("parts") == 0)) == {}


def brute_component(links, node):
    seen, stack = {node}, [node]
    while stack:
        x = stack.pop()
        for a, b in links:
            for y, z in ((a, b), (b, a)):
                if y == x and z not in seen:
                    seen.add(z)
                    stack.append(z)
    return seen


def test_components_reach_and_protection(spark):
    r = random.Random(4)
    links = [(f"n{r.randint(0, 60)}", f"n{r.randint(0, 60)}") for _ in range(45)] + [(f"c{k}", f"c{k + 1}") for k in range(40)] + [("n1", None)]
    df = spark.createDataFrame(links, "a string, b string")
    whole = [x for x in links if None not in x]
    got = {x.node: x.component for x in graph.components(df, "a", "b").collect()}
    assert got == {n: min(brute_component(whole, n)) for e in whole if e[0] != e[1] for n in e}
    seeds = spark.createDataFrame([("g", "c0"), ("h", "c38"), ("g", "n0"), ("h", None)], "gate string, node string")
    found = {(x.gate, x.node): x.distance for x in graph.reach(df.selectExpr("a as src", "b as dst").where("b is not null"), seeds, "gate", "node").collect()}
    assert {k: v for k, v in found.items() if k[1].startswith("c")} == {("g", f"c{k}"): k for k in range(41)} | {("h", "c38"): 0, ("h", "c39"): 1, ("h", "c40"): 2}
    names = sorted({n for e in whole for n in e} | {"lonely"})
    inputs = spark.createDataFrame([(n, "source") for n in names] + [("conf", "config-present"), ("none", "missing")], "path string, state string")
    leases = spark.createDataFrame([("g", "file", "c3"), ("g", "file", "lonely"), ("h", "directory", "d"), ("i", "new-file", "x"), ("i", "file", "c3"), ("j", "file", "no source")], "gate string, kind string, path string")
    kept = {}
    for x in gates.protected_inputs(leases, "gate", "kind", "path", inputs, df, "a", "b").collect():
        kept.setdefault(x.gate, set()).add(x.path)
    config = {"conf", "none"}
    assert kept == {"g": {f"c{k}" for k in range(41)} | {"lonely"} | config, "h": {*names, *config}, "i": {*names, *config}, "j": config}


def test_demand_chains_circles_and_stalls(spark):
    files = {"a": "b", "b": "c", "c": None, "x": "y", "y": "x", "s": "s", "lost": "nowhere"}
    schema = "key string, extends string, met boolean"
    table = spark.createDataFrame([(k, v, True) for k, v in files.items()], schema)
    asked = []

    def fetch(keys):
        asked.append(sorted(r.key for r in keys.collect()))
        return keys.join(table.drop("met"), "key", "left").withColumn("met", F.lit(True))

    def resolve(pending, known):
        rows = pending.join(known, "key", "left")
        ends = F.coalesce(F.col("met") & F.col("extends").isNull(), F.lit(False))
        waits = rows.where(~ends).select("id", F.when(F.col("met").isNotNull(), F.col("extends")).otherwise(F.col("key")).alias("key"))
        return rows.where(ends).select("id", F.col("key").alias("end")), waits

    def run(*starts):
        asked.clear()
        pending = spark.createDataFrame(list(enumerate(starts)), "id int, key string")
        return {r.id: r.end for r in demand.fixpoint(pending, ["id"], ["key"], spark.createDataFrame([], schema), resolve, fetch).collect()}

    assert run("a", "c", "b", "lost") == {0: "c", 1: "c", 2: "c", 3: "nowhere"}
    assert sorted(itertools.chain(*asked)) == ["a", "b", "c", "lost", "nowhere"]  # each once
    for starts in (("x",), ("a", "s")):
        with pytest.raises(demand.Stalled, match="again"):
            run(*starts)


def test_capability_states_travel_along_needs(spark):
    declared = spark.createDataFrame([(c,) for c in "abcdefg"], "c string")
    records = spark.createDataFrame([(c, "complete") for c in "abcdef"] + [("f", "failed"), ("b", "incomplete")], "c string, state string")
    gaps = spark.createDataFrame([("c", True)] * 3 + [("d", False), ("d", None)], "c string, soft boolean")
    own = capabilities.own_states(declared, "c", records, gaps, "soft")
    got = {r.c: (r.state, r.n_required, r.n_advisory) for r in own.collect()}
    assert got == {"a": ("complete", 0, 0), "b": ("incomplete", 0, 0), "c": ("complete", 0, 3), "d": ("incomplete", 2, 0), "e": ("complete", 0, 0), "f": ("failed", 0, 0), "g": ("unavailable", 0, 0)}
    needs = spark.createDataFrame([("a", "b"), ("b", "e"), ("e", "b"), ("c", "a"), ("e", "g"), ("d", "unknown"), ("a", None)], "c string, n string")
    folded = {r.c: r.effective for r in capabilities.folded(own, "c", needs, "n").collect()}
    assert folded == {"a": "unavailable", "b": "unavailable", "c": "unavailable", "d": "unavailable", "e": "unavailable", "f": "failed", "g": "unavailable"}
    assert {r.effective for r in capabilities.folded(own, "c", needs.limit(0), "n").collect()} == {"complete", "incomplete", "failed", "unavailable"}


def test_payloads_by_field_and_null_keys(spark):
    schema = "k string, payload map<string,struct<value:string,rank:int>>"
    df = lambda rows: spark.createDataFrame(rows, schema)
    base = df([("a", {"r": ("high", 3), "u": ("x", None)}), ("b", {"r": ("low", 1)}), ("c", {"r": ("m", 2)}), ("d", {"u": ("x", None)}), (None, {"u": ("x", None)}), ("m", {"r": ("a", 1), "s": ("q", 1)}), ("m", {"r": ("b", 2)}), ("e", None)])
    now = df([("a", {"r": ("low", 1), "u": ("x", None)}), ("b", {"r": ("high", 3)}), ("c", {}), ("d", {"u": ("y", None)}), (None, {"u": ("x", None)}), ("m", {"r": ("b", 2)}), ("m", {"r": ("a", 1), "s": ("q", 1)}), ("e", {})])
    merged = [delta.merge_payloads(x, ["k"], "payload") for x in (base, now)]
    held = {r.k: r.payload for r in merged[0].collect()}
    assert held["m"]["r"].rank is None and held["m"]["r"].value == "a@1,b@2" and held["m"]["s"].value == "q@1,absent" and held["e"] == {}
    got = {r.k: (r["class"], r.regressions, r.improvements, r.incomparable) for r in delta.lifecycle(*merged, ["k"], payload="payload").collect()}
    assert got["a"] == ("regressed", ["payload.r"], [], []) and got["b"] == ("improved", [], ["payload.r"], [])
    assert got["c"] == ("changed-incomparable", [], [], ["payload.r"]) and got["d"] == ("changed-incomparable", [], [], ["payload.u"])
    assert {k: got[k][0] for k in (None, "m", "e")} == {None: "unchanged", "m": "unchanged", "e": "unchanged"}


def test_a_file_of_many_names_takes_a_row_each(spark):
    names = spark.range(100_000).select(F.format_string("n%06d", "id").alias("name"), F.lit("1:1").alias("file"))
    few = spark.createDataFrame([("x", "1:2"), ("y", "1:2"), ("y", "1:2"), ("z", None)], "name string, file string")
    groups = graph.alias_groups(names.union(few), "name", "file").checkpoint()
    assert groups.count() == 100_003
    assert {tuple(r) for r in groups.where("name in ('x', 'y', 'z', 'n000007')").collect()} == {("x", "x", 2), ("y", "x", 2), ("z", "z", 1), ("n000007", "n000000", 100_000)}
    leases = spark.createDataFrame([("g", "n000007"), ("h", "y"), ("h", "elsewhere")], "gate string, name string")
    held = graph.follow_aliases(leases, "gate", "name", groups)
    assert held.where("gate = 'g'").count() == 100_000 and held.where("declared").count() == 3
    assert {(r.name, r.declared) for r in held.where("gate = 'h'").collect()} == {("x", False), ("y", True), ("elsewhere", True)}


def brute_pattern(text, patterns):
    best = None
    for pattern, order in patterns:
        head, star, tail = pattern.partition("*")
        if star and text.startswith(head) and text.endswith(tail) and len(text) >= len(head) + len(tail):
            rank, captured = (False, len(head), -order), text[len(head) : len(text) - len(tail)]
        elif not star and text == pattern:
            rank, captured = (True, len(pattern), -order), ""
        else:
            continue
        if best is None or rank > best[0]:
            best = (rank, pattern, order, captured)
    return best[1:] if best else (None, None, None)


def test_patterns_by_both_ends(spark):
    r = random.Random(1)
    some = lambda n: "".join(r.choice("ab/é") for _ in range(r.randint(0, n)))
    patterns = [(r.choice("gh"), p, k) for k, p in enumerate(r.choice([some(3) + "*" + some(2), some(4), "*"]) for _ in range(300))]
    texts = [(r.choice("ghi"), some(6)) for _ in range(200)] + [("g", None), (None, "ab")]
    got = lookup.longest_pattern_of(spark.createDataFrame(texts, "root string, spec string"), "spec", spark.createDataFrame(patterns, "root string, p string, o int"), "p", "o", ["root"])
    want = [(g, t, *(brute_pattern(t, [(p, o) for own, p, o in patterns if own == g]) if t is not None else (None, None, None))) for g, t in texts]
    assert sorted(map(tuple, got.select("root", "spec", "key", "order", "captured").collect()), key=str) == sorted(want, key=str)


def test_ten_thousand_patterns_meet_only_what_fits(spark):
    held = spark.range(10_000).select(F.lit("g").alias("root"), F.format_string("@lib%05d/*", "id").alias("p"), F.col("id").cast("int").alias("o"))
    asked = spark.range(5_000).select(F.lit("g").alias("root"), F.format_string("@lib%05d/x%d", F.col("id") * 3, "id").alias("spec"))
    got = lookup.longest_pattern_of(asked, "spec", held, "p", "o", ["root"])
    assert got.where("key is not null").count() == 3_334 and got.where("captured = 'x7'").first()["order"] == 21


def test_plan_pages_cross_tables(spark):
    a = spark.createDataFrame([(k, f"i{k}") for k in range(5)], "k int, name string")
    b = spark.createDataFrame([(f"e{k}", ["why"]) for k in range(4)], "id string, reasons array<string>")
    scope, order = paging.Scope("plan", "o"), [[("k", False)], [("id", True)]]
    seen, cursor = [], None
    while True:
        page = paging.tagged_page([a, b], order, scope, cursor, 3)
        seen += [(r.tag, r.name or r.id) for r in sorted(page.rows.collect(), key=lambda r: (r.tag, -(r.k or 0), r.id or ""))]
        cursor = page.next_cursor
        if not page.truncated:
            break
    assert seen == [(0, f"i{k}") for k in (4, 3, 2, 1, 0)] + [(1, f"e{k}") for k in range(4)] and cursor is None
    first = paging.tagged_page([a, b], order, scope, None, 5)
    assert first.truncated and {r.id for r in paging.tagged_page([a, b], order, scope, first.next_cursor, 9).rows.collect()} == {f"e{k}" for k in range(4)}
    for bad in (paging.encode_cursor(scope, [7, 1]), paging.encode_cursor(scope, [0]), paging.encode_cursor(scope, [0, 99])):
        with pytest.raises(paging.CursorError):
            paging.tagged_page([a, b], order, scope, bad, 3)


def stream(spark, folder, rows, schema):
    """Adds a file to a stream's folder and opens the stream."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


def test_pointers_keep_the_latest_version(spark, tmp_path):
    schema, top = "k string, seq long, v string", f"file://{tmp_path}"
    parts = [[("a", 5, "five"), ("b", 1, "one")], [("a", 3, "late"), ("a", 5, "five"), ("c", None, "null")], [("b", 2, "two"), ("b", 2, "other"), ("a", 4, "late")]]
    for rows in parts:
        latest.follow(stream(spark, f"{top}/in", rows, schema), ["k"], ["seq"], ["v"], f"{top}/out", f"{top}/state").awaitTermination()
    got = {r.k: (r.seq, r.v, r.conflict) for r in latest.pointers(spark.read.parquet(f"{top}/out"), ["k"]).collect()}
    assert got["a"] == (5, "five", False) and got["c"] == (None, "null", False) and got["b"][0] == 2 and got["b"][2]


def test_a_ledger_goes_on_after_a_restart(spark, tmp_path):
    schema, top = "k string, seq long, b string, a string, base string", f"file://{tmp_path}"
    parts = [[("x", 2, "B", "C", "A"), ("x", 1, "A", "B", "A"), ("y", 1, None, "P", None), ("z", 1, "Q", "R", "S")], [("x", 3, "C", "D", "A"), ("x", 2, "no", "late", "A"), ("y", 4, "wrong", "Z", None), ("z", 2, "R", "T", "S")], [("y", 5, "P", "Q", None)]]
    for rows in parts:
        reconcile.follow(stream(spark, f"{top}/in", rows, schema), "k", "seq", "b", "a", f"{top}/out", f"{top}/state", "base").awaitTermination()
    got = {r.key: (r.expected, r.broken_at, r.last, r.late) for r in reconcile.ledger_state(spark.read.parquet(f"{top}/out")).collect()}
    assert got == {"x": ("D", None, 3, 1), "y": ("P", 4, 5, 0), "z": ("S", 1, 2, 0)}


def test_paths_of_directories_are_components(spark):
    row = spark.createDataFrame([("a//b/c",)], "p string").select(paths.components(F.col("p")).alias("x")).first()
    assert row.x == ["a", "b", "c"]
