"""What must not grow with the rounds of a loop, or with the pairs of a result: size estimates, tasks and shuffled rows."""

import pytest
from pyspark.sql import functions as F

from evigraph.operators import demand, gates, graph, integrity, sizes
from evigraph.plans import crosswalk
from evigraph.sources.state import ensure_checkpoint_dir


@pytest.fixture(autouse=True)
def checkpoints(spark):
    ensure_checkpoint_dir(spark)


def estimate(df):
    """Bits of the planner's size estimate."""
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()


def test_estimates_do_not_grow_with_the_rounds_of_a_fixpoint(spark):
    files = spark.range(12).select(F.col("id").alias("key"), F.when(F.col("id") < 11, F.col("id") + 1).alias("extends"))
    seen = []

    def resolve(pending, known):
        seen.append(max(estimate(pending), estimate(known)))
        rows = pending.join(known, "key", "left")
        ends = F.coalesce(F.col("met") & F.col("extends").isNull(), F.lit(False))
        return rows.where(ends).select("id", "key"), rows.where(~ends).select("id", F.when(F.col("met"), F.col("extends")).otherwise(F.col("key")).alias("key"))

    none = files.where("false").withColumn("met", F.lit(True))
    start = spark.createDataFrame([(1, 0)], "id int, key long")
    found = demand.fixpoint(start, ["id"], ["key"], none, resolve, lambda keys: keys.join(files, "key", "left").withColumn("met", F.lit(True)))
    assert [tuple(r) for r in found.collect()] == [(1, 11)]
    assert len(seen) == 13 and max(seen) < 40


def test_reference_faults_of_many_rows_take_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sizes, "ROWS", 1000)
    moves = spark.range(1, 2001).select(F.lit("own").alias("gate"), F.col("id").alias("seq"))
    held = spark.range(5).select(F.concat(F.lit("g"), "id").alias("gate"), F.lit(0).cast("long").alias("base"))
    want = gates.attach(moves, held, "gate", "seq", "base")
    assert want.rdd.getNumPartitions() == 10
    nulls = spark.createDataFrame([(None, 1), ("g0", None)], "gate string, seq long")
    have = want.where("seq <> 7").union(want.where("seq = 9")).union(nulls)
    found = gates.reference_faults(have, want.union(nulls), "gate", "seq")
    assert found.rdd.getNumPartitions() == 21
    expected = [(f"g{k}", s, f) for k in range(5) for s, f in ((7, "missing"), (9, "duplicate"))] + [(g, s, f) for g, s in ((None, 1), ("g0", None)) for f in ("missing", "unknown")]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str)


def test_a_symmetric_difference_of_many_rows_takes_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(sizes, "ROWS", 1000)
    side = lambda a, b: spark.range(a, b).select("id", F.when(F.col("id") % 2 == 0, "even").alias("kind")).union(spark.range(a, b).select("id", F.lit(None)))
    found = integrity.symmetric_difference(side(0, 3000), side(5, 3002))
    assert found.rdd.getNumPartitions() == 12
    want = {(i, k, s) for i, s in ((0, "left"), (1, "left"), (2, "left"), (3, "left"), (4, "left"), (3000, "right"), (3001, "right")) for k in ({"even", None} if i % 2 == 0 else {None})}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)


def test_estimates_do_not_grow_with_the_rounds_of_closures_and_components(spark):
    chain = spark.range(30).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    seeds = spark.createDataFrame([(0,)], "node long")
    for both in (graph.undirected(chain, "a", "b"), graph.undirected(chain.union(chain), "a", "b", once=False)):
        found = graph.reachable(both, seeds, symmetric=True)
        assert estimate(found) < 40 and sorted(map(tuple, found.collect())) == [(k, k) for k in range(31)]
    found = graph.components(chain, "a", "b")
    assert estimate(found) < 64 and {tuple(r) for r in found.collect()} == {(k, 0) for k in range(31)}


def test_protected_inputs_are_no_pair_twice(spark):
    """Paths of several states, a gate without a name, and repeated rows."""
    inputs = spark.createDataFrame([("a", "source"), ("a", "source"), ("a", "missing"), ("b", "source"), ("c", "source"), ("d", "missing"), ("d", "unreadable"), ("e", None), ("f", "other")], "path string, state string")
    links = spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string")
    leases = spark.createDataFrame([("g", "file", "a"), ("g", "file", "b"), ("h", "directory", "z"), (None, "file", "a"), (None, "new-file", "q"), ("i", None, "b")], "gate string, kind string, path string")
    found = gates.protected_inputs(leases, "gate", "kind", "path", inputs, links, "x", "y")
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString().partition("Union")[0]
    want = {"g": "abd", "h": "abcd", None: "abcd", "i": "ad"}
    assert sorted(map(tuple, found.collect()), key=str) == sorted(((g, p) for g, ps in want.items() for p in ps), key=str)


def test_overlapping_leases_shuffle_no_pairs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(crosswalk, "_PAIRS", 7)
    urls = [(k, f"http://a.x/p/{k % 3}") for k in range(20)] + [(3, "http://a.x/p/other"), (3, "http://b.x/q"), (4, "http://b.x/q"), (None, "http://b.x/q"), (30, "none"), (31, None)]
    spark.createDataFrame(urls, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    found = crosswalk.QUERIES["lease_overlap"](spark, str(tmp_path))
    parts = {(k, tuple(x for x in u.partition("://")[2].split("/") if x)) for k, u in urls if u}
    want = {(a, b) for a, p in parts for b, q in parts if p[:2] == q[:2] or not p or not q}
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and not plan.splitlines()[1].startswith("+- Aggregate") and not plan.splitlines()[1].startswith(":- Aggregate")
