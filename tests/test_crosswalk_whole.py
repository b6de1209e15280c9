"""Queries over every page against plain loops, on pages of which no id is a multiple of two, three or ten."""

from evigraph.plans import crosswalk

URLS = {1: "http://a.x/p/q?z", 7: "http://a.x/p/r#z", 11: "http://a.x", 13: "http://b.x/p", 17: "http://b.x/p/q/s", 19: "no url", 23: None, 29: "http://a.x/pq/", 31: "http://a.x/p/q"}


def parts_of(url):
    return [x for x in url.partition("://")[2].split("?")[0].split("#")[0].split("/") if x] if url and "://" in url else [] if url else None


def test_every_page_is_a_lease_and_a_root(spark, tmp_path):
    spark.createDataFrame(list(URLS.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    parts = {k: parts_of(v) for k, v in URLS.items()}
    covers = lambda a, b: b[: len(a)] == a
    pairs = sorted((a, b) for a, p in parts.items() for b, q in parts.items() if p is not None and q is not None and (covers(p[:2], q) or covers(q, p[:2])))
    got = crosswalk.QUERIES["lease_overlap"](spark, str(tmp_path)).collect()
    assert sorted((r.left, r.right) for r in got) == pairs
    owners = {k: (None, -1) if p is None else ("/".join(p[:2]), len(p[:2])) for k, p in parts.items()}
    got = crosswalk.QUERIES["most_specific_ancestor"](spark, str(tmp_path)).collect()
    assert {r.page_id: (r.owner, r.depth) for r in got} == owners


def test_the_closure_runs_over_all_lines(spark, tmp_path):
    lines = [(1, 5), (2, 5), (2, 6), (3, 6), (4, 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = crosswalk.QUERIES["adjacency_closure"](spark, str(tmp_path)).collect()
    assert sorted(r.node for r in got) == ["o1", "o2", "o3", "s5", "s6"]
