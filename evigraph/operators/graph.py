"""Closures over link tables, and overlaps of path reservations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..sources.state import drop, keep, new_folder
from .sizes import spread

MAX_ROUNDS = 10_000
#: Without use since frontiers are rows of one table; callers may still set it.
MERGE = 24


def undirected(edges: DataFrame, a: str, b: str, once: bool = True) -> DataFrame:
    """Both directions of every link as (src, dst), once each; links to itself and null ends are left out. What has no link
    is no vertex here; adjacency() keeps it. Without once a repeated link stays repeated, which spares a shuffle of all links."""
    one = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = one.union(edges.select(F.col(b), F.col(a))).where("src <> dst")
    return both.distinct() if once else both


def adjacency(nodes: DataFrame, node: str, edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, neighbours) of every node, isolated ones included: neighbours as a sorted array without repeats."""
    near = undirected(edges, a, b).groupBy(F.col("src").alias(node)).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))
    none = F.array().cast(near.schema["neighbours"].dataType)
    return nodes.select(node).distinct().join(near, node, "left").withColumn("neighbours", F.coalesce("neighbours", none))


def reachable(edges: DataFrame, seeds: DataFrame, node: str = "node", symmetric: bool = False) -> DataFrame:
    """(node, distance) of all that edges(src, dst) reach from the seeds, seeds at distance 0.

    A frontier loop: each round joins only what the last one found, takes away what is known, and is written once. symmetric
    says that every link goes both ways: what a round finds again is then in the last two frontiers, and only those are taken
    away, so the work of a round does not grow with the rounds before. Otherwise it is taken from all. Links and frontiers are
    tables in the shared folder whose sizes the planner knows: a small frontier is broadcast to the links, which then are only
    scanned. Repeated links do no harm.
    """
    spark = edges.sparkSession
    links, found, folder = new_folder(spark, "links"), new_folder(spark, "reached"), new_folder(spark, "frontier")
    edges = keep(edges, links)
    last = keep(seeds.select(F.col(node).alias("node")).where("node is not null").distinct().withColumn("distance", F.lit(0)), f"{folder}-0")
    known = keep(last, found)
    for k in range(1, MAX_ROUNDS):
        taken = known.where(F.col("distance") >= k - 2) if symmetric else known
        nearby = edges.join(last.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        last = keep(nearby.join(taken.select("node"), "node", "left_anti").withColumn("distance", F.lit(k)), f"{folder}-{k}")
        drop(spark, f"{folder}-{k - 1}")
        if last.isEmpty():
            drop(spark, links)
            return known
        known = keep(last, found)
    raise RuntimeError(f"the closure did not end in {MAX_ROUNDS} rounds")


def overlaps(left: DataFrame, right: DataFrame, key: str, parts: str, physical: str | None = None) -> DataFrame:
    """(left, right) keys of reservations that overlap: either path contains the other, or both are one physical file.

    The two prefix tests are equi-joins with exploded ancestors and the third one with the physical id; no pair is compared
    that does not overlap.
    """
    a, b = (df.select(F.col(key).alias("k"), F.col(parts).alias("p"), *([F.col(physical).alias("f")] if physical else [])) for df in (left, right))
    up = lambda df: df.select("k", F.explode(paths.ancestors(F.col("p"))).alias("p"))
    whole = lambda df: df.select("k", "p")
    pair = lambda x, y, on: x.withColumnRenamed("k", "left").join(y.withColumnRenamed("k", "right"), on).select("left", "right")
    found = pair(up(a), whole(b), "p").union(pair(whole(a), up(b), "p"))
    if physical:
        found = found.union(pair(a.select("k", "f"), b.select("k", "f"), "f"))
    return found.distinct()


def aliases(rows: DataFrame, key: str, physical: str) -> DataFrame:
    """(key, alias): every other name of the same physical file, itself included."""
    a = rows.select(F.col(key), F.col(physical).alias("_f"))
    return a.join(rows.select(F.col(key).alias("alias"), F.col(physical).alias("_f")), "_f").select(key, "alias").distinct()


def reach(edges: DataFrame, seeds: DataFrame, label: str, node: str) -> DataFrame:
    """(label, node, distance) of all that edges(src, dst) reach from each label's seeds: one frontier of (label, node) for all
    labels, so many sets cost as many rounds as the longest one."""
    spark = edges.sparkSession
    links, found, folder = new_folder(spark, "links"), new_folder(spark, "reached"), new_folder(spark, "frontier")
    edges = keep(edges, links)
    last = keep(seeds.select(F.col(label).alias("label"), F.col(node).alias("node")).where("node is not null").distinct().withColumn("distance", F.lit(0)), f"{folder}-0")
    known = keep(last, found)
    for k in range(1, MAX_ROUNDS):
        nearby = last.select("label", F.col("node").alias("src")).join(edges, "src").select("label", F.col("dst").alias("node")).distinct()
        last = keep(nearby.join(known, ["label", "node"], "left_anti").withColumn("distance", F.lit(k)), f"{folder}-{k}")
        drop(spark, f"{folder}-{k - 1}")
        if last.isEmpty():
            drop(spark, links)
            return known.select(F.col("label").alias(label), F.col("node").alias(node), "distance")
        known = keep(last, found)
    raise RuntimeError(f"the closure did not end in {MAX_ROUNDS} rounds")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every end of links that go both ways: component is the smallest node connected with it.

    By turns every node's larger neighbours, then its smaller ones and itself, are hung below its smallest neighbour, until
    nothing changes: the turns grow with the logarithm of the longest way. A node's links are only reduced to their minimum,
    before and after a shuffle, and joined with that one row.
    """
    spark, folder = edges.sparkSession, new_folder(edges.sparkSession, "components")
    rows = spread(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), edges.count(), "u")
    links = keep(rows.distinct(), f"{folder}-0")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
    before = mark(links)
    for turn in range(MAX_ROUNDS):
        both = spread(links.union(links.select("v", "u")), 2 * before[0], "u")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = keep(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), f"{folder}-hung-{turn}")
        low = spread(hung, before[0], "u")
        least = low.groupBy("u").agg(F.min("v").alias("m"))
        rest = low.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = keep(spread(rest.union(least.select("u", F.col("m").alias("v"))).where("u <> v"), before[0], "u").distinct(), f"{folder}-{turn + 1}")
        drop(spark, f"{folder}-hung-{turn}")
        drop(spark, f"{folder}-{turn}")
        now = mark(links)
        if now == before:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        before = now
    raise RuntimeError(f"the components did not settle in {MAX_ROUNDS} turns")


def alias_groups(rows: DataFrame, key: str, physical: str) -> DataFrame:
    """(key, representative, n_names) of every name: the smallest name of the same physical file, and how many it has.

    Names are summed by file before they move and then given their file's one row, so a file of many names costs a row a name
    and no pair. A name without a file stands for itself; repeated rows count once.
    """
    names = rows.select(F.col(key), F.col(physical).alias("_f")).distinct()
    held = names.where("_f is not null").groupBy("_f").agg(F.min(key).alias("representative"), F.count("*").alias("n_names"))
    out = names.join(held, "_f", "left")
    return out.select(key, F.coalesce("representative", F.col(key)).alias("representative"), F.coalesce("n_names", F.lit(1).cast("long")).alias("n_names"))


def follow_aliases(leases: DataFrame, label: str, key: str, groups: DataFrame) -> DataFrame:
    """(label, key, declared) of leases(label, key) with every other name of the files they name: who may write a file by one
    name writes it by all. groups are alias_groups(); a name that they lack stays as declared."""
    own = leases.select(label, key).distinct()
    held = own.join(groups, key).select(label, "representative").distinct()
    named = held.join(groups.select(key, "representative"), "representative").select(label, key)
    return own.withColumn("_o", F.lit(True)).join(named.distinct(), [label, key], "full").select(label, key, F.coalesce("_o", F.lit(False)).alias("declared"))
