"""The operators applied to the driver's tables, each with the SQL it is checked against.

Every query works on whole tables. Thresholds in them (quantities, dates, price bounds) tell lanes, scopes and snapshots apart;
rows on either side of them count.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..operators import delta, fanin, gates, graph, integrity, ledger, lookup, paging, reduce, retention
from . import report, specimen

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line is a use of its part; all but large, well discounted ones are the test lane."""
    lines = _table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_partkey").alias("p_partkey"), F.expr("not (l_quantity >= 48 and l_discount >= 0.06)").alias("is_test"))


def _brand_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses that name a brand only: every order with any of its parts, in the test lane if it has no line of at least 50."""
    lines = _table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_quantity")
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    found = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_orderkey")
    return found.agg(F.min((F.col("l_quantity") < 50).cast("int")).alias("t")).select("p_brand", (F.col("t") == 1).alias("is_test"))


_USES = "SELECT l_partkey, NOT (l_quantity >= 48 AND l_discount >= 0.06) AS is_test FROM lineitem"
_EXACT = f"SELECT l_partkey AS k, count(*) FILTER (NOT is_test) AS pe, count(*) FILTER (is_test) AS te FROM ({_USES}) GROUP BY 1"
_BRAND = """SELECT p_brand AS b, count(*) FILTER (t = 0) AS pb, count(*) FILTER (t = 1) AS tb FROM (
  SELECT p_brand, l_orderkey, min(CAST(l_quantity < 50 AS INT)) AS t FROM lineitem JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2) GROUP BY 1"""


@query(f"SELECT p_partkey, p_brand, coalesce(pe, 0) AS production_exact, coalesce(te, 0) AS test_exact FROM part LEFT JOIN ({_EXACT}) ON p_partkey = k")
def fan_in_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return fanin.fan_in(parts, ["p_partkey"], exact=_uses(spark, sf_dir)).select("p_partkey", "p_brand", "production_exact", "test_exact")


@query(
    f"""SELECT p_partkey, p_brand, coalesce(te, 0) AS test_uses,
    CASE WHEN coalesce(te, 0) > 0 THEN 'used only by tests (' || te || ')' ELSE 'no use found' END AS claim
    FROM part LEFT JOIN ({_EXACT}) ON p_partkey = k WHERE coalesce(pe, 0) = 0"""
)
def zero_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    counted = fanin.fan_in(parts, ["p_partkey"], exact=_uses(spark, sf_dir))
    return fanin.unused(counted).select("p_partkey", "p_brand", "test_uses", "claim")


@query(f"SELECT p_partkey, p_brand, coalesce(pb, 0) AS production_broad, coalesce(tb, 0) AS test_broad FROM part LEFT JOIN ({_BRAND}) ON p_brand = b")
def broad_fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    counted = fanin.fan_in(parts, ["p_partkey"], broad=_brand_uses(spark, sf_dir), broad_keys=["p_brand"])
    return counted.select("p_partkey", "p_brand", "production_broad", "test_broad")


@query(
    f"""SELECT p_partkey, coalesce(pe, 0) AS production_exact, coalesce(te, 0) AS test_exact, coalesce(pb, 0) AS production_broad,
    coalesce(tb, 0) AS test_broad, coalesce(n, 0) AS public_surface FROM part LEFT JOIN ({_EXACT}) ON p_partkey = k
    LEFT JOIN ({_BRAND}) ON p_brand = b LEFT JOIN (SELECT p_type AS y, count(*) AS n FROM part WHERE p_retailprice >= 990 GROUP BY 1) ON p_type = y"""
)
def exact_plus_broad_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part")
    public = parts.where("p_retailprice >= 990").select("p_type")
    counted = fanin.fan_in(parts, ["p_partkey"], _uses(spark, sf_dir), _brand_uses(spark, sf_dir), ["p_brand"], public, ["p_type"])
    return counted.select("p_partkey", *fanin.COUNTERS)


@query(
    """WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey, s_acctbal >= 5000 AS rich FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    n AS (SELECT s_nationkey AS k, min(s_suppkey) AS t FROM s WHERE rich GROUP BY 1), p AS (SELECT s_nationkey AS k, min(s_suppkey) AS t FROM s WHERE NOT rich GROUP BY 1), r AS (SELECT n_regionkey AS k, min(s_suppkey) AS t FROM s WHERE rich GROUP BY 1)
    SELECT c_custkey, coalesce(n.t, p.t, r.t) AS target, CASE WHEN n.t IS NOT NULL THEN 0 WHEN p.t IS NOT NULL THEN 1 WHEN r.t IS NOT NULL THEN 2 END AS stage
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN n ON n.k = c_nationkey LEFT JOIN p ON p.k = c_nationkey LEFT JOIN r ON r.k = n_regionkey"""
)
def ordered_candidate_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    """A rich supplier of the customer's nation, else another one there, else a rich one of its region."""
    at = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    customers = _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    customers = customers.select("c_custkey", F.array(at("n", "c_nationkey"), at("p", "c_nationkey"), at("r", "n_regionkey")).alias("candidates"))
    suppliers = _table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    offers = F.when(F.col("s_acctbal") >= 5000, F.array(at("n", "s_nationkey"), at("r", "n_regionkey"))).otherwise(F.array(at("p", "s_nationkey")))
    targets = suppliers.select("s_suppkey", F.explode(offers).alias("path"))
    return lookup.first_candidate(customers, "c_custkey", "candidates", targets, "path", "s_suppkey").select("c_custkey", "target", "stage")


def _page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the components of host and path."""
    return _table(spark, sf_dir, "pages").select("page_id", paths.components(F.regexp_extract("url", "://([^?#]*)", 1)).alias("parts"))


_PAGE = "SELECT page_id, list_filter(string_split(regexp_extract(url, '://([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM pages"


@query(
    f"""WITH p AS ({_PAGE}), r AS (SELECT DISTINCT parts[1:2] AS owner FROM p UNION SELECT DISTINCT parts[1:1] FROM p)
    SELECT page_id, array_to_string(arg_max(owner, len(owner)), '/') AS owner, coalesce(CAST(max(len(owner)) AS INT), -1) AS depth
    FROM p LEFT JOIN r ON p.parts[1:len(owner)] = owner GROUP BY page_id"""
)
def most_specific_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first one and two components of every page are roots."""
    pages = _page_paths(spark, sf_dir)
    roots = pages.select(F.slice("parts", 1, 2).alias("root")).union(pages.select(F.slice("parts", 1, 1))).distinct()
    found = lookup.nearest_ancestor(pages, "parts", roots, "root")
    return found.select("page_id", paths.display(F.col("owner")).alias("owner"), F.coalesce(F.size("owner"), F.lit(-1)).alias("depth"))


_PATTERNS = [("small *", "tiny/*"), ("* gear", "gear/*"), ("small gizmo", "exact"), ("s*", "other/*"), ("red *", "red/*"), ("r*t", "rt/*")]


@query(
    """SELECT p_partkey, matched, CASE matched WHEN 'small gizmo' THEN 'exact' WHEN 'small *' THEN 'tiny/' || p_name[7:] WHEN 'red *' THEN 'red/' || p_name[5:]
    WHEN 's*' THEN 'other/' || p_name[2:] WHEN 'r*t' THEN 'rt/' || p_name[2:-2] WHEN '* gear' THEN 'gear/' || p_name[:-6] END AS mapped
    FROM (SELECT p_partkey, p_name, CASE WHEN p_name = 'small gizmo' THEN 'small gizmo' WHEN p_name LIKE 'small %' THEN 'small *' WHEN p_name LIKE 'red %' THEN 'red *'
      WHEN p_name LIKE 's%' THEN 's*' WHEN p_name LIKE 'r%t' THEN 'r*t' WHEN p_name LIKE '% gear' THEN '* gear' END AS matched FROM part)"""
)
def longest_pattern_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.longest_pattern(_table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", _PATTERNS).drop("p_name")


@query(
    """WITH k AS (SELECT DISTINCT p_brand, p_name[1:2] || '*' AS key FROM part WHERE p_size <= 10 UNION SELECT DISTINCT p_brand, p_name FROM part WHERE p_size = 11
      UNION SELECT DISTINCT p_brand, p_name[1:1] || '*' FROM part WHERE p_size >= 40)
    SELECT p_partkey, arg_max(key, struct_pack(x := key NOT LIKE '%*', l := CASE WHEN key LIKE '%*' THEN len(key) - 1 ELSE len(key) END)) AS key
    FROM part LEFT JOIN k ON part.p_brand = k.p_brand AND (key = p_name OR (key LIKE '%*' AND starts_with(p_name, key[:-2]))) GROUP BY p_partkey"""
)
def most_specific_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    star = lambda n, where: parts.where(where).select("p_brand", F.concat(F.substring("p_name", 1, n), F.lit("*")).alias("pattern"))
    keys = star(2, "p_size <= 10").union(parts.where("p_size = 11").select("p_brand", "p_name")).union(star(1, "p_size >= 40")).distinct()
    return lookup.most_specific_key(parts.select("p_partkey", "p_brand", "p_name"), "p_name", keys, "pattern", ["p_brand"]).select("p_partkey", "key")


@query("SELECT doc_id, n AS n_claims FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def duplicate_identity_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("identity"))
    return reduce.reject_duplicates(docs, ["identity"])[1].select("doc_id", "n_claims")


@query("SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n = 1")
def unique_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("identity"))
    return reduce.reject_duplicates(docs, ["identity"])[0].select("doc_id")


@query("SELECT o_custkey, arg_min(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey, min(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def first_wins_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return reduce.first_wins(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"])


_STATES = ["view", "click", "signup", "purchase", "error"]


@query("SELECT user_id, ['view', 'click', 'signup', 'purchase', 'error'][max(list_position(['view', 'click', 'signup', 'purchase', 'error'], event_type))] AS event_type FROM events GROUP BY 1")
def capability_worst_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.worst_state(_table(spark, sf_dir, "events").select("user_id", "event_type"), ["user_id"], "event_type", _STATES)


@query("SELECT user_id, max(ts) AS ts, arg_max(event_id, struct_pack(ts := ts, e := event_id)) AS event_id, arg_max(event_type, struct_pack(ts := ts, e := event_id)) AS event_type, false AS conflict FROM events GROUP BY 1")
def latest_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return reduce.latest(events, ["user_id"], ["ts", "event_id"], ["event_type"])


_RANK = "6 - CAST(o_orderpriority[1:1] AS INT)"
_OLD = _NEW = "timestamp_ntz'1998-07-01'"  # the orders before it are one snapshot, the others the next


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders").withColumn("rank", 6 - F.substring("o_orderpriority", 1, 1).cast("int"))
    facts = lambda rows: delta.merge_facts(rows.select("o_custkey", F.array("o_orderstatus").alias("targets"), "rank"), ["o_custkey"], ["targets"], ["rank"], [])
    return facts(orders.where(f"o_orderdate < {_OLD}")), facts(orders.where(f"o_orderdate >= {_NEW}"))


_FACTS = f"""b AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS t, min({_RANK}) AS r FROM orders WHERE o_orderdate < TIMESTAMP '1998-07-01' GROUP BY 1),
    c AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS t, min({_RANK}) AS r FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' GROUP BY 1),
    d AS (SELECT coalesce(b.o_custkey, c.o_custkey) AS o_custkey, b.t AS bt, c.t AS ct, b.r AS br, c.r AS cr, b.o_custkey IS NOT NULL AS hb, c.o_custkey IS NOT NULL AS hc
      FROM b FULL JOIN c ON b.o_custkey = c.o_custkey),
    e AS (SELECT *, list_filter(ct, lambda x: NOT list_contains(bt, x)) AS up, list_filter(bt, lambda x: NOT list_contains(ct, x)) AS down FROM d)"""


@query(
    f"""WITH {_FACTS} SELECT o_custkey, CASE WHEN NOT hb THEN 'introduced' WHEN NOT hc THEN 'resolved' WHEN cr < br THEN 'regressed' WHEN cr > br THEN 'improved' ELSE 'unchanged' END AS class FROM e"""
)
def lifecycle_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current = _snapshots(spark, sf_dir)
    return delta.lifecycle(base, current, ["o_custkey"], ranks=["rank"]).select("o_custkey", "class")


_CLASS = """CASE WHEN NOT hb THEN 'introduced' WHEN NOT hc THEN 'resolved'
      WHEN (len(up) > 0 OR cr < br) AND NOT (len(down) > 0 OR cr > br) THEN 'regressed' WHEN (len(down) > 0 OR cr > br) AND NOT (len(up) > 0 OR cr < br) THEN 'improved'
      WHEN NOT (len(up) > 0 OR cr < br OR len(down) > 0 OR cr > br) THEN 'unchanged' ELSE 'changed-incomparable' END"""


@query(
    f"""WITH {_FACTS} SELECT o_custkey, {_CLASS} AS class,
    CASE WHEN hb AND hc THEN list_sort(list_concat(CASE WHEN cr < br THEN ['rank'] ELSE [] END, list_transform(up, lambda x: 'targets+' || x))) ELSE [] END AS regressions,
    CASE WHEN hb AND hc THEN list_sort(list_concat(CASE WHEN cr > br THEN ['rank'] ELSE [] END, list_transform(down, lambda x: 'targets-' || x))) ELSE [] END AS improvements FROM e"""
)
def delta_set_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current = _snapshots(spark, sf_dir)
    return delta.lifecycle(base, current, ["o_custkey"], ["targets"], ["rank"]).select("o_custkey", "class", "regressions", "improvements")


@query(
    """SELECT l_orderkey, list_sort(list(DISTINCT l_partkey)) AS parts, min(l_linenumber) AS rank, list_sort(list(DISTINCT l_returnflag)) AS flags FROM lineitem GROUP BY 1"""
)
def delta_group_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.array("l_partkey").alias("parts"), F.col("l_linenumber").alias("rank"), F.col("l_returnflag").alias("flags"))
    return delta.merge_facts(lines, ["l_orderkey"], ["parts"], ["rank"], ["flags"])


_SIGNALS = f"""{_FACTS}, f AS (SELECT *, {_CLASS} AS class, len(up) > 0 AS adverse, cr < br AS lost FROM e),
    s AS (SELECT 'adverse-fact-introduced' AS signal, count(*) AS n FROM f WHERE class = 'introduced' UNION ALL SELECT 'pre-existing-adverse-facts', count(*) FROM f WHERE class = 'unchanged'
      UNION ALL SELECT 'adverse-fact-regressed', count(*) FROM f WHERE class IN ('regressed', 'changed-incomparable') AND adverse
      UNION ALL SELECT 'lifecycle-evidence-regressed', count(*) FROM f WHERE class IN ('regressed', 'changed-incomparable') AND lost)"""


@query(f"WITH {_SIGNALS} SELECT signal, n FROM s WHERE n > 0")
def delta_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, current = _snapshots(spark, sf_dir)
    return delta.signals(delta.lifecycle(base, current, ["o_custkey"], ["targets"], ["rank"]), ["rank"])


_EFFECTS = ", ".join(f"('{s}', {delta.EFFECTS.index(e)}, '{delta.DECISIONS[delta.EFFECTS.index(e)]}')" for s, e in delta.SIGNAL_EFFECTS.items())


@query(f"WITH {_SIGNALS}, x(signal, e, d) AS (VALUES {_EFFECTS}) SELECT coalesce(arg_max(d, e), 'allow') AS decision, count(*) AS n_signals FROM s LEFT JOIN x USING (signal) WHERE n > 0")
def decision_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delta.decide(delta_signals(spark, sf_dir))


#: What an order raises by its priority; one of them is no signal.
_RAISED = {"1-URGENT": "protected-input-changed", "2-HIGH": "unplanned-write", "3-MEDIUM": "write-conflict", "4-NOT SPECIFIED": "finding-warnings", "5-LOW": "none"}


@query(
    f"""WITH x(signal, e, d) AS (VALUES {_EFFECTS}), m(p, signal) AS (VALUES {", ".join(f"('{k[0]}', '{v}')" for k, v in _RAISED.items())})
    SELECT o_custkey, coalesce(arg_max(d, e), 'allow') AS decision, count(*) AS n_signals, coalesce(max(e), 0) < 2 AS authorised
    FROM orders JOIN m ON o_orderpriority[1:1] = p LEFT JOIN x ON x.signal = m.signal GROUP BY 1"""
)
def decision_by_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*(F.lit(x) for k, v in _RAISED.items() for x in (k[0], v)))
    raised = _table(spark, sf_dir, "orders").select("o_custkey", F.element_at(names, F.substring("o_orderpriority", 1, 1)).alias("signal"))
    return delta.decide(raised, ["o_custkey"]).withColumn("authorised", gates.authorises(F.col("decision")))


@query(
    """WITH b AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS m FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
    c AS (SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS m FROM orders GROUP BY 1)
    SELECT coalesce(b.k, c.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'added' WHEN c.k IS NULL THEN 'removed' ELSE 'changed' END AS change,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'leased' WHEN c_acctbal < 0 THEN 'protected' ELSE 'unplanned' END AS scope
    FROM b FULL JOIN c ON b.k = c.k JOIN customer ON c_custkey = coalesce(b.k, c.k) WHERE (b.n, b.m) IS DISTINCT FROM (c.n, c.m)"""
)
def input_change_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    state = lambda before: orders.where(f"o_orderdate < timestamp_ntz'{before}'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m"))
    customers = _table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return delta.input_changes(state("1998-01-01"), state("9999-01-01"), "o_custkey", ["n", "m"], customers.where("c_mktsegment = 'BUILDING'"), customers.where("c_acctbal < 0"))


_ORDER = [("o_totalprice", False), ("o_orderkey", True)]
_SCOPE = paging.Scope("orders", "totalprice-desc.v1")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")


_PAGED = "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100"


@query(_PAGED)
def keyset_page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.page(_orders(spark, sf_dir), _ORDER, _SCOPE).rows


@query(f"{_PAGED} OFFSET 100")
def keyset_page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _orders(spark, sf_dir)
    return paging.page(orders, _ORDER, _SCOPE, paging.page(orders, _ORDER, _SCOPE).next_cursor).rows


@query("SELECT least(count(*), 100) AS shown, count(*) AS total, count(*) > 100 AS truncated FROM orders")
def limit_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.probe(_orders(spark, sf_dir))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem), x AS (SELECT o AS a, -s - 1 AS b FROM e UNION ALL SELECT -s - 1, o FROM e),
    r(n) AS (SELECT min(o) FROM e UNION SELECT b FROM r JOIN x ON a = n)
    SELECT CASE WHEN n < 0 THEN 's' || (-n - 1) ELSE 'o' || n END AS node FROM r WHERE n IS NOT NULL"""
)
def adjacency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders and suppliers that the links of all lines connect with the first order."""
    from ..sources.state import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    lines = _table(spark, sf_dir, "lineitem")
    order, supplier = F.col("l_orderkey") * 2, F.col("l_suppkey") * 2 + 1  # numbers: a fraction of the bytes of names
    links = graph.undirected(lines.select(order.alias("a"), supplier.alias("b")), "a", "b", once=False)
    found = graph.reachable(links, lines.agg(F.min(order).alias("node")), symmetric=True)
    node = F.col("node")
    return found.select(F.concat(F.when(node.bitwiseAND(1) == 1, "s").otherwise("o"), F.shiftright(node, 1)).alias("node"))


@query(
    """SELECT s_suppkey, list_sort(list(DISTINCT l_partkey) FILTER (l_partkey IS NOT NULL)) AS neighbours FROM (SELECT s_suppkey FROM supplier UNION SELECT -p_partkey - 1 FROM part)
    LEFT JOIN (SELECT l_suppkey AS k, -l_partkey - 1 AS l_partkey FROM lineitem UNION ALL SELECT -l_partkey - 1, l_suppkey FROM lineitem) ON k = s_suppkey GROUP BY 1"""
)
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, and parts as negative numbers, with their neighbours."""
    part = lambda c: -F.col(c) - 1
    nodes = _table(spark, sf_dir, "supplier").select("s_suppkey").union(_table(spark, sf_dir, "part").select(part("p_partkey")))
    links = _table(spark, sf_dir, "lineitem").select("l_suppkey", part("l_partkey").alias("p"))
    found = graph.adjacency(nodes, "s_suppkey", links, "l_suppkey", "p")
    return found.withColumn("neighbours", F.when(F.size("neighbours") > 0, F.col("neighbours")))


@query(
    f"""WITH p AS (SELECT DISTINCT * FROM ({_PAGE})), l AS (SELECT DISTINCT page_id, parts[1:2] AS parts FROM p)
    SELECT DISTINCT l.page_id AS "left", r.page_id AS "right" FROM l JOIN p r ON l.parts = r.parts[1:len(l.parts)] OR r.parts = l.parts[1:len(r.parts)]"""
)
def lease_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page holds a lease on its first two components: what overlaps is found among distinct paths, then given its pages.

    The pairs of pages are as many as pages times those of their host, so the join that makes them is the last step and they are
    not shuffled: each lease path is brought together with its own pages and with the pages it overlaps, in parts of _PAIRS
    pairs at most or little more. Pages with several paths can meet twice; pairs with such a page alone go through a distinct.
    """
    from ..sources.state import keep

    pages = _page_paths(spark, sf_dir).where("parts is not null").distinct()
    several = pages.groupBy(F.col("page_id").alias("_p")).agg((F.count("*") > 1).alias("several"))
    pages = keep(pages.join(several, F.col("page_id").eqNullSafe(F.col("_p"))).select("page_id", "parts", F.to_json("parts").alias("right"), "several"))
    leases = keep(pages.select("page_id", F.slice("parts", 1, 2).alias("parts"), "several").distinct().withColumn("left", F.to_json("parts")))
    held, read = leases.select("parts", F.col("left").alias("path")).distinct(), pages.select("parts", F.col("right").alias("path")).distinct()
    right = keep(graph.overlaps(held, read, "path", "parts").join(pages, "right").select("left", F.col("page_id").alias("_r"), F.col("several").alias("_rs")))
    count = lambda df, name: df.groupBy("left").agg(F.count("*").alias(name))
    sizes = keep(count(leases, "_m").join(count(right, "_n"), "left").select("left", F.ceil(F.col("_m") * F.col("_n") / _PAIRS).alias("_k")))
    left = leases.join(sizes, "left").select("left", F.col("page_id").alias("_l"), F.col("several").alias("_ls"), F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_at"))
    right = right.join(sizes, "left").select("left", "_r", "_rs", F.pmod(F.xxhash64("_r"), F.col("_k")).alias("_at"))
    parts = sizes.agg(F.sum("_k")).first()[0] or 1
    left, right = keep(left), keep(right)
    pairs = lambda x, y: left.where(x).join(right.where(y).repartition(min(parts, 1000), "left", "_at"), ["left", "_at"]).select(F.col("_l").alias("left"), F.col("_r").alias("right"))
    return pairs("not _ls", "not _rs").union(pairs("_ls", "true").union(pairs("not _ls", "_rs")).distinct())


#: Pairs of pages that one lease path makes in a part of it.
_PAIRS = 1 << 22


@query(f"SELECT c_custkey FROM customer WHERE c_acctbal < 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal > 9000)")
def blocked_scope_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = _table(spark, sf_dir, "customer").where("c_acctbal < 0")
    blocked = _table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    return integrity.outside_scope(findings, blocked, ["c_nationkey"]).select("c_custkey")


def _retention(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    runs = orders.withColumn("finished", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")))
    pins = orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    why = retention.protection_reasons(runs, "o_orderkey", "o_custkey", ["o_orderdate", "o_orderkey"], "finished", "o_orderstatus = 'F'", pins)
    return retention.plan(runs, "o_orderkey", "finished", dt.datetime(1998, 1, 1), why)


_RETENTION = """r AS (SELECT *, CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS finished FROM orders),
    w AS (SELECT arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS k, 'latest-attempt' AS reason FROM r GROUP BY o_custkey
      UNION ALL SELECT arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)), 'latest-completed' FROM r WHERE o_orderstatus = 'F' GROUP BY o_custkey
      UNION ALL SELECT o_orderkey, 'pinned' FROM r WHERE o_orderpriority = '1-URGENT'),
    x AS (SELECT k, list_sort(list(DISTINCT reason)) AS reasons FROM w GROUP BY k), o AS (SELECT * FROM r WHERE finished < TIMESTAMP '1998-01-01')"""


@query(f"WITH {_RETENTION} SELECT o_orderkey, finished FROM o WHERE NOT EXISTS (SELECT 1 FROM x WHERE k = o_orderkey)")
def retention_plan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retention(spark, sf_dir)[0].select("o_orderkey", "finished")


@query(f"WITH {_RETENTION} SELECT o_orderkey, reasons FROM o JOIN x ON k = o_orderkey")
def retention_plan_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _retention(spark, sf_dir)[1].select("o_orderkey", "reasons")


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def orphan_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.orphans(_table(spark, sf_dir, "documents").select("doc_id"), _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "k"), "doc_id", "k")


@query(
    """SELECT 'lineitem-orders' AS "check", count(*) AS misses FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'lineitem-part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)
    UNION ALL SELECT 'lineitem-rich-supplier', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)"""
)
def referential_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "lineitem")
    suppliers = _table(spark, sf_dir, "supplier").where("s_acctbal > 0")
    return integrity.closure_report(
        [
            ("lineitem-orders", lines, _table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey"),
            ("lineitem-part", lines, _table(spark, sf_dir, "part"), "l_partkey", "p_partkey"),
            ("lineitem-rich-supplier", lines, suppliers, "l_suppkey", "s_suppkey"),
        ]
    )


_A, _B = (f"SELECT l_partkey, l_suppkey FROM lineitem WHERE l_shipdate {x} TIMESTAMP '1998-07-01'" for x in ("<", ">="))


@query(f"SELECT l_partkey, l_suppkey, 'left' AS side FROM ({_A} EXCEPT {_B}) UNION ALL SELECT l_partkey, l_suppkey, 'right' FROM ({_B} EXCEPT {_A})")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of part and supplier that were shipped only before a day, or only from it on."""
    lines = _table(spark, sf_dir, "lineitem").where("l_shipdate is not null").select("l_partkey", "l_suppkey", F.expr("l_shipdate < timestamp_ntz'1998-07-01'").alias("before"))
    return integrity.symmetric_difference(lines.where("before").drop("before"), lines.where("not before").drop("before"))


@query("SELECT p_partkey, (p_name LIKE '%gear' OR p_name LIKE 'small%') AND NOT p_name LIKE '%ring' AS member FROM part")
def workspace_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", integrity.member(F.col("p_name"), ["*gear", "small*"], ["*ring"]).alias("member"))


@query(
    """SELECT page_id, CASE WHEN contains(url, 'spam') THEN 'vendored' WHEN regexp_matches(url, '/(fr|es)/') THEN 'authored' WHEN contains(html, '<script>') THEN 'generated' ELSE 'authored' END AS role FROM pages"""
)
def role_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, html = F.col("url"), F.col("html")
    rules = [(html.contains("<script>"), "generated"), (url.rlike("/(fr|es)/"), None), (url.contains("spam"), "vendored")]
    return _table(spark, sf_dir, "pages").select("page_id", integrity.last_rule(rules, "authored").alias("role"))


@query(
    """SELECT p_partkey, 'id-' || sha256(unhex(printf('%016x', strlen(p_name)) || hex(encode(p_name)) || printf('%016x', strlen(p_brand)) || hex(encode(p_brand)))) AS identity FROM part"""
)
def content_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", hashing.content_identity(F.col("p_name"), F.col("p_brand"), prefix="id-").alias("identity"))


@query(
    f"""WITH p AS ({_PAGE}) SELECT page_id, array_to_string(list_concat(parts[1:1], ['shared', parts[-1]]), '/') AS resolved, CASE WHEN len(parts) < 3 THEN NULL ELSE array_to_string(list_concat(parts[1:-4], ['x']), '/') END AS above FROM p"""
)
def relative_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _page_paths(spark, sf_dir)
    spec = F.concat(F.lit("./../shared/./"), F.element_at("parts", -1))
    up = paths.resolve_relative(F.slice("parts", 1, 2), spec)
    above = paths.resolve_relative(F.col("parts"), F.lit("../../../x"))
    return pages.select("page_id", paths.display(up).alias("resolved"), paths.display(above).alias("above"))


_LEDGER = """t AS (SELECT user_id, event_id, event_type AS a, lag(event_type) OVER w AS last, CASE WHEN event_type = 'purchase' THEN 'click' ELSE lag(event_type) OVER w END AS b
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), x AS (SELECT user_id, min(event_id) FILTER (last IS DISTINCT FROM b) AS broken_at FROM t GROUP BY 1)"""


@query(
    f"""WITH {_LEDGER} SELECT x.user_id, arg_max(a, event_id) FILTER (broken_at IS NULL OR event_id < broken_at) AS expected, any_value(broken_at) AS broken_at
    FROM x JOIN t ON x.user_id = t.user_id GROUP BY 1"""
)
def ledger_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events are transitions from the type before; every purchase claims to follow a click, which may not hold."""
    from pyspark.sql import Window as W

    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    last = F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id"))
    rows = events.withColumn("before", F.when(F.col("event_type") == "purchase", "click").otherwise(last))
    base = events.select("user_id").distinct().withColumn("state", F.lit(None).cast("string"))
    return ledger.reconcile(rows, ["user_id"], "event_id", "before", "event_type", base, "state")


_STATE_AT = "SELECT o_custkey AS k, count(*) AS n, max(o_orderkey) AS m FROM orders WHERE o_orderdate < TIMESTAMP '{}' GROUP BY 1"
_CLOSING = f"""b AS ({_STATE_AT.format("1998-01-01")}), c AS ({_STATE_AT.format("9999-01-01")}),
    p AS (SELECT z.* FROM ({_STATE_AT.format("1998-04-01")}) z JOIN customer ON c_custkey = k WHERE c_acctbal < 2000),
    d AS (SELECT coalesce(b.k, c.k) AS k, b.k IS NULL AS added, c.k IS NULL AS removed, p.k IS NOT NULL AS fixed, p.k IS NOT NULL AND (p.n, p.m) IS NOT DISTINCT FROM (c.n, c.m) AS settled
      FROM b FULL JOIN c ON b.k = c.k LEFT JOIN p ON p.k = coalesce(b.k, c.k) WHERE (b.n, b.m) IS DISTINCT FROM (c.n, c.m)),
    e AS (SELECT k AS o_custkey, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'changed' END AS change,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'leased' WHEN NOT fixed THEN 'unplanned' WHEN settled THEN 'settled' ELSE 'protected' END AS scope
      FROM d JOIN customer ON c_custkey = k WHERE NOT (added AND settled))"""


def _closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs are customers, their records what they had ordered by a day; those of one segment are leased, and what others had
    ordered by a day between is fixed."""
    orders = _table(spark, sf_dir, "orders")
    state = lambda before: orders.where(f"o_orderdate < timestamp_ntz'{before}'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("m"))
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal")
    fixed = state("1998-04-01").join(customers.where("c_acctbal < 2000"), "o_custkey", "left_semi")
    return gates.closing_inputs(state("1998-01-01"), state("9999-01-01"), "o_custkey", ["n", "m"], customers.where("c_mktsegment = 'BUILDING'"), fixed)


@query(f"WITH {_CLOSING} SELECT * FROM e")
def gate_closing_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _closing(spark, sf_dir)


@query(
    f"""WITH {_CLOSING} SELECT CASE scope WHEN 'protected' THEN 'protected-input-changed' ELSE 'unplanned-write' END AS signal, count(*) AS n
    FROM e WHERE scope IN ('protected', 'unplanned') GROUP BY 1"""
)
def gate_closing_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.closing_signals(_closing(spark, sf_dir))


@query(
    """SELECT * FROM (SELECT 'required-evidence-incomplete' AS signal, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL SELECT 'finding-warnings', count(*) FROM labels WHERE toxic = 1 UNION ALL SELECT 'pre-existing-adverse-facts', count(*) FROM labels WHERE quality = 0) WHERE n > 0"""
)
def gate_opening_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "k")
    gaps = integrity.orphans(_table(spark, sf_dir, "documents").select("doc_id"), labels, "doc_id", "k")
    return gates.opening_signals(gaps, labels.where("toxic = 1"), labels.where("quality = 0"))


@query(
    f"""WITH p AS ({_PAGE}), l AS (SELECT DISTINCT parts[1] AS gate, parts[1:2] AS lease FROM p WHERE len(parts) > 0)
    SELECT DISTINCT page_id, gate FROM p JOIN l ON p.parts[1:len(lease)] = lease"""
)
def transition_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are open gates that lease the first level of each of their pages; every page has changed."""
    pages = _page_paths(spark, sf_dir)
    leases = pages.where(F.size("parts") > 0).select(F.get("parts", F.lit(0)).alias("gate"), F.slice("parts", 1, 2).alias("lease"))
    return gates.pending(pages, "page_id", "parts", leases, "gate", "lease")


_REFS = """g AS (SELECT n_nationkey AS gate, n_regionkey, n_nationkey * 40 AS base FROM nation),
    w AS (SELECT gate, c_custkey AS seq FROM g JOIN customer ON c_custkey > base AND c_nationkey <> gate)"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are open gates with a baseline, customers transitions of their nation."""
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("gate"), (F.col("n_nationkey") * 40).alias("base"))
    moves = _table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("gate"), F.col("c_custkey").alias("seq"))
    return gates.attach(moves, nation, "gate", "seq", "base")


@query(f"WITH {_REFS} SELECT gate, seq FROM w")
def active_gate_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir)


@query(
    f"""WITH {_REFS}, r AS (SELECT gate, c_custkey AS seq FROM g JOIN nation n ON n.n_regionkey = g.n_regionkey JOIN customer ON c_nationkey = n.n_nationkey
      UNION ALL SELECT c_nationkey, c_custkey FROM customer)
    SELECT coalesce(r.gate, w.gate) AS gate, coalesce(r.seq, w.seq) AS seq, CASE WHEN r.gate IS NULL THEN 'missing' WHEN w.gate IS NULL THEN 'unknown' ELSE 'duplicate' END AS fault
    FROM (SELECT gate, seq, count(*) AS n FROM r GROUP BY 1, 2) r FULL JOIN w ON r.gate = w.gate AND r.seq = w.seq WHERE r.gate IS NULL OR w.gate IS NULL OR n > 1"""
)
def gate_reference_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates hold references on the transitions of their own region, twice on those of their own nation."""
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    moves = _table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_custkey").alias("seq"))
    near = nation.withColumnRenamed("n_nationkey", "gate").join(nation, "n_regionkey").join(moves, F.col("n_nationkey") == F.col("c_nationkey")).select("gate", "seq")
    held = near.union(moves.select("c_nationkey", "seq"))
    return gates.reference_faults(held, _references(spark, sf_dir), "gate", "seq")


_GATES = """g AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'active' ELSE 'closed' END AS state, d FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS d FROM orders GROUP BY 1) ON o_custkey = c_custkey),
    h AS (SELECT c_custkey, list_sort(list(DISTINCT s)) AS holders FROM (SELECT o_custkey AS c_custkey, CAST(l_suppkey AS VARCHAR) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_quantity >= 50) GROUP BY 1),
    o AS (SELECT g.*, holders FROM g LEFT JOIN h USING (c_custkey) WHERE state <> 'active' AND d < TIMESTAMP '2001-06-01')"""


def _gate_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers are gates: one segment is active, the others ended with their last order; suppliers of large lines hold references."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    customers = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise("closed").alias("state"))
    rows = customers.join(orders.groupBy("c_custkey").agg(F.max("o_orderdate").alias("committed")), "c_custkey", "left")
    lines = _table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select("l_orderkey", "l_suppkey")
    holds = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("c_custkey", "l_suppkey")
    return gates.plan_gates(rows, "c_custkey", "state", "committed", dt.datetime(2001, 6, 1), holds, "l_suppkey")


@query(
    f"""WITH {_GATES}, i AS (SELECT c_custkey FROM o WHERE holders IS NULL) SELECT 0 AS kind_rank, 'gate' AS kind, c_custkey, CAST(c_custkey AS VARCHAR) AS record_id FROM i
    UNION ALL SELECT 4, 'operation', c_custkey, CAST(o_orderkey AS VARCHAR) FROM i JOIN orders ON o_custkey = c_custkey"""
)
def gate_retention_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return gates.gate_items(_gate_plan(spark, sf_dir)[0], "c_custkey", [("operation", orders, "o_orderkey")])


@query(
    f"""WITH {_GATES} SELECT c_custkey, 'active-gate' AS reason, CAST([] AS VARCHAR[]) AS holders FROM g WHERE state = 'active'
    UNION ALL SELECT c_custkey, 'terminal-timestamp-unavailable', [] FROM g WHERE state <> 'active' AND d IS NULL UNION ALL SELECT c_custkey, 'active-transition-reference', holders FROM o WHERE holders IS NOT NULL"""
)
def gate_retention_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gate_plan(spark, sf_dir)[1]


@query("SELECT o_custkey, o_orderstatus, count(DISTINCT o_orderpriority) AS n_values FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) > 1")
def binding_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.conflicts(_table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], "o_orderpriority")


@query(
    """WITH t AS (SELECT p_brand, p_size, count(*) AS n, min(p_partkey) AS k FROM part GROUP BY 1, 2), r AS (SELECT c_custkey, 'Brand#' || c_nationkey AS p_brand, CAST(c_custkey % 50 + 1 AS INT) AS p_size FROM customer)
    SELECT c_custkey, CASE WHEN n = 1 THEN k END AS binding, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'bound' ELSE 'several' END AS outcome FROM r LEFT JOIN t USING (p_brand, p_size)"""
)
def exactly_one_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks for the one part of a brand and size."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("int").alias("p_size"))
    asked = _table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Brand#"), "c_nationkey").alias("p_brand"), (F.col("c_custkey") % 50 + 1).cast("int").alias("p_size"))
    return gates.bind_one(asked, parts, ["p_brand", "p_size"], "p_partkey").select("c_custkey", "binding", "outcome")


@query(
    """SELECT coalesce(c_custkey, o_custkey) AS c_custkey, CASE WHEN o_custkey IS NULL THEN 'missing' WHEN c_custkey IS NULL THEN 'unexpected' ELSE 'repeated' END AS fault
    FROM customer FULL JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE o_custkey IS NULL OR c_custkey IS NULL OR n > 1"""
)
def unit_bijection_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer should have exactly one order."""
    orders = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return gates.bijection_faults(_table(spark, sf_dir, "customer").select("c_custkey"), orders, ["c_custkey"])


@query(
    """WITH n AS (SELECT l_orderkey AS k, count(*) FILTER (l_linenumber = 1) AS made, count(*) FILTER (l_returnflag = 'R' AND l_linenumber <> 1) AS done FROM lineitem GROUP BY 1),
    x AS (SELECT coalesce(o_orderkey, k) AS o_orderkey, o_orderstatus AS s, coalesce(made, 0) AS made, coalesce(done, 0) AS done FROM orders FULL JOIN n ON k = o_orderkey),
    y AS (SELECT o_orderkey, CASE WHEN s IS NULL THEN 'unknown-plan' WHEN made <> 1 THEN 'creations' WHEN (s = 'F') <> (done > 0) THEN 'confirmation' END AS fault FROM x)
    SELECT * FROM y WHERE fault IS NOT NULL"""
)
def plan_closure_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are plans, confirmed with status F; their first line is the creation, other returned ones are confirmations."""
    kind = F.when(F.col("l_linenumber") == 1, "create").when(F.col("l_returnflag") == "R", "confirm").otherwise("other")
    operations = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), kind.alias("kind"))
    plans = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("planned").alias("state"))
    return gates.plan_closure(plans, operations, "o_orderkey", "kind", "state")


@query(
    """WITH t AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'pruned' ELSE 'pruning' END AS state, CASE WHEN toxic = 1 THEN 'x' ELSE lang END AS d FROM labels JOIN documents USING (doc_id)),
    y AS (SELECT t.doc_id, CASE WHEN i.doc_id IS NULL THEN 'not-planned' WHEN i.lang <> d THEN 'other-digest' WHEN state = 'pruned' AND v.doc_id IS NOT NULL THEN 'still-there'
      WHEN state = 'pruning' AND v.doc_id IS NULL THEN 'already-gone' END AS fault FROM t LEFT JOIN (SELECT doc_id, lang FROM documents WHERE n_chars >= 500) i ON i.doc_id = t.doc_id
      LEFT JOIN (SELECT doc_id FROM documents WHERE source <> 'src0') v ON v.doc_id = t.doc_id)
    SELECT * FROM y WHERE fault IS NOT NULL"""
)
def tombstone_coherence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are tombstones of documents: those of some length were planned, those of one source are gone."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    labels = _table(spark, sf_dir, "labels").join(docs, "doc_id")
    marks = labels.select("doc_id", F.when(F.col("quality") == 1, "pruned").otherwise("pruning").alias("state"), F.when(F.col("toxic") == 1, "x").otherwise(F.col("lang")).alias("lang"))
    return gates.tombstone_faults(marks, docs.where("n_chars >= 500"), docs.where("source <> 'src0'"), "doc_id", "lang", "state")


@query("SELECT documents.doc_id, CASE WHEN labels.doc_id IS NULL THEN 'live' WHEN quality = 1 THEN 'pruned' ELSE 'pruning' END AS state FROM documents LEFT JOIN labels ON labels.doc_id = documents.doc_id")
def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = _table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "pruned").otherwise("pruning").alias("state"))
    return retention.live(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", marks)


@query(
    f"""WITH p AS ({_PAGE}), a AS (SELECT page_id, list_transform(range(0, len(parts) + 1), lambda i: array_to_string(parts[1:i], '/')) AS up FROM p)
    SELECT page_id, len(list_filter(up, lambda x: regexp_full_match(x, '[^/]*/(en|fr)'))) > 0 AND len(list_filter(up, lambda x: regexp_full_match(x, '[^/]*[.]net') OR regexp_full_match(x, '.*/7[^/]*'))) = 0 AS admitted FROM a"""
)
def scan_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages below en or fr of any host come in, but for hosts of one ending and any level that starts with 7."""
    pages = _page_paths(spark, sf_dir)
    return pages.select("page_id", integrity.admitted(F.col("parts"), ["*/en", "*/fr"], ["*.net", "*/**/7*"]).alias("admitted"))


_SPEC = "CASE p_partkey % 5 WHEN 0 THEN '@' || lower(p_type) || '/' || p_name || '/x.js' WHEN 1 THEN './' || p_name || '.js' WHEN 2 THEN '../' || p_name WHEN 3 THEN lower(p_type) || '/' || p_name WHEN 4 THEN lower(p_type) || '.mjs' END"


@query(
    f"""WITH s AS (SELECT p_partkey, {_SPEC} AS spec FROM part) SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN string_split(spec, '/')[1] || '/' || string_split(spec, '/')[2] WHEN 3 THEN string_split(spec, '/')[1] WHEN 4 THEN spec END AS package,
    CASE WHEN p_partkey % 5 = 1 THEN spec[:-4] ELSE spec END AS identity,
    CASE p_partkey % 5 WHEN 4 THEN [spec[:-4] || 'mts', spec] WHEN 0 THEN list_transform(['ts', 'tsx', 'js', 'jsx'], lambda x: spec[:-3] || x) WHEN 1 THEN list_transform(['ts', 'tsx', 'js', 'jsx'], lambda x: spec[:-3] || x)
      ELSE list_transform(['ts', 'tsx', 'js', 'jsx'], lambda x: spec || '.' || x) END AS candidates,
    rtrim(replace(replace(to_base64(encode(spec)), '+', '-'), '/', '_'), '=') AS token FROM s"""
)
def specifier_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Package, identity, candidates and base64url form of a specifier made from every part."""
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_SPEC).alias("spec"))
    spec = F.col("spec")
    return rows.select(
        "p_partkey",
        paths.package_name(spec).alias("package"),
        paths.identity_specifier(spec).alias("identity"),
        paths.candidate_paths(spec, F.lit(False), F.lit(True)).alias("candidates"),
        hashing.base64_url(spec.cast("binary")).alias("token"),
    )


@query(
    """WITH f AS (SELECT o_custkey, list_sort(list({'name': CAST(o_orderkey AS VARCHAR), 'digest': o_orderstatus, 'size': CAST(len(o_orderpriority) AS VARCHAR)})) AS l FROM orders GROUP BY 1)
    SELECT o_custkey, sha256(unhex(array_to_string(list_transform(l, lambda e: printf('%016x', strlen(e.name)) || hex(encode(e.name)) || printf('%016x', strlen(e.digest)) || hex(encode(e.digest)) || printf('%016x', strlen(e.size)) || hex(encode(e.size))), ''))) AS identity FROM f"""
)
def directory_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as a directory: name, digest and size of each entry."""
    entry = F.struct(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderstatus").alias("digest"), F.length("o_orderpriority").cast("long").alias("size"))
    rows = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(entry).alias("entries"))
    return rows.select("o_custkey", hashing.tree_identity(F.col("entries")).alias("identity"))


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS d FROM orders), p AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority = '1-URGENT' THEN '?' ELSE o_orderstatus END AS d FROM orders)
    SELECT o.k AS o_orderkey, o.d <> p.d AS stays FROM o JOIN p ON o.k = p.k"""
)
def checked_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan to delete every order, made from other digests for urgent ones: those stay."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    planned = _table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))
    stay, _ = retention.checked_delete(orders, "o_orderkey", "o_orderstatus", planned)
    return orders.select("o_orderkey").join(stay.select("o_orderkey", F.lit(True).alias("s")), "o_orderkey", "left").select("o_orderkey", F.coalesce("s", F.lit(False)).alias("stays"))


@query(
    """SELECT doc_id, CAST(coalesce(len(l), 0) AS INT) AS n_items, list_transform(l, lambda x: CAST(len(x) AS INT)) AS n_chars, list_transform(l, lambda x: CAST(len(string_split(x, ' ')) AS INT)) AS n_words
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"""
)
def nested_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records, their lines as revisions with words as a list: shown as counts."""
    line = lambda x: F.struct(F.length(x).alias("n_chars"), F.split(x, " ").alias("words"))
    records = _table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n"), line).alias("items"))
    shown = report.counted(records, "doc_id", "items", ["words"], ["n_chars"])
    return shown.select("doc_id", "n_items", F.col("items.n_chars").alias("n_chars"), F.col("items.n_words").alias("n_words"))


@query(
    """SELECT l_orderkey, l_linenumber, 0 AS at, CASE l_returnflag WHEN 'A' THEN 'finding-warnings' WHEN 'R' THEN 'unplanned-write' ELSE 'analysis-contract-changed' END AS kind,
      CASE WHEN l_returnflag = 'A' THEN CAST(l_partkey AS VARCHAR) END AS "count", CASE WHEN l_returnflag = 'R' THEN CAST(l_partkey AS VARCHAR) END AS path FROM lineitem
    UNION ALL SELECT l_orderkey, l_linenumber, 1, 'write-conflict', NULL, CAST(l_suppkey AS VARCHAR) FROM lineitem WHERE l_quantity >= 25"""
)
def signal_flattening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with one or two signals: warnings with a count, writes with a path, others with nothing."""
    none = F.create_map().cast("map<string,string>")
    one = lambda field, column: F.create_map(F.lit(field), F.col(column).cast("string"))
    signal = lambda kind, payload: F.struct(kind.alias("kind"), payload.alias("payload"))
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "finding-warnings").when(flag == "R", "unplanned-write").otherwise("analysis-contract-changed")
    first = signal(kind, F.when(flag == "A", one("count", "l_partkey")).when(flag == "R", one("path", "l_partkey")).otherwise(none))
    both = F.array(first, signal(F.lit("write-conflict"), one("path", "l_suppkey")))
    lines = _table(spark, sf_dir, "lineitem").withColumn("signals", F.when(F.col("l_quantity") >= 25, both).otherwise(F.array(first)))
    return report.flat_signals(lines, ["l_orderkey", "l_linenumber"], "signals", ["count", "path"])


_NAME = "CASE p_partkey % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN p_name WHEN 2 THEN '@' || lower(p_type) || '/' || CAST(p_partkey AS VARCHAR(10)) WHEN 3 THEN p_brand END"


@query(f"SELECT p_partkey, regexp_full_match(nm, '(@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*') AND len(nm) <= 214 AS valid FROM (SELECT p_partkey, {_NAME} AS nm FROM part)")
def package_name_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made from every part: plain, with blanks, with a scope, with capitals."""
    return _table(spark, sf_dir, "part").select("p_partkey", F.expr(_NAME).alias("nm")).select("p_partkey", paths.valid_package(F.col("nm")).alias("valid"))


@query(specimen.SQL)
def audit_generated_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An audit, from scan to findings, of a repository that has a module for every supplier."""
    from ..sources.state import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    return specimen.unused(spark, specimen.write(spark, sf_dir))
