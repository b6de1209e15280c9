"""Queries of inputs and their identities, protection, demand, capabilities, aliases, patterns, plan pages and streams on the
driver's tables; registered beside those of crosswalk."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import capabilities, delta, demand, gates, graph, identity, lookup, paging
from ..operators.sizes import spread, tasks
from ..sources.state import ensure_checkpoint_dir, keep, new_folder
from ..streaming import latest, reconcile
from .crosswalk import _LEDGER, _PAGE, _RETENTION, ORACLES, _page_paths, _retention, _table, query

_STATE = "CASE WHEN contains(url, '/fr/') THEN 'missing' WHEN contains(url, '/de/') THEN 'unreadable' WHEN contains(url, '#') THEN 'non-regular' ELSE 'config-present' END"
_INPUTS = f"""i AS (SELECT 'doc/' || doc_id AS path, 'source' AS state, sha256(text) AS payload_sha256, lang || ':' || n_chars AS physical_id FROM documents
    UNION SELECT url, s, CASE s WHEN 'config-present' THEN sha256(html) WHEN 'unreadable' THEN sha256(url) END, CASE WHEN s <> 'missing' THEN 'page:' || page_id END
      FROM (SELECT *, {_STATE} AS s FROM pages))"""


def _inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are sources; pages are configuration that was asked for, and what came of it follows from the url."""
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.sha2("text", 256).alias("payload_sha256"), F.concat_ws(":", "lang", "n_chars").alias("physical_id"))
    html, url = F.col("html"), F.col("url")
    state = F.when(url.contains("/fr/"), identity.MISSING).when(url.contains("/de/"), identity.UNREADABLE).when(url.contains("#"), identity.NON_REGULAR).otherwise(identity.PRESENT)
    pages = _table(spark, sf_dir, "pages").select(url.alias("path"), state.alias("state"), F.sha2(html, 256).alias("payload_sha256"), F.concat(F.lit("page:"), "page_id").alias("physical_id"), url.alias("detail"))
    return identity.semantic_inputs(docs, pages)


def _digest(*values: str) -> str:
    one = lambda v: f"coalesce(printf('%016x', strlen({v})) || lower(hex(encode({v}))), 'ffffffffffffffff')"
    return f"sha256(unhex({' || '.join(map(one, values))}))"


def _sums(digest: str) -> str:
    return " || '.' || ".join(f"CAST(sum(CAST('0x' || {digest}[{8 * k + 1}:{8 * k + 8}] AS UBIGINT)) AS VARCHAR)" for k in range(8))


@query(f"WITH {_INPUTS} SELECT * FROM i")
def semantic_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inputs(spark, sf_dir)


_IDENTITY = f"""d AS (SELECT state, {_digest("path", "state", "payload_sha256", "physical_id")} AS d FROM i),
    b AS (SELECT state, CAST(CAST('0x' || d[1:2] AS UBIGINT) AS INT) AS bucket, count(*) AS n, {_sums("d")} AS sums FROM d GROUP BY 1, 2)"""


@query(f"WITH {_INPUTS}, {_IDENTITY} SELECT state, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(bucket || ':' || sha256(sums || '|' || n), ',' ORDER BY bucket)) AS identity FROM b GROUP BY 1")
def semantic_input_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One identity for the inputs of each state."""
    return identity.set_identity(_inputs(spark, sf_dir), identity.INPUT, ["state"])


_ORDERED = "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1"


@query(f"WITH a AS ({_ORDERED}), b AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT *, 'before' AS side FROM (FROM a EXCEPT FROM b) UNION ALL SELECT *, 'after' FROM (FROM b EXCEPT FROM a)")
def changed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their number of orders, without and with the pending ones."""
    orders = _table(spark, sf_dir, "orders")
    counted = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return identity.changed_members(counted(orders.where("o_orderstatus <> 'P'")), counted(orders), ["o_custkey", "n"])


_KIND = "CASE n_regionkey WHEN 0 THEN 'directory' WHEN 1 THEN 'new-file' ELSE 'file' END"


@query(
    f"""WITH c AS (SELECT 'c' || c_custkey AS path, c_nationkey AS n, c_mktsegment AS m, c_acctbal > 9000 AS leased FROM customer),
    s AS (SELECT 's' || s_suppkey AS path FROM supplier), g AS (SELECT n_nationkey AS gate, {_KIND} AS kind FROM nation),
    h AS (SELECT DISTINCT gate, kind FROM g JOIN c ON n = gate WHERE leased)
    SELECT DISTINCT gate, path FROM (SELECT gate, a.path FROM h JOIN c b ON b.n = gate AND b.leased JOIN c a ON a.n = b.n AND a.m = b.m WHERE kind = 'file'
      UNION ALL SELECT gate, path FROM h CROSS JOIN c WHERE kind <> 'file' UNION ALL SELECT gate, path FROM h CROSS JOIN s)"""
)
def protected_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are gates that lease their rich customers; customers of one nation and segment are linked in a chain, suppliers are
    configuration, some of it missing."""
    from pyspark.sql import Window as W

    ensure_checkpoint_dir(spark)
    customers = _table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("path"), "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
    near = F.lag("path").over(W.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey"))
    links = spread(customers, customers.count(), "c_nationkey", "c_mktsegment").select("path", near.alias("before")).where("before is not null")
    region = F.col("n_regionkey")
    nation = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("gate"), F.when(region == 0, gates.DIRECTORY).when(region == 1, gates.NEW_FILE).otherwise(gates.FILE).alias("kind"))
    leases = customers.where("c_acctbal > 9000").join(nation, F.col("c_nationkey") == F.col("gate")).select("gate", "kind", "path")
    config = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("path"), F.when(F.col("s_acctbal") < 0, identity.MISSING).otherwise(identity.PRESENT).alias("state"))
    inputs = customers.select("path", F.lit(identity.SOURCE).alias("state")).union(config)
    return gates.protected_inputs(leases, "gate", "kind", "path", inputs, links, "path", "before")


@query(
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority = '1-URGENT' AS base, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS hops,
      count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_custkey, min(hops) FILTER (base OR hops = n - 1) AS hops, arg_min(o_orderkey, hops) FILTER (base OR hops = n - 1) AS resolved, bool_or(base) AS has_base FROM o GROUP BY 1"""
)
def demand_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's last order extends the one before, until an urgent one or the first; an order is only read when a chain
    asks for it."""
    from pyspark.sql import Window as W

    ensure_checkpoint_dir(spark)
    orders = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority")
    before = F.lag("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    files = keep(orders.select(F.col("o_orderkey").alias("key"), (F.col("o_orderpriority") == "1-URGENT").alias("base"), before.alias("extends")))
    first = orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("key")).withColumn("hops", F.lit(0).cast("long"))

    def resolve(pending: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        rows = pending.join(known.join(pending.select("key"), "key", "left_semi"), "key", "left")
        ends = F.coalesce(F.col("base") | (F.col("met") & F.col("extends").isNull()), F.lit(False))
        on = F.col("met").isNotNull()
        waits = rows.where(~ends).select("o_custkey", F.when(on, F.col("extends")).otherwise(F.col("key")).alias("key"), F.when(on, F.col("hops") + 1).otherwise(F.col("hops")).alias("hops"))
        return rows.where(ends).select("o_custkey", "hops", F.col("key").alias("resolved"), F.col("base").alias("has_base")), waits

    fetch = lambda keys: keys.join(files.join(keys, "key", "left_semi"), "key", "left").withColumn("met", F.lit(True))
    none = files.where(F.lit(False)).withColumn("met", F.lit(True))
    return demand.fixpoint(first, ["o_custkey"], ["key"], none, resolve, fetch)


_OWN = """x AS (SELECT 'p' || p_partkey AS capability, CASE WHEN p_size > 5 THEN 0 ELSE 2 END AS r FROM part
      UNION ALL SELECT 's' || s_suppkey, CASE WHEN s_acctbal < 0 THEN 3 ELSE 0 END FROM supplier UNION ALL SELECT 'n' || n_nationkey, 0 FROM nation),
    g AS (SELECT 'p' || l_partkey AS capability, count(*) FILTER (l_discount >= 0.05) AS n_required, count(*) FILTER (l_discount < 0.05) AS n_advisory FROM lineitem WHERE l_quantity > 49 GROUP BY 1),
    o AS (SELECT capability, greatest(r, CASE WHEN coalesce(n_required, 0) > 0 THEN 1 ELSE 0 END) AS own, coalesce(n_required, 0) AS n_required, coalesce(n_advisory, 0) AS n_advisory FROM x LEFT JOIN g USING (capability)),
    e AS (SELECT DISTINCT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem WHERE l_returnflag = 'R' AND l_tax > 0.06 UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
    r(capability, own) AS (SELECT capability, own FROM o UNION SELECT e.a, r.own FROM r JOIN e ON e.b = r.capability)"""


@query(
    f"""WITH RECURSIVE {_OWN} SELECT capability, ['complete', 'incomplete', 'unavailable', 'failed'][o.own + 1] AS state, n_required, n_advisory,
    ['complete', 'incomplete', 'unavailable', 'failed'][w + 1] AS effective FROM o JOIN (SELECT capability, max(own) AS w FROM r GROUP BY 1) USING (capability)"""
)
def capability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts need the suppliers of some returned lines, and those their nations; poor suppliers have failed, small parts have no
    record, and large lines are gaps of their part, advisory ones at a small discount."""
    ensure_checkpoint_dir(spark)
    name = lambda letter, c: F.concat(F.lit(letter), c).alias("capability")
    part, supplier, nation, lines = (_table(spark, sf_dir, t) for t in ("part", "supplier", "nation", "lineitem"))
    declared = part.select(name("p", "p_partkey")).union(supplier.select(name("s", "s_suppkey"))).union(nation.select(name("n", "n_nationkey")))
    records = part.where("p_size > 5").select(name("p", "p_partkey"), F.lit("complete").alias("state"))
    records = records.union(supplier.select(name("s", "s_suppkey"), F.when(F.col("s_acctbal") < 0, "failed").otherwise("complete")))
    records = records.union(nation.select(name("n", "n_nationkey"), F.lit("complete")))
    gaps = lines.where("l_quantity > 49").select(name("p", "l_partkey"), (F.col("l_discount") < 0.05).alias("advisory"))
    own = capabilities.own_states(declared, "capability", records, gaps, "advisory").checkpoint()
    needs = lines.where("l_returnflag = 'R' and l_tax > 0.06").select(name("p", "l_partkey"), F.concat(F.lit("s"), "l_suppkey").alias("needed"))
    needs = needs.union(supplier.select(name("s", "s_suppkey"), F.concat(F.lit("n"), "s_nationkey")))
    return own.join(capabilities.folded(own, "capability", needs, "needed").drop("state"), "capability")


def _payload_side(where: str) -> str:
    """(k, f, v, r) of each field of each customer, merged over the orders of one side."""
    fields = {"priority": ("o_orderpriority", "6 - CAST(o_orderpriority[1:1] AS INT)", "true"), "status": ("o_orderstatus", "CAST(NULL AS INT)", "true"), "large": ("'yes'", "1", "o_totalprice > 300000")}
    rows = " UNION ALL ".join(f"SELECT o_custkey AS k, '{f}' AS f, {v} AS v, {r} AS r FROM o WHERE {c}" for f, (v, r, c) in fields.items())
    return f"""(WITH o AS (SELECT * FROM orders WHERE {where}), n AS (SELECT o_custkey AS k, count(*) AS n FROM o GROUP BY 1), d AS (SELECT k, f, v, r, count(*) AS c FROM ({rows}) GROUP BY ALL)
      SELECT k, f, CASE WHEN count(*) = 1 AND sum(c) = any_value(n) THEN any_value(v) ELSE string_agg(v || '@' || coalesce(CAST(r AS VARCHAR), '-'), ',' ORDER BY v, r) || CASE WHEN sum(c) < any_value(n) THEN ',absent' ELSE '' END END AS v,
        CASE WHEN count(*) = 1 AND sum(c) = any_value(n) THEN any_value(r) END AS r FROM d JOIN n USING (k) GROUP BY 1, 2)"""


_BEFORE, _SINCE = "o_orderdate < TIMESTAMP '1998-07-01'", "o_orderdate >= TIMESTAMP '1998-07-01'"


@query(
    f"""WITH b AS {_payload_side(_BEFORE)}, c AS {_payload_side(_SINCE)}, hb AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE {_BEFORE}), hc AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE {_SINCE}),
    f AS (SELECT coalesce(b.k, c.k) AS k, coalesce(b.f, c.f) AS f, b.r AS br, c.r AS cr FROM b FULL JOIN c ON b.k = c.k AND b.f = c.f WHERE (b.v, b.r) IS DISTINCT FROM (c.v, c.r)),
    g AS (SELECT k, 'payload.' || f AS f, CASE WHEN cr < br THEN 'w' WHEN cr > br THEN 'i' ELSE 'x' END AS t FROM f WHERE k IN (FROM hb) AND k IN (FROM hc)),
    l AS (SELECT k, list_sort(coalesce(list(f) FILTER (t = 'w'), [])) AS regressions, list_sort(coalesce(list(f) FILTER (t = 'i'), [])) AS improvements, list_sort(coalesce(list(f) FILTER (t = 'x'), [])) AS incomparable FROM g GROUP BY 1)
    SELECT coalesce(hb.k, hc.k) AS o_custkey, CASE WHEN hb.k IS NULL THEN 'introduced' WHEN hc.k IS NULL THEN 'resolved' WHEN l.k IS NULL THEN 'unchanged'
        WHEN len(improvements) + len(incomparable) = 0 THEN 'regressed' WHEN len(regressions) + len(incomparable) = 0 THEN 'improved' ELSE 'changed-incomparable' END AS class,
      coalesce(regressions, []) AS regressions, coalesce(improvements, []) AS improvements, coalesce(incomparable, []) AS incomparable
    FROM hb FULL JOIN hc ON hb.k = hc.k LEFT JOIN l ON l.k = coalesce(hb.k, hc.k)"""
)
def delta_payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with what their orders say of priority (ranked), status (unranked) and size (ranked, often absent), on two sides of a day."""
    orders = _table(spark, sf_dir, "orders")
    field = lambda name, value, rank: F.create_map(F.lit(name), F.struct(value.alias("value"), rank.cast("int").alias("rank")))
    priority = field("priority", F.col("o_orderpriority"), 6 - F.substring("o_orderpriority", 1, 1).cast("int"))
    always = F.map_concat(priority, field("status", F.col("o_orderstatus"), F.lit(None)))
    payload = F.when(F.col("o_totalprice") > 300000, F.map_concat(always, field("large", F.lit("yes"), F.lit(1)))).otherwise(always)
    facts = orders.select("o_custkey", payload.alias("payload"), F.expr("o_orderdate < timestamp_ntz'1998-07-01'").alias("before"))
    side = lambda rows: delta.merge_payloads(rows, ["o_custkey"], "payload")
    return delta.lifecycle(side(facts.where("before")), side(facts.where("not before")), ["o_custkey"], payload="payload")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS representative, count(*) OVER (PARTITION BY text) AS n_names FROM documents")
def physical_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents are names, their texts the files."""
    return graph.alias_groups(_table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file")), "doc_id", "file")


@query(
    """WITH l AS (SELECT DISTINCT source AS gate, doc_id, text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
    SELECT gate, doc_id, bool_or(d) AS declared FROM (SELECT gate, doc_id, true AS d FROM l UNION ALL SELECT gate, o.doc_id, false FROM l JOIN documents o ON o.text = l.text) GROUP BY 1, 2"""
)
def leases_follow_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source leases its toxic documents, and with them every document of the same text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("file"))
    toxic = _table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    leases = docs.join(toxic, "doc_id").select(F.col("source").alias("gate"), "doc_id")
    return graph.follow_aliases(leases, "gate", "doc_id", graph.alias_groups(docs, "doc_id", "file"))


@query(
    """WITH k AS (SELECT p_brand, CASE WHEN p_size <= 20 THEN p_name[1:3] || '*' || p_name[-2:] WHEN p_size <= 24 THEN p_name WHEN p_size <= 40 THEN '*' || p_name[-4:] ELSE p_name[1:2] || '*' END AS key, p_partkey AS o FROM part),
    m AS (SELECT p_partkey, key, o, key NOT LIKE '%*%' AS exact, split_part(key, '*', 1) AS h, CASE WHEN key LIKE '%*%' THEN split_part(key, '*', 2) ELSE '' END AS t, p_name FROM part JOIN k ON part.p_brand = k.p_brand
      WHERE key = p_name OR (key LIKE '%*%' AND starts_with(p_name, split_part(key, '*', 1)) AND ends_with(p_name, split_part(key, '*', 2)) AND length(p_name) >= length(key) - 1)),
    b AS (SELECT p_partkey, arg_max({'k': key, 'o': o, 'c': CASE WHEN exact THEN '' ELSE p_name[length(h) + 1:length(p_name) - length(t)] END}, struct_pack(e := exact, l := length(h), o := -o)) AS m FROM m GROUP BY 1)
    SELECT p_partkey, m.k AS key, m.o AS "order", m.c AS captured FROM part LEFT JOIN b USING (p_partkey)"""
)
def longest_pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's name is tried against the patterns that all parts of its brand make."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    name, star = F.col("p_name"), F.lit("*")
    tail = lambda n: F.substring(name, -n, n)
    pattern = F.when(F.col("p_size") <= 20, F.concat(F.substring(name, 1, 3), star, tail(2))).when(F.col("p_size") <= 24, name).when(F.col("p_size") <= 40, F.concat(star, tail(4))).otherwise(F.concat(F.substring(name, 1, 2), star))
    held = parts.select("p_brand", pattern.alias("pattern"), F.col("p_partkey").alias("o"))
    return lookup.longest_pattern_of(parts.select("p_partkey", "p_brand", "p_name"), "p_name", held, "pattern", "o", ["p_brand"]).select("p_partkey", "key", "order", "captured")


#: Levels of the SQL below; paths of the tables have fewer components.
_LEVELS = 8


def _directories() -> str:
    entry = _digest("kind", "name", "digest", "size")
    levels = [f"f AS (SELECT parts[:-2] AS path, 'file' AS kind, parts[-1] AS name, sha256(html) AS digest, CAST(strlen(html) AS VARCHAR) AS size, strlen(html) AS bytes, 1 AS files FROM (SELECT page_id, parts FROM ({_PAGE})) JOIN pages USING (page_id) WHERE len(parts) > 0)"]
    for depth in reversed(range(_LEVELS)):
        below = f"UNION ALL SELECT path[:-2], 'directory', path[-1], identity, CAST(bytes AS VARCHAR), bytes, n_files FROM l{depth + 1}" if depth < _LEVELS - 1 else ""
        levels.append(f"""l{depth} AS (SELECT path, {depth} AS depth, sha256({_sums("d")} || '|' || count(*) || '|' || CAST(sum(bytes) AS BIGINT)) AS identity, count(*) AS n_entries, CAST(sum(files) AS BIGINT) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes
          FROM (SELECT *, {entry} AS d FROM (SELECT * FROM f WHERE len(path) = {depth} {below})) GROUP BY path)""")
    return f"WITH {', '.join(levels)} SELECT array_to_string(path, '/') AS path, depth, identity, n_entries, n_files, bytes FROM ({' UNION ALL '.join(f'FROM l{d}' for d in range(_LEVELS))})"


@query(_directories())
def directory_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are files below their hosts."""
    ensure_checkpoint_dir(spark)
    files = _page_paths(spark, sf_dir).join(_table(spark, sf_dir, "pages"), "page_id").select("parts", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("size"))
    out = identity.directory_identities(files, "parts", "digest", "size")
    return out.withColumn("path", F.array_join("path", "/"))


_PLAN_ORDER = [[("finished", True), ("o_orderkey", True)], [("o_orderkey", True)]]
_PLAN_SCOPE = paging.Scope("retention", "items-then-exclusions.v1")
_ARMS = f"""{_RETENTION}, a AS (SELECT o_orderkey, finished FROM o WHERE NOT EXISTS (SELECT 1 FROM x WHERE k = o_orderkey)), b AS (SELECT o_orderkey, reasons FROM o JOIN x ON k = o_orderkey)"""


def _plan_arms(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    items, exclusions = _retention(spark, sf_dir)
    return [items.select("o_orderkey", "finished"), exclusions.select("o_orderkey", "reasons")]


@query(f"WITH {_ARMS} SELECT o_orderkey, finished, CAST(NULL AS VARCHAR[]) AS reasons, 0 AS tag FROM a ORDER BY finished, o_orderkey LIMIT 100")
def plan_page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paging.tagged_page(_plan_arms(spark, sf_dir), _PLAN_ORDER, _PLAN_SCOPE).rows


@query(
    f"""WITH {_ARMS}, t AS (SELECT o_orderkey, finished, NULL AS reasons, 0 AS tag FROM (SELECT * FROM a ORDER BY finished DESC, o_orderkey DESC LIMIT 40)
      UNION ALL SELECT o_orderkey, NULL, reasons, 1 FROM (SELECT * FROM b ORDER BY o_orderkey LIMIT 61)) SELECT * FROM t ORDER BY tag, finished, o_orderkey OFFSET 1"""
)
def plan_page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind the fortieth item from the end: it goes on into the exclusions."""
    arms = _plan_arms(spark, sf_dir)
    end = arms[0].orderBy(F.col("finished").desc(), F.col("o_orderkey").desc()).limit(40).agg(F.min(F.struct("finished", "o_orderkey")).alias("m")).select(F.col("m.finished").cast("string").alias("f"), "m.o_orderkey").first()
    cursor = paging.encode_cursor(_PLAN_SCOPE, [0, end["f"], end["o_orderkey"]])
    return paging.tagged_page(arms, _PLAN_ORDER, _PLAN_SCOPE, cursor).rows


def _as_stream(rows: DataFrame, order: str, files: int) -> tuple[DataFrame, str]:
    """A table as a stream of files in the shared folder, in the order of a column, a file a micro-batch."""
    spark = rows.sparkSession
    folder = new_folder(spark, "stream")
    rows.repartitionByRange(files, order).write.parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder), folder


@query(ORACLES["latest_pointer"])
def latest_pointer_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, kept by a stream whose files hold events of all times: most arrive late."""
    events = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    stream, folder = _as_stream(events.withColumn("h", F.xxhash64("event_id")), "h", 4)
    out = f"{folder}-out"
    latest.follow(stream, ["user_id"], ["ts", "event_id"], ["event_type"], out, f"{folder}-state").awaitTermination()
    return latest.pointers(spark.read.parquet(out), ["user_id"])


@query(f"WITH {_LEDGER} SELECT x.user_id, arg_max(a, event_id) FILTER (broken_at IS NULL OR event_id < broken_at) AS expected, any_value(broken_at) AS broken_at FROM x JOIN t ON x.user_id = t.user_id GROUP BY 1")
def ledger_reconcile_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of events as a stream that ends and is started again: half of it arrives only then."""
    from pyspark.sql import Window as W

    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    last = F.lag("event_type").over(W.partitionBy("user_id").orderBy("event_id"))
    rows = keep(events.withColumn("before", F.when(F.col("event_type") == "purchase", "click").otherwise(last)))
    files = max(2, tasks(rows.count()))
    half = events.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0] or 0
    folder = new_folder(spark, "stream")
    for late in (False, True):
        part = rows.where(F.col("event_id") > half if late else F.col("event_id") <= half)
        part.repartitionByRange(files, "event_id").sortWithinPartitions("event_id").write.mode("append").parquet(folder)
        stream = spark.readStream.schema(rows.schema).parquet(folder)
        reconcile.follow(stream, "user_id", "event_id", "before", "event_type", f"{folder}-out", f"{folder}-state").awaitTermination()
    out = reconcile.ledger_state(spark.read.parquet(f"{folder}-out"))
    return out.select(F.col("key").alias("user_id"), "expected", "broken_at")
