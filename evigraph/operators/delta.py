"""Lifecycle delta: baseline against current facts, every key classified, and the signals and decision that follow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Effects by rank, and the effect of each signal.
EFFECTS = ["none", "warn", "incomplete", "block", "stale"]
DECISIONS = ["allow", "allow-with-warnings", "incomplete", "deny", "stale"]
SIGNAL_EFFECTS = {
    "protected-input-changed": "stale",
    "analysis-contract-changed": "stale",
    "transition-catalog-changed": "stale",
    "unplanned-write": "block",
    "transition-chain-broken": "block",
    "adverse-fact-introduced": "block",
    "adverse-fact-regressed": "block",
    "required-evidence-incomplete": "incomplete",
    "analysis-failed": "incomplete",
    "declared-path-unsupported": "incomplete",
    "write-conflict": "incomplete",
    "semantic-input-conflict": "incomplete",
    "active-transition-pending": "incomplete",
    "opacity-introduced": "incomplete",
    "opacity-regressed": "incomplete",
    "lifecycle-evidence-regressed": "incomplete",
    "lifecycle-delta-incomparable": "incomplete",
    "lifecycle-baseline-unavailable": "incomplete",
    "finding-warnings": "warn",
    "pre-existing-adverse-facts": "warn",
}


def merge_facts(facts: DataFrame, keys: list[str], sets: list[str], ranks: list[str], values: list[str]) -> DataFrame:
    """One fact a key: unions of set columns (sorted arrays), least ranks, and the distinct values of value columns as a
    sorted array, in which a missing value counts as one (null first).

    Members are made distinct, with partial sums, before a key's are brought together, so what is gathered for a hot key
    follows its distinct members and not its rows. A null key is a key. A set that is null or empty everywhere is empty.
    """
    lists = {c: facts.select(*keys, F.explode(c).alias("v")) for c in sets} | {c: facts.select(*keys, F.col(c).alias("v")) for c in values}
    merged = facts.groupBy(*keys).agg(F.lit(0).alias("_"), *(F.min(c).alias(c) for c in ranks))
    for c, rows in lists.items():
        gathered = rows.distinct().groupBy(*keys).agg(F.collect_list(F.struct("v")).alias("_s"))
        merged = _beside(merged, gathered.withColumn(c, F.transform(F.sort_array("_s"), lambda x: x["v"])).drop("_s"), keys)
        if c in sets:
            merged = merged.withColumn(c, F.coalesce(c, F.array().cast(facts.schema[c].dataType)))
    return merged.select(*keys, *sets, *ranks, *values)


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left with the columns of right at the same keys, null keys too."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys))
    return left.join(other, same, "left").drop(*(f"_r_{k}" for k in keys))


def merge_payloads(facts: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """(keys, payload) of facts with a map from field to struct(value, rank): one map a key.

    A field that all facts of a key have alike stays. One on which they differ, or that some lack, becomes unranked, its value
    the distinct ones joined in their order. Distinct values are found with partial sums, so a hot key gathers only those.
    """
    at = F.explode(F.coalesce(payload, F.create_map().cast(facts.schema[payload].dataType))).alias("_f", "_v")
    rows = facts.select(*keys, at).groupBy(*keys, "_f", F.col("_v.value").alias("v"), F.col("_v.rank").alias("r")).agg(F.count("*").alias("n"))
    values = rows.groupBy(*keys, "_f").agg(F.sum("n").alias("_has"), F.array_sort(F.collect_list(F.struct("v", "r"))).alias("_s"))
    out = _beside(values, facts.groupBy(*keys).agg(F.count("*").alias("_all")), keys)
    text = lambda x: F.concat(F.coalesce(x["v"], F.lit("-")), F.lit("@"), F.coalesce(x["r"].cast("string"), F.lit("-")))
    alike = (F.size("_s") == 1) & (F.col("_has") == F.col("_all"))
    joined = F.concat(F.array_join(F.transform("_s", text), ","), F.when(F.col("_has") < F.col("_all"), F.lit(",absent")).otherwise(F.lit("")))
    none = F.lit(None).cast("int")
    one = F.when(alike, F.struct(F.get("_s", F.lit(0))["v"].alias("value"), F.get("_s", F.lit(0))["r"].cast("int").alias("rank"))).otherwise(F.struct(joined.alias("value"), none.alias("rank")))
    maps = out.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_f", one.alias("_v")))).alias("_m"))
    empty = F.create_map().cast("map<string,struct<value:string,rank:int>>")
    return _beside(facts.select(*keys).distinct(), maps, keys).select(*keys, F.coalesce("_m", empty).alias(payload))


def payload_changes(was: Column, now: Column) -> dict[str, Column]:
    """The fields of two payload maps that regressed, improved or changed incomparably, each as a sorted array of names.

    Of two ranks the lower is the worse; a field without a rank on either side, or absent on one, is incomparable if it differs.
    """

    def change(_, a, b):
        same, worse, better = a.eqNullSafe(b), b["rank"] < a["rank"], b["rank"] > a["rank"]
        return F.when(~same, F.when(worse, "regressions").when(better, "improvements").otherwise("incomparable"))

    zipped = F.map_zip_with(was, now, change)
    pick = lambda name: F.array_sort(F.map_keys(F.map_filter(zipped, lambda _, v: F.coalesce(v == name, F.lit(False)))))
    return {name: pick(name) for name in ("regressions", "improvements", "incomparable")}


def classify(regressions: Column, improvements: Column, incomparable: Column, has_base: Column, has_current: Column, baseline_available: Column | None = None) -> Column:
    """The class of a key from whether its dimensions regressed, improved or changed incomparably. Total: never null."""
    out = (
        F.when(~has_base, "introduced")
        .when(~has_current, "resolved")
        .when(regressions & ~improvements & ~incomparable, "regressed")
        .when(improvements & ~regressions & ~incomparable, "improved")
        .when(~regressions & ~improvements & ~incomparable, "unchanged")
        .otherwise("changed-incomparable")
    )
    return out if baseline_available is None else F.when(baseline_available, out).otherwise("baseline-unavailable")


def lifecycle(baseline: DataFrame, current: DataFrame, keys: list[str], sets: list[str] = (), ranks: list[str] = (), values: list[str] = (), baseline_available: bool = True, payload: str | None = None) -> DataFrame:
    """Full outer comparison of two fact tables with unique keys; a null key is a key.

    regressions, improvements and incomparable list the dimensions as text: added and lost members of sets (name+member,
    name-member), lowered and raised ranks (name), changed values (name). A raised rank is an improvement whatever it means.
    A rank missing on one side is incomparable. payload names a map from field to struct(value, rank), compared field by field
    and listed as name.field.
    """
    held = (*sets, *ranks, *values, *([payload] if payload else []))
    b = baseline.select(*(F.col(k).alias(f"_kb_{k}") for k in keys), *(F.col(c).alias(f"_b_{c}") for c in held), F.lit(True).alias("_base"))
    c = current.select(*(F.col(k).alias(f"_kc_{k}") for k in keys), *(F.col(x).alias(f"_c_{x}") for x in held), F.lit(True).alias("_cur"))
    rows = b.join(c, reduce(lambda x, y: x & y, (F.col(f"_kb_{k}").eqNullSafe(F.col(f"_kc_{k}")) for k in keys)), "full")
    rows = rows.withColumns({k: F.coalesce(f"_kb_{k}", f"_kc_{k}") for k in keys})
    both = F.col("_base").isNotNull() & F.col("_cur").isNotNull()
    none = F.array().cast("array<string>")
    tag = lambda xs, sign: F.transform(xs, lambda x: F.concat(F.lit(sign), x.cast("string")))
    worse, better, other = [none], [none], [none]
    for x in sets:
        empty = F.array().cast(baseline.schema[x].dataType)
        was, now = F.coalesce(F.col(f"_b_{x}"), empty), F.coalesce(F.col(f"_c_{x}"), empty)
        worse.append(tag(F.array_except(now, was), f"{x}+"))
        better.append(tag(F.array_except(was, now), f"{x}-"))
    for x in ranks:
        was, now = F.col(f"_b_{x}"), F.col(f"_c_{x}")
        worse.append(F.when(now < was, F.array(F.lit(x))).otherwise(none))
        better.append(F.when(now > was, F.array(F.lit(x))).otherwise(none))
        other.append(F.when(was.isNull() != now.isNull(), F.array(F.lit(x))).otherwise(none))
    for x in values:
        other.append(F.when(~F.col(f"_b_{x}").eqNullSafe(F.col(f"_c_{x}")), F.array(F.lit(x))).otherwise(none))
    if payload:
        empty = F.create_map().cast(baseline.schema[payload].dataType)
        fields = payload_changes(F.coalesce(f"_b_{payload}", empty), F.coalesce(f"_c_{payload}", empty))
        for to, name in ((worse, "regressions"), (better, "improvements"), (other, "incomparable")):
            to.append(F.transform(fields[name], lambda x: F.concat(F.lit(f"{payload}."), x)))
    lists = {"regressions": worse, "improvements": better, "incomparable": other}
    rows = rows.withColumns({k: F.when(both, F.array_sort(F.concat(*v))).otherwise(none) for k, v in lists.items()})
    some = lambda k: F.size(k) > 0
    label = classify(some("regressions"), some("improvements"), some("incomparable"), F.col("_base").isNotNull(), F.col("_cur").isNotNull(), F.lit(baseline_available))
    return rows.withColumn("class", label).select(*keys, "class", *lists)


def signals(deltas: DataFrame, ranks: list[str] = (), opacity: Column | None = None) -> DataFrame:
    """(signal, n): how many deltas raise each signal; one delta may raise several. Signals of no delta have no row.

    ranks names the dimensions whose regression is a loss of evidence rather than an adverse fact.
    """
    opaque = opacity if opacity is not None else F.lit(False)
    lost = F.exists("regressions", lambda x: x.isin(*ranks)) if ranks else F.lit(False)
    adverse = F.exists("regressions", lambda x: ~x.isin(*ranks)) if ranks else F.size("regressions") > 0
    changed = F.col("class").isin("regressed", "changed-incomparable")
    rules = {
        "adverse-fact-introduced": (F.col("class") == "introduced") & ~opaque,
        "opacity-introduced": (F.col("class") == "introduced") & opaque,
        "pre-existing-adverse-facts": F.col("class") == "unchanged",
        "adverse-fact-regressed": changed & adverse & ~opaque,
        "opacity-regressed": changed & adverse & opaque,
        "lifecycle-evidence-regressed": changed & lost,
        "lifecycle-delta-incomparable": (F.col("class") == "changed-incomparable") & (F.size("incomparable") > 0),
        "lifecycle-baseline-unavailable": F.col("class") == "baseline-unavailable",
    }
    counts = deltas.agg(*(F.count_if(v).alias(k) for k, v in rules.items()))
    pairs = F.array(*(F.struct(F.lit(k).alias("signal"), F.col(f"`{k}`").alias("n")) for k in rules))
    return counts.select(F.explode(pairs).alias("p")).select("p.*").where("n > 0")


def decide(raised: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, decision, n_signals): the strongest effect of the signals raised; without any the decision is to allow. A signal
    that is not known here has no effect."""
    effect = F.element_at(F.create_map(*(F.lit(x) for s, e in SIGNAL_EFFECTS.items() for x in (s, EFFECTS.index(e)))), F.col("signal"))
    top = raised.groupBy(*keys).agg(F.coalesce(F.max(effect), F.lit(0)).alias("e"), F.count("signal").alias("n_signals"))
    return top.select(*keys, F.element_at(F.array(*map(F.lit, DECISIONS)), F.col("e") + 1).alias("decision"), "n_signals")


def input_changes(baseline: DataFrame, current: DataFrame, key: str, record: list[str], leased: DataFrame, protected: DataFrame) -> DataFrame:
    """(key, change, scope) of every input that differs: change is added, removed or changed, and scope is leased (planned
    writes), protected or unplanned, in this order of precedence."""
    b = baseline.select(key, F.struct(*record).alias("_b"))
    c = current.select(key, F.struct(*record).alias("_c"))
    rows = b.join(c, key, "full").where(~F.col("_b").eqNullSafe(F.col("_c")))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_c").isNull(), "removed").otherwise("changed")
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = rows.join(mark(leased, "_l"), key, "left").join(mark(protected, "_p"), key, "left")
    scope = F.when(F.col("_l"), "leased").when(F.col("_p"), "protected").otherwise("unplanned")
    return rows.select(key, change.alias("change"), scope.alias("scope"))
