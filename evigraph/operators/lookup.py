"""Ordered and most-specific lookups, each as equi-joins and an argument of an extreme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def first_candidate(requests: DataFrame, key: str, candidates: str, targets: DataFrame, path: str, target: str) -> DataFrame:
    """Adds the target of the first candidate that exists, and its stage (0-based); both null where none does.

    candidates is an ordered array. It is exploded and equi-joined, so the cost follows the number of candidates, and a
    later hit never wins over an earlier one. key must identify a request; null candidates exist nowhere.
    """
    tried = requests.select(F.col(key).alias("_k"), F.posexplode(candidates).alias("_stage", "_path"))
    known = targets.groupBy(F.col(path).alias("_path")).agg(F.min(target).alias("_target"))
    first = tried.join(known, "_path").groupBy("_k").agg(F.min(F.struct("_stage", "_target")).alias("_m"))
    out = requests.join(first, requests[key] == F.col("_k"), "left").drop("_k")
    return out.withColumns({"target": F.col("_m._target"), "stage": F.col("_m._stage")}).drop("_m")


def nearest_ancestor(rows: DataFrame, parts: str, roots: DataFrame, root_parts: str) -> DataFrame:
    """Adds owner: the deepest root (component array) that contains the row's path; null if none does.

    Each row is exploded into its own ancestors and equi-joined, never compared with all roots. Distinct paths are looked
    up once, so repeated paths cost one lookup.
    """
    wanted = rows.select(F.col(parts).alias("_p")).where("_p is not null").distinct()
    held = roots.select(F.col(root_parts).alias("_a")).where("_a is not null").distinct()
    tried = wanted.select("_p", F.explode(paths.ancestors(F.col("_p"))).alias("_a"))
    best = tried.join(held, "_a").groupBy("_p").agg(F.max_by("_a", F.size("_a")).alias("owner"))
    return rows.join(best, F.col(parts) == F.col("_p"), "left").drop("_p")


def longest_pattern(rows: DataFrame, text: str, patterns: list[tuple[str, str]]) -> DataFrame:
    """Adds matched and mapped: an exact pattern first, else the one-star pattern with the longest literal prefix, the
    earlier of equals; mapped is its target with the captured text in place of the target's star.

    The patterns are a bounded literal list, tried in their final order inside the scan: no join.
    """
    order = sorted(range(len(patterns)), key=lambda k: ("*" in patterns[k][0], -len(patterns[k][0].partition("*")[0]), k))
    matched, mapped = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in reversed(order):
        pattern, target = map(F.lit, patterns[k])
        if "*" in patterns[k][0]:
            captured = paths.star_capture(F.col(text), pattern)
            fits = captured.isNotNull()
            value = paths.star_replace(target, captured)
        else:
            fits, value = F.col(text) == pattern, target
        matched, mapped = F.when(fits, pattern).otherwise(matched), F.when(fits, value).otherwise(mapped)
    return rows.withColumns({"matched": matched, "mapped": mapped})


def most_specific_key(rows: DataFrame, text: str, keys: DataFrame, pattern: str, group: list[str]) -> DataFrame:
    """Adds key: of the patterns of the row's group the exact one, else that with the most UTF-16 units before its star,
    then in all. A pattern's literal prefix is looked up among the text's own prefixes, so no pair is tried in vain; only
    prefixes of a length that a pattern of the group has are made, so a long text costs no more than there are lengths."""
    p = F.col(pattern)
    held = keys.select(*group, p.alias("_key"), F.substring_index(p, "*", 1).alias("_prefix"), p.contains("*").alias("_star"))
    texts = rows.select(*group, F.col(text).alias("_t")).distinct()
    lengths = held.groupBy(*group).agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    own = F.filter("_lengths", lambda n: n <= F.length("_t"))
    tried = texts.join(lengths, group).select(*group, "_t", F.explode(F.transform(own, lambda n: F.substring(F.col("_t"), F.lit(1), n))).alias("_prefix"))
    found = tried.join(held, [*group, "_prefix"])
    found = found.where(F.when(F.col("_star"), paths.star_capture(F.col("_t"), F.col("_key")).isNotNull()).otherwise(F.col("_key") == F.col("_t")))
    rank = F.struct(~F.col("_star"), paths.utf16_length(F.col("_prefix")), paths.utf16_length(F.col("_key")), F.col("_key"))
    best = found.groupBy(*group, "_t").agg(F.max_by("_key", rank).alias("key"))
    return rows.join(best.withColumnRenamed("_t", text), [*group, text], "left")


def longest_pattern_of(rows: DataFrame, text: str, patterns: DataFrame, pattern: str, order: str, group: list[str]) -> DataFrame:
    """Adds key, order and captured: of the patterns of the row's group the exact one, else the one-star pattern with the longest
    literal prefix, the earliest of equals; captured is what its star stands for.

    Patterns are indexed by both literal ends. A text only makes the ends of lengths that patterns of its group have, in the
    pairs in which they occur, and looks them up at once, so no pattern is met that does not fit and the cost of a text follows
    the pairs of lengths, not the patterns. Distinct texts are looked up once. Null groups and texts have no pattern,
    and a pattern of several stars fits nothing.
    """
    p = F.col(pattern)
    star = p.contains("*")
    ends = lambda last: F.when(star, F.substring_index(p, "*", last)).otherwise(p if last == 1 else F.lit(""))
    held = patterns.where(F.length(p) - F.length(F.replace(p, F.lit("*"), F.lit(""))) <= 1)
    held = held.select(*group, p.alias("key"), F.col(order).alias("order"), star.alias("_star"), ends(1).alias("_head"), ends(-1).alias("_tail"))
    held = held.groupBy(*group, "_star", "_head", "_tail").agg(F.min("order").alias("order"), F.min_by("key", "order").alias("key"))
    shape = F.struct("_star", F.length("_head").alias("h"), F.length("_tail").alias("t"))
    shapes = held.groupBy(*group).agg(F.collect_set(shape).alias("_shapes"))
    texts = rows.select(*group, F.col(text).alias("_x")).where("_x is not null").distinct().join(shapes, group)
    fits = lambda s: F.when(s["_star"], s["h"] + s["t"] <= F.length("_x")).otherwise(s["h"] == F.length("_x"))
    tried = texts.select(*group, "_x", F.explode(F.filter("_shapes", fits)).alias("s"))
    x = F.col("_x")
    tried = tried.select(*group, "_x", F.col("s._star").alias("_star"), F.substring(x, F.lit(1), F.col("s.h")).alias("_head"), F.substring(x, F.length(x) - F.col("s.t") + 1, F.col("s.t")).alias("_tail"))
    found = tried.join(held, [*group, "_star", "_head", "_tail"])
    middle = F.when(F.col("_star"), F.substring(x, F.length("_head") + 1, F.length(x) - F.length("_head") - F.length("_tail"))).otherwise(F.lit(""))
    rank = F.struct(~F.col("_star"), F.length("_head"), -F.col("order"))
    best = found.groupBy(*group, "_x").agg(F.max_by(F.struct("key", "order", middle.alias("captured")), rank).alias("_m"))
    out = rows.join(best.withColumnRenamed("_x", text), [*group, text], "left")
    return out.withColumns({c: F.col(f"_m.{c}") for c in ("key", "order", "captured")}).drop("_m")
