"""Referential closure, symmetric differences, blocked scopes, memberships and role rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import paths
from .sizes import spread


def orphans(children: DataFrame, parents: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Children whose key no parent has; a null key is an orphan."""
    known = parents.select(F.col(parent_key).alias("_k")).distinct()
    return children.join(known, F.col(child_key) == F.col("_k"), "left_anti")


def closure_report(checks: Sequence[tuple[str, DataFrame, DataFrame, str, str]]) -> DataFrame:
    """(check, misses) for each (name, children, parents, child key, parent key); a closed store has no misses."""
    found = [orphans(c, p, ck, pk).agg(F.count("*").alias("misses")).select(F.lit(name).alias("check"), "misses") for name, c, p, ck, pk in checks]
    return reduce(DataFrame.unionByName, found)


def symmetric_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows that only one side has, and which side: one full outer aggregation instead of two differences. Both sides
    are counted to size the tasks, then go through one shuffle and one grouping."""
    both = left.withColumn("_l", F.lit(1)).unionByName(right.withColumn("_l", F.lit(2)))
    sums = spread(both, left.count() + right.count(), *left.columns).groupBy(*left.columns).agg(F.bit_or("_l").alias("_s")).where("_s <> 3")
    return sums.select(*left.columns, F.when(F.col("_s") == 1, "left").otherwise("right").alias("side"))


def outside_scope(rows: DataFrame, blocked: DataFrame, keys: list[str], everything: DataFrame | None = None) -> DataFrame:
    """Rows whose keys are not blocked. everything is a table that, if it has any row, blocks all."""
    out = rows.join(blocked.select(*keys).distinct(), keys, "left_anti")
    return out.where(F.lit(everything.isEmpty())) if everything is not None else out


def member(path: Column, include: Sequence[str], exclude: Sequence[str], root: Column | None = None) -> Column:
    """In any included pattern and no excluded one, whatever their order; the root always is a member."""
    any_of = lambda globs: reduce(lambda a, b: a | b, (path.rlike(paths.glob_regex(g)) for g in globs), F.lit(False))
    inside = any_of(include) & ~any_of(exclude)
    return inside | root if root is not None else inside


def admitted(parts: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """A pattern fits a path if it fits it or any of its parents; excluded paths never come in, an empty include list is all."""
    all_paths = F.transform(paths.ancestors(parts), lambda x: F.array_join(x, "/"))
    any_of = lambda globs: F.exists(all_paths, lambda p: reduce(lambda a, b: a | b, (p.rlike(paths.glob_regex(g)) for g in globs)))
    inside = any_of(include) if include else F.lit(True)
    return inside & ~any_of(exclude) if exclude else inside


def last_rule(rules: Sequence[tuple[Column, str | None]], default: str) -> Column:
    """The value of the last rule that fits; a rule with None clears back to the default."""
    out = F.lit(default)
    for condition, value in rules:
        out = F.when(condition, F.lit(default if value is None else value)).otherwise(out)
    return out


#: The components and stem endings of test files, and the mark of generated ones.
TEST_COMPONENTS = ("test", "tests", "__tests__", "__mocks__")
TEST_STEMS = (".test", ".spec")
GENERATED_MARK, GENERATED_WITHIN = "@generated", 2048


def test_like(parts: Column) -> Column:
    name = F.element_at(parts, -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.exists(parts, lambda x: x.isin(*TEST_COMPONENTS)) | F.coalesce(reduce(lambda a, b: a | b, (stem.endswith(s) for s in TEST_STEMS)), F.lit(False))


def generated(text: Column) -> Column:
    """Whether the mark stands in a comment before the first code, within the first 2 KiB."""
    head = F.substring(text, 1, GENERATED_WITHIN)
    return head.rlike(r"^(?s)\s*(?:(?://[^\n]*\n|/\*.*?\*/)\s*)*(?://[^\n]*|/\*(?:(?!\*/).)*)" + GENERATED_MARK)


#: Kinds of source by file name ending, compound endings first.
SOURCE_KINDS = [
    (".d.ts", "declaration"), (".d.mts", "declaration"), (".d.cts", "declaration"),
    (".ts", "ts"), (".tsx", "tsx"), (".mts", "mts"), (".cts", "cts"),
    (".js", "js"), (".jsx", "jsx"), (".mjs", "mjs"), (".cjs", "cjs"),
    (".vue", "vue"), (".svelte", "svelte"), (".astro", "astro"),
]


def source_kind(name: Column) -> Column:
    """The kind of the first ending that fits; null for other files."""
    out = F.lit(None).cast("string")
    for ending, kind in reversed(SOURCE_KINDS):
        out = F.when(name.endswith(ending), kind).otherwise(out)
    return out
