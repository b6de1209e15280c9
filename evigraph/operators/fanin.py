"""Fan-in: how often each defined identity is used, and the identities that no production use refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

COUNTERS = ("production_exact", "test_exact", "production_broad", "test_broad", "public_surface")


def _lanes(uses: DataFrame, keys: list[str], name: str) -> DataFrame:
    return uses.groupBy(*keys).agg(F.count_if(~F.col("is_test")).alias(f"production_{name}"), F.count_if("is_test").alias(f"test_{name}"))


def fan_in(
    definitions: DataFrame,
    identity: list[str],
    exact: DataFrame | None = None,
    broad: DataFrame | None = None,
    broad_keys: list[str] | None = None,
    public: DataFrame | None = None,
    public_keys: list[str] | None = None,
) -> DataFrame:
    """Adds the five counters to each definition.

    exact and broad uses hold their keys and is_test; broad uses and public surfaces name only part of the identity and
    count for every definition they fit. Uses are counted by key before they meet definitions, so a key with very many
    uses is summed map-side and a broad use never fans out into rows. Uses of nothing defined are dropped; null keys fit
    nothing.
    """
    out = definitions
    if exact is not None:
        out = out.join(_lanes(exact, identity, "exact"), identity, "left")
    if broad is not None:
        out = out.join(_lanes(broad, broad_keys, "broad"), broad_keys, "left")
    if public is not None:
        out = out.join(public.groupBy(*public_keys).agg(F.count("*").alias("public_surface")), public_keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in out.columns else F.lit(0).cast("long") for c in COUNTERS})


def unused(counted: DataFrame, declaration: Column | None = None) -> DataFrame:
    """The identities without production use or public surface, with the claim made about each.

    A use from tests alone saves nothing but changes the claim. Declarations are never claimed to be unused.
    """
    idle = (F.col("production_exact") == 0) & (F.col("production_broad") == 0) & (F.col("public_surface") == 0)
    if declaration is not None:
        idle = idle & ~F.coalesce(declaration, F.lit(False))
    tests = F.col("test_exact") + F.col("test_broad")
    claim = F.when(tests > 0, F.format_string("used only by tests (%d)", tests)).otherwise(F.lit("no use found"))
    return counted.where(idle).withColumns({"test_uses": tests, "claim": claim})


def disposition(generated: Column, vendored: Column) -> Column:
    """What a finding asks for, by the roles of its file: review, where the file is not written by hand."""
    reason = F.when(generated & vendored, "generated-vendored").when(generated, "generated").when(vendored, "vendored")
    return F.struct(F.when(reason.isNull(), F.lit("actionable")).otherwise(F.lit("review-only")).alias("kind"), reason.alias("reason"))
