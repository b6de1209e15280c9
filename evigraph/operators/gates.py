"""Gates and their ledger as tables: signals of opening and closing, transitions, the references that open gates hold on
transitions, and what an age limit may remove of closed gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import paths
from ..sources.state import keep
from . import graph
from .identity import SOURCE, STATES
from .sizes import spread

#: What a lease names; all but the first protect every source.
FILE, DIRECTORY, NEW_FILE = "file", "directory", "new-file"
#: Decisions that let a change stand, and the kinds of retained records in their order.
AUTHORISING = ("allow", "allow-with-warnings")
ITEM_KINDS = ("gate", "evidence", "revision", "finding", "operation", "transition")
#: Sequence numbers in one block of a range join.
BLOCK = 1024


def authorises(decision: Column) -> Column:
    """Whether a decision closes its gate; a gate without such a decision stays open."""
    return F.coalesce(decision.isin(*AUTHORISING), F.lit(False))


def _counted(counts: dict[str, DataFrame]) -> DataFrame:
    found = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("signal"), "n") for name, df in counts.items()]
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out.where("n > 0")


def opening_signals(gaps: DataFrame, findings: DataFrame, advisory: DataFrame) -> DataFrame:
    """(signal, n) of a gate that opens: gaps of required evidence, findings, and limitations that only advise, each for itself."""
    return _counted({"required-evidence-incomplete": gaps, "finding-warnings": findings, "pre-existing-adverse-facts": advisory})


def covered(changed: DataFrame, key: str, parts: str, leases: DataFrame, lease_parts: str) -> DataFrame:
    """The keys whose path a lease names or contains; each path looks its own ancestors up."""
    up = changed.select(key, F.explode(paths.ancestors(F.col(parts))).alias("_p"))
    return up.join(leases.select(F.col(lease_parts).alias("_p")).distinct(), "_p", "left_semi").select(key).distinct()


def protected_inputs(leases: DataFrame, gate: str, kind: str, path: str, inputs: DataFrame, links: DataFrame, a: str, b: str) -> DataFrame:
    """(gate, path) of the inputs(path, state) that each gate fixes by what it leases.

    A lease on a file fixes all sources that links(a, b) between sources connect with it, itself included; one on a directory
    or on a new file fixes all sources. What is no source is fixed by every gate. Links go both ways, so the closures of all
    gates are read off one labelling of connected sources; a source without links is its own. An input has one row with what it
    is, and close and fixed have no pair in common, so the pairs need no distinct. Gates, one row each, meet every input.
    """
    rest = [x for x in STATES if x != SOURCE]
    has = lambda c: F.coalesce(F.max(c), F.lit(False))
    flags = spread(inputs.select(path, "state"), inputs.count(), path).groupBy(path).agg(has(F.col("state") == SOURCE).alias("_s"), has(F.col("state").isin(rest)).alias("_r"))
    flags = keep(flags.where("_s or _r"))
    named = graph.components(links, a, b).withColumnRenamed("node", path)
    placed = keep(flags.where("_s").join(named, path, "left").select(path, "_r", F.coalesce("component", F.col(path)).alias("component")))
    ours = leases.select(gate, kind, path)
    every = keep(ours.groupBy(gate).agg(has(F.col(kind) != FILE).alias("_wide")))
    files = ours.where(F.col(kind) == FILE).join(placed.select(path, "component"), path).select(gate, "component").distinct()
    wide = every.where("_wide").select(F.col(gate).alias("_g"))
    close = files.join(wide, F.col(gate).eqNullSafe(F.col("_g")), "left_anti").join(placed.where("not _r"), "component").select(gate, path)
    fixed = flags.join(F.broadcast(every), F.col("_r") | F.col("_wide")).select(gate, path)
    return close.union(fixed)


def closing_inputs(baseline: DataFrame, current: DataFrame, key: str, record: Sequence[str], leased: DataFrame, protected: DataFrame) -> DataFrame:
    """(key, change, scope) of every input that differs: change is added, removed or changed.

    leased holds keys that the gate may write. protected holds keys with the record that a transition or a reader has fixed: an
    input that is now as fixed there is settled, any other one that is not leased is protected. All else is unplanned. An
    added input that is as fixed is no change of this gate and has no row. Null keys are left out.
    """
    row = lambda df, name: df.where(F.col(key).isNotNull()).select(key, F.struct(*record).alias(name))
    rows = row(baseline, "_b").join(row(current, "_c"), key, "full").where(~F.col("_b").eqNullSafe(F.col("_c")))
    rows = rows.join(leased.select(key).distinct().withColumn("_l", F.lit(True)), key, "left")
    rows = rows.join(row(protected, "_p"), key, "left")
    added, as_fixed = F.col("_b").isNull(), F.col("_p").isNotNull() & F.col("_p").eqNullSafe(F.col("_c"))
    change = F.when(added, "added").when(F.col("_c").isNull(), "removed").otherwise("changed")
    scope = F.when(F.col("_l"), "leased").when(F.col("_p").isNull(), "unplanned").when(as_fixed, "settled").otherwise("protected")
    return rows.where(~(added & as_fixed)).select(key, change.alias("change"), scope.alias("scope"))


def closing_signals(changes: DataFrame) -> DataFrame:
    """(signal, n) of the changes of closing_inputs."""
    raised = F.when(F.col("scope") == "protected", "protected-input-changed").when(F.col("scope") == "unplanned", "unplanned-write")
    return changes.select(raised.alias("signal")).where("signal is not null").groupBy("signal").agg(F.count("*").alias("n"))


def pending(changed: DataFrame, path: str, parts: str, leases: DataFrame, gate: str, lease_parts: str) -> DataFrame:
    """(path, gate): changed paths that a lease of another open gate covers."""
    up = changed.select(path, F.explode(paths.ancestors(F.col(parts))).alias("_p"))
    return up.join(leases.select(gate, F.col(lease_parts).alias("_p")).distinct(), "_p").select(path, gate).distinct()


def attach(transitions: DataFrame, gates: DataFrame, gate: str, sequence: str, baseline: str) -> DataFrame:
    """(gate, sequence): every transition of another gate behind an open gate's baseline.

    A join by range as one by blocks of sequence numbers: a gate is filed under the blocks from its baseline on, so a
    transition only meets gates of its own block. Tasks are as many as transitions times gates ask for: what goes in is small,
    what comes out is not.
    """
    block = lambda c: F.floor(c / F.lit(BLOCK)).cast("long")
    rows = transitions.select(F.col(gate).alias("_own"), F.col(sequence), block(F.col(sequence)).alias("_block"))
    last = rows.agg(F.max("_block").alias("_last")).where("_last is not null")
    held = gates.select(gate, F.col(baseline).alias("_base"), block(F.col(baseline)).alias("_first")).join(last, F.col("_first") <= F.col("_last"))  # one row
    held = held.select(gate, "_base", F.explode(F.sequence("_first", "_last")).alias("_block"))
    rows = spread(rows, transitions.count() * gates.count(), "_block")
    return rows.join(held, "_block").where((F.col(sequence) > F.col("_base")) & ~F.col("_own").eqNullSafe(F.col(gate))).select(gate, sequence)


def reference_faults(references: DataFrame, expected: DataFrame, gate: str, sequence: str) -> DataFrame:
    """(gate, sequence, fault): references that should be there and are missing, that nothing explains, or that are there twice.
    Both sides are counted to size the tasks, then go through one shuffle and one grouping; null keys of one side never meet those of the other."""
    alone = F.when(F.col(gate).isNull() | F.col(sequence).isNull(), F.col("_w")).alias("_alone")
    row = lambda df, n, w: df.select(gate, sequence, F.lit(n).cast("long").alias("_n"), F.lit(w).alias("_w")).select("*", alone)
    both = spread(row(references, 1, False).union(row(expected, 0, True)), references.count() + expected.count(), gate, sequence)
    sums = both.groupBy(gate, sequence, "_alone").agg(F.sum("_n").alias("_n"), F.max("_w").alias("_w"))
    fault = F.when(F.col("_n") == 0, "missing").when(~F.col("_w"), "unknown").when(F.col("_n") > 1, "duplicate")
    return sums.select(gate, sequence, fault.alias("fault")).where("fault is not null")


def plan_gates(gates: DataFrame, gate: str, state: str, committed: str, cutoff, references: DataFrame, holder: str) -> tuple[DataFrame, DataFrame]:
    """(gates that may go, exclusions(gate, reason, holders)) of gates(gate, state, committed).

    Open gates and closed ones without a date are excluded whatever their age. Of those committed strictly before the cutoff
    the ones that references(gate, holder) name are excluded, with their holders. Younger gates are neither.
    """
    none = F.array().cast("array<string>")
    holds = references.where(F.col(gate).isNotNull()).select(gate, F.col(holder).cast("string").alias("_h")).distinct().groupBy(gate).agg(F.array_sort(F.collect_list("_h")).alias("holders"))
    active = gates.where(F.col(state) == "active").select(gate, F.lit("active-gate").alias("reason"), none.alias("holders"))
    closed = gates.where(~F.col(state).eqNullSafe("active"))
    undated = closed.where(F.col(committed).isNull()).select(gate, F.lit("terminal-timestamp-unavailable").alias("reason"), none.alias("holders"))
    old = closed.where(F.col(committed) < F.lit(cutoff)).join(holds, gate, "left")
    held = old.where("holders is not null").select(gate, F.lit("active-transition-reference").alias("reason"), "holders")
    return old.where("holders is null").drop("holders"), active.unionByName(undated).unionByName(held)


def gate_items(planned: DataFrame, gate: str, parts: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """(kind_rank, kind, gate, record_id) of all records of the planned gates; parts are (kind, table with gate, id column).
    The order of a plan is that of kind_rank, gate, record_id."""
    out = planned.select(F.lit(0).alias("kind_rank"), F.lit("gate").alias("kind"), gate, F.col(gate).cast("string").alias("record_id"))
    for kind, table, key in parts:
        own = table.select(gate, F.col(key).cast("string").alias("record_id")).join(planned.select(gate), gate, "left_semi")
        out = out.unionByName(own.select(F.lit(ITEM_KINDS.index(kind)).alias("kind_rank"), F.lit(kind).alias("kind"), gate, "record_id"))
    return out


def conflicts(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, n_values) of keys that are bound to several values; a null value is one of them."""
    counted = rows.groupBy(*keys).agg((F.count_distinct(value) + F.max(F.col(value).isNull().cast("int"))).alias("n_values"))
    return counted.where("n_values > 1")


def bind_one(requests: DataFrame, targets: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """Adds binding and outcome: bound where exactly one target has the request's keys, else none or several."""
    found = targets.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(target).alias("_t"))
    rows = requests.join(found, list(keys), "left")
    outcome = F.when(F.col("_n").isNull(), "none").when(F.col("_n") == 1, "bound").otherwise("several")
    return rows.withColumns({"binding": F.when(F.col("_n") == 1, F.col("_t")), "outcome": outcome}).drop("_n", "_t")


def bijection_faults(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, fault): missing, unexpected, or repeated on either side. Without a row both hold the same keys, once each."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    rows = count(expected, "_e").join(count(observed, "_o"), list(keys), "full")
    fault = F.when(F.col("_o").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when((F.col("_e") > 1) | (F.col("_o") > 1), "repeated")
    return rows.select(*keys, fault.alias("fault")).where("fault is not null")


def plan_closure(plans: DataFrame, operations: DataFrame, plan: str, kind: str, state: str) -> DataFrame:
    """(plan, fault): a plan has exactly one creation, and a confirmation exactly if its state says so."""
    of = operations.groupBy(plan).agg(F.count_if(F.col(kind) == "create").alias("_c"), F.count_if(F.col(kind) == "confirm").alias("_f"))
    rows = plans.select(plan, F.col(state).alias("_s")).join(of, plan, "full")
    made, done = F.coalesce("_c", F.lit(0)), F.coalesce("_f", F.lit(0))
    known = F.col("_s").isNotNull()
    fault = F.when(~known, "unknown-plan").when(made != 1, "creations").when((F.col("_s") == "confirmed") != (done > 0), "confirmation")
    return rows.select(plan, fault.alias("fault")).where("fault is not null")


def tombstone_faults(tombstones: DataFrame, items: DataFrame, live: DataFrame, key: str, digest: str, state: str) -> DataFrame:
    """(key, fault): a tombstone names a planned item and its digest, a pruned record is gone, one being pruned is still there."""
    planned = items.select(key, F.col(digest).alias("_planned"))
    there = live.select(key).distinct().withColumn("_live", F.lit(True))
    rows = tombstones.select(key, F.col(digest).alias("_d"), F.col(state).alias("_s")).join(planned, key, "left").join(there, key, "left")
    fault = (
        F.when(F.col("_planned").isNull(), "not-planned")
        .when(~F.col("_planned").eqNullSafe(F.col("_d")), "other-digest")
        .when((F.col("_s") == "pruned") & F.col("_live").isNotNull(), "still-there")
        .when((F.col("_s") == "pruning") & F.col("_live").isNull(), "already-gone")
    )
    return rows.select(key, fault.alias("fault")).where("fault is not null")
