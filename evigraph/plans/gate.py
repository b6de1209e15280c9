"""Write gate: evidence before and after a planned change, reduced to one decision.

Opening reserves paths to write and to read, and keeps the evidence of that moment as a run. What must not change meanwhile is
found from the analysis: all configuration, and the sources that links connect with what is leased (all sources, where that
is a directory or a new file). A lease on a file holds for all of its names. Closing audits again, brings the baseline up to
the transitions that other gates have published since, compares inputs, findings and limitations with it, and decides. Only
a decision that lets the change stand closes the gate and publishes its changes as a transition; any other one leaves it
open. Where nothing that an analysis reads has changed since one that the store keeps, that one is read instead; the run
that a gate was opened with is pinned until the gate is closed or abandoned. The control document holds open gates and their ledger; evidence and reservations are in the store's runs.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import delta, gates, graph, identity, ledger
from ..sources.tree import root_identity
from . import evidence, report
from .audit import SEVERITIES, Evidence, bounded
from .runs import RunStore, now_ms

FACT_KEYS = ["family", "rule_id", "path", "namespace", "name"]
SETS, RANKS = ["targets", "affected"], ["confidence", "grounding"]
OPEN, CLOSED, ABANDONED = "open", "closed", "abandoned"
#: Confidence by rank, the surer the higher.
CONFIDENCE = ("heuristic", "grounded")
#: What of an input is compared: how it was met, and its bytes.
RECORD = ["state", "payload_sha256"]
#: Times that the reservations of others may change while one's own are compared with them.
TRIES = 5


class GateError(RuntimeError):
    """The gate has changed under the operation, which must be asked for again."""


def _rank(column: str, values: Sequence[str]):
    return F.array_position(F.array(*map(F.lit, values)), F.col(column)).cast("int")


def facts(findings: DataFrame, limitations: DataFrame) -> DataFrame:
    """Findings and bounded limitations as delta facts; equal keys are merged.

    A finding is about itself and affects its source. Where it stands is its evidence, which changes incomparably; what its
    owner says of it is a payload, of which only the severity has ranks. An unresolved request is an opaque fact about what it
    may have meant, keyed by its importer and what was asked for, a relative request without the extension .js. Limitations
    without such a list are gaps and no facts.
    """
    say = lambda value, rank=None: F.struct(value.cast("string").alias("value"), (F.lit(None) if rank is None else rank).cast("int").alias("rank"))
    payload = F.create_map(F.lit("claim"), say(F.col("claim")), F.lit("disposition"), say(F.to_json("disposition")), F.lit("severity"), say(F.col("severity"), _rank("severity", SEVERITIES)))
    at = F.concat_ws(":", "path", "start", "end")
    shown = findings.select(F.lit("finding").alias("family"), "rule_id", "path", "namespace", F.col("exported_name").alias("name"), F.array("finding_id").alias("targets"), F.array("source_id").alias("affected"), _rank("confidence", CONFIDENCE).alias("confidence"), F.when(F.col("start").isNotNull(), 1).otherwise(0).alias("grounding"), at.alias("evidence"), payload.alias("payload"))
    asked = F.when(F.col("detail").rlike(r"^\.\.?/.*\.js$"), F.regexp_replace("detail", r"\.js$", "")).otherwise(F.col("detail"))
    none = F.create_map().cast(shown.schema["payload"].dataType)
    opaque = limitations.where(bounded()).select(F.lit("opacity").alias("family"), F.lit("unresolved-request").alias("rule_id"), "path", F.lit("").alias("namespace"), asked.alias("name"), F.col("candidates").alias("targets"), F.array("path").alias("affected"), F.lit(len(CONFIDENCE)).alias("confidence"), F.lit(1).alias("grounding"), F.concat_ws(":", "path", asked).alias("evidence"), none.alias("payload"))
    both = shown.unionByName(opaque)
    merged = delta.merge_facts(both, FACT_KEYS, SETS, RANKS, ["evidence"])
    return merged.join(delta.merge_payloads(both, FACT_KEYS, "payload"), FACT_KEYS)


def unsupported(root: str, path: str) -> str | None:
    """Why a declared path cannot be reserved; None if it can. A path that does not exist yet can."""
    parts = path.split("/")
    if not path or "\0" in path:
        return "empty"
    if path.startswith("/") or "\\" in path:
        return "not-relative"
    if ".." in parts:
        return "escapes-root"
    if any(p in ("", ".") for p in parts):
        return "not-canonical"
    if parts[0] == ".git":
        return "pruned"
    at = root
    for k, part in enumerate(parts):
        at = os.path.join(at, part)
        try:
            kind = os.lstat(at).st_mode
        except FileNotFoundError:
            return None
        except OSError:
            return "unreadable"
        if stat.S_ISLNK(kind):
            return "symbolic-link"
        if k < len(parts) - 1 and not stat.S_ISDIR(kind):
            return "below-a-file"
        if k == len(parts) - 1 and not (stat.S_ISDIR(kind) or stat.S_ISREG(kind)):
            return "not-regular"
    return None


def lease_kind(root: str, path: str) -> str:
    """What a declared path is now."""
    full = os.path.join(root, path)
    return gates.DIRECTORY if os.path.isdir(full) else gates.FILE if os.path.exists(full) else gates.NEW_FILE


def _parts(df: DataFrame) -> DataFrame:
    return df.withColumn("parts", paths.components(F.col("path")))


class Gate:
    def __init__(self, spark: SparkSession, root: str, store: RunStore):
        self.spark, self.root, self.store = spark, root, store

    def _paths(self, values: dict[str, Sequence[str]]) -> DataFrame:
        """(gate, path, parts) of the paths of each gate."""
        rows = self.spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "gate string, path string")
        return rows.withColumn("parts", paths.components(F.col("path")))

    def _overlap(self, mine: Sequence[str], theirs: dict[str, Sequence[str]]) -> bool:
        if not mine or not any(theirs.values()):
            return False
        return not graph.overlaps(self._paths({"": mine}), self._paths(theirs), "gate", "parts").isEmpty()

    def _reserved(self, others: dict[str, dict]) -> DataFrame | None:
        """(path, parts, role) of what other open gates have reserved by their analyses."""
        held = [self.store.read(x["reserved"], "reserved") for x in others.values() if x.get("reserved")]
        out = None
        for one in held:
            out = one if out is None else out.unionByName(one)
        return out

    def _reserve(self, gate: str, found: Evidence, leases: Sequence[str], reads: Sequence[str]) -> DataFrame:
        """(path, parts, role) of a gate: leases with every name of the files they name, and the inputs that must not change."""
        declared = self.spark.createDataFrame([(gate, lease_kind(self.root, p), p) for p in leases], "gate string, kind string, path string")
        names = graph.alias_groups(found.sources, "path", "physical_id")
        files = declared.where(F.col("kind") == gates.FILE)
        files = graph.follow_aliases(files, "gate", "path", names).select("gate", F.lit(gates.FILE).alias("kind"), "path")
        ours = declared.unionByName(files).distinct()
        fixed = gates.protected_inputs(ours, "gate", "kind", "path", found.inputs, found.links, "source", "target").select("path")
        asked = gates.covered(_parts(found.inputs.select("path")), "path", "parts", self._paths({gate: reads}), "parts")
        held = ours.select("path", F.lit("lease").alias("role")).union(fixed.union(asked).distinct().withColumn("role", F.lit("read")))
        return _parts(held.distinct())

    def _meets(self, mine: DataFrame, others: dict[str, dict]) -> list[str]:
        """The conflicts of a gate's reservations(path, parts, role) with those of other open gates, declared or found."""
        if not others:
            return []
        of = lambda role: mine.where(F.col("role") == role)
        theirs = [_parts(self.spark.createDataFrame([(p, r) for x in others.values() for r, k in (("lease", "leases"), ("read", "reads")) for p in x[k]], "path string, role string"))]
        found = self._reserved(others)
        held = theirs[0].select("path", "parts", "role") if found is None else theirs[0].select("path", "parts", "role").unionByName(found)
        leased, read = (held.where(F.col("role") == r).distinct().checkpoint() for r in ("lease", "read"))
        out = []
        if not graph.overlaps(of("lease"), leased, "path", "parts").isEmpty():
            out.append("write-conflict")
        if not gates.covered(of("read"), "path", "parts", leased, "parts").isEmpty() or not gates.covered(read, "path", "parts", of("lease"), "parts").isEmpty():
            out.append("semantic-input-conflict")
        return out

    def _others(self, gate: str) -> dict[str, dict]:
        with self.store.control(write=False) as c:
            return {g: x for g, x in c.get("gates", {}).items() if x["state"] == OPEN and g != gate}

    @staticmethod
    def _holds(others: dict[str, dict]) -> dict:
        return {g: (x["leases"], x["reads"], x.get("reserved")) for g, x in others.items()}

    def open(self, leases: Sequence[str], reads: Sequence[str] = (), operation: str | None = None) -> dict:
        """{gate, decision, run, signals}. leases are files or directories that the change may write, reads those that must not
        change meanwhile beside what the analysis protects. A reservation that meets that of another open gate, a path that
        cannot be declared, and a file that is not analysed are refused. If the analysis fails nothing stays reserved."""
        body = ["open", self.root, sorted(leases), sorted(reads)]
        with self.store.control() as c:
            if (old := self.store.once(c, operation, body)) is not None:
                return old
            others = {g: x for g, x in c.setdefault("gates", {}).items() if x["state"] == OPEN}
            gate = f"gate-{self.store.next(c, 'gate'):016x}"
            baseline = c["sequences"].get("transition", 0)
            c["gates"][gate] = {"state": OPEN, "leases": sorted(leases), "reads": sorted(reads), "baseline": baseline, "root": root_identity(self.root), "references": [], "opened_ms": now_ms(), "revisions": []}
        signals = []
        if self._overlap(leases, {g: x["leases"] for g, x in others.items()}):
            signals.append("write-conflict")
        if self._overlap(leases, {g: x["reads"] for g, x in others.items()}) or self._overlap(reads, {g: x["leases"] for g, x in others.items()}):
            signals.append("semantic-input-conflict")
        if any(unsupported(self.root, p) for p in (*leases, *reads)):
            signals.append("declared-path-unsupported")
        if signals:
            return self._finish(gate, ABANDONED, signals, None, operation, body)
        try:
            found, key, _ = evidence.gather(self.store, self.root)
            files = [(p,) for p in leases if lease_kind(self.root, p) == gates.FILE]
            named = self.spark.createDataFrame(files, "path string")
            if files and not named.join(found.sources, "path", "left_anti").isEmpty():
                return self._finish(gate, ABANDONED, ["declared-path-unsupported"], None, operation, body)
            reserved = self._reserve(gate, found, leases, reads).checkpoint()
            run = evidence.publish(self.store, found, key, {"reserved": reserved})
            raised = gates.opening_signals(found.gaps(), found.findings, found.limitations.where(bounded()))
            signals = [r.signal for r in raised.collect()]
            for _ in range(TRIES):
                others = self._others(gate)
                if met := self._meets(reserved, others):
                    return self._finish(gate, ABANDONED, met, run, operation, body)
                with self.store.control() as c:
                    if self._holds({g: x for g, x in c["gates"].items() if x["state"] == OPEN and g != gate}) == self._holds(others):
                        c["gates"][gate]["reserved"] = run
                        c["pins"][run] = sorted({*c["pins"].get(run, []), gate})
                        break
            else:
                raise GateError("reservations of other gates keep changing")
            return self._finish(gate, OPEN, signals, run, operation, body)
        except BaseException:
            with self.store.control() as c:
                if c["gates"][gate]["state"] == OPEN and not c["gates"][gate]["revisions"]:
                    c["gates"][gate]["revisions"].append({"run": None, "decision": None, "signals": ["analysis-failed"], "at_ms": now_ms()})
                    self._release(c, gate, ABANDONED)
            raise

    def close(self, gate: str, operation: str | None = None) -> dict:
        """{gate, decision, run, signals}: what changed since the gate was opened, and whether the plan covers it."""
        body = ["close", gate]
        with self.store.control() as c:
            if (old := self.store.once(c, operation, body)) is not None:
                return old
            entry = c["gates"][gate]
            if entry["state"] != OPEN:
                raise KeyError(f"{gate} is {entry['state']}")
            if not entry.get("reserved"):
                raise GateError(f"{gate} is still being opened")
            others = {g: x for g, x in c["gates"].items() if x["state"] == OPEN and g != gate}
            moves = [t for t in c.get("transitions", []) if t["sequence"] > entry["baseline"]]
            seen = c["sequences"].get("transition", 0), len(entry["revisions"])
        base = entry["reserved"]
        found, key, run = evidence.gather(self.store, self.root)
        run = run or evidence.publish(self.store, found, key)
        names = ["analysis-contract-changed"] if entry["root"] != root_identity(self.root) else []
        before, broken = self._reconciled(self.store.read(base, "inputs"), [t for t in moves if t["sequence"] in entry["references"]])
        if broken:
            names.append("transition-chain-broken")
        if self._catalog_changed(gate, entry, moves):
            names.append("transition-catalog-changed")
        after = self.store.read(run, "inputs").select("path", *RECORD)
        reserved = self.store.read(base, "reserved")
        role = lambda x: reserved.where(F.col("role") == x)
        both = _parts(before.select("path").union(after.select("path")).distinct()).checkpoint()
        leased = gates.covered(both, "path", "parts", role("lease"), "parts")
        changes = gates.closing_inputs(before, after, "path", RECORD, leased, before.join(role("read"), "path", "left_semi")).checkpoint()
        names += [r.signal for r in gates.closing_signals(changes).collect()]
        if not self._late_names(run, leased).isEmpty():
            names.append("unplanned-write")
        touched = changes.select("path").join(both, "path")
        theirs = self._paths({g: x["leases"] for g, x in others.items()}) if others else None
        if others and not gates.pending(touched, "path", "parts", theirs, "gate", "parts").isEmpty():
            names.append("active-transition-pending")
        if not found.gaps().isEmpty():
            names.append("required-evidence-incomplete")
        was, now = (facts(self.store.read(r, "findings"), self.store.read(r, "limitations")) for r in (base, run))
        deltas = delta.lifecycle(was, now, FACT_KEYS, SETS, RANKS, ["evidence"], payload="payload")
        names += [r.signal for r in delta.signals(deltas, RANKS, F.col("family") == "opacity").collect()]
        old, new = (df.select("path", F.col("payload_sha256").alias(name)) for df, name in ((before, "before"), (after, "after")))
        moved = changes.where("scope = 'leased'").select("path").join(old, "path", "left").join(new, "path", "left").collect()
        return self._finish(gate, CLOSED, names, run, operation, body, [[r["path"], r["before"], r["after"]] for r in moved], seen)

    def _late_names(self, run: str, leased: DataFrame) -> DataFrame:
        """Names, not leased, of files of which another name is."""
        groups = graph.alias_groups(self.store.read(run, "sources"), "path", "physical_id").where("n_names > 1")
        held = groups.join(leased, "path", "left_semi").select("representative").distinct()
        return groups.join(held, "representative", "left_semi").join(leased, "path", "left_anti")

    def _reconciled(self, inputs: DataFrame, moves: list[dict]) -> tuple[DataFrame, bool]:
        """(path, state, payload_sha256) of a baseline after other gates' transitions, and whether one of them does not fit."""
        if not moves:
            return inputs.select("path", *RECORD), False
        fixed, state = (inputs.where(c).select("path", *RECORD) for c in (F.col("state") != identity.SOURCE, F.col("state") == identity.SOURCE))
        rows = self.spark.createDataFrame([(p, t["sequence"], a, b) for t in moves for p, a, b in t["paths"]], "path string, sequence long, before string, after string")
        out = ledger.reconcile(rows, ["path"], "sequence", "before", "after", state, "payload_sha256").checkpoint()
        now = out.where("expected is not null").select("path", F.lit(identity.SOURCE).alias("state"), F.col("expected").alias("payload_sha256"))
        return fixed.union(now), not out.where("broken_at is not null").isEmpty()

    def _catalog_changed(self, gate: str, entry: dict, moves: list[dict]) -> bool:
        """Whether the transitions that a gate refers to are not those of the ledger behind its baseline."""
        if not moves and not entry["references"]:
            return False
        ledger_rows = self.spark.createDataFrame([(t["gate"], t["sequence"]) for t in moves], "gate string, sequence long")
        held = self.spark.createDataFrame([(gate, s) for s in entry["references"]], "gate string, sequence long")
        one = self.spark.createDataFrame([(gate, entry["baseline"])], "gate string, baseline long")
        return not gates.reference_faults(held, gates.attach(ledger_rows, one, "gate", "sequence", "baseline"), "gate", "sequence").isEmpty()

    def abandon(self, gate: str, operation: str | None = None) -> dict:
        """Gives an open gate's reservations back, without a decision on what was changed. Others are refused."""
        body = ["abandon", gate]
        with self.store.control() as c:
            if (old := self.store.once(c, operation, body)) is not None:
                return old
            entry = c["gates"][gate]
            if entry["state"] != OPEN:
                raise KeyError(f"{gate} is {entry['state']}")
            self._release(c, gate, ABANDONED)
            entry["revisions"].append({"run": None, "decision": None, "signals": [], "at_ms": now_ms()})
            return self.store.done(c, operation, body, {"gate": gate, "decision": None, "run": None, "signals": []})

    def show(self, gate: str) -> dict:
        """A gate's record as it is shown; a KeyError for what never was."""
        with self.store.control(write=False) as c:
            return report.gate_summary(gate, c.get("gates", {})[gate])

    @staticmethod
    def _release(c: dict, gate: str, state: str) -> None:
        entry = c["gates"][gate]
        if base := entry.get("reserved"):
            c["pins"][base] = [x for x in c["pins"].get(base, []) if x != gate]
        entry["state"], entry["references"] = state, []
        if state == ABANDONED:
            entry["leases"] = entry["reads"] = []
            entry.pop("reserved", None)

    def _finish(self, gate: str, state: str, signals: list[str], run: str | None, operation: str | None, body: object, moved: Sequence[list] = (), seen: tuple[int, int] | None = None) -> dict:
        """Puts a revision on record. What was evaluated must still hold under the lock: the gate is open and has no other
        revision (a GateError, for the operation may be asked for again), and no transition has been published since it was read,
        which makes the revision stale and leaves the gate open."""
        with self.store.control(write=False) as c:
            if seen is not None and c["sequences"].get("transition", 0) != seen[0]:
                signals = [*signals, "transition-catalog-changed"]
        last = seen and max(seen[0], c["sequences"].get("transition", 0))
        raised = self.spark.createDataFrame([(s,) for s in signals], "signal string")
        verdict = delta.decide(raised).withColumn("stands", gates.authorises(F.col("decision"))).first()
        result = {"gate": gate, "decision": verdict["decision"], "run": run, "signals": sorted(set(signals))}
        with self.store.control() as c:
            entry = c["gates"][gate]
            if entry["state"] != OPEN or (seen is not None and (len(entry["revisions"]) != seen[1] or c["sequences"].get("transition", 0) != last)):
                raise GateError(f"{gate} has changed meanwhile")
            entry["revisions"].append({"run": run, "decision": verdict["decision"], "signals": result["signals"], "at_ms": now_ms()})
            if state == ABANDONED or (state == CLOSED and verdict["stands"]):
                self._release(c, gate, state)
            if entry["state"] == CLOSED and moved:
                sequence = self.store.next(c, "transition")
                c.setdefault("transitions", []).append({"sequence": sequence, "gate": gate, "revision": len(entry["revisions"]), "paths": sorted(map(list, moved))})
                for g, x in c["gates"].items():
                    if g != gate and x["state"] == OPEN and x["baseline"] < sequence:
                        x["references"].append(sequence)
            return self.store.done(c, operation, body, result)
