"""What is shown of runs and gates: flat rows, nested records with their lists as counts, and versioned JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing
from .audit import RULE, Audit

#: The versions of what is shown.
OVERVIEW, GATE = "evigraph.overview.v1", "evigraph.gate.v1"


def finding_rows(findings: DataFrame) -> DataFrame:
    """A finding as it is shown: its path as text and, for what text cannot hold, its canonical bytes in base64url."""
    shown = F.struct(hashing.base64_url(F.col("path_key")).alias("canonical"), F.col("path").alias("display"))
    return findings.select("finding_id", "rule_id", F.lower("severity").alias("severity"), F.lower("confidence").alias("confidence"), "disposition", "claim", shown.alias("path"), "start", "end", F.col("exported_name").alias("name"), "namespace")


def counted(records: DataFrame, key: str, items: str, lists: Sequence[str], kept: Sequence[str]) -> DataFrame:
    """(key, n_items, items) where each item keeps the fields kept and has its lists as n_<list> counts.

    A null list counts as empty, a null array of items has none; the order of items stays.
    """
    size = lambda c: F.coalesce(F.array_size(c), F.lit(0))
    short = lambda x: F.struct(*(x[k].alias(k) for k in kept), *(size(x[n]).alias(f"n_{n}") for n in lists))
    return records.select(key, size(F.col(items)).alias("n_items"), F.transform(items, short).alias(items))


def flat_signals(rows: DataFrame, keys: Sequence[str], signal: str, fields: Sequence[str]) -> DataFrame:
    """One row a signal of an array of struct(kind, payload map): its kind, and every named field, null where it has none."""
    one = rows.select(*keys, F.posexplode(signal).alias("at", "_s"))
    return one.select(*keys, "at", F.col("_s.kind").alias("kind"), *(F.try_element_at("_s.payload", F.lit(f)).alias(f) for f in fields))


def overview(run: str, found: Audit) -> dict:
    """State and counts of a run, and its limitations by reason; the rows themselves are asked for by page."""
    total = found.summary().first()
    reasons = found.limitations.groupBy("reason").agg(F.count("*").alias("n")).orderBy("reason").collect()
    return {
        "schemaVersion": OVERVIEW,
        "scope": {"kind": "run", "id": run},
        "capabilities": [{"capability": RULE, "state": total["state"]}],
        "findings": total["n_findings"],
        "reviewOnly": total["n_review_only"],
        "limitations": total["n_limitations"],
        "limitationsByReason": {r["reason"]: r["n"] for r in reasons},
    }


def gate_summary(gate: str, entry: dict) -> dict:
    """A gate's record with the contents of its lists but for what was declared left out."""
    revisions = [{"revision": k + 1, "decision": r["decision"], "signals": list(r["signals"]), "run": r["run"]} for k, r in enumerate(entry["revisions"])]
    return {
        "schemaVersion": GATE,
        "gate": gate,
        "lifecycle": entry["state"],
        "currentRevision": len(revisions),
        "leases": [{"display": p} for p in entry["leases"]],
        "protectedInputs": len(entry["reads"]),
        "transitionReferences": list(entry["references"]),
        "baselineSequence": entry["baseline"],
        "revisions": revisions,
    }


def to_json(value: object) -> str:
    """The one form in which records are shown: sorted keys, no blanks, non-ASCII text as it is, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)

