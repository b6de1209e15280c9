"""What is shown of runs and gates."""

import base64
import json

from evigraph.plans import report
from evigraph.plans.audit import audit
from evigraph.plans.gate import Gate
from evigraph.plans.runs import RunStore


def test_lists_become_counts(spark):
    rows = [("a", [{"n": 1, "x": [1, 2], "y": None}, {"n": 2, "x": [], "y": ["z"]}]), ("b", []), ("c", None)]
    made = spark.createDataFrame(rows, "id string, items array<struct<n:int,x:array<int>,y:array<string>>>")
    got = {r.id: (r.n_items, r["items"]) for r in report.counted(made, "id", "items", ["x", "y"], ["n"]).collect()}
    assert got["a"][0] == 2 and [tuple(x) for x in got["a"][1]] == [(1, 2, 0), (2, 0, 1)]
    assert got["b"] == (0, []) and got["c"] == (0, None)


def test_signals_become_rows(spark):
    rows = [("g", [("a", {"path": "p"}), ("b", {}), ("c", None)]), ("h", []), ("i", None)]
    made = spark.createDataFrame(rows, "gate string, signals array<struct<kind:string,payload:map<string,string>>>")
    got = [tuple(r) for r in report.flat_signals(made, ["gate"], "signals", ["path", "count"]).orderBy("at").collect()]
    assert got == [("g", 0, "a", "p", None), ("g", 1, "b", None, None), ("g", 2, "c", None, None)]


def test_a_run_and_its_gate_are_shown(spark, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a é.ts").write_text("export const a = 1")
    (root / "b.ts").write_text("import x from './none'")
    found = audit(spark, str(root))
    shown = report.overview("run-1", found)
    assert (shown["findings"], shown["limitations"], shown["limitationsByReason"]) == (1, 1, {"internal-specifier-unresolved": 1})
    assert shown["capabilities"] == [{"capability": "dead-export", "state": "incomplete"}]
    row = report.finding_rows(found.findings).first()
    canonical = base64.urlsafe_b64decode(row.path.canonical + "=" * (-len(row.path.canonical) % 4))
    assert row.path.display == "a é.ts" and canonical.endswith("a é.ts".encode()) and row.severity == "warning"
    gate = Gate(spark, str(root), RunStore(spark, str(tmp_path / "store")))
    opened = gate.open(["b.ts"], reads=["a é.ts"])
    shown = gate.show(opened["gate"])
    assert (shown["lifecycle"], shown["currentRevision"], shown["protectedInputs"], shown["leases"]) == ("open", 1, 1, [{"display": "b.ts"}])
    assert shown["revisions"][0]["signals"] == opened["signals"]
    text = report.to_json(shown)
    assert json.loads(text) == shown and text == report.to_json(json.loads(text)) and ": " not in text
