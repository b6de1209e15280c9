"""Run store and write gate over a small repository."""

import os

import pytest

from evigraph.operators.paging import CursorError
from evigraph.plans import evidence
from evigraph.plans.audit import audit
from evigraph.plans.gate import Gate
from evigraph.plans.runs import Conflict, IntegrityError, RunStore, now_ms


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "store"))


def tables(spark, n=3):
    return {"findings": spark.range(n).toDF("id")}


def test_publish_read_and_detect_changed_bytes(spark, store):
    run = store.publish(tables(spark), "complete")
    assert store.read(run, "findings").count() == 3 and store.latest() == run and store.lookup(run) == "live"
    part = next((store.top / "runs" / run / "findings").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(IntegrityError):
        store.read(run, "findings")
    with pytest.raises(KeyError):
        store.lookup("run-none")


def test_failed_publication_leaves_no_run(spark, store):
    bad = spark.range(1).selectExpr("raise_error('no') AS x")
    with pytest.raises(Exception, match="no"):
        store.publish({"findings": bad}, "complete")
    with store.control(write=False) as c:
        assert [a["state"] for a in c["attempts"].values()] == ["failed"] and not c["catalog"]
    assert os.listdir(store.top / "staging") == [] and store.latest() is None


def test_recovery_of_attempts_without_owner(spark, store):
    run = store.publish(tables(spark), "complete")
    with store.control() as c:
        for attempt in ("att-" + run[4:], "att-00000000000000ff"):
            c["attempts"][attempt] = {"sequence": int(attempt[4:], 16), "state": "running", "started_ms": 0, "owner": 2**22 + 1}
        del c["catalog"][run]
    assert len(store.recover()) == 2 and store.lookup(run) == "live"
    with store.control(write=False) as c:
        assert c["attempts"]["att-00000000000000ff"]["state"] == "interrupted"


def test_runs_are_paged_and_cursors_go_stale(spark, store):
    runs = [store.publish(tables(spark, 1), "complete") for _ in range(3)]
    page = store.runs(size=2)
    assert [r.run for r in page.rows.collect()] == runs[:0:-1] and page.truncated
    assert [r.run for r in store.runs(page.next_cursor, 2).rows.collect()] == runs[:1]
    store.pin(runs[0], "keep")
    with pytest.raises(CursorError):
        store.runs(page.next_cursor, 2)


def test_retention_protects_and_resumes(spark, store):
    a, b, c = (store.publish(tables(spark, 1), "complete") for _ in range(3))
    (store.top / "runs" / "run-orphan").mkdir()
    store.pin(b, "why", operation="op-1")
    assert store.pin(b, "why", operation="op-1") == "why"
    with pytest.raises(Conflict):
        store.pin(b, "other", operation="op-1")
    stale = store.plan(now_ms() + 1000)
    store.unpin(b, "why")
    assert store.confirm(stale) == "stale"
    store.pin(b, "why")
    plan = store.plan(now_ms() + 2000)
    with store.control(write=False) as s:
        assert [x[1] for x in s["plans"][plan]["items"]] == [a, "run-orphan"]
        assert s["plans"][plan]["exclusions"] == [[b, ["pinned"]], [c, ["latest-completed"]]] or [c, ["latest-attempt", "latest-completed"]] in s["plans"][plan]["exclusions"]
    # a confirmation that stopped after its tombstones is finished by the next call
    with store.control() as s:
        for kind, name, evidence in s["plans"][plan]["items"]:
            s["tombstones"][name] = {"plan": plan, "kind": kind, "evidence": evidence, "state": "pruning"}
    assert store.lookup(a) == "pruning"
    assert store.confirm(plan) == "done" == store.confirm(plan)
    assert store.lookup(a) == "pruned" and sorted(os.listdir(store.top / "runs")) == [b, c] and os.listdir(store.top / "trash") == []


def test_a_store_moves_as_a_whole(spark, store, tmp_path):
    first, second = (store.publish(tables(spark, n), "complete") for n in (2, 3))
    store.pin(first, "keep")
    moved = store.migrate(str(tmp_path / "next"))
    assert moved.read(first, "findings").count() == 2 and moved.latest() == second == store.latest()
    assert moved.publish(tables(spark), "complete") > second and not list(tmp_path.glob(".next*"))
    with pytest.raises(FileExistsError):
        store.migrate(str(tmp_path / "next"))
    part = next((store.top / "runs" / first / "findings").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(IntegrityError):
        store.migrate(str(tmp_path / "other"))
    assert not list(tmp_path.glob("*other*"))


def test_a_gate_holds_for_its_root(spark, store, tmp_path):
    root = tmp_path / "repo"
    for k in range(2):
        root.mkdir()
        (root / "a.ts").write_text("console.log(1)")
        if k == 0:
            opened = Gate(spark, str(root), store).open(["a.ts"])
            root.rename(tmp_path / "old")
    closed = Gate(spark, str(root), store).close(opened["gate"])
    assert closed["decision"] == "stale" and closed["signals"] == ["analysis-contract-changed"]


def test_gate_decides_by_what_changed(spark, store, tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src" / "lib.ts").write_text("export const used = 1")
    (root / "src" / "main.ts").write_text("import {used} from './lib'")
    gate = Gate(spark, str(root), store)
    first = gate.open(["src/lib.ts"], operation="o1")
    assert first["decision"] == "allow" and gate.open(["src/lib.ts"], operation="o1") == first
    assert gate.open(["src"])["decision"] == "incomplete"  # overlaps the open gate
    (root / "src" / "lib.ts").write_text("export const used = 1; export const dead = 2")
    closed = gate.close(first["gate"])
    assert closed["decision"] == "deny" and closed["signals"] == ["adverse-fact-introduced"]
    assert gate.open(["src/lib.ts"])["signals"] == ["write-conflict"]  # a refused change keeps its gate open
    assert gate.abandon(first["gate"], "o2") == gate.abandon(first["gate"], "o2")
    with pytest.raises(KeyError):
        gate.abandon(first["gate"])
    second = gate.open(["src/lib.ts"])
    assert (second["decision"], second["signals"]) == ("allow-with-warnings", ["finding-warnings"])
    (root / "src" / "main.ts").write_text("import {used} from './lib'\nused()")
    (root / "src" / "lib.ts").write_text("export const used = 1")
    late = gate.close(second["gate"])  # main is linked with what is leased
    assert (late["signals"], late["decision"]) == (["protected-input-changed"], "stale")
    (root / "src" / "main.ts").write_text("import {used} from './lib'")
    assert gate.close(second["gate"])["decision"] == "allow"
    with pytest.raises(KeyError):
        gate.close(second["gate"])


def test_gates_side_by_side(spark, store, tmp_path):
    """A transition of one gate is part of the other's baseline; what a gate reads must stay; reservations do not cross."""
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    for name in ("a", "b", "c"):
        (root / "src" / f"{name}.ts").write_text(f"export const {name} = 1")
    for name in ("a", "b", "c"):
        (root / "src" / f"uses_{name}.ts").write_text(f"import {{{name}}} from './{name}'")
    gate = Gate(spark, str(root), store)
    one, two = gate.open(["src/a.ts"])["gate"], gate.open(["src/b.ts"], reads=["src/c.ts"])["gate"]
    assert gate.open(["src/c.ts"])["signals"] == ["semantic-input-conflict"]
    for bad in ("/etc/x", "../x", "src//a.ts", "", "src/a.ts/below", ".git/x"):
        assert "declared-path-unsupported" in gate.open([bad])["signals"]
    (root / "src" / "a.ts").write_text("export const a = 2")
    assert gate.close(one)["decision"] == "allow"
    with store.control(write=False) as c:
        assert c["gates"][two]["references"] == [1] and [t["paths"][0][0] for t in c["transitions"]] == ["src/a.ts"]
    (root / "src" / "c.ts").write_text("export const c = 2")
    assert (late := gate.close(two))["signals"] == ["protected-input-changed"] and late["decision"] == "stale"
    (root / "src" / "c.ts").write_text("export const c = 1")
    (root / "src" / "a.ts").write_text("export const a = 3")
    assert gate.close(two)["signals"] == ["unplanned-write"]  # not what the transition left there
    (root / "src" / "a.ts").write_text("export const a = 2")
    (root / "src" / "b.ts").write_text("export const b = 2")
    with store.control() as c:
        c["gates"][two]["references"] = []
    assert "transition-catalog-changed" in gate.close(two)["signals"]
    with store.control() as c:
        c["gates"][two]["references"] = [1]
    assert gate.close(two)["decision"] == "allow"


def test_configuration_and_directories_protect(spark, store, tmp_path):
    """An unplanned change of configuration is stale, as is one of any source where a directory or a new file is leased."""
    root = tmp_path / "repo"
    (root / "src" / "feature").mkdir(parents=True)
    (root / "tsconfig.json").write_text('{"compilerOptions": {"strict": true}}')
    (root / "src" / "lib.ts").write_text("export const used = 1")
    (root / "src" / "main.ts").write_text("import {used} from './lib'; import './gone'")
    (root / "src" / "alone.ts").write_text("console.log(1)")
    gate = Gate(spark, str(root), store)
    opened = gate.open(["src/alone.ts"])
    assert (opened["decision"], opened["signals"]) == ("allow-with-warnings", ["pre-existing-adverse-facts"])  # a bounded unresolved request
    (root / "tsconfig.json").write_text('{"compilerOptions": {"strict": true, "baseUrl": "src"}}')
    closed = gate.close(opened["gate"])
    assert closed["decision"] == "stale" and "protected-input-changed" in closed["signals"]
    (root / "tsconfig.json").write_text('{"compilerOptions": {"strict": true}}')
    (root / "src" / "lib.ts").write_text("export const used = 2")
    assert gate.close(opened["gate"])["signals"] == ["pre-existing-adverse-facts", "unplanned-write"]
    (root / "src" / "lib.ts").write_text("export const used = 1")
    assert gate.close(opened["gate"])["decision"] == "allow-with-warnings"
    wide = gate.open(["src/feature"])
    assert gate.open(["src/lib.ts"])["signals"] == ["semantic-input-conflict"]
    (root / "src" / "alone.ts").write_text("console.log(2)")
    assert gate.close(wide["gate"])["decision"] == "stale"
    gate.abandon(wide["gate"])
    (root / "tsconfig.json").write_text('{"compilerOptions": {"unheardOf": true}}')
    assert "required-evidence-incomplete" in gate.open(["src/alone.ts"])["signals"]


def test_names_of_a_leased_file_and_failures(spark, store, tmp_path, monkeypatch):
    from evigraph.plans import gate as plan

    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.ts").write_text("console.log(1)")
    os.link(root / "a.ts", root / "b.ts")
    gate = Gate(spark, str(root), store)
    real = plan.audit
    monkeypatch.setattr(plan, "audit", lambda *_: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError, match="gone"):
        gate.open(["a.ts"])
    monkeypatch.setattr(plan, "audit", real)
    assert gate.open(["README.md"])["signals"] == []  # a name that is not there yet
    with store.control(write=False) as c:
        states = [x["state"] for x in c["gates"].values()]
    assert states == ["abandoned", "open"]
    gate.abandon("gate-0000000000000002")
    opened = gate.open(["a.ts"])
    assert opened["decision"] == "allow" and "write-conflict" in gate.open(["b.ts"])["signals"]
    (root / "a.ts").write_text("console.log(2)")  # b.ts is the same file
    os.link(root / "a.ts", root / "late.ts")
    assert gate.close(opened["gate"])["decision"] == "deny"
    (root / "late.ts").unlink()

    def meanwhile(*args):
        gate.abandon(opened["gate"])
        return real(*args)

    monkeypatch.setattr(plan, "audit", meanwhile)
    with pytest.raises(plan.GateError):
        gate.close(opened["gate"])


def test_an_audit_is_read_again_only_where_nothing_has_changed(spark, store, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "lib.ts").write_text("export const used = 1; export const dead = 2")
    (root / "main.ts").write_text("import {used} from './lib'")
    again = lambda **k: evidence.audited(store, str(root), **k)
    first = again()
    assert again() == first and store.latest() == first
    found, _, run = evidence.gather(store, str(root))
    plain = audit(spark, str(root))
    assert run == first
    for name in ("links", "findings", "limitations", "inputs"):
        assert sorted(map(str, getattr(found, name).collect())) == sorted(map(str, getattr(plain, name).collect()))
    assert [tuple(r) for r in found.links.collect()] == [("main.ts", "lib.ts")]
    others = [again(roles=[("lib.ts", "generated")]), again(exclude=["main.ts"]), again(profile="node16")]
    assert len({first, *others}) == 4 and again() == first  # what was asked for is part of the key
    (root / "tsconfig.json").write_text("{}")
    configured = again()
    assert configured not in {first, *others}  # so is configuration
    (root / "gone.ts").symlink_to(tmp_path / "nowhere.ts")
    assert again() not in {first, configured, *others}  # and what cannot be read
    (root / "gone.ts").unlink()
    assert again() == configured
    part = next((store.top / "runs" / configured / "findings").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    with pytest.raises(IntegrityError):
        again()


def test_retention_keeps_what_an_open_gate_was_opened_with(spark, store, tmp_path):
    root = tmp_path / "repo"
    root.mkdir()
    (root / "a.ts").write_text("export const a = 1")
    gate = Gate(spark, str(root), store)
    first = gate.open(["a.ts"])
    store.publish(tables(spark), "complete")  # the latest run is another one
    with store.control(write=False) as c:
        assert [x[0] for x in store._planned(c, now_ms() + 1)["exclusions"]] == [first["run"], store.latest()]
    closed = gate.close(first["gate"])
    assert closed["run"] == first["run"] and closed["decision"] == first["decision"] == "allow-with-warnings"  # nothing has changed
    with store.control(write=False) as c:
        assert first["run"] in [x[1] for x in store._planned(c, now_ms() + 1)["items"]]
