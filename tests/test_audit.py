"""Small repositories, one rule a test."""

import pytest

from evigraph.plans import workspaces
from evigraph.plans.audit import Config, audit, findings_page
from evigraph.sources import documents, settings, sfc
from evigraph.sources.modules import module_facts
from evigraph.sources.tree import IgnoreRules, walk


@pytest.fixture
def tree(tmp_path):
    def make(files):
        for path, text in files.items():
            p = tmp_path / path
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(tmp_path)

    return make


def names(result):
    return sorted(r.exported_name for r in result.findings.collect())


def reasons(result):
    return sorted({r.reason for r in result.limitations.collect()})


def test_one_dead_one_used_whatever_the_partitions(spark, tree):
    root = tree({"src/lib.ts": "export const used = 1; export const dead = 2", "src/main.ts": "import {used} from './lib.js'; used()"})
    a = audit(spark, root)
    assert names(a) == ["dead"] and a.state() == "complete"
    first = sorted(map(str, a.findings.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    assert sorted(map(str, audit(spark, root).findings.collect())) == first
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    page = findings_page(a.findings, "run-1")
    assert [r.exported_name for r in page.rows.collect()] == ["dead"] and not page.truncated


def test_roles_stay_visible(spark, tree):
    root = tree({"a.ts": "export const a = 1", "b.ts": "// @generated\nexport const b = 1", "third/c.ts": "export const c = 1"})
    got = {r.exported_name: r.disposition.kind for r in audit(spark, root, roles=[("third/**", "vendored")]).findings.collect()}
    assert got == {"a": "actionable", "b": "review-only", "c": "review-only"}


def test_parse_failure_blocks_the_workspace(spark, tree):
    a = audit(spark, tree({"a.ts": "export const = ;", "b.ts": "export const b = 1"}))
    assert names(a) == [] and a.state() == "incomplete" and reasons(a) == ["js-module-use-unknown"]


def test_unresolved_blocks_only_its_candidates(spark, tree):
    a = audit(spark, tree({"main.ts": "import x from './missing'", "other.ts": "export const dead = 1", "missing.txt": ""}))
    assert names(a) == ["dead"] and reasons(a) == ["internal-specifier-unresolved"]


def test_tests_change_the_claim_only(spark, tree):
    a = audit(spark, tree({"lib.ts": "export const t = 1", "lib.test.ts": "import {t} from './lib'"}))
    assert [r.claim for r in a.findings.collect()] == ["only tests ask for `t`"]


def test_node16_esm_needs_extensions_unless_overridden(spark, tree):
    root = tree({"package.json": '{"type":"module","private":true}', "tsconfig.json": '{"compilerOptions":{"moduleResolution":"node16"}}', "lib.ts": "export const used=1, dead=2", "main.ts": "import {used} from './lib'"})
    a = audit(spark, root)
    assert names(a) == [] and a.state() == "incomplete"
    b = audit(spark, root, profile="bundler")
    assert names(b) == ["dead"] and b.state() == "complete"


def test_unknown_option_blocks_its_package(spark, tree):
    a = audit(spark, tree({"package.json": '{"private":true}', "tsconfig.json": '{"compilerOptions":{"odd":1}}', "a.ts": "export const a = 1"}))
    assert names(a) == [] and reasons(a) == ["tsconfig-semantics-unsupported"]


def test_extends_paths_and_base_url(spark, tree):
    root = tree({
        "tsconfig.base.json": '{"compilerOptions":{"baseUrl":"src","paths":{"@wrong":["x"]}}}',
        "tsconfig.json": '// c\n{"extends":"./tsconfig.base","compilerOptions":{"paths":{"@lib":["lib"],"@/*":["*"]},}}',
        "src/lib.ts": "export const used = 1; export const dead = 1", "src/util.ts": "export const u = 1; export const v = 1", "src/deep/w.ts": "export const w = 1",
        "src/main.ts": "import {used} from '@lib'; import {u} from '@/util'; import {w} from 'deep/w'; import r from 'react'",
    })
    a = audit(spark, root)
    assert names(a) == ["dead", "v"] and a.state() == "complete"


def test_duplicate_package_names_have_no_winner(spark, tree):
    a = audit(spark, tree({"package.json": '{"private":true,"workspaces":["p/*"]}', "p/a/package.json": '{"name":"x"}', "p/b/package.json": '{"name":"x"}', "p/a/i.ts": "export const a=1"}))
    assert names(a) == [] and reasons(a) == ["package-identity-unsupported"] and a.limitations.count() == 2


def test_workspace_packages_by_key_and_public_surface(spark, tree):
    root = tree({
        "package.json": '{"private":true,"workspaces":["packages/*"]}',
        "packages/lib/package.json": '{"name":"@w/lib","private":true,"exports":{".":{"node":"./src/n.ts","default":"./src/index.ts"},"./*":"./src/f/*.ts","./exact":"./src/e.ts"}}',
        "packages/lib/src/index.ts": "export const main = 1, mainDead = 1", "packages/lib/src/n.ts": "export const nodeOnly = 1",
        "packages/lib/src/f/one.ts": "export const one = 1, oneDead = 1", "packages/lib/src/f/exact.ts": "export const patternDead = 1", "packages/lib/src/e.ts": "export const e = 1, exactDead = 1",
        "packages/app/package.json": '{"name":"app","private":true}',
        "packages/app/m.ts": "import {main} from '@w/lib'; import {one} from '@w/lib/one'; import {e} from '@w/lib/exact'",
        "packages/pub/package.json": '{"name":"pub","main":"./lib/i.js"}', "packages/pub/lib/i.ts": "export {p} from './q'", "packages/pub/lib/q.ts": "export const p = 1, siblingDead = 1",
    })
    a = audit(spark, root)
    assert reasons(a) == []
    assert names(a) == ["exactDead", "mainDead", "nodeOnly", "oneDead", "patternDead", "siblingDead"]


def test_names_hold_within_a_workspace_only(spark, tree):
    lib = {"a/lib/package.json": '{"name":"lib","private":true,"main":"./i.js"}', "a/lib/i.ts": "export const used = 1, dead = 1", "b/app/m.ts": "import {used} from 'lib'", "b/app/package.json": '{"name":"app","private":true}'}
    a = audit(spark, tree({**lib, "a/package.json": '{"private":true,"workspaces":{"packages":["*"]}}', "b/package.json": '{"private":true,"workspaces":["app"]}'}))
    assert names(a) == ["dead", "used"] and reasons(a) == []
    b = audit(spark, tree({"pnpm-workspace.yaml": "packages: ['*/*', '!x/*']\n", "a/package.json": '{"private":true}', "b/package.json": '{"private":true}'}))
    assert names(b) == ["dead"] and reasons(b) == []


def test_a_list_file_replaces_the_manifest_beside_it():
    roots = [(), ("p", "a"), ("p", "b"), ("q", "c"), ("p", "a", "deep")]
    manifest = {"package.json": {"workspaces": ["p/*"]}}
    assert workspaces.owners(manifest, roots) == ({(): (), ("p", "a"): (), ("p", "b"): ()}, [])
    listed = {**manifest, "pnpm-workspace.yaml": {"packages": ["!p/b", "**"]}, "p/a/package.json": {"workspaces": ["deep"]}}
    assert workspaces.owners(listed, roots)[0] == {(): (), ("p", "a"): ("p", "a"), ("q", "c"): (), ("p", "a", "deep"): ("p", "a")}
    assert workspaces.owners({**manifest, "pnpm-workspace.yaml": None}, roots) == ({(): ()}, [])
    odd, told = workspaces.owners({"package.json": {"workspaces": ["!x"]}, "q/pnpm-workspace.yaml": {"catalog": {}, "odd": 1, "packages": "x"}}, roots)
    assert odd == {(): ()} and sorted(r for r, _, _ in told) == [workspaces.DEPENDENCY, workspaces.OWNERSHIP, workspaces.OWNERSHIP, workspaces.OWNERSHIP]


@pytest.mark.parametrize(("name", "fits"), [("a", True), ("@s/a.b_c-1", True), ("", False), ("A", False), ("@s", False), ("@s/a/b", False), ("a/b", False), (".a", False), ("a" * 214, True), ("a" * 215, False), ("a\n", False), ("é", False)])
def test_package_names(name, fits):
    assert workspaces.valid_name(name) is fits


@pytest.mark.parametrize(("pattern", "fits"), [("a/*", True), ("**/b", True), ("a*b", True), ("", False), ("/a", False), ("a/", False), ("a//b", False), ("../a", False), ("a**", False), ("{a,b}", False), ("a\\b", False)])
def test_workspace_patterns(pattern, fits):
    assert workspaces.valid_pattern(pattern) is fits


def test_workspace_faults_block_what_is_below(spark, tree):
    a = audit(spark, tree({"x/pnpm-workspace.yaml": "odd: 1\n", "x/a.ts": "export const a = 1", "x/p/package.json": '{"name":"p","private":true}', "x/p/b.ts": "export const b = 1", "y.ts": "export const y = 1"}))
    assert names(a) == ["y"] and reasons(a) == [workspaces.OWNERSHIP]


def test_lanes_choose_their_conditions(spark, tree):
    exports = '{".":{"types":"./t.d.ts","node":"./n.ts","require":"./r.ts","import":"./i.ts"},"./sub":{"require":"./r.ts","import":"./i.ts"},"./in/*":"./in/*.ts","./in/no/*":null}'
    root = tree({
        "package.json": '{"private":true,"workspaces":["*"]}', "lib/package.json": '{"name":"lib","private":true,"main":"./m","exports":%s}' % exports,
        "lib/n.ts": "export const x = 'n'", "lib/r.ts": "export const x = 'r'", "lib/i.ts": "export const x = 'i'", "lib/m/index.ts": "export const x = 'm'", "lib/in/no/a.ts": "export const x = 0",
        "app/package.json": '{"name":"app","private":true}', "app/m.ts": "import {x} from 'lib'; import {x as y} from 'lib/sub'; import {x as z} from 'lib/in/no/a'",
    })
    target = lambda a: sorted(r.path for r in a.resolved.where("outcome = 'internal'").join(a.sources, a.resolved.target == a.sources.source_id).select("path").collect())
    closed = lambda a: [r.specifier for r in a.resolved.where("outcome = 'unresolved'").collect()]
    bundler, legacy, node = (audit(spark, root, profile=p) for p in ("bundler", "node", "node16"))
    assert (target(bundler), closed(bundler)) == (["lib/i.ts", "lib/i.ts"], ["lib/in/no/a"])
    assert target(node) == ["lib/n.ts", "lib/r.ts"]
    assert target(legacy) == ["lib/m/index.ts"] and sorted(closed(legacy)) == ["lib/in/no/a", "lib/sub"]


def test_patterns_of_a_public_package_open_what_they_fit(spark, tree):
    root = tree({
        "package.json": '{"name":"pub","exports":{"./*":"./src/*.js","./hidden/*":null}}',
        "src/a.ts": "export const a = 1", "src/hidden/b.ts": "export const b = 1", "other/c.ts": "export const c = 1", "src/in/package.json": '{"private":true}', "src/in/d.ts": "export const d = 1",
    })
    a = audit(spark, root)
    assert names(a) == ["b", "c"] and reasons(a) == []


@pytest.mark.parametrize(("options", "complete"), [('"moduleResolution":"node10","module":"CommonJS"', True), ('"moduleResolution":"node16","module":"esnext"', False), ('"module":"ESNext"', True), ('"module":"commonjs"', False), ('"moduleResolution":"classic"', False)])
def test_module_setting_must_go_with_the_resolution(options, complete):
    config = Config({"tsconfig.json": ('{"compilerOptions":{%s}}' % options).encode()})
    assert (config.limitations == []) is complete and config.configs[0][3] is not complete


def test_scan_configuration(spark, tree):
    text = '{"schemaVersion":"evigraph-config.v1","entries":["a.ts"],"scan":{"include":["in/**"],"exclude":["in/no/**"],"roles":[{"pattern":"in/g/**","role":"generated"}]}}'
    root = tree({"evigraph.json": text, "in/a.ts": "export const a = 1", "in/no/b.ts": "export const b = 1", "in/g/c.ts": "export const c = 1", "d.ts": "export const d = 1"})
    kinds = lambda a: {r.exported_name: r.disposition.kind for r in a.findings.collect()}
    assert kinds(audit(spark, root)) == {"a": "actionable", "c": "review-only"}
    assert kinds(audit(spark, root, include=["in/g/**", "in/no/**"], roles=[("in/g/**", "authored")])) == {"c": "actionable"}


@pytest.mark.parametrize("text", ["{}", "[]", '{"schemaVersion":"v0"}', '{"schemaVersion":"evigraph-config.v1","odd":1}', '{"schemaVersion":"evigraph-config.v1","entries":["../a"]}', '{"schemaVersion":"evigraph-config.v1","scan":{"roles":[{"pattern":"a","role":"x"}]}}', '{"schemaVersion":"evigraph-config.v1","scan":{"roles":[{"role":"test"}]}}'])
def test_scan_configuration_is_strict(text):
    with pytest.raises(documents.DocumentError):
        settings.parse(text.encode())


def test_encoded_export_target_blocks_its_package(spark, tree):
    a = audit(spark, tree({"package.json": '{"name":"x","exports":"./a%2Fb.ts"}', "a.ts": "export const a=1"}))
    assert names(a) == [] and reasons(a) == ["public-surface-unsupported"]


def test_components_use_their_imports(spark, tree):
    root = tree({
        "main.ts": "import App from './App.vue'", "App.vue": "<template><user-card/><p>don't</p></template>\n<script setup lang=\"ts\">\nimport UserCard from './UserCard.vue'\nimport {used} from './lib'\n</script>\n<style>@import './x.css';</style>",
        "UserCard.vue": "<script src='./ext.ts'></script>", "ext.ts": "export default {}", "lib.ts": "export const used = 1, dead = 1",
    })
    a = audit(spark, root)
    assert (names(a), reasons(a)) == (["dead"], [])
    b = audit(spark, tree({"odd.svelte": "<p/>"}))
    assert names(b) == [] and reasons(b) == ["sfc-dialect-unavailable"]


def test_template_tags_need_one_binding(spark, tree):
    page = lambda body, script: f"<template>{body}</template><script setup>{script}</script>"
    root = tree({
        "package.json": '{"private":true}', "p/package.json": '{"private":true}', "q/package.json": '{"private":true}', "lib.ts": "export const dead = 1", "p/lib.ts": "export const hidden = 1", "q/lib.ts": "export const shown = 1",
        "p/A.vue": page("<my-card/><transition/>", ""), "q/B.vue": "<template><my-card/></template><script src='./b.ts'></script>", "q/b.ts": "import MyCard from './C.vue'", "q/C.vue": "<template><p/></template>",
    })
    a = audit(spark, root)
    assert (names(a), reasons(a)) == (["dead", "shown"], ["vue-template-opaque"])
    assert [r.detail for r in a.limitations.collect()] == ["template component my-card has no binding in a script"]
    two = "<template><a-b/><component :is='x'/><n.S/></template><script>import AB from './C.vue'</script><script setup>import {x as AB} from './C.vue'; import * as n from './C.vue'</script>"
    b = audit(spark, tree({"p/A.vue": two, "p/C.vue": "<template><p/></template>"}))
    assert sorted(r.detail for r in b.limitations.where("reason = 'vue-template-opaque'").collect()) == ["template component a-b has several bindings in scripts", "template component component is bound at run time or below a namespace", "template component n.S is bound at run time or below a namespace"]


def test_spans_count_bytes():
    text = "const é = '漢';\nexport const b = 1; import {c} from './d'"
    got = module_facts(text.encode(), "ts")
    data = text.encode()
    assert data[got.exports[0].start : got.exports[0].end].decode().startswith(("b", "export", "const"))
    page = f"<!-- é --><template><p>漢</p><my-card/></template><script>{text}</script>".encode()
    facts = sfc.component_facts(page)
    assert [page[t.start : t.end] for t in facts.tags] == [b"<my-card/>"]
    assert page[facts.uses[0].start : facts.uses[0].end] == data[got.uses[0].start : got.uses[0].end]


def test_walk_honours_ignore_files_and_links(tree, tmp_path):
    root = tree({".gitignore": "*.log\n/out/\n!keep.log\n", "a.log": "", "keep.log": "", "out/x.ts": "", "src/out/y.ts": "", "node_modules/z.ts": "", "src/.gitignore": "y.ts\n", ".hidden.ts": ""})
    (tmp_path / "in.ts").symlink_to(tmp_path / ".hidden.ts")
    (tmp_path / "bad.ts").symlink_to("/etc/hostname")
    got = dict(walk(root))
    assert {p for p, e in got.items() if e is None} == {".gitignore", "keep.log", "src/.gitignore", ".hidden.ts", "in.ts"}
    assert got["bad.ts"]
    assert IgnoreRules("a/**/b\n").verdict("a/x/y/b", False) and IgnoreRules("a/**/b\n").verdict("a/b", False) and IgnoreRules("x[!a].ts").verdict("xb.ts", False)


@pytest.mark.parametrize("data", [b'{"a":1,"a":2}', b'{"a":NaN}', b"{", b"\xff"])
def test_json_is_strict(data):
    with pytest.raises(documents.DocumentError):
        documents.parse_json(data)


def test_jsonc_and_yaml():
    assert documents.parse_jsonc(b'\xef\xbb\xbf{"a": "// no", /* c */ "b": [1,], }') == {"a": "// no", "b": [1]}
    assert documents.parse_yaml(b"packages:\n  - 'a/*'\n  - \"!b\"\nx: {y: z}\n") == {"packages": ["a/*", "!b"], "x": {"y": "z"}}
    for bad in (b"a: 1\na: 2\n", b"a: &x 1\nb: *x\n", b"--- 1\n--- 2\n", b"? [1]\n: 2\n", b"a: !!int 1\n"):
        with pytest.raises(documents.DocumentError):
            documents.parse_yaml(bad)


@pytest.mark.parametrize(
    ("text", "kind", "exports", "uses"),
    [
        ("export enum E {A}", "ts", [("E", "type"), ("E", "value")], []),
        ("export const {a, b: [c = 1, ...d], ...e} = x, f = /}/", "js", [(n, "value") for n in "acdef"], []),
        ("export default interface I {}", "ts", [("default", "type")], []),
        ("export {x as default, type T} from './m'", "ts", [("T", "type"), ("default", "value")], ["./m", "./m"]),
        ("const s = `${`${import('a')}`} ${require('b')}`; import type D from 'c'", "ts", [], ["a", "b", "c"]),
        ("a.import('x'); b.require('y'); const o = {import: 1, export: 2}", "js", [], []),
        ("export const a = 1\nexport function f() {}\nlet q = 4 / 2 / 1\nexport class K extends B {}", "ts", [("K", "value"), ("a", "value"), ("f", "value")], []),
    ],
)
def test_module_facts(text, kind, exports, uses):
    got = module_facts(text.encode(), kind)
    assert not got.unknown
    assert sorted((e.name, e.namespace) for e in got.exports) == sorted(exports) and sorted(u.specifier for u in got.uses) == uses


@pytest.mark.parametrize("text", ["import(x)", "require(x + 'y')", "import.meta.glob('./*')", "export * from './a'", "export = 1", "export namespace N {}", "import x = require('y')", "const a = 'open", "f(", "/* open"])
def test_unplaced_syntax_is_unknown(text):
    assert module_facts(text.encode(), "ts").unknown


def test_component_tags_and_styles():
    assert sfc.component_tags("<div><my-card/><Other/><ns.Part/><component :is='x'/><!-- <No/> --></div>") == (["MyCard", "Other", "ns"], True)
    assert sfc.style_references("/* url(./no) */ @import './a.css'; b {background: url(../c.png) url(https://x)}") == ["../c.png", "./a.css"]
    assert sfc.component_facts(b"<template><p>").unknown and sfc.component_facts(b"<script>import(x)</script>").unknown
