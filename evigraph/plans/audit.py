"""Repository audit: scan, module facts, resolution, fan-in, and findings of exports that no production source uses.

Uncertainty is data: what cannot be read or resolved becomes a limitation row with the scope it blocks, and no finding is
made inside a blocked scope.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from posixpath import normpath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..functions import hashing, paths
from ..operators import fanin, gates, identity, integrity, lookup, paging, reduce
from ..sources import documents, settings
from ..sources.modules import module_facts
from ..sources.sfc import component_facts
from ..sources.state import ensure_checkpoint_dir
from ..sources.tree import scan
from . import workspaces

RULE = "dead-export"
#: The version of what an analysis makes of its inputs: one of another version is not read in its place.
CONTRACT = "audit.v1"
#: What of a scanned file an analysis depends on.
READ = ("path", "kind", "is_config", "test_like", "generated", "vendored", "declaration", "payload_sha256", "physical_id", "error")
#: Dialects without a parser here, and option names that the resolver reads or may ignore.
NO_PARSER = ("svelte", "astro")
READ_OPTIONS = ("baseUrl", "paths", "moduleResolution", "module")
IGNORED_OPTIONS = frozenset("""target lib strict jsx jsxImportSource esModuleInterop skipLibCheck allowJs checkJs noEmit declaration declarationMap sourceMap
outDir rootDir isolatedModules resolveJsonModule forceConsistentCasingInFileNames types typeRoots noUnusedLocals noUnusedParameters
noImplicitAny noImplicitReturns noFallthroughCasesInSwitch strictNullChecks composite incremental tsBuildInfoFile useDefineForClassFields
allowSyntheticDefaultImports verbatimModuleSyntax allowImportingTsExtensions emitDeclarationOnly importHelpers removeComments
experimentalDecorators emitDecoratorMetadata downlevelIteration noEmitOnError noUncheckedIndexedAccess exactOptionalPropertyTypes
noImplicitOverride noPropertyAccessFromIndexSignature inlineSources inlineSourceMap newLine moduleDetection""".split())  # fmt: skip
NODE_PROFILES = ("node16", "nodenext")
#: The module settings that go with a resolution profile.
MODULES = {"node": ("commonjs",), "bundler": ("preserve", "es2015", "es2020", "es2022", "esnext"), "node16": ("node16",), "nodenext": ("nodenext",)}
#: Conditions of package exports by the lane that a request takes, beside default and, for types, types. The
#: legacy lane does not read exports.
CONDITIONS = {"bundler": ("import",), "import": ("node", "import"), "require": ("node", "require")}
LEGACY = "legacy"
#: Manifest fields in the order they are tried, by lane; a lane that is not here tries main alone.
VALUE_FIELDS = {"bundler": ("module", "main")}
TYPE_FIELDS = ("typings", "types")

#: Characters of a configuration table that may be broadcast.
SMALL = 8_000_000

_EXPORT = "struct<name:string,local:string,namespace:string,start:bigint,end:bigint>"
_USE = "struct<specifier:string,imported:string,local:string,namespace:string,kind:string,request:string,start:bigint,end:bigint>"
_TAG = "struct<tag:string,binding:string,kind:string,start:bigint,end:bigint>"
_FACTS = f"source_id string, exports array<{_EXPORT}>, uses array<{_USE}>, unknown array<string>, tags array<{_TAG}>"


@dataclass(frozen=True)
class Evidence:
    """What of an analysis is kept; links are (source, target) paths of the requests between sources."""

    sources: DataFrame
    links: DataFrame
    limitations: DataFrame
    findings: DataFrame
    inputs: DataFrame

    def gaps(self) -> DataFrame:
        """Limitations that leave required evidence out. One that lists what an unresolved request may have meant is bounded: it
        is compared from run to run like a finding, and only advises."""
        return self.limitations.where(~bounded())

    def state(self) -> str:
        return "complete" if self.limitations.isEmpty() else "incomplete"


@dataclass(frozen=True)
class Audit(Evidence):
    resolved: DataFrame
    exports: DataFrame

    def summary(self) -> DataFrame:
        n = self.limitations.agg(F.count("*").alias("n_limitations"), F.when(F.count("*") == 0, "complete").otherwise("incomplete").alias("state"))
        one = self.findings.agg(F.count("*").alias("n_findings"), F.count_if(F.col("disposition.kind") == "review-only").alias("n_review_only"))
        return one.join(n, F.lit(True))  # one row each


def bounded() -> Column:
    """Whether a row of limitations is an unresolved request with a list of what it may have meant."""
    return (F.col("reason") == "internal-specifier-unresolved") & (F.size("candidates") > 0)


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    export = pa.struct([("name", pa.string()), ("local", pa.string()), ("namespace", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    use = pa.struct([(k, pa.string()) for k in ("specifier", "imported", "local", "namespace", "kind", "request")] + [("start", pa.int64()), ("end", pa.int64())])
    tag = pa.struct([(k, pa.string()) for k in ("tag", "binding", "kind")] + [("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        found = []
        for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found.append(component_facts(data) if kind == "vue" else module_facts(data, kind))
        rows = lambda xs: [vars(x) for x in xs]
        columns = [batch.column(0), pa.array([rows(f.exports) for f in found], pa.list_(export)), pa.array([rows(f.uses) for f in found], pa.list_(use)), pa.array([f.unknown for f in found], pa.list_(pa.string())), pa.array([rows(f.tags) for f in found], pa.list_(tag))]
        yield pa.RecordBatch.from_arrays(columns, names=["source_id", "exports", "uses", "unknown", "tags"])


class Config:
    """What manifests and compiler configurations say, as short lists for small tables. Only configuration files come here."""

    def __init__(self, files: dict[str, bytes], override: str | None = None):
        self.documents = {p: documents.parse(p, b) for p, b in files.items()}
        self.profile = override
        self.limitations: list[tuple[str, str, str]] = []  # reason, path, detail
        self.packages: list[tuple[list[str], str | None, bool, bool, list[str] | None]] = []
        self.surfaces: list[tuple[list[str], str, str | None, str, str, int]] = []
        self.mappings: list[tuple[list[str], str, int, list[str]]] = []
        self.configs: list[tuple[list[str], str | None, str, bool]] = []
        self.missing: set[str] = set()
        for path, doc in sorted(self.documents.items()):
            name, root = path.rpartition("/")[2], [x for x in path.rpartition("/")[0].split("/") if x]
            if name == "package.json":
                self._package(path, root, doc)
            elif name == "tsconfig.json" or (name == "jsconfig.json" and path.replace("jsconfig", "tsconfig") not in self.documents):
                self._compiler(path, root, override)
        self._workspaces()

    def _workspaces(self) -> None:
        """Gives every package its workspace, and takes a name from all packages of a workspace that share it."""
        owner, told = workspaces.owners(self.documents, [tuple(p[0]) for p in self.packages])
        self.limitations += told
        twice = workspaces.repeated([(tuple(p[0]), p[1]) for p in self.packages if p[1]], owner)
        for root, name, *_ in self.packages:
            if tuple(root) in twice:
                self.limitations.append(("package-identity-unsupported", "/".join([*root, "package.json"]), name))
        place = lambda root: None if (w := owner.get(tuple(root))) is None else list(w)
        self.packages = [(root, None if tuple(root) in twice else name, private, esm, place(root)) for root, name, private, esm, _ in self.packages]

    def _package(self, path: str, root: list[str], doc: object) -> None:
        if not isinstance(doc, dict) or not isinstance(doc.get("name", ""), str):
            self.limitations.append(("package-metadata-unobservable", path, "manifest is no object or its name no string"))
            return
        name = doc.get("name")
        if name is not None and not workspaces.valid_name(name):
            self.limitations.append(("package-identity-unsupported", path, f"{name} is no package name"))
            name = None
        self.packages.append((root, name, doc.get("private") is True, doc.get("type") == "module", None))
        base = "/".join(root)
        place = lambda target: target and normpath(f"{base}/{target}").lstrip("/")
        try:
            for lane in (*CONDITIONS, LEGACY):
                for ns in ("value", "type"):
                    if lane != LEGACY and "exports" in doc:
                        self.surfaces += [(root, key, place(target), ns, lane, 0) for key, target in self._exports(doc["exports"], ns, lane)]
                        continue
                    targets = self._fields(doc, ns, lane)
                    self.surfaces += [(root, ".", place(target), ns, lane, order) for order, target in enumerate(targets)]
        except documents.DocumentError as e:
            self.limitations.append(("public-surface-unsupported", path, str(e)))

    @staticmethod
    def _fields(doc: dict, ns: str, lane: str) -> list[str]:
        """What a package without exports is asked for, in order: the fields that name a file, then its index. Where a file
        may be named without extension, a folder stands for its index. A type is looked for beside the value."""
        fields = [*(TYPE_FIELDS if ns == "type" else ()), *VALUE_FIELDS.get(lane, ("main",))]
        out = []
        for field in fields:
            if field not in doc:
                continue
            if not isinstance(doc[field], str) or not doc[field]:
                raise documents.DocumentError(f"{field} must be a string that is not empty")
            out.append(doc[field])
            if lane != "import" and "." not in doc[field].rpartition("/")[2].removesuffix(".").removeprefix("."):
                out.append(f"{doc[field]}/index.js")
        return out if lane == "import" else [*out, "index.js"]

    def _exports(self, value: object, ns: str, lane: str) -> list[tuple[str, str | None]]:
        """(key, target) by the conditions that a lane sees; the first active condition wins. A null target closes its key to
        patterns that would fit as well."""
        active = {"default", *CONDITIONS[lane]} | ({"types"} if ns == "type" else set())

        def pick(x: object) -> str | None:
            if x is None or isinstance(x, str):
                return x
            if isinstance(x, list):
                return next((y for y in map(pick, x) if y is not None), None)
            if isinstance(x, dict):
                return next((pick(y) for k, y in x.items() if k in active), None)
            raise documents.DocumentError("exports has a target that is no string")

        keyed = isinstance(value, dict) and value and all(k.startswith(".") for k in value)
        found = [(k, pick(v)) for k, v in value.items()] if keyed else [(".", pick(value))]
        for _, target in found:
            if target is not None and (not target.startswith("./") or any(x in ("", ".", "..", "node_modules") or "%2f" in x.lower() or "%5c" in x.lower() for x in target[2:].split("/"))):
                raise documents.DocumentError(f"exports target {target} is not safe")
        return found

    def _compiler(self, path: str, root: list[str], override: str | None) -> None:
        options: dict = {}
        seen: list[str] = []
        blocked = False

        def load(p: str) -> None:
            nonlocal blocked
            doc = self.documents.get(p)
            if p not in self.documents:
                self.missing.add(p)
            if p in seen or not isinstance(doc, dict):
                blocked = True
                self.limitations.append(("tsconfig-payload-unavailable", path, f"{p} is missing, no object, or extends itself"))
                return
            seen.append(p)
            parents = doc.get("extends", [])
            for parent in [parents] if isinstance(parents, str) else parents:
                if not parent.startswith((".", "/")):
                    blocked = True
                    self.limitations.append(("tsconfig-semantics-unsupported", path, f"extends package {parent}"))
                    continue
                target = normpath(f"{p.rpartition('/')[0]}/{parent}").lstrip("/")
                load(target if target in self.documents else f"{target}.json")
            here = p.rpartition("/")[0]
            for key, value in (doc.get("compilerOptions") or {}).items():
                if key not in READ_OPTIONS and key not in IGNORED_OPTIONS:
                    blocked = True
                    self.limitations.append(("tsconfig-semantics-unsupported", path, f"unknown option {key}"))
                options[key] = (here, value)

        load(path)
        profile = override or {"node10": "node"}.get(p := str(options.get("moduleResolution", ("", "bundler"))[1]).lower(), p)
        module = options.get("module")
        if profile not in MODULES or (module is not None and str(module[1]).lower() not in MODULES[profile]):
            blocked = True
            self.limitations.append(("tsconfig-semantics-unsupported", path, f"module {module and module[1]} with resolution {profile}"))
        base = options.get("baseUrl")
        base_url = normpath(f"{base[0]}/{base[1]}").lstrip("/").removeprefix(".") if base else None
        self.configs.append((root, base_url, profile, blocked))
        here, mapping = options.get("paths", ("", {}))
        for order, (pattern, targets) in enumerate(mapping.items()):
            self.mappings.append((root, pattern, order, [normpath(f"{base_url if base_url is not None else here}/{t}").lstrip("/") for t in targets]))


def small(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of configuration, to be broadcast only if it is at most SMALL characters."""
    made = spark.createDataFrame(rows, schema)
    return F.broadcast(made) if sum(len(str(r)) for r in rows) <= SMALL else made


def surfaces_of(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return small(spark, rows, "p_root array<string>, key string, target string, ns string, lane string, ord int")


def surface_candidates(rows: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Adds in_package, the ordered candidates of rows(p_root, ns, lane, request): the targets of the most specific key, each
    tried as its lane allows. A key that is closed has none."""
    group = ["p_root", "ns", "lane"]
    rows = lookup.most_specific_key(rows, "request", surfaces.select(*group, "key").distinct(), "key", group)
    targets = surfaces.groupBy(*group, "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "target"))), lambda x: x["target"]).alias("s_targets"))
    rows = rows.join(targets, [*group, "key"], "left")
    captured = F.coalesce(paths.star_capture(F.col("request"), F.col("key")), F.lit(""))
    tried = lambda t: paths.candidate_paths(paths.star_replace(t, captured), F.col("ns") == "type", F.col("lane") != "import")
    return rows.withColumn("in_package", F.filter(F.flatten(F.transform("s_targets", tried)), lambda x: x.isNotNull()))


def public_requests(spark: SparkSession, config: Config, sources: DataFrame) -> DataFrame:
    """(p_root, ns, lane, request) that anyone may ask a public package for. A key with a star stands for what it makes of the
    sources below the package's root, each compared with the patterns of packages around it only."""
    open_roots = {tuple(p[0]) for p in config.packages if p[1] and not p[2]}
    public = [x for x in config.surfaces if tuple(x[0]) in open_roots]
    keys = surfaces_of(spark, public)
    made = F.col("key").contains("*") & F.coalesce(F.col("target").contains("*"), F.lit(False))
    plain = keys.where(~made).select("p_root", "ns", "lane", F.col("key").alias("request"))
    if not any("*" in x[1] and "*" in (x[2] or "") for x in public):
        return plain.distinct()
    roots = small(spark, [(list(r),) for r in sorted(open_roots)], "p_root array<string>")
    inside = sources.select("path", F.explode(paths.ancestors(F.col("parts"))).alias("p_root")).join(roots, "p_root")
    met = inside.select("p_root", F.explode(paths.requested_as(F.col("path"))).alias("_asked")).join(keys.where(made), "p_root")
    met = met.withColumn("_star", paths.star_capture(F.col("_asked"), F.col("target"))).where("_star is not null")
    return plain.union(met.select("p_root", "ns", "lane", paths.star_replace(F.col("key"), F.col("_star")))).distinct()


def resolve(spark: SparkSession, uses: DataFrame, sources: DataFrame, config: Config) -> DataFrame:
    """Adds kind (internal, unresolved, external, unsupported, asset), target, candidates and reason to each use."""
    table = lambda rows, schema: small(spark, rows, schema)
    configs = table(config.configs, "c_root array<string>, base_url string, profile string, blocked boolean")
    packages = table(config.packages, "p_root array<string>, p_name string, private boolean, esm boolean, w_root array<string>")
    own = sources.select("source_id", "path", "parts", "kind")
    own = lookup.nearest_ancestor(own, "parts", configs, "c_root").withColumnRenamed("owner", "c_root").join(configs, "c_root", "left")
    own = lookup.nearest_ancestor(own, "parts", packages, "p_root").withColumnRenamed("owner", "p_root")
    own = own.join(packages.select("p_root", "esm", "w_root"), "p_root", "left")
    own = own.withColumn("esm", F.col("kind").isin("mts", "mjs") | (F.coalesce("esm", F.lit(False)) & ~F.col("kind").isin("cts", "cjs"))).checkpoint()
    profile = F.lit(config.profile) if config.profile else F.coalesce("profile", F.lit("bundler"))
    strict = profile.isin(*NODE_PROFILES) & F.col("esm")
    rows = uses.join(own.select("source_id", "parts", "c_root", "base_url", "blocked", (~strict).alias("bare"), profile.alias("profile"), "esm", "w_root"), "source_id")
    by_request = F.when(F.col("request_kind") == "dynamic-import", "import").when(F.col("request_kind") == "require", "require").when(F.col("esm"), "import").otherwise("require")
    rows = rows.withColumn("lane", F.when(F.col("profile") == "node", LEGACY).when(F.col("profile").isin(*NODE_PROFILES), by_request).otherwise("bundler"))
    rows = rows.withColumn("types", F.col("namespace") == "type")
    spec = F.col("specifier")
    relative = spec.rlike(r"^\.{1,2}/")
    base = paths.display(paths.resolve_relative(paths.parent(F.col("parts")), spec))
    tried = lambda p: paths.candidate_paths(p, F.col("types"), F.col("bare"))
    # a mapping that fits is final, so its candidates stand alone
    mapped = table(config.mappings, "c_root array<string>, pattern string, ord int, targets array<string>")
    rows = lookup.longest_pattern_of(rows.withColumn("_asked", F.when(~relative, spec)), "_asked", mapped, "pattern", "ord", ["c_root"])
    known = mapped.select("c_root", F.col("pattern").alias("key"), F.col("ord").alias("order"), "targets")
    rows = rows.join(known, ["c_root", "key", "order"], "left").withColumn("m", F.when(F.col("key").isNotNull(), F.struct(F.col("key").alias("pattern"), "targets")))
    rows = rows.drop("key", "order", "captured", "targets", "_asked").checkpoint()
    replaced = F.transform("m.targets", lambda t: paths.star_replace(t, F.coalesce(paths.star_capture(spec, F.col("m.pattern")), F.lit(""))))
    from_mapping = F.flatten(F.transform(replaced, tried))
    # a package of the importer's workspace by its name, then the most specific key of its surface
    name = paths.package_name(spec)
    known = packages.where("p_name is not null and w_root is not null").select("p_root", F.col("p_name").alias("n"), F.col("w_root").alias("n_root"))
    rows = rows.join(known, (name == F.col("n")) & (F.col("w_root") == F.col("n_root")), "left")
    rest = F.concat(F.lit("."), F.substring(spec, F.length("n") + 1, F.length(spec)))
    rows = rows.withColumns({"request": F.when(F.col("n").isNotNull(), rest), "ns": F.col("namespace")}).checkpoint()
    rows = surface_candidates(rows, surfaces_of(spark, config.surfaces))
    none = F.array().cast("array<string>")
    from_base = F.when(F.col("base_url").isNotNull(), tried(F.when(F.col("base_url") == "", spec).otherwise(F.concat("base_url", F.lit("/"), spec))))
    bare_list = F.when(F.col("m").isNotNull(), from_mapping).otherwise(F.concat(F.coalesce(from_base, none), F.coalesce("in_package", none)))
    rows = rows.withColumn("candidates", F.when(relative, F.when(base.isNotNull(), tried(base)).otherwise(none)).otherwise(F.coalesce(bare_list, none))).checkpoint()
    found = lookup.first_candidate(rows, "use_id", "candidates", sources.select("path", "source_id"), "path", "source_id")
    last = F.element_at(F.split(spec, "/"), -1)
    suffix = F.regexp_extract(last, r"(\.[A-Za-z0-9]+)$", 1)
    asset = (suffix != "") & ~suffix.isin(".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".mts", ".cts", ".vue", ".svelte", ".astro")
    needs_ext = relative & ~F.col("bare") & ~last.contains(".")
    reason = (
        F.when(F.coalesce("blocked", F.lit(False)), "the importer's configuration is incomplete")
        .when(spec.startswith("/") | spec.startswith("\\"), "root-absolute specifier")
        .when(spec.startswith("#"), "package imports")
        .when(relative & base.isNull(), "relative specifier leaves the root")
        .when(needs_ext, "a relative specifier needs its extension here")
    )
    kind = (
        F.when(reason.isNotNull(), "unsupported")
        .when(F.col("target").isNotNull(), "internal")
        .when(relative & asset, "asset")
        .when(relative | F.col("m").isNotNull() | F.col("n").isNotNull(), "unresolved")
        .otherwise("external")
    )
    return found.select("use_id", "source_id", "specifier", "imported", "local", "namespace", F.col("use_kind"), "request_kind", "start", "end", kind.alias("outcome"), F.when(reason.isNull(), F.col("target")).alias("target"), "candidates", reason.alias("reason"))


def blocked_scope(limitations: DataFrame, sources: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """(paths without findings, rows that block the whole workspace) of limitations(reason, path, candidates).

    A limitation of a package blocks the sources whose nearest package is its own, one of a manifest that cannot be read or of
    a workspace all below it; one whose owner is unknown blocks all.
    """
    spark = sources.sparkSession
    listed = limitations.where("reason = 'internal-specifier-unresolved'").select(F.explode("candidates").alias("path"))
    owned = ("public-surface-unsupported", "package-imports-unsupported", "tsconfig-semantics-unsupported", "tsconfig-payload-unavailable", "sfc-external-script-unresolved", "vue-template-opaque")
    roots = spark.createDataFrame([(p[0],) for p in config.packages], "r array<string>")
    local = limitations.where(F.col("reason").isin(*owned)).select("path", paths.components(F.col("path")).alias("l_parts"))
    local = lookup.nearest_ancestor(local, "l_parts", roots, "r").withColumnRenamed("owner", "l_owner")
    owners = lookup.nearest_ancestor(sources.select("path", "parts"), "parts", roots, "r")
    inside = owners.join(local.where("l_owner is not null").select(F.col("l_owner").alias("owner")).distinct(), "owner", "left_semi").select("path")
    below = limitations.where(F.col("reason").isin("package-metadata-unobservable", workspaces.OWNERSHIP, workspaces.DEPENDENCY)).select(paths.parent(paths.components(F.col("path"))).alias("_a")).distinct()
    under = sources.select("path", F.explode(paths.ancestors(F.col("parts"))).alias("_a")).join(below, "_a", "left_semi").select("path")
    everywhere = limitations.where(F.col("reason").isin("js-module-use-unknown", "source-payload-unavailable", "package-identity-unsupported", "sfc-dialect-unavailable")).select("reason")
    return listed.union(inside).union(under).distinct(), everywhere.union(local.where("l_owner is null").select(F.lit("unknown owner")))


def unbound_tags(tags: DataFrame, uses: DataFrame, resolved: DataFrame) -> DataFrame:
    """(source_id, detail) of the template tags(source_id, tag, binding, kind) that do not stand for exactly one binding of
    the component's scripts, one in another file included. What such a tag uses cannot be told."""
    bound = uses.where("namespace = 'value' and local is not null").select("source_id", F.col("local").alias("binding"))
    scripts = resolved.where("outcome = 'internal' and use_kind = 'namespace' and request_kind = 'static-import' and local is null").select(F.col("source_id").alias("component"), "target")
    inside = scripts.join(bound, F.col("target") == F.col("source_id")).select(F.col("component").alias("source_id"), "binding")
    known = bound.union(inside).join(tags.select("source_id").distinct(), "source_id", "left_semi").withColumn("one", F.lit(1))
    asked = gates.bind_one(tags.where("kind = 'static'").select("source_id", "tag", "binding").distinct().withColumnRenamed("binding", "wanted"), known.withColumnRenamed("binding", "wanted"), ["source_id", "wanted"], "one")
    why = F.concat(F.lit("template component "), "tag", F.when(F.col("outcome") == "none", " has no binding in a script").otherwise(" has several bindings in scripts"))
    loose = tags.where("kind <> 'static'").select("source_id", F.concat(F.lit("template component "), "tag", F.lit(" is bound at run time or below a namespace")).alias("detail"))
    return asked.where("outcome <> 'bound'").select("source_id", why.alias("detail")).union(loose).distinct()


@dataclass(frozen=True)
class Capture:
    """What an analysis reads, at one moment: scanned files, what configuration files say, and what the scan was asked for."""

    scanned: DataFrame
    config: Config
    asked: list

    def key(self) -> str:
        """One value for all that the analysis depends on: two captures with the same key have the same result."""
        files = identity.set_identity(self.scanned, READ, distinct=False).first()["identity"]
        return hashlib.sha256(json.dumps([CONTRACT, self.asked, files]).encode()).hexdigest()


def capture(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), roles: Sequence[tuple[str, str]] = (), profile: str | None = None) -> Capture:
    """Reads a repository. The sources are read once and kept in the checkpoint folder.

    The scan's configuration at the root applies: includes given here replace its own, excludes add to it, and role rules
    given here come after its rules. One that cannot be read is an error, as a scan of other files would be a wrong answer.
    """
    ensure_checkpoint_dir(spark)
    asked = settings.read(root).merged(include, exclude, roles)
    scanned = scan(spark, root, *asked).checkpoint()
    files = {r.path: bytes(r.bytes) for r in scanned.where("is_config and error is null").select("path", "bytes").toLocalIterator()}
    return Capture(scanned, Config(files, profile), [*asked, profile])


def audit(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), roles: Sequence[tuple[str, str]] = (), profile: str | None = None) -> Audit:
    """Audits a repository; see capture() for what is read."""
    return analyse(capture(spark, root, include, exclude, roles, profile))


def analyse(seen: Capture) -> Audit:
    """The analysis of what was read. Every step is kept in the checkpoint folder: a plan of all of them would be analysed again
    at every join."""
    spark, scanned, config = seen.scanned.sparkSession, seen.scanned, seen.config
    sources = scanned.where("kind is not null and error is null")
    places = sources.drop("bytes")
    parsed = sources.where(~F.col("kind").isin(*NO_PARSER)).select("source_id", "kind", "bytes").mapInArrow(_parse, _FACTS).checkpoint()
    exports = parsed.select("source_id", F.explode("exports").alias("e")).select("source_id", "e.*")
    exports = reduce.first_wins(exports, ["source_id", "namespace", "name"], ["start", "end"])
    exports = exports.checkpoint()
    uses = parsed.select("source_id", F.posexplode("uses").alias("at", "u")).select("source_id", "at", "u.*")
    uses = uses.withColumn("use_id", F.concat("source_id", F.lit("#"), "at")).withColumnsRenamed({"kind": "use_kind", "request": "request_kind"}).drop("at")
    resolved = resolve(spark, uses, places, config).checkpoint()

    row = lambda df, reason, path, detail, candidates=None: df.select(F.lit(reason).alias("reason"), F.col(path).alias("path"), detail.alias("detail"), (candidates if candidates is not None else F.array().cast("array<string>")).alias("candidates"))
    unknown = parsed.select("source_id", F.explode("unknown").alias("why")).join(places.select("source_id", "path"), "source_id")
    tags = parsed.select("source_id", F.explode("tags").alias("t")).select("source_id", "t.*")
    loose = unbound_tags(tags, uses, resolved).join(places.select("source_id", "path"), "source_id")
    bad = resolved.where("outcome = 'unsupported'").join(places.select("source_id", "path"), "source_id")
    told = spark.createDataFrame(config.limitations, "r string, path string, d string")
    limitations = (
        row(unknown, "js-module-use-unknown", "path", F.col("why"))
        .union(row(scanned.where("error is not null"), "source-payload-unavailable", "path", F.col("error")))
        .union(row(sources.where(F.col("kind").isin(*NO_PARSER)), "sfc-dialect-unavailable", "path", F.col("kind")))
        .union(row(loose, "vue-template-opaque", "path", F.col("detail")))
        .union(row(bad.where("reason = 'package imports'"), "package-imports-unsupported", "path", F.col("specifier")))
        .union(row(bad.where("reason not in ('package imports') and reason not like '%configuration%'"), "js-module-use-unknown", "path", F.col("reason")))
        .union(row(resolved.where("outcome = 'unresolved'").join(places.select("source_id", "path"), "source_id"), "internal-specifier-unresolved", "path", F.col("specifier"), F.col("candidates")))
        .union(told.select(F.col("r").alias("reason"), "path", F.col("d").alias("detail"), F.array().cast("array<string>").alias("candidates")))
        .distinct()
        .checkpoint()
    )

    tests = places.select(F.col("source_id").alias("importer"), F.col("test_like").alias("is_test"))
    internal = resolved.where("outcome = 'internal'").join(tests, F.col("source_id") == F.col("importer"))
    key = [F.col("target").alias("source_id"), "namespace"]
    exact = internal.where(F.col("use_kind").isin("named", "default", "reexport-named")).select(*key, F.col("imported").alias("name"), "is_test")
    broad = internal.where(F.col("use_kind").isin("namespace", "dynamic-broad")).select(*key, "is_test")
    public = surface_candidates(public_requests(spark, config, places), surfaces_of(spark, config.surfaces))
    public = public.select("ns", F.concat_ws("#", F.to_json("p_root"), "ns", "lane", "request").alias("use_id"), F.col("in_package").alias("candidates"))
    surface = lookup.first_candidate(public, "use_id", "candidates", places, "path", "source_id").where("target is not null").select(F.col("target").alias("source_id"), F.col("ns").alias("namespace")).distinct()
    counted = fanin.fan_in(exports, ["source_id", "namespace", "name"], exact, broad, ["source_id", "namespace"], surface, ["source_id", "namespace"])
    counted = counted.join(places.select("source_id", "path", "parts", "generated", "vendored", "declaration"), "source_id").checkpoint()
    idle = fanin.unused(counted, F.col("declaration"))
    some, everywhere = blocked_scope(limitations, places, config)
    idle = integrity.outside_scope(idle, some, ["path"], everywhere)
    asked_by = F.when(F.col("test_uses") > 0, "only tests ask for `").otherwise("nothing asks for `")
    claim = F.concat(asked_by, F.col("name"), F.lit("`"))
    findings = idle.select(
        hashing.content_identity(F.lit(RULE), F.col("source_id"), F.col("namespace"), F.col("name"), prefix="fnd-").alias("finding_id"),
        F.lit(RULE).alias("rule_id"), F.lit("warning").alias("severity"), F.lit("grounded").alias("confidence"),
        fanin.disposition(F.col("generated"), F.col("vendored")).alias("disposition"), claim.alias("claim"),
        "source_id", "path", "start", "end", F.col("name").alias("exported_name"), "namespace", paths.canonical(F.col("parts")).alias("path_key"),
    )
    read = F.when(F.col("error").isNull(), identity.PRESENT).when(F.col("error").contains("link"), identity.NON_REGULAR).otherwise(identity.UNREADABLE)
    asked = scanned.where("is_config").select("path", read.alias("state"), "payload_sha256", "physical_id", F.col("error").alias("detail"))
    absent = spark.createDataFrame([(p, identity.MISSING, None, None, None) for p in sorted(config.missing)], asked.schema)
    inputs = identity.semantic_inputs(places, asked.union(absent))
    named = lambda key, as_: places.select(F.col("source_id").alias(key), F.col("path").alias(as_))
    links = resolved.where("outcome = 'internal'").select("source_id", "target").distinct().join(named("source_id", "source"), "source_id").join(named("target", "to"), "target").select("source", F.col("to").alias("target"))
    return Audit(places, links, limitations, findings, inputs, resolved, counted)


#: Severities and confidences from the least on.
SEVERITIES, CONFIDENCES = ("warning",), ("grounded",)
#: Findings order: the most severe and the surest first, then rule, path, span and id.
FINDINGS_ORDER = [("severity_rank", False), ("confidence_rank", False), ("rule_id", True), ("path_key", True), ("start", True), ("end", True), ("finding_id", True)]


def findings_page(findings: DataFrame, run: str, cursor: str | None = None, size: int = paging.PAGE) -> paging.Page:
    """A page of a run's findings; the cursor only opens the run it came from."""
    rank = lambda column, values: F.array_position(F.array(*map(F.lit, values)), F.col(column)).cast("int")
    ordered = findings.withColumns({"path_key": F.hex("path_key"), "severity_rank": rank("severity", SEVERITIES), "confidence_rank": rank("confidence", CONFIDENCES)})
    return paging.page(ordered, FINDINGS_ORDER, paging.Scope(run, "findings.v1"), cursor, size)
