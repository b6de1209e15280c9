"""Repository paths as component arrays, and the string rules of module specifiers."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql.column import Column


def components(path: Column) -> Column:
    """Components of a slash-separated path; the root is the empty array."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def display(parts: Column) -> Column:
    return F.array_join(parts, "/")


def parent(parts: Column) -> Column:
    """The path without its last component; the root has none (null)."""
    return F.when(F.size(parts) > 0, F.slice(parts, 1, F.size(parts) - 1))


def ancestors(parts: Column, itself: bool = True) -> Column:
    """Every ancestor from the root on, each as a component array."""
    last = F.size(parts) - (0 if itself else 1)
    empty = F.array().cast("array<array<string>>")
    return F.when(last < 0, empty).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.slice(parts, 1, i)))


def contains(outer: Column, inner: Column) -> Column:
    """Whether outer is inner or one of its ancestors, by whole components."""
    return F.slice(inner, 1, F.greatest(F.size(outer), F.lit(0))) == outer


def canonical(parts: Column) -> Column:
    """Byte order of paths: component count first, then each component framed by its length; shallow paths come first."""
    u32 = lambda n: F.lpad(F.hex(n.cast("long")), 8, "0")
    one = lambda x: F.concat(u32(F.octet_length(x)), F.hex(x.cast("binary")))
    return F.unhex(F.concat(u32(F.size(parts)), F.array_join(F.transform(parts, one), "")))


def resolve_relative(directory: Column, specifier: Column) -> Column:
    """The components that a ./ or ../ specifier names from a directory; above the root: null."""
    start = F.struct(directory.alias("at"), F.lit(True).alias("ok"))

    def step(state: Column, part: Column) -> Column:
        up = F.struct(F.slice(state["at"], 1, F.greatest(F.size(state["at"]) - 1, F.lit(0))).alias("at"), (state["ok"] & (F.size(state["at"]) > 0)).alias("ok"))
        stay, down = state, F.struct(F.concat(state["at"], F.array(part)).alias("at"), state["ok"].alias("ok"))
        return F.when((part == "") | (part == "."), stay).when(part == "..", up).otherwise(down)

    return F.aggregate(F.split(specifier, "/"), start, step, lambda s: F.when(s["ok"], s["at"]))


def package_name(specifier: Column) -> Column:
    """The package a bare specifier names: two components with a scope, else one; null for relative and absolute ones."""
    parts = F.split(specifier, "/")
    scoped = F.when((F.size(parts) > 1) & (F.length(parts[0]) > 1) & (parts[1] != ""), F.concat(parts[0], F.lit("/"), parts[1]))
    return F.when(specifier.rlike(r"^(\.{1,2}(/|$)|/|#|$)"), None).when(specifier.startswith("@"), scoped).otherwise(parts[0])


#: The form of a package's name, and its longest length.
PACKAGE_NAME, PACKAGE_LENGTH = r"(?:@[a-z0-9][a-z0-9._-]*/)?[a-z0-9][a-z0-9._-]*", 214


def valid_package(name: Column) -> Column:
    """Whether a text is the name of a package: one segment, or a scope and one; null for null."""
    return name.rlike(rf"\A{PACKAGE_NAME}\z") & (F.length(name) <= PACKAGE_LENGTH)


#: What a request is tried as, in order, by its extension; the second list is for type-only uses.
SUBSTITUTES = {
    ".js": (("ts", "tsx", "js", "jsx"), ("ts", "tsx", "d.ts", "js", "jsx")),
    ".jsx": (("tsx", "jsx"), ("tsx", "d.ts", "jsx")),
    ".mjs": (("mts", "mjs"), ("mts", "d.mts", "mjs")),
    ".cjs": (("cts", "cjs"), ("cts", "d.cts", "cjs")),
}


def candidate_paths(path: Column, types: Column, bare: Column) -> Column:
    """Ordered candidates of a requested path. bare: whether a missing extension may be filled in. No index file is tried."""
    out = F.array(path)
    name = F.element_at(F.split(path, "/"), -1)
    for suffix, (values, kinds) in SUBSTITUTES.items():
        stem = F.substring(path, F.lit(1), F.length(path) - F.lit(len(suffix)))
        made = lambda names, stem=stem: F.array(*(F.concat(stem, F.lit(f".{n}")) for n in names))
        out = F.when(path.endswith(suffix), F.when(types, made(kinds)).otherwise(made(values))).otherwise(out)
    values, kinds = SUBSTITUTES[".js"]
    filled = lambda names: F.array(*(F.concat(path, F.lit(f".{n}")) for n in names))
    return F.when(~name.contains("."), F.when(bare, F.when(types, filled(kinds)).otherwise(filled(values))).otherwise(F.array(path))).otherwise(out)


def requested_as(path: Column) -> Column:
    """The paths that candidate_paths turns into this one, itself first: those with a longer ending are its type."""
    out = [path]
    for suffix, lists in SUBSTITUTES.items():
        for ending in sorted({x for names in lists for x in names} - {suffix[1:]}):
            stem = F.substring(path, F.lit(1), F.length(path) - F.lit(len(ending) + 1))
            out.append(F.when(path.endswith(f".{ending}"), F.concat(stem, F.lit(suffix))))
            if suffix == ".js":
                out.append(F.when(path.endswith(f".{ending}"), stem))
    return F.array_distinct(F.filter(F.array(*out), lambda x: x.isNotNull()))


def glob_regex(pattern: str) -> str:
    """An anchored expression for a component pattern: * stays in a component, ** spans any number of whole ones."""
    out: list[str] = []
    parts = [p for p in pattern.split("/") if p]
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out.append(".*" if last else "(?:[^/]+/)*")
        else:
            out.append("[^/]*".join(map(re.escape, part.split("*"))) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def star_capture(text: Column, pattern: Column) -> Column:
    """What the first star of a pattern stands for in a text that fits; null if it does not fit or there is no star."""
    at = F.instr(pattern, "*")
    left, right = F.substring(pattern, F.lit(1), at - 1), F.substring(pattern, at + 1, F.length(pattern))
    fits = (at > 0) & text.startswith(left) & text.endswith(right) & (F.length(text) >= F.length(left) + F.length(right))
    return F.when(fits, F.substring(text, F.length(left) + 1, F.length(text) - F.length(left) - F.length(right)))


def star_replace(pattern: Column, captured: Column) -> Column:
    """The pattern with its first star replaced."""
    at = F.instr(pattern, "*")
    return F.when(at > 0, F.concat(F.substring(pattern, F.lit(1), at - 1), captured, F.substring(pattern, at + 1, F.length(pattern)))).otherwise(pattern)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units, by which export patterns are ranked."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def identity_specifier(specifier: Column) -> Column:
    """A relative specifier without its .js ending, so that both spellings are one identity."""
    return F.when(specifier.rlike(r"^\.{1,2}/"), F.regexp_replace(specifier, r"\.js$", "")).otherwise(specifier)
