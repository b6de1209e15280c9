"""Workspaces of a repository: which package belongs to which, by the lists and manifests that were read.

Input and output are as many as there are manifests; nothing here grows with the sources.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from ..functions import paths
from ..sources.documents import DocumentError

#: The file that lists a workspace, and its fields that change how packages depend on each other.
LIST_FILE = "pnpm-workspace.yaml"
DEPENDENCY_FIELDS = ("catalog", "catalogs", "packageConfigs")
OWNERSHIP, DEPENDENCY = "workspace-ownership-unsupported", "pnpm-dependency-semantics-unsupported"

Root = tuple[str, ...]


def valid_name(name: str) -> bool:
    """One segment, or a scope and one, each of lower-case letters, digits, dots, underscores and hyphens."""
    return len(name) <= paths.PACKAGE_LENGTH and re.fullmatch(paths.PACKAGE_NAME, name) is not None


def valid_pattern(pattern: str) -> bool:
    """Components of literals and stars; two stars only as a whole component."""
    if re.search(r"[\\?\[\]{}()]", pattern):
        return False
    return all(x not in ("", ".", "..") and ("**" not in x or x == "**") for x in pattern.split("/"))


def patterns(value: object, negation: bool) -> tuple[list[str], list[str]]:
    """(included, excluded) of a list of patterns. negation: whether a leading ! excludes; otherwise it is an error."""
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise DocumentError("workspace patterns must be a list of strings")
    kept: tuple[list[str], list[str]] = ([], [])
    for raw in value:
        out = negation and raw.startswith("!")
        if not valid_pattern(raw[out:]) or raw[out:].startswith("!"):
            raise DocumentError(f"workspace pattern {raw} is not read")
        kept[out].append(raw[out:])
    return kept


def folder(path: str) -> Root:
    return tuple(x for x in path.split("/")[:-1] if x)


def _matching(globs: Iterable[str], base: Root, roots: Iterable[Root]) -> set[Root]:
    expressions = [re.compile(paths.glob_regex(g)) for g in globs]
    inside = (r for r in roots if len(r) > len(base) and r[: len(base)] == base)
    return {r for r in inside if any(e.match("/".join(r[len(base) :])) for e in expressions)}


def owners(documents: dict[str, object], packages: Iterable[Root]) -> tuple[dict[Root, Root], list[tuple[str, str, str]]]:
    """(workspace root of every package that is in one, limitations(reason, path, detail)).

    A list file replaces the manifest beside it as the source of a workspace, even where it lists nothing. The root is always
    a member. Of several workspaces a package belongs to the deepest.
    """
    roots, told = list(packages), []
    members: dict[Root, set[Root]] = {}
    for path, doc in sorted(documents.items()):
        if path.rpartition("/")[2] != LIST_FILE:
            continue
        base = folder(path)
        members[base] = {base}
        for field, value in (doc if isinstance(doc, dict) else {}).items():
            if field in DEPENDENCY_FIELDS:
                told.append((DEPENDENCY, path, f"{field} is not read"))
            elif field != "packages":
                told.append((OWNERSHIP, path, f"unknown field {field}"))
            else:
                try:
                    included, excluded = patterns(value, True)
                    members[base] |= _matching(included, base, roots) - _matching(excluded, base, roots)
                except DocumentError as e:
                    told.append((OWNERSHIP, path, str(e)))
    for path, doc in sorted(documents.items()):
        base = folder(path)
        if path.rpartition("/")[2] != "package.json" or base in members or not isinstance(doc, dict) or "workspaces" not in doc:
            continue
        members[base] = {base}
        value = doc["workspaces"]
        try:
            included, _ = patterns(value.get("packages") if isinstance(value, dict) else value, False)
            members[base] |= _matching(included, base, roots)
        except DocumentError as e:
            told.append((OWNERSHIP, path, str(e)))
    found = {r: max((w for w, own in members.items() if r in own), key=len, default=None) for r in roots}
    return {r: w for r, w in found.items() if w is not None}, told


def repeated(names: Iterable[tuple[Root, str]], owner: dict[Root, Root]) -> set[Root]:
    """Roots whose name another package of the same workspace has: none of them is meant by it."""
    first: dict[tuple[Root, str], list[Root]] = {}
    for root, name in names:
        if root in owner:
            first.setdefault((owner[root], name), []).append(root)
    return {r for roots in first.values() if len(roots) > 1 for r in roots}
