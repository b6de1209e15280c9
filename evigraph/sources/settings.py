"""The scan's own configuration at the root of a repository."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from .documents import DocumentError, parse_json

NAME, VERSION = "evigraph.json", "evigraph-config.v1"
#: Roles that a rule may give; the last two take the others back.
ROLES = ("test", "generated", "vendored", "production", "authored")

Rules = Sequence[tuple[str, str]]


@dataclass(frozen=True)
class Settings:
    entries: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def merged(self, include: Sequence[str], exclude: Sequence[str], roles: Rules) -> tuple[list[str], list[str], list[tuple[str, str]]]:
        """What a call asks for, on top: its includes replace those here, excludes add up, its roles come after."""
        return list(include or self.include), [*exclude, *self.exclude], [*self.roles, *roles]


def _fields(value: object, where: str, known: Sequence[str]) -> dict:
    if not isinstance(value, dict):
        raise DocumentError(f"{where} must be an object")
    if odd := sorted(set(value) - set(known)):
        raise DocumentError(f"{where} has the unknown field {odd[0]}")
    return value


def _strings(value: object, where: str) -> tuple[str, ...]:
    if not isinstance(value, list) or not all(isinstance(x, str) for x in value):
        raise DocumentError(f"{where} must be a list of strings")
    return tuple(value)


def portable(path: str) -> bool:
    """Whether a path is relative, canonical and means the same on every system."""
    return "\\" not in path and "\0" not in path and all(x not in ("", ".", "..") for x in path.split("/"))


def parse(data: bytes) -> Settings:
    """Strict: an unknown field, another version, an odd role or a path that leaves the root is an error."""
    doc = _fields(parse_json(data), "the configuration", ("schemaVersion", "entries", "scan"))
    if doc.get("schemaVersion") != VERSION:
        raise DocumentError(f"schemaVersion must be {VERSION}")
    entries = _strings(doc.get("entries", []), "entries")
    if odd := [x for x in entries if not portable(x)]:
        raise DocumentError(f"entry {odd[0]!r} is no path below the root")
    scan = _fields(doc.get("scan", {}), "scan", ("include", "exclude", "roles"))
    if not isinstance(scan.get("roles", []), list):
        raise DocumentError("scan.roles must be a list")
    rules = [_fields(x, "a role", ("pattern", "role")) for x in scan.get("roles", [])]
    for rule in rules:
        if not isinstance(rule.get("pattern"), str) or rule.get("role") not in ROLES:
            raise DocumentError(f"a role needs a pattern and one of {', '.join(ROLES)}")
    return Settings(entries, _strings(scan.get("include", []), "scan.include"), _strings(scan.get("exclude", []), "scan.exclude"), tuple((r["pattern"], r["role"]) for r in rules))


def read(root: str) -> Settings:
    """The settings of a repository; the defaults where it has no such file."""
    try:
        return parse((Path(root) / NAME).read_bytes())
    except FileNotFoundError:
        return Settings()
