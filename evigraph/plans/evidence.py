"""Analyses that a run store keeps, read again where nothing that they depend on has changed.

What an analysis depends on has one key: every scanned file with its role, digest and place, and what the scan was asked for.
A run is kept under that key, so an unchanged repository is read and hashed but neither parsed nor resolved again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .audit import Evidence, analyse, capture
from .runs import RunStore

#: Columns of the sources that are kept.
SOURCE = ("source_id", "path", "parts", "payload_sha256", "physical_id")


def gather(store: RunStore, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), roles: Sequence[tuple[str, str]] = (), profile: str | None = None) -> tuple[Evidence, str, str | None]:
    """The evidence of a repository as it is now, its key, and the run that it was read from; None if it was analysed anew.

    A kept run whose files are not what was published is an error. One that retention removes meanwhile makes later reads fail,
    and the operation may be asked for again."""
    seen = capture(store.spark, root, include, exclude, roles, profile)
    key = seen.key()
    run = store.with_inputs(key)
    if run is None:
        return analyse(seen), key, None
    read = lambda name: store.read(run, name)
    return Evidence(read("sources"), read("links"), read("limitations"), read("findings"), read("inputs")), key, run


def publish(store: RunStore, found: Evidence, key: str, more: dict[str, DataFrame] | None = None) -> str:
    """Keeps evidence, and tables that belong to it, as a run."""
    tables = {"inputs": found.inputs, "sources": found.sources.select(*SOURCE), "links": found.links, "findings": found.findings, "limitations": found.limitations}
    return store.publish(tables | (more or {}), found.state(), key)


def audited(store: RunStore, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), roles: Sequence[tuple[str, str]] = (), profile: str | None = None) -> str:
    """The run of a repository's audit: one that the store keeps if nothing has changed since, else a new one."""
    found, key, run = gather(store, root, include, exclude, roles, profile)
    return run or publish(store, found, key)
