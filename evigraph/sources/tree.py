"""Repository scan: a driver-side walk decides which paths come in, tasks read and classify them.

The walk honours ignore files, never follows links out of the root and never enters pruned directories. Only paths go
through the driver; bytes are read where the rows are. Every path that cannot be read becomes a row with its reason.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, paths
from ..operators import integrity

#: Directories that are never entered, and files read as configuration.
PRUNED = (".git", "node_modules", ".evigraph")
CONFIG_FILES = re.compile(r"^(package\.json|pnpm-workspace\.yaml|tsconfig(\.[\w-]+)?\.json|jsconfig\.json)$")


class IgnoreRules:
    """The rules of one ignore file, for paths relative to its directory; the last rule that fits decides."""

    def __init__(self, text: str):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in text.splitlines():
            line = re.sub(r"(?<!\\)\s+$", "", line)
            if not line or line.startswith("#"):
                continue
            keep, line = line.startswith("!"), line.removeprefix("!")
            directory, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            body = self._regex(line.lstrip("/"))
            self.rules.append((re.compile(("^" if anchored else "^(?:.*/)?") + body + "$"), keep, directory))

    @staticmethod
    def _regex(pattern: str) -> str:
        out, k = "", 0
        while k < len(pattern):
            if pattern.startswith("**/", k):
                out, k = out + "(?:.*/)?", k + 3
            elif pattern.startswith("/**", k) and k + 3 == len(pattern):
                out, k = out + "/.*", k + 3
            elif pattern[k] == "*":
                out, k = out + "[^/]*", k + 1
            elif pattern[k] == "?":
                out, k = out + "[^/]", k + 1
            elif pattern[k] == "[" and (end := pattern.find("]", k + 1)) > 0:
                out, k = out + "[" + pattern[k + 1 : end].replace("!", "^", 1) + "]", end + 1
            else:
                k += pattern[k] == "\\" and k + 1 < len(pattern)
                out, k = out + re.escape(pattern[k]), k + 1
        return out

    def verdict(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored, False: kept by a negated rule, None: no rule fits."""
        found = None
        for regex, keep, directory in self.rules:
            if (is_dir or not directory) and regex.match(path):
                found = not keep
        return found


def walk(root: str) -> Iterator[tuple[str, str | None]]:
    """(path, error) of every file below root that ignore files let in, sorted by directory; a link that leaves the root or
    leads nowhere comes with an error."""
    top = Path(root).resolve(strict=True)

    def visit(directory: Path, rules: list[tuple[str, IgnoreRules]]) -> Iterator[tuple[str, str | None]]:
        at = directory.relative_to(top).as_posix().removeprefix(".")
        try:
            names = sorted(os.listdir(directory))
        except OSError as e:
            yield at, f"directory cannot be read: {e.strerror}"
            return
        if ".gitignore" in names:
            try:
                rules = [*rules, (at, IgnoreRules((directory / ".gitignore").read_text(errors="replace")))]
            except OSError as e:
                yield f"{at}/.gitignore".lstrip("/"), f"ignore file cannot be read: {e.strerror}"
        for name in names:
            entry = directory / name
            path = f"{at}/{name}".lstrip("/")
            link = entry.is_symlink()
            is_dir = entry.is_dir() and not link
            if name in PRUNED and (is_dir or link):
                continue
            ignored = False
            for base, own in rules:
                verdict = own.verdict(path[len(base) :].lstrip("/"), is_dir)
                ignored = ignored if verdict is None else verdict
            if ignored:
                continue
            if is_dir:
                yield from visit(entry, rules)
            elif link:
                target = entry.resolve()
                if not target.exists() or not target.is_relative_to(top):
                    yield path, "link leads out of the root or nowhere"
                elif target.is_file():
                    yield path, None
            elif entry.is_file():
                yield path, None

    yield from visit(top, [])


def root_identity(root: str) -> dict:
    """The root by its canonical path and by what it is on disk: another folder put in its place has another identity."""
    path = Path(root).resolve(strict=True)
    if not path.is_dir():
        raise NotADirectoryError(root)
    found = path.stat()
    return {"path": path.as_posix(), "physical": f"{found.st_dev}:{found.st_ino}"}


def _reader(root: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data, physical = None, None
                if error is None:
                    try:
                        full = os.path.join(root, path)
                        with open(full, "rb") as f:
                            data = f.read()
                            stat = os.fstat(f.fileno())
                        physical = f"{stat.st_dev}:{stat.st_ino}"
                    except OSError as e:
                        error = f"cannot be read: {e.strerror}"
                sha = hashlib.sha256(data).hexdigest() if data is not None else None
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((path, pa.string()), (error, pa.string()), (sha, pa.string()), (physical, pa.string()), (data, pa.binary()))], names=["path", "error", "payload_sha256", "physical_id", "bytes"])

    return run


def scan(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), roles: Sequence[tuple[str, str]] = (), partitions: int | None = None) -> DataFrame:
    """One row for each admitted source or configuration file, and for each path with an error.

    roles are (glob, role) rules, the last that fits wins: test, generated and vendored set a role, production and authored
    clear them. Columns: source_id, path, parts, kind, is_config, test_like, generated, vendored, declaration,
    payload_sha256, physical_id, bytes, error.
    """
    listed = [x for x in walk(root) if x[1] or CONFIG_FILES.match(x[0].rpartition("/")[2]) or any(x[0].endswith(e) for e, _ in integrity.SOURCE_KINDS)]
    schema = "path string, error string"
    found = spark.createDataFrame(listed, schema).repartition(partitions or max(1, min(len(listed), spark.sparkContext.defaultParallelism)))
    parts = paths.components(F.col("path"))
    found = found.where(integrity.admitted(parts, list(include), list(exclude)) | F.lit(not include and not exclude))
    read = found.mapInArrow(_reader(str(Path(root).resolve())), "path string, error string, payload_sha256 string, physical_id string, bytes binary")
    head = F.substring(F.decode("bytes", "ISO-8859-1"), 1, integrity.GENERATED_WITHIN)
    name = F.element_at(paths.components(F.col("path")), -1)
    rules = lambda role, clear: [(F.col("path").rlike(paths.glob_regex(g)), "yes" if r == role else "no") for g, r in roles if r in (role, clear)]
    set_by = lambda own, role, clear: F.coalesce(F.nullif(integrity.last_rule(rules(role, clear), "-"), F.lit("-")) == "yes", own)
    return read.select(
        hashing.content_identity(F.col("path"), prefix="src-").alias("source_id"),
        "path",
        parts.alias("parts"),
        integrity.source_kind(F.col("path")).alias("kind"),
        name.rlike(CONFIG_FILES.pattern).alias("is_config"),
        set_by(integrity.test_like(parts), "test", "production").alias("test_like"),
        set_by(F.coalesce(integrity.generated(head), F.lit(False)), "generated", "authored").alias("generated"),
        set_by(F.lit(False), "vendored", "authored").alias("vendored"),
        F.coalesce(integrity.source_kind(F.col("path")) == "declaration", F.lit(False)).alias("declaration"),
        "payload_sha256",
        "physical_id",
        "bytes",
        "error",
    )
