"""Secret scans: patterns find candidates, a random forest trained from labelled findings removes the false ones.

The forest sees a candidate's length, character transitions, dictionary coverage, whether it looks like a path, and the
words next to it. It is trained on the driver from a bounded list of findings and sent to the tasks as a few small arrays.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import bound_batches

#: The forms of candidates. Group "v" is the candidate. No form bounds a value's length: each run starts where
#: the one before has ended and is taken possessively, so that a text is read a fixed number of times.
PATTERNS = {
    # To the END line; a key that was cut off before it goes on over its headers to the next dash.
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?P<v>[^-]*+(?:-(?!----)[^-]*+)*+(?=-----END )|(?:\s*+[A-Za-z][A-Za-z0-9-]*+:[^\n]*+)*+[^-]*+)",
    "access_key": r"\b(?P<v>(?:AKIA|ASIA)[0-9A-Z]{16})\b",
    "prefixed": r"\b(?P<v>(?:gh[pousr]_|sk-|pk-|xox[abprs]-|glpat-)[A-Za-z0-9_-]{16,}+)",
    # What follows the run is looked at once, not from each "eyJ" in it.
    "signed": r"(?<![A-Za-z0-9_-])(?=[A-Za-z0-9_-]{11,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8})(?:[A-Za-z0-9_-]*?\b)??(?P<v>eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)",
    "assigned": r"(?i:password|passwd|pwd|secret|token|api_?key|access_?key|auth)[\"']?[ \t]*+(?:=|:)[ \t]*+[\"']?(?P<v>[^\s\"',;]{6,}+)",
    # In quotes a value may hold what ends it elsewhere.
    "quoted": r"(?i:password|passwd|pwd|secret|token|api_?key|access_?key|auth)[\"']?[ \t]*+(?:=|:)[ \t]*+(?P<q>[\"'])(?P<v>(?:(?!(?P=q))\S){6,}+)(?P=q)",
    "header": r"(?i:authorization)[\"']?[ \t]*+(?:=|:)[ \t]*+[\"']?(?i:bearer|basic|token)[ \t]++(?P<v>[^\s\"',;]{6,}+)",
    "url": r"://[^\s/:@\"']*+:(?P<v>[^\s/@\"']{3,}+)@",
    "hex": r"(?<![0-9A-Za-z])(?P<v>(?=[a-f]*+[0-9])[0-9a-f]{32,}+)(?![0-9A-Za-z])",
    "base64": r"(?<![0-9A-Za-z+/_-])(?P<v>(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{32,}+={0,2})(?![0-9A-Za-z+/_-])",
}
#: Words that real secrets do not spell, and words that stand next to secrets or to their stand-ins.
DICTIONARY = """
the and for with that this from have your user users name admin root test testing example sample demo dummy default change
changeme password passwd secret token key value string number config local host server client data file path home index main
class function return null none true false undefined public private system service version build debug release module object
input output login email account group world hello welcome letmein master qwerty monkey dragon summer winter spring autumn
monday sunday january december apple orange banana river mountain water table chair window house street city green blue black
white placeholder required optional replace insert here enter your_password mypassword environment variable import export
""".split()
NEAR_SECRET = ("password", "passwd", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "login", "private")
NEAR_STAND_IN = ("example", "sample", "dummy", "placeholder", "test", "demo", "checksum", "sha256", "sha1", "md5", "commit", "digest", "hash", "etag", "uuid", "revision", "integrity")
CONTEXT = 48
FEATURES = (
    "length entropy transitions digits uppers lowers others dictionary distinct longest_run path_like has_extension dots"
    " near_secret near_stand_in assigned quoted uuid_like hex_only prefix_form"
).split()

_KINDS = list(PATTERNS)
_ANY = [(k, re.compile(p)) for k, p in PATTERNS.items()]
#: A text that holds none of these has no candidate: the cheap test that most texts stop at.
_HINT = re.compile(r"-----BEGIN|AKIA|ASIA|gh[pousr]_|sk-|pk-|xox|glpat-|eyJ|(?i:passw|pwd|secret|token|api_?key|access_?key|auth)|[A-Za-z0-9+/_-]{32}|://[^\s/:@]*+:[^\s/@]++@")
_WORD = re.compile("|".join(sorted(map(re.escape, DICTIONARY), key=len, reverse=True)))


@dataclass(frozen=True)
class Finding:
    kind: str
    start: int
    end: int


def candidates(text: str) -> list[Finding]:
    """Candidates in order of place. Matches that overlap are one candidate over all of their span, of the kind that comes first
    in PATTERNS: what one form knows of a value is not left readable where another form goes on."""
    if not _HINT.search(text):
        return []
    found = [(*m.span("v"), rank) for rank, (kind, pattern) in enumerate(_ANY) if kind != "signed" or "eyJ" in text for m in pattern.finditer(text)]
    out: list[list[int]] = []
    for start, end, rank in sorted(x for x in found if x[1] > x[0]):
        if out and start < out[-1][1]:
            out[-1][1:] = max(end, out[-1][1]), min(rank, out[-1][2])
        else:
            out.append([start, end, rank])
    return [Finding(_KINDS[rank], start, end) for start, end, rank in out]


def _kind_of(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def describe(text: str, found: Finding) -> list[float]:
    """The features of a candidate in its text, in the order of FEATURES."""
    value = text[found.start : found.end]
    n = len(value)
    kinds = [_kind_of(c) for c in value]
    counts = Counter(value)
    before, after = text[max(0, found.start - CONTEXT) : found.start], text[found.end : found.end + CONTEXT]
    near = (before + " " + after).lower()
    run = longest = 1
    for a, b in zip(value, value[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    covered = sum(len(m[0]) for m in _WORD.finditer(value.lower()))
    return [
        float(n),
        -sum(k / n * math.log2(k / n) for k in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        kinds.count(0) / n,
        kinds.count(1) / n,
        kinds.count(2) / n,
        kinds.count(3) / n,
        covered / n,
        len(counts) / n,
        longest / n,
        float("/" in value or "\\" in value or before.endswith(("/", "\\"))),
        float(bool(re.search(r"\.[a-z]{2,4}$", value)) or bool(re.match(r"\.[a-z]{2,4}\b", after))),
        value.count(".") / n,
        float(any(w in near for w in NEAR_SECRET)),
        float(any(w in near for w in NEAR_STAND_IN)),
        float(before.rstrip(" \t\"'").endswith(("=", ":"))),
        float(before.endswith(('"', "'"))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}", value))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))),
        float(found.kind in ("private_key", "access_key", "prefixed", "signed")),
    ]


def labelled_findings(rows: int = 3000, seed: int = 7) -> list[tuple[str, Finding, int]]:
    """Findings with a label (1: a secret), made by rule: (text, finding, label). A user passes own findings instead."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexa, upper, mixed = "0123456789abcdef", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits
    filler = lambda: " ".join(pick(string.ascii_lowercase, r.randint(2, 9)) for _ in range(r.randint(0, 7)))
    word = lambda: r.choice(DICTIONARY)
    field = lambda: r.choice(["password", "secret", "token", "api_key", "auth", "pwd"])
    true = [
        lambda: ("AKIA" + pick(upper, 16), "{}"),
        lambda: (r.choice(["ghp_", "gho_", "sk-", "glpat-"]) + pick(mixed, r.randint(20, 40)), "{}"),
        lambda: (pick(hexa, r.choice([12, 16, 18, 24, 32, 40])), field() + "={}"),
        lambda: (pick(hexa, r.choice([32, 40, 64])), field() + ' = "{}"'),
        lambda: (pick(mixed + "!@#%^&*", r.randint(9, 24)), field() + r.choice(["=", ": ", " = "]) + "{}"),
        lambda: (pick(mixed + "+/", r.randint(36, 80)), field() + ' = "{}"'),
        lambda: ("eyJ" + pick(mixed, 30) + "." + pick(mixed, 60) + "." + pick(mixed, 43), "bearer {}"),
        lambda: (pick(mixed + "+/", 200), "-----BEGIN PRIVATE KEY-----{}"),
        lambda: (pick(mixed, r.randint(3, 5)) + r.choice(",;") + pick(mixed + "!%,;", r.randint(8, 16)), field() + r.choice([': "{}"', '="{}"'])),
        lambda: (pick(mixed + "!%", r.randint(8, 24)), "://" + word() + ":{}@" + word()),
        lambda: (pick(mixed + "+/", r.randint(16, 60)), "Authorization: " + r.choice(["Bearer", "Basic", "token"]) + " {}"),
    ]
    false = [
        lambda: ("AKIA" + r.choice(["IOSFODNN7EXAMPLE", "X" * 16, "EXAMPLEEXAMPLE12", "0" * 16]), r.choice(["example {}", "{}"])),
        lambda: (word() + r.choice(["", word(), "123", "_" + word()]) + word(), field() + r.choice(["=", ": "]) + "{}"),
        lambda: ("${" + word().upper() + "_" + word().upper() + "}", field() + "={}"),
        lambda: (r.choice("x*.-0") * r.randint(6, 40), field() + "={}"),
        lambda: (word() + "." + word() + "()", field() + " = {}"),
        lambda: ("/" + "/".join(word() for _ in range(3)) + "/" + word() + ".pem", field() + "={}"),
        lambda: (pick(hexa, r.choice([32, 40, 64])), r.choice(["sha256 {}", "commit {}", "md5 checksum {}", "etag {}", "integrity digest {}"])),
        lambda: ("-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), r.choice(["uuid {}", "revision {}"])),
        lambda: ("/".join(word() for _ in range(6)) + str(r.randint(0, 99)), "see {}"),
        lambda: ("-".join(word() for _ in range(8)) + str(r.randint(0, 99)), "{}"),
        lambda: (pick(string.ascii_lowercase, r.randint(6, 12)) + r.choice([".", "", ","]), field() + r.choice([": ", " : "]) + "{}"),
        lambda: (r.choice([word(), word() + word(), "${" + word().upper() + "}", "*" * r.randint(3, 8)]), "://" + word() + ":{}@" + word()),
        lambda: (r.choice(["<" + word() + ">", word() + "_" + word(), "$" + word().upper() + word().upper()]), "Authorization: Bearer {}"),
    ]
    out: list[tuple[str, Finding, int]] = []
    while len(out) < rows:
        label = len(out) % 2
        value, form = r.choice(true if label else false)()
        head, tail = form.split("{}")
        text = f"{filler()} {head}{value}{tail}{r.choice(['', chr(34)]) if chr(34) in head and not tail else ''} {filler()}".replace('""', '"')
        for f in candidates(text):
            if value.startswith(text[f.start : f.end][:6]) or text[f.start : f.end] in value:
                out.append((text, f, label))
                break
        else:
            start = text.index(value)
            out.append((text, Finding("assigned", start, start + len(value)), label))
    return out


class Forest:
    """A random forest of binary trees in flat arrays: feature (-1: leaf), limit, left, right, share of secrets."""

    def __init__(self, feature: np.ndarray, limit: np.ndarray, left: np.ndarray, right: np.ndarray, share: np.ndarray, roots: np.ndarray):
        self.feature, self.limit, self.left, self.right, self.share, self.roots = feature, limit, left, right, share, roots

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, leaf: int = 2, seed: int = 11) -> Forest:
        r = np.random.default_rng(seed)
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if level == depth or len(rows) < 2 * leaf or share in (0.0, 1.0):
                return at
            best = (1e-9, -1, 0.0)
            base = share * (1 - share)
            for f in r.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                values = x[rows, f]
                for limit in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 13), method="lower")):
                    low = values <= limit
                    k = int(low.sum())
                    if k < leaf or len(rows) - k < leaf:
                        continue
                    p, q = y[rows[low]].mean(), y[rows[~low]].mean()
                    gain = base - (k * p * (1 - p) + (len(rows) - k) * q * (1 - q)) / len(rows)
                    if gain > best[0]:
                        best = (float(gain), int(f), float(limit))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[at][:2] = best[1:]
                nodes[at][2] = grow(rows[low], level + 1)
                nodes[at][3] = grow(rows[~low], level + 1)
            return at

        roots = [grow(r.integers(0, len(x), len(x)), 0) for _ in range(trees)]
        a = np.array(nodes)
        return Forest(a[:, 0].astype(np.int32), a[:, 1], a[:, 2].astype(np.int32), a[:, 3].astype(np.int32), a[:, 4], np.array(roots))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                low = x[rows, np.maximum(f, 0)] <= self.limit[at]
                at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
            total += self.share[at]
        return total / len(self.roots)


def train(findings: list[tuple[str, Finding, int]] | None = None) -> Forest:
    findings = labelled_findings() if findings is None else findings
    x = np.array([describe(text, f) for text, f, _ in findings])
    return Forest.fit(x, np.array([label for _, _, label in findings], float))


def scan_text(text: str, forest: Forest) -> list[tuple[Finding, float]]:
    found = candidates(text)
    if not found:
        return []
    return list(zip(found, forest.predict(np.array([describe(text, f) for f in found])).tolist(), strict=True))


def redact_text(text: str, forest: Forest, threshold: float = 0.5, mark: str = "[SECRET]") -> str:
    """The text with every confirmed secret replaced; the same object if there is none."""
    for f, score in reversed(scan_text(text, forest)):
        if score >= threshold:
            text = text[: f.start] + mark + text[f.end :]
    return text


def _scan(model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kinds, starts, ends, scores = [], [], [], [], []
            for k, text in enumerate(batch.column(1)):
                text = text.as_py()
                for f, score in scan_text(text, model.value) if text else []:
                    at.append(k)
                    kinds.append(f.kind)
                    starts.append(f.start)
                    ends.append(f.end)
                    scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), pa.array(kinds, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(scores, pa.float64())],
                names=["doc_id", "kind", "start", "end", "score"],
            )

    return run


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """One row for each candidate in docs(doc_id, text): doc_id, kind, start and end in code points, score, is_secret.

    Documents without a candidate, null and empty texts have no row; repeated rows are scanned each for itself. Whole texts
    of any length are read, and candidates of any length are found, in time that follows the text. A null doc_id is kept.
    Other columns are not read. An empty table gives no row.
    """
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(forest or train())
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_scan(model), f"doc_id {kind}, kind string, start bigint, end bigint, score double")
    return found.withColumn("is_secret", F.col("score") >= threshold)


def _redact(model, text_at: int, chars_at: int | None) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(text_at)
            after = [None if not x.is_valid else redact_text(x.as_py(), model.value) for x in before]
            columns = list(batch.columns)
            columns[text_at] = pa.array(after, before.type)
            if chars_at is not None:
                old = columns[chars_at].to_pylist()
                new = [n if n is None or a is None or len(a) == len(b.as_py()) else len(a) for n, a, b in zip(old, after, before, strict=True)]
                columns[chars_at] = pa.array(new, columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def redact(docs: DataFrame, forest: Forest | None = None) -> DataFrame:
    """docs with confirmed secrets replaced in text and n_chars, where there is one, following; every row and column stays.

    Null and empty texts stay as they are, texts of any length are read whole, repeated rows are masked alike, columns of
    any other name are handed on, and a table without rows stays one.
    """
    bound_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(forest or train())
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None
    return docs.mapInArrow(_redact(model, docs.columns.index("text"), chars), docs.schema)
