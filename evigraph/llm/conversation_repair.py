"""Repair of the turn structure of conversations at least cost.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles: an optional system turn, then user and assistant in
turns. Rows are kept, given another role, deleted or inserted; what that costs is a shortest path over (row, state of the
grammar). The cost to go is computed backwards over the rows; the forward walk then takes, among the edits that lie on a
cheapest path, the one whose initial comes first in ASCII (Delete, Insert, Keep, Rerole).

Rows are range-sorted by conversation and turn, so a conversation of any size is spread over as many tasks as its rows need.
A conversation that lies inside one task is finished there. One that meets a task's edge is a chain of segments: each gives
the costs between the states it is entered and left in, the few rows of these costs are composed by conversation, and every
segment is then walked on its own. Only the last step is sequential, as SHA-256 is: a conversation's repaired bytes are
streamed in order through one task, a piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column
from pyspark.sql.pandas.types import to_arrow_schema

from .runtime import bound_batches, materialize

#: What edits cost, and what a cut-off row adds while it stays.
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
#: States: nothing yet, behind a system, a user and an assistant turn. What a role may be put as next, and the state behind it.
PUT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
LEGAL = frozenset(("su", "ua", "au"))
INF = float("inf")
#: Costs behind the last row: nothing at all and a closed pair may end.
END = (0.0, 2.0 * INSERT, 1.0 * INSERT, 0.0)
#: Rows that a task holds of one conversation; of a longer one it passes them on as a segment.
HELD_ROWS, HELD_CHARS = 20_000, 4_000_000
PIECE_BYTES = 1 << 18

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECES = "array<struct<edit:string,role:string,text:string>>"
_STREAM = f"c string, part int, at long, turn long, role string, text string, fault string, md5 string, {_RESULT}, pieces {_PIECES}"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with faults planted by crc32(conv_id:turn) % 20: 0 drops the row (gone), 1 empties its
    text, 2 takes its sentence ends away, 3 repeats it, 4 makes its role user. A null in the key, the role or the text is one
    space. The conv_id of a dropped row stays known."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    role = F.when(kind == 4, "user").otherwise(some("role"))
    out = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), (kind == 0).alias("gone"), F.when(kind == 3, 2).otherwise(1).alias("n"))
    return out.select("conv_id", "turn", "role", "text", "gone", F.explode(F.sequence(F.lit(1), "n")).alias("n")).drop("n")


@lru_cache(100_000)
def _step(kind: int, after: tuple[float, ...]) -> tuple[float, tuple[float, ...], tuple[tuple[str, int], ...]]:
    """(offset, costs before a row, (edits, state) from each state) for costs behind it whose least is 0.

    kind is 0 for a row that must go, else 1 + 2 * place of the role's initial in "sua" (3: another) + whether it is cut off.
    """
    cut = CUT if kind and (kind - 1) % 2 else 0
    initial = "sua "[(kind - 1) // 2] if kind else ""
    options: list[dict[str, tuple[float, int]]] = []
    for s in range(4):
        mine = {"D": (DELETE + after[s], s)}
        if kind:
            if (s, initial) in KEEP:
                mine["K"] = (cut + after[KEEP[s, initial]], KEEP[s, initial])
            mine["R"] = (REROLE + cut + after[PUT[s][1]], PUT[s][1])
        options.append(mine)
    cost = [min(v for v, _ in mine.values()) for mine in options]
    for _ in range(3):
        cost = [min(cost[s], INSERT + cost[PUT[s][1]]) for s in range(4)]
    moves = []
    for s in range(4):
        edits, at = "", s
        while cost[at] < INF:
            mine = options[at] | {"I": (INSERT + cost[PUT[at][1]], PUT[at][1])}
            letter = min(x for x, (v, _) in mine.items() if v == cost[at])
            edits, at = edits + letter, mine[letter][1]
            if letter != "I":
                break
        moves.append((edits, at))
    least = min(cost)
    return (least, tuple(x - least for x in cost), tuple(moves)) if least < INF else (0.0, tuple(cost), tuple(moves))


def _backward(kinds: list[int], end: tuple[float, ...]) -> tuple[tuple[float, ...], list]:
    """(costs before the first row, the moves of every row from the last to the first)."""
    least = min(end)
    base, now, moves = least, tuple(x - least for x in end), []
    for kind in reversed(kinds):
        offset, now, move = _step(kind, now)
        base += offset
        moves.append(move)
    return tuple(x + base for x in now), moves


def _forward(moves: list, state: int) -> tuple[str, int]:
    edits = []
    for move in reversed(moves):
        more, state = move[state]
        edits.append(more)
    return "".join(edits), state


def _tail(state: int) -> str:
    """What is inserted behind the last row."""
    return {1: "II", 2: "I"}.get(state, "")


def _rebuild(edits: str, rows: Iterable[tuple[str, str]], state: int) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every turn that the edits leave or make, entered in a state."""
    rows = iter(rows)
    for edit in edits:
        role, text = ("", "") if edit == "I" else next(rows)
        if edit == "D":
            continue
        if edit in "IR":
            role, state = PUT[state]
        else:
            state = KEEP[state, role[:1]]
        yield edit, role, text


def _digest(turns: Iterable[tuple[str, str, str]]) -> str:
    return hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns).encode()).hexdigest()


@dataclass
class Run:
    """What is known of rows of one conversation in a row, without their texts."""

    kinds: list[int] = field(default_factory=list)
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    first: str | None = None
    last: str | None = None
    low: int | None = None
    high: int | None = None
    turns: int = 0

    def add(self, turn: int | None, role: str, fault: str) -> None:
        initial = role[:1]
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.kinds.append(0 if fault in ("blank", "duplicate") else 1 + 2 * ("sua".find(initial) % 4 if initial else 3) + (fault == "truncated"))

    def join(self, later: Run) -> None:
        """Takes the counts of the rows behind these in."""
        for name in ("blank", "duplicate", "truncated", "illegal", "turns"):
            setattr(self, name, getattr(self, name) + getattr(later, name))
        if self.last is not None and later.first is not None:
            self.illegal += self.last + later.first not in LEGAL
        self.turns -= self.high is not None and self.high == later.low
        self.first = later.first if self.first is None else self.first
        self.last = self.last if later.last is None else later.last
        self.low = later.low if self.low is None else self.low
        self.high = self.high if later.high is None else later.high

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns

    def counts(self, cost: float) -> tuple[int, ...]:
        return self.gaps(), self.blank, self.duplicate, self.truncated, self.illegal, int(cost)


class _Task:
    """One task's sorted rows: whole conversations become results, those at its edges or too long to hold stay rows."""

    def __init__(self, turns: bool):
        self.turns, self.out, self.number = turns, [], 0

    def begin(self, c: str | None) -> None:
        self.c, self.rows, self.seen, self.chars, self.at = c, [], set(), 0, 0
        self.open = self.number == 0  # the task's first conversation may have begun before it
        self.number += 1

    def row(self, part: int, turn: int | None, role: str, text: str, fault: str, md5: str) -> None:
        if fault != "gone" and fault != "blank":
            key = (role, md5)
            fault = "duplicate" if key in self.seen else fault
            self.seen.add(key)
        self.rows.append((self.c, part, self.at, turn, role, text, fault, md5))
        self.at += 1
        self.chars += len(text)
        self.open |= len(self.rows) > HELD_ROWS or self.chars > HELD_CHARS
        if self.open:
            self.flush()

    def flush(self) -> None:
        self.out += [(*x, *[None] * 9) for x in self.rows]
        self.rows, self.chars = [], 0

    def finish(self, last: bool) -> None:
        if self.open or last:
            return self.flush()
        rows = [x for x in self.rows if x[6] != "gone"]
        run = Run()
        for x in rows:
            run.add(x[3], x[4], x[6])
        costs, moves = _backward(run.kinds, END)
        edits, state = _forward(moves, 0)
        edits += _tail(state)
        turns = list(_rebuild(edits, ((x[4], x[5]) for x in rows), 0))
        pieces = [dict(zip(("edit", "role", "text"), x, strict=True)) for x in turns] if self.turns else None
        self.out.append((self.c, 0, None, None, None, None, None, None, *run.counts(costs[0]), edits, _digest(turns), pieces))


def _solve(turns: bool, schema: pa.Schema) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def emit(task: _Task) -> Iterator[pa.RecordBatch]:
        if task.out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*task.out, strict=True), schema, strict=True)], schema=schema)
            task.out = []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(turns)
        for batch in batches:
            for c, part, turn, role, text, fault, md5 in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if task.number == 0:
                    task.begin(c)
                elif c != task.c:
                    task.finish(False)
                    task.begin(c)
                task.row(part, turn, role, text, fault, md5)
            yield from emit(task)
        if task.number:
            task.finish(True)
            yield from emit(task)

    return run


def _run_of(rows: pd.DataFrame) -> tuple[pd.DataFrame, Run]:
    """A segment's rows in order, without those that are gone, and what is known of them."""
    rows = rows.sort_values("at")
    rows = rows[rows["fault"] != "gone"]
    run = Run()
    for turn, role, fault in zip(rows["turn"], rows["role"], rows["fault"], strict=True):
        run.add(None if pd.isna(turn) else int(turn), role, fault)
    return rows, run


_KNOWN = ("blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns")
_SEGMENT = "c string, part int, costs array<double>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long"


def _measure(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A segment's counts, and its least costs from each state to each other."""
    _, run = _run_of(rows)
    ways = [_backward(run.kinds, tuple(0.0 if t == u else INF for u in range(4)))[0] for t in range(4)]
    costs = [ways[t][s] for s in range(4) for t in range(4)]
    return pd.DataFrame([(*key, costs, *(getattr(run, k) for k in _KNOWN))], columns=["c", "part", "costs", *_KNOWN])


def _compose(key: tuple, segments: pd.DataFrame) -> pd.DataFrame:
    """The costs behind each segment of a conversation, and the conversation's counts, in all of its rows."""
    segments = segments.sort_values("part")
    ends, end = [], END
    for costs in segments["costs"][::-1]:
        ends.append(list(end))
        end = tuple(min(costs[4 * s + t] + end[t] for t in range(4)) for s in range(4))
    total = Run()
    for known in zip(*(segments[k] for k in _KNOWN), strict=True):
        total.join(Run([], *(None if pd.isna(x) else x if isinstance(x, str) else int(x) for x in known)))
    return pd.DataFrame([(*key, part, end_, *total.counts(end[0])) for part, end_ in zip(segments["part"], reversed(ends), strict=True)], columns=["c", "part", "end", *COUNTS])


def _walk(key: tuple, rows: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
    """A segment's edits and the state behind it, for each state it may be entered in."""
    _, run = _run_of(rows)
    _, moves = _backward(run.kinds, tuple(ends["end"].iloc[0]))
    ways = [_forward(moves, s) for s in range(4)]
    return pd.DataFrame([(*key, [e for e, _ in ways], [s for _, s in ways])], columns=["c", "part", "edits", "states"])


def _enter(key: tuple, segments: pd.DataFrame) -> pd.DataFrame:
    """The state that each segment of a conversation is entered in, and what is inserted behind it."""
    segments = segments.sort_values("part")
    found, state = [], 0
    for part, states in zip(segments["part"], segments["states"], strict=True):
        found.append([*key, part, state, ""])
        state = int(states[state])
    found[-1][-1] = _tail(state)
    return pd.DataFrame(found, columns=["c", "part", "enter", "tail"])


def _pieces(key: tuple, rows: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
    """The repaired turns of a segment, in pieces of bounded size."""
    rows = rows[rows["fault"] != "gone"].sort_values("at")
    turns = _rebuild(edits["audit"].iloc[0], zip(rows["role"], rows["text"], strict=True), int(edits["enter"].iloc[0]))
    out, held, size = [], [], 0
    for turn in turns:
        held.append(dict(zip(("edit", "role", "text"), turn, strict=True)))
        size += len(turn[2]) + len(turn[1])
        if size > PIECE_BYTES:
            out.append((*key, len(out), held))
            held, size = [], 0
    out += [(*key, len(out), held)] if held else []
    return pd.DataFrame(out, columns=["c", "part", "no", "pieces"])


def _hash_all(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(c, digest) of each conversation; its pieces come in order, one conversation after the other."""
    now, state, found = None, None, []
    for batch in batches:
        for c, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or c != now:
                if state is not None:
                    found.append((now, state.hexdigest()))
                now, state, first = c, hashlib.sha256(), True
            for turn in turns:
                state.update(("" if first else "\n").encode() + f"{turn['role']}:{turn['text']}".encode())
                first = False
    if state is not None:
        found.append((now, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.string()), pa.array([h for _, h in found], pa.string())], names=["c", "repaired_sha256"])


def _solve_segments(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, repaired turns in pieces) of the conversations that lie in several tasks.

    A row that is new in its segment is a duplicate if an earlier segment has it too: of each (conversation, role, text) the
    first segment is found, and only texts of several segments are joined back.
    """
    news = rows.where("fault not in ('gone', 'blank', 'duplicate')").select("c", "role", "md5", "part", "at")
    twice = news.groupBy("c", "role", "md5").agg(F.min("part").alias("p"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = news.join(twice, ["c", "role", "md5"]).where("part > p").select("c", "part", "at", F.lit(True).alias("again"))
    rows = rows.join(again, ["c", "part", "at"], "left").withColumn("fault", F.when(F.col("again"), "duplicate").otherwise(F.col("fault"))).drop("again")
    rows = materialize(rows.select("c", "part", "at", "turn", "role", "text", "fault"), "turns-open")
    light = rows.select("c", "part", "at", "turn", "role", "fault")
    costs = light.groupBy("c", "part").applyInPandas(_measure, _SEGMENT)
    ends = costs.groupBy("c").applyInPandas(_compose, "c string, part int, end array<double>, " + ", ".join(f"{k} long" for k in COUNTS))
    ends = materialize(ends, "turns-ends")
    walks = light.groupBy("c", "part").cogroup(ends.select("c", "part", "end").groupBy("c", "part"))
    walks = materialize(walks.applyInPandas(_walk, "c string, part int, edits array<string>, states array<int>"), "turns-walks")
    entered = walks.select("c", "part", "states").groupBy("c").applyInPandas(_enter, "c string, part int, enter int, tail string")
    audits = walks.join(entered, ["c", "part"]).select("c", "part", "enter", F.concat(F.get("edits", F.col("enter")), "tail").alias("audit"))
    audits = materialize(audits, "turns-audits")
    pieces = rows.select("c", "part", "at", "role", "text", "fault").groupBy("c", "part").cogroup(audits.groupBy("c", "part"))
    pieces = materialize(pieces.applyInPandas(_pieces, f"c string, part int, no int, pieces {_PIECES}"), "turns-pieces")
    hashed = pieces.repartition("c").sortWithinPartitions("c", "part", "no").select("c", "pieces").mapInArrow(_hash_all, "c string, repaired_sha256 string")
    whole = audits.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    counts = ends.groupBy("c").agg(*(F.min(k).alias(k) for k in COUNTS))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = counts.join(whole, "c").join(hashed, "c", "left").withColumn("repaired_sha256", F.coalesce("repaired_sha256", none))
    return out.select("c", *COUNTS, "audit", "repaired_sha256"), pieces


def _known(c: Column) -> Column:
    """A conversation's key as text that is never null."""
    return F.when(c.isNull(), "-").otherwise(F.concat(F.lit("+"), c.cast("string")))


def _solved(rows: DataFrame, turns: bool) -> tuple[DataFrame, DataFrame]:
    """(results of whole conversations, rows of all others)."""
    spark = rows.sparkSession
    bound_batches(spark)
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    bare = F.rtrim(text, F.lit(" \t\n\x0b\x0c\r"))
    fault = F.when(gone, "gone").when(bare == "", "blank").when(F.substring(bare, -1, 1).isin(".", "!", "?"), "").otherwise("truncated")
    rows = rows.select(_known(F.col("conv_id")).alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), fault.alias("fault"), F.md5(text.cast("binary")).alias("md5"))
    order = [F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64), F.col("md5"), F.col("_n")]
    rows = rows.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select("c", F.spark_partition_id().alias("part"), "turn", "role", "text", "fault", "md5")
    schema = to_arrow_schema(spark.createDataFrame([], _STREAM).schema)
    found = materialize(rows.mapInArrow(_solve(turns, schema), _STREAM), "turns-solved")
    return found.where("at is null"), found.where("at is not null").select("c", "part", "at", "turn", "role", "text", "fault", "md5")


def _named(out: DataFrame, kind: str) -> DataFrame:
    return out.withColumn("conv_id", F.when(F.col("c") != "-", F.substring("c", 2, 1 << 30)).cast(kind)).drop("c")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows(conv_id,
    turn, role, text).

    Null roles and texts are one space, a null turn comes first and is no turn for gaps, a null conv_id is a conversation. Equal
    turns are taken by role, then by the first 64 characters of their text, then by its MD5; repeated rows are duplicates. A row
    with a true column ``gone`` is not there but keeps its conversation listed; other columns are not looked at, whatever their
    names. A role that is empty or begins with none of s, u, a cannot be kept. A conversation without rows has zeros, an empty
    audit and the hash of nothing; an empty table gives none.
    """
    done, segments = _solved(rows, False)
    more, _ = _solve_segments(segments)
    out = done.select("c", *COUNTS, "audit", "repaired_sha256").unionByName(more)
    return _named(out, rows.schema["conv_id"].dataType.simpleString()).select("conv_id", *COUNTS, "audit", "repaired_sha256")


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, part, no, at, edit, role, text): the turns of the repaired conversations, in the order of part, no, at."""
    done, segments = _solved(rows, True)
    _, pieces = _solve_segments(segments)
    both = done.select("c", "part", F.lit(0).alias("no"), "pieces").unionByName(pieces)
    out = both.select("c", "part", "no", F.posexplode("pieces").alias("at", "x")).select("c", "part", "no", "at", "x.*")
    return _named(out, rows.schema["conv_id"].dataType.simpleString()).select("conv_id", "part", "no", "at", "edit", "role", "text")


def _oracle() -> str:
    """DuckDB SQL of repair(damage(conversations)): the cheapest, then ASCII-least edits to each state, row by row."""
    ways = []
    for state in range(4):
        for kind in range(9):
            at, inserts = state, 0
            while inserts < 4:
                made = [("D", DELETE, at)]
                if kind:
                    cut, initial = CUT * ((kind - 1) % 2), "sua "[(kind - 1) // 2]
                    made += [("K", cut, KEEP[at, initial])] if (at, initial) in KEEP else []
                    made += [("R", REROLE + cut, PUT[at][1])]
                ways += [(state, kind, "I" * inserts + x, INSERT * inserts + cost, to) for x, cost, to in made]
                at, inserts = PUT[at][1], inserts + 1
    tails = [(0, "", 0), (1, "II", 2 * INSERT), (2, "I", INSERT), (3, "", 0)]
    values = lambda rows: ", ".join(str(x) for x in rows)
    crc = """xor(list_reduce([4294967295] || list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
    white = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE way(s, kind, e, c, t) AS (VALUES {values(ways)}), tail(s, e, c) AS (VALUES {values(tails)}),
    keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS d FROM keyed),
    hurt AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, n
      FROM hit, LATERAL (SELECT unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS n) WHERE d <> 0),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[1:64], md5(text), n) AS i,
        rtrim(text, {white}) AS bare FROM hurt),
    dup AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS twice FROM placed),
    judged AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN twice THEN 'duplicate' WHEN bare[-1:] IN ('.', '!', '?') THEN '' ELSE 'truncated' END AS fault,
        role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM dup),
    kinds AS (SELECT conv_id, i, role, text, initial, CASE WHEN fault IN ('blank', 'duplicate') THEN 0
        ELSE 1 + 2 * (CASE initial WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END) + CAST(fault = 'truncated' AS INT) END AS kind FROM judged),
    counted AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id),
    go(conv_id, i, s, best) AS (SELECT conv_id, CAST(0 AS BIGINT), 0, {{'c': 0, 'e': ''}} FROM counted
      UNION ALL SELECT g.conv_id, g.i + 1, t, min({{'c': g.best.c + w.c, 'e': g.best.e || w.e}}) FROM go g
        JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM g.conv_id AND k.i = g.i + 1 JOIN way w ON w.s = g.s AND w.kind = k.kind GROUP BY g.conv_id, g.i, t),
    ended AS (SELECT go.conv_id, min({{'c': best.c + tail.c, 'e': best.e || tail.e}}) AS best FROM go JOIN counted ON go.conv_id IS NOT DISTINCT FROM counted.conv_id AND go.i = n
      JOIN tail ON tail.s = go.s GROUP BY go.conv_id),
    edits AS (SELECT conv_id, best.e AS audit, p, best.e[p] AS e FROM ended, LATERAL (SELECT unnest(range(1, length(best.e) + 1)) AS p)),
    used AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i, count(*) FILTER (e <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS o FROM edits),
    made AS (SELECT u.*, role, text, max(CASE WHEN o = 1 AND e = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY u.conv_id) AS led
      FROM used u LEFT JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM u.conv_id AND k.i = u.i AND e <> 'I' WHERE e <> 'D'),
    lines AS (SELECT conv_id, o, CASE WHEN e = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, '') AS line FROM made),
    hashed AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY o)) AS h FROM lines GROUP BY conv_id)
    SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
      coalesce(illegal, 0) AS illegal, CAST(coalesce(best.c, 0) AS BIGINT) AS cost, coalesce(best.e, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counted c ON a.conv_id IS NOT DISTINCT FROM c.conv_id
      LEFT JOIN ended d ON a.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN hashed b ON a.conv_id IS NOT DISTINCT FROM b.conv_id"""


ORACLE = _oracle()
