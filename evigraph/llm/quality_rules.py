"""Quality rules: a learned decision list over text statistics, applied as one ordered Spark conditional.

Sequential covering for the class of low quality: a rule, a conjunction of thresholds, is grown on one part of the labelled
rows by information gain, pruned on the rest, and kept if it is precise there; the rows it covers go, and the next is
grown. All counting is grouped aggregation over the slim table of statistics; the driver sees counts by feature and bin.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .runtime import fold, materialize, space_words

#: Fixed characters and limits of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

FEATURES = ("word_length", "symbol_share", "mark_share", "upper_share", "dup_line_share", "repeat_share", "distinct_share", "n_words")
BINS, MAX_RULES, MAX_CONDITIONS = 24, 12, 4
MIN_PRECISION, MIN_COVER = 0.9, 3


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base statistics and the features of a text; every other column but the text stays.

    A word is in a repeat if it is in a 3-word window found twice or more. Windows are sorted with their positions, so equal
    ones are neighbours and the cost of a long text is n log n, in one row, without a shuffle.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    without = lambda col, chars: F.length(col) - F.length(F.translate(col, chars, ""))
    rows = docs.withColumns({"_t": t, "_w": space_words(F.col(text))}).drop(text)
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    several = F.when(F.instr("_t", "\n") > 0, lines)
    rows = rows.withColumns(
        {
            "_lines": several,
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": without(F.col("_t"), SYMBOLS).cast("long"),
            "_marks": without(F.col("_t"), "!?"),
            "_upper": without(F.col("_t"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
            "_distinct": F.size(F.array_distinct("_w")),
            "_sorted": _sorted_windows(F.col("_w")),
        }
    ).drop("_t", "_w")
    rows = rows.withColumn("n_dup_lines", F.coalesce(F.size("_lines") - F.size(F.array_distinct("_lines")), F.lit(0)).cast("long"))
    rows = rows.withColumn("n_repeat_words", _covered(F.col("_sorted")).cast("long")).drop("_sorted")
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    rows = rows.withColumn("_n_lines", F.greatest(F.coalesce(F.size("_lines"), F.lit(1)), F.lit(1)))
    return rows.withColumns(
        {
            "word_length": per("word_chars", "n_words"),
            "symbol_share": per("n_symbols", "word_chars"),
            "mark_share": per("_marks", "word_chars"),
            "upper_share": per("_upper", "word_chars"),
            "dup_line_share": per("n_dup_lines", "_n_lines"),
            "repeat_share": per("n_repeat_words", "n_words"),
            "distinct_share": per("_distinct", "n_words"),
        }
    ).drop("_lines", "_n_lines", "_marks", "_upper", "_distinct")


def _sorted_windows(words: Column) -> Column:
    n = F.size(words)
    windows = F.arrays_zip(words.alias("a"), F.slice(words, 2, n).alias("b"), F.slice(words, 3, n).alias("c"), F.sequence(F.lit(0), n - 1).alias("at"))
    return F.when(n >= 4, F.sort_array(F.slice(windows, 1, n - 2)))


def _covered(sorted_windows: Column) -> Column:
    """Words in the windows that have an equal neighbour."""
    pairs = F.arrays_zip(sorted_windows.alias("x"), F.slice(sorted_windows, 2, F.size(sorted_windows)).alias("y"))
    same = F.filter(pairs, lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"]))
    at = F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["x"]["at"], p["y"]["at"]))))
    words = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, i + 1, i + 2))))
    return F.coalesce(F.size(words), F.lit(0))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    limit: float

    def column(self) -> Column:
        return F.col(self.feature) > F.lit(self.limit) if self.above else F.col(self.feature) <= F.lit(self.limit)

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.limit:g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def rule_number(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, from 1 on; null if none does."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        out = out.when(_all(rule), F.lit(k))
    return out


class Labelled:
    """Statistics with a label (bad: 1, 0) and a part (grow: true, false), and the cuts tried as thresholds."""

    def __init__(self, rows: DataFrame):
        self.rows = rows
        cuts = rows.agg(*(F.percentile_approx(f, [k / BINS for k in range(1, BINS)] + [0.005, 0.995], 10_000).alias(f) for f in FEATURES)).first()
        self.cuts = {f: sorted(set(cuts[f] or [])) for f in FEATURES}

    def by_bin(self, covered: Column) -> dict[str, list[tuple[int, int]]]:
        """(bad, good) of the growing part by feature and bin; bin k holds values above cut k-1 and up to cut k."""
        out = {f: [(0, 0)] * (len(self.cuts[f]) + 1) for f in FEATURES}
        bins = F.array(*(F.struct(F.lit(i).alias("f"), self._bin(f).alias("b")) for i, f in enumerate(FEATURES)))
        held = self.rows.where(covered & F.col("grow")).select("bad", F.explode(bins).alias("x"))
        for row in held.groupBy("x.f", "x.b").agg(F.sum("bad").alias("p"), F.count("*").alias("n")).collect():
            out[FEATURES[row["f"]]][row["b"]] = (row["p"], row["n"] - row["p"])
        return out

    def _bin(self, feature: str) -> Column:
        cuts = self.cuts[feature]
        return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(feature))) if cuts else F.lit(0)

    def of_prefixes(self, open_: Column, rule: Rule) -> list[tuple[int, int]]:
        """(bad, good) of the pruning part that each beginning of the rule covers."""
        aggs = []
        for k in range(1, len(rule) + 1):
            hit = _all(rule[:k])
            aggs += [F.count_if(hit & (F.col("bad") == 1)), F.count_if(hit & (F.col("bad") == 0))]
        row = self.rows.where(open_ & ~F.col("grow")).agg(*aggs).first()
        return [(row[2 * k], row[2 * k + 1]) for k in range(len(rule))]


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def _grow(data: Labelled, open_: Column) -> Rule:
    rule: Rule = ()
    while len(rule) < MAX_CONDITIONS:
        bins = data.by_bin(open_ & _all(rule))
        p0, n0 = map(sum, zip(*bins[FEATURES[0]], strict=True))
        if not p0 or not n0:
            break
        best = (1e-9, None)
        for f in FEATURES:
            low_p = low_n = 0
            for limit, (p, n) in zip(data.cuts[f], bins[f], strict=False):
                low_p, low_n = low_p + p, low_n + n
                for above, q, m in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                    gain = _gain(q, m, p0, n0)
                    if gain > best[0]:
                        best = (gain, Condition(f, above, float(limit)))
        if best[1] is None:
            break
        rule = (*rule, best[1])
    return rule


def learn(rows: DataFrame) -> list[Rule]:
    """The rules for low quality from rows with FEATURES, bad and grow, best first. Without labels there are none."""
    data, rules, open_ = Labelled(rows), [], F.lit(True)
    while len(rules) < MAX_RULES:
        rule = _grow(data, open_)
        if not rule:
            break
        worth = [((p - n) / (p + n), -k, p, n) if p + n else (-1.0, -k, 0, 0) for k, (p, n) in enumerate(data.of_prefixes(open_, rule))]
        _, k, p, n = max(worth)
        if p < MIN_COVER or p / (p + n) < MIN_PRECISION:
            break
        rules.append(rule[: 1 - k])
        open_ = open_ & ~_all(rules[-1])
    return rules


def judge(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[Rule]]:
    """Statistics of every row of docs(doc_id, text, ...) with base_failed, rule and kept; and the rules learned.

    labels(doc_id, quality): null ids and qualities are left out; an id with both labels counts as good. Null and empty
    texts have no words and fail the base rules. Repeated rows are judged alike. With no labels at all, only the base rules
    reject. The statistics are written once to the shared folder, without texts; the label join and all learning read them.
    """
    stats = materialize(text_statistics(docs.select("doc_id", "text")), "quality-statistics")
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((1 - F.max("quality")).cast("long").alias("bad"))
    labelled = stats.join(known, "doc_id").where(f"n_words >= {MIN_WORDS}")
    labelled = materialize(labelled.select(*FEATURES, "bad", (fold(F.col("doc_id"), 3) < 2).alias("grow")), "quality-labelled")
    rules = learn(labelled)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = stats.withColumns({"base_failed": failed, "rule": rule_number(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
