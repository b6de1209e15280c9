"""URL filter rules, indexed by the rarest literal token of each rule.

A rule is a regular expression with literal tokens that every URL it fits must contain. The index holds each rule under
the one of its tokens that the fewest URLs have; the tokens of a URL fetch candidate rules, and only those run. Up to
MAX_INLINE_RULES the index is a literal of hash buckets next to the scan, so no row is shuffled; a longer list is a table
joined by token, with the same verdicts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .runtime import fresh

#: At most so many rules are put into the plan itself, each with its own compiled expression.
MAX_INLINE_RULES = 200
#: URLs whose tokens the rarity of a rule's tokens is counted on: it settles speed only, never a verdict.
TOKEN_SPLIT = "[^A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """text: the rule as reported; regex: run on ``target`` (``place``: lower-cased host and path, or ``url``); tokens:
    lower-case literals that a fitting URL holds as whole tokens, none: the rule is tried on every URL."""

    text: str
    verdict: str
    regex: str
    target: str
    tokens: tuple[str, ...]


def place_rule(text: str, verdict: str) -> Rule:
    """``host/path``: fits the host and its subdomains, where the path starts with the rule's."""
    host, _, path = text.partition("/")
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    # the last piece of the path may be continued by the URL, so only closed pieces are whole tokens
    closed = re.findall(r"[A-Za-z0-9]+(?=[^A-Za-z0-9])", path)
    tokens = tuple(dict.fromkeys(x.lower() for x in re.split(TOKEN_SPLIT, host) + closed if x))
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{_escaped(host)}/{_escaped(path)}", "place", tokens)


def url_pattern(text: str, verdict: str, tokens: Iterable[str]) -> Rule:
    """A regular expression on the whole URL; ``tokens`` are the literals it needs as whole tokens."""
    return Rule(text, verdict, text, "url", tuple(x.lower() for x in tokens))


def _escaped(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/-])", r"\\\1", text)


#: Fixed values of the contract: host and path rules.
PLACE_RULES = [
    place_rule("net/", "block"),
    place_rule("example.net/en/", "allow"),
    place_rule("example.com/de/", "block"),
    place_rule("org/fr/", "allow"),
]
#: The method's own verdict where no place rule fits: tracking links and listing pages are blocked, all else is allowed.
URL_PATTERNS = [
    url_pattern("[?&]utm_source=", "block", ["utm", "source"]),
    url_pattern("[?&]page=[0-9]+(&|$)", "block", ["page"]),
    url_pattern("[?&]ref=", "block", ["ref"]),
    *(url_pattern(f"/{word}([/?#]|$)", "block", [word]) for word in ("login", "logout", "signup")),
]
DEFAULT_VERDICT = "allow"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """After the host up to ``? #`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def token_counts(urls: DataFrame, tokens: Iterable[str], url: str = "url") -> dict[str, int]:
    """How many URLs hold each of the rules' tokens; one pass, no shuffle of rows, one count a token to the driver."""
    names = sorted(set(tokens))
    if not names:
        return {}
    held = F.split(F.lower(F.coalesce(F.col(url), F.lit(""))), TOKEN_SPLIT)
    row = urls.select(held.alias("t")).agg(*(F.count_if(F.array_contains("t", x)).alias(f"c{i}") for i, x in enumerate(names))).first()
    return dict(zip(names, row, strict=True))


def rarest(rules: list[Rule], counts: dict[str, int]) -> dict[str | None, list[int]]:
    """Token to the rules filed under it; None holds those without a token."""
    index: dict[str | None, list[int]] = {}
    for i, rule in enumerate(rules):
        token = min(rule.tokens, key=lambda x: (counts.get(x, 0), x)) if rule.tokens else None
        index.setdefault(token, []).append(i)
    return index


def judge(pages: DataFrame, place_rules: list[Rule], patterns: list[Rule], default: str = DEFAULT_VERDICT, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict. The longest fitting place rule gives both; where none fits, rule is null and the
    verdict is that of the first fitting pattern, else the default.

    Null URLs and those without ``://`` have an empty host and path and fit no place rule. Ties in length go to the rule
    that is listed first. Repeated rows are judged alike. Columns host, path, rule, verdict of the input are replaced;
    columns of any other name stay as they are.
    """
    rules = [*place_rules, *patterns]
    if len(rules) > MAX_INLINE_RULES:
        return judge_by_join(pages, rule_table(pages.sparkSession, rules), default, url)
    index = rarest(rules, token_counts(pages, (t for r in rules if len(r.tokens) > 1 for t in r.tokens), url))
    tokens, candidates, fitting, chosen = fresh(pages, "_tokens", "_candidates", "_fits", "_best")
    held = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    held = held.withColumn(tokens, F.array_distinct(F.split(F.lower(F.coalesce(F.col(url), F.lit(""))), TOKEN_SPLIT)))
    buckets: dict[int, list[tuple[str, int]]] = {}
    size = 1 << max(4, (2 * len(index)).bit_length())
    for token, filed in index.items():
        if token is not None:
            buckets.setdefault(_bucket(token, size), []).extend((token, i) for i in filed)
    entry = lambda token, i: F.struct(F.lit(token).alias("token"), F.lit(i).alias("rule"))
    empty = F.filter(F.array(entry("", 0)), lambda _: F.lit(False))
    literal = F.array(*(F.array(*(entry(*x) for x in buckets[b])) if b in buckets else empty for b in range(size)))
    fetched = F.flatten(F.transform(tokens, lambda t: F.transform(F.filter(F.element_at(literal, _bucket_of(t, size) + 1), lambda e: e["token"] == t), lambda e: e["rule"])))
    always = F.array(*(F.lit(i) for i in index.get(None, []))).cast("array<int>")
    held = held.withColumn(candidates, F.concat(fetched, always))
    text = {"place": F.concat("host", "path"), "url": F.coalesce(F.col(url), F.lit(""))}
    fits = F.array(*(F.when(F.array_contains(candidates, i), F.when(text[r.target].rlike(r.regex), i)) for i, r in enumerate(rules)))
    held = held.withColumn(fitting, F.array_compact(fits.cast("array<int>")))
    # best: longest place rule, first listed; patterns come after all place rules, first listed
    n = len(place_rules)
    scores = F.array(*(F.struct(F.lit(-len(r.text) if k < n else 0).alias("a"), F.lit(k).alias("b")) for k, r in enumerate(rules)))
    best = F.array_min(F.transform(fitting, lambda i: F.element_at(scores, i + 1)))["b"]
    held = held.withColumn(chosen, best)
    texts = F.array(*(F.lit(r.text if k < n else None).cast("string") for k, r in enumerate(rules)))
    verdicts = F.array(*(F.lit(r.verdict) for r in rules))
    at = F.col(chosen) + 1
    return held.withColumns({"rule": F.when(F.col(chosen).isNotNull(), F.element_at(texts, at)), "verdict": F.coalesce(F.when(F.col(chosen).isNotNull(), F.element_at(verdicts, at)), F.lit(default))}).drop(tokens, candidates, fitting, chosen)


def judge_by_join(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, url: str = "url") -> DataFrame:
    """The same for any number of rules(ord, rule, verdict, regex, place, tokens): distinct URLs meet rules by token.

    Each distinct URL is judged once and its verdict joined back, so copies of one URL cost one row, and rules are filed
    under the token that the fewest distinct URLs hold. Rules without a token are filed under the empty one, which every
    URL has. Ties and nulls are as in judge(); columns host, path, rule, verdict of the input are replaced.
    """
    urls = pages.select(F.coalesce(F.col(url), F.lit("")).alias("_u")).distinct()
    held = urls.select("_u", F.explode(F.array_union(F.split(F.lower("_u"), TOKEN_SPLIT), F.array(F.lit("")))).alias("_t"))
    rules = rules.withColumn("tokens", F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(""))))
    wanted = rules.select(F.explode("tokens").alias("_t")).distinct()
    counts = held.join(wanted, "_t").groupBy("_t").agg(F.count("*").alias("_n"))
    filed = rules.select("*", F.explode("tokens").alias("_t")).join(counts, "_t", "left")
    filed = filed.groupBy("ord", "rule", "verdict", "regex", "place").agg(F.min_by("_t", F.struct(F.coalesce("_n", F.lit(0)), "_t")).alias("_t"))
    text = F.when(F.col("place"), F.concat(url_host(F.col("_u")), url_path(F.col("_u")))).otherwise(F.col("_u"))
    found = held.join(filed, "_t").where(F.rlike(text, F.col("regex")))
    score = F.struct((~F.col("place")).alias("p"), F.when(F.col("place"), -F.length("rule")).otherwise(0).alias("l"), F.col("ord").alias("o"))
    best = found.groupBy("_u").agg(F.min_by(F.struct(F.when(F.col("place"), F.col("rule")).alias("rule"), "verdict"), score).alias("_b"))
    pages = pages.drop("host", "path", "rule", "verdict")
    key, won = fresh(pages, "_u", "_b")
    out = pages.join(best.toDF(key, won), F.coalesce(F.col(url), F.lit("")) == F.col(key), "left").drop(key)
    return out.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url)), "rule": F.col(won)["rule"], "verdict": F.coalesce(F.col(won)["verdict"], F.lit(default))}).drop(won)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """Rules as the table that judge_by_join takes."""
    rows = [(i, r.text, r.verdict, r.regex, r.target == "place", list(r.tokens)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "ord int, rule string, verdict string, regex string, place boolean, tokens array<string>")


def _bucket(token: str, size: int) -> int:
    import zlib

    return zlib.crc32(token.encode()) & (size - 1)


def _bucket_of(token: Column, size: int) -> Column:
    return F.crc32(token.cast("binary")).bitwiseAND(F.lit(size - 1).cast("long")).cast("int")


ORACLE = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url,
         translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN regexp_matches(url, '[?&]utm_source=') OR regexp_matches(url, '[?&]page=[0-9]+(&|$)') OR regexp_matches(url, '[?&]ref=')
    OR regexp_matches(url, '/(login|logout|signup)([/?#]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""
