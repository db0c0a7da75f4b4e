"""URL filter: rules indexed by their rarest literal token.

A rule set mixes *site rules* (host plus path prefix) and *pattern rules* (regular
expressions with their literal tokens).  Every rule is filed under the one of its literal
tokens that is rarest among the URLs; the tokens of a URL fetch the candidate rules, and
only those run their regular expression.  DataFrame functions only.

Defined cases: a null URL or one without "://" has empty host and path and no site rule can
fit it; an empty path fits no site rule (their paths start with "/"); repeated rows are judged
alike; an empty table gives an empty result; columns of the input that have a result's name
are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, joined, without

#: Up to so many rules the index is part of the expression; beyond, it is a joined table.
INLINE_RULES = 500
#: Bytes of patterns and names up to which that table is broadcast.
BROADCAST_BYTES = 32 << 20
RESULTS = ["host", "path", "rule", "verdict"]


@dataclass(frozen=True)
class Rule:
    """name: shown in the result (None: a pattern rule, which shows none); order: smaller wins."""

    name: str | None
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    order: tuple


def tokens_of(text: str, open_end: bool) -> tuple[str, ...]:
    """Whole alphanumeric tokens, A-Z lower-cased as the URLs' are; a last one that the URL may continue is no literal token."""
    text = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    found = re.findall(r"[a-z0-9]+", text)
    if open_end and re.search(r"[a-z0-9]\Z", text) and found:
        found = found[:-1]
    return tuple(dict.fromkeys(found))


def site_rule(verdict: str, host: str, path: str) -> Rule:
    """Fits the host and all its subdomains where the URL's path starts with `path`; the longest wins."""
    name = host + path
    return Rule(name, verdict, r"^(?:[^/]*\.)?" + re.escape(host) + re.escape(path), tokens_of(name, True), (0, -len(name), name))


def pattern_rule(verdict: str, pattern: str, tokens: tuple[str, ...]) -> Rule:
    """A regular expression over host + path (A-Z lower-cased) and literal tokens each match must hold."""
    return Rule(None, verdict, pattern, tokens, (1, 0, pattern))


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of a text file: `block host/path`, or `block /pattern/ token token`; empty lines and those with # are left out.

    The whole rule set comes to the driver.
    """
    out = []
    for (line,) in spark.read.text(path).where("trim(value) <> '' and not startswith(trim(value), '#')").collect():
        verdict, what = line.strip().split(None, 1)
        if what.startswith("/"):
            pattern, _, words = what[1:].rpartition("/")
            out.append(pattern_rule(verdict, pattern, tuple(t for w in words.split() for t in tokens_of(w, False))))
        else:
            host, slash, path_start = what.partition("/")
            out.append(site_rule(verdict, host.lower(), slash + path_start))
    return out


#: The site rules of the registered query.
SITE_RULES = (
    site_rule("block", "net", "/"),
    site_rule("allow", "example.net", "/en/"),
    site_rule("block", "example.com", "/de/"),
    site_rule("allow", "org", "/fr/"),
)
#: Words of advertising and gambling hosts, as pattern rules.
PATTERN_RULES = (
    pattern_rule("block", r"^(?:[^/]*[.-])?casino-[a-z]+[.]", ("casino",)),
    pattern_rule("block", r"^(?:[^/]*[.-])?free-bets[.]", ("free", "bets")),
    pattern_rule("block", r"^(?:[^/]*[.-])?cheap-pills[.]", ("cheap", "pills")),
    pattern_rule("block", r"^(?:[^/]*[.-])?ads-track[.]", ("ads", "track")),
)


def parsed(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    u = F.col(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def _tokens():
    key = ascii_lower(F.concat("host", "path"))
    return F.array_distinct(F.split(key, "[^a-z0-9]+"))


def _rarest(df: DataFrame, rules: list[Rule]) -> list[str | None]:
    """For each rule its token that the fewest URLs hold (ties: the smaller); None: it has no token.

    The counts cover all URLs; what reaches the driver has one row for each rule token at most.
    """
    words = sorted({t for r in rules for t in r.tokens})
    if not words:
        return [None] * len(rules)
    spark = df.sparkSession
    wanted = spark.createDataFrame([(w,) for w in words], "token string")
    seen = df.select(F.explode(_tokens()).alias("token"))
    if len(words) <= INLINE_RULES:
        seen = seen.where(F.col("token").isin(words))
    else:
        seen = seen.join(wanted, "token", "left_semi")
    counts = {r.token: r["n"] for r in seen.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return [min(r.tokens, key=lambda t: (counts.get(t, 0), t)) if r.tokens else None for r in rules]


def _inline(df: DataFrame, rules: list[Rule], filed: list[str | None]) -> DataFrame:
    index: dict[str, list[int]] = {}
    for i, t in enumerate(filed):
        index.setdefault(t or "", []).append(i + 1)
    always = F.array(*[F.lit(i) for i in index.pop("", [])]).cast("array<int>")
    found = always
    if index:
        table = F.create_map(*[x for t, ids in sorted(index.items()) for x in (F.lit(t), F.array(*map(F.lit, ids)))])
        fetched = F.flatten(F.transform(F.filter(_tokens(), lambda t: F.map_contains_key(table, t)), lambda t: F.element_at(table, t)))
        found = F.concat(always, fetched)
    patterns = F.array(*[F.lit(r.pattern) for r in rules])
    # the path keeps its case: rules' paths compare exactly
    fits = F.filter(found, lambda i: F.rlike(F.concat("host", "path"), F.element_at(patterns, i)))
    names = F.array(*[F.lit(r.name).cast("string") for r in rules])
    verdicts = F.array(*[F.lit(r.verdict) for r in rules])
    best = F.array_min(fits)
    return df.withColumn("_best", best).withColumns({"rule": F.when(F.col("_best").isNotNull(), F.element_at(names, F.col("_best"))), "verdict": F.when(F.col("_best").isNotNull(), F.element_at(verdicts, F.col("_best")))}).drop("_best")


def _joined(df: DataFrame, rules: list[Rule], filed: list[str | None]) -> DataFrame:
    """For large rule sets: distinct host/path pairs meet the index in a join on the token; rules without tokens run on all of them."""
    spark = df.sparkSession
    index = spark.createDataFrame([(t, i, r.pattern, r.name, r.verdict) for i, (t, r) in enumerate(zip(filed, rules)) if t], "token string, nr int, pattern string, name string, says string")
    if sum(len(r.pattern) + len(r.name or "") + 100 for r in rules) <= BROADCAST_BYTES:
        index = F.broadcast(index)
    # a host has no "/" and a path starts with one: together they stand for both
    urls = df.groupBy(F.concat("host", "path").alias("url")).agg(F.count("*").alias("n"))
    tokens = F.explode(F.array_distinct(F.split(ascii_lower(F.col("url")), "[^a-z0-9]+"))).alias("token")
    hits = urls.select("url", "n", tokens).join(index, "token").where("rlike(url, pattern)").select("url", "n", F.struct("nr", "name", "says").alias("hit"))
    always = [F.struct(F.lit(i).alias("nr"), F.lit(r.name).cast("string").alias("name"), F.lit(r.verdict).alias("says"), F.lit(r.pattern).alias("pattern")) for i, (t, r) in enumerate(zip(filed, rules)) if not t]
    if always:
        fits = F.array_min(F.filter(F.array(*always), lambda r: F.rlike(F.col("url"), r["pattern"]))).alias("r")
        found = urls.select("url", "n", fits).where("r is not null")
        hits = hits.unionByName(found.select("url", "n", F.struct("r.nr", "r.name", "r.says").alias("hit")))
    best = hits.groupBy("url").agg(F.first("n").alias("n"), F.min("hit").alias("hit")).withColumnsRenamed({"url": "_site", "n": "_n", "hit": "_hit"})
    out = joined(df.withColumn("_url", F.concat("host", "path")), best.withColumnRenamed("_site", "_url"), "_url", "_n", df.count())
    return out.withColumns({"rule": F.col("_hit.name"), "verdict": F.col("_hit.says")}).drop("_hit", "_url")


def judge(df: DataFrame, rules=SITE_RULES + PATTERN_RULES, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule (a site rule's name, else null) and verdict (the rule's, else `default`)."""
    df = parsed(without(df, RESULTS), url)
    rules = sorted(rules, key=lambda r: r.order)
    if not rules:
        return df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    filed = _rarest(df, rules)
    out = (_inline if len(rules) <= INLINE_RULES else _joined)(df, rules, filed)
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(default)))
