"""URL filters: pattern rules that are found through their rarest literal token.

A rule is a regular expression over `host + path`, with the literal tokens that every URL it
matches must hold as whole tokens. The index keeps each rule under the token that the fewest
URLs hold; a URL's tokens fetch candidate rules, and only those run their expressions. Rules
without such a token stand under the empty token, which every URL has. Of the rules that fit,
the longest wins (then the last by code point); with none, pattern rules decide, and then `default`.

All of it is DataFrame operations. Up to FEW_RULES rules, the index is one value of the plan, a map
from token to rules: each URL's tokens look up their rules within the scan, without a shuffle. Up to
BROADCAST_RULES it is broadcast; beyond that it is joined by token, with the rules of each token
dealt to SALTS parts so that a common token is no hot key. The results of these two are gathered by
(key, host, path), on which alone a verdict depends, with a count of equal rows.

Cases: a null URL or one without `://` has an empty host and path and fits no host rule;
repeated rows are judged one by one; an empty table gives an empty result; no rules at all
give the default; other columns of the table are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEW_RULES, BROADCAST_RULES, SALTS = 64, 50_000, 16
TOKEN = "[a-z0-9]+"

#: Words that stand as a whole step of a path, and endings of files, which are blocked
#: where no host rule fits.
STEPS, ENDINGS = ("login", "signin", "cart", "checkout"), ("exe", "zip", "iso")
#: Each pattern is one literal, which is its token in the index.
PATTERNS = (
    *((word, "block", rf"/{word}(?:/|$)", (word,)) for word in STEPS),
    *((word, "block", rf"\.{word}$", (word,)) for word in ENDINGS),
)


@dataclass(frozen=True)
class Rule:
    """tokens: lower-case tokens that a matching URL must hold; weight: length that decides."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...] = ()
    weight: int = 0


def host_rule(text: str, verdict: str) -> Rule:
    """`host/path`: fits the host and its subdomains, where the path starts with the rule's.

    Tokens that end with the rule are left out unless a delimiter ends them, as a URL's may go on.
    """
    host, slash, rest = text.partition("/")
    path = slash + rest
    tokens = re.findall(TOKEN, host.lower())
    if re.search(r"[^a-z0-9.-]", host):  # such hosts are not cut at token borders for certain
        tokens = []
    inner = re.match(r"(.*[^A-Za-z0-9])?", path, re.S)
    tokens += [t.lower() for t in re.findall("[A-Za-z0-9]+", inner[0] or "")] if path.isascii() else []
    quoted = re.sub(r"([^A-Za-z0-9/])", r"\\\1", path)
    return Rule(text, verdict, rf"^(?:[^/]*\.)?{re.escape(host.lower())}{quoted}", tuple(dict.fromkeys(tokens)), len(text))


def pattern_rules(patterns: Sequence[tuple] = PATTERNS) -> list[Rule]:
    return [Rule(name, verdict, pattern, tuple(tokens), -1) for name, verdict, pattern, tokens in patterns]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, with A-Z in lower case."""
    raw = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, and the empty token."""
    low = F.translate(F.concat(host, path), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(low, F.lit(f"({TOKEN})"), F.lit(1))))


def index_rules(spark: SparkSession, urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """token, rule, verdict, pattern, weight: each rule under its token in the fewest urls."""
    table = spark.createDataFrame(
        [(r.name, r.verdict, r.pattern, r.weight, list(r.tokens)) for r in rules],
        "rule string, verdict string, pattern string, weight int, tokens array<string>",
    )
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    wanted = F.broadcast(wanted) if len(rules) <= BROADCAST_RULES else wanted
    counts = (
        urls.select(F.explode("tokens").alias("token"))
        .join(wanted, "token", "left_semi")
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("urls"))
    )
    rarest = (
        table.select("rule", F.explode("tokens").alias("token"))
        .join(counts, "token", "left")
        .groupBy("rule")
        .agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    )
    return table.drop("tokens").join(rarest, "rule", "left").withColumn("token", F.coalesce("token", F.lit("")))


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """key, host, path, rule (of a host rule that fits, else null), verdict, pattern_rule."""
    spark = pages.sparkSession
    urls = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    urls = urls.withColumn("tokens", tokens_of(F.col("host"), F.col("path")))
    index = index_rules(spark, urls, rules)
    if len(rules) <= min(FEW_RULES, BROADCAST_RULES):
        won = urls.select("key", "host", "path", looked_up(index, F.col("tokens"), F.col("host"), F.col("path")).alias("found"))
    else:
        won = joined(urls, index, len(rules) <= BROADCAST_RULES)
    return won.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.when(F.col("found.weight") >= 0, F.col("found.rule")).alias("rule"),
        F.coalesce("found.verdict", F.lit(default)).alias("verdict"),
        F.when(F.col("found.weight") < 0, F.col("found.rule")).alias("pattern_rule"),
    )


def looked_up(index: DataFrame, tokens: Column, host: Column, path: Column) -> Column:
    """The best rule (weight, rule, verdict) of those that the tokens fetch from a small index."""
    held: dict[str, list] = {}
    for r in index.collect():  # at most FEW_RULES
        held.setdefault(r["token"], []).append((r["weight"], r["rule"], r["verdict"], r["pattern"]))
    kind = "array<struct<weight:int,rule:string,verdict:string,pattern:string>>"
    entry = lambda r: F.struct(F.lit(r[0]).alias("weight"), *(F.lit(v).alias(n) for v, n in zip(r[1:], ("rule", "verdict", "pattern"), strict=True)))
    by_token = F.create_map(*[x for t in sorted(held) for x in (F.lit(t), F.array(*map(entry, sorted(held[t]))))]) if held else F.lit(None).cast(f"map<string,{kind}>")
    fetched = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(by_token, t)), lambda x: x.isNotNull()))
    whole = F.concat(host, path)
    fits = F.filter(fetched, lambda r: (host != "") & F.call_function("rlike", whole, r["pattern"]))
    return F.array_max(F.transform(fits, lambda r: F.struct(r["weight"].alias("weight"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))


def joined(urls: DataFrame, index: DataFrame, few: bool) -> DataFrame:
    """key, host, path and found for each of urls, by joins on tokens."""
    # the null token meets no rule, so it stands once for each row
    each = urls.select("key", "host", "path", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("tokens"))).alias("token"))
    if few:
        pairs = each.join(F.broadcast(index), "token", "left")
    else:
        index = index.withColumn("salt", F.pmod(F.xxhash64("rule"), F.lit(SALTS)))
        parts = F.when(F.col("token").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))
        pairs = each.withColumn("salt", F.explode(parts)).join(index, ["token", "salt"], "left")
    fits = F.col("host").isNotNull() & (F.col("host") != "") & F.expr("rlike(concat(host, path), pattern)")
    found = F.when(F.coalesce(fits, F.lit(False)), F.struct(F.col("weight"), F.col("rule"), F.col("verdict")))
    won = (
        pairs.select("key", "host", "path", found.alias("found"), F.col("token").isNull().cast("long").alias("one"))
        .groupBy("key", "host", "path")
        .agg(F.max("found").alias("found"), F.sum("one").alias("rows"))
    )
    return won.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))).drop("rows", "copy")
