"""URL filters: pattern rules, indexed by their rarest literal token.

A rule is a regular expression with literal tokens that every URL it matches
must hold.  Each rule is filed under that one of its tokens that the fewest
URLs hold; the tokens of a URL fetch candidate rules, and only those run.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_column

#: Tokens are the longest runs of these characters.
TOKEN = r"[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host and path (joined as they are); the match of the highest ``rank`` decides."""

    name: str
    action: str
    pattern: str
    tokens: tuple[str, ...]
    rank: int
    listed: bool = False


def host_rule(action: str, text: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the URL's path starts with the rule's; the longest wins."""
    host, slash, path = text.partition("/")
    host = host.lower()
    # A path may end inside a token, so only tokens that the rule itself ends are whole.
    whole = re.findall(TOKEN, host) + re.findall(TOKEN, re.sub(r"[A-Za-z0-9]+$", "", path))
    return Rule(text, action, rf"^(?:[^/]*\.)?{re.escape(host)}{slash}{re.escape(path)}", tuple(whole), 1_000_000 + len(text), True)


def word_rule(action: str, words: str, rank: int = 1) -> Rule:
    """Fits hosts one of whose labels is made of these words, joined by hyphens, in this order."""
    return Rule(words, action, rf"^(?:[^/]*[.-])?{re.escape(words)}[.-]", tuple(re.findall(TOKEN, words)), rank)


#: The listed rules of the contract.  Fixed values.
LISTED = (
    host_rule("allow", "com/"),
    host_rule("block", "example.com/en/"),
    host_rule("allow", "www.example.com/en/"),
    host_rule("block", "net/es/"),
    host_rule("block", "net/fr/"),
)
#: What the method judges by where no listed rule fits: words of spam hosts.
WORDS = tuple(word_rule("block", w) for w in ("casino", "casino-win", "cheap-pills", "free-bets", "ads-track", "bets", "pills", "poker", "ads", "track"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.  Path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def indexed(urls: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rules, each with the one of its tokens that the fewest of ``urls`` (``tokens``) hold; equally rare: the first in order."""
    spark = urls.sparkSession
    made = spark.createDataFrame(
        [(i, r.name, r.action, r.pattern, r.rank, r.listed, sorted(set(r.tokens))) for i, r in enumerate(rules)],
        "rule_no int, name string, action string, pattern string, rank int, listed boolean, tokens array<string>",
    )
    each = made.select("rule_no", F.explode("tokens").alias("token"))
    held = urls.select(F.explode("tokens").alias("token")).join(each.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = each.join(held, "token", "left").groupBy("rule_no").agg(F.min(F.struct(F.coalesce("count", F.lit(0)), "token"))["token"].alias("token"))
    return made.drop("tokens").join(rarest, "rule_no")


def url_verdicts(pages: DataFrame, rules: Sequence[Rule] = LISTED + WORDS) -> DataFrame:
    """One row per row of ``pages``: ``(page_id, url, host, path, rule, verdict)``.

    ``rule`` is the listed rule that decides, else null; ``verdict`` is
    ``allow`` or ``block``, ``allow`` where no rule matches.  Equal ranks: a
    block wins, then the first name.  A URL that is null or has no ``://`` has
    an empty host and path, and is allowed.  Each distinct URL is judged once;
    rows may repeat and ``page_id`` may be null.
    """
    rows = pages.select(own_column(pages, "page_id", "bigint").alias("page_id"), own_column(pages, "url", "string").alias("url"))
    host, path = host_and_path(F.col("url"))
    urls = rows.select("url").filter("url is not null").distinct().select("url", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("place", F.concat("host", "path")).withColumn("tokens", F.expr(f"array_distinct(regexp_extract_all(place, '{TOKEN}', 0))"))
    index = indexed(urls, rules)
    candidates = urls.select("url", "place", F.explode("tokens").alias("token")).join(index, "token")
    matches = candidates.filter(F.expr("place rlike pattern"))
    best = matches.groupBy("url").agg(F.max(F.struct("rank", (F.col("action") == "block").alias("blocks"), (-F.col("rule_no")).alias("first"), "name", "listed", "action")).alias("best"))
    host, path = host_and_path(F.col("url"))
    return rows.join(best, "url", "left").select(
        "page_id",
        "url",
        host.alias("host"),
        path.alias("path"),
        F.when(F.col("best.listed"), F.col("best.name")).alias("rule"),
        F.coalesce("best.action", F.lit("allow")).alias("verdict"),
    )
