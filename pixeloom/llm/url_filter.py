"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens
that any URL it matches must have.  Token frequencies over the URLs (a grouped
aggregation) choose each rule's rarest token; the tokens of a URL fetch the
rules filed under them, and only those rules run.  Rules without a token are
filed under the empty token, which every URL has.  URLs are judged once for
each distinct text, so a hot host's repeated URLs cost one row.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; ``weight`` decides between several that fit (largest, then smallest name).

    ``listed`` rules are those of a caller's host and path list, the others are the method's own general ones.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    weight: int
    listed: bool = True


def host_rule(verdict: str, host: str, path: str = "/") -> Rule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``; the longest such rule wins.

    An empty path starts with no rule's ``/``, so ``http://example.org`` fits none of its host's rules.

    Tokens: the host's labels, and the path's parts that are closed by a slash (the last part may go on in the URL).
    """
    parts = tuple(f"p:{p}" for p in path.split("/")[1:-1] if p)
    labels = tuple(f"h:{p}" for p in host.split(".") if p)
    fits = rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}"
    return Rule(host + path, verdict, fits, labels + parts, (1 << 20) + len(host + path))


def text_rule(verdict: str, name: str, pattern: str, *tokens: str) -> Rule:
    """A rule of the general list, below all host rules; ``tokens`` are literals that the pattern can't match without."""
    return Rule(name, verdict, pattern, tokens, len(name), False)


#: The host rules of the contract (fixed values).
HOST_RULES = (
    host_rule("allow", "org"),
    host_rule("block", "example.org", "/es/"),
    host_rule("block", "example.org", "/en/1"),
    host_rule("allow", "com", "/fr/"),
    host_rule("block", "com", "/de/"),
)
#: The general list behind them: pages that are not prose (fixed values).
TEXT_RULES = (
    text_rule("block", "login pages", r"(?s)^[^/]*/(?:.*/)?login(?:/|\.|\z)", "p:login"),
    text_rule("block", "shopping carts", r"(?s)^[^/]*/(?:.*/)?cart(?:/|\.|\z)", "p:cart"),
    text_rule("block", "advertising hosts", r"^(?:[^/]*\.)?ads\.", "h:ads"),
    text_rule("block", "archives and media", r"\.(?:zip|gz|exe|mp4|jpg|png)\z"),
)


def host_of(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    """The empty token, the host's labels and the path's parts (cut at ``/`` and at a dot), each once."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    parts = F.transform(F.split(path, "[/.]"), lambda x: F.concat(F.lit("p:"), x))
    whole = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, parts, whole))


def judge(pages: DataFrame, rules: Iterable[Rule] = HOST_RULES + TEXT_RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule, method_rule, verdict.

    ``verdict`` comes from the heaviest rule that fits, else it is ``default``.  That rule's name is in ``rule`` where it
    is a listed one and in ``method_rule`` where it is one of the general list; the other, or both, are null.  A null URL, or one
    without ``://``, has empty host and path and is judged by the rules on those.  Repeated rows and ids each get
    their row; an empty table or rule list is fine; other columns of any name are ignored.
    """
    spark = pages.sparkSession
    rules = list(rules)
    urls = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    urls = urls.select("id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # the rule list comes with the call, so its size is that of the call's argument, not of the data
    filed = spark.createDataFrame([(i, t) for i, r in enumerate(rules) for t in r.tokens or ("",)] or [(-1, "-")], "rule int, token string")
    bodies = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, r.weight, r.listed) for i, r in enumerate(rules)] or [(-1, "", "", "", 0, True)], "rule int, name string, verdict string, pattern string, weight int, listed boolean")
    distinct = urls.groupBy("host", "path").agg(F.lit(1).alias("one")).select("host", "path", url_tokens(F.col("host"), F.col("path")).alias("tokens"))
    seen = distinct.select(F.explode("tokens").alias("token")).join(F.broadcast(filed.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    ranked = filed.join(F.broadcast(seen), "token", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
    index = ranked.join(F.broadcast(bodies), "rule").select(F.col("rarest.token").alias("token"), "name", "verdict", "pattern", "weight", "listed")
    candidates = distinct.select("host", "path", F.explode("tokens").alias("token")).join(F.broadcast(index), "token")
    fits = candidates.where(F.expr("concat(host, path) rlike pattern"))
    best = fits.groupBy("host", "path").agg(F.min(F.struct((-F.col("weight")).alias("less"), "name", "verdict", "listed")).alias("best"))
    named = urls.join(best, ["host", "path"], "left")
    listed = F.col("best.listed")
    return named.select(F.col("id").alias(id_col), "host", "path", F.when(listed, F.col("best.name")).alias("rule"), F.when(~listed, F.col("best.name")).alias("method_rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
