"""Allow and block rules for URLs, found by their rarest literal token.

A rule is a regular expression plus the literal tokens that every URL it fits
must hold. The rule is filed under the one of them that fewest URLs hold; the
tokens of a URL fetch the rules filed under them, and only those rules run
their regular expressions. All of it is DataFrame functions.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

_SPLIT = "[^0-9A-Za-z]+"


@dataclass(frozen=True)
class UrlRule:
    """``pattern`` is matched against host + path; ``tokens`` are whole tokens of any match."""

    action: str
    rule: str
    pattern: str
    tokens: tuple[str, ...] = ()


def host_path_rule(action: str, host: str, path: str) -> UrlRule:
    """A rule that fits ``host`` and its subdomains where the path starts with ``path``."""
    inner = re.findall(r"(?<![0-9A-Za-z])[0-9A-Za-z]+(?=[^0-9A-Za-z])", path)
    tokens = [t for t in re.split(_SPLIT, host) if t] + inner
    return UrlRule(action, host + path, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", tuple(dict.fromkeys(tokens)))


#: The rules of the registered query.
RULES = (
    host_path_rule("block", "com", "/en/"),
    host_path_rule("allow", "example.com", "/en/7"),
    host_path_rule("allow", "net", "/de/"),
    host_path_rule("block", "example.net", "/de/8"),
    host_path_rule("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _index(urls: DataFrame, rules: Sequence[UrlRule]) -> dict[str, list[UrlRule]]:
    """Rules by their rarest token; those without a token are under ""."""
    known = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if known:
        held = F.array_intersect(F.col("tokens"), F.array(*map(F.lit, known)))
        counts = {t: n for t, n in urls.select(F.explode(held).alias("t")).groupBy("t").count().collect()}
    filed: dict[str, list[UrlRule]] = {}
    for r in rules:
        filed.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return filed


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], url: str = "url", default: str = "allow", max_inline: int = 500) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, with A-Z lower-cased; the path goes on up to ``?``, ``#`` or the end.
    A null URL and one without ``://`` have an empty host and path. The longest
    fitting rule decides (of equally long ones the greater by code points);
    without any, ``rule`` is null and the verdict is ``default``. Columns of
    ``pages`` named like an added one are replaced.

    Up to ``max_inline`` rules travel inside the plan. Beyond that they are a
    table that is joined on the token, whatever its size.
    """
    # added under names of its own, so that no column of ``pages`` can clash before the end
    parts = pages.withColumns({"_host": host_of(F.col(url)), "_path": path_of(F.col(url))})
    target = F.concat("_host", "_path")
    tokens = F.array_distinct(F.split(target, _SPLIT))
    rules = list(dict.fromkeys(rules))
    if len(rules) <= max_inline:
        filed = _index(parts.select(tokens.alias("tokens")), rules)
        judged = parts.withColumn("_best", _fetch(tokens, target, filed) if filed else F.lit(None).cast("struct<n:int,rule:string,action:string>"))
    else:
        judged = _joined(parts, tokens, target, rules)
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return judged.select(
        *(F.col(f"`{c}`") for c in kept),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce("_best.action", F.lit(default)).alias("verdict"),
    )


def _fetch(tokens: Column, target: Column, filed: dict[str, list[UrlRule]]) -> Column:
    """The best rule among those that the tokens fetch and whose pattern fits."""
    entry = lambda r: F.struct(F.lit(r.pattern).alias("pattern"), F.lit(len(r.rule)).alias("n"), F.lit(r.rule).alias("rule"), F.lit(r.action).alias("action"))
    index = F.create_map(*(x for t, rs in sorted(filed.items()) for x in (F.lit(t), F.array(*map(entry, rs)))))
    keys = F.array_union(F.array_intersect(tokens, F.array(*map(F.lit, sorted(filed)))), F.array(F.lit("")) if "" in filed else F.array().cast("array<string>"))
    fetched = F.flatten(F.transform(keys, lambda t: F.try_element_at(index, t)))
    fitting = F.filter(fetched, lambda r: F.rlike(target, r["pattern"]))
    return F.array_max(F.transform(fitting, lambda r: F.struct(r["n"].alias("n"), r["rule"].alias("rule"), r["action"].alias("action"))))


def _joined(parts: DataFrame, tokens: Column, target: Column, rules: list[UrlRule]) -> DataFrame:
    """As ``_fetch``, with the rules as a table; URLs are judged once each, however often they occur."""
    spark = parts.sparkSession
    held = spark.createDataFrame([(k, t) for k, r in enumerate(rules) for t in r.tokens or ("",)], "k int, token string")
    urls = parts.select("_host", "_path").distinct().select("*", F.explode(F.array_append(F.filter(tokens, lambda t: t != ""), F.lit(""))).alias("token"))
    counts = urls.join(held.select("token").distinct(), "token", "left_semi").groupBy("token").count()
    rarest = held.join(counts, "token", "left").groupBy("k").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token"))
    text = spark.createDataFrame([(k, r.pattern, len(r.rule), r.rule, r.action) for k, r in enumerate(rules)], "k int, pattern string, n int, rule string, action string")
    best = (
        urls.join(rarest.join(text, "k"), "token")
        .filter(F.rlike(target, F.col("pattern")))
        .groupBy("_host", "_path")
        .agg(F.max(F.struct("n", "rule", "action")).alias("_best"))
    )
    return parts.join(best, ["_host", "_path"], "left")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url by ``RULES``; a row for each, in no order. See ``judge_urls`` for odd urls."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP5_SQL = r"""
WITH rules(action, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
         ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
parts AS (
  SELECT page_id, row_number() OVER () AS n,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, coalesce(r.action, 'allow') AS verdict
FROM parts p LEFT JOIN rules r
  ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
QUALIFY row_number() OVER (PARTITION BY p.n ORDER BY length(r.host || r.path) DESC, r.host || r.path DESC) = 1
"""
