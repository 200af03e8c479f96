"""URL filters with redirect equivalence.

Rules are (action, host, path): a rule fits its host and all subdomains where
the url's path starts with the rule's; the longest that fits wins. Pages name
their aliases: the target of a meta refresh and the canonical link. Connected
components over these edges are one resource under several urls, so a url no rule
decides takes a block from any alias that a rule blocks. A rule that allows a url
itself always stands, and never spreads. All else is allowed.

Cases: a null url, or one without ://, has empty host and path, no rule and no
aliases; the fragment is no part of a url's identity; null html has no links, and
links in comments, scripts and styles are none; relative targets are resolved against
the page's base element, if it has one, and the page, with . and .. segments;
character references for ASCII are decoded in targets; repeated urls, on any number
of pages, are one node; several components through one alias are one; an empty table
gives no rows; other columns, with any names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .components import components

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
_ASCII = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host with A-Z lower-cased, path), both empty without ://."""
    text = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(text, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), *_ASCII)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(action, rule) of the longest rule that fits, else null. For up to a few hundred rules."""
    out = F.lit(None).cast("struct<action:string,rule:string>")
    for action, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(action).alias("action"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(out)
    return out


def identity(url: Column) -> Column:
    """A url without its fragment, scheme and host lower-cased; null if it has no ://."""
    parts = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(F.translate(parts, *_ASCII), rest))


def _plain(html: Column) -> Column:
    """Pages without comments, scripts and styles."""
    return F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script|\z)|<style\b.*?(?:</style|\z)", " ")


def _decoded(target: Column) -> Column:
    """Character references of ASCII characters, by number or as &amp;."""
    found = F.array_distinct(F.regexp_extract_all(target, F.lit("&#(?:[xX][0-9a-fA-F]{1,4}|[0-9]{1,5});"), F.lit(0)))
    code = lambda e: F.when(F.lower(e).startswith("&#x"), F.conv(F.regexp_extract(e, "[xX]([0-9a-fA-F]+)", 1), 16, 10)).otherwise(F.regexp_extract(e, "([0-9]+)", 1)).cast("int")
    numbers = F.aggregate(found, target, lambda acc, e: F.when(code(e).between(33, 126), F.replace(acc, e, F.char(code(e)))).otherwise(acc))
    return F.replace(numbers, F.lit("&amp;"), F.lit("&"))


def _targets(html: Column) -> Column:
    """Raw targets of canonical links and meta refreshes."""
    links = F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    links = F.filter(links, lambda x: x.rlike(r"(?i)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))
    href = F.transform(links, lambda x: F.regexp_extract(x, r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'>\s]+)", 1))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))
    metas = F.filter(metas, lambda x: x.rlike(r"(?i)http-equiv\s*=\s*[\"']?refresh"))
    go = F.transform(metas, lambda x: F.regexp_extract(x, r"(?i)\burl\s*=\s*[\"']?\s*([^\"'>\s]+)", 1))
    return F.filter(F.concat(href, go), lambda x: x != "")


def _straight(url: Column) -> Column:
    """An absolute url without . and .. segments in its path."""
    origin, path, rest = (F.regexp_extract(url, r"(?s)^([^:]+://[^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3))
    parts = F.split(path, "/")
    step = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(1), F.size(acc) - 1))).when(p == ".", acc).otherwise(F.concat(acc, F.array(p)))
    straight = F.concat(F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"), F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(origin, straight, rest)).otherwise(url)


def _absolute(target: Column, page: Column) -> Column:
    """An absolute url for a link target on a page."""
    scheme, origin = F.regexp_extract(page, r"(?s)^(.*?:)//", 1), F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(page, r"(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(origin, target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("?"), F.concat(F.regexp_extract(page, r"(?s)^([^?#]*)", 1), target))
        .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def resolve(rows: DataFrame, target: str, page: str) -> DataFrame:
    """rows with the column `target` made absolute, column by column, so that no expression contains another one several times."""
    rows = rows.withColumn(target, _decoded(F.col(target)))
    rows = rows.withColumn(target, _absolute(F.col(target), F.col(page)))
    return rows.withColumn(target, _straight(F.col(target)))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v): distinct urls that a redirect or canonical link makes one resource; a page may name itself, and v be null.

    Nothing is filtered here: a filter would be pushed down through all the steps, each with its expressions written out.
    """
    out = pages.filter(F.col(html).rlike(r"(?i)canonical|refresh") & F.col(url).contains("://"))
    out = out.select(F.col(url).alias("page"), _plain(F.col(html)).alias("html"))
    base = F.regexp_extract("html", r"(?is)<base\b[^>]*\bhref\s*=\s*[\"']?\s*([^\"'>\s]+)", 1)
    out = out.select("page", F.nullif(base, F.lit("")).alias("base"), F.explode(_targets(F.col("html"))).alias("target"))
    out = resolve(out, "base", "page").withColumn("base", F.coalesce("base", "page"))
    return resolve(out, "target", "base").select(identity(F.col("page")).alias("u"), identity(F.col("target")).alias("v")).distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, edges: DataFrame | None = None, url: str = "url", html: str = "html", page_id: str = "page_id") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, component (its least alias, if it has any)."""
    edges = cut(edges if edges is not None else alias_edges(pages, url, html), "alias-edges")
    nodes = components(edges)
    host, path = split_url(F.col("node"))
    fits = rule_column(host, path, rules)["action"] == "block"
    blocked = nodes.withColumn("block", F.coalesce(fits, F.lit(False))).groupBy("component").agg(F.max("block").alias("blocked"))
    nodes = cut(cut(nodes, "nodes").join(cut(blocked, "blocked"), "component").select("node", "component", "blocked"), "aliases")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    host, path = split_url(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path}).withColumn("fits", rule_column(F.col("host"), F.col("path"), rules))
    # Urls without an identity match nothing, each under a number of its own, so that they do not meet in one task.
    rows = rows.withColumn("self", F.coalesce(identity(F.col("url")), F.monotonically_increasing_id().cast("string"))).drop("url")
    rows = rows.join(nodes, F.col("self") == F.col("node"), "left")
    verdict = F.coalesce(F.col("fits.action"), F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "component")
