"""URL filters whose block decisions reach all aliases of a page.

Rules (allow or block a host and its subdomains, from a path prefix on; the longest that
fits wins) judge addresses.  Redirects (meta refresh, or a table of them) and canonical
links make addresses aliases of each other; their classes are the connected components
over all such edges.  An address that no rule fits takes the verdict of its class: allow
if a member is explicitly allowed, else block if a member is explicitly blocked, else
allow.  A rule that fits an address itself always decides it, so an explicit allow is
never overruled by a block that arrives through an alias.

The identity of an address is its host, path and query: scheme and fragment don't count.
Links are decoded (``&amp;``) and resolved against the page's address by RFC 3986.
Targets that are not pages themselves are judged by the rules as well.

Defined results: a null address or one without ``://`` has an empty host and path, fits
no rule, has no aliases and is allowed; null pages have no links; repeated rows are
aliases of themselves and get the same verdict; an empty table gives an empty result;
further columns pass through, the columns that are added replace those of the same name.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segspark.llm._components import connected_components
from segspark.llm._hot import hot_keys, join_unique
from segspark.llm._scratch import materialize


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)(\\?[^#]*)?"
_CANONICAL = "(?is)<link\\b(?=[^>]*\\brel\\s*=\\s*[\"']?canonical\\b)[^>]*?\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)[^>]*"
_REFRESH = "(?is)<meta\\b(?=[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b)[^>]*?\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)[^>]*"


_SCHEME = re.compile("[A-Za-z][A-Za-z0-9+.-]*:")
_AUTHORITY = re.compile("//([^/?]*)(.*)", re.DOTALL)


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, group), F.lit(""))


def url_host(url: Column) -> Column:
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return _part(url, 2)


def url_key(url: Column) -> Column:
    """Host, path and query of an address; null if it has no host."""
    host = url_host(url)
    return F.when(host != "", F.concat(host, url_path(url), _part(url, 3)))


def resolve(host: str, path: str, link: str) -> str | None:
    """The address that ``link``, as written in an attribute of a page, points to by RFC 3986:
    ``x://`` with host, path without dot segments and query; null if it has no host.

    A link is absolute only if it begins with a scheme and ``://``; links of other schemes
    have no host, and one that is empty but for its fragment is the page itself."""
    link = html.unescape(link).strip(" \t\n\f\r").partition("#")[0]
    if not link or not host:
        return None
    scheme = _SCHEME.match(link)
    if scheme:
        link = link[scheme.end() :]
        if not link.startswith("//"):
            return None
    if link.startswith("//"):
        host, link = _AUTHORITY.match(link).groups()
    elif link.startswith("?"):
        link = path + link
    elif not link.startswith("/"):
        link = (path[: path.rfind("/") + 1] or "/") + link
    link, mark, query = link.partition("?")
    kept: list[str] = []
    parts = link.split("/")[1:]
    for part in parts:
        if part == "..":
            kept = kept[:-1]
        elif part != ".":
            kept.append(part)
    if parts and parts[-1] in (".", ".."):
        kept.append("")
    return f"x://{host}{'/' if parts else ''}{'/'.join(kept)}{mark}{query}"


def _resolved(host: Column, path: Column, link: Column) -> Column:
    def all_of(hosts: pd.Series, paths: pd.Series, links: pd.Series) -> pd.Series:
        return pd.Series([resolve(*x) for x in zip(hosts, paths, links)], dtype=object)

    return F.pandas_udf(all_of, "string")(host, path, link)


def judge(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits as a struct (rule, verdict); null if none fits."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges (``a``, ``b``) between address keys: all canonical links and refreshes in
    ``html``, and rows of ``redirects`` (``source``, ``target``)."""
    url, body = F.col("url"), F.col("html")
    found = lambda word, pattern: F.when(F.contains(F.lower(body), F.lit(word)), F.regexp_extract_all(body, F.lit(pattern), F.lit(1))).otherwise(F.array().cast("array<string>"))
    links = F.concat(found("canonical", _CANONICAL), found("http-equiv", _REFRESH))
    edges = pages.select("url", F.explode(links).alias("link")).filter("link <> ''").select(url_key(url).alias("a"), url_key(_resolved(url_host(url), url_path(url), F.col("link"))).alias("b"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select(url_key(F.col("source")).alias("a"), url_key(F.col("target")).alias("b")))
    return edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct()


def url_filter(pages: DataFrame, rules: list[UrlRule] | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` without its html, with ``host, path, rule, verdict`` and ``via_alias``
    (the verdict came through the class)."""
    rules = RULES if rules is None else rules
    classes = materialize(connected_components(alias_edges(pages, redirects)), "aliases")
    # The key starts with host and path, so it can be judged by itself.
    said = judge(url_host(F.concat(F.lit("x://"), F.col("node"))), url_path(F.concat(F.lit("x://"), F.col("node"))), rules)
    judged = classes.withColumn("said", said["verdict"])
    votes = judged.groupBy("component").agg(F.bool_or(F.col("said") == "allow").alias("allow"), F.bool_or(F.col("said") == "block").alias("block"))
    spread = votes.withColumn("spread", F.when(F.coalesce("allow", F.lit(False)), "allow").when(F.coalesce("block", F.lit(False)), "block")).filter("spread IS NOT NULL")
    by_node = classes.join(spread, "component").select(F.col("node").alias("_key"), "spread")
    added = ("host", "path", "rule", "verdict", "via_alias", "html")
    own = [c for c in pages.columns if c not in added or c == "url"]
    said = judge(F.col("host"), F.col("path"), rules)
    mine = pages.select(*(F.col(f"`{c}`") for c in own), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), url_key(F.col("url")).alias("_key"))
    mine = mine.withColumn("_said", said)
    # Pages that a rule decides, and those without an address, need no class.
    alone = F.col("_said").isNotNull() | F.col("_key").isNull()
    rest = mine.filter(~alone)
    spread = materialize(by_node.withColumnRenamed("_key", "_node"), "spread")
    rest = join_unique(rest, "_key", spread, "_node", hot_keys(rest, "_key", rest.count()))
    joined = mine.filter(alone).withColumn("spread", F.lit(None).cast("string")).unionByName(rest)
    return joined.select(
        *(F.col(f"`{c}`") for c in own),
        "host",
        "path",
        F.col("_said.rule").alias("rule"),
        F.coalesce("_said.verdict", "spread", F.lit("allow")).alias("verdict"),
        (F.col("_said").isNull() & F.col("spread").isNotNull()).alias("via_alias"),
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "via_alias")


OP1_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)?', 1) AS query
  FROM pages
), tags AS (
  SELECT host, path, query, unnest(regexp_extract_all(coalesce(html, ''), '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM p WHERE host <> ''
), links AS (
  SELECT host, path, query, CASE
    WHEN regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) ELSE '' END AS link
  FROM tags
), decoded AS (
  SELECT host, path, query, regexp_replace(replace(replace(replace(replace(replace(link, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '(?s)#.*$', '') AS link FROM links
), targets AS (
  SELECT host || path || query AS a, CASE
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN regexp_replace(link, '^[A-Za-z][A-Za-z0-9+.-]*:', '')
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(link, '//') THEN link
    WHEN starts_with(link, '/') THEN '//' || host || link
    WHEN starts_with(link, '?') THEN '//' || host || path || link
    ELSE '//' || host || coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/') || link END AS url
  FROM decoded WHERE link <> ''
), split AS (
  SELECT a, translate(regexp_extract(url, '^//([^/?]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
         string_split(regexp_extract(url, '(?s)^//[^/?]*/([^?]*)', 1), '/') AS parts, starts_with(regexp_extract(url, '(?s)^//[^/?]*(.*)', 1), '/') AS rooted, regexp_extract(url, '(?s)(\?.*)$', 1) AS q
  FROM targets WHERE url IS NOT NULL
), edges AS (
  SELECT a, h || CASE WHEN rooted THEN '/' || array_to_string(list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(CASE WHEN parts[-1] IN ('.', '..') THEN list_append(parts, '') ELSE parts END, lambda x: [x])),
         lambda acc, x: CASE WHEN x[1] = '..' THEN acc[:-2] WHEN x[1] = '.' THEN acc ELSE list_concat(acc, x) END), '/') ELSE '' END || q AS b
  FROM split WHERE h <> ''
), both_ways AS (
  SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b
), reach AS (
  SELECT a AS node, a AS other FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON r.other = e.a
), rules(rule, verdict, rhost, rpath) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
         ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')
), votes AS (
  SELECT node, bool_or(v = 'allow') AS allow, bool_or(v = 'block') AS block FROM (
    SELECT node, other, arg_max(verdict, length(rule)) AS v FROM (
      SELECT DISTINCT node, other, regexp_extract(other, '^([^/?#]*)', 1) AS h, regexp_extract(other, '^[^/?#]*([^?#]*)', 1) AS pa FROM reach
    ) JOIN rules ON (h = rhost OR ends_with(h, '.' || rhost)) AND starts_with(pa, rpath) GROUP BY node, other
  ) GROUP BY node
), own AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path
)
SELECT page_id, p.host, p.path, own.rule,
       coalesce(own.verdict, CASE WHEN votes.allow THEN 'allow' WHEN votes.block THEN 'block' END, 'allow') AS verdict,
       own.rule IS NULL AND coalesce(votes.allow OR votes.block, FALSE) AS via_alias
FROM p LEFT JOIN own ON p.host = own.host AND p.path = own.path
LEFT JOIN votes ON p.host <> '' AND p.host || p.path || p.query = votes.node
"""
