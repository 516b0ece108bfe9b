"""Operator 3: URL filters with redirect equivalence.  DataFrame functions only.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased;
path: from there up to ``?``, ``#`` or the end.  A rule (action, host, path prefix) fits its
host and all subdomains; the longest fitting rule decides.

Pages without a rule follow their aliases.  Addresses are nodes (host, path and query;
scheme and fragment left out); edges are canonical links (``<link rel="canonical">``),
refresh redirects (``<meta http-equiv="refresh">``) and any further (source, target) pairs
given.  Connected components of the edges, found by distributed star contraction, share
their explicit decisions: ``allow`` if any address of the component has an explicit allow,
else ``block`` if any has an explicit block, else ``allow``.  A page's own rule always wins.

Rules are joined by key, not compared one by one: a page looks up the suffixes of its host
among the rules' hosts, and of the rules found keeps the longest that its path starts with.

Defined cases: a null url or one without ``://`` has empty host and path, no rule and no
alias (verdict allow); relative or foreign canonical links resolve against the page or are
addresses of their own; equal rules keep ``allow`` before ``block``; rows that repeat are each
judged; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clinloom.llm.catalog import query, table
from clinloom.llm.shared import components, materialise

# the query's rules: fixed values
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_LINK = r"(?is)<link\b[^>]*>"
_META = r"(?is)<meta\b[^>]*>"
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)\bcontent\s*=\s*["']?[^"'>]*?;\s*url\s*=\s*['"]?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), *_LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """The address of a url: host, path and query; null without ``://``."""
    query_part = F.regexp_extract(_rest(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(host(url), path(url), query_part))


def resolve(link: Column, base: Column) -> Column:
    """An absolute url for a link found on page ``base``."""
    scheme = F.regexp_extract(base, r"^[^:]*:", 0)
    origin = F.regexp_extract(base, r"^[^:]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (F.when(F.instr(link, "://") > 0, link)
            .when(link.startswith("//"), F.concat(scheme, link))
            .when(link.startswith("/"), F.concat(origin, link))
            .when(F.length(link) > 0, F.concat(F.when(folder.endswith("/"), folder)
                                               .otherwise(F.concat(folder, F.lit("/"))), link)))


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target) addresses from canonical links and refresh redirects of the pages' html."""
    html = F.col("html")
    marked = pages.filter("url is not null and html is not null").filter(
        F.lower(html).contains("canonical") | F.lower(html).contains("http-equiv"))

    def tags(pattern: str, wanted: str, value: str) -> Column:
        found = F.filter(F.regexp_extract_all(html, F.lit(pattern), F.lit(0)), lambda t: t.rlike(wanted))
        return F.transform(found, lambda t: F.regexp_extract(t, value, 1))

    links = F.concat(tags(_LINK, r"""(?is)\brel\s*=\s*["']?canonical\b""", _HREF),
                     tags(_META, r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b""", _REFRESH))
    out = marked.select("url", F.explode(links).alias("link")).filter("link <> ''")
    return out.select(node(F.col("url")).alias("source"), node(resolve(F.col("link"), F.col("url"))).alias("target"))


def judge(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """``addresses`` (key, host, path) with the longest fitting rule: key, rule, action (of those that have one)."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffix = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))
    looked = addresses.filter("host <> ''").select("key", "path", F.explode(suffix).alias("rule_host"))
    fit = looked.join(rules.withColumnRenamed("host", "rule_host").withColumnRenamed("path", "prefix"), "rule_host") \
        .filter(F.col("path").startswith(F.col("prefix")))
    rule = F.concat("rule_host", "prefix")
    return (fit.groupBy("key").agg(F.max(F.struct(F.length(rule).alias("l"), F.length("rule_host").alias("h"),
                                                  (F.col("action") == "allow").alias("ok"), rule.alias("rule"),
                                                  F.col("action").alias("action"))).alias("best"))
            .select("key", "best.rule", "best.action"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, edges: DataFrame | None = None,
                id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_of) per row; ``edges`` adds (source, target) urls."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                         F.col(html_col).cast("string").alias("html"))
    # a list given by the caller: a few rows of the plan
    book = spark.createDataFrame([(a, h, p) for a, h, p in rules], "action string, host string, path string") \
        .groupBy("host", "path").agg(F.min("action").alias("action"))
    links = page_links(pages)
    if edges is not None:
        links = links.unionByName(edges.select(node(F.col("source")).alias("source"), node(F.col("target")).alias("target")))
    links = materialise(links.filter("source is not null and target is not null and source <> target").distinct(),
                        "op3-links")
    roots = materialise(components(links, "op3", "source", "target"), "op3-roots")
    own = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                       node(F.col("url")).alias("node"))
    places = own.select("host", "path").distinct().withColumn("key", F.struct("host", "path"))
    ruled = judge(places, book).select("key.host", "key.path", "rule", "action")
    # explicit decisions of every address in a component, pages or not
    spots = roots.select("root", F.regexp_extract("node", r"^[^/?#]*", 0).alias("host"),
                         F.regexp_extract("node", r"^[^/?#]*([^?#]*)", 1).alias("path"))
    spots = spots.withColumn("key", F.struct("root", "host", "path"))
    fate = (judge(spots, book).groupBy("key.root")
            .agg(F.min("action").alias("fate")))                    # 'allow' sorts before 'block'
    alias = roots.join(fate, "root", "left").select("node", F.col("root").alias("alias_of"), "fate")
    out = own.join(ruled, ["host", "path"], "left").join(alias, "node", "left")
    return out.select("page_id", "host", "path", "rule",
                      F.coalesce("action", "fate", F.lit("allow")).alias("verdict"), "alias_of")


_SQL = """
WITH RECURSIVE rules(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
p AS (
  SELECT page_id, url, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
own AS (
  SELECT row_number() OVER () AS rid, page_id, url, html, rest,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(rest, '^[^?#]*(\\?[^#]*)?', 1) AS q
  FROM p),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*>')) AS tag, 1 AS kind FROM own WHERE rest IS NOT NULL
  UNION ALL
  SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*>')), 2 FROM own WHERE rest IS NOT NULL),
links AS (
  SELECT url, CASE WHEN kind = 1 THEN regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)
    ELSE regexp_extract(tag, '(?is)\\bcontent\\s*=\\s*["'']?[^"''>]*?;\\s*url\\s*=\\s*[''"]?([^"''\\s>]+)', 1) END AS link
  FROM tags
  WHERE (kind = 1 AND regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?canonical\\b'))
     OR (kind = 2 AND regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b'))),
absolute AS (
  SELECT url, CASE WHEN strpos(link, '://') > 0 THEN link
      WHEN starts_with(link, '//') THEN regexp_extract(url, '^[^:]*:') || link
      WHEN starts_with(link, '/') THEN regexp_extract(url, '^[^:]*://[^/?#]*') || link
      ELSE regexp_extract(url, '^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)', 1)
        || CASE WHEN ends_with(regexp_extract(url, '^([^:]*://[^/?#]*(?:/[^?#]*/|/)?)', 1), '/') THEN '' ELSE '/' END || link END AS target
  FROM links WHERE link <> ''),
ends AS (
  SELECT u, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(r, '^[^/?#]*([^?#]*)', 1) || regexp_extract(r, '^[^?#]*(\\?[^#]*)?', 1) AS node
  FROM (SELECT DISTINCT u, substr(u, strpos(u, '://') + 3) AS r
        FROM (SELECT url AS u FROM absolute UNION ALL SELECT target FROM absolute) WHERE strpos(u, '://') > 0)),
edge AS (
  SELECT DISTINCT s.node AS a, t.node AS b FROM absolute x JOIN ends s ON s.u = x.url JOIN ends t ON t.u = x.target
  WHERE s.node <> t.node),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(node, other) AS (
  SELECT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
member AS (SELECT node, min(other) AS root FROM reach GROUP BY node),
spot AS (
  SELECT DISTINCT root, regexp_extract(node, '^[^/?#]*') AS host, regexp_extract(node, '^[^/?#]*([^?#]*)', 1) AS path FROM member),
place AS (SELECT DISTINCT host, path FROM own UNION SELECT DISTINCT host, path FROM spot),
fit AS (
  SELECT host, path, rhost || rpath AS rule, action,
    row_number() OVER (PARTITION BY host, path ORDER BY length(rhost || rpath) DESC) AS r
  FROM place JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) AND host <> ''),
best AS (SELECT host, path, rule, action FROM fit WHERE r = 1),
fate AS (SELECT root, min(action) AS fate FROM spot JOIN best USING (host, path) GROUP BY root)
SELECT o.page_id, o.host, o.path, b.rule, coalesce(b.action, f.fate, 'allow') AS verdict, m.root AS alias_of
FROM own o LEFT JOIN best b ON b.host = o.host AND b.path = o.path
LEFT JOIN member m ON o.rest IS NOT NULL AND m.node = o.host || o.path || o.q
LEFT JOIN fate f ON f.root = m.root
"""


@query("op3_url_filters", _SQL)
def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` url under the fixed rules."""
    return filter_urls(table(spark, sf_dir, "pages"))
