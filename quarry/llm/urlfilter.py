"""URL filters with redirect equivalence.

Rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest rule
that fits decides. Pages tell of aliases: canonical links and immediate refreshes in their html, and
redirects from a crawl if given. Connected components over these edges make alias groups, and a
decision on one address holds for the aliases that no rule fits: an allowed address in the group
allows them, else a blocked one blocks them, else they are allowed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import table, tune, written
from quarry.llm.components import connected_components

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; of equal lengths, a block.
    Rules are a parameter of some hundreds at most, compiled into one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[2] == "block")):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """What aliases are compared by: the host in lower case, the rest as it is, without a fragment."""
    scheme = F.translate(F.regexp_extract(url, "(?s)^(.*?)://", 1), _UPPER, _LOWER)
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host_of(url), F.when(rest == "", "/").otherwise(rest)))


#: What a scan of a page stops at; in elements of text, tags are none until the element ends.
_STOP = re.compile(r"<(?:!--|(script|style|textarea|title|link|meta|base)(?=[\s/>]))", re.I)
_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?)""")
_REFRESH = re.compile(r"""\s*0*(?:\.0*)?\s*[;,\s]\s*(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|(.*))""", re.I | re.S)


def _attributes(html: str, at: int) -> tuple[dict[str, str], int]:
    """A tag's attributes, the first of each name, their entities decoded, and the place after the tag.
    Quoted values may hold anything; a tag that does not end has none."""
    found: dict[str, str] = {}
    while m := _ATTRIBUTE.match(html, at):
        if m[1]:
            return found, m.end()
        found.setdefault(m[2].lower(), unescape(next((v for v in m.group(3, 4, 5) if v is not None), "")))
        at = max(m.end(), at + 1)
    end = html.find(">", at)
    return (found, end + 1) if end >= 0 else ({}, len(html))


def links_of(html: str) -> tuple[str | None, list[str]]:
    """A page's base address, if it names one, and the addresses that it calls its canonical one or goes
    on to at once. Comments, scripts, styles and other elements of text name none."""
    base, out, at = None, [], 0
    while m := _STOP.search(html, at):
        if not m[1]:
            at = html.find("-->", m.start() + 2) + 3
            if at < 3:
                break
            continue
        name, (tag, at) = m[1].lower(), _attributes(html, m.end())
        if name == "base":
            base = base or tag.get("href")
        elif name == "link":
            if "canonical" in tag.get("rel", "").lower().split() and tag.get("href"):
                out.append(tag["href"])
        elif name == "meta":
            if tag.get("http-equiv", "").lower() == "refresh" and (r := _REFRESH.match(tag.get("content", ""))):
                out.append(next(v for v in r.groups() if v is not None))
        elif end := re.compile(f"</{name}(?=[\\s/>])", re.I).search(html, at):
            at = end.end()
        else:
            break
    return base, out


def _targets(url: str, html: str) -> list[str]:
    """Links as absolute urls, seen from the page at `url`. What is no url of a host names nothing."""
    base, found = links_of(html)
    out = []
    for link in found:
        try:
            target = urljoin(urljoin(url, base.strip()) if base else url, link.strip())
        except ValueError:  # a host in brackets that is none
            continue
        if link.strip() and "://" in target:
            out.append(target)
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [(u, t) for u, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in _targets(u, html)]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], ["u", "t"])


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst) addresses of pages and of what they name as their canonical address or go on to."""
    url, html = F.col(url_col), F.col(html_col)
    names = html.ilike("%canonical%") | html.ilike("%http-equiv%")  # other pages stay out of Python
    rows = pages.filter(url.contains("://") & names).select(url.alias("u"), html.alias("h")).mapInArrow(_edges, "u string, t string")
    return rows.select(address(F.col("u")).alias("src"), address(F.col("t")).alias("dst")).filter("src is not null and dst is not null and src <> dst")


def group_verdicts(edges: DataFrame, rules=RULES) -> DataFrame:
    """(address, group_verdict) of every address in an edge: the group's decision, allow before block."""
    parts = written(connected_components(edges, "src", "dst"), "aliases")
    ruled = parts.withColumn("v", matched_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    groups = ruled.groupBy("root").agg(F.max(F.col("v") == "allow").alias("ok"), F.max(F.col("v") == "block").alias("bad"))
    groups = groups.select("root", F.when(F.col("ok"), "allow").when(F.col("bad"), "block").otherwise("allow").alias("group_verdict"))
    return parts.join(groups, "root").select(F.col("node").alias("address"), "group_verdict")


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, host, path, rule (null if none fits), verdict.

    A null url or one without :// has an empty host and path, no rule and no aliases, and is allowed.
    redirects: (src, dst) urls. Null html names no alias; tags that do not end, and links that are no url of a host, count for nothing. Repeated rows stay repeated; other columns are ignored; an empty
    table gives an empty result.
    """
    edges = alias_edges(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("src")).alias("src"), address(F.col("dst")).alias("dst")))
    groups = group_verdicts(edges, rules)
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), host_of(url).alias("host"), path_of(url).alias("path"), address(url).alias("address"))
    # rows without an address meet none, and are spread
    rows = rows.withColumn("address", F.coalesce("address", F.concat(F.lit("none "), F.monotonically_increasing_id().cast("string"))))
    rows = rows.withColumn("r", matched_rule(F.col("host"), F.col("path"), rules)).join(groups, "address", "left")
    verdict = F.coalesce(F.col("r.verdict"), F.col("group_verdict"), F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(tune(spark), sf_dir, "pages"))


OP3_SQL = r"""
WITH RECURSIVE parsed AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
    CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
      || CASE regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1) END END AS address
  FROM pages),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parsed),
bare AS (SELECT url, address, regexp_replace(html, '<!--.*?-->', '', 'gs') AS html FROM ruled WHERE contains(url, '://')),
tags AS (SELECT url, address, unnest(regexp_extract_all(html, '<(?:link|meta)\s(?:[^>"'']|"[^"]*"|''[^'']*'')*>', 0, 'is')) AS tag FROM bare),
linked AS (
  SELECT url, address AS a, replace(CASE
    WHEN regexp_matches(tag, '^<link', 'i') AND regexp_matches(tag, '\srel\s*=\s*["'']?canonical["''\s/>]', 'i') THEN regexp_extract(tag, '\shref\s*=\s*["'']?([^"''\s>]+)', 1, 'i')
    WHEN regexp_matches(tag, '^<meta', 'i') AND regexp_matches(tag, '\shttp-equiv\s*=\s*["'']?refresh["''\s/>]', 'i') THEN regexp_extract(tag, '\scontent\s*=\s*["'']?\s*0*\s*[;,]\s*url\s*=\s*["'']?([^"''>]+)', 1, 'i') END, '&amp;', '&') AS link
  FROM tags),
absolute AS (
  SELECT a, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link
    WHEN starts_with(link, '//') THEN regexp_extract(url, '^(.*?:)//', 1) || link
    WHEN starts_with(link, '/') THEN regexp_extract(url, '^(.*?://[^/?#]*)', 1) || link
    WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    ELSE regexp_replace(regexp_extract(url, '^(.*?://[^/?#]*(?:/[^?#]*/|/)?)', 1), '([^/])$', '\1/') || link END AS t
  FROM linked WHERE link <> ''),
met AS (
  SELECT a, translate(regexp_extract(t, '^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || CASE regexp_extract(t, '^.*?://[^/?#]*([^#]*)', 1) WHEN '' THEN '/' ELSE regexp_extract(t, '^.*?://[^/?#]*([^#]*)', 1) END AS b
  FROM absolute WHERE t IS NOT NULL),
edges AS (SELECT a, b FROM met UNION SELECT b, a FROM met),
known AS (SELECT a AS address FROM edges UNION SELECT address FROM ruled),
parts AS (
  SELECT address, regexp_extract(address, '^.*?://([^/?#]*)', 1) AS host, regexp_extract(address, '^.*?://[^/?#]*([^?#]*)', 1) AS path FROM known WHERE address IS NOT NULL),
seeds AS (SELECT address, CASE
      WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN true
      WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN false
      WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN true
      WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN false END AS ok
  FROM parts WHERE address IN (SELECT a FROM edges)),
reached AS (SELECT address, ok FROM seeds WHERE ok IS NOT NULL UNION SELECT edges.b, reached.ok FROM reached JOIN edges ON edges.a = reached.address),
decided AS (SELECT address, bool_or(ok) AS ok FROM reached GROUP BY address)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN NOT coalesce(decided.ok, true) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN decided USING (address)
"""
