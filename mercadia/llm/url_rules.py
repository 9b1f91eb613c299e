"""URL verdicts: rules by host and path, and block decisions propagated to aliases.

Pages are aliases if their URLs are equal once scheme, default port, fragment, tracking parameters
and a closing slash are set aside, or if redirects or canonical links join them through any chain.
Canonical links and refresh redirects are read from the pages' HTML; a table of observed redirects
(source, target) can be added. Targets that were never fetched are nodes too.

A rule decides every URL that it fits; the longest rule wins, and allow wins among equals. Without
a rule, a page takes its class of aliases' decision: allow if a rule allows any member, else block
if a rule blocks any, else allow. So an explicit allow has precedence over propagated blocks.

Classes come from distributed connected components; rules are joined on the host's suffixes, once
for each distinct host and path. Only aggregates per URL are shuffled, never the HTML, and equal
URLs fold before. A null URL or one without `://` has an empty host and path, fits no rule and has
no alias: it is allowed. Null ids and repeated rows pass through, each with its verdict; empty
tables give no rows; further columns are ignored. HTML of any length is read whole; of several canonical
links the first counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercadia.llm.components import components
from mercadia.llm.shared import Tables, broadcast_if_small

#: Host, path and verdict of the contract's rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
BROADCAST_ROWS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parameters that name the way to a page, not the page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"

CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\burl\s*=\s*["']?([^\s"'>]+)"""


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The URL without what does not name the page; null for a URL without `://`."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKING + "(=|$)")))
    host = F.regexp_replace(host_of(url), r":(80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    rest = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, rest))


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a whole URL."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    target = F.trim(F.regexp_replace(target, "&amp;", "&"))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target != "", F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def links_of(pages: DataFrame) -> DataFrame:
    """Rows (url, target): canonical links and refresh redirects in pages."""
    html = F.col("html")
    quoted = [F.regexp_extract(html, CANONICAL, k) for k in (1, 2, 3)]
    canonical = F.when(F.lower(html).contains("canonical"), F.concat(*quoted))
    refresh = F.when(F.lower(html).contains("refresh"), F.regexp_extract(html, REFRESH, 1))
    found = pages.select("url", F.explode(F.array(canonical, refresh)).alias("target")).filter("target <> ''")
    return found.select("url", resolved(F.col("target"), F.col("url")).alias("target")).filter("url is not null and target is not null")


def rule_table(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    return pages.sparkSession.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def ruled(places: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (host, path, rule, rule_verdict) for the distinct places that a rule fits."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))
    each = places.filter("host <> ''").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    fits = each.join(broadcast_if_small(rules, BROADCAST_ROWS), "rule_host").filter(F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    order = F.struct(F.length(name), (F.col("rule_verdict") == "allow"))
    return fits.groupBy("host", "path").agg(
        F.max_by(name, order).alias("rule"), F.max_by("rule_verdict", order).alias("rule_verdict")
    )


def verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, node, class_root) of all pages."""
    tables = Tables(pages.sparkSession, "urls")
    place = {"host": host_of, "path": path_of, "node": node_of}
    rows = tables.stored(pages.select("page_id", *(f(F.col("url")).alias(k) for k, f in place.items())))
    links = links_of(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("source").alias("url"), "target"))
    links = tables.stored(links.distinct())
    targets = links.select(*(f(F.col("target")).alias(k) for k, f in place.items()))
    edges = links.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"))
    sources = links.select(*(f(F.col("url")).alias(k) for k, f in place.items()))
    nodes = rows.select("host", "path", "node").union(targets).union(sources).filter("node is not null").distinct()
    decided = tables.stored(ruled(nodes.select("host", "path"), rules))
    roots = components(edges, tables).withColumnRenamed("root", "linked")
    classed = nodes.join(decided, ["host", "path"], "left").join(roots, "node", "left")
    classed = classed.select("node", F.coalesce("linked", "node").alias("class_root"), "rule_verdict")
    members = tables.stored(classed.groupBy("node", "class_root").agg(*said()))
    tables.drop(links)
    classes = members.groupBy("class_root").agg(F.bool_or("allows").alias("allows"), F.bool_or("blocks").alias("blocks"))
    passed_on = F.when(F.col("blocks") & ~F.col("allows"), "block").otherwise("allow")
    of_node = members.select("node", "class_root").join(classes.select("class_root", passed_on.alias("passed_on")), "class_root")
    return (
        rows.join(decided, ["host", "path"], "left")
        .join(of_node, "node", "left")
        .select(
            "page_id", "host", "path", "rule", F.coalesce("rule_verdict", "passed_on", F.lit("allow")).alias("verdict"),
            "node", "class_root",
        )
    )


def said() -> list[Column]:
    each = F.coalesce(F.col("rule_verdict"), F.lit(""))
    return [F.bool_or(each == "allow").alias("allows"), F.bool_or(each == "block").alias("blocks")]
