"""URL filter with redirect equivalence.

A page's url is judged by rules of (verdict, host, path): a rule fits its host and all subdomains when
the url's path starts with the rule's path, and the longest rule (host, then path) wins. Pages that no
rule fits take the decision of their aliases: urls are nodes, redirect and canonical-link edges join
them, and connected components carry decisions over. In a component with an explicitly allowed url its
unruled members are allowed; else, with an explicitly blocked one, they are blocked; else allowed. A rule
of a page's own always stands.

Edges of a page: its ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` targets, those relative to the
page's url included, and, as an option that is on by default, the address that its own url is commonly
redirected to (https, lower-case host without www. or m., path without a closing slash or .html, no
fragment, no utm_ parameters). That address is a convention, not an observed redirect: sites where such
urls are different pages need ``common=False``, or an ``edges`` table of observed redirects instead. Host:
after the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; path: then up to ``? #`` or the end. A null
url, or one without ``://``, has empty host and path, no rule and no edges, and is allowed. Rows that repeat
a url share its component, whatever their ids; other columns, whatever their names, are not read. All of
it is built-in functions; urls are joined by their 128-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import settle, small

#: Fixed values: (verdict, host, path) of the rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _lower(F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^(?:(?!://).)*://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The winning (verdict, rule) or null. The rules are a bounded list, so they are one expression."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]), len(r[2]))):  # later ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def common_form(url: Column) -> Column:
    """The address that a url is commonly redirected to; null for a url without ``://``."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:/|\.html?)$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.when(F.locate("://", url) > 0, F.concat(F.lit("https://"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def absolute(target: Column, url: Column) -> Column:
    """A link's target as seen from the page ``url``, which has a scheme."""
    scheme, site, folder = (F.regexp_extract(url, p, 1) for p in (r"(?s)^((?:(?!://).)*:)//", r"(?s)^((?:(?!://).)*://[^/?#]*)", r"(?s)^((?:(?!://).)*://[^/?#]*(?:/[^?#]*/|/)?)"))
    whole = F.when(target.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("/"), F.concat(site, target))
    return whole.when(target.rlike(r"^[?#]"), F.concat(F.regexp_extract(url, r"(?s)^([^?#]*)", 1), target)).otherwise(F.concat(folder, F.when(folder.endswith("/") & (folder != F.concat(scheme, F.lit("//"))), "").otherwise("/"), target))


def _attribute(html: Column, tag: str, url: Column) -> Column:
    """Targets of a kind of tag."""
    tags = F.regexp_extract_all(html, F.lit(tag), F.lit(0))
    return F.transform(F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)(?:href\s*=|url\s*=)\s*["']?\s*([^"'\s>]+)""", 1)), lambda u: u != ""), lambda u: absolute(u, url))


def edges_of(pages: DataFrame, url_col: str = "url", html_col: str = "html", common: bool = True) -> DataFrame:
    """(src, dst) urls of redirect and canonical-link edges, and, if ``common``, of the common form."""
    url, html = F.col(url_col), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    links = F.concat(_attribute(html, r"(?i)<link\s[^>]*rel\s*=\s*[\"']?canonical[^>]*>", url), _attribute(html, r"(?i)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*>", url))
    links = F.concat(links, F.array(common_form(url))) if common else links
    return pages.filter(F.locate("://", url) > 0).select(url.alias("src"), F.explode(links).alias("dst")).filter("src != dst")


def _node(url: Column) -> Column:
    return F.unhex(F.md5(url.cast("binary")))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: tuple = RULES, edges: DataFrame | None = None, common: bool = True) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict. ``edges``: more (src, dst) urls, such
    as a crawl's redirect log."""
    links = edges_of(pages, url_col, html_col, common)
    if edges is not None:
        links = links.unionByName(edges.select("src", "dst").dropna())
    # one edge more for each end: hosts and paths of urls that are only a link's target count for rules too
    links = settle(links.distinct(), "url-links")
    of = components(links.select(_node(F.col("src")).alias("a"), _node(F.col("dst")).alias("b")))
    of = settle(of, "url-components")
    ends = links.select(F.explode(F.array("src", "dst")).alias("url")).distinct()
    ruled = ends.select(_node(F.col("url")).alias("node"), rule_of(host_of(F.col("url")), path_of(F.col("url")), rules).alias("r")).filter("r IS NOT NULL")
    said = ruled.join(small(of), "node").groupBy("component").agg(F.bool_or(F.col("r.verdict") == "allow").alias("allow"))
    said = settle(said, "url-said")
    decided = settle(of.join(small(said), "component").select(F.col("node").alias("__node"), F.col("allow").alias("__allow")), "url-decided")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), _node(F.col("url")).alias("node"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    alias = F.when(F.col("__allow"), "allow").when(~F.col("__allow"), "block").otherwise("allow")
    return rows.join(small(decided), F.col("node") == F.col("__node"), "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", alias).alias("verdict"))
