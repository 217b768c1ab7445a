"""Judging web addresses by rules, and by what they redirect to or name as canonical.

A rule (host, path) fits its host and all subdomains where the address's path starts with the rule's; the longest one
that fits decides. An address without a rule takes the decision of its class: redirects and canonical links join
addresses into classes (connected components over written tables, DataFrame operations alone). A class with an
explicitly allowed address is allowed; else one with a blocked address is blocked; else it is allowed. Targets are
judged by the rules as well, crawled or not.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .near_dedup import components, sent

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The ? and what follows it up to # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """struct(len, name, verdict) of the longest rule that fits; null without one. At equal length, the greater name."""
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(len(r.name)).alias("len"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
        for r in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<len:int,name:string,verdict:string>")


def address(host: Column, path: Column, query: Column) -> Column:
    """What tells pages apart: scheme and fragment don't count, an empty path is /."""
    return F.concat(host, F.when(path == "", "/").otherwise(path), query)


def node(address_: Column) -> Column:
    """128 bits that stand for an address."""
    return F.struct(F.xxhash64(address_).alias("a"), F.xxhash64(F.lit("node"), address_).alias("b"))


def links_of(html: Column) -> Column:
    """The targets, as written, of a page's canonical links and immediate or timed refreshes."""
    html = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), 0)
    value = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""

    def bare(v: Column) -> Column:
        return F.regexp_replace(v, r"""^["']|["']$""", "")

    def attribute(tag: Column, name: str) -> Column:
        return bare(F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}{value}", 1))

    def target(tag: Column) -> Column:
        canonical = F.lower(attribute(tag, "rel")).rlike(r"(^|\s)canonical(\s|$)") & F.lower(tag).startswith("<link")
        refresh = (F.lower(attribute(tag, "http-equiv")) == "refresh") & F.lower(tag).startswith("<meta")
        # a content's url may stand in quotes of its own
        later = bare(F.trim(F.regexp_extract(attribute(tag, "content"), r"(?is)^[\s\d.]*[;,]\s*url\s*=\s*(.*)$", 1)))
        return F.when(canonical, attribute(tag, "href")).when(refresh, later)

    return F.filter(F.transform(tags, lambda t: F.trim(F.regexp_replace(target(t), "&amp;", "&"))), lambda t: t.isNotNull() & (t != ""))


def resolved(link: Column, host: Column, path: Column) -> Column:
    """A link's absolute address, taken from a page at host and path; null if it isn't a web address or only a fragment."""
    link = F.regexp_replace(link, r"(?s)#.*$", "")
    below = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    return (
        F.when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (link == ""), F.lit(None).cast("string"))
        .when(link.startswith("/"), F.concat(F.lit("http://"), host, link))
        .when(link.startswith("?"), F.concat(F.lit("http://"), host, path, link))
        .otherwise(F.concat(F.lit("http://"), host, F.when(below == "", "/").otherwise(below), link))
    )


def judged(url: Column, rules: Sequence[UrlRule]) -> Column:
    """struct(node, verdict) of an address."""
    host, path = host_of(url), path_of(url)
    return F.struct(node(address(host, path, query_of(url))).alias("node"), rule_for(host, path, rules)["verdict"].alias("verdict"))


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, redirects: DataFrame | None = None, key: str = "page_id", url: str = "url", html: str = "html", small: int = 50_000) -> DataFrame:
    """Of each row of pages: its key, host, path, rule (host and path of the rule that decides; null if none), verdict
    (allow or block) and aliased (whether a class has decided).

    redirects: (source, target) addresses known besides the pages' own refreshes and canonical links; rows with a null
    side are left out. A page without a host is in no class and allowed; null keys and repeated rows each give their
    row. Null html has no links. An empty table gives an empty one; other columns are ignored, whatever their names.
    small: most rows of a table sent to all executors; larger ones are joined by shuffles.
    """
    where = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(url).alias("url"), F.col(html).alias("html"))
    links = F.filter(F.transform(links_of(F.col("html")), lambda t: resolved(t, F.col("host"), F.col("path"))), lambda t: t.isNotNull())
    targets = F.when(F.col("host") != "", F.transform(links, lambda t: judged(t, rules)))
    own = where.select("key", "host", "path", rule_for(F.col("host"), F.col("path"), rules).alias("rule"), F.when(F.col("host") != "", node(address(F.col("host"), F.col("path"), query_of(F.col("url"))))).alias("node"), targets.alias("targets"))
    own = staged(own, "url-pages")
    edges = own.filter("size(targets) > 0").select("node", F.explode("targets").alias("t")).select(F.col("node").alias("a"), F.col("t.node").alias("b"), F.col("t.verdict").alias("verdict"))
    said = own.filter("node is not null and rule is not null").select("node", F.col("rule.verdict").alias("verdict"))
    if redirects is not None:
        known = redirects.select("source", "target").filter("source is not null and target is not null")
        known = known.select(judged(F.col("source"), rules).alias("s"), judged(F.col("target"), rules).alias("t"))
        edges = edges.unionByName(known.select(F.col("s.node").alias("a"), F.col("t.node").alias("b"), F.col("t.verdict").alias("verdict")))
        said = said.unionByName(known.filter("s.verdict is not null").select("s.node", "s.verdict"))
    edges = staged(edges, "url-edges")
    said = said.unionByName(edges.filter("verdict is not null").select(F.col("b").alias("node"), "verdict"))
    said = said.groupBy("node").agg(F.max(F.col("verdict") == "allow").alias("allow"), F.max(F.col("verdict") == "block").alias("block"))
    comps = components(edges.filter("a <> b").select("a", "b"), small)
    few = comps.count() <= small
    classes = comps.withColumnRenamed("id", "node")
    decided = classes.join(said, "node").groupBy("comp").agg(F.max("allow").alias("allow"), F.max("block").alias("block"))
    decided = staged(classes.join(sent(decided, few), "comp").filter("allow or block").select("node", F.when(F.col("allow"), "allow").otherwise("block").alias("verdict")), "url-decided")
    by_class = sent(decided.withColumnRenamed("verdict", "of_class"), few)
    out = own.join(by_class, "node", "left")
    verdict = F.coalesce("rule.verdict", "of_class", F.lit("allow"))
    return out.select(F.col("key").alias(key), "host", "path", F.col("rule.name").alias("rule"), verdict.alias("verdict"), (F.col("rule").isNull() & F.col("of_class").isNotNull()).alias("aliased"))
