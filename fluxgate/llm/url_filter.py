"""URL verdicts by rules and redirect equivalence [native]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower
from .graph import components

#: (verdict, host, path): a rule fits its host and all subdomains, below its path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_ATTR = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty without ``://``.  Host: A-Z lower-cased."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return ascii_lower(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null: a CASE over
    the rules, longest first."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path or an address without its ``.`` and ``..`` segments."""
    head = F.regexp_extract(path, r"(?s)^([^/?#]*://[^/?#]*)?", 0)
    tail = F.regexp_extract(path, r"(?s)[?#].*$", 0)
    parts = F.split(F.substring(path, F.length(head) + 1, F.length(path) - F.length(head) - F.length(tail)), "/")
    # the first part is empty: it stands for the root, above which nothing is
    kept = lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(x)))
    out = F.aggregate(parts, F.array().cast("array<string>"), kept)
    out = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(out, F.array(F.lit("")))).otherwise(out)
    return F.when(path.rlike(r"^[^?#]*/\.\.?(?:[/?#]|$)"), F.concat(head, F.array_join(out, "/"), tail)).otherwise(path)


def node_key(url: Column) -> Column:
    """What two spellings of one address share: host, path without dot segments and
    closing slash, and query; scheme, fragment and default port do not count.  Null for no URL."""
    host, path = split_url(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(F.locate("://", url) > 0, F.concat(F.regexp_replace(host, r":(80|443)$", ""), F.regexp_replace(without_dots(path), r"/+$", ""), query))


def resolve(base: str, link: str) -> Column:
    """The absolute form of the link in a column, found in the page of a column; dot
    segments stay."""
    base, link = F.col(base), F.col(link)
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    own = F.regexp_extract(base, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when((link == "") | link.startswith("#"), F.lit(None).cast("string"))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(own, link))
        .when(folder.endswith("/"), F.concat(folder, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def page_links(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(url, target): canonical links and meta refreshes of the pages' HTML.  The few
    raw links are written first; one expression for all would be too long to compile."""
    html = F.col("html").cast("string")
    # a tag ends before the next one begins, so even unclosed ones are read once
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^<>]*+>"), F.lit(0))
    canonical = lambda t: t.rlike(r"(?is)^<link.*\brel\s*+=\s*+[\"']?canonical\b")
    refresh = lambda t: t.rlike(r"(?is)^<meta.*\bhttp-equiv\s*+=\s*+[\"']?refresh\b")
    tags = F.filter(tags, lambda t: canonical(t) | refresh(t))
    found = pages.select(F.col("url").cast("string").alias("url"), F.explode(tags).alias("tag"))
    href = F.concat(*[F.regexp_extract("tag", rf"(?i)\bhref{_ATTR}", i) for i in (1, 2, 3)])
    moved = F.regexp_extract("tag", r"""(?i)\burl\s*=\s*['"]?([^'">\s]+)""", 1)
    link = F.regexp_replace(F.when(F.col("tag").rlike("(?i)^<link"), href).otherwise(moved), "&amp;", "&")
    raw = scratch.keep(found.select("url", F.trim(link).alias("link")).distinct(), "raw")
    return raw.select("url", resolve("url", "link").alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, redirects: DataFrame | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for each row of ``pages``
    (page_id, url, html).

    A url that a rule fits has that rule's verdict: an explicit allow stays an allow
    among blocked aliases, and a block stays a block.  The method judges the others.
    Urls are nodes as they are written.  Edges are canonical links, meta refreshes, the
    given ``redirects`` (url, target), and for every url that has another spelling among
    the pages or links, one to the spelling that they share (see ``node_key``).  The
    connected components over these edges are found by distributed contraction; nodes
    are told apart by 128 bits.  In a component, an explicit allow has precedence over
    blocks; without one, a block reaches all aliases; else: allow.  component is the
    url's component, null where it has no alias.

    A null url, or one without ``://``, has empty host and path, no rule and no
    alias, and is allowed.  A link target need not be a page: its own rule counts
    in its component.  Repeated rows come out repeated.  Many pages of one url are
    one row in the graph.  HTML of any length is read in one pass; a tag that holds
    another < or is never closed links nothing.  Columns beyond the three are ignored."""
    scratch = Scratch(pages.sparkSession, "url")
    url = F.col("url").cast("string")
    node = lambda c: F.unhex(F.md5(c.cast("binary")))
    links = page_links(pages, scratch)
    if redirects is not None:
        links = links.unionByName(redirects.select(F.col("url").cast("string").alias("url"), F.col("target").cast("string").alias("target")))
    links = links.distinct().select("url", without_dots(F.col("target")).alias("target")).where((F.locate("://", "url") > 0) & (F.locate("://", "target") > 0))
    links = scratch.keep(links.distinct(), "links")

    # each written url once, with the spelling that it shares with others
    urls = pages.select(url.alias("url")).union(links.select("url")).union(links.select("target")).where(F.locate("://", "url") > 0).distinct()
    urls = scratch.keep(urls.withColumn("key", node_key(F.col("url"))), "urls")
    spelled = urls.groupBy("key").agg(F.min("url").alias("least"), F.max("url").alias("most")).where("least < most").select("key")
    same = urls.join(spelled, "key").select(node(F.col("url")).alias("a"), node(F.concat(F.lit("spelling "), F.col("key"))).alias("b"))
    label = components(links.select(node(F.col("url")).alias("a"), node(F.col("target")).alias("b")).unionByName(same), scratch)

    h, p = split_url(F.col("url"))
    said = urls.select(node(F.col("url")).alias("id"), rule_for(h, p, rules)["verdict"].alias("v")).where("v is not null")
    groups = said.join(label, "id").groupBy("label").agg(F.max((F.col("v") == "allow").cast("int")).alias("allowed"), F.max((F.col("v") == "block").cast("int")).alias("blocked"))
    fate = label.join(groups, "label", "left").select("id", F.col("label").alias("component"), "allowed", "blocked")

    host, path = split_url(url)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), node(url).alias("id")).withColumn("own", rule_for(F.col("host"), F.col("path"), rules))
    out = judged.join(fate, "id", "left")
    method = F.when((F.col("blocked") == 1) & (F.col("allowed") == 0), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce(F.col("own.verdict"), method).alias("verdict"), F.hex("component").alias("component"))
