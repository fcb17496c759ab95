"""URL filtering by host and path rules, with block decisions shared by redirect-equivalent addresses.

Only DataFrame functions. Rules decide a page where one fits. Pages without a rule take the block of any address that
redirects to them or that they redirect to, directly or over others: the edges are a page's canonical link, its
meta-refresh target and its own address without fragment, tracking parameters and final slash, and a distributed
connected-components run joins them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower
from .components import connected_components


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for ``host`` with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Query parameters that do not change the page behind an address.
TRACKING = ("utm_[a-z]+", "ref", "gclid", "fbclid", "sessionid")
_LINK = r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?([^\"'\s>]+)"
_BASE = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' for null or no ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def address_of(url: Column) -> Column:
    """The address that stands for ``url``: host, path and query without scheme, fragment, tracking parameters and a
    final slash. Null where there is no host."""
    query = F.regexp_extract(url, r"://[^?#]*(\?[^#]*)", 1)
    for name in TRACKING:
        query = F.regexp_replace(query, rf"(?i)(?<=[?&]){name}=[^&]*(&|$)", "")
    query = F.regexp_replace(query, "[?&]$", "")
    whole = F.concat(host_of(url), F.regexp_replace(path_of(url), "/$", ""), query)
    return F.when(host_of(url) != "", whole)


def rule_of(host: Column, path: Column, rules: list[Rule], what: str = "name") -> Column:
    """The longest fitting rule's name or verdict, null where none fits. Of equally long ones the first listed wins."""
    out = F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(getattr(rule, what))).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """An absolute path with its ``.`` and ``..`` parts resolved."""
    parts = F.split(path, "/")

    def step(done: Column, part: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == "..", shorter).when(part == ".", done).otherwise(F.concat(done, F.array(part)))

    left = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array().cast("array<string>"), step)
    end = F.when(path.rlike(r"/\.\.?$") & (F.size(left) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(left, "/"), end)


def resolve(target: Column, base: Column) -> Column:
    """The address that ``target`` names on a page at ``base``: a whole one, or one relative to the scheme, the host, the
    folder or the page."""
    host = lambda url: F.regexp_extract(url, "^([^:]*://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(base), "(?s)^(.*/)", 1)
    whole = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), target).when(target.startswith("//"), F.concat(F.lit("http:"), target)).when(target.startswith("/"), F.concat(host(base), target))
        .when(target.startswith("?"), F.concat(host(base), path_of(base), target)).when(target.startswith("#"), F.concat(F.regexp_replace(base, "(?s)#.*", ""), target))
        .otherwise(F.concat(host(base), F.when(folder == "", "/").otherwise(folder), target))
    )
    plain = F.concat(host(whole), without_dots(path_of(whole)), F.regexp_extract(whole, r"(?s)://[^?#]*([?#].*)$", 1))
    return F.when(path_of(whole).contains("/."), plain).otherwise(whole)


#: Comments and scripts, up to the end of the page where they are not closed; and the references that hide in addresses.
UNSEEN = r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)"
REFERENCES = (("(?i)&(?:quot|#0*34|#x0*22);", '"'), ("(?i)&(?:apos|#0*39|#x0*27);", "'"), ("(?i)&(?:amp|#0*38|#x0*26);", "&"))


def decoded(target: Column) -> Column:
    """An attribute's value with its references to &, " and ' resolved, once."""
    for pattern, char in REFERENCES:
        target = F.regexp_replace(target, pattern, char)
    return target


def redirect_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) addresses of all canonical links and meta refreshes to another address. Relative targets are resolved
    against the page's ``base`` element, if it has one, and its url, after references such as ``&amp;`` are resolved. What
    stands in comments or scripts is no link. Targets of other schemes have no host and are dropped."""
    linked = pages.where(F.lower(F.col(html)).contains("canonical") | F.lower(F.col(html)).contains("refresh"))
    linked = linked.select(F.col(url).alias("url"), F.regexp_replace(F.col(html), UNSEEN, "").alias("html"))
    given = decoded(F.regexp_extract("html", _BASE, 1))
    base = F.when(given == "", F.col("url")).otherwise(resolve(given, F.col("url")))
    found = F.concat(*[F.regexp_extract_all("html", F.lit(pattern), 1) for pattern in (_LINK, _REFRESH)])
    held = linked.select(address_of(F.col("url")).alias("src"), base.alias("base"), F.array_distinct(F.transform(found, decoded)).alias("found"))
    edges = held.select("src", F.explode(F.transform("found", lambda t: resolve(t, F.col("base")))).alias("to"))
    edges = edges.select("src", address_of(F.col("to")).alias("dst"), F.col("to").alias("dst_url"))
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))


def judge(pages: DataFrame, rules: list[Rule], page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict, component) for every row of ``pages``.

    A page whose own address fits a rule has that rule's verdict: an allow rule holds against any alias. Another page is
    blocked if some address of its component (pages and link targets alike) is blocked by a rule, else allowed. Null or
    hostless urls fit no rule, have no aliases and are allowed. Repeated rows are judged each; an empty table gives no
    rows. Rules are a short configured list, compiled into one expression. Pages without a link to elsewhere never enter
    the components run, and blocked components are one row each, however many pages share them.
    """
    u = F.col(url)
    host, path = host_of(u), path_of(u)
    own = pages.select(
        F.col(page_id), host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"),
        rule_of(host, path, rules, "verdict").alias("own"), address_of(u).alias("address"),
    )
    edges = redirect_edges(pages, url, html)
    parts = connected_components(edges)
    target = F.col("dst_url")
    judged = own.select("address", "own").unionByName(
        edges.select(F.col("dst").alias("address"), rule_of(host_of(target), path_of(target), rules, "verdict").alias("own"))
    )
    blocked = judged.where(F.col("own") == "block").select("address").distinct()
    node = parts.select(F.col("node").alias("address"), "component")
    blocked = blocked.join(node, "address", "left").select(F.coalesce("component", "address").alias("component")).distinct()
    placed = own.join(node, "address", "left").withColumn("component", F.coalesce("component", "address"))
    out = placed.join(blocked.withColumn("hit", F.lit(True)), "component", "left")
    verdict = F.coalesce(F.col("own"), F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(page_id, "host", "path", "rule", verdict.alias("verdict"), "component")
