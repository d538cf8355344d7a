"""URL verdicts by host and path rules, carried along redirects and canonical links."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.operators.components import connected_components
from gradus.plans.scratch import Scratch


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
BASE = r"""(?is)<base\b[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?["']?([^"'\s>]+)"""

#: What a browser doesn't read as tags: comments and the contents of elements that hold plain text.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title)\b.*?(?:</\1\s*>|\z)"
NAMED = {"amp;": "&", "lt;": "<", "gt;": ">", "quot;": '"', "apos;": "'"}


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """Host, path (a host's empty one is /) and query: what a link names. The fragment stays on the page."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    path = F.when((host_of(url) != "") & (path_of(url) == ""), "/").otherwise(path_of(url))
    return F.concat(host_of(url), path, query)


def without_entities(text: Column) -> Column:
    """Character references of a link decoded once: decimal, hexadecimal and the five of NAMED; others stay."""

    def decoded(part: Column) -> Column:
        hexa, deci = (F.regexp_extract(part, r, 1) for r in (r"^#[xX]0*([0-9A-Fa-f]{1,6});", r"^#0*([0-9]{1,7});"))
        code = F.when(hexa != "", F.conv(hexa, 16, 10)).when(deci != "", deci).cast("long")
        letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        out = F.when(valid, F.concat(letter, F.regexp_replace(part, r"^#[^;]*;", "")))
        for name, char in NAMED.items():
            out = out.when(part.startswith(name), F.concat(F.lit(char), F.substring(part, len(name) + 1, 2**31 - 1)))
        return out.otherwise(F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    rest = F.slice(parts, 2, F.size(parts) - 1)
    return F.concat(F.element_at(parts, 1), F.array_join(F.transform(rest, decoded), ""))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Name of the longest rule that fits, else null. Rules are a short fixed list and become one expression."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)).otherwise(out)
    return out


def verdict_of(rule: Column, rules: Sequence[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.name, F.lit(r.verdict)).otherwise(out)
    return out


def without_dots(path: Column) -> Column:
    """A path from the root with its . and .. segments resolved; .. stops at the root."""
    parts = F.split(path, "/")
    parts = F.slice(parts, 2, F.size(parts) - 1)
    up = lambda held: F.when(F.size(held) > 0, F.slice(held, 1, F.size(held) - 1)).otherwise(held)
    step = lambda held, p: F.when(p == ".", held).when(p == "..", up(held)).otherwise(F.concat(held, F.array(p)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    folder = path.rlike(r"/\.\.?$") & (F.size(kept) > 0)
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, "/").otherwise(""))
    return F.when(path.rlike(r"/\.\.?(/|$)"), resolved).otherwise(path)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that stands once in the plan, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def absolute(link: Column, url: Column) -> Column:
    """A link as a full url: absolute, without scheme, from the host's root, or beside the page; . and .. segments are resolved."""

    def joined(link: Column, url: Column) -> Column:
        root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
        beside = F.concat(root, F.regexp_replace(F.regexp_replace(path_of(url), r"[^/]*$", ""), r"^$", "/"), link)
        return (
            F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
            .when(link.startswith("//"), F.concat(F.lit("http:"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .when(link.startswith("?"), F.concat(root, path_of(url), link))
            .when(link.startswith("#"), url)
            .otherwise(beside)
        )

    def resolved(full: Column) -> Column:
        rest = F.regexp_extract(full, r"(?s)^.*?://[^?#]*(.*)$", 1)
        return F.concat(F.regexp_extract(full, r"(?s)^(.*?://[^/?#]*)", 1), let(path_of(full), without_dots), rest)

    return let(link, lambda k: let(url, lambda u: let(joined(k, u), resolved)))


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) host + path + query of a page and of all it redirects to or calls canonical, with both hosts and paths.

    Links are relative to the page's first <base href>, if any; comments and
    scripts are skipped and character references decoded.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    head = pages.where(F.col("url").isNotNull() & html.rlike("(?i)canonical|http-equiv"))
    head = head.select("url", F.regexp_replace(html, UNREAD, "").alias("html"))
    links = F.concat(F.regexp_extract_all("html", F.lit(CANONICAL), 1), F.regexp_extract_all("html", F.lit(REFRESH), 1))
    base = without_entities(F.regexp_extract("html", BASE, 1))
    found = head.select("url", base.alias("base"), F.explode(links).alias("link")).where("link <> ''")
    found = found.select("url", F.when(F.col("base") == "", F.col("url")).otherwise(absolute(F.col("base"), F.col("url"))).alias("base"), without_entities(F.col("link")).alias("link"))
    target = absolute(F.col("link"), F.col("base"))
    named = found.select("url", target.alias("target"))
    ends = {"a": node_of(F.col("url")), "b": node_of(F.col("target")), "ah": host_of(F.col("url")), "ap": path_of(F.col("url")), "bh": host_of(F.col("target")), "bp": path_of(F.col("target"))}
    return named.select(*(c.alias(k) for k, c in ends.items())).where("a <> '' and b <> '' and a <> b")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every page.

    The longest rule that fits a page decides it. A page without a rule is
    blocked if any url in its alias class (connected by redirects and canonical
    links, urls taken as host + path + query, a host's empty path as /) is blocked by
    a rule of its own; rules that allow hold against that. Other pages get ``default``.

    Null, malformed or empty urls have empty host and path and no rule; null
    html has no links; repeated pages are judged alike; an empty table gives no
    rows; other columns are ignored. Only blocked aliases are joined back, and a
    hot url on the pages' side is split by the adaptive join.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    # no url is no :// : the extractions then give empty strings
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), node_of(F.col("url")).alias("node"))
    judged = judged.withColumn("rule", longest_rule(F.col("host"), F.col("path"), rules))
    edges = scratch.save(link_edges(pages.select("url", "html")).distinct(), "edges")
    own = verdict_of(F.col("rule"), rules)
    if edges.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce(own, F.lit(default)).alias("verdict"))
    component = scratch.save(connected_components(spark, edges.select("a", "b"), scratch=scratch), "component")
    ends = edges.select(F.col("a").alias("node"), F.col("ah").alias("h"), F.col("ap").alias("p")).union(edges.select("b", "bh", "bp")).distinct()
    seeds = ends.where(verdict_of(longest_rule(F.col("h"), F.col("p"), rules), rules) == "block").select("node")
    bad = component.join(seeds, "node", "left_semi").select("component").distinct()
    blocked = component.join(bad, "component", "left_semi").select(F.col("node").alias("alias")).distinct().withColumn("spread", F.lit("block"))
    out = judged.join(blocked, F.col("node") == F.col("alias"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(own, F.col("spread"), F.lit(default)).alias("verdict"))
