"""URL filters whose blocks reach every alias of a blocked address.

Rules judge a URL by host and path. Pages without a rule are judged by their
equivalence class: connected components over the redirects and canonical links
that pages state, and over the canonical form that a URL has by itself (secure
scheme, no fragment, no tracking parameter, no trailing slash).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.llm.common import new_folder, written
from tickloom.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Patterns of what a page says about its address.
CANONICAL = r"""(?is)<link\s[^>]*rel=["']?canonical["'\s][^>]*>"""
REFRESH = r"""(?is)<meta\s[^>]*http-equiv=["']?refresh["'\s][^>]*>"""
HREF = r"""(?is)\shref=["']?([^"'\s>]+)"""
TARGET = r"""(?is)url=["']?([^"'\s>]+)"""
TRACKING = r"(^|&)(?:utm_[a-z]+|gclid|fbclid|ref)=[^&]*"


@dataclass(frozen=True)
class Rule:
    """``action`` (allow or block) for a host with its subdomains, below a path."""

    action: str
    host: str
    path: str

    @classmethod
    def read(cls, text: str) -> Rule:
        """From text such as ``block example.com/en/``."""
        action, address = text.split()
        host, slash, path = address.partition("/")
        return cls(action, host, slash + path)

    def fits(self, host: Column, path: Column) -> Column:
        inside = (host == self.host) | host.endswith(f".{self.host}")
        return inside & path.startswith(self.path)


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting(rules: list[Rule], host: Column, path: Column, value) -> Column:
    """``value(rule)`` of the longest rule that fits, null if none does."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.host) + len(r.path)):
        found = F.when(rule.fits(host, path), F.lit(value(rule))).otherwise(found)
    return found


def canonical(url: Column) -> Column:
    """The form of a URL that stands for it; null without a scheme."""
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&+", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    form = F.concat(F.lit("https://"), host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.instr(url, "://") > 0, form)


def resolved(target: Column, url: Column) -> Column:
    """A stated address as a full one; null for one relative to a folder."""
    scheme = F.substring(url, F.lit(1), F.instr(url, "://") - 1)
    site = F.concat(scheme, F.lit("://"), host_of(url))
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(site, target))
    )


def links(pages: DataFrame) -> DataFrame:
    """``url`` and ``target``: every redirect, canonical link and canonical form.

    A URL without a scheme, or null, links nothing.
    """
    url, html = F.col("url").cast("string"), F.col("html").cast("string")
    refresh = F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1)
    stated_form = F.regexp_extract(F.regexp_extract(html, CANONICAL, 0), HREF, 1)
    stated = F.when(html.rlike("(?i)canonical|refresh"), F.array(resolved(refresh, url), resolved(stated_form, url)))
    rows = pages.where(F.instr(url, "://") > 0).select(
        url.alias("url"),
        F.explode(F.concat(F.array(canonical(url)), F.coalesce(stated, F.array().cast("array<string>")))).alias("target"),
    )
    full = rows.where("target IS NOT NULL AND target != ''")
    forms = full.select(F.col("target").alias("url"), canonical(F.col("target")).alias("target"))
    return full.unionByName(forms.where("target IS NOT NULL"))


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and ``alias_blocked``.

    The longest fitting rule decides. Without one, a page is blocked if an
    address of its class is blocked by a rule and none is allowed by a rule:
    explicit allows come first. Null URLs and URLs without ``://`` have empty
    host and path, no class, and are allowed. Every row of ``pages`` comes back.
    """
    spark = pages.sparkSession
    folder = new_folder(spark, "url-filters")
    classes = connected_components(links(pages.select("url", "html")))
    address = F.col("node")
    action = fitting(rules, host_of(address), path_of(address), lambda r: r.action)
    decided = classes.withColumn("action", action).where("action IS NOT NULL")
    blocked = written(
        decided.groupBy("component")
        .agg(F.count_if(F.col("action") == "allow").alias("allows"))
        .where("allows = 0")
        .select(F.col("component").alias("blocked_class")),
        f"{folder}/blocked",
    )
    aliases = written(
        classes.join(blocked, F.col("component") == F.col("blocked_class")).select(F.col("node").alias("blocked_url")),
        f"{folder}/aliases",
    )
    url = F.col("url").cast("string")
    judged = pages.select(
        "page_id",
        url.alias("url"),
        host_of(url).alias("host"),
        path_of(url).alias("path"),
    ).withColumns(
        {
            "rule": fitting(rules, F.col("host"), F.col("path"), lambda r: r.host + r.path),
            "action": fitting(rules, F.col("host"), F.col("path"), lambda r: r.action),
        }
    )
    marked = judged.join(aliases, F.col("url") == F.col("blocked_url"), "left")
    alias = F.col("blocked_url").isNotNull()
    verdict = F.coalesce("action", F.when(alias, "block").otherwise("allow"))
    return marked.select("page_id", "host", "path", "rule", verdict.alias("verdict"), alias.alias("alias_blocked"))
