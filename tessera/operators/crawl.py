"""Crawl planning: source names, url rewriting, modification times, what to crawl, the queue, and upserts by url."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INTERVAL_SECONDS = 86_400


@dataclass(frozen=True)
class RewriteRule:
    """Urls of sitemaps that start with sitemap_pattern (less its `*`) and match pattern at their start are rewritten."""

    sitemap_pattern: str
    pattern: str
    replacement: str

    def translated(self) -> tuple[str, str] | None:
        """Pattern and replacement in the syntax that Spark runs, named groups by number; None if either side rejects the rule."""
        try:
            names = re.compile(self.pattern).groupindex
            pattern = re.sub(r"\(\?P<\w+>", "(", self.pattern)
            pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{names[m[1]]}", pattern)

            def part(m: re.Match) -> str:
                group = m["name"] or m["number"]
                if group:
                    return f"${group if group.isdigit() else names[group]}"
                return m[0] if m[0] == "\\\\" else f"\\{m[0]}"

            replacement = re.sub(r"\\g<(?P<name>\w+)>|\\(?P<number>\d{1,2})|\\\\|[\\$]", part, self.replacement)
            SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(pattern)
        except (re.error, KeyError, Py4JJavaError):
            return None
        return pattern, replacement

    def valid(self) -> bool:
        return self.translated() is not None


@dataclass(frozen=True)
class CrawlOptions:
    sitemaps: Sequence[str] = ()
    max_urls_per_sitemap: int = 0
    interval_seconds: int = INTERVAL_SECONDS
    delay_between_requests: int = 5
    state_dir: str = "crawler_state"
    connection_string: str = ""
    documents_database: str = ""
    url_transforms: Sequence[RewriteRule] = field(default_factory=tuple)

    @classmethod
    def of(cls, config: dict) -> CrawlOptions:
        """From a nested dictionary with the sections db, state and logic; unknown keys are left out, missing ones default."""
        db, state, logic = (config.get(k) or {} for k in ("db", "state", "logic"))
        rules = tuple(RewriteRule(r["sitemap_pattern"], r["pattern"], r["replacement"]) for r in logic.get("url_transforms") or ())
        return cls(tuple(logic.get("sitemaps") or ()), int(logic.get("max_urls_per_sitemap") or 0), int(logic.get("interval_seconds") or INTERVAL_SECONDS), int(logic.get("delay_between_requests") or 5), state.get("state_dir") or "crawler_state", db.get("connection_string") or "", db.get("documents_database") or "", rules)


def source_name(url: Column) -> Column:
    """The authority of the url, port and user kept; empty if there is none."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1)


def rewrite(url: Column, sitemap: Column, rules: Sequence[RewriteRule]) -> Column:
    """The url by the first valid rule whose sitemap and pattern fit; else as it is."""
    out = url
    for rule in reversed(rules):
        if found := rule.translated():
            fits = sitemap.startswith(rule.sitemap_pattern.replace("*", "")) & url.rlike(f"^(?:{found[0]})")
            out = F.when(fits, F.regexp_replace(url, *found)).otherwise(out)
    return out


def lastmod_epoch(text: Column) -> Column:
    """Seconds since 1970 of a time with an offset, a time, or a date, in UTC where no offset is given; else null."""
    day, second = r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"
    whole = F.when(text.rlike(day), F.concat(text, F.lit("T00:00:00Z"))).when(text.rlike(second), F.concat(text, F.lit("Z"))).otherwise(text)
    zoned = whole.rlike(r"(Z|[+-]\d{2}:?\d{2})$")  # else the session's zone would count
    return F.when(zoned, F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ss[XXX][XX]")).cast("long"))


def sitemap_cache(entries: DataFrame, order: str) -> DataFrame:
    """url and its lastmod of last order: the last writer wins."""
    return entries.groupBy("url").agg(F.max_by("lastmod", order).alias("lastmod"), F.min(order).alias(order))


def crawl_plan(cache: DataFrame, store: DataFrame, now: int, interval: int = INTERVAL_SECONDS) -> DataFrame:
    """url, is_new, time_ok, modified, needs_crawl of each url of the cache (url, lastmod) against the store (url, crawl_time).

    A stored page is crawled again only if the interval has passed and its lastmod is later than the crawl; a missing or
    zero time on either side isn't later.
    """
    kept = store.select(F.col("url").alias("__url"), "crawl_time")
    found = cache.join(kept, cache["url"] == kept["__url"], "left")
    is_new = F.col("__url").isNull()
    crawled, changed = F.coalesce("crawl_time", F.lit(0.0)), F.coalesce(lastmod_epoch(F.col("lastmod")), F.lit(0))
    time_ok = ~is_new & (F.lit(now) - crawled >= interval)
    modified = ~is_new & (changed != 0) & (crawled != 0) & (changed > crawled)
    return found.select("url", is_new.alias("is_new"), time_ok.alias("time_ok"), modified.alias("modified"), (is_new | time_ok & modified).alias("needs_crawl"))


def new_urls(cache: DataFrame, store: DataFrame) -> DataFrame:
    return cache.join(store.select("url"), "url", "left_anti").select("url")


def enqueue(queue: DataFrame, urls: DataFrame, order: str = "seq") -> DataFrame:
    """The queue (seq, url) and, after it, the urls (url, order) that aren't in it, once each, in the order of their first."""
    fresh = urls.groupBy("url").agg(F.min(order).alias("__at")).join(queue.select("url"), "url", "left_anti")
    last = queue.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__last"))
    numbered = fresh.withColumn("__n", F.row_number().over(Window.orderBy("__at", "url"))).crossJoin(F.broadcast(last))
    return queue.select("seq", "url").unionByName(numbered.select((F.col("__last") + F.col("__n")).cast("long").alias("seq"), "url"))


def dequeue(queue: DataFrame, n: int = 1) -> DataFrame:
    return queue.orderBy("seq").limit(n)


def upsert(store: DataFrame, pages: DataFrame) -> DataFrame:
    """The store (doc_id, url, html, source_name, crawl_time) after the pages (url, html, crawl_time): a known url keeps
    its id and takes the new page, a new one gets the next id in the order of url. The last page of a url counts.

    New ids are numbered in one window over the new urls of one batch; the store itself isn't moved for it.
    """
    last = pages.groupBy("url").agg(F.max_by(F.struct("html", "crawl_time"), F.struct("crawl_time", "html")).alias("p")).select("url", "p.html", "p.crawl_time")
    last = last.withColumn("source_name", source_name(F.col("url")))
    top = store.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("__top"))
    fresh = last.join(store.select("url"), "url", "left_anti").withColumn("__n", F.row_number().over(Window.orderBy("url"))).crossJoin(F.broadcast(top))
    fresh = fresh.select((F.col("__top") + F.col("__n")).cast("long").alias("doc_id"), "url", "html", "source_name", F.col("crawl_time").cast("double").alias("crawl_time"))
    new = last.select(F.col("url").alias("__url"), F.col("html").alias("__html"), F.col("crawl_time").cast("double").alias("__time"))
    seen = store.join(new, store["url"] == new["__url"], "left")
    hit = F.col("__url").isNotNull()
    changed = seen.select("doc_id", "url", F.when(hit, F.col("__html")).otherwise(F.col("html")).alias("html"), "source_name", F.when(hit, F.col("__time")).otherwise(F.col("crawl_time")).alias("crawl_time"))
    return changed.unionByName(fresh)
