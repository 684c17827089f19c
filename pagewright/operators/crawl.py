"""Crawl dataflow over tables: frontier levels, inventories, throttling, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import urls as U
from pagewright.storage import staged

#: Addresses that one task gives their keys: about two seconds of patterns.
KEYED = 20_000
#: Rows of a key up to which a table may be broadcast.
FEW = 200_000


def beside(table: DataFrame) -> DataFrame:
    """A staged table for the right side of a join: broadcast only if its rows, counted, are few; its file's size says little."""
    return F.broadcast(table) if table.count() <= FEW else table.hint("merge")


def frontier_step(found: DataFrame, seen: DataFrame, root: Column, depth: int, max_depth: int = 10, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Newly found addresses of one breadth-first level: (key, url, kind, refusal, via), one row a key, first finder wins.

    found is (href, found_on, pos); keys already seen are left out, refused ones carry their first reason.
    """
    keyed = found.select(U.canonical_key(F.col("href")).alias("key"), U.normalize_url(F.col("href")).alias("url"), "found_on", "pos").where("url is not null")
    one = keyed.groupBy("key").agg(F.min_by(F.struct("url", "found_on"), F.struct("found_on", "pos")).alias("f")).select("key", "f.url", F.col("f.found_on").alias("via"))
    fresh = one.join(seen.select("key").distinct(), "key", "left_anti")
    return fresh.select("key", "url", U.url_kind(F.col("url")).alias("kind"), U.scope_refusal(F.col("url"), F.lit(depth), root, max_depth, list(include), list(exclude)).alias("refusal"), "via")


def crawl(pages: DataFrame, links: DataFrame, root: str, max_depth: int = 3) -> DataFrame:
    """(key, depth) of pages reached from a root over links (url, href): a few joins a level, each level cut from the last.

    pages gives the addresses that answer; a level's new keys are those of no level before. Each distinct address gets its
    key once, not once a link. links are read at every level: what is dear to compute should be staged before.
    """
    urls = pages.select("url", F.lit(True).alias("answers")).unionByName(links.select("url", F.lit(False).alias("answers"))).unionByName(links.select(F.col("href").alias("url"), F.lit(False).alias("answers")))
    urls = staged(urls.groupBy("url").agg(F.bool_or("answers").alias("answers")), "crawl-urls")
    spread = urls.repartition(urls.count() // KEYED + 1, "url")  # few bytes, much work: not to be coalesced by size
    keys = staged(spread.select("url", "answers", U.canonical_key(F.col("url")).alias("key")), "crawl-keys")
    known = staged(keys.where("answers").select("key").distinct(), "crawl-pages")
    start = pages.sparkSession.range(1).select(U.canonical_key(F.lit(root))).head()[0]  # once, not once a page
    front = staged(known.where(F.col("key") == start).select("key", F.lit(0).alias("depth")), "crawl-level")
    reached = front
    for depth in range(1, max_depth + 1):
        from_ = staged(keys.join(beside(front.select("key")), "key", "left_semi").select("url"), "crawl-from")
        hrefs = staged(links.join(beside(from_), "url", "left_semi").select(F.col("href").alias("url")).distinct(), "crawl-hrefs")
        found = keys.join(beside(hrefs), "url", "left_semi").select("key").distinct().join(beside(known), "key", "left_semi")
        front = staged(found.join(beside(reached.select("key")), "key", "left_anti").select("key", F.lit(depth).alias("depth")), "crawl-level")
        reached = reached.unionByName(front)
        if not front.head(1):
            break
    return reached


def throttle(requests: DataFrame, interval: float) -> DataFrame:
    """(host, url, at, starts_at): a host's requests in order start at least `interval` seconds apart.

    starts = max over earlier requests of (arrival + interval x requests since): a running maximum, not a loop.
    """
    order = Window.partitionBy("host").orderBy("at", "url")
    n = F.row_number().over(order)
    r = requests.withColumn("host", U.host(F.col("url"))).withColumn("_n", n).withColumn("_lead", F.col("at") - F.col("_n") * interval)
    return r.withColumn("starts_at", F.max("_lead").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * interval).select("host", "url", "at", "starts_at")


def sample_sections(links: DataFrame, count: int) -> DataFrame:
    """The first links of each path section, then the rest, plain addresses before those with a query, up to `count` a page."""
    l = links.where(U.same_site(F.col("href"), F.col("url"))).withColumn("section", U.section_of(F.col("href"))).withColumn("asks", F.col("href").contains("?"))
    l = l.withColumn("_s", F.row_number().over(Window.partitionBy("page_id", "section").orderBy("asks", "pos")))
    l = l.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy(F.col("_s") > 1, "asks", "pos")))
    return l.where(F.col("_n") <= count).select("page_id", "href", "section")


def resolved_roots(roots: DataFrame, redirects: DataFrame, most: int = 5) -> DataFrame:
    """(root, final): where each root's redirects (url, location) end, at most `most` of them; a root without one is its own."""
    step = redirects.groupBy("url").agg(F.min("location").alias("location"))
    out = roots.select("root", F.col("root").alias("final")).distinct()
    for _ in range(most):
        out = staged(out.join(step, F.col("final") == F.col("url"), "left").select("root", F.coalesce("location", "final").alias("final")), "roots")
    return out


def inventory(sitemap: DataFrame, crawled: DataFrame, statuses: DataFrame | None = None) -> DataFrame:
    """(key, url, via, status, live): the pages of a site, advertised by sitemaps (url) or found by links (url), one row a
    key; via says by which or both. live is null where nobody asked (statuses: url, status)."""
    both = sitemap.select("url", F.lit("sitemap").alias("via")).unionByName(crawled.select("url", F.lit("link").alias("via")))
    k = both.withColumn("key", U.canonical_key(F.col("url"))).where(U.normalize_url(F.col("url")).isNotNull() & (U.url_kind(F.col("url")) != "other_file"))
    one = k.groupBy("key").agg(F.min("url").alias("url"), F.array_join(F.sort_array(F.collect_set("via")), "+").alias("via"))
    if statuses is None:
        return one.select("key", "url", "via", F.lit(None).cast("int").alias("status"), F.lit(None).cast("boolean").alias("live"))
    s = statuses.groupBy(U.canonical_key(F.col("url")).alias("key")).agg(F.min("status").alias("status"))
    return one.join(s, "key", "left").select("key", "url", "via", "status", (F.col("status") < 400).alias("live"))


def inventory_summary(found: DataFrame) -> DataFrame:
    """One row: pages, checked, live and dead ones, the live share of those checked (null if none), and whether all were."""
    n = F.count_if(F.col("live").isNotNull())
    return found.agg(F.count("*").alias("pages"), n.alias("checked"), F.count_if("live").alias("live"), F.count_if(~F.col("live")).alias("dead"), (F.count_if("live") / F.nullif(n, F.lit(0))).alias("liveness"), (n == F.count("*")).alias("fully_verified"))


def paced(requests: DataFrame, interval: float, now: float) -> DataFrame:
    """requests (url, at) with `wait`: seconds until each may start, so that a host has one in an interval."""
    return throttle(requests, interval).withColumn("wait", F.greatest(F.lit(0.0), F.col("starts_at") - now))


def crawl_record(pages: DataFrame) -> DataFrame:
    """What the end of a crawl needs of each page: no markup, no blocks."""
    return pages.select(*(c for c in ("page_id", "key", "url", "via", "depth", "status", "error", "title", "page_type", "content_hash", "markdown") if c in pages.columns))


def crawl_report(pages: DataFrame, refusals: DataFrame | None = None) -> DataFrame:
    """(line): counts of a crawl in words: pages, failures by kind, depths; and addresses refused by reason."""
    read = pages.agg(F.concat(F.count("*").cast("string"), F.lit(" pages, "), F.count_if(F.col("error").isNotNull()).cast("string"), F.lit(" failed")).alias("line")).withColumn("_o", F.lit(0))
    deep = pages.groupBy("depth").agg(F.count("*").alias("n")).select(F.concat(F.lit("depth "), F.col("depth").cast("string"), F.lit(": "), F.col("n").cast("string")).alias("line"), (F.col("depth") + 1).alias("_o"))
    out = read.unionByName(deep)
    if refusals is not None:
        out = out.unionByName(refusals.groupBy("refusal").agg(F.count("*").alias("n")).select(F.concat(F.lit("refused, "), "refusal", F.lit(": "), F.col("n").cast("string")).alias("line"), F.lit(1000).alias("_o")))
    return out.orderBy("_o", "line").select("line")
