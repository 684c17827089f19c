"""The site report: measures, sub-scores, findings, signals, proposals."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import parse, report, signals

ROBOTS = "User-agent: GPTBot\nDisallow: /\n\nUser-agent: CCBot\nDisallow: /articles/\nCrawl-delay: x\nCrawl-delay: 2.5\n\nUser-agent: *\nDisallow: /wp-admin/\nDisallow: /search?\nCrawl-delay: 10\nContent-Usage: /docs train-ai=n, search=y\nContent-Signal: search=yes, ai-train=no\nSitemap: https://e.com/s.xml\n"
HEAD = "<html lang=en><head><title>{0} | Acme</title><meta name=description content=d><meta property=og:title content=t><link rel=canonical href={1}><script type='application/ld+json'>{{\"@type\":\"Article\"}}</script></head>"


@pytest.fixture(scope="module")
def parsed(spark):
    spam = "".join(f"<div style='position:absolute;left:-9999px'><a href='http://x{i}.org/'>buy now</a></div>" for i in range(6))
    rows = [
        (1, "https://e.com/a", HEAD.format("A", "https://e.com/a") + "<p>some words of the page</p>" + spam),
        (2, "https://e.com/b", HEAD.format("B", "https://other.org/b") + "<p>more words</p><ul style='display:none'><li>menu <a href=/m>m</a><a href='https://www.e.com/n'>n</a></ul>"),
        (3, "https://f.com/", "<p>bare</p><div style='left:-2000px;position:fixed'><a href='http://y.org/'>z</a></div>"),
        (4, "https://f.com/x", None),
    ]
    return parse.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).cache()


def test_measures(parsed):
    got = {r.page_id: r for r in report.measure_pages(parsed).collect()}
    assert (got[1].offscreen_hosts, got[1].offscreen_links, got[1].hidden_words) == (6, 6, {"offscreen": 12})
    assert got[2].hidden_words == {"display": 3} and got[2].hidden_hosts == 0 and got[2].has_schema and got[2].has_og
    assert not got[3].has_title and got[3].offscreen_hosts == 1 and got[4].error
    hosts = {(r.page_id, r.host): (r.external, r.offscreen, r.links) for r in report.hidden_links(parsed).collect()}
    assert hosts[2, "e.com"] == (False, False, 1) and hosts[3, "y.org"] == (True, True, 1) and len([k for k in hosts if k[0] == 1]) == 6


def test_sub_scores(spark, parsed):
    pages = report.measure_pages(parsed).withColumn("site", F.regexp_extract("url", "//([^/]+)", 1)).withColumn("wall", F.when(F.col("page_id") == 2, "login"))
    links = report.check_links(spark.createDataFrame([(1, i, "https://e.com/a", f"https://e.com/l{i}") for i in range(40)] + [(1, 99, "https://e.com/a", "https://e.com/l1/"), (1, 100, "https://e.com/a", "http://z.org/")], "page_id long, pos int, url string, href string"), spark.createDataFrame([(f"https://e.com/l{i}", [200, 404, None][i % 3]) for i in range(40)], "url string, status int"))
    row = links.first()
    assert (row.checked, row.dead, row.unreachable) == (30, 10, 10) and row.dead_links[0].status == 404
    coverage = spark.createDataFrame([(1, 0.5, 10, 10), (2, 1.0, 10, 10), (3, 1.0, 0, 10)], "page_id long, static_coverage double, rendered_chars int, union_chars int")
    access = report.bot_access(report.robots_rules(spark.createDataFrame([("e.com", ROBOTS)], "origin string, body string"))).withColumnRenamed("origin", "site")
    bots = {r.bot: (r.access, r.via, r.content_paths) for r in access.collect()}
    assert bots["GPTBot"] == ("blocked", "named", []) and bots["CCBot"] == ("partly", "named", ["/articles/"]) and bots["Googlebot"] == ("allowed", "wildcard", [])
    sitemap = spark.createDataFrame([("e.com", 1, True), ("e.com", 2, False), ("e.com", 9, None), ("f.com", None, None)], "site string, page_id long, listed boolean")
    llms = spark.createDataFrame([("e.com", True), ("f.com", False)], "site string, found boolean")
    got = {(r.site, r.part): r.earned for r in report.sub_scores(pages, links, coverage, access, sitemap, llms).collect()}
    want = {"walls": 7.5, "structured": 10.0, "hidden": 0.0, "readable": 18.75, "robots": 20 * (1 - 1 / 15), "sitemap": 8.0, "llms": 5.0, "dead": 5 * (1 - 10 / 30)}
    assert {p: got["e.com", p] for p in want} == pytest.approx(want)
    assert got["f.com", "hidden"] == 5.0 and got["f.com", "structured"] == 0.0 and got["f.com", "sitemap"] == 0.0 and ("f.com", "dead") not in got
    whole = {r.site: r for r in report.site_report(pages, links=links, coverage=coverage, access=access, sitemap=sitemap, llms=llms).collect()}
    assert whole["e.com"].total == round(100 * sum(want.values()) / 100) and whole["e.com"].pages == 2 and whole["f.com"].parts["walls"] == 15.0


def test_findings(spark, parsed):
    pages = report.measure_pages(parsed).withColumn("site", F.regexp_extract("url", "//([^/]+)", 1)).withColumn("wall", F.when(F.col("page_id") == 2, "login")).withColumn("canvas", F.col("page_id") == 3).withColumn("rendered", F.when(F.col("page_id") == 3, False))
    stack = spark.createDataFrame([("e.com", "jQuery", True), ("e.com", "Vue", False)], "site string, technology string, old boolean")
    maps = spark.createDataFrame([("e.com", "https://e.com/a"), ("e.com", "https://cdn.net/b")], "site string, loc string")
    got = [(r.site, r.kind, r.severity) for r in report.findings(pages, stack, maps).collect()]
    assert got == [("e.com", "injected_links", 3), ("e.com", "wall", 3), ("e.com", "canonical_elsewhere", 2), ("e.com", "sitemap_elsewhere", 2), ("e.com", "outdated_stack", 1), ("f.com", "unreadable_page", 3), ("f.com", "canvas_content", 2), ("f.com", "hidden_external_links", 2), ("f.com", "render_failed", 1)]
    assert {r.site: r.name for r in report.site_names(pages).collect()} == {"e.com": "Acme"}


def test_robots_lines(spark):
    files = spark.createDataFrame([("e.com", ROBOTS)], "origin string, body string")
    assert {r.agent: r.delay for r in report.crawl_delays(files).collect()} == {"ccbot": 2.5, "*": 10.0}
    assert {(r.path, r.category, r.value) for r in signals.content_usage(files).collect()} == {("/docs", "train-ai", "no"), ("/docs", "search", "yes")}
    patterns = spark.createDataFrame([("/wp-admin/",), ("/articles/",), ("/*?",), ("/search",), ("/login.php",), ("/blog/login-tips/",)], "p string")
    assert [r[0] for r in patterns.select(report.is_administrative(F.col("p"))).collect()] == [True, False, True, True, True, False]
    said = spark.createDataFrame([({"search": "yes", "ai-train": "no"},), ({"ai-input": "no"},), ({"x": "y"},)], "m map<string,string>")
    assert [r[0] for r in said.select(signals.signal_meaning(F.col("m"))).collect()] == ["AI systems may index it for search, but should not train AI models on it.", "AI systems should not use it as input to AI answers.", None]


def test_signals(spark, parsed):
    roots = parsed.where("page_id = 1").select(F.lit("e.com").alias("site"), "meta", "payloads")
    robots = spark.createDataFrame([("e.com", ROBOTS)], "site string, body string")
    headers = signals.joined_headers(spark.createDataFrame([("e.com", 1, "Link", "<a>"), ("e.com", 2, "link", "<b>"), ("e.com", 3, "X-Robots-Tag", "none")], "url string, seq int, name string, value string"))
    assert {r.name: r.value for r in headers.collect()} == {"link": "<a>, <b>", "x-robots-tag": "none"}
    files = spark.createDataFrame([("e.com", "/llms.txt", 200), ("e.com", "/ai.txt", 404)], "site string, path string, status int")
    got = {r.signal: r.present for r in signals.collect_signals(roots, robots, headers.withColumnRenamed("url", "site"), files).collect()}
    assert len(got) == 24 and {k for k, v in got.items() if v} == {"content_signal", "content_usage", "sitemap", "link_header", "robots_header", "canonical", "open_graph", "json_ld", "llms_txt"}


def test_proposals():
    text = signals.suggest_robots("e.com", "https://e.com/s.xml", True)
    assert "User-agent: GPTBot" in text and "ai-train=no" in text and text.endswith("Sitemap: https://e.com/s.xml\n") and "GPTBot" not in signals.suggest_robots("e.com", None, False)
    assert signals.suggest_security("e.com", "mailto:a@e.com", "2030-01-01T00:00:00Z").count("\n") == 4
