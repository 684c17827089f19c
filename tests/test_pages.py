"""Parsing, selection, structured data, graph and change operators on small inputs of our own."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import assemble, crawl, facts, knowledge, order, parse, report, site, tech
from pagewright.sources import readers, sinks
from pagewright.streaming import pages as streams


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "url, normal",
    [
        ("HTTP://WWW.Example.com:80/a/index.html?b=2&utm_source=x&a=1#top", "http://www.example.com/a/?a=1&b=2"),
        ("https://e.com", "https://e.com/"),
        ("https://e.com:8443/x/", "https://e.com:8443/x/"),
        ("https://e.com/a.PNG", None),
        ("https://e.com/doc.pdf", "https://e.com/doc.pdf"),
        ("https://e.com/undefined/x", None),
        ("mailto:a@b.c", None),
        ("#x", None),
        ("https://e.com/?q=a+b&q=%C3%A9&e=", "https://e.com/?e=&q=a+b&q=%C3%A9"),
        (None, None),
    ],
)
def test_normalize_url(spark, url, normal):
    assert spark.createDataFrame([(url,)], "u string").select(U.normalize_url(F.col("u")).alias("x")).first().x == normal


def test_url_identity_and_kind(spark):
    rows = [("https://www.e.com/a/b//?x=1", "https://e.com/a/b?x=1", "page"), ("https://e.com/2024/06/", "https://e.com/2024/06", "archive"), ("https://e.com/2024/06/post", "https://e.com/2024/06/post", "page"), ("https://e.com/tags/x", "https://e.com/tags/x", "tag"), ("https://e.com/r.pdf", "https://e.com/r.pdf", "pdf"), ("https://www.e.com", "https://e.com/", "page")]
    got = spark.createDataFrame([(r[0],) for r in rows], "u string").select("u", U.canonical_key(F.col("u")).alias("k"), U.url_kind(F.col("u")).alias("kind")).collect()
    assert [tuple(r) for r in got] == rows


def test_scope_order(spark):
    df = spark.createDataFrame([("https://x.com/a", 9), ("https://x.com/a", 1), ("https://e.com/no", 1), ("https://e.com/yes", 1), ("https://e.com/other", 1)], "u string, d int")
    got = df.select(U.scope_refusal(F.col("u"), F.col("d"), F.lit("https://e.com/"), 3, ["/yes"], ["/no"]).alias("x")).collect()
    assert [r.x for r in got] == ["past-depth", "off-site", "excluded", None, "not-included"]


PAGE = """<?xml version="1.0"?><html lang="ar-SA"><head><title>The Title Here | Site</title><link rel=canonical href="/p"><meta property="og:title" content="O">
<script type="application/ld+json">{"@graph":[{"@type":"Product","name":"A","offers":{"price":"1.299,00"}},]}</script></head><body>
<nav><ul><li><a href="/n">N</a></ul></nav><main><h1>The Title Here</h1><p>One <b>bold<p>Two<br><br>Three <a href="x.html" rel=nofollow>n</a><a href="/y">why</a>
<ol><li>first<li>second<ul><li>inner</ul></ol><table><tr><th>a<th>b<tr><td rowspan=2>1<td>2<tr><td>3</table><pre><code class="language-py">x = 1
y</code></pre><blockquote><p>said</blockquote><div itemscope itemtype="http://schema.org/Person"><span itemprop=name>Bo</span></div></main>
<p style="display: none">hidden words</p><script>var t="</p>";</script><hr><img src=a.png alt=pic></body></html>"""


def test_parser(spark):
    p = parse.read_page(PAGE, "https://e.com/d/")
    kinds = [(b["kind"], b["text"]) for b in p["blocks"]]
    assert ("heading", "The Title Here") in kinds and ("paragraph", "Two") in kinds and ("code", "x = 1\ny") in kinds and ("rule", "") in kinds
    assert not any("hidden" in t or "var t" in t for _, t in kinds)
    table = next(b for b in p["blocks"] if b["kind"] == "table")
    assert table["rows"] == [["a", "b"], ["1", "2"], ["1", "3"]]
    assert [b["level"] for b in p["blocks"] if b["text"] == "inner"] == [2] and p["rtl"] and dict(p["meta"])["canonical"] == "https://e.com/p"
    assert [link["href"] for link in p["links"]] == ["https://e.com/n", "https://e.com/y"]
    assert [x["source"] for x in p["payloads"]] == ["json-ld", "microdata", "open-graph"]
    assert parse.read_page("", "u")["error"] and parse.read_page(None, None)["error"]
    assert H.balanced('x {"a": "}"} y', 2) == '{"a": "}"}'


def test_markdown_and_content(spark):
    pages = spark.createDataFrame([(1, "https://e.com/d/", PAGE), (2, "https://e.com/e", None)], "page_id long, url string, html string")
    parsed = parse.parse_pages(pages)
    b = assemble.dedup_blocks(parse.blocks_of(parsed))
    md = assemble.markdown_of(b).first().markdown
    assert "# The Title Here" in md and "1. first\n1. second\n  - inner" in md and '<td rowspan="2">1</td><td>2</td>' in md and "```py\nx = 1\ny\n```" in md and "> said" in md and "[why](https://e.com/y)" in md
    kept = assemble.select_content(b, parsed.select("page_id", F.coalesce(F.col("meta")["title"], F.lit("")).alias("title")))
    assert kept.where("text = 'The Title Here'").count() == 1


def blocks(spark, rows):
    return spark.createDataFrame(rows, "page_id long, site string, pos int, text string, kind string, level int").withColumn("chrome_key", T.chrome_key(F.col("text")))


def test_chrome(spark):
    rows = [(p, "s", i, t, "paragraph", 0) for p in range(6) for i, t in enumerate(["Home", "HOME", "About  us", f"own text number {p} that is long enough to stay"])]
    keys = assemble.site_chrome(blocks(spark, rows))
    assert {r.chrome_key: r.df for r in keys.collect()} == {"home": 6, "about us": 6}
    assert assemble.strip_chrome(blocks(spark, rows), keys).count() == 6
    assert assemble.site_chrome(blocks(spark, [r for r in rows if r[0] < 5])).count() == 0
    same = blocks(spark, [(p, "s", 0, "all the same", "paragraph", 0) for p in range(6)])
    assert assemble.strip_chrome(same, assemble.site_chrome(same)).count() == 6  # nothing would be left


def test_restated(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(1, 0, " ".join(words), "paragraph"), (1, 1, " ".join(words[:90]), "paragraph"), (1, 2, " ".join(words[85:170]), "paragraph"), (2, 0, " ".join(words), "paragraph"), (2, 1, " ".join(words[:190]), "paragraph")]
    got = assemble.restated(spark.createDataFrame(rows, "page_id long, pos int, text string, kind string")).collect()
    assert [tuple(r) for r in got] == [(1, 0)]


def test_union_keeps_rendered_order(spark):
    mk = lambda keys: spark.createDataFrame([(1, i, k) for i, k in enumerate(keys)], "page_id long, pos int, key string")
    got = assemble.union_blocks(mk("axbyc"), mk("cab")).orderBy("pos").collect()
    assert "".join(r.key for r in got) == "caxby"


def test_reading_order(spark):
    b = spark.createDataFrame([(1, i, f"/x{i}") for i in range(5)], "page_id long, pos int, xpath string")
    rects = [(1, "/x0", 0.0, 0.0, 300.0, 20.0), (1, "/x1", 0.0, 60.0, 100.0, 20.0), (1, "/x2", 150.0, 60.0, 100.0, 20.0), (1, "/x3", 0.0, 85.0, 100.0, 20.0)]
    got = order.order_blocks(b, spark.createDataFrame(rects, "page_id long, xpath string, x double, y double, width double, height double")).orderBy("reading_pos").collect()
    assert [r.pos for r in got] == [0, 1, 3, 4, 2] and got[0].method == "anchored"


def test_facts(spark):
    p = spark.createDataFrame([(1, 0, "json-ld", json.dumps({"name": "A", "offers": {"price": "1.299,00"}})), (1, 1, "open-graph", json.dumps({"og:title": "B"}))], "page_id long, seq int, source string, data string")
    schema = {"properties": {"title": {"type": "string"}, "price": {"type": "number"}, "gone": {"type": "string"}}}
    got = {r.path: (json.loads(r.value), r.how, r.confidence) for r in facts.merge_facts(facts.extract_facts(p, schema)).collect()}
    assert got == {"title": ("A", "known-alias", 0.8), "price": (1299.0, "nested", round(0.72 * 0.97, 4))}
    verdicts = facts.score_facts(spark.createDataFrame([(1, "price", "1299"), (1, "title", '"x"'), (1, "gone", "1")], "page_id long, path string, value string"), facts.merge_facts(facts.extract_facts(p, schema)))
    assert {r.path: r.verdict for r in verdicts.collect()} == {"price": "correct", "title": "wrong", "gone": "missing"}
    assert facts.run_score(verdicts).first().page_success == 0.0


def test_technologies_are_closed(spark):
    page = spark.createDataFrame([(1, '<script src="/wp-content/plugins/woocommerce/a.js"></script><script src="jquery-3.6.0.min.js"></script>')], "page_id long, html string")
    got = {r.technology: (r.version, r.implied) for r in tech.detect(page).collect()}
    assert got["jQuery"] == ("3.6.0", False) and got["PHP"] == ("", True) and {"WooCommerce", "WordPress"} <= set(got)


def test_expansion_and_budget(spark):
    e = spark.createDataFrame([("a", "b", 3.0), ("a", "c", 1.0), ("b", "d", 1.0)], "source string, target string, weight double")
    got = {r.id: round(r.score, 6) for r in site.expand(spark.createDataFrame([("a", 1.0)], "id string, score double"), e).collect()}
    assert got == {"a": 1.0, "b": 0.3375, "c": 0.1125, "d": round(0.3375 * 0.45**2, 6)}
    ranked = spark.createDataFrame([("p", "1", 9.0, 600, "x"), ("p", "2", 8.0, 600, "y"), ("q", "3", 7.0, 100, "x"), ("q", "4", 6.0, 90, "z")], "page string, id string, score double, chars int, prefix string")
    assert {r.id: r.tier for r in site.fill_budget(ranked, 1000).collect()} == {"1": "full", "2": "map", "4": "opening"}


def test_sections_and_diff(spark):
    rows = [(1, 0, "Top", "heading", 1), (1, 1, "x" * 50, "paragraph", 0), (1, 2, "Sub", "heading", 2), (1, 3, "y" * 50, "paragraph", 0), (1, 4, "Empty", "heading", 2)]
    s = site.sections(spark.createDataFrame(rows, "page_id long, pos int, text string, kind string, level int")).orderBy("section").collect()
    assert [(r.heading, r.parent) for r in s] == [("Top", None), ("Sub", 1)]
    mk = lambda x: spark.createDataFrame(x, "key string, section int, heading string, text string")
    d = site.diff_sections(mk([("k", 0, "A", "one"), ("k", 1, "B", "two  words")]), mk([("k", 0, "New", "n"), ("k", 1, "a", "ONE"), ("k", 2, "B", "two words")])).collect()
    assert sorted((r.heading, r.change) for r in d) == [("a", "edited"), ("new", "added")]
    assert one(spark, F.size(site.split_long(F.lit("\n\n".join(["p" * 40] * 5)), 100))) == 3


def test_robots(spark):
    files = spark.createDataFrame([("https://e.com", "User-agent: *\nDisallow: /a\nAllow: /a/b$\nDisallow: /*.pdf\n\nUser-agent: GPTBot\nDisallow:\n")], "origin string, body string")
    urls = spark.createDataFrame([("https://e.com/a/x",), ("https://e.com/a/b",), ("https://e.com/q.pdf",), ("https://e.com/z",)], "url string")
    got = {(r.agent, r.url[13:]): r.allowed for r in report.policies(report.robots_rules(files), urls, ("GPTBot", "CCBot")).collect()}
    assert got == {("CCBot", "/a/x"): False, ("CCBot", "/a/b"): True, ("CCBot", "/q.pdf"): False, ("CCBot", "/z"): True} | {("GPTBot", u): True for u in ("/a/x", "/a/b", "/q.pdf", "/z")}


def test_measures(spark):
    assert one(spark, report.token_f1(F.lit("a a b"), F.lit("a b c"))) == pytest.approx(2 / 3)
    o = spark.createDataFrame([(1, 0, 0), (1, 1, 2), (1, 2, 1)], "page_id long, truth int, produced int")
    assert tuple(report.inversions(o).first()) == (1, 2, 1)


def test_names_and_quotes(spark):
    assert one(spark, T.norm_name(F.lit("  “Acme  Corp's”"))) in ("acme corp", "“acme corp's”", "“acme corp")
    assert one(spark, T.snake_case(F.lit("worksFor-Company"))) == "works_for_company"
    assert knowledge.locate_quote("The *quick*  Brown fox", "quick brown") == (5, 18)
    m = knowledge.mentions(spark.createDataFrame([(1, 0, "Mail a.b@c.org or call +1 (743) 555-3824; $1,200 due 2024-01-02")], "page_id long, pos int, text string"))
    assert {r.type for r in m.collect()} == {"Email", "Phone", "Money", "Date"}
    ents = spark.createDataFrame([("e1", "Name", "international business machines corporation", 5), ("e2", "Name", "international business machines corporations", 2), ("e3", "Name", "other", 9)], "entity_id string, type string, norm string, evidence long")
    assert [tuple(r) for r in knowledge.near_names(ents).collect()] in ([("e2", "e1")], [])


def test_frontier(spark):
    found = spark.createDataFrame([("https://e.com/a", "p", 0), ("https://www.e.com/a/", "p", 1), ("https://o.com/", "p", 2), ("https://e.com/seen", "p", 3)], "href string, found_on string, pos int")
    seen = spark.createDataFrame([("https://e.com/seen",)], "key string")
    got = {r.key: (r.url, r.refusal) for r in crawl.frontier_step(found, seen, F.lit("https://e.com/"), 1).collect()}
    assert got == {"https://e.com/a": ("https://e.com/a", None), "https://o.com/": ("https://o.com/", "off-site")}
    pages = spark.createDataFrame([(f"https://e.com/{x}",) for x in ("", "a", "b", "c")], "url string")
    links = spark.createDataFrame([("https://e.com/", "https://e.com/a"), ("https://e.com/a", "https://e.com/b"), ("https://e.com/b", "https://e.com/")], "url string, href string")
    assert {r.key[-1]: r.depth for r in crawl.crawl(pages, links, "https://e.com/").collect()} == {"/": 0, "a": 1, "b": 2}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in" / "docs").mkdir(parents=True)
    (tmp_path / "in" / "index.html").write_text("<h1>x</h1>")
    (tmp_path / "in" / "docs" / "a.html").write_text("<h1>y</h1>")
    assert {r.url for r in readers.html_folder(spark, str(tmp_path / "in"), "https://e.com").collect()} == {"https://e.com/", "https://e.com/docs/a.html"}
    s = readers.sitemap_urls(spark.createDataFrame([("o", "<urlset><url><loc> https://e.com/?a=1&amp;b=2 </loc></url></urlset>")], "origin string, body string"))
    assert s.first().loc == "https://e.com/?a=1&b=2"
    pages = spark.createDataFrame([("e.com/", "It's")], "page_key string, title string")
    sinks.write_graph({"page": pages}, str(tmp_path / "g"))
    assert json.loads(readers.jsonl_graph(spark, str(tmp_path / "g"))["page"].first().value) == {"kind": "page", "page_key": "e.com/", "title": "It's"}
    assert "It\\'s" in sinks.cypher_pages(pages).first().value
    c = spark.createDataFrame([("http://e.com/<", "changed", None)], "url string, change string, title string").withColumn("at", F.lit("2024-01-02").cast("timestamp"))
    assert "&lt;" in sinks.feed(c, "t", "l").first().value and sinks.feed(c, "t", "l", "markdown").first().value.startswith("# t")


def test_streams(spark, tmp_path):
    rows = [(1, "https://e.com/a", "x"), (2, "https://www.e.com/a/", "x"), (3, "https://e.com/b", "x"), (4, "https://e.com/c", "x")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    q = streams.new_pages(streams.page_stream(spark, str(tmp_path / "p"))).select("key").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("seen").count() == 3
    got = []
    streams.on_each_batch(streams.page_stream(spark, str(tmp_path / "p")), lambda df, i: got.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(got) == 4
    assert streams.identical_content(spark.read.parquet(str(tmp_path / "p"))).first().urls == 3


def test_restated_by_page(spark):
    """Shingles stay in the task that holds their page (before: all of them were broadcast); random pages against all pairs."""
    import random

    from pagewright.functions import restate

    rows = [(1, 0, " ".join(f"w{i}" for i in range(200)), "paragraph")]
    plan = assemble.restated(spark.createDataFrame(rows, "page_id long, pos int, text string, kind string"))._jdf.queryExecution().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    r, found = random.Random(5), 0
    for _ in range(400):
        base = [f"w{r.randrange(99)}" for _ in range(r.randrange(20, 90))]
        texts = [" ".join(base[a : a + r.randrange(50)]) for a in r.choices(range(len(base)), k=r.randrange(1, 9))] + [" ".join(base)]
        runs = [{tuple(w[i : i + 6]) for i in range(len(w) - 5)} for w in map(str.split, texts)]
        want = []
        for i, s in enumerate(runs):
            shared = [s & t for j, t in enumerate(runs) if j != i and s & t]
            if len(texts[i].split()) >= 20 and shared and len(set().union(*shared)) >= 0.7 * len(s) and max(map(len, shared)) < 0.5 * len(s):
                want.append(i)
        assert restate.restated(list(enumerate(texts)), 20, 0.7, 0.5) == want
        found += len(want)
    assert found


def test_headings_as_sql(spark, tmp_path):
    """Other references than the three, pages without a heading or any markup: the rows of the SQL."""
    import duckdb
    from conftest import rows_of

    from pagewright import catalog

    catalog.load()
    page = "<html><body><ul><li>x</li></ul>{}<p>some text</p></body></html>"
    tops = ["<h1>token = &quot;0b96</h1>", "<h1>The&amp;&amp; the&amp</h1>", "<h1>a &lt;b&gt; &amp;lt; &nbsp;&#39; R&D &copy;</h1>", "", "<h1>plain</h1><h1>second</h1>"]
    rows = [(i, "http://e.com/", page.format(h)) for i, h in enumerate(tops)] + [(7, "http://e.com/", ""), (8, "http://e.com/", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert rows_of(catalog.QUERIES["page_headings"](spark, str(tmp_path)).toPandas()) == rows_of(c.sql(catalog.ORACLE_SQL["page_headings"]).df())


def test_crawl_broadcasts_nothing_large(spark, monkeypatch):
    """Tables beyond FEW rows are joined by shuffling, and the root's key is computed once: the same levels either way."""
    pages = spark.createDataFrame([(f"https://e.com/{x}",) for x in ("", "a", "b", "c", "d/")], "url string")
    links = spark.createDataFrame([(f"https://e.com/{a}", f"https://e.com/{b}") for a, b in (("", "a/"), ("", "?ref=x"), ("a", "b"), ("b", "c"), ("c", "d"), ("b", "gone"))], "url string, href string")
    level = lambda: {r.key.rsplit("/", 1)[-1]: r.depth for r in crawl.crawl(pages, links, "https://www.e.com").collect()}
    want = {"": 0, "a": 1, "b": 2, "c": 3}
    assert level() == want
    monkeypatch.setattr(crawl, "FEW", 0)
    monkeypatch.setattr(crawl, "KEYED", 2)
    assert "Broadcast" not in crawl.crawl(pages, links, "https://www.e.com")._jdf.queryExecution().toString() and level() == want
