"""Walls, classifiers, signals, answers, further site operators and custom stream state."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import answers, assemble, classify, signals, site, walls
from pagewright.streaming.state import stream_chrome


def test_walls(spark):
    rows = [(1, 403, "", "", 0), (2, 200, "<div id=cf-challenge>", "wait", 1), (3, 200, "", "Access Denied by policy " + "w " * 30, 33), (4, 200, "", "a page of its own " * 10, 50)]
    df = spark.createDataFrame([(i, s, h, t, "https://e.com/a", "https://e.com/a", w) for i, s, h, t, w in rows], "page_id long, status int, html string, text string, requested string, url string, words int")
    assert {r.page_id: r.wall for r in walls.walls(df).collect()} == {1: "refused", 2: "challenge: cloudflare", 3: "block page: access denied", 4: None}
    u = spark.createDataFrame([("https://e.com/a", "https://e.com/login?next=%2Fa", 10), ("https://e.com/a", "https://e.com/a", 10)], "r string, f string, w int")
    assert [r.x for r in u.select(walls.login_redirect(F.col("r"), F.col("f"), F.col("w")).alias("x")).collect()] == [True, False]


@pytest.mark.parametrize("url, public", [("https://example.com/", True), ("http://127.0.0.1/", False), ("http://10.1.2.3/", False), ("http://169.254.169.254/", False), ("http://172.20.0.1/", False), ("http://localhost/", False), ("http://[::1]/", False), ("http://2130706433/", False), ("http://8.8.8.8/", True), ("http://db.internal/", False)])
def test_public(spark, url, public):
    assert spark.createDataFrame([(url,)], "u string").select(walls.is_public(F.col("u")).alias("x")).first().x is public


MODEL = json.dumps({"base": [0.0, 0.0], "trees": [[0, {"f": 0, "t": 5.0, "l": {"v": 2.0}, "r": {"v": -2.0}, "m": "r"}], [1, {"f": 1, "t": 0.5, "l": {"v": -1.0}, "r": {"v": 1.0}}]]})


def test_trees(spark):
    x = np.array([[1.0, 0.0], [9.0, 1.0], [np.nan, 0.0]])
    assert classify.Trees(MODEL).raw(x).tolist() == [[2.0, -1.0], [-2.0, 1.0], [-2.0, -1.0]]
    df = spark.createDataFrame([(1, 1.0, 0.0), (2, 9.0, 1.0), (3, 9.0, 0.0)], "id long, a double, b double")
    got = {r.id: (r.label, r.runner_up) for r in classify.score(df, ["a", "b"], MODEL, ["x", "y"], 0.8).collect()}
    assert got == {1: ("x", "y"), 2: ("y", "x"), 3: ("unknown", "x")}
    import pandas as pd

    assert classify.explain(pd.DataFrame({"a": [1.0], "b": [0.0]}), MODEL, 0)[0][0] == "a"
    with pytest.raises(ValueError):
        classify.Trees("{}")


def test_signals(spark):
    got = spark.range(1).select(signals.link_header(F.lit('<https://e.com/2>; rel="next", </s.css>; rel=preload; as=style')).alias("x"), signals.robots_tokens(F.lit("NoIndex, nofollow,noindex")).alias("t"), signals.script_links(F.lit('{url:"/a",x:1,"href":"https://b.c/d", url:"/a"}')).alias("s")).first()
    assert [(x.url, x.rel) for x in got.x] == [("https://e.com/2", "next"), ("/s.css", "preload")] and got.t == ["noindex", "nofollow"] and got.s == ["/a", "https://b.c/d"]
    f = spark.createDataFrame([("o", "User-agent: *\nContent-Signal: search=yes, ai-train=no\nLicense: https://l.x/a\n")], "origin string, body string")
    assert {(r.name, r.value) for r in signals.content_signals(f).collect()} == {("search", "yes"), ("ai-train", "no")} and signals.licence_lines(f).first().licence == "https://l.x/a"
    p = spark.createDataFrame([(1, 200, 5, 0.2, "", 0, 0), (2, 404, 100, 1.0, "t", 6, 1)], "page_id long, status int, words int, static_coverage double, title string, hidden_hosts int, dead_links int")
    assert [r.line for r in signals.suggest_llms(spark.createDataFrame([("A", "https://e.com/docs/a")], "title string, url string")).collect()] == ["## docs", "- [A](https://e.com/docs/a)"]


def test_answers(spark):
    rows = spark.createDataFrame([("1", "Acme Corp", "makes anvils"), ("2", "Other", "acme acme and more words here"), ("3", "None", "nothing")], "id string, name string, about string")
    assert [r.id for r in answers.field_search(rows, "id", {"name": 3.0, "about": 1.0}, "acme?", 5).collect()][0] in ("1", "2")
    found = spark.createDataFrame([(f"e{i}", float(i), i < 3) for i in range(10)], "evidence_id string, score double, reached boolean")
    got = answers.select_evidence(found, 6).collect()
    assert len(got) == 6 and sum(r.reached for r in got) == 2 and sorted(r.citation for r in got) == list(range(1, 7))
    a = answers.parse_answer("It is so. [1] Or not. Perhaps [9].", {1})
    assert [s["supported"] for s in a["sentences"]] == [True, False, False] and not a["abstained"] and answers.parse_answer("No.", set())["abstained"]
    assert answers.extractive("Who makes anvils?", [(1, "Acme makes anvils"), (2, "Nothing")]) == "Acme makes anvils. [1]"
    assert answers.rouge_l("the cat sat", "the cat sat") == (1.0, 1.0, 1.0) and answers.rouge_l("a b", "c")[2] == 0.0
    k = spark.createDataFrame([("1,200", "1200", "number"), ("on 2024-01-02", "2024-01-02", "span"), ("2 January 2024", "2024-01-02", "date"), ("x", "y", "span")], "f string, w string, k string")
    assert [r.x for r in k.select(answers.is_answer(F.col("f"), F.col("w"), F.col("k")).alias("x")).collect()] == [True, True, True, False]


def test_selection_steps(spark):
    rows = [(1, 0, "Title", "heading", 1, 0, ""), (1, 1, "lead text", "paragraph", 0, 0, ""), (1, 2, "body text", "paragraph", 0, 0, ""), (1, 3, "", "rule", 0, 0, ""), (1, 4, "more body", "paragraph", 0, 0, ""), (1, 5, "Related posts", "heading", 2, 0, ""), (1, 6, "other", "paragraph", 0, 0, ""), (1, 7, "Next", "heading", 2, 0, ""), (1, 8, "kept", "paragraph", 0, 0, "")]
    b = spark.createDataFrame(rows, "page_id long, pos int, text string, kind string, level int, quoted int, xpath string").withColumns({"words": T.word_count(F.col("text")), "link_density": F.lit(0.0)})
    assert [r.pos for r in assemble.prune_sections(b).orderBy("pos").collect()] == [0, 1, 2, 3, 4, 7, 8]
    kept = b.where("pos in (2, 4)")
    back = assemble.restore(b, kept, spark.createDataFrame([(1, "")], "page_id long, title string"))
    assert sorted(r.pos for r in back.collect()) == [1, 2, 3, 4]
    words = " ".join(f"w{i}" for i in range(20))
    q = spark.createDataFrame([(1, 0, words, 0), (1, 1, words, 1), (1, 2, "new " + words[::-1], 1)], "page_id long, pos int, text string, quoted int")
    assert sorted(r.pos for r in assemble.drop_quoted_repeats(q).collect()) == [0, 2]
    g = spark.createDataFrame([(1, i, f"/html[1]/ul[1]/li[{i}]/p[1]", 10) for i in range(1, 5)], "page_id long, pos int, xpath string, words int")
    assert [(r.template, r.instances) for r in assemble.repeat_groups(g).orderBy("template").collect()][0] == ("html[1]/ul[1]/li", 4)


def test_site_steps(spark):
    m = spark.createDataFrame([("k", "intro\n# One\ntext\n```\n# not\n```\n## Two\nmore")], "key string, markdown string")
    assert [(r.heading, r.text.split("\n")[0]) for r in site.sections_from_markdown(m).orderBy("section").collect()] == [("", "intro"), ("One", "text"), ("Two", "more")]
    secs = spark.createDataFrame([("p0", "p", 0, None, "H", "Acme Corp makes things"), ("p1", "p", 1, 0, "H2", "nothing"), ("q0", "q", 0, None, "H", "about acme corporate")], "id string, page string, section int, parent int, heading string, text string")
    links = spark.createDataFrame([("p", "q", "see q")], "source string, target string, anchor string")
    spec = spark.createDataFrame([("q", 0.9)], "target string, specificity double")
    e = {(r.source, r.target, r.reason) for r in site.section_edges(secs, links, spec, spark.createDataFrame([("p1", "e"), ("q0", "e")], "id string, entity string")).collect()}
    assert e == {("p0", "p1", "adjacent"), ("p1", "p0", "adjacent"), ("p1", "p0", "parent"), ("p0", "q0", "link"), ("q0", "p0", "back-link"), ("p1", "q0", "mention")}
    assert [tuple(r) for r in site.link_mentions(secs, spark.createDataFrame([("Acme Corp",)], "name string"), 10).collect()] == [("p0", "Acme Corp")]
    assert {r.page: r.line for r in site.map_lines(secs).collect()}["p"].startswith("H")
    now = F.lit("2024-01-10 00:00:00").cast("timestamp")
    got = spark.range(1).select(*(F.date_format(site.since(F.lit(x), now), "yyyy-MM-dd HH") for x in ("3d", "12h", "2024-01-02", "0", "soon"))).first()
    assert tuple(got) == ("2024-01-07 00", "2024-01-09 12", "2024-01-02 00", "1970-01-01 00", None)


def test_chrome_of_a_stream(spark, tmp_path):
    for n in range(8):
        spark.createDataFrame([("s", n, "home"), ("s", n, f"own {n}")], "site string, page_id long, key string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lines = spark.readStream.schema("site string, page_id long, key string").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    stream_chrome(lines).writeStream.format("memory").queryName("chrome").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = spark.table("chrome")
    assert got.count() == 16 and got.where("chrome").select("key").distinct().collect()[0].key == "home" and got.where("chrome").count() in (2, 1)


def test_formulas_and_shadows():
    from pagewright.functions import html as H

    def texts(html):
        return [b["text"] for b in H.Blocks(H.tree(html), "").out]

    assert texts("<p>x <math><mfrac><mi>a</mi><msup><mi>b</mi><mn>2</mn></msup></mfrac><mo>≤</mo><msqrt><mi>c</mi></msqrt></math></p>") == [r"x $\frac{a}{b^2}\leq \sqrt{c}$"]
    assert texts('<math display="block"><semantics><mi>x</mi><annotation encoding="application/x-tex">E=mc^2</annotation></semantics></math>') == ["$$E=mc^2$$"]
    assert texts('<my-card><template shadowrootmode=open><h2><slot name=t>none</slot></h2><p><slot></slot></p></template><b slot=t>Head</b>body</my-card>') == ["Head", "body"]
    assert texts("<body><div id=app></div><noscript><p>" + "word " * 120 + "</p></noscript>") != []
    assert texts("<select><option>a<option>b</select>") == ["a · b"]


def test_subjects(spark):
    from pagewright.operators import facts

    rows = [(1, 0, "json-ld", json.dumps({"@type": "WebSite", "name": "Site"})), (1, 1, "json-ld", json.dumps({"@type": "Product", "name": "Other", "url": "https://e.com/o"})), (1, 2, "json-ld", json.dumps({"@type": "Product", "name": "Mine", "url": "http://www.e.com/p/"})), (1, 3, "open-graph", json.dumps({"og:title": "T", "og:image": "i.png"}))]
    p = spark.createDataFrame(rows, "page_id long, seq int, source string, data string")
    pages = spark.createDataFrame([(1, "https://e.com/p", "product")], "page_id long, url string, page_type string")
    got = {r.path: (json.loads(r.value), r.tier) for r in facts.page_facts(p, pages, {"properties": {"name": {"type": "string"}, "image": {"type": "string"}}}).collect()}
    assert got == {"name": ("Mine", 1), "image": ("i.png", 3)}


def test_product_grids(spark):
    rows = [(1, 0, "Shoe", "heading", 1, "/b[1]/h1[1]", None), (1, 1, "Fine shoe for $90", "paragraph", 0, "/b[1]/p[1]", None)] + [(1, 2 + i, f"Other {i} $5{i}", "paragraph", 0, f"/b[1]/ul[1]/li[{i}]/p[1]", "/x") for i in range(1, 5)]
    b = spark.createDataFrame(rows, "page_id long, pos int, text string, kind string, level int, xpath string, href string").withColumns({"words": T.word_count(F.col("text")), "rows": F.lit(None).cast("array<array<string>>")})
    assert sorted(r.pos for r in assemble.prune_product(b).collect()) == [0, 1]


def test_all_edge_types(spark):
    secs = spark.createDataFrame([("p0", "p", 0, None), ("p1", "p", 1, 0), ("q0", "q", 0, None), ("q1", "q", 1, None), ("q2", "q", 2, None)], "id string, page string, section int, parent int")
    links = spark.createDataFrame([("p", "q", "see q")], "source string, target string, anchor string")
    spec = spark.createDataFrame([("q", 1.0)], "target string, specificity double")
    mentions = spark.createDataFrame([("p0", "e"), ("q0", "e"), ("q2", "e")], "id string, entity string")
    own = spark.createDataFrame([("p1", "q")], "id string, target string")
    parents = spark.createDataFrame([("q", "p"), ("p", None)], "page string, parent string")
    got = {(r.source, r.target, r.reason): r.weight for r in site.section_edges(secs, links, spec, mentions, (), own, parents, 4, True).collect()}
    q = ["q0", "q1", "q2"]
    assert {k: w for k, w in got.items() if k[2] == "link"} == {(a, b, "link"): w for a, w in (("p0", 0.35), ("p1", 1.0)) for b in q}
    assert {k[:2] for k in got if k[2] == "back-link"} == {(a, b) for a in q for b in ("p0", "p1")}
    assert {k[:2]: w for k, w in got.items() if k[2] == "url-parent"} == {(a, b): 0.5 for a in q for b in ("p0", "p1")}
    assert {k[:2] for k in got if k[2] == "mention"} == {x for a in ("p0", "q0", "q2") for x in ((a, "entity:e"), ("entity:e", a))}


def test_noise(spark):
    noise = ["12/03/2024", "2024-03-12T10:15:00Z", "March 3rd, 2024", "3 Sept. 2023", "Last updated on 5 May 2021", "10:45 pm", "1,234 visitors", "Page views: 88", "3 users online", "5 minutes ago", "just now", "© 2019-2024 Acme", "Copyright 2020", "17000", "1,234,567", "posted 2 days ago by Al"]
    content = ["", "Nothing here changes at all", "12 apples", "May the road rise", "It was published in a journal of record on 3 May 2020 with comments", "Section 4", "Visitors are welcome"]
    df = spark.createDataFrame([(t, True) for t in noise] + [(t, False) for t in content], "t string, want boolean")
    assert [r.t for r in df.select("t", "want", T.is_noise(F.col("t")).alias("got")).where("got <> want").collect()] == []
    counts = spark.createDataFrame([("漢字かな 한국 word",), ("ไทย x",), ("豈 a b",)], "t string").select(T.word_count(F.col("t"))).collect()
    assert [r[0] for r in counts] == [7, 4, 3]


def test_inventory(spark):
    from pagewright.functions import html as H
    from pagewright.functions import urls as U
    from pagewright.operators import crawl

    url = lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    found = crawl.inventory(url("https://e.com/a", "https://e.com/b/"), url("https://www.e.com/a/", "https://e.com/c", "mailto:x"), spark.createDataFrame([("https://e.com/a", 200), ("https://e.com/c", 404)], "url string, status int")).cache()
    assert {r.key: (r.via, r.live) for r in found.collect()} == {"https://e.com/a": ("link+sitemap", True), "https://e.com/b": ("sitemap", None), "https://e.com/c": ("link", False)}
    r = crawl.inventory_summary(found).first()
    assert (r.pages, r.checked, r.live, r.dead, r.liveness, r.fully_verified) == (3, 2, 1, 1, 0.5, False)
    assert crawl.inventory_summary(crawl.inventory(url("https://e.com/a"), url())).first().liveness is None
    roots = crawl.resolved_roots(spark.createDataFrame([("http://a",), ("http://z",)], "root string"), spark.createDataFrame([("http://a", "https://a"), ("https://a", "https://www.a/")], "url string, location string"))
    assert {r.root: r.final for r in roots.collect()} == {"http://a": "https://www.a/", "http://z": "http://z"}
    waits = crawl.paced(spark.createDataFrame([("http://e.com/1", 0.0), ("http://e.com/2", 0.0)], "url string, at double"), 2.0, 1.0)
    assert sorted(r.wait for r in waits.collect()) == [0.0, 1.0]
    pages = spark.createDataFrame([(1, 0, None, "x"), (2, 1, "HTTP 500", None)], "page_id long, depth int, error string, html string")
    assert [r.line for r in crawl.crawl_report(pages, spark.createDataFrame([("off-site",)], "refusal string")).collect()] == ["2 pages, 1 failed", "depth 0: 1", "depth 1: 1", "refused, off-site: 1"] and crawl.crawl_record(pages).columns == ["page_id", "depth", "error"]
    x = spark.createDataFrame([("/html[1]/main[1]/div[2]/p[1]",), ("/html[1]/p[1]",)], "x string")
    assert [r[0] for r in x.select(U.ancestor_path(F.col("x"), "div")).collect()] == ["/html[1]/main[1]/div[2]", None]
    assert spark.range(1).select(U.page_url(F.lit("https://e.com/"), F.lit("/d/index.html"))).first()[0] == "https://e.com/d/"
    said = spark.createDataFrame([("Blocked. Please declare your traffic by updating it. Bye.",), ("Access denied.",)], "s string")
    assert [r[0] for r in said.select(walls.declaration_demanded(F.col("s"))).collect()] == ["Please declare your traffic by updating it.", None]
    assert [H.js_string(s) for s in (r'"a\x41\u{1F600}\n"', r"'it\'s \"q\"'", '"')] == ["aA😀\n", 'it\'s "q"', ""]


def test_sanctioned_sources(spark):
    pages = spark.createDataFrame([(1, "https://en.wiki.org/x"), (2, "https://wiki.org/"), (3, "https://notwiki.org/")], "page_id long, url string")
    hints = spark.createDataFrame([("wiki.org", "dumps"), ("en.wiki.org", "english dumps")], "domain string, hint string")
    assert {r.page_id: r.hint for r in walls.sanctioned(pages, hints).collect()} == {1: "english dumps", 2: "dumps"}
