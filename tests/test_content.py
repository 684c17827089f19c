"""Content selection step by step, on pages that need each step."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import assemble, parse
from pagewright.operators.assemble import Selection



def prose(n, first=0):
    """n paragraphs of the story, no two alike."""
    return "".join(f"<p>Part {i} of it. {f'words of part {i} that go on for a good while without any link ' * 3}</p>" for i in range(first, first + n))


P = prose(1, 90)
LINKS = "<ul>" + "".join(f"<li><a href=/l{i}>Somewhere else {i}</a></li>" for i in range(12)) + "</ul>"


@pytest.fixture(scope="module")
def run(spark):
    def select(*pages, how=Selection(), title="The story of the day - Daily"):
        rows = [(i, "https://e.com/p", f"<html><head><title>{title}</title></head><body>{h}</body></html>") for i, h in enumerate(pages)]
        parsed = parse.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
        b = assemble.dedup_blocks(parse.blocks_of(parsed)).cache()
        titles = parsed.select("page_id", F.col("meta")["title"].alias("title"))
        kept = assemble.select_content(b, titles, how=how)
        texts = {i: [] for i in range(len(pages))}
        for r in kept.orderBy("page_id", "pos").collect():
            texts[r.page_id].append(r.text)
        steps = {(r.page_id, r.step): r.removed for r in assemble.removals(b, assemble.selection_steps(b, titles, how=how)).collect()}
        return texts, steps

    return select


def test_steps(run):
    nav = f"<nav>{LINKS}</nav><select><option>a<option>b</select><div class='comments'><p>first!</p></div>"
    bodies = f"<div class=entry-content>{prose(3)}</div><div><p>{'outside the body of it ' * 9}</p></div>"
    texts, steps = run(nav + prose(4), f"<p>side words</p><main>{prose(4)}</main>", f"<article>{prose(4)}</article><article>teaser</article>", bodies, LINKS + prose(3) + LINKS.replace("/l", "/m"))
    assert steps[0, "landmarks"] == 13 and steps[0, "comments"] == 1 and (1, "main") in steps and (2, "article") in steps and (3, "article-body") in steps and steps[4, "main-run"] == 24
    assert all("Somewhere else 1" not in x for x in texts[4]) and texts[3] and not any("outside" in x for x in texts[3])


def test_title_lead_and_rules_come_back(run):
    texts, _ = run(f"<h1>The story of the day</h1><p>By A. Writer</p>{LINKS}{P}<hr>{prose(2)}", f"<h1>The story of the day</h1><p>By A. Writer</p><p>3 May</p><main>{P}<hr>{prose(2)}</main>")
    assert texts[0][0] == "The story of the day" and "By A. Writer" not in texts[0] and "" in texts[0]
    assert texts[1][:3] == ["The story of the day", "By A. Writer", "3 May"]


def test_code_and_its_introduction_stay(run):
    texts, _ = run(LINKS + prose(2) + "<p>Like this:</p><pre>x = 1</pre>" + LINKS)
    assert "x = 1" in texts[0] and "Like this:" in texts[0] and not any("Somewhere" in x for x in texts[0])


def test_page_types(run):
    thread = f"<div class=comments>{P}<blockquote>{P}</blockquote></div>" + "<p>short</p>"
    assert len(run(thread, how=assemble.policy_for("forum"))[0][0]) == 1
    story = f"{prose(2)}<h2>Related stories</h2>{LINKS}<p>{'and so the story goes on and on. ' * 6}</p>{prose(2, 50)}"
    texts, steps = run(story, how=assemble.policy_for("article"))
    assert steps[0, "sections"] == 13 and any("goes on" in x for x in texts[0])
    grid = "<h1>A thing</h1>" + prose(2) + "".join(f"<div class=g><div><a href=/t{i}>Thing {i}</a><span>$ {i}9.00</span></div></div>" for i in range(5))
    assert (0, "product") in run(grid, how=assemble.policy_for("product"))[1]
    assert assemble.policy_for("nothing") == Selection()


def test_block_kinds(spark):
    rows = [("paragraph", "word " * 40, 40, 0.0), ("paragraph", "It ends a sentence of a dozen words and not a word more than that.", 14, 0.0), ("image", "", 0, 0.0), ("paragraph", "Weight: 3 kg", 3, 0.0), ("paragraph", "word " * 40, 40, 0.9)]
    b = spark.createDataFrame(rows, "kind string, text string, words int, link_density double").withColumn("rows", F.lit(None).cast("array<array<string>>"))
    got = b.select(assemble.is_prose(), assemble.is_sentence(), assemble.is_river_furniture(), assemble.is_spec()).collect()
    assert [tuple(r) for r in got] == [(True, False, False, False), (False, True, False, False), (False, False, True, False), (False, False, True, True), (False, False, False, False)]


def test_drawn_copies(spark):
    rect = lambda x: {"x": float(x), "y": 0.0, "width": 9.0, "height": 9.0}
    rows = [(1, 0, "a", None), (1, 1, "a", rect(5)), (1, 2, "a", rect(5)), (1, 3, "a", rect(50)), (1, 4, "b", None), (1, 5, "b", None)]
    b = spark.createDataFrame(rows, "page_id long, pos int, key string, rect struct<x:double,y:double,width:double,height:double>").withColumns({"href": F.lit(None).cast("string"), "kind": F.lit("paragraph"), "in_main": F.lit(False)})
    assert sorted(r.pos for r in assemble.dedup_drawn(b).collect()) == [1, 3, 4]


def test_markdown_of_tables_and_linked_pictures(spark):
    html = "<table><tr><th>n<th>v<tr><td><a href=/a>A</a><td>1|2</table><a href=/big><img src=s.png alt='[x]'></a><table><tr><th colspan=2>wide<tr><td>1<td>2</table>"
    b = parse.blocks_of(parse.parse_pages(spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string")))
    md = assemble.markdown_of(b).first().markdown
    assert "| [A](https://e.com/a) | 1\\|2 |" in md and "[![\\[x\\]](https://e.com/s.png)](https://e.com/big)" in md and '<th colspan="2">wide</th>' in md
    assert "[A]" not in assemble.markdown_of(b, links=False).first().markdown


def test_pages_by_canvas_and_types(spark):
    pages = spark.createDataFrame([(1, "https://e.com/", "<canvas></canvas><p>few</p>"), (2, "https://e.com/", "<p>few</p><script type='application/ld+json'>{\"@graph\":[{\"@type\":[\"Article\"]},{\"@type\":\"https://schema.org/Person\"}]}</script>")], "page_id long, url string, html string")
    parsed = parse.parse_pages(pages)
    assert {r.page_id: r.canvas for r in assemble.canvas_pages(parsed, pages).collect()} == {1: True, 2: False}
    assert {r.page_id: r.types for r in assemble.schema_types(parse.payloads_of(parsed)).collect()} == {2: ["Article", "Person"]}
