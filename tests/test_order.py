"""Reading order, and resolution of plain and rendered copies."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import order, parse, resolve
from pagewright.operators.order import Box


def read(boxes, paths=None, rtl=False, floats=None):
    boxes = [Box(*b) for b in boxes]
    unit = order.line_unit([b.height for b in boxes])
    return [b.id for b in order.with_cards(boxes, paths or {b.id: f"/b[{b.id}]" for b in boxes}, floats or {}, unit, rtl)]


def test_columns_and_rows():
    page = [(1, 0, 0, 300, 20), (2, 0, 40, 140, 20), (3, 0, 64, 140, 20), (4, 180, 40, 140, 20), (5, 180, 64, 140, 20)]
    assert read(page) == [1, 2, 3, 4, 5] and read(page, rtl=True) == [1, 4, 5, 2, 3]
    assert order.columns_of([Box(*b) for b in page[1:]], 20) == 2
    assert read([(2, 100, 2, 50, 20), (1, 0, 0, 50, 20)]) == [1, 2]
    assert order.gaps([(0, 10), (30, 40), (41, 50), (70, 80)], 8) == ([20, 60], 20)


def test_rails_and_backdrops():
    boxes = [Box(1, 0, 0, 100, 20), Box(2, 140, 0, 100, 20), Box(3, 118, 0, 12, 900), Box(4, 0, 0, 800, 900), Box(5, 0, 40, 100, 20)]
    assert order.unmeasured(boxes, {3, 4}, 20) == {3, 4} and order.unmeasured(boxes, set(), 20) == {3}
    assert order.holds(boxes[3], boxes[0]) and not order.holds(boxes[0], boxes[3]) and order.overlap(boxes[0], boxes[4], 0) == 100


def test_bridged_gutter():
    left, right = [(i, 0, 30 * i, 100, 20) for i in range(1, 31)], [(100 + i, 140, 30 * i, 100, 20) for i in range(1, 31)]
    wide = [(999, 0, 925, 240, 900)]
    got = read([*left, *right, (500, 60, 455, 120, 8)])
    assert [g for g in got if g < 100] == list(range(1, 31)) and got.index(101) > got.index(30)
    assert len(read([*left, *right, *wide])) == 61


def test_cards_stay_whole():
    boxes, paths = [], {}
    for c in range(6):
        for k, (y, h) in enumerate(((0, 200), (225, 20), (250, 20))):
            i = 10 * c + k
            boxes.append((i, 320 * c, y, 312, h))
            paths[i] = f"/main[1]/ul[1]/li[{c + 1}]/p[{k + 1}]"
    assert read(boxes, paths) == sorted(i for i, *_ in boxes)
    assert read(boxes) != sorted(i for i, *_ in boxes)  # without cards the rows are read across


def test_order_of_pages(spark):
    blocks = spark.createDataFrame([(1, 0, "/a[1]", "t"), (1, 1, "/a[2]", "t"), (1, 2, "/a[3]", "t"), (2, 0, "/a[1]", "t"), (3, 0, "/a[1]", "t"), (3, 1, "/a[2]", "t"), (4, 0, "/a[1]", "l"), (4, 1, "/a[2]", "r")], "page_id long, pos int, xpath string, text string")
    rects = spark.createDataFrame([(1, "/a[1]", 200.0, 0.0, 100.0, 20.0), (1, "/a[3]", 0.0, 0.0, 100.0, 20.0), (4, "/a[1]", 0.0, 0.0, 100.0, 20.0), (4, "/a[2]", 200.0, 0.0, 100.0, 20.0)], "page_id long, xpath string, x double, y double, width double, height double")
    pages = spark.createDataFrame([(4, True)], "page_id long, rtl boolean")
    got = {(r.page_id, r.pos): r for r in order.order_blocks(blocks, rects, pages).collect()}
    assert [got[1, p].reading_pos for p in (0, 1, 2)] == [1, 2, 0] and got[1, 0].method == "anchored" and got[1, 0].differs
    assert got[2, 0].method == "single" and got[3, 0].method == "dom" and not got[3, 0].differs
    assert [got[4, p].reading_pos for p in (0, 1)] == [1, 0] and got[4, 0].method == "xy-cut" and got[4, 0].columns == 2


def test_choice_and_failures(spark):
    schema = "page_id long, status int, error string, html string, words int"
    plain = spark.createDataFrame([(1, 200, None, "<p>x", 50), (2, 403, None, "<h1>No</h1><script>x</script> entry", 2), (3, 200, None, "<div id=app>", 0), (4, None, "timed out", None, None), (5, 200, None, " ", 0)], schema)
    drawn = spark.createDataFrame([(1, 200, None, "<p>x", 60), (2, 200, None, "<p>x", 60), (4, None, "crashed", None, None), (6, 200, None, "<p>y", 30)], schema)
    got = {r.page_id: (r.strategy, r.error) for r in resolve.choose(plain, drawn).collect()}
    assert got[1] == ("union", None) and got[2] == ("rendered-only", None) and got[6] == ("rendered-only", None)
    assert got[3][1] == "plain fetch: a script shell without readable text; browser: not tried" and got[4][1] == "plain fetch: could not be fetched: timed out; browser: could not be fetched: crashed" and "empty answer" in got[5][1]
    assert [r[0] for r in resolve.choose(plain, drawn, "static-only").where("page_id = 2").select("error").collect()][0].startswith("plain fetch: HTTP 403: No entry")


def test_union_and_coverage(spark):
    def blocks(html):
        return parse.blocks_of(parse.parse_pages(spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string")))

    plain, drawn = blocks("<p>one</p><p>only plain</p><p>two</p>"), blocks("<p>one</p><p>two</p><p>only drawn</p>")
    chosen = spark.createDataFrame([(1, "union")], "page_id long, strategy string")
    union = resolve.resolve(plain, drawn, chosen)
    assert [(r.text, r.from_static) for r in union.orderBy("pos").collect()] == [("one", False), ("only plain", True), ("two", False), ("only drawn", False)]
    c = resolve.coverage(plain, drawn, union).first()
    assert (c.static_chars, c.rendered_chars, c.union_chars, c.render_lost_content) == (16, 16, 26, True) and c.static_coverage == pytest.approx(16 / 26)


def test_frames_and_declared_addresses(spark):
    frames = "<frameset><frame src=a.html><frame src='/b.html'><frame src='http://other.org/x'></frameset>"
    pages = spark.createDataFrame([(1, "http://e.com/d/", frames), (2, "http://e.com/p", "<p>plain</p>")], "page_id long, url string, html string")
    known = spark.createDataFrame([("http://e.com/d/a.html", "<p>first</p>"), ("http://e.com/b.html", "<frameset><frame src=c.html></frameset>"), ("http://e.com/c.html", "<p>inner</p>")], "url string, html string")
    got = {r.page_id: [b.text for b in r.blocks] for r in parse.parse_pages(resolve.compose_framesets(pages, known)).collect()}
    assert got[2] == ["plain"] and got[1][0] == "first"
    supplied = spark.createDataFrame([("<link rel='canonical' href='https://a.com/x'>", "u"), ('<meta property="og:url" content="https://a.com/y">', "u"), ("<p>", "u")], "html string, url string")
    assert [r[0] for r in supplied.select(resolve.declared_url(F.col("html"), F.col("url"))).collect()] == ["https://a.com/x", "https://a.com/y", "u"]


def test_runtime_evidence(spark):
    rows = [(1, "https://e.com/a.js", "script", ["s"]), (1, "https://cdn.org/x", "xhr", ["s", "t"]), (2, "https://e.com/", "document", None)]
    got = {r.page_id: r for r in resolve.runtime_evidence(spark.createDataFrame(rows, "page_id long, url string, resource string, cookies array<string>")).collect()}
    assert (got[1].requests, got[1].hosts, got[1].scripts, got[1].xhr, got[1].cookies) == (2, ["cdn.org", "e.com"], 1, 1, ["s", "t"])
