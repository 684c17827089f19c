"""The reader: pages that break parsers, linear time, and every kind of block."""

import time

import pytest

from pagewright.functions import dom
from pagewright.functions import html as H
from pagewright.operators import parse


def blocks(html, base="https://e.com/d/"):
    return H.Blocks(H.tree(html), base).out


def texts(html):
    return [b["text"] for b in blocks(html)]


BAD = {
    "nested inline": ("<span>" * 5000 + "x <a href=/k>link</a>" + "</span>" * 5000, ["x link"]),
    "nested blocks": ("<div>" * 5000 + "deep <a href=/k>link</a> text", None),
    "nested json": ('<script type="application/ld+json">' + "[" * 5000 + "]" * 5000 + "</script><p>ok</p>", ["ok"]),
    "declaration": ("<p>a</p><![foo", None),
    "open comment": ("<p>a</p><!-- " * 1000, ["a"]),
    "open quotes": ('<p>a</p><a b="' * 5000 + ">", None),
    "open tags": ("<p>a</p>" + "<a " * 50000, None),
    "equals": ("<p ==" + "=" * 50000 + ">a", ["a"]),
    "attributes": ("<p " + "a=1 " * 50000 + ">a", ["a"]),
    "open script": ("<p>a</p><script>x <p>b", ["a"]),
    "bad spans": ("<table><tr><th colspan=99999999>a<tr><td rowspan=x>b</table>", None),
}


@pytest.mark.parametrize("name", BAD)
def test_bad_pages_are_read(name):
    html, want = BAD[name]
    began = time.perf_counter()
    page = parse.read_page(html, "https://e.com/")
    assert page["error"] is None and time.perf_counter() - began < 10
    if want is not None:
        assert [b["text"] for b in page["blocks"]] == want
    if "link" in html:
        assert [x["href"] for x in page["links"]] == ["https://e.com/k"] and any("link" in b["text"] for b in page["blocks"])


def test_one_bad_page_harms_no_other(spark, monkeypatch):
    rows = [(1, "https://e.com/1", "<p>fine</p>"), (2, "https://e.com/2", None), (3, "https://e.com/3", " "), (4, None, "<span>" * 9000 + "x"), (5, "http://[bad", "<a href='//[x'>t</a>"), (6, "https://e.com/6", "<p>" + "x" * (33 << 20))]
    got = {r.page_id: r for r in parse.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == 6 and {k for k, r in got.items() if r.error} == {2, 3, 6}
    assert [b.text for b in got[1].blocks] == ["fine"] and [b.text for b in got[4].blocks] == ["x"]


def test_time_grows_with_the_page():
    def took(n):
        html = "<body>" + "".join(f"<p>Some words with <a href='/p/{i}'>a link</a> and <b>more</b> of them.</p>" for i in range(n))
        began = time.perf_counter()
        assert len(parse.read_page(html, "https://e.com/")["blocks"]) == n
        return time.perf_counter() - began

    took(500)
    small, large = took(2500), took(20000)
    assert large < 20 * small and large < 8


def test_hidden_text():
    assert texts("<p>a<a class=headerlink href='#x'>link</a></p><h2>T <a href='#t'>¶</a></h2>") == ["a", "T"]
    assert texts("<p>x <span class=sr-only>Opens in a new window</span></p><h1 class=sr-only>The real title of it</h1>") == ["x", "The real title of it"]
    assert texts("<p>a</p><div style='position:absolute; left:-9999px'>spam</div><div style='left:-20px'>b</div>") == ["a", "b"]
    assert texts("<dialog>closed</dialog><dialog open>open</dialog><div role=dialog aria-hidden=true>x</div>") == ["open"]
    assert texts("<p>a</p><div hidden>unreachable</div><button aria-controls=k>more</button><div id=k style='display:none'>tray</div>") == ["a", "more", "tray"]
    assert texts("<p><span data-hidden-by=display>NEW</span><span>NEW</span></p>") == ["NEW"]
    assert texts("<p data-hidden-by=clipped>a</p><button data-hidden-by=opacity>Copy</button><p>b</p>") == ["b"]
    assert [b["text"] for b in H.Blocks(H.tree("<p>x</p><p class=sr-only>y</p>", keep_hidden=True), "").out] == ["x", "y"]


def test_formulas():
    assert texts(r"<p>so \(a+b\) and \[c\]</p><pre>\(x\)</pre>") == ["so $a+b$ and $$c$$", r"\(x\)"]
    assert texts("<p>e <span class=MathJax>drawn</span><script type='math/tex'>E=mc^2</script></p>") == ["e $E=mc^2$"]
    assert texts("<p>w <span class=mwe-math-element><span><math><mi>x</mi></math></span><img class=mwe-math-fallback-image src=f.svg></span></p>") == ["w $x$"]


def test_inline_markup():
    b = blocks("<p>H<sub>2</sub>O, x<sup>10</sup>, <b> bold </b>, <a href=k>go <em>on</em></a> <code>c</code></p>")[0]
    assert b["text"] == "H₂O, x¹⁰, bold , go on c" and b["rich_text"] == "H₂O, x¹⁰, **bold** , [go *on*](https://e.com/d/k) `c`"
    assert [x["text"] for x in blocks("<p>one<br><br>two<br>three</p>")] == ["one", "two\nthree"]


def test_pictures_and_media():
    rows = blocks("<a href=/t><img src=s.png srcset='a.png 300w, b.png 900w' alt=' An  image '></a><img src=x.gif width=1><img src='data:x'><picture><source srcset='big.webp 2x'><img src=small.jpg></picture><iframe src=/v title=Video></iframe>")
    assert [(b["kind"], b["text"], b["href"], b["link"]) for b in rows] == [("image", "An image", "https://e.com/d/b.png", "https://e.com/t"), ("image", "", "https://e.com/d/big.webp", None), ("media", "Video", "https://e.com/v", None)]
    assert texts("<svg><path d='M0'/><text>Load</text><text>Store</text></svg><svg><title>icon</title></svg>") == ["Load, Store"]


def test_tables():
    t = blocks("<table><caption>Sales</caption><thead><tr><th rowspan=2>Region<th colspan=2>2025<tr><th>Q1<th>Q2</thead><tr><td><a href=/n>North</a><td>1<td>2</table>")[0]
    assert t["rows"] == [["Region", "2025 Q1", "2025 Q2"], ["North", "1", "2"]] and t["text"].startswith("Sales\nRegion | 2025 Q1")
    assert t["rich_rows"][1][0] == "[North](https://e.com/n)" and '<th rowspan="2">Region' in t["table_html"] and 'href="https://e.com/n"' in t["table_html"]
    plain = blocks("<table><tr><th>a<th>b<tr><td>1<td>2</table>")[0]
    assert plain["rich_rows"] is None and plain["table_html"] is None
    assert [b["kind"] for b in blocks("<table><tr><td><h2>Head</h2><p>one</p><p>two</p><td>side</table>")] == ["heading", "paragraph", "paragraph", "paragraph"]
    assert dom.fold(H.cell_text(H.first(H.tree("<table><tr><td>a<table><tr><td>in</table>b</table>"), "td"))) in ("a b", "ab")


def test_code():
    rows = blocks("<div class=head><span>js</span><button>Copy</button></div><pre><code class='hljs language-js'>a<br>b</code></pre><p>prose here</p><pre class='brush: css;'>x</pre><pre data-lang=undefined>y</pre>")
    assert [(b["kind"], b["text"], b["language"]) for b in rows] == [("code", "a\nb", "js"), ("paragraph", "prose here", None), ("code", "x", "css"), ("code", "y", None)]
    editor = "<div class=monaco-editor data-mode-id=sql><div class=view-lines><div class=view-line style='top:19px'>from t</div><div class=view-line style='top:0px'>select 1</div></div><div class=margin>1 2</div></div>"
    assert [(b["kind"], b["text"], b["language"]) for b in blocks(editor)] == [("code", "select 1\nfrom t", "sql")]
    whole = "<div class=cm-editor><div class=cm-content data-language=css><div class=cm-line>a {</div></div></div><pre style='display:none'>a {\n  b: c\n}</pre>"
    assert [b["text"] for b in blocks(whole)] == ["a {\n  b: c\n}"]


def test_regions_and_panels():
    filler = "<main>" + "<p>many words of the page itself stand here</p>" * 30
    page = filler + "<aside class='note'>callout</aside><aside>side</aside><div class='sidebar most-read'>rail</div><ol class=comment-list><li>said</ol><p class=comment-count>3</p><div class=cookie-banner>we use</div><div class=filters><input>by size</div><div class=signature>me</div><div class=entry-content><p>body</p></div><div v-if=x>maybe</div><div data-floats=left>float</div></main>"
    got = {b["text"]: b for b in blocks(page)}
    assert got["callout"]["region"] is None and got["side"]["region"] == "aside"
    assert [got[t]["widget"] for t in ("rail", "said", "3", "we use", "by size", "me")] == ["rail", "comments", None, "consent", "filter", "post-furniture"]
    assert got["body"]["body_of"] and got["maybe"]["templated"] == "v-if" and got["float"]["float_of"] and got["side"]["aside"]
    assert {b["widget"] for b in blocks("<body><div class=filters><input>all of the page is this</div>")} == {None}


def test_direction():
    assert H.is_rtl(H.tree("<html lang=az-Arab>x")) and H.is_rtl(H.tree("<html lang=ckb>x")) and not H.is_rtl(H.tree("<html lang=ar dir=ltr>x"))
