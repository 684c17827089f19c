"""Technology rules: literals derived from patterns, signals, merging, profiles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagewright.operators import parse, tech


@pytest.mark.parametrize("pattern, clause", [(r"jquery[.@/-]([\d.]*\d)?[^/]*\.js", {"jquery.", "jquery@", "jquery/", "jquery-"}), (r"(?:google\.com|gstatic\.com)/x", {"google.com/x", "gstatic.com/x"}), (r"nginx(?:/([\d.]+))?", {"nginx"}), (r"\d+", set()), (r"(?:ab)+c?", {"ab"}), (r"a|bcd", {"a", "bcd"})])
def test_best_clauses(pattern, clause):
    assert tech.best_clause(pattern) == clause


def test_literals_are_required():
    """Texts that match, grown at random from pieces of the patterns, hold a literal of every clause."""
    rng, hits = random.Random(3), 0
    rules = [p for *_, p in tech.SIGNAL_RULES if len(p) > 1] + [p for *_, p in tech.RULES]
    for p in rules:
        clauses, bare = tech.required_literals(p), re.sub(r"[\\()?:+*\[\]^$|]", "", p)
        for _ in range(200):
            text = "".join(rng.choice([bare[(k := rng.randrange(len(bare))) : k + rng.randrange(1, 30)], ".js", "/", "1.2", "<script>track("]) for _ in range(4)).lower()
            if re.search(p, text):
                hits += 1
                assert all(any(x in text for x in c) for c in clauses), (p, text)
    assert hits > 50


def test_signals(spark):
    rows = [(1, "header", "Server", "nginx/1.18.0"), (1, "header", "X-Powered-By", "PHP/8.1"), (1, "cookie", "PHPSESSID", None), (1, "asset", "", "/js/jquery-3.6.0.min.js"), (1, "global", "jQuery", None), (1, "request", "", "https://js.stripe.com/v3"), (2, "header", "server", "other"), (2, "bundle", "", "var a=__webpack_require__(1)")]
    got = {(r.page_id, r.technology): (r.version, r.confidence) for r in tech.detect_signals(spark.createDataFrame(rows, "page_id long, signal string, key string, value string")).collect()}
    assert got == {(1, "nginx"): ("1.18.0", 1.0), (1, "PHP"): ("8.1", 1.0), (1, "jQuery"): ("3.6.0", 1.0), (1, "Stripe"): ("", 0.95), (2, "webpack"): ("", 0.75)}


def test_assets_and_profiles(spark):
    html = "<script src='/a.js'></script><link href=https://www.e.com/b.css><img src='//cdn.org/c.png'><div id=\"__next\"></div><script id=\"__NEXT_DATA__\" type=application/json>{\"a\":1}</script>"
    pages = spark.createDataFrame([(1, "https://e.com/", html), (2, "https://e.com/b", "<p>" + "plain text " * 40)], "page_id long, url string, html string")
    assert {(r.asset, r.same_site) for r in tech.assets(pages).collect()} == {("/a.js", True), ("https://www.e.com/b.css", True), ("//cdn.org/c.png", False)}
    got = {r.page_id: r for r in tech.profile_pages(pages, parse.parse_pages(pages)).collect()}
    assert got[1].requires_render and got[1].has_state and "Next.js" in got[1].frameworks and not got[2].requires_render and got[2].frameworks == []
    asks = spark.createDataFrame([("<noscript>You need to enable JavaScript</noscript><p>x</p>", 1), ("<p>x</p>", 1), ("<script>x</script>", 0)], "h string, n int")
    assert [r[0] for r in asks.select(tech.needs_render(F.col("h"), F.col("n"))).collect()] == [True, False, True]
