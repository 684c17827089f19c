"""Classifiers, built-in schemas, evaluation and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from pagewright import __main__ as cli
from pagewright.operators import classify, evaluate, facts, parse


def test_names_and_schemas(spark):
    rows = [("A story | Acme", "Acme"), ("Acme: A story", "acme"), ("Acme", "Acme"), ("Macacme", "Acme"), ("A story", None), ("A – Acme", "Acme")]
    df = spark.createDataFrame(rows, "t string, n string")
    assert [r[0] for r in df.select(facts.without_site_name(F.col("t"), F.col("n"))).collect()] == ["A story", "A story", "Acme", "Macacme", "A story", "A"]
    p = spark.createDataFrame([('{"@id":"https://www.e.com/p/#x"}',), ('{"mainEntityOfPage":{"@id":"http://e.com/p"}}',), ('{"url":"https://e.com/q"}',), ("{}",)], "d string")
    assert [r[0] for r in p.select(facts.self_references(F.col("d"), F.lit("https://e.com/p/#x"))).collect()][0] and [r[0] for r in p.select(facts.self_references(F.col("d"), F.lit("https://e.com/p"))).collect()][1:] == [True, False, False]
    assert facts.schema_for("product")["properties"]["price"] == {"type": "number"} and set(facts.schema_for(None)["properties"]) == {"title", "description"}
    meta = spark.createDataFrame([({"og:site_name": " Acme "},), ({"x": "y"},)], "m map<string,string>")
    assert [r[0] for r in meta.select(facts.site_name(F.col("m"))).collect()] == ["Acme", None]


def test_models_as_data(spark):
    leaf = lambda v: {"v": v}
    model = json.dumps({"base": [0.0], "trees": [[0, {"f": 0, "t": 10, "l": leaf(-3.0), "r": leaf(3.0)}]]})
    b = spark.createDataFrame([(1, 0, 50), (1, 1, 3), (2, 0, 4), (2, 1, 5)], "page_id long, pos int, words int")
    assert sorted((r.page_id, r.pos) for r in classify.select_by_model(b, b, ["words"], model).collect()) == [(1, 0), (2, 0), (2, 1)]
    for bad in ("[]", '{"trees": []}', '{"base": [0], "trees": [[1, {"v": 1}]]}', '{"base": [0], "trees": [[0, {"f": 1}]]}'):
        with pytest.raises(ValueError):
            classify.Trees(bad)
    pages = spark.createDataFrame([("<body class='mediawiki ns-0 x'>",), ("<body class='mediawiki ns-14'>",), ("<body class='ns-0'>",)], "h string")
    assert [r[0] for r in pages.select(classify.platform_page_type(F.col("h"))).collect()] == ["article", "listing", None]
    scored = spark.createDataFrame([(1, "forum", 0.6, "article"), (2, "forum", 0.95, "article"), (3, "product", 0.7, "forum")], "page_id long, label string, confidence double, runner_up string")
    word = spark.createDataFrame([(1, "listing"), (2, "listing"), (3, None)], "page_id long, page_type string")
    assert {r.page_id: (r.label, r.runner_up) for r in classify.route(scored, word).collect()} == {1: ("listing", "forum"), 2: ("forum", "article"), 3: ("product", "forum")}


def test_page_features(spark):
    html = '<script type="application/ld+json">{"@type":"https://schema.org/Product"}</script><meta property="og:type" content="og"><nav><a href=/x>x</a></nav><p>Only $5 today. It is good.</p>'
    parsed = parse.parse_pages(spark.createDataFrame([(1, "https://e.com/products/2024/01/a-1?q=2", html)], "page_id long, url string, html string"))
    r = classify.page_features(parsed, parse.blocks_of(parsed)).first()
    assert (r.url_product, r.url_blog, r.url_query, r.url_dated, r.n_nav_links, r.prices) == (1, 0, 1, 1, 1, 1)
    assert classify.payload_types(parsed).first().types == ["Product", "og"]
    f = classify.block_features(parse.blocks_of(parsed)).orderBy("pos").collect()
    assert f[0].next_words == 6 and f[1].prev_words == 1 and f[1].stop_words > 0 and f[0].page_words == 7


def test_order_measures(spark):
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 90.0, 10.0), (1, 1, 0.0, 20.0, 90.0, 10.0), (1, 2, 100.0, 0.0, 90.0, 10.0)], "page_id long, pos int, x double, y double, width double, height double")
    claims = evaluate.order_claims(boxes)
    assert {(r.first, r.second) for r in claims.collect()} == {(0, 1), (0, 2)}
    order = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 2)], "page_id long, pos int, reading_pos int")
    r = evaluate.claims_met(claims, order).first()
    assert (r.claims, r.met) == (2, 1)
    truth, placed = spark.createDataFrame([(1, c, i) for i, c in enumerate("abcd")], "page_id long, key string, pos int"), spark.createDataFrame([(1, c, i) for i, c in enumerate("abdc")], "page_id long, key string, pos int")
    r = evaluate.pairwise_accuracy(truth, placed).first()
    assert (r.pairs, r.right) == (3, 2) and evaluate.ablated(truth, spark.createDataFrame([(1, "b")], "page_id long, key string")).count() == 3


def brute_best_run(texts, wanted):
    want, best, gain = set(wanted.split()), 0.0, 0
    for i in range(len(texts)):
        for j in range(i + 1, len(texts) + 1):
            words = " ".join(texts[i:j]).split()
            hits = sum(w in want for w in words)
            if 2 * hits - len(words) > gain:
                gain, p, r = 2 * hits - len(words), hits / len(words), min(1.0, hits / len(wanted.split()))
                best = 2 * p * r / (p + r)
    return best


def test_bounds_and_leaks(spark):
    texts = ["menu home", "the cat sat here", "ad", "on the mat", "foot note links more"]
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "page_id long, pos int, text string")
    wanted = "the cat sat here on the mat"
    assert evaluate.best_run(b, spark.createDataFrame([(1, wanted)], "page_id long, text string")).first().f1 == pytest.approx(brute_best_run(texts, wanted))
    found = spark.createDataFrame([(1, "a b c d e f g"), (2, "x")], "page_id long, text string")
    bad = spark.createDataFrame([(1, "b c d e f z"), (2, "secret")], "page_id long, text string")
    assert {r.page_id: r.leaked for r in evaluate.leak_score(found, bad).collect()} == {1: 0.5, 2: 0.0}
    v = spark.createDataFrame([("1.0", "1"), ("A  b", "a B"), (None, None), ("x", None), (None, "x"), ("2", "3")], "e string, a string")
    assert [r[0] for r in v.select(evaluate.verdict(F.col("e"), F.col("a"))).collect()] == ["correct", "correct", "correct", "missing", "wrong", "wrong"]
    s = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "mode string, f1 double")
    assert [(r.mode, r.n, r.f1) for r in evaluate.summarise(s, "mode", "f1").collect()] == [("a", 2, 0.5), ("b", 1, 1.0)]


def test_command_line(spark, tmp_path, capsys):
    html = '<html lang=en><head><title>Acme | T</title><script type="application/ld+json">{"@type":"Article","headline":"Head","name":"N"}</script></head><body><h1>Head of the page</h1><p>' + "anvils are made here by many people every day " * 5 + "</p></body></html>"
    for name in ("a.html", "b.html"):
        (tmp_path / name).write_text(html)
    folder = f"file://{tmp_path}"
    assert cli.main(["text", folder]) == 0 and "anvils" in capsys.readouterr().out
    assert cli.main(["ask", folder, "--question", "who makes anvils"]) == 0 and "## Head of the page" in capsys.readouterr().out
    assert cli.main(["extract", folder, "--type", "article"]) == 0 and "known-alias" in capsys.readouterr().out
    assert cli.main(["report", folder]) == 0 and "site.example" in capsys.readouterr().out
    store = f"file://{tmp_path}/store"
    assert cli.main(["diff", folder, "--store", store, "--fail-on-change"]) == 1 and "2 added" in capsys.readouterr().out
    assert cli.main(["diff", folder, "--store", store, "--fail-on-change"]) == 0 and "2 unchanged" in capsys.readouterr().out
    (tmp_path / "gold.json").write_text(json.dumps([{"id": "a", "url": "https://e.com/a", "file": "a.html", "facts": {"title": "N"}}]))
    assert cli.main(["bench", folder, "--type", "article", "--gate", "0.5"]) in (0, 1)
    assert cli.main(["config"]) == 0 and "operators.site.K1 = 1.5" in capsys.readouterr().out
    assert cli.settings({"PAGEWRIGHT_SPARK_SQL_SHUFFLE_PARTITIONS": "7", "X": "1"}) == {"spark_sql_shuffle_partitions": "7"}
    pages = spark.createDataFrame([(1, "https://e.com/", html), (2, "https://e.com/b", "<div id=app></div>")], "page_id long, url string, html string")
    assert cli.probe(pages)["strategy"] == "union" and cli.probe(pages.where("page_id = 2"))["strategy"] == "rendered-only"
