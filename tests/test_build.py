"""Building a knowledge graph, and what readers ask of it."""

import pytest
from pyspark.sql import functions as F

from pagewright.operators import build, parse

TEXTS = {1: ["Ada Lovelace met Charles Babbage on 5 June 1833.", "It cost $1,200 then."], 2: ["Ada Lovelace wrote to Charles Babbage."], 3: ["Ada Lovelaces wrote notes.", "**Ada  Lovelace** again"]}


@pytest.fixture(scope="module")
def blocks(spark):
    return spark.createDataFrame([(p, i, t) for p, ts in TEXTS.items() for i, t in enumerate(ts)], "page_id long, pos int, text string").cache()


def test_columns(spark):
    df = spark.createDataFrame([("isBasedIn", "works-for", "local business", "  short ", "{x}"), ("wasFoundedBy", "employed by", "Person", "x" * 300, "")], "p string, q string, t string, v string, w string")
    got = df.select(build.normalise_predicate(F.col("p")), build.normalise_predicate(F.col("q")), build.pascal(F.col("t")), build.scalar(F.col("v")), build.scalar(F.col("w"))).collect()
    assert [tuple(r) for r in got] == [("located_in", "works_for", "LocalBusiness", "short", None), ("founded_by", "works_for", "Person", None, None)]
    names = spark.createDataFrame([("5 June 1833",), ("Acme Inc.",), ("Dr. No",), ("a@b.org",), ("Rome",)], "n string")
    assert [r[0] for r in names.select(build.guess_type(F.col("n"))).collect()] == ["Date", "Organization", "Person", "Email", "Thing"]
    near = spark.createDataFrame([("one two three NEEDLE four five", "needle"), ("none", "needle")], "t string, n string").select(build.window_of(F.col("t"), F.col("n"), 2)).collect()
    assert [r[0] for r in near] == ["two three NEEDLE four five", None]
    assert build.parse_reply('Sure:\n```json\n{"a": 1}\n```') == {"a": 1} and build.parse_reply("x [1] y") == [1] and build.parse_reply("no") is None


def test_verification(spark, blocks):
    rows = [(1, 0, "Ada Lovelace", "ada  LOVELACE met charles"), (3, 1, "Ada Lovelace", "Ada Lovelace again"), (1, 0, "Ada Lovelace", "never said"), (1, 9, "Ada", "x"), (1, 0, "Ada", " "), (1, 0, "Ada", "Charles Babbage")]
    a = spark.createDataFrame([(*r, "Person", None, None, None) for r in rows], "page_id long, pos int, subject string, quote string, subject_type string, predicate string, object string, object_type string")
    kept, rejected = build.verify(a, blocks)
    got = {(r.page_id, r.pos): TEXTS[r.page_id][r.pos][r.start : r.end] for r in kept.collect()}
    assert got[1, 0] == "Ada Lovelace met Charles" and got[3, 1].startswith("Ada  Lovelace") and len(got) == 2
    assert {r.reason: r.rejected for r in rejected.collect()} == {"quote not in block": 1, "no such block": 1, "no quote": 1, "quote does not name the subject": 1}


def test_types_give_way(spark):
    d = spark.createDataFrame([("person", "Ada"), ("thing", "ADA"), ("thing", "Rome"), ("Place", "Bath"), ("Product", "Bath"), ("thing", "Bath")], "type string, name string")
    got = {(r.name, r.type) for r in build.homes(d).collect()}
    assert got == {("Ada", "Person"), ("ADA", "Person"), ("Rome", "Thing"), ("Bath", "Place"), ("Bath", "Product"), ("Bath", "Thing")}


def test_merge_chains(spark):
    m = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(20)] + [("x", "y")], "loser string, winner string")
    got = {r.loser: r.winner for r in build.resolve_merges(m).collect()}
    assert got == {f"n{i}": "n20" for i in range(20)} | {"x": "y"}


def test_a_graph(spark, blocks):
    g = build.build_graph(blocks)
    entities = {r.name: r for r in g["entities"].collect()}
    assert entities["Ada Lovelace"].evidence == 2 and {"Charles Babbage", "5 June 1833", "$1,200"} <= set(entities)
    relations = {(r.subject_id, r.predicate, r.object_id): r.evidence for r in g["relations"].collect()}
    a, b = entities["Ada Lovelace"].entity_id, entities["Charles Babbage"].entity_id
    assert relations[a, "near_name", b] == 2 and g["rejected"].count() == 0
    assert {(r.source, r.target): r.weight for r in build.adjacency(g["relations"]).collect()}[b, a] == 2
    top = build.entity_summaries(g["entities"], g["relations"], 2).collect()
    assert [r.name for r in top][0] == "Charles Babbage" and top[0].degree == 2
    assert build.relation_summaries(g["relations"], spark.createDataFrame([(a,), (b,)], "entity_id string")).count() == 1
    stats = {(r.kind, r.name): r.n for r in build.graph_stats(g["entities"], g["mentions"], g["relations"]).collect()}
    assert stats["total", "pages"] == 3 and stats["predicate", "near_name"] == 1
    secs = spark.createDataFrame([("s", 1, 0, 0)], "section_id string, page_id long, first_pos int, last_pos int")
    assert build.entities_in(g["mentions"], secs).count() == 3
    assert build.prepare(blocks, secs.unionByName(spark.createDataFrame([("t", 3, 0, 5)], secs.schema))).where("section_id = 't'").first().text == "[0] Ada Lovelaces wrote notes.\n[1] **Ada  Lovelace** again"
    assert [r.id for r in build.overlap_search(blocks.withColumn("k", F.concat_ws("-", "page_id", "pos")), "k", F.col("text"), "who wrote notes", 1).collect()] == ["3-0"]


def test_structured_entities_need_their_words(spark):
    html = '<script type="application/ld+json">[{"@type":"Person","name":"Ada Lovelace"},{"@type":"Person","name":"Nobody Here"}]</script><p>by ada lovelace</p>'
    parsed = parse.parse_pages(spark.createDataFrame([(1, "https://e.com/", html)], "page_id long, url string, html string"))
    got = build.structured_drafts(parse.payloads_of(parsed), parse.blocks_of(parsed)).collect()
    assert [(r.type, r.name, r.start, r.end) for r in got] == [("Person", "Ada Lovelace", 3, 15)]
