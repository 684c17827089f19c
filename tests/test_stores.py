"""Stores of watches, graphs and knowledge; feeds with bodies; event logs."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from pagewright.sources import readers, sinks, stores

PAGE = "key string, url string, status int, content_hash string, title string, text string"


def pages(spark, *rows):
    return spark.createDataFrame([(k, f"https://e.com/{k}", s, str(hash(t)), k.upper(), t) for k, s, t in rows], PAGE)


@pytest.fixture(scope="module")
def watched(spark, tmp_path_factory):
    store = stores.WatchStore(spark, f"file://{tmp_path_factory.mktemp('watch')}")
    watch = store.create_watch("https://e.com/", {"max_pages": 5, "unknown": 1}, at=1)
    first = store.run_watch(watch, pages(spark, ("a", 200, "one\n\ntwo"), ("b", 200, "stays"), ("c", 200, "goes"), ("d", 200, "text\n\nupdated 5 minutes ago"), ("e", 503, "")), at=10)
    second = store.run_watch(watch, pages(spark, ("a", 200, "one\n\nthree & more"), ("b", 200, "stays"), ("c", 404, ""), ("d", 200, "text\n\nupdated 9 minutes ago"), ("e", 200, "back")), at=20)
    return store, watch, first, second


def test_a_watch_over_two_runs(watched):
    store, watch, first, second = watched
    assert {k: first[k] for k in ("pages", "added", "changed")} == {"pages": 5, "added": 0, "changed": 0}
    assert {k: second[k] for k in ("added", "removed", "changed", "suppressed")} == {"added": 1, "removed": 1, "changed": 1, "suppressed": 1}
    got = {r.key: (r.change, json.loads(r.detail)) for r in store.changes(watch).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "changed", "c": "removed", "e": "added"} and got["a"][1] == {"added": ["three & more"], "removed": ["two"]}
    runs = store.runs(watch).collect()
    assert [(r.status, r.pages, r.changes) for r in runs] == [("finished", 5, 3), ("finished", 5, 0)]
    assert store.last_finished_run(watch) == second["run"] and store.baseline_run(watch, second["run"]) == first["run"] and store.baseline_run(watch, first["run"]) is None
    assert store.config_of(watch)["max_pages"] == 5 and "unknown" not in store.config_of(watch)
    assert store.changes(watch, kind="added").count() == 1 and store.changes(watch, limit=2).count() == 2 and store.changes(watch, since=F.timestamp_micros(F.lit(21))).count() == 0
    assert store.count_changes().collect()[0].changes == 3 and store.pages_of(first["run"]).count() == 5


@pytest.mark.parametrize("kind", ["rss", "atom", "markdown", "json"])
def test_feeds_have_bodies(watched, kind):
    store, watch, *_ = watched
    changes = store.changes(watch).withColumn("at", F.timestamp_micros("at"))
    text = sinks.feed(changes, "A & B", "https://e.com/?a=1&b=2", kind).first().value
    if kind in ("rss", "atom"):
        root = ET.fromstring(text)
        assert sum(e.tag.endswith(("item", "entry")) for e in root.iter()) == 3 and "three &amp; more" in "".join(root.itertext())
    elif kind == "json":
        assert {x["change"] for x in json.loads(text)} == {"added", "removed", "changed"}
    else:
        assert "- three & more" in text and "## Removed: [C](https://e.com/c)" in text
    assert sinks.feed(changes.limit(0), "t", "l", kind).first().value


def test_deleting_a_watch(spark, tmp_path):
    store = stores.WatchStore(spark, f"file://{tmp_path}")
    watch, other = store.create_watch("https://e.com/"), store.create_watch("https://f.com/")
    run = store.run_watch(watch, pages(spark, ("a", 200, "x")))["run"]
    store.delete_watch(watch)
    assert [r.watch for r in store.watches.rows().collect()] == [other] and store.runs(watch).count() == 0 and store.pages_of(run).count() == 0


def test_graph_store(spark, tmp_path):
    store = stores.GraphStore(spark, f"file://{tmp_path}")
    assert store.load("https://e.com/") is None and store.stored() == []
    for at, n in ((10, 1), (20, 2), (30, 3)):
        store.save("https://e.com/" if n < 3 else "https://f.com/", {"pages": spark.range(n), "links": spark.range(0)}, at)
    assert store.load("https://e.com/")["pages"].count() == 2 and store.stored() == [("https://f.com/", 30), ("https://e.com/", 20), ("https://e.com/", 10)]
    (tmp_path / "half" / "00000000000000000040-x").mkdir(parents=True)  # a version that was never finished
    assert len(store.stored()) == 3 and store.prune(keep=2) == 1 and store.prune(older_than=25) == 1 and store.stored() == [("https://f.com/", 30)]


def test_knowledge_store(spark, tmp_path):
    store = stores.KnowledgeStore(spark, f"file://{tmp_path}")
    assert store.entities("r") is None and store.last_run("r") is None
    e = spark.createDataFrame([("e1", "B", 1), ("e2", "A", 1), ("e3", "C", 5)], "entity_id string, name string, evidence int")
    r = spark.createDataFrame([("r1", 1, False), ("r2", 2, True), ("r3", 3, None)], "relation_id string, evidence int, retired boolean")
    v = spark.createDataFrame([(2, 0, 0, 1), (1, 0, 5, 6), (1, 0, 2, 3)], "page_id long, pos int, start int, end int")
    store.replace_graph("r", {"entities": e.limit(0), "relations": r, "evidence": v}, 1)
    store.replace_graph("r", {"entities": e, "relations": r, "evidence": v}, 2)
    assert [x.entity_id for x in store.entities("r").collect()] == ["e3", "e2", "e1"] and [x.relation_id for x in store.relations("r").collect()] == ["r3", "r1"]
    assert [(x.page_id, x.start) for x in store.evidence("r").collect()] == [(1, 2), (1, 5), (2, 0)]
    store.cache_put(spark.createDataFrame([("k", "old"), ("l", "x")], "cache_key string, value string"), 1)
    store.cache_put(spark.createDataFrame([("k", "new")], "cache_key string, value string"), 2)
    assert [x.value for x in store.cache_get(spark.createDataFrame([("k",), ("m",)], "cache_key string")).collect()] == ["new"]
    store.record_run("r", {"pages": 1}, 1)
    store.record_run("r", {"pages": 2}, 2)
    assert store.last_run("r")["pages"] == 2


def test_event_log(tmp_path):
    events = [{"kind": "page", "markdown": "x" * 1000, "links": list(range(50))}, {"kind": "done"}]
    got = list(stores.trace_events(iter(events), str(tmp_path / "log"), clock=lambda: 0.0))
    lines = [json.loads(x) for x in (tmp_path / "log").read_text().splitlines()]
    assert got == events and len(lines[0]["markdown"]) < 450 and len(lines[0]["links"]) == 21 and lines[1] == {"at": 0.0, "kind": "done"}


def test_summary_and_gold(spark, tmp_path):
    c = spark.createDataFrame([("a", "added"), ("b", "unchanged"), ("c", "unchanged")], "key string, change string")
    assert stores.diff_summary(c).first().value == "1 added, 0 removed, 0 changed, 2 unchanged"
    (tmp_path / "gold.json").write_text(json.dumps([{"id": "p", "url": "https://e.com/p", "schema": {"type": "object"}, "facts": {"a": 1}}]))
    (tmp_path / "p.html").write_text("<p>x</p>")
    page, gold = readers.gold_corpus(spark, f"file://{tmp_path}")
    assert page.first().html == "<p>x</p>" and json.loads(gold.first().facts) == {"a": 1}
