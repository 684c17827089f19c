"""Content selection in bounded tasks: the blocks of pages are shuffled by page into a counted number of tasks, never by the keys of a site."""

import re

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from pagewright import catalog
from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import assemble, parse

catalog.load()


@pytest.fixture
def large(spark):
    """Joins as over tables that are too large to be broadcast unasked."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def parsed(spark):
    return parse.staged_pages(spark.read.parquet(f"{SMALL}/pages.parquet"))


def shuffles(df):
    return re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def content(parsed, tasks):
    b = assemble.dedup_blocks(parse.blocks_of(assemble.by_page(parsed, tasks))).withColumn("site", U.site_host(F.col("url"))).withColumn("chrome_key", T.chrome_key(F.col("text")))
    titles = parsed.select("page_id", F.col("meta")["title"].alias("title"))
    return assemble.markdown_of(assemble.select_content(b, titles, assemble.site_chrome(b), assemble.site_slots(b)))


def test_blocks_stay_in_their_tasks(parsed, large):
    assert {re.sub(r"#\d+L?", "", x) for x in shuffles(content(parsed, 7))} == {"page_id, 7"}


def test_tasks_follow_the_blocks(parsed, monkeypatch):
    blocks = parsed.select(F.sum(F.size("blocks"))).first()[0]
    assert assemble.tasks_of(parsed) == 1 and assemble.tasks_of(parsed.limit(0)) == 1
    monkeypatch.setattr(assemble, "TASK_BLOCKS", 100)
    n = assemble.tasks_of(parsed)
    assert n == blocks // 100 + 1
    held = [r.n for r in parse.blocks_of(assemble.by_page(parsed, n)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(held) == blocks and max(held) < blocks
    monkeypatch.setattr(assemble, "TASK_CHARS", 1000)
    assert assemble.tasks_of(parsed) > n


def test_many_marks_give_the_same(spark, parsed, large, monkeypatch):
    few = {tuple(r) for r in catalog.QUERIES["page_content"](spark, SMALL).collect()}
    chrome = {tuple(r) for r in catalog.QUERIES["site_chrome_pages"](spark, SMALL).collect()}
    monkeypatch.setattr(assemble, "FEW", 0)
    monkeypatch.setattr(assemble, "TASK_BLOCKS", 200)
    assert {tuple(r) for r in catalog.QUERIES["page_content"](spark, SMALL).collect()} == few and few
    assert {tuple(r) for r in catalog.QUERIES["site_chrome_pages"](spark, SMALL).collect()} == chrome


def test_only_places_of_many_marks_are_shuffled(spark, large, monkeypatch):
    rows = [(p, "s", i, t, "paragraph", 0) for p in range(8) for i, t in enumerate(["Home", "About  us", f"own text number {p} that is long enough to stay"])]
    b = spark.createDataFrame(rows + [(9, None, 0, "Home", "paragraph", 0), (9, "s", 1, None, "image", 0)], "page_id long, site string, pos int, text string, kind string, level int").withColumn("chrome_key", T.chrome_key(F.col("text")))
    keys = assemble.site_chrome(b, share=0.8)
    few = assemble.strip_chrome(b, keys)
    assert not any("site" in x or "chrome_key" in x or "_mark" in x for x in shuffles(few))
    want = sorted(map(tuple, few.select("page_id", "pos").collect()))
    assert want == [(p, 2) for p in range(8)] + [(9, 0), (9, 1)]
    monkeypatch.setattr(assemble, "FEW", 0)
    many = assemble.strip_chrome(b, keys)
    assert any("_mark" in x for x in shuffles(many)) and not any("site" in x or "chrome_key" in x for x in shuffles(many))
    assert sorted(map(tuple, many.select("page_id", "pos").collect())) == want


def test_dominant_article(spark):
    words = {1: [("a", 300), ("b", 90), (None, 50)], 2: [("a", 300), ("b", 150)], 3: [("a", 200), ("b", 200)], 4: [(None, 900), ("a", 120)], 5: [("a", 60), ("a", 60), ("b", 30)], 6: [(None, 10)]}
    rows = [(p, i, a, n) for p, held in words.items() for i, (a, n) in enumerate(held)]
    kept = assemble.scope_to_article(spark.createDataFrame(rows, "page_id long, pos int, article string, words int"))
    assert sorted((r.page_id, r.pos) for r in kept.collect()) == [(1, 0), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0), (4, 1), (5, 0), (5, 1), (6, 0)]
