"""Formats of tables, and streams with bounded state."""

import datetime as dt

import pytest

from pagewright.sources import readers, sinks
from pagewright.streaming import pages


@pytest.mark.parametrize("kind", ["parquet", "orc", "json", "csv"])
def test_formats(spark, tmp_path, kind):
    df = spark.createDataFrame([(1, "a, \"b\"", "x"), (2, None, "y")], "id long, t string, part string")
    sinks.write_table(df, f"file://{tmp_path}/t", kind, ("part",))
    back = readers.table(spark, f"file://{tmp_path}/t", kind, "id long, t string, part string")
    assert sorted((r.id, r.t, r.part) for r in back.collect()) == [(1, 'a, "b"', "x"), (2, None, "y")]
    assert (tmp_path / "t" / "part=x").exists()


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_new_pages_within_a_span(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    rows = [("https://e.com/a", at(0)), ("https://www.e.com/a/", at(1)), ("https://e.com/b", at(2))]
    spark.createDataFrame(rows, "url string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/p")
    stream = spark.readStream.schema("url string, at timestamp").parquet(f"{tmp_path}/p")
    assert len(run(pages.new_pages(stream, "at", "1 day"), "once")) == 2


def test_streams_are_matched(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    spark.createDataFrame([("a", at(0)), ("b", at(1))], "url string, asked_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/q")
    spark.createDataFrame([("a", at(5), 200), ("b", at(0), 500)], "url string, answered_at timestamp, status int").coalesce(1).write.parquet(f"{tmp_path}/r")
    q = spark.readStream.schema("url string, asked_at timestamp").parquet(f"{tmp_path}/q")
    r = spark.readStream.schema("url string, answered_at timestamp, status int").parquet(f"{tmp_path}/r")
    assert ("a", 200) in {(x.url, x.status) for x in run(pages.matched(q, r), "matches")}
