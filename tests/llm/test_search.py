"""Archives and nearest neighbours against brute force."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import ann, warc

BIG = "<p>" + "same " * 40 + "</p>"
PAGES = [(4, "http://www.B.com/x?q=1#f", BIG), (2, "https://a.com/", BIG), (9, None, "short"), (1, "http://b.com/X", "short"), (7, "http://b.com/é bad\nurl", None), (8, "http://c.org", ""), (2, "https://a.com/", BIG), (None, "http://a.com/z", BIG), (5, "http://a.com/y", "ü" * 60)]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, digest string, first string").repartition(3)


def test_archives(spark, pages):
    got = warc.archive_histories(pages).toPandas()
    assert len(got) == len(PAGES)
    for page_id, _, html in PAGES:
        raw = (html or "").encode()
        mine = got[(got.page_id == page_id) | (got.page_id.isna() & (page_id is None))]
        mine = mine[mine.payload_digest == hashlib.sha256(raw).hexdigest()]
        assert len(mine) and (mine.payload_bytes == len(raw)).all()
        revisit = page_id is not None and len(raw) >= 100 and html == BIG and page_id != 2
        assert (mine.record_type == ("revisit" if revisit else "response")).all()
        assert mine.refers_to.eq(2).all() if revisit else mine.refers_to.isna().all()
    ordered = got.sort_values(["merge_range", "merge_position"])
    keys = list(zip(ordered.url_key, ordered.captured_at, strict=True))
    assert keys == sorted(keys)
    assert warc.archive_histories(pages.limit(0)).count() == 0


def test_many_runs_and_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "FAN_IN", 3)
    monkeypatch.setattr(warc, "RANGE", 7)
    monkeypatch.setattr(warc, "BLOCK", 4)
    rows = [(i, "http://hot.com/" if i % 3 else f"http://h{i % 7}.com/{i}", f"page {i} " * 20) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8)
    runs = warc.index_archives(warc.write_archives(df))
    assert runs.count() == 8
    got = warc.merge_runs(runs).toPandas().sort_values(["merge_range", "merge_position"])
    keys = list(zip(got.url_key, got.captured_at, got.page_id, strict=True))
    assert keys == sorted(keys) and sorted(got.page_id) == list(range(120)) and got.merge_range.nunique() >= 2


def test_records_are_plain_warc(tmp_path):
    raw = warc.record("response", 3, "http://a.com/", "d" * 64, 2, b"hi", None)
    text = gzip.decompress(raw)
    head, body = warc.parse(text)
    assert text.startswith(b"WARC/1.1\r\n") and head["warc-type"] == "response" and body.endswith(b"\r\n\r\nhi")


@pytest.mark.parametrize("k", [0, 1, 2, 3, 8, 13])
def test_loser_tree(k):
    rng = random.Random(k)
    lists = [sorted(bytes([rng.randrange(5)]) for _ in range(rng.randrange(9))) for _ in range(k)]
    assert list(warc.LoserTree([iter(x) for x in lists])) == sorted(b for x in lists for b in x)


def brute(ids, x, q, k):
    d = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])  # in the order of SQL
    at = [i for i in np.lexsort((ids, d)) if ids[i] != ids[q]][:k]
    return [(int(ids[i]), d[i]) for i in at]


def test_exact_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 5)
    monkeypatch.setattr(ann, "CANDIDATE_TILE", 64)
    monkeypatch.setattr(ann, "QUERY_TILE", 3)
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 16)), 1)
    x[100:180] = x[100]  # many ties, also at distance 0
    ids = rng.permutation(1000)[:400]
    df = spark.createDataFrame([(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0).toPandas()
    asked = [n for n, i in enumerate(ids) if i % 20 == 0]
    assert got.query_id.nunique() == len(asked)
    for n in asked:
        mine = got[got.query_id == ids[n]].sort_values("rank")
        want = brute(ids, x, n, 10)
        assert mine["rank"].tolist() == list(range(1, 11))
        assert mine.vec_id.tolist() == [i for i, _ in want] and np.allclose(mine.score, [d for _, d in want], rtol=0, atol=1e-12)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (20, [2.0, 2.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == {(0, 1), (0, 20), (20, 0), (20, 1)}
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0 and ann.nearest(df, F.lit(False)).count() == 0


def test_close_and_extreme_vectors():
    """Double vectors that differ by less than rounding shows, and components near the ends of the range."""
    rng = np.random.default_rng(8)
    for x in (1 + np.outer(rng.random(2000) * 1e-8, np.ones(8)), np.eye(8)[rng.integers(0, 8, 600)] + rng.normal(size=(600, 8)) * 1e-9, rng.normal(size=(300, 8)) * 1e200, rng.normal(size=(300, 8)) * 1e-160):
        ids = np.arange(len(x))
        block = ann.QueryBlock(ids[:20], x[:20])
        heaps, upper = [[] for _ in range(20)], np.full(20, np.inf)
        for a in range(0, len(x), 256):
            block.search(heaps, upper, ids[a : a + 256], x[a : a + 256], 10)
        for q in range(20):
            d = ann.distances(np.repeat(x[q : q + 1], len(x), 0), x)
            want = [(d[i], i) for i in np.lexsort((ids, d)) if i != q][:10]
            assert sorted((-a, -b) for a, b in heaps[q]) == [(float(a), int(b)) for a, b in want]


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(50, 64)) * 10 ** rng.uniform(-3, 3, (50, 1)), rng.normal(size=(50, 64))
    (qx, sx, ex), (qy, sy, ey) = ann.quantise(x), ann.quantise(y)
    near = np.sqrt((((qx * sx[:, None])[:, None] - (qy * sy[:, None])[None]) ** 2).sum(2))
    true = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
    assert (np.abs(near - true) <= ex[:, None] + ey).all()
