"""Line deduplication, near duplicates and the pipeline against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import linededup, neardup

SMALL = "/root/testdata/sf0.001"


def deleted_by_hand(docs, least, often=None):
    """doc -> deleted non-blank lines: in a run of `least` words that occurs before, or a later copy of a frequent line."""
    lines = {d: [x.strip() for x in (t or "").split("\n") if x.strip()] for d, t in docs}
    gone, seen = {d: set() for d in lines}, {}
    count = Counter(x for v in lines.values() for x in v)
    for d in sorted(lines):
        x = lines[d]
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1):
                if sum(linededup.words_of(y.encode()) for y in x[i:j]) >= least or (often and j == i + 1 and count[x[i]] >= often):
                    if tuple(x[i:j]) in seen and seen[tuple(x[i:j])] < (d, i):
                        gone[d] |= set(range(i, j))
                    seen.setdefault(tuple(x[i:j]), (d, i))
    return gone


@pytest.mark.parametrize("seed, least, often", [(0, 10, None), (1, 25, 8), (2, 4, None), (3, 1, None), (4, 7, 5)])
def test_lines_against_brute_force(spark, seed, least, often):
    rng = random.Random(seed)
    pool = ["a", "b b", "c c c", "d d d d", "one two three four five six seven eight nine ten eleven", "x y z w v"]
    docs = [(i, "\n".join(rng.choice([*pool, "", f"own {i} {rng.random()}"]) for _ in range(rng.randrange(14)))) for i in range(25)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), least_words=least, often=often).collect()}
    for d, gone in deleted_by_hand(docs, least, often).items():
        mine = {i for r in got[d]._runs_deleted for i in range(r.start, r.start + r.length)}
        assert mine == gone, d
        kept = [x for x in dict(docs)[d].split("\n") if x]
        assert [x for x in got[d].text.split("\n") if x] == [x for i, x in enumerate(kept) if i not in gone]


def test_maximal_runs_of_any_length(spark, monkeypatch):
    """Planted runs of 1 to 50 one-word lines are found whole, with their earlier place, if they hold enough words."""
    monkeypatch.setattr(linededup, "broadcast_if_small", lambda df: df)
    docs, planted = [(0, "\n".join(f"s{i}" for i in range(2000)))], {}
    for n in range(1, 51):
        at = 37 * n
        docs.append((n, "\n".join([f"own{n}", *(f"s{i}" for i in range(at, at + n)), f"end{n}", f"s{at + n + 3}"])))
        planted[n] = (1, n, 0, at)
    runs = linededup.repeated_runs(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), least_words=20, often=None).collect()
    assert {r.doc: [tuple(c) for c in r["copies"]] for r in runs} == {n: [p] for n, p in planted.items() if n >= 20}
    assert {r.doc: (r.starts, r.ends) for r in runs} == {n: ([1], [1 + n]) for n in planted if n >= 20}


def test_line_edges(spark):
    long = "these are more than ten words in one long line of text" + " and more" * 8
    rows = [(1, long, "k"), (2, f" {long}\t\n\nown", "k"), (3, None, None), (4, "", "k"), (None, long, "k"), (1, long, "k"), (5, "\n".join([long] * 4000), "k"), (6, "short\nline\nshort\nline\n", "k"), (7, "line\nline", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").withColumn("line", F.lit(1)).withColumn("words", F.lit(2)).withColumn("doc", F.lit(3)).withColumn("_doc", F.lit(4)).withColumn("_runs", F.lit(5)).withColumn("_lines", F.lit(6)).withColumn("_runs_deleted", F.lit(7)).withColumn("often", F.lit(8))
    out = linededup.dedup_lines(df)
    assert out.columns == [*(c for c in df.columns if c not in ("_lines", "_runs_deleted")), "_runs_deleted", "_lines"]
    got = sorted(out.collect(), key=lambda r: (r.doc_id or 0))
    text = lambda d: [r.text for r in got if r.doc_id == d]
    assert text(1) == [long, long] and text(2) == ["\nown"] and text(3) == [None] and text(4) == [""] and text(None) == [long] and text(5) == [""] and text(6) == ["short\nline\nshort\nline\n"] and text(7) == ["line\nline"]
    assert linededup.dedup_lines(df.limit(0)).count() == 0


def similar(a, b):
    """Best ordered matching of the labelled shingles, by dynamic programming."""
    s = neardup.Shingler()
    x, y = (s.labelled(s.words(t)).tolist() for t in (a, b))
    row = [0] * (len(y) + 1)
    for u in x:
        last = 0
        for j, v in enumerate(y):
            last, row[j + 1] = row[j + 1], last + 1 if u == v else max(row[j + 1], row[j])
    return row[-1] / (len(x) + len(y) - row[-1])


def test_alignment_is_exact():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    for _ in range(60):
        a = [rng.choice(words) for _ in range(60)]
        b = list(a)
        for _ in range(rng.randrange(3)):
            b[rng.randrange(len(b))] = rng.choice(words)
        if rng.random() < 0.3:
            b = b[30:] + b[:30]
        s = neardup.Shingler()
        x, y = s.labelled(a), s.labelled(b)
        at = {v: i for i, v in enumerate(x.tolist())}
        got = neardup.aligned(np.array([at.get(v, -1) for v in y.tolist()]), len(y), len(x))
        want = similar(" ".join(a), " ".join(b))
        assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def made(seed, n_groups=6):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(500)]
    docs, number = [], 0
    for _ in range(n_groups):
        base = [rng.choice(words) for _ in range(rng.randrange(30, 160))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((number, " ".join(copy)))
            number += 1
    rng.shuffle(docs)
    return docs


def classes_by_hand(docs):
    root = {d: d for d, _ in docs}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(docs):
        for b, y in docs[i + 1 :]:
            if similar(x, y) >= 0.8:
                u, v = sorted((find(a), find(b)))
                root[v] = u
    return {d: find(d) for d in root}


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_against_brute_force(spark, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(neardup, "TILE_DOCS", 2)  # every bucket has leaders and is cut into pairs of chunks
        monkeypatch.setattr(neardup, "LEADERS", 1)
        monkeypatch.setattr(neardup, "SMALL_CLASS", 2)
    docs = made(seed)
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.class_id for r in got.collect()} == classes_by_hand(docs)


def test_hot_bucket_costs_its_size(spark, monkeypatch):
    """Near copies of one text in one large bucket are compared with its leaders, not with each other."""
    rng = random.Random(9)
    base = [f"w{rng.randrange(4000)}" for _ in range(400)]
    docs = []
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(1, 4)):
            copy[rng.randrange(250, 400)] = f"x{i}"
        docs.append((i, " ".join(copy)))
    monkeypatch.setattr(neardup, "TILE_DOCS", 10)
    monkeypatch.setattr(neardup, "SMALL_CLASS", 5)
    seen = []
    real = neardup._class_tiles
    monkeypatch.setattr(neardup, "_class_tiles", lambda *a: seen.append(real(*a)) or seen[-1])
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert {r.class_id for r in got.collect()} == {0}
    assert seen[0].count() <= 12 * 120  # pairs of chunks would give each member twelve rows a table


@pytest.mark.parametrize("low, high", [(0.8, 0.85), (0.85, 0.9), (0.9, 1.0)])
def test_recall_by_band(low, high):
    """Pairs of texts of a similarity in the band that share a bucket and pass the signature: at least 0.99 of them."""
    rng, met, pairs = random.Random(12), 0, 0
    while pairs < 150:
        a = [f"t{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        b = list(a)
        for _ in range(rng.randrange(1, max(2, len(a) // 45))):
            b[rng.randrange(len(b))] = f"u{rng.randrange(99)}"
        s = neardup.Shingler()
        x, y = s.labelled(a), s.labelled(b)
        at = {v: i for i, v in enumerate(x.tolist())}
        if not low <= neardup.aligned(np.array([at.get(v, -1) for v in y.tolist()]), len(y), len(x)) < high:
            continue
        (k, sk), (m, sm) = neardup.sketch(x), neardup.sketch(y)
        pairs += 1
        met += bool((k == m).any()) and (np.frombuffer(sk, np.uint8) == np.frombuffer(sm, np.uint8)).sum() >= neardup.AGREE
    assert met >= 0.99 * pairs


def test_near_duplicate_edges(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(3, text), (1, text.upper() + " !"), (2, None), (4, ""), (5, "two words"), (6, "Two, words"), (None, text), (3, text), (7, "?!"), (8, "?!"), (9, "z " * 30000), (10, "z " * 30000 + "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("id", F.lit(1))
    got = sorted(((r.doc_id or 0), r.class_id) for r in neardup.near_duplicates(df).collect())
    assert got == [(0, None), (1, 1), (2, 2), (3, 1), (3, 1), (4, 2), (5, 5), (6, 5), (7, 7), (8, 7), (9, 9), (10, 9)]
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 5, 7, 9]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        u, v = sorted((find(a), find(b)))
        root[v] = u
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.id: r.least for r in neardup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["toxicity", "language", "lines", "near-duplicates", "packing"]
    sizes = [docs.count()]
    for _, stage in p.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SMALL)
        assert docs.schema.names == before.schema.names
        docs = spark.createDataFrame(docs.toArrow())
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    packed = p.run(spark, SMALL)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == left
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_stages_take_empty_and_odd_tables(spark):
    import corpus_pipeline as p

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "some words here", "en", "s", 3), (2, "", "en", "s", 0), (3, "bonjour le monde", "fr", "s", 5), (3, "bonjour le monde", "fr", "s", 5)], schema)
    want = {"toxicity": [None, 1, 2, 3, 3], "lines": [None, 1, 2, 3, 3], "near-duplicates": [None, 1, 3], "packing": [None, 1, 2, 3, 3]}
    for name, stage in p.STAGES:
        got = sorted((r.doc_id for r in stage(spark, odd, SMALL).select("doc_id").collect()), key=lambda d: d or 0)
        assert got == want[name] if name in want else not {1, 2} & set(got), name
        assert stage(spark, odd.limit(0), SMALL).count() == 0


def test_pipeline_deletes_repeated_passages_and_boilerplate(spark):
    import corpus_pipeline

    long = " ".join(f"word{i}" for i in range(30))
    rows = [(1, f"All rights reserved.\nown one\n{long}"), (2, f"own two\nAll rights reserved.\nown three\n{long}"), (3, long)] + [(i, f"All rights reserved.\nown {i}") for i in range(4, 12)]
    got = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect()
    assert {r.doc_id: r.text for r in got} == {1: rows[0][1], 2: "own two\nown three"} | {i: f"own {i}" for i in range(4, 12)}
