"""Language identification and toxicity: held-out accuracy, edge cases, decoding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagewright.llm import langid, toxicity

DOCS = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DOCS}/documents.parquet")


@pytest.mark.parametrize("k", [2, 4, 6, 11])
def test_codewords_are_apart(k):
    code = langid.codewords(k).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2
    assert apart[~np.eye(k, dtype=bool)].min() >= (2 ** (k - 2) if k <= 6 else 5) and (np.abs(code.sum(0)) < k).all()


def test_language_held_out(spark, documents):
    model = langid.train_language_model(documents)
    assert model.languages == ["de", "en", "es", "fr"]
    found = langid.identify(documents, model).join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.count() > 150 and found.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    scores = langid.identify(documents, model).agg(F.min("score"), F.max("score")).first()
    assert 0 <= scores[0] <= scores[1] <= 1


def test_language_ignores_other_columns_and_held_out_labels(spark, documents):
    small = documents.limit(300)
    wrong = small.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "xx").otherwise(F.col("lang"))).withColumn("score", F.lit("clash")).withColumn("x", F.lit(1))
    a, b = langid.train_language_model(small), langid.train_language_model(wrong)
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_language_edges(spark):
    rows = [(1, "the cat", "en"), (2, "le chat", "fr"), (3, None, "en"), (4, "", "en"), (6, "12 !?", "en"), (None, "the", None), (7, "the dog " * 20000, None), (1, "the cat", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df, langid.train_language_model(df)).collect()
    assert len(got) == len(rows)
    assert [r.lang_pred for r in got][2:5] == ["und"] * 3 and all(r.score == 0 and r.ambiguous for r in got[2:5])
    assert got[0].lang_pred == got[7].lang_pred and got[5].held_out is False
    empty = langid.train_language_model(df.limit(0))
    assert [r.lang_pred for r in langid.identify(df.limit(1), empty).collect()] == ["und"] and langid.identify(df.limit(0), empty).count() == 0
    alone = langid.train_language_model(df.where("lang = 'en'"))
    assert langid.identify(df, alone).where("doc_id = 2").first().lang_pred == "en"


def test_samples_are_bounded_by_rows(spark, monkeypatch):
    """Repeated ids do not widen the samples; many languages share the sample and all can be predicted."""
    rows = [(1, f"the cat number {i}", "en") for i in range(400)] + [(2, "le chat", "fr")] * 400 + [(3 + i, f"{c * 5} {c * 3}", f"l{i:03d}") for i, c in enumerate(map(chr, range(0x4E00, 0x4E00 + 260)))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(langid, "grams", lambda t, real=langid.grams: seen.append(t) or real(t))
    model = langid.train_language_model(df, per_language=5)
    assert len(model.languages) > 200
    right = [model.predict([t])[0][0] == lang for _, t, lang in rows[800:] if lang in model.languages]
    assert np.mean(right) > 0.9
    docs, labels = made_documents(spark)
    many = docs.unionAll(docs.where("doc_id < 30")).unionAll(docs.where("doc_id < 30"))
    assert toxicity.train_toxicity_model(many, labels, rows=50).thresholds.shape == (2,)


def test_toxicity_on_held_out_labels(spark):
    """Labelled rows with crc32 mod 5 = 0 are never learned from: precision and recall on all of them."""
    folder = DOCS.replace("sf0.01", "sf0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null")
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    model = toxicity.train_toxicity_model(docs, labels)
    held = labels.where("crc32(cast(doc_id as string)) % 5 = 0").select("doc_id", F.col("toxic").alias("truth"))
    got = toxicity.grade_toxicity(docs.join(held, "doc_id", "left_semi"), model).join(held, "doc_id").toPandas()
    hit = (got.toxic & (got.truth > 0)).sum()
    assert len(got) > 500 and hit >= 0.9 * (got.truth > 0).sum() and hit >= 0.95 * got.toxic.sum()


def made_documents(spark):
    """Half of the documents hold one of two marks; marks in others are absent; noise words are everywhere."""
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(60)])
    rows, labels = [], []
    for i in range(600):
        text = list(rng.choice(words, 40))
        if toxic := i % 3 == 0:
            text[5 : 5 + 1 + i % 4] = ["badword", "vile"][i % 2 :: 2][:1] * (1 + i % 4)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic) if rng.random() > 0.03 else int(not toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = made_documents(spark)
    model = toxicity.train_toxicity_model(docs, labels)
    assert (np.diff(model.thresholds) > 0).all()
    got = toxicity.grade_toxicity(docs, model).toPandas()
    truth = got.doc_id % 3 == 0
    assert (got.toxic == truth).mean() > 0.99
    assert got[truth].expected_severity.mean() > got[~truth].expected_severity.mean() + 0.8
    assert set(got.grade) <= {0, 1, 2} and got.expected_severity.between(0, 2).all()


def test_toxicity_edges(spark):
    docs, labels = made_documents(spark)
    model = toxicity.train_toxicity_model(docs, labels)
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (None, "badword", 0.5), (3, "badword " * 50000, 0.5), (3, "w1 w2", 0.5), (3, "w1 w2", 0.5)], "doc_id long, text string, toxic double")
    got = toxicity.grade_toxicity(odd, model).collect()
    assert len(got) == 6 and not got[0].toxic and not got[1].toxic and got[3].toxic and got[4] == got[5]
    assert toxicity.grade_toxicity(odd.limit(0), model).count() == 0
    none = toxicity.train_toxicity_model(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.grade_toxicity(odd, none).collect())
    blank = toxicity.train_toxicity_model(docs, labels.withColumn("toxic", F.lit(None).cast("int")))
    assert blank.weights == {}
    held = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.train_toxicity_model(docs, held).weights == model.weights


def test_pipeline_drops_what_is_in_no_language(spark, documents):
    import base64
    import random

    import corpus_pipeline

    rng = random.Random(4)
    letters = "".join(map(chr, range(97, 123)))
    junk = ["".join(rng.choice(letters + "   ") for _ in range(n)) for n in (20, 100, 500) for _ in range(20)]
    junk += [base64.b64encode(rng.randbytes(n)).decode() for n in (20, 100, 500) for _ in range(20)] + [rng.randbytes(200).hex() for _ in range(20)]
    planted = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([*junk, "12 !?", "", None])], "doc_id long, text string")
    docs = documents.select("doc_id", "text", "lang").unionByName(planted, allowMissingColumns=True)
    kept = corpus_pipeline.drop_no_language(spark, docs, DOCS)
    left = {bool(r.junk): r["count"] for r in kept.groupBy((F.col("doc_id") >= 10**9).alias("junk")).count().collect()}
    assert left[False] >= 0.995 * documents.count() and left.get(True, 0) <= 0.05 * len(junk)
