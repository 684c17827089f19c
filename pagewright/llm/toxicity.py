"""Toxicity severity by cumulative-link ordinal regression.

A text's features are its words and their longer beginnings (stems), weighed by how often and how densely they occur. An
L1 penalty in proportion to the noise of each feature first chooses those that mark toxic labels. Grades are 0 (not
toxic), 1 (toxic) and 2 (toxic, with chosen features denser than in the median toxic text); the labels themselves know
no more than toxic or not. In the second fit one weight for each feature is shared by all thresholds:
P(grade <= k) = logistic(threshold k - sum of weight x value).
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.runtime import map_batches, staged

#: Bound on the training sample (labelled rows, the least by hash of doc_id) and on its vocabulary.
LABELLED_ROWS, MOST_FEATURES, LEAST_DOCS = 3_000, 40_000, 8
#: Features in more than this share of the sample mark nothing and are left out.
MOST_SHARE = 0.5
GRADES = 3
#: Features whose gain is below so many standard deviations of chance get no weight.
SIGMAS = 5.0
#: Lengths of the beginnings of longer words that count as features.
STEMS = (3, 4, 5, 6, 7, 8)
#: The dense form of a feature counts in full from this share of a text's words; beyond MOST occurrences more add nothing.
DENSE, MOST = 0.004, 8
WORD = regex.compile(r"[\p{L}\p{M}\p{N}_]+")
WORDS_KEPT = 100_000


def features_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in STEMS if k < len(word))]


def values_of(counts: Counter[str], words: int) -> dict[str, float]:
    """Two values for each feature: by its occurrences, and by those scaled down where they are thinly spread."""
    out = {}
    for f, c in sorted(counts.items()):
        v = float(np.log1p(min(c, MOST)))
        out[f], out[f + "@"] = v, v * min(1.0, c / words / DENSE)
    return out


def text_features(text: str | None) -> dict[str, float]:
    words = WORD.findall(text.lower()) if text else []
    counts: Counter[str] = Counter()
    for w, c in Counter(words).items():
        for f in features_of(w):
            counts[f] += c
    return values_of(counts, len(words))


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class ToxicityModel:
    weights: dict[str, float]
    thresholds: np.ndarray  # ascending, GRADES - 1 of them
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)  # words met and their features with weight

    def _signal(self, text: str | None) -> float:
        if not text or not self.weights:
            return 0.0
        words, known, counts = WORD.findall(text.lower()), self.known, Counter()
        for w in words:
            found = known.get(w)
            if found is None:
                if len(known) > WORDS_KEPT:
                    known.clear()
                found = known[w] = tuple(f for f in features_of(w) if f in self.weights or f + "@" in self.weights)
            if found:
                counts.update(found)
        return sum(self.weights.get(f, 0.0) * v for f, v in values_of(counts, len(words)).items())

    def severity(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Likeliest grade, expected severity and P(grade >= 1) of each text."""
        x = np.array([self._signal(t) for t in texts], np.float64)
        over = _logistic(x[:, None] - self.thresholds)  # P(grade > k)
        p = np.diff(np.concatenate([np.ones((len(x), 1)), over, np.zeros((len(x), 1))], 1), axis=1) * -1
        return p.argmax(1).astype(np.int32), np.round(over.sum(1), 6), np.round(over[:, 0], 6)


def _fit(docs: np.ndarray, words: np.ndarray, values: np.ndarray, n_words: int, grade: np.ndarray, penalty: np.ndarray, ridge: float, steps: int, positive: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Accelerated proximal gradient on the mean negative log-likelihood; docs, words and values list the sparse matrix."""
    n = len(grade)
    share = np.array([(grade > k).mean() for k in range(GRADES - 1)]).clip(1e-4, 1 - 1e-4)
    theta = np.log((1 - share) / share)
    theta[1:] = np.maximum(theta[1:], theta[:-1] + 0.05)
    w = v = np.zeros(n_words)
    u = np.ones(n_words)
    for _ in range(30):  # the greatest curvature, by power iteration
        u = np.bincount(words, np.bincount(docs, u[words] * values, n)[docs] * values, n_words) / n
        top = np.sqrt((u * u).sum())
        u = u / max(top, 1e-12)
    rate, t = 2.0 / max(top, 1e-3), 1.0
    edges = lambda th: np.concatenate([[-np.inf], th, [np.inf]])
    for _ in range(steps):
        x = np.bincount(docs, v[words] * values, n)
        e = edges(theta)
        hi, lo = _logistic(e[grade + 1] - x), _logistic(e[grade] - x)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gx = (dhi - dlo) / p / n  # of the loss by x
        g = np.bincount(words, gx[docs] * values, n_words) + ridge * v
        new = v - rate * g
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        if positive:
            new = np.maximum(new, 0)
        if g @ (new - w) > 0:  # overshot: momentum starts anew
            t = 1.0
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
        gt = np.array([(-(dhi / p)[grade == k].sum() + (dlo / p)[grade == k + 1].sum()) / n for k in range(GRADES - 1)])
        theta = theta - gt
        theta[1:] = np.maximum(theta[1:], theta[:-1] + 0.05)
    return w, theta


def train_toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS) -> ToxicityModel:
    """Learn from at most `rows` labelled documents with crc32(id as text) mod 5 not 0.

    A null toxic label is left out. Without labels, or with one kind only, nothing has weight and no text is toxic. Of several labels for one id each counts.
    """
    spark = docs.sparkSession
    graded = labels.where("toxic is not null").select(F.col(id_col).alias("id"), (F.col("toxic") > 0).cast("int").alias("grade"))
    chosen = graded.where("crc32(cast(id as string)) % 5 != 0").orderBy(F.xxhash64("id"), "id", "grade").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # At most `rows` rows are broadcast, and at most `rows` are kept where ids of documents are repeated.
    found = texts.join(F.broadcast(chosen), "id").orderBy(F.xxhash64("id"), "id", "grade", F.xxhash64("text")).limit(rows)
    sample = staged(found.select(F.col("id").cast("string").alias("id"), "grade", "text").repartition(32), "labelled-texts")

    def split(batch):
        yield pa.RecordBatch.from_arrays([pa.array([list(text_features(t)) for t in batch.column(2).to_pylist()], pa.list_(pa.string()))], ["features"])

    counted = map_batches(sample, split, "features array<string>").select(F.explode("features").alias("feature")).groupBy("feature").count()
    total = sample.count()
    vocab = [r.feature for r in counted.where((F.col("count") >= LEAST_DOCS) & (F.col("count") <= MOST_SHARE * total)).orderBy(F.desc("count"), "feature").limit(MOST_FEATURES).collect()]
    place = spark.sparkContext.broadcast({w: i for i, w in enumerate(vocab)})

    def index(batch):
        at = place.value
        found = [sorted((at[f], v) for f, v in text_features(t).items() if f in at) for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([[i for i, _ in x] for x in found], pa.list_(pa.int32())), pa.array([[v for _, v in x] for x in found], pa.list_(pa.float32()))], ["id", "grade", "at", "value"])

    got = map_batches(sample, index, "id string, grade int, at array<int>, value array<float>").toArrow().sort_by([("id", "ascending"), ("grade", "ascending")])
    grade = np.array(got["grade"].to_pylist(), np.int64)
    if len(set(grade > 0)) < 2 or not vocab:
        return ToxicityModel({}, np.array([20.0, 21.0]))
    at = got["at"].combine_chunks()
    rows_at, words = np.repeat(np.arange(len(grade), dtype=np.int32), np.diff(at.offsets.to_numpy())), at.flatten().to_numpy()
    values = got["value"].combine_chunks().flatten().to_numpy()
    del got, at
    n, toxic = len(grade), (grade > 0).mean()
    mass = np.bincount(words, values * values, len(vocab))
    chance = SIGMAS * np.sqrt(toxic * (1 - toxic) * np.maximum(mass, 2)) / n
    w, _ = _fit(rows_at, words, values, len(vocab), grade, chance, 0.0, 150)
    marks = {vocab[k].removesuffix("@") for k in np.flatnonzero(w > 0)}  # features of toxic texts; none speaks for innocence
    kept = np.array([i for i, f in enumerate(vocab) if f.removesuffix("@") in marks], np.int64)  # in both forms
    again = np.full(len(vocab), -1)
    again[kept] = np.arange(len(kept))
    inside = again[words] >= 0
    dense = inside & np.array([f.endswith("@") for f in vocab])[words]
    share = np.bincount(rows_at[dense], values[dense], n)
    found = share[(grade > 0) & (share > 0)]
    grade = grade + ((grade > 0) & (share > (np.median(found) if len(found) else np.inf)))
    w, theta = _fit(rows_at[inside], again[words[inside]], values[inside], len(kept), grade, np.zeros(len(kept)), 2e-5, 1500, positive=True)
    return ToxicityModel({vocab[k]: float(x) for k, x in zip(kept, w, strict=True)}, theta)


def grade_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, grade, expected_severity, p_toxic, toxic) of every row from its whole text.

    toxic means P(grade >= 1) >= threshold. A null or empty text has the words of none and gets the model's base rate.
    Equal texts get equal grades; repeated rows and null ids stay; an empty table gives an empty table. Other columns are
    not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # a bounded vocabulary

    def kernel(batch):
        grade, expected, p = shared.value.severity(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grade), pa.array(expected), pa.array(p), pa.array(p >= threshold)], ["doc_id", "grade", "expected_severity", "p_toxic", "toxic"])

    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(kept, kernel, "doc_id long, grade int, expected_severity double, p_toxic double, toxic boolean")


def toxicity_of(model: ToxicityModel, df: DataFrame):
    """A column function from text to P(grade >= 1), for filters that keep all other columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.severity([t if isinstance(t, str) else None for t in texts])[2])

    return predict
