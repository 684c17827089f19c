"""Language identification by error-correcting output codes.

Every language gets a codeword of signs; one logistic classifier over hashed letter n-grams learns each bit. A text's
language is the codeword with the least loss, each bit weighted by how well its classifier does on that language. A
runner-up with a near loss makes the answer ambiguous.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.runtime import broadcast_if_small, map_batches, staged

#: Hash buckets for each n-gram order from 1 to ORDERS.
BUCKETS, ORDERS = 2048, 3
#: Bounds on the training sample: whole texts for each language, the least by hash of doc_id and text, and texts in all,
#: which languages share alike; every language has at least one.
TEXTS_PER_LANGUAGE, SAMPLE_TEXTS = 600, 24_000
#: Rows of the sample that are held dense at once while the classifiers are fitted.
DENSE_ROWS = 4_000
#: A runner-up with more than this share of the winner's weight makes an answer ambiguous.
AMBIGUOUS = 0.5
UNDETERMINED = "und"
#: A text of a lower score is in no known language, unless more than this share of right held-out answers scores so low.
LEAST_SCORE, CLEAN_LOSS = 0.98, 0.001


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def grams(text: str | None) -> np.ndarray | None:
    """Unit vector of root counts of hashed letter n-grams over the whole text; None if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    code = np.where(letters()[code], code, 0)
    if not code.any():
        return None
    code = np.concatenate([[0], code, [0]]).astype(np.uint32)
    code = code[np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0)])]
    out, h = [], np.zeros(len(code), np.uint32)
    for n in range(ORDERS):
        h = h[: len(code) - n] * np.uint32(0x9E3779B1) + code[n:] + np.uint32(1)
        mixed = h ^ (h >> np.uint32(15))
        mixed = mixed * np.uint32(0x85EBCA6B)
        out.append(np.bincount(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS))
    x = np.sqrt(np.concatenate(out).astype(np.float32))
    return x / np.sqrt((x * x).sum())


def codewords(k: int) -> np.ndarray:
    """k codewords of signs: all splits of the classes up to 6, beyond that random ones far apart."""
    if k <= 6:
        return np.array([(1, *rest) for rest in product((1, -1), repeat=k - 1) if -1 in rest], np.int8).T
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (k, max(15, int(10 * np.log2(k)))))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = (code.shape[1] - (code.astype(np.int32) @ code.T)) // 2 + np.eye(k, dtype=int) * 10**6
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # language x bit, signs
    trust: np.ndarray  # language x bit, rows sum to 1
    weights: np.ndarray  # feature x bit
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores from 0 to 1, and whether each answer is ambiguous."""
        found, scores, doubt = [], np.zeros(len(texts)), np.zeros(len(texts), bool)
        for i, text in enumerate(texts):
            x = grams(text) if self.languages else None
            if x is None:
                found.append(UNDETERMINED)
                doubt[i] = True
                continue
            if len(self.languages) == 1:
                found.append(self.languages[0])
                scores[i] = 1
                continue
            f = x.astype(np.float64) @ self.weights + self.bias
            loss = (self.trust * np.logaddexp(0, -self.code * f)).sum(1) * len(f)
            p = np.exp(loss.min() - loss)
            order = np.argsort(-p, kind="stable")
            found.append(self.languages[order[0]])
            scores[i] = round(float(p[order[0]] / p.sum()), 6)
            doubt[i] = p[order[1]] > AMBIGUOUS
        return found, scores, doubt


def train_language_model(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TEXTS_PER_LANGUAGE) -> LanguageModel:
    """Learn from rows with text and language whose crc32(id as text) mod 5 is not 0: at most
    per_language rows of each, however often an id or text is repeated.

    No such rows give a model that knows no language (all `und`); one language is then always the answer.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    mine = rows.where("lang is not null and text is not null and crc32(cast(id as string)) % 5 != 0")
    # A hash cutoff from each language's count leaves about twice the sample, so no language meets whole in one task; rows
    # of one id or text that pass it together are cut to the sample's size in every task before they meet.
    counts = staged(mine.groupBy("lang").count(), "languages")
    per_language = max(1, min(per_language, SAMPLE_TEXTS // max(1, counts.count())))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000))
    near = mine.join(broadcast_if_small(counts), "lang").where(place < F.lit(2_000_000.0 * per_language) / F.col("count") + 100)
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(place, "id", F.xxhash64("text"))))

    def kernel(batch):
        vectors = [grams(t) for t in batch.column(2).to_pylist()]
        keep = [i for i, v in enumerate(vectors) if v is not None]
        found = [np.flatnonzero(vectors[i]).astype(np.uint16) for i in keep]
        columns = [pa.array([at.tobytes() for at in found], pa.binary()), pa.array([vectors[i][at].tobytes() for i, at in zip(keep, found, strict=True)], pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64())), *columns], ["id", "lang", "at", "x"])

    sample = map_batches(ranked.where(F.col("n") <= per_language).select(F.col("id").cast("string"), "lang", "text"), kernel, "id string, lang string, at binary, x binary").toArrow()
    rows = sorted(zip(*(sample[c].to_pylist() for c in ("lang", "id", "at", "x")), strict=True), key=lambda r: (r[0], r[1] or "", r[3]))
    langs = [r[0] for r in rows]
    names = sorted(set(langs))
    if len(names) < 2:
        return LanguageModel(names, np.ones((len(names), 1), np.int8), np.ones((len(names), 1)), np.zeros((BUCKETS * ORDERS, 1)), np.zeros(1))
    size = BUCKETS * ORDERS

    def dense(a: int) -> np.ndarray:
        out = np.zeros((min(DENSE_ROWS, len(rows) - a), size), np.float32)
        for i, r in enumerate(rows[a : a + DENSE_ROWS]):
            out[i, np.frombuffer(r[2], np.uint16)] = np.frombuffer(r[3], np.float32)
        return out

    pieces = range(0, len(rows), DENSE_ROWS)
    block = functools.lru_cache(maxsize=1)(dense)  # a sample of one block is laid out once
    y = np.searchsorted(np.array(names), np.array(langs))
    code = codewords(len(names))
    target = code[y].astype(np.float32)
    share = 1 / np.bincount(y)[y].astype(np.float32)[:, None] / len(names)  # every language weighs the same
    w, b = np.zeros((size, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(b)
    for _ in range(200):
        gw, gb = -1e-5 * w, np.zeros_like(b)
        for a in pieces:
            x, at = block(a), slice(a, a + DENSE_ROWS)
            pull = share[at] * target[at] / (1 + np.exp(target[at] * (x @ w + b)))
            gw, gb = gw + x.T @ pull, gb + pull.sum(0)
        dw, db = 0.9 * dw + 4 * gw, 0.9 * db + 4 * gb
        w, b = w + dw, b + db
    right = np.concatenate([np.sign(block(a) @ w + b) for a in pieces]) == target
    trust = np.stack([right[y == i].astype(float).mean(0) for i in range(len(names))]) + 1e-3
    return LanguageModel(names, code, trust / trust.sum(1, keepdims=True), w.astype(np.float64), b.astype(np.float64))


def identify(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row, from its whole text alone.

    `und` with score 0, flagged ambiguous, where the text is null, empty or has no letter. Equal texts get equal answers;
    repeated rows stay; a null id is not held out. An empty table gives an empty table. Other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x bits x buckets: a bounded size

    def kernel(batch):
        lang, score, doubt = shared.value.predict(batch.column(2).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(doubt)], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kept = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return map_batches(kept, kernel, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def least_score(model: LanguageModel, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> float:
    """The score below which a text is in no known language: LEAST_SCORE, or as much lower, in steps of 0.001, as keeps
    all but CLEAN_LOSS of the held-out rows that the model answers right.

    All held-out rows with text and language count, in a histogram of at most 2,002 rows. Without any the bound is
    LEAST_SCORE.
    """
    found = F.col("found")
    held = df.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 5 == 0))
    held = held.select(F.col(lang_col).cast("string").alias("lang"), language_of(model, df)(F.col(text_col).cast("string")).alias("found"))
    counts = held.groupBy((found["lang"] == F.col("lang")).alias("right"), F.floor(found["score"] * 1000).cast("int").alias("bin")).count().collect()
    bins = {r["bin"]: r["count"] for r in counts if r["right"]}
    spare, top = CLEAN_LOSS * sum(bins.values()), round(LEAST_SCORE * 1000)
    for b in sorted(bins):
        spare -= bins[b]
        if spare < 0:
            return min(b, top) / 1000
    return top / 1000


def language_of(model: LanguageModel, df: DataFrame):
    """A column function from text to struct<lang, score, ambiguous>, for filters that keep all other columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        lang, score, doubt = shared.value.predict([t if isinstance(t, str) else None for t in texts])
        return pd.DataFrame({"lang": lang, "score": score, "ambiguous": doubt})

    return predict
