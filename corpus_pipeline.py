"""A corpus from raw documents to packed training sequences.

Toxic documents and those that score too low for every language go, repeated line runs lose their later copies, one document of each class of
near copies stays, and what is left is packed. Every stage but the last keeps the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm import langid, linededup, neardup, packing, runtime, toxicity

#: A document goes from this probability of being toxic on.
TOXIC = 0.5
#: The stages have no common SQL form: learned models decide the first two.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model holds for toxic go; null and empty texts stay."""
    model = toxicity.train_toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where((F.coalesce(F.col("text"), F.lit("")) == "") | (toxicity.toxicity_of(model, docs)(F.col("text")) < TOXIC))


def drop_no_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter (null and empty ones, too) have no language and go, and so do those whose best
    language scores less than held-out rows that are answered right."""
    model = langid.train_language_model(docs)
    found = langid.language_of(model, docs)(F.col("text"))
    return docs.where((found["lang"] != langid.UNDETERMINED) & (found["score"] >= langid.least_score(model, docs)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs and of frequent lines go from the texts; documents that are nothing but such copies
    go as a whole."""
    out = linededup.dedup_lines(docs)
    gone = F.aggregate("_runs_deleted", F.lit(0), lambda n, r: n + r["length"])
    out = out.where((gone == 0) | (gone < F.col("_lines")))
    return out.select(*(F.when(gone > 0, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_no_language),
    ("lines", dedup_lines),
    ("near-duplicates", drop_near_duplicates),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written as Parquet and read again; what a finished stage staged is deleted, and so
    is the table it read once its own is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with runtime.scratch(spark):
            result = stage(spark, docs, sf_dir)
            path = runtime.new_path(spark, f"corpus-{name}", keep=True)
            result.write.option("compression", "zstd").parquet(path)
        if before:
            runtime.delete_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
