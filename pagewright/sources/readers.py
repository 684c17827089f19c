"""Sources: page tables, HTML folders, robots and sitemap files, graphs and facts as JSON lines."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def html_folder(spark: SparkSession, folder: str, root: str, glob: str = "*.html") -> DataFrame:
    """(page_id, url, html) of a folder of HTML files; the address is the root and the file's path below the folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder)
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + re.escape(re.sub(r"^file:/+", "/", folder).rstrip("/")) + "/?", "")
    url = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(relative, r"(^|/)index\.html?$", "$1"))
    return files.select(F.abs(F.xxhash64("path")).alias("page_id"), url.alias("url"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def table(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table of any format that Spark knows (parquet, orc, json, csv with a header, text, jdbc); rows of text that do not fit
    the schema come with nulls."""
    reader = spark.read.format(kind).options(**({"header": "true", "mode": "PERMISSIVE"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).load(path)


def sitemap_urls(files: DataFrame) -> DataFrame:
    """(origin, loc, lastmod, is_index) from sitemap texts (origin, body)."""
    entries = files.select("origin", F.col("body").rlike("<sitemapindex").alias("is_index"), F.explode(F.regexp_extract_all("body", F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))).alias("e"))
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("e", rf"(?s)<{t}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{t}>", 1)), F.lit(""))
    return entries.select("origin", F.replace(tag("loc"), F.lit("&amp;"), F.lit("&")).alias("loc"), tag("lastmod").alias("lastmod"), "is_index").where("loc is not null")


def jsonl_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a graph written by sinks.write_graph, by kind of record."""
    rows = spark.read.text(path).select(F.get_json_object("value", "$.kind").alias("kind"), "value")
    kinds = [r.kind for r in rows.select("kind").distinct().collect()]  # a handful of record kinds
    return {k: rows.where(F.col("kind") == k).select("value") for k in sorted(kinds)}


def as_json(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The lines as VARIANT values."""
    return lines.select(F.parse_json("value").alias("value"))


def gold_corpus(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Pages (page_id, url, html) and gold rows (page_id, url, schema, facts as JSON) of a folder with gold.json, a list of
    cases {id, url, file, schema, facts}, and the saved pages that they name."""
    text = spark.read.option("wholetext", "true").text(f"{folder.rstrip('/')}/gold.json").first().value
    cases = [(i, c.get("url"), c.get("file") or f"{c.get('id')}.html", json.dumps(c.get("schema") or {}, sort_keys=True), json.dumps(c.get("facts") or {}, sort_keys=True)) for i, c in enumerate(json.loads(text))]
    gold = spark.createDataFrame(cases, "page_id long, url string, file string, schema string, facts string")  # a labelled set
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.htm*").option("recursiveFileLookup", "true").load(folder).select(F.substring_index("path", "/", -1).alias("file"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))
    return gold.join(files, "file").select("page_id", "url", "html"), gold.select("page_id", "url", "schema", "facts")
