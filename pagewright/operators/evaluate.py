"""Evaluation: order claims from geometry, placements, leaks, upper bounds, and corpora of pages with known facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import facts, parse


def order_claims(boxes: DataFrame, line: float = 4.0) -> DataFrame:
    """(page_id, first, second): what is surely read before what, for boxes (page_id, pos, x, y, width, height): a box that
    ends above another's top in the same column, or to the left of it in the same row; of each box the nearest below and the
    nearest to the right, so claims grow with the boxes, not with their pairs.
    """
    b = boxes.where("height > 0 and width > 0")
    by_column, by_row = Window.partitionBy("page_id", "_c").orderBy("y", "pos"), Window.partitionBy("page_id", "_r").orderBy("x", "pos")
    c = b.withColumn("_c", F.round(F.col("x") / line)).withColumn("second", F.lead("pos").over(by_column)).withColumn("_t", F.lead("y").over(by_column)).where(F.col("_t") >= F.col("y") + F.col("height"))
    r = b.withColumn("_r", F.round(F.col("y") / line)).withColumn("second", F.lead("pos").over(by_row)).withColumn("_t", F.lead("x").over(by_row)).where(F.col("_t") >= F.col("x") + F.col("width"))
    return c.select("page_id", F.col("pos").alias("first"), "second").unionByName(r.select("page_id", F.col("pos").alias("first"), "second")).distinct()


def claims_met(claims: DataFrame, order: DataFrame) -> DataFrame:
    """(page_id, claims, met): claims (first, second) that an order (page_id, pos, reading_pos) keeps."""
    o = lambda name: order.select("page_id", F.col("pos").alias(name), F.col("reading_pos").alias(f"_{name}"))
    j = claims.join(o("first"), ["page_id", "first"]).join(o("second"), ["page_id", "second"])
    return j.groupBy("page_id").agg(F.count("*").alias("claims"), F.count_if(F.col("_first") < F.col("_second")).alias("met"))


def pairwise_accuracy(truth: DataFrame, placed: DataFrame) -> DataFrame:
    """(page_id, pairs, right): of the pairs of neighbours in true order (page_id, key, pos), those that a placement keeps."""
    nxt = truth.withColumn("_next", F.lead("key").over(Window.partitionBy("page_id").orderBy("pos"))).where("_next is not null").select("page_id", "key", "_next")
    a, b = placed.select("page_id", "key", F.col("pos").alias("_a")), placed.select("page_id", F.col("key").alias("_next"), F.col("pos").alias("_b"))
    j = nxt.join(a, ["page_id", "key"]).join(b, ["page_id", "_next"])
    return j.groupBy("page_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("_a") < F.col("_b")).alias("right"))


def ablated(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """blocks without those of chosen keys (page_id, key), for placing them anew."""
    return blocks.join(keys.select("page_id", "key").distinct(), ["page_id", "key"], "left_anti").select(*blocks.columns)


def verdict(expected: Column, actual: Column) -> Column:
    """correct, wrong or missing: nulls only meet nulls, numbers agree to a millionth, texts folded."""
    number = lambda c: c.try_cast("double")
    near = F.abs(number(expected) - number(actual)) <= F.greatest(F.lit(1e-6), 1e-6 * F.abs(number(expected)))
    same = F.coalesce(near, F.lower(T.fold_space(expected)) == F.lower(T.fold_space(actual)))
    return F.when(expected.isNull() & actual.isNull(), "correct").when(actual.isNull(), "missing").when(expected.isNull(), "wrong").when(same, "correct").otherwise("wrong")


def leak_score(found: DataFrame, forbidden: DataFrame, size: int = 5) -> DataFrame:
    """(page_id, leaked): the share of the forbidden text's word runs that the found text (page_id, text) holds; a forbidden
    text shorter than a run counts whole."""
    words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != "")
    runs = lambda d: d.select("page_id", F.explode(F.when(F.size(words) >= size, T.shingles(words, size)).otherwise(F.array(F.array_join(words, " ")))).alias("s")).where("s <> ''").distinct()
    bad = runs(forbidden)
    hit = bad.join(runs(found), ["page_id", "s"], "left_semi").groupBy("page_id").count()
    return bad.groupBy("page_id").agg(F.count("*").alias("n")).join(hit, "page_id", "left").select("page_id", (F.coalesce("count", F.lit(0)) / F.col("n")).alias("leaked"))


def best_run(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, f1): what the best contiguous run of blocks could score against the wanted text (page_id, text), by words as
    multisets; runs end where they gain nothing, as in the selection of content."""
    w = wanted.select("page_id", T.tokenize(F.col("text")).alias("_want"))
    b = blocks.select("page_id", "pos", T.tokenize(F.col("text")).alias("_has")).join(w, "page_id")
    hits = F.size(F.filter("_has", lambda t: F.array_contains("_want", t)))
    b = b.select("page_id", "pos", hits.alias("h"), F.size("_has").alias("n"), F.size("_want").alias("want"))
    order = Window.partitionBy("page_id").orderBy("pos")
    b = b.withColumn("_v", 2 * F.col("h") - F.col("n")).withColumn("_s", F.sum("_v").over(order)).withColumn("_low", F.coalesce(F.min("_s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = b.withColumn("_low", F.least("_low", F.lit(0))).withColumn("_gain", F.col("_s") - F.col("_low")).withColumn("_ch", F.sum("h").over(order)).withColumn("_cn", F.sum("n").over(order))
    end = b.groupBy("page_id").agg(F.max_by(F.struct("pos", "_low", "_ch", "_cn", "want"), F.struct("_gain", -F.col("pos"))).alias("e"))
    j = b.join(end, "page_id").where(F.col("pos") <= F.col("e.pos"))
    start = j.groupBy("page_id", "e").agg(F.max(F.when(F.col("_s") == F.col("e._low"), F.struct("pos", "_ch", "_cn"))).alias("s"))
    h, n = F.col("e._ch") - F.coalesce("s._ch", F.lit(0)), F.col("e._cn") - F.coalesce("s._cn", F.lit(0))
    p, r = F.coalesce(h / F.nullif(n, F.lit(0)), F.lit(0.0)), F.least(F.lit(1.0), F.coalesce(h / F.nullif(F.col("e.want"), F.lit(0)), F.lit(0.0)))
    return start.select("page_id", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def summarise(scores: DataFrame, by: str, *measures: str) -> DataFrame:
    """Means of measures for each mode, and how many rows they rest on."""
    return scores.groupBy(by).agg(F.count("*").alias("n"), *(F.avg(m).alias(m) for m in measures)).orderBy(by)


def run_corpus(pages: DataFrame, gold: DataFrame, schema: dict) -> DataFrame:
    """(page_id, field, expected, actual, verdict) of a corpus: facts of every page under a schema against its gold facts
    (page_id, facts as JSON); a page that cannot be read has its fields missing."""
    found = facts.merge_facts(facts.extract_facts(parse.payloads_of(parse.parse_pages(pages)), schema)).select("page_id", F.col("path").alias("field"), F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v"), "value").alias("actual"))
    want = gold.select("page_id", F.explode(F.from_json("facts", "map<string,string>")).alias("field", "expected"))
    return want.join(found, ["page_id", "field"], "left").withColumn("verdict", verdict(F.col("expected"), F.col("actual")))


def corpus_score(verdicts: DataFrame, gate: float = 0.0) -> DataFrame:
    """One row: fields, accuracy, wrong and miss rates, the share of perfect pages, and whether accuracy passes a gate."""
    page = verdicts.groupBy("page_id").agg(F.min((F.col("verdict") == "correct").cast("int")).alias("perfect")).agg(F.avg("perfect").alias("perfect_pages"))
    rate = lambda v: F.avg((F.col("verdict") == v).cast("double"))
    total = verdicts.agg(F.count("*").alias("fields"), rate("correct").alias("accuracy"), rate("wrong").alias("wrong_rate"), rate("missing").alias("miss_rate"))
    return total.crossJoin(F.broadcast(page)).withColumn("passed", F.col("accuracy") >= gate)  # one row each
