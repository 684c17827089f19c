"""Knowledge graph: mentions with evidence, entity merging, relations, graph-expanded answers, exports.

Extraction is by rules (money, dates, addresses, capitalised names); a model can replace it by giving rows of the same form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T

# Fixed values of merging and of answering.
MERGE_JACCARD, BANDS, ROWS = 0.9, 16, 4
GENERIC_SHARE, DECAY, MOST_ENTITIES, EVIDENCE, REACHED_SHARE = 0.6, 0.5, 60, 24, 0.35

#: Patterns of our own choosing, by entity type.
PATTERNS = {
    "Money": r"(?:[$€£]\s?\d[\d.,]*\d|\d[\d.,]*\d\s?(?:USD|EUR|GBP))",
    "Date": r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2} (?:January|February|March|April|May|June|July|August|September|October|November|December) \d{4})\b",
    "Email": r"[\w.+-]+@[\w-]+\.[\w.-]+\w",
    "Phone": r"\+\d{1,3} \(\d{3}\) \d{3}-\d{4}",
    "Name": r"\b\p{Lu}\p{Ll}{2,}(?: \p{Lu}\p{Ll}{2,}){1,3}\b",
}


def mentions(blocks: DataFrame) -> DataFrame:
    """(entity_id, type, name, norm, page_id, pos, start, end, evidence_id) of every match of each pattern in block
    texts, in one pass over them."""

    def places(kind: str, pattern: str) -> Column:
        """Every match with its place: each is looked for after the one before."""
        start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<type:string,name:string,start:int>>").alias("out"))

        def step(s, m):
            at = F.call_function("locate", m, F.col("text"), s["at"])
            return F.struct((at + F.length(m)).alias("at"), F.concat(s["out"], F.array(F.struct(F.lit(kind).alias("type"), m.alias("name"), (at - 1).alias("start")))).alias("out"))

        return F.aggregate(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), start, step, lambda s: s["out"])

    found = blocks.select("page_id", "pos", F.inline(F.concat(*(places(k, p) for k, p in PATTERNS.items()))))
    found = found.withColumn("end", F.col("start") + F.length("name")).withColumn("norm", T.norm_name(F.col("name")))
    found = found.withColumn("entity_id", T.short_id("ent", F.col("type"), F.col("norm"))).withColumn("evidence_id", T.short_id("ev", F.col("page_id").cast("string"), F.col("pos").cast("string"), F.col("start").cast("string"), F.col("end").cast("string")))
    return found.select("entity_id", "type", "name", "norm", "page_id", "pos", "start", "end", "evidence_id")


def entities(found: DataFrame, pages: int) -> DataFrame:
    """(entity_id, type, name, evidence, pages, generic): the most frequent spelling names an entity."""
    names = found.groupBy("entity_id", "type", "norm", "name").agg(F.count_distinct("evidence_id").alias("n"))
    best = names.groupBy("entity_id", "type", "norm").agg(F.max_by("name", F.struct("n", "name")).alias("name"))
    counts = found.groupBy("entity_id").agg(F.count_distinct("evidence_id").alias("evidence"), F.count_distinct("page_id").alias("pages"))
    return best.join(counts, "entity_id").withColumn("generic", (F.lit(pages) >= 3) & (F.col("pages") > GENERIC_SHARE * pages))


def near_names(ents: DataFrame) -> DataFrame:
    """(loser, winner): entities of one type whose name 3-grams agree to 0.9; the one with more evidence wins.

    Candidates share a band of a minhash; each band's key meets only itself in the join.
    """
    grams = ents.select("entity_id", "type", "norm", "evidence", T.name_grams(F.col("norm")).alias("g"))
    least = lambda i: F.array_min(F.transform("g", lambda s: F.xxhash64(F.lit(i), s)))
    hashes = [least(i) for i in range(BANDS * ROWS)]
    bands = F.array(*(F.xxhash64(F.lit(b), *hashes[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)))
    banded = grams.withColumn("band", F.explode(F.array_distinct(bands)))
    a, b = banded.alias("a"), banded.alias("b")
    stronger = F.struct(F.col("a.evidence"), F.col("b.entity_id")) > F.struct(F.col("b.evidence"), F.col("a.entity_id"))
    pairs = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.type") == F.col("b.type")) & (F.col("a.entity_id") != F.col("b.entity_id")) & stronger)
    pairs = pairs.where(T.jaccard(F.col("a.g"), F.col("b.g")) >= MERGE_JACCARD)
    return pairs.groupBy(F.col("b.entity_id").alias("loser")).agg(F.max_by(F.col("a.entity_id"), F.struct(F.col("a.evidence"), F.col("a.entity_id"))).alias("winner"))


def relations(found: DataFrame) -> DataFrame:
    """(relation_id, subject_id, predicate, object_id, evidence): entities named in one block, in order of place."""
    m = found.select("entity_id", "type", "page_id", "pos", "start").distinct()
    nxt = Window.partitionBy("page_id", "pos").orderBy("start", "entity_id")
    r = m.withColumn("object_id", F.lead("entity_id").over(nxt)).withColumn("object_type", F.lead("type").over(nxt)).where("object_id is not null and object_id <> entity_id")
    r = r.withColumn("predicate", F.concat(F.lit("near_"), F.lower("object_type"))).withColumnRenamed("entity_id", "subject_id")
    r = r.withColumn("relation_id", T.short_id("rel", F.col("subject_id"), F.col("predicate"), F.col("object_id")))
    return r.groupBy("relation_id", "subject_id", "predicate", "object_id").agg(F.count_distinct("page_id", "pos").alias("evidence"))


def reach(seeds: DataFrame, rels: DataFrame, ents: DataFrame, hops: int = 2) -> DataFrame:
    """(entity_id, score, hop): seeds and what relations reach from them; generic entities are reached but not left."""
    both = rels.select(F.col("subject_id").alias("s"), F.col("object_id").alias("o"), F.col("evidence").alias("w")).unionByName(rels.select(F.col("object_id").alias("s"), F.col("subject_id").alias("o"), F.col("evidence").alias("w")))
    mass = both.groupBy("s").agg(F.sum("w").alias("_all"))
    edges = both.join(mass, "s").select("s", "o", (F.col("w") / F.col("_all")).alias("share"))
    total = front = seeds.select("entity_id", "score", F.lit(0).alias("hop"))
    plain = ents.where(~F.col("generic")).select("entity_id")
    for hop in range(1, hops + 1):
        got = front.join(plain, "entity_id", "left_semi").join(edges, F.col("entity_id") == F.col("s")).groupBy("o").agg(F.sum(F.col("score") * F.col("share") * DECAY).alias("score"))
        front = got.select(F.col("o").alias("entity_id"), "score", F.lit(hop).alias("hop")).join(total.select("entity_id"), "entity_id", "left_anti")
        total = total.unionByName(front)
    return total.orderBy(F.desc("score"), "entity_id").limit(MOST_ENTITIES)


def heads(pages: DataFrame) -> DataFrame:
    """Counts of a graph: entities, mentions, pages, by type."""
    return pages.groupBy("type").agg(F.count_distinct("entity_id").alias("entities"), F.count("*").alias("mentions"), F.count_distinct("page_id").alias("pages"))


def locate_quote(text: str, quote: str) -> tuple[int, int] | None:
    """Span of a quote in a text, white space and case folded, Markdown marks ignored."""
    kept = [(i, c) for i, c in enumerate(text) if c not in "*_`"]
    out, at = [], []
    for i, c in kept:
        if c.isspace() and (not out or out[-1] == " "):
            continue
        out.append(" " if c.isspace() else c.lower()[0])
        at.append(i)
    wanted = " ".join("".join(c for c in quote if c not in "*_`").lower().split())
    found = "".join(out).find(wanted) if wanted else -1
    return (at[found], at[found + len(wanted) - 1] + 1) if found >= 0 else None
