"""Building a knowledge graph: quotes verified against blocks, drafts merged into entities, relations resolved; and what
readers of the graph ask of it.

Extraction gives assertions as rows, from rules (FakeProvider) or from a model; nothing here calls one.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators import knowledge
from pagewright.operators.knowledge import GENERIC_SHARE, locate_quote
from pagewright.storage import staged

#: Types that say what a thing is; any other type is open and gives way to them.
CORE = ("Person", "Organization", "Place", "Product", "Event", "Work", "Date", "Money", "Email", "Phone")
#: Predicates that mean the same, by the one that stands for them.
SYNONYMS = {
    "located_in": ("based_in", "headquartered_in", "in", "is_in", "situated_in"),
    "works_for": ("employed_by", "is_employed_by", "works_at"),
    "founded_by": ("created_by", "established_by", "started_by"),
    "part_of": ("belongs_to", "member_of", "subsidiary_of"),
    "costs": ("has_price", "price", "priced_at"),
    "published_on": ("date_published", "posted_on", "released_on"),
}
SCALAR = 200


def normalise_predicate(predicate: Column) -> Column:
    """Snake case, auxiliary words off, and the predicate that stands for its synonyms."""
    bare = F.regexp_replace(T.snake_case(predicate), r"^(?:(?:is|was|are|were|has_been|have_been)_)(?=.)", "")
    table = F.create_map(*(F.lit(x) for name, others in SYNONYMS.items() for o in others for x in (o, name)))
    return F.coalesce(table[T.snake_case(predicate)], table[bare], bare)


def pascal(kind: Column) -> Column:
    """A type name in PascalCase."""
    return F.array_join(F.transform(F.split(F.regexp_replace(kind, r"([a-z0-9])([A-Z])", "$1 $2"), r"[^A-Za-z0-9]+"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1000)))), "")


def scalar(value: Column) -> Column:
    """A short text for a value; null for objects, lists and long texts."""
    v = F.trim(value)
    return F.when((v != "") & (F.length(v) <= SCALAR) & ~v.rlike(r"^[\[{]"), v)


def guess_type(name: Column) -> Column:
    """What a name's form says: a date, an amount, an address, a company's ending, else a thing."""
    return (
        F.when(name.rlike(knowledge.PATTERNS["Date"]), "Date")
        .when(name.rlike(knowledge.PATTERNS["Money"]), "Money")
        .when(name.rlike(r"^[\w.+-]+@[\w-]+\.[\w.-]+$"), "Email")
        .when(name.rlike(r"(?i)\b(?:ag|co|company|corp|corporation|foundation|gmbh|group|inc|institute|llc|ltd|plc|sa|university)\.?$"), "Organization")
        .when(name.rlike(r"(?i)^(?:dr|mr|mrs|ms|prof)\.? "), "Person")
        .otherwise("Thing")
    )


def window_of(text: Column, needle: Column, words: int = 8) -> Column:
    """The needle in a text with so many words on each side; null where it is not there."""
    at = F.call_function("locate", F.lower(needle), F.lower(text))
    left = F.split(F.trim(F.substring(text, F.lit(1), at - 1)), r"\s+")
    right = F.split(F.trim(F.substring(text, at + F.length(needle), F.length(text))), r"\s+")
    some = lambda a, n, end: F.array_join(F.filter(F.slice(a, F.greatest(F.lit(1), F.size(a) - n + 1) if end else F.lit(1), F.lit(n)), lambda w: w != ""), " ")
    return F.when(at > 0, F.trim(F.concat_ws(" ", some(left, words, True), F.substring(text, at, F.length(needle)), some(right, words, False))))


def prepare(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """(section_id, text): each section as marked blocks, [pos] before each, for an extractor that must name its block."""
    b = blocks.join(sections.select("section_id", "page_id", "first_pos", "last_pos"), "page_id").where(F.col("pos").between(F.col("first_pos"), F.col("last_pos")) & (F.col("text") != ""))
    said = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), "text")
    return b.groupBy("section_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("s")))), lambda x: x["s"]), "\n").alias("text"))


def fake_extract(blocks: DataFrame) -> DataFrame:
    """Assertions of the rule-based extractor: entities by pattern, neighbours in one block related, each with its quote:
    (page_id, pos, subject, subject_type, predicate, object, object_type, quote)."""
    m = knowledge.mentions(blocks)
    nxt = Window.partitionBy("page_id", "pos").orderBy("start", "end", "name")
    pair = m.withColumn("object", F.lead("name").over(nxt)).withColumn("object_type", F.lead("type").over(nxt)).withColumn("_oend", F.lead("end").over(nxt))
    j = pair.join(blocks.select("page_id", "pos", "text"), ["page_id", "pos"])
    quote = F.when(F.col("object").isNull(), F.col("name")).otherwise(F.expr("substring(text, start + 1, _oend - start)"))
    return j.select("page_id", "pos", F.col("name").alias("subject"), F.col("type").alias("subject_type"), F.when(F.col("object").isNotNull(), F.concat(F.lit("near_"), F.lower("object_type"))).alias("predicate"), "object", "object_type", quote.alias("quote"))


def verify(assertions: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Assertions whose quote stands in their block, with its span (start, end) and evidence_id; and (reason, rejected).

    A quote is found whatever its case, white space and Markdown marks. Without a block of that place, without a quote, with
    a quote that is not there, or one that does not name the subject, an assertion is rejected.
    """

    @F.pandas_udf("start int, end int")
    def spans(text: pd.Series, quote: pd.Series) -> pd.DataFrame:
        found = [locate_quote(t, q) if isinstance(t, str) and isinstance(q, str) and q.strip() else None for t, q in zip(text, quote, strict=True)]
        return pd.DataFrame({"start": pd.array([f[0] if f else None for f in found], "Int32"), "end": pd.array([f[1] if f else None for f in found], "Int32")})

    j = assertions.join(blocks.select("page_id", "pos", "text"), ["page_id", "pos"], "left").withColumn("_span", spans("text", "quote"))
    named = F.lower(T.fold_space(F.col("quote"))).contains(F.lower(T.fold_space(F.col("subject"))))
    reason = F.when(F.col("text").isNull(), "no such block").when(F.coalesce(F.trim("quote"), F.lit("")) == "", "no quote").when(F.col("_span.start").isNull(), "quote not in block").when(~named, "quote does not name the subject")
    j = j.withColumn("_reason", reason)
    evidence = T.short_id("ev", F.col("page_id").cast("string"), F.col("pos").cast("string"), F.col("_span.start").cast("string"), F.col("_span.end").cast("string"))
    kept = j.where("_reason is null").select(*assertions.columns, F.col("_span.start").alias("start"), F.col("_span.end").alias("end"), evidence.alias("evidence_id"))
    return kept, j.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("rejected"))


def compatible(a: Column, b: Column) -> Column:
    """Whether two types can be one entity's: equal, or at least one of them open."""
    return (a == b) | ~a.isin(*CORE) | ~b.isin(*CORE)


def homes(drafts: DataFrame) -> DataFrame:
    """drafts (type, name, evidence_id, ...) with entity_id and the type of their home.

    Drafts of one type and name key are one entity. A draft of an open type goes to the core type of the same name, where
    there is just one; names that differ in spelling are aliases of the most frequent one.
    """
    d = drafts.withColumn("type", pascal(F.col("type"))).withColumn("norm", T.norm_name(F.col("name"))).where("norm <> ''")
    core = d.where(F.col("type").isin(*CORE)).groupBy("norm").agg(F.collect_set("type").alias("_core")).where(F.size("_core") == 1).select("norm", F.col("_core")[0].alias("_core"))
    d = d.join(core, "norm", "left").withColumn("type", F.when(F.col("type").isin(*CORE), F.col("type")).otherwise(F.coalesce("_core", "type"))).drop("_core")
    return d.withColumn("entity_id", T.short_id("ent", F.col("type"), F.col("norm")))


def structured_drafts(payloads: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, pos, type, name, start, end, evidence_id): entities that structured data names, where the page's text says
    their name; one that no block says has no evidence and is left out."""
    kind = F.regexp_extract(F.coalesce(F.get_json_object("data", "$.@type"), F.lit("")), r"([^/\[\]\"]+)[\]\"]*$", 1)
    e = payloads.select("page_id", kind.alias("type"), scalar(F.coalesce(F.get_json_object("data", "$.name"), F.get_json_object("data", "$.headline"))).alias("name")).where("name is not null and type <> ''").distinct()
    j = e.join(blocks.select("page_id", "pos", "text"), "page_id").withColumn("start", F.call_function("locate", F.lower("name"), F.lower("text")) - 1).where("start >= 0")
    first = j.withColumn("_n", F.row_number().over(Window.partitionBy("page_id", "type", "name").orderBy("pos"))).where("_n = 1").drop("_n", "text")
    first = first.withColumn("end", F.col("start") + F.length("name"))
    return first.withColumn("evidence_id", T.short_id("ev", F.col("page_id").cast("string"), F.col("pos").cast("string"), F.col("start").cast("string"), F.col("end").cast("string")))


def resolve_merges(merges: DataFrame, rounds: int = 20) -> DataFrame:
    """(loser, winner) with every chain followed to its end: pointers double in each round, so long chains take few."""
    found = staged(merges.select("loser", "winner"), "merges")
    for _ in range(rounds):
        onward = found.alias("a").join(found.alias("b"), F.col("a.winner") == F.col("b.loser"), "left").select("a.loser", F.coalesce("b.winner", "a.winner").alias("winner"))
        onward = staged(onward, "merges")
        if not onward.exceptAll(found).head(1):
            break
        found = onward
    return found.where("loser <> winner")


def finish(drafts: DataFrame, relations: DataFrame, pages: int) -> dict[str, DataFrame]:
    """entities, mentions and relations of a graph from homed drafts (entity_id, type, norm, name, page_id, pos, start, end,
    evidence_id) and relations (subject_id, predicate, object_id, evidence_id).

    Near-equal names are merged into the one with more evidence, chains to their end; evidence counts once; relations of an
    entity with itself, or with one that is not there, go.
    """
    found = staged(drafts.select("entity_id", "type", "norm", "name", "page_id", "pos", "start", "end", "evidence_id").distinct(), "drafts")
    merges = resolve_merges(knowledge.near_names(knowledge.entities(found, pages)))
    into = lambda df, c: df.join(merges.select(F.col("loser").alias(c), F.col("winner").alias("_w")), c, "left").withColumn(c, F.coalesce("_w", c)).drop("_w")
    mentions = staged(into(found, "entity_id").dropDuplicates(["entity_id", "evidence_id"]), "mentions")
    first = mentions.groupBy("entity_id").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("_longest"), F.count_distinct("evidence_id").alias("evidence"), F.count_distinct("page_id").alias("pages"), F.sort_array(F.collect_set("name")).alias("aliases"))
    named = mentions.groupBy("entity_id", "type", "name").count()
    best = named.groupBy("entity_id").agg(F.max_by(F.struct("type", "name"), F.struct("count", "name")).alias("b")).select("entity_id", "b.*")
    entities = best.join(first.drop("_longest"), "entity_id").withColumn("aliases", F.array_remove("aliases", F.col("name"))).withColumn("generic", (F.lit(pages) >= 3) & (F.col("pages") > GENERIC_SHARE * pages))
    r = into(into(relations, "subject_id"), "object_id").where("subject_id <> object_id")
    for c in ("subject_id", "object_id"):
        r = r.join(entities.select(F.col("entity_id").alias(c)), c, "left_semi")
    r = r.withColumn("predicate", normalise_predicate(F.col("predicate"))).withColumn("relation_id", T.short_id("rel", F.col("subject_id"), F.col("predicate"), F.col("object_id")))
    r = r.groupBy("relation_id", "subject_id", "predicate", "object_id").agg(F.count_distinct("evidence_id").alias("evidence"), F.sort_array(F.collect_set("evidence_id")).alias("evidence_ids"))
    return {"entities": entities, "mentions": mentions.select("entity_id", "page_id", "pos", "start", "end", "evidence_id"), "relations": r}


def build_graph(blocks: DataFrame, payloads: DataFrame | None = None, assertions: DataFrame | None = None) -> dict[str, DataFrame]:
    """A whole graph from blocks (page_id, pos, text): assertions (by default the rule-based extractor's) verified, drafts of
    both ends and of structured data merged; with `rejected`, the reasons counted."""
    kept, rejected = verify(assertions if assertions is not None else fake_extract(blocks), blocks)
    kept = staged(kept, "assertions")
    place = ("page_id", "pos", "start", "end", "evidence_id")
    subjects = kept.select(F.col("subject_type").alias("type"), F.col("subject").alias("name"), *place)
    drafts = subjects.unionByName(kept.where("object is not null").select(F.coalesce("object_type", guess_type(F.col("object"))).alias("type"), F.col("object").alias("name"), *place))
    if payloads is not None:
        drafts = drafts.unionByName(structured_drafts(payloads, blocks).select("type", "name", *place))
    homed = staged(homes(drafts), "homes")
    ids = homed.select("norm", "entity_id", "type").distinct()
    end = lambda side: ids.select(F.col("norm").alias(f"_{side}"), F.col("entity_id").alias(f"{side}_id"), F.col("type").alias(f"_{side}t"))
    r = kept.where("object is not null").select(T.norm_name(F.col("subject")).alias("_subject"), T.norm_name(F.col("object")).alias("_object"), pascal(F.col("subject_type")).alias("_st"), pascal(F.coalesce("object_type", guess_type(F.col("object")))).alias("_ot"), "predicate", "evidence_id")
    r = r.join(end("subject"), "_subject").join(end("object"), "_object").where(compatible(F.col("_st"), F.col("_subjectt")) & compatible(F.col("_ot"), F.col("_objectt")))
    return finish(homed, r.select("subject_id", "predicate", "object_id", "evidence_id"), blocks.select("page_id").distinct().count()) | {"rejected": rejected}


def entities_in(mentions: DataFrame, sections: DataFrame) -> DataFrame:
    """(section_id, entity_id, mentions): entities that sections (section_id, page_id, first_pos, last_pos) mention."""
    j = mentions.join(sections, "page_id").where(F.col("pos").between(F.col("first_pos"), F.col("last_pos")))
    return j.groupBy("section_id", "entity_id").agg(F.count("*").alias("mentions"))


def adjacency(relations: DataFrame) -> DataFrame:
    """(source, target, weight): relations both ways, by the evidence of all predicates."""
    r = relations.select(F.col("subject_id").alias("source"), F.col("object_id").alias("target"), "evidence")
    both = r.unionByName(r.select(F.col("target").alias("source"), F.col("source").alias("target"), "evidence"))
    return both.groupBy("source", "target").agg(F.sum("evidence").alias("weight"))


def entity_summaries(entities: DataFrame, relations: DataFrame, limit: int) -> DataFrame:
    """(entity_id, type, name, evidence, degree), the best connected first: a top-k report."""
    degree = adjacency(relations).groupBy(F.col("source").alias("entity_id")).agg(F.count("*").alias("degree"))
    return entities.join(degree, "entity_id", "left").select("entity_id", "type", "name", "evidence", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), F.desc("evidence"), "name", "entity_id").limit(limit)


def relation_summaries(relations: DataFrame, among: DataFrame) -> DataFrame:
    """Relations both of whose ends are in a set (entity_id), the best supported first."""
    r = relations
    for c in ("subject_id", "object_id"):
        r = r.join(among.select(F.col("entity_id").alias(c)).distinct(), c, "left_semi")
    return r.orderBy(F.desc("evidence"), "relation_id")


def graph_stats(entities: DataFrame, mentions: DataFrame, relations: DataFrame, predicates: int = 40) -> DataFrame:
    """(kind, name, n): counts of the graph, of entities by type, and of its most frequent predicates."""
    one = lambda df, name, n: df.agg(n.alias("n")).select(F.lit("total").alias("kind"), F.lit(name).alias("name"), "n")
    out = one(entities, "entities", F.count("*")).unionByName(one(relations, "relations", F.count("*"))).unionByName(one(mentions, "mentions", F.count("*"))).unionByName(one(mentions, "pages", F.count_distinct("page_id")))
    out = out.unionByName(entities.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n"))
    return out.unionByName(relations.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(predicates).select(F.lit("predicate").alias("kind"), F.col("predicate").alias("name"), "n"))


def overlap_search(rows: DataFrame, id_col: str, text: Column, question: str, limit: int) -> DataFrame:
    """(id, score): the share of the question's terms that a text holds, for stores without an index."""
    terms = sorted({t for t in re.findall(r"[a-z0-9]+", question.lower()) if len(t) > 1})
    share = F.size(F.array_intersect(T.tokenize(text), F.array(*map(F.lit, terms)))) / len(terms) if terms else F.lit(0.0)
    return rows.select(F.col(id_col).alias("id"), share.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def parse_reply(text: str):
    """JSON of a model's reply, in a fence or between words; None if there is none."""
    fenced = re.search(r"```(?:json)?\s*(.*?)```", text, re.S)
    for body in ([fenced[1]] if fenced else []) + [text, text[text.find("{") : text.rfind("}") + 1], text[text.find("[") : text.rfind("]") + 1]]:
        try:
            return json.loads(body)
        except ValueError:
            continue
    return None
