"""Structured payloads to facts under a JSON Schema, with confidence and precedence."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Confidence by how a field was matched and by where it came from; loss for each level of nesting.
HOW = {"exact": 0.95, "declared-alias": 0.92, "normalized": 0.88, "known-alias": 0.80, "nested": 0.72}
SOURCE = {"json-ld": 1.0, "microdata": 0.98, "next-data": 0.95, "rsc-flight": 0.93, "nuxt": 0.93, "initial-state": 0.90, "open-graph": 0.85}
PER_LEVEL, DEEPEST = 0.97, 6
#: Other names under which fields are published.
KNOWN = {"title": ["name", "headline", "og:title"], "name": ["title", "headline"], "image": ["og:image", "thumbnailUrl"], "price": ["lowPrice", "amount"], "description": ["og:description", "summary"], "date": ["datePublished", "dateCreated"], "author": ["creator", "byline"]}


def _plain(key: str) -> str:
    return re.sub(r"[^a-z0-9]", "", key.lower())


def number(raw) -> float | None:
    """A number written in any locale; None where separators leave it open."""
    if isinstance(raw, int | float) and not isinstance(raw, bool):
        return float(raw)
    s = re.sub(r"[^0-9.,\- ]", "", str(raw)).strip(" .,")
    sign, s = (-1, s[1:].strip()) if s.startswith("-") else (1, s)
    if re.fullmatch(r"\d+", s) or re.fullmatch(r"\d{1,3}([ .,]\d{3})+", s):
        return sign * float(re.sub(r"\D", "", s))
    if m := re.fullmatch(r"(\d+|\d{1,3}(?:[ .,]\d{3})+)[.,](\d{1,2})", s):
        return sign * float(re.sub(r"\D", "", m[1]) + "." + m[2])
    return None


def lookup(data, field: str, aliases: list[str], depth: int = 0):
    """(value, how, depth) of a field in nested data, the nearest and most exact match first; None if there is none."""
    if isinstance(data, dict):
        if field in data:
            return data[field], "nested" if depth else "exact", depth
        for names, how in ((aliases, "declared-alias"), ([k for k in data if _plain(k) == _plain(field)], "normalized"), (KNOWN.get(field, []), "known-alias")):
            for name in names:
                if name in data:
                    return data[name], "nested" if depth else how, depth
    if depth >= DEEPEST:
        return None
    inner = data.values() if isinstance(data, dict) else data if isinstance(data, list) else ()
    found = [m for x in inner if isinstance(x, dict | list) and (m := lookup(x, field, aliases, depth + 1))]
    return min(found, key=lambda m: m[2], default=None)


def coerce(value, kind: str | None, enum: list | None):
    """The value as the schema's type, or None."""
    if isinstance(value, list) and kind != "array":
        value = value[0] if value else None
    if isinstance(value, dict) and kind not in ("object", None):
        value = value.get("name") or value.get("@value") or value.get("url")
    if value is None:
        return None
    if enum:
        tail = str(value).rstrip("/").rsplit("/", 1)[-1]
        return next((e for e in enum if _plain(str(e)) in (_plain(str(value)), _plain(tail))), None)
    if kind in ("number", "integer"):
        n = number(value)
        return None if n is None or kind == "integer" and n != int(n) else int(n) if kind == "integer" else n
    if kind == "boolean":
        return {"true": True, "yes": True, "1": True, "false": False, "no": False, "0": False}.get(str(value).strip().lower())
    if kind == "string":
        return re.sub(r"\s+", " ", str(value)).strip() or None
    return value


def walk(schema: dict, data, source: str, prefix: str = "") -> list[tuple[str, str, float, str]]:
    """(path, JSON value, confidence, how) of each field of the schema found in a payload."""
    out = []
    for name, sub in schema.get("properties", {}).items():
        match = lookup(data, name, sub.get("x-aliases", []))
        if match is None:
            continue
        value, how, depth = match
        path, kind = f"{prefix}{name}", sub.get("type")
        if kind == "object" and sub.get("properties"):
            out += walk(sub, value[0] if isinstance(value, list) and value else value, source, path + ".")
            continue
        if kind == "array":
            items = value if isinstance(value, list) else [value]
            value = [v for x in items if (v := coerce(x, sub.get("items", {}).get("type"), sub.get("items", {}).get("enum"))) is not None] or None
        else:
            value = coerce(value, kind, sub.get("enum"))
        if value is not None:
            out.append((path, json.dumps(value, ensure_ascii=False, sort_keys=True), min(1.0, round(HOW.get(how, 0.7) * SOURCE.get(source, 0.7) * PER_LEVEL**depth, 4)), how))
    return out


def extract_facts(payloads: DataFrame, schema: dict) -> DataFrame:
    """(page_id, seq, source, path, value, confidence, how) for payloads (page_id, seq, source, data)."""

    def run(frames):
        for f in frames:
            rows = [(p, s, src, *fact) for p, s, src, d in f[["page_id", "seq", "source", "data"]].itertuples(index=False, name=None) for fact in walk(schema, json.loads(d), src)]
            yield pd.DataFrame(rows, columns=["page_id", "seq", "source", "path", "value", "confidence", "how"])

    return payloads.select("page_id", "seq", "source", "data").mapInPandas(run, "page_id long, seq int, source string, path string, value string, confidence double, how string")


def merge_facts(facts: DataFrame) -> DataFrame:
    """One fact for each page and path: the highest confidence, of equal ones the first."""
    best = Window.partitionBy("page_id", "path").orderBy(F.desc("confidence"), "seq", "value")
    return facts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def score_facts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(page_id, path, verdict): correct, wrong or missing, for values as JSON; numbers agree to one in a million."""
    e, a = expected.select("page_id", "path", F.col("value").alias("_e")), actual.select("page_id", "path", F.col("value").alias("_a"))
    ne, na = F.col("_e").try_cast("double"), F.col("_a").try_cast("double")
    close = F.abs(ne - na) <= F.greatest(F.lit(1e-6), 1e-6 * F.greatest(F.abs(ne), F.abs(na)))
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    same = F.when(ne.isNotNull() & na.isNotNull(), close).otherwise(fold(F.col("_e")) == fold(F.col("_a")))
    return e.join(a, ["page_id", "path"], "left").select("page_id", "path", F.when(F.col("_a").isNull(), "missing").when(same, "correct").otherwise("wrong").alias("verdict"))


def run_score(verdicts: DataFrame) -> DataFrame:
    """One row: field accuracy, wrong and miss rates, and the share of pages with every field right."""
    pages = verdicts.groupBy("page_id").agg(F.bool_and(F.col("verdict") == "correct").alias("perfect"))
    rate = lambda v: F.avg((F.col("verdict") == v).cast("double"))
    return verdicts.agg(rate("correct").alias("field_accuracy"), rate("wrong").alias("wrong_rate"), rate("missing").alias("miss_rate")).crossJoin(pages.agg(F.avg(F.col("perfect").cast("double")).alias("page_success")))


#: Types of structured data that speak of a page of a kind.
SUBJECTS = {"product": ["Product", "Offer", "ProductGroup"], "article": ["Article", "NewsArticle", "BlogPosting", "TechArticle"], "recipe": ["Recipe"], "event": ["Event"], "job": ["JobPosting"], "profile": ["Person", "Organization", "LocalBusiness"], "video": ["VideoObject"]}
GENERIC = ["WebSite", "WebPage", "BreadcrumbList", "Organization", "SearchAction", "ImageObject"]
#: What a value that only a generic node or social metadata gives is worth.
FILLED = 0.8


def subject_tiers(payloads: DataFrame, pages: DataFrame) -> DataFrame:
    """payloads of each page's subject with `tier` 1 (its kind's types), 2 (other types) or 3 (generic types, social
    metadata); within a tier nodes that name the page itself are alone if there are any. pages is (page_id, url, page_type).
    """
    from pagewright.functions import urls as U

    kind = F.regexp_extract(F.coalesce(F.get_json_object("data", "$.@type"), F.lit("")), r"([A-Za-z]+)[\]\"]*$", 1)
    own = F.create_map(*(x for k, v in SUBJECTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    p = payloads.join(pages.select("page_id", F.col("url").alias("_url"), "page_type"), "page_id").withColumn("_kind", kind)
    tier = F.when((F.col("source") == "open-graph") | F.col("_kind").isin(*GENERIC), 3).when(F.coalesce(F.array_contains(own[F.col("page_type")], F.col("_kind")), F.lit(False)), 1).otherwise(2)
    named = F.coalesce(F.get_json_object("data", "$.url"), F.get_json_object("data", "$['@id']"), F.get_json_object("data", "$.mainEntityOfPage"))
    p = p.withColumn("tier", tier).withColumn("_self", F.coalesce(U.same_page(named, F.col("_url")), F.lit(False)))
    some = F.max("_self").over(Window.partitionBy("page_id", "tier"))
    return p.withColumn("_some", some).where(F.col("_self") | ~F.col("_some")).drop("_url", "_kind", "_self", "_some", "page_type")


def page_facts(payloads: DataFrame, pages: DataFrame, schema: dict) -> DataFrame:
    """One fact for each page and path: of the best tier that has it; facts of lower tiers fill gaps at less confidence."""
    tiers = subject_tiers(payloads, pages)
    facts = extract_facts(tiers, schema).join(tiers.select("page_id", "seq", "tier"), ["page_id", "seq"])
    facts = facts.withColumn("confidence", F.round(F.col("confidence") * F.when(F.col("tier") == 3, FILLED).otherwise(1.0), 4))
    best = Window.partitionBy("page_id", "path").orderBy("tier", F.desc("confidence"), "seq", "value")
    return facts.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


#: Fields of each page type, and their kinds.
SCHEMAS = {
    "article": {"title": "string", "author": "string", "datePublished": "date-time", "description": "string", "image": "string"},
    "product": {"name": "string", "price": "number", "currency": "string", "brand": "string", "availability": "string", "rating": "number", "description": "string", "image": "string"},
    "recipe": {"name": "string", "ingredients": "array", "totalTime": "string", "yield": "string"},
    "event": {"name": "string", "startDate": "date-time", "endDate": "date-time", "location": "string"},
    "job": {"title": "string", "company": "string", "location": "string", "datePosted": "date-time"},
}
DECLARED = {"currency": ["priceCurrency"], "rating": ["ratingValue"], "company": ["hiringOrganization"], "ingredients": ["recipeIngredient"], "yield": ["recipeYield"]}


def schema_for(page_type: str | None) -> dict:
    """The built-in JSON Schema of a page type; of any other page, a title and a description."""
    fields = SCHEMAS.get(page_type or "", {"title": "string", "description": "string"})
    one = lambda kind: {"type": "string", "format": "date-time"} if kind == "date-time" else {"type": kind, "items": {"type": "string"}} if kind == "array" else {"type": kind}
    return {"type": "object", "properties": {k: one(v) | ({"aliases": DECLARED[k]} if k in DECLARED else {}) for k, v in fields.items()}}


def site_name(meta: Column) -> Column:
    """og:site_name, else application-name; null if there is none."""
    return F.coalesce(F.nullif(F.trim(meta["og:site_name"]), F.lit("")), F.nullif(F.trim(meta["application-name"]), F.lit("")))


def without_site_name(title: Column, name: Column) -> Column:
    """A title without the site's name at either end, set off by a bar, dash or colon; a title that is the name stays."""
    t, n = F.trim(title), F.lower(F.trim(name))
    low = F.lower(t)
    tail = F.when(low.endswith(n), F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(n)), r"\s*[|·–—:»-]\s*$", ""))
    head = F.when(low.startswith(n), F.regexp_replace(F.substring(t, F.length(n) + 1, F.length(t)), r"^\s*[|·–—:»-]\s*", ""))
    cut = F.coalesce(F.when(tail != F.substring(t, F.lit(1), F.length(t) - F.length(n)), tail), F.when(head != F.substring(t, F.length(n) + 1, F.length(t)), head))
    return F.when(F.coalesce(n, F.lit("")) == "", t).otherwise(F.coalesce(F.nullif(F.trim(cut), F.lit("")), t))


def self_references(data: Column, url: Column) -> Column:
    """Whether a payload says it is about this address: by @id, url, mainEntityOfPage or og:url."""
    said = F.array(*(F.get_json_object(data, p) for p in ("$['@id']", "$.url", "$.mainEntityOfPage", "$.mainEntityOfPage['@id']", "$['og:url']")))
    key = lambda u: F.regexp_replace(F.regexp_replace(F.lower(u), r"^https?://(www\.)?", ""), r"[/#]+$", "")
    return F.coalesce(F.exists(F.filter(said, lambda x: x.isNotNull()), lambda x: key(x) == key(url)), F.lit(False))
