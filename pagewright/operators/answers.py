"""Answers from the knowledge graph: weighted-field search, evidence candidates, selection, citations, exports."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.knowledge import EVIDENCE, REACHED_SHARE
from pagewright.operators.site import B, K1


def field_search(rows: DataFrame, id_col: str, fields: dict[str, float], question: str, limit: int) -> DataFrame:
    """(id, score): BM25 over several text fields, a field's matches weighed by its factor; terms are joined by OR."""
    terms = sorted({t for t in re.findall(r"[a-z0-9]+", question.lower()) if len(t) > 1})
    tokens = [T.tokenize(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    length = sum((F.size(t) for t in tokens[1:]), F.size(tokens[0]))
    hits = lambda t, q: F.size(F.filter(t, lambda x: x == q))
    weighted = [(t, w) for t, w in zip(tokens, fields.values(), strict=True)]
    tf = [sum((w * hits(t, q) for t, w in weighted[1:]), weighted[0][1] * hits(weighted[0][0], q)).alias(f"t{i}") for i, q in enumerate(terms)]
    counted = rows.select(F.col(id_col).alias("id"), length.alias("len"), *tf)
    totals = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *(F.sum((F.col(f"t{i}") > 0).cast("int")).alias(f"d{i}") for i in range(len(terms))))
    scored = counted.crossJoin(F.broadcast(totals))  # one row
    part = lambda i: F.greatest(F.ln((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)), F.lit(1e-6)) * F.col(f"t{i}") * (K1 + 1) / (F.col(f"t{i}") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg"), F.lit(1.0))))
    total = sum((part(i) for i in range(1, len(terms))), part(0)) if terms else F.lit(0.0)
    return scored.select("id", total.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(limit)


def candidates(scores: DataFrame, mentions: DataFrame, relations: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """(evidence_id, score, reached): evidence of scored entities and relations; of each item the first two rows, and each
    piece of evidence once at its best.

    scores is (entity_id, score, hop), mentions (entity_id, evidence_id), relations (subject_id, object_id, evidence_id).
    """
    two = lambda df, by: df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("evidence_id"))).where("_n <= 2").drop("_n")
    m = two(mentions, ["entity_id"]).join(scores, "entity_id").select("evidence_id", (F.col("score") * 0.8).alias("score"), (F.col("hop") > 0).alias("reached"))
    s = scores.select(F.col("entity_id").alias("subject_id"), F.col("score").alias("_s"), F.col("hop").alias("_h"))
    o = scores.select(F.col("entity_id").alias("object_id"), F.col("score").alias("_o"))
    r = two(relations, ["subject_id", "object_id"]).join(s, "subject_id").join(o, "object_id").select("evidence_id", (F.col("_s") + F.col("_o")).alias("score"), (F.col("_h") > 0).alias("reached"))
    every = m.unionByName(r)
    if attributes is not None:
        every = every.unionByName(two(attributes, ["entity_id"]).join(scores, "entity_id").select("evidence_id", (F.col("score") * 1.2).alias("score"), (F.col("hop") > 0).alias("reached")))
    return every.groupBy("evidence_id").agg(F.max("score").alias("score"), F.max_by("reached", "score").alias("reached"))


def select_evidence(found: DataFrame, limit: int = EVIDENCE, share: float = REACHED_SHARE) -> DataFrame:
    """The best evidence, with a share kept for what the graph reached; numbered citations from 1."""
    kept = math.floor(limit * share)
    reached = found.where("reached").orderBy(F.desc("score"), "evidence_id").limit(kept)
    rest = found.join(reached.select("evidence_id"), "evidence_id", "left_anti").orderBy(F.desc("score"), "evidence_id").limit(limit)
    r = reached.withColumn("_p", F.lit(0)).unionByName(rest.withColumn("_p", F.lit(1))).orderBy("_p", F.desc("score"), "evidence_id").limit(limit)
    return r.select("evidence_id", "score", "reached").withColumn("citation", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "evidence_id")))  # at most `limit` rows


def parse_answer(text: str, known: set[int]) -> dict:
    """Sentences with their citations; those without a known citation are unsupported, and an answer without any abstains."""
    sentences = []
    for part in re.findall(r"[^.!?]*[.!?]+(?:\s*\[\d+\])*|[^.!?]+$", text.strip()):
        cited = [int(n) for n in re.findall(r"\[(\d+)\]", part) if int(n) in known]
        plain = re.sub(r"\s*\[\d+\]", "", part).strip()
        if plain:
            sentences.append({"text": plain, "citations": cited, "supported": bool(cited)})
    return {"sentences": sentences, "unsupported": sum(not s["supported"] for s in sentences), "abstained": not any(s["supported"] for s in sentences)}


def extractive(question: str, evidence: list[tuple[int, str]], most: int = 3) -> str:
    """An answer without a model: the evidence lines that share most words with the question, cited."""
    asked = set(re.findall(r"\w+", question.lower()))
    best = sorted(((-len(asked & set(re.findall(r"\w+", t.lower()))), n, t) for n, t in evidence))[:most]
    return " ".join(f"{t.strip().rstrip('.')}. [{n}]" for s, n, t in best if s < 0)


def rouge_l(found: str, wanted: str) -> tuple[float, float, float]:
    """ROUGE-LSum precision, recall and F1: union of longest common subsequences, sentence by sentence."""
    words = lambda s: re.findall(r"[a-z0-9]+", s.lower())
    mine, theirs = [words(s) for s in found.split("\n")], [words(s) for s in wanted.split("\n")]
    hits, left = 0, {}
    for w in (w for s in mine for w in s):
        left[w] = left.get(w, 0) + 1
    for ref in theirs:
        union: set[int] = set()
        for cand in mine:
            table = [[0] * (len(cand) + 1) for _ in range(len(ref) + 1)]
            for i, a in enumerate(ref):
                for j, b in enumerate(cand):
                    table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
            i, j = len(ref), len(cand)
            while i and j:
                if ref[i - 1] == cand[j - 1]:
                    union.add(i - 1)
                    i, j = i - 1, j - 1
                elif table[i - 1][j] >= table[i][j - 1]:
                    i -= 1
                else:
                    j -= 1
        for i in union:
            if left.get(ref[i], 0) > 0:
                left[ref[i]] -= 1
                hits += 1
    p, r = hits / max(1, sum(map(len, mine))), hits / max(1, sum(map(len, theirs)))
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def citation_precision(cited: DataFrame, gold: DataFrame) -> DataFrame:
    """(question_id, page_precision, block_precision) of citations (question_id, page, block) against gold ones."""
    pages = gold.select("question_id", "page").distinct().withColumn("_p", F.lit(1))
    blocks = gold.select("question_id", "page", "block").distinct().withColumn("_b", F.lit(1))
    j = cited.join(pages, ["question_id", "page"], "left").join(blocks, ["question_id", "page", "block"], "left")
    return j.groupBy("question_id").agg(F.avg(F.coalesce("_p", F.lit(0))).alias("page_precision"), F.avg(F.coalesce("_b", F.lit(0))).alias("block_precision"))


def json_ld_graph(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """One JSON-LD node per entity with its evidence as web annotations (page, span)."""
    selector = F.struct(F.col("page_id").alias("source"), F.struct(F.lit("TextPositionSelector").alias("type"), "start", "end").alias("selector"))
    few = Window.partitionBy("entity_id").orderBy("page_id", "pos", "start")
    kept = mentions.withColumn("_n", F.row_number().over(few)).where("_n <= 20")
    e = kept.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("page_id", "pos", "start", selector.alias("target")))).alias("ev"))
    node = F.to_json(F.struct(F.concat(F.lit("urn:"), "entity_id").alias("@id"), F.col("type").alias("@type"), "name", F.transform("ev", lambda x: x["target"]).alias("prov:wasDerivedFrom")))
    return entities.join(e, "entity_id").select(node.alias("value"))


def batches(rows: DataFrame, by: str, size: int) -> DataFrame:
    """Rows in numbered batches for a writer: about `size` rows each, dealt by hash, so no global order is needed."""
    slot = F.pmod(F.xxhash64(by), F.lit(64))
    counts = rows.groupBy(slot.alias("_slot")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("_n"))  # 64 rows
    dealt = rows.withColumn("_slot", slot).join(F.broadcast(counts), "_slot")
    return dealt.withColumn("batch", F.col("_slot") * 1_000_000 + F.pmod(F.xxhash64(by, F.lit(1)), F.col("_n"))).drop("_slot", "_n")


def is_answer(found: Column, wanted: Column, kind: Column) -> Column:
    """Typed agreement of an answer: numbers by value, dates by day, else folded text that holds the other."""
    number = lambda c: T.to_number(F.regexp_extract(c, r"(-?\d[\d., ]*\d|\d)", 1))
    folded = lambda c: F.lower(T.fold_space(c))
    day = lambda c: F.coalesce(F.try_to_date(c), F.try_to_date(c, "d MMMM yyyy"))
    return F.coalesce(F.when(kind == "number", F.abs(number(found) - number(wanted)) <= 1e-6 * F.greatest(F.abs(number(wanted)), F.lit(1.0))).when(kind == "date", day(found) == day(wanted)).otherwise(folded(found).contains(folded(wanted))), F.lit(False))
