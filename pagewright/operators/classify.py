"""Feature tables for blocks and pages, and scoring by boosted trees given as data."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Frequent words without meaning of their own, in four languages.
STOP_WORDS = "a an and are as at be by das de der des die du el en es et für il in is it la le les los mit of on or que the to un una und une von was were with y zu".split()


def text_shape(text: Column) -> Column:
    """struct of shares of digits and punctuation of the characters that are not space, of capitals of the letters, of stop
    words of the words, and whether the text ends a sentence; shares of nothing are 0."""
    count = lambda p: F.length(text) - F.length(F.regexp_replace(text, p, ""))
    share = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    stop = F.size(F.filter(words, lambda w: w.isin(*STOP_WORDS)))
    return F.struct(share(count(r"\d"), count(r"\S")).alias("digits"), share(count(r"\p{Lu}"), count(r"\p{L}")).alias("capitals"), share(count(r"\p{Punct}"), count(r"\S")).alias("punctuation"), share(stop, F.size(words)).alias("stop_words"), text.rlike(r"[.!?…]['\")\]]*\s*$").alias("ends_sentence"))


def block_features(blocks: DataFrame) -> DataFrame:
    """Per block: its own numbers, its neighbours', and the page's."""
    order, page = Window.partitionBy("page_id").orderBy("pos"), Window.partitionBy("page_id")
    own = blocks.select("page_id", "pos", "kind", "words", "link_density", text_shape(F.col("text")).alias("shape"), F.coalesce("in_main", F.lit(False)).alias("in_main"), F.col("article").isNotNull().alias("in_article"))
    own = own.select("*", "shape.*").drop("shape").withColumn("_n", F.row_number().over(order))
    for c in ("words", "link_density", "kind"):
        own = own.withColumn(f"prev_{c}", F.lag(c).over(order)).withColumn(f"next_{c}", F.lead(c).over(order))
    total = F.sum("words").over(page)
    for c in ("digits", "capitals", "stop_words"):
        own = own.withColumn(f"prev_{c}", F.lag(c).over(order)).withColumn(f"next_{c}", F.lead(c).over(order))
    same = Window.partitionBy("page_id", "kind")
    own = own.withColumn("kind_share", F.count("*").over(same) / F.count("*").over(page)).withColumn("page_link_density", F.avg("link_density").over(page)).withColumn("page_median_words", F.percentile("words", F.lit(0.5)).over(page)).withColumn("since_heading", F.row_number().over(order) - F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("_n")), ignorenulls=True).over(order), F.lit(0)))
    return own.drop("_n").withColumn("place", F.row_number().over(order) / F.count("*").over(page)).withColumn("page_words", total).withColumn("word_share", F.col("words") / F.greatest(total, F.lit(1)))


#: Words of addresses that tell page types apart.
URL_WORDS = "about article blog book buy cart category company contact doc event faq forum guide help home job listing login news post press price product question recipe review search service shop store support tag team thread topic video wiki".split()


def page_features(parsed: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per page: counts by kind, lexical rates, markup counts, payload types and address shape."""
    kinds = blocks.groupBy("page_id").agg(
        F.sum("words").alias("words"),
        *(F.sum((F.col("kind") == k).cast("int")).alias(f"n_{k.replace('-', '_')}") for k in ("paragraph", "heading", "list-item", "table", "image", "code", "quote")),
        F.avg("link_density").alias("mean_link_density"),
        F.max("words").alias("longest"),
        F.sum(F.regexp_count("text", F.lit(r"[$€£]\s?\d"))).alias("prices"),
        F.sum(F.regexp_count("text", F.lit(r"\b(19|20)\d{2}\b"))).alias("years"),
        # The upper median by index, as a sorted array gives it.
        F.element_at(F.array_sort(F.collect_list("words")), F.floor(F.count("*") / 2).cast("int") + 1).alias("median_words"),
    )
    types = F.array_distinct(F.flatten(F.transform("payloads", lambda p: F.regexp_extract_all(p["data"], F.lit(r'"@type":\s*"([^"]+)"'), F.lit(1)))))
    low = F.lower("url")
    vocabulary = [low.rlike(rf"[/_-]{w}s?(?:[/?_.-]|$)").cast("int").alias(f"url_{w}") for w in URL_WORDS]
    head = parsed.select("page_id", "url", "stats.*", types.alias("types"), *vocabulary, F.length("url").alias("url_length"), low.contains("?").cast("int").alias("url_query"), F.regexp_count("url", F.lit(r"\d")).alias("url_digits"), low.rlike(r"/(?:19|20)\d{2}/").cast("int").alias("url_dated"), F.size("links").alias("n_links"), F.size(F.filter("links", lambda x: x["region"] == "nav")).alias("n_nav_links"), F.size("payloads").alias("n_payloads"), F.size(F.split(F.regexp_extract("url", r"^https?://[^/]+/?([^?#]*)", 1), "/")).alias("path_depth"))
    return head.join(kinds, "page_id", "left")


class Trees:
    """Sums of regression trees from JSON: {"trees": [[class, tree]], "base": [..]}; a tree is {"v": x} or {"f": feature,
    "t": threshold, "l": tree, "r": tree, "m": "l"|"r"} with the side that missing values take."""

    def __init__(self, text: str):
        spec = json.loads(text)
        if not isinstance(spec, dict) or not isinstance(spec.get("trees"), list) or not spec.get("base"):
            raise ValueError("not a tree model")
        self.base, self.trees = np.array(spec["base"], float), spec["trees"]
        for k, tree in self.trees:
            if not 0 <= k < len(self.base):
                raise ValueError(f"no class {k}")
            self._check(tree)

    def _check(self, tree: dict) -> None:
        if "v" in tree:
            return
        if not all(k in tree for k in "ftlr") or tree.get("m", "l") not in ("l", "r"):
            raise ValueError("a node needs feature, threshold and two sides")
        self._check(tree["l"])
        self._check(tree["r"])

    def _value(self, tree: dict, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if "v" in tree:
            out[rows] += tree["v"]
            return
        v = x[rows, tree["f"]]
        left = np.where(np.isnan(v), tree.get("m", "l") == "l", v < tree["t"])
        self._value(tree["l"], x, rows[left], out)
        self._value(tree["r"], x, rows[~left], out)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(x), 1))
        for k, tree in self.trees:
            self._value(tree, x, np.arange(len(x)), out[:, k])
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Logistic for one output, softmax for several."""
        raw = self.raw(x)
        if raw.shape[1] == 1:
            p = 1 / (1 + np.exp(-raw))
            return np.concatenate([1 - p, p], 1)
        e = np.exp(raw - raw.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def score(features: DataFrame, columns: list[str], model: str, classes: list[str], floor: float = 0.5) -> DataFrame:
    """features with `label` (unknown under the floor), `confidence` and `runner_up`."""

    def run(frames):
        trees = Trees(model)
        for f in frames:
            p = trees.probabilities(f[columns].to_numpy(float))
            order = np.argsort(-p, axis=1, kind="stable")
            best = p[np.arange(len(p)), order[:, 0]]
            yield f.assign(label=[classes[i] if c >= floor else "unknown" for i, c in zip(order[:, 0], best, strict=True)], confidence=best, runner_up=[classes[i] for i in order[:, 1]])

    return features.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in features.schema) + ", label string, confidence double, runner_up string")


def explain(x: pd.DataFrame, model: str, row: int, top: int = 4) -> list[tuple[str, float]]:
    """Features whose absence lowers the chosen class most, for one row."""
    trees, a = Trees(model), x.to_numpy(float)[[row]]
    whole = trees.probabilities(a)[0]
    chosen = int(whole.argmax())
    drops = []
    for i, name in enumerate(x.columns):
        b = a.copy()
        b[0, i] = np.nan
        drops.append((name, float(whole[chosen] - trees.probabilities(b)[0][chosen])))
    return sorted(drops, key=lambda d: (-d[1], d[0]))[:top]


def select_by_model(blocks: DataFrame, features: DataFrame, columns: list[str], model: str, threshold: float = 0.5, least: float = 0.02) -> DataFrame:
    """blocks that a one-output model holds for content; pages where that would leave fewer than `least` of their words
    stay whole."""
    p = score(features, columns, model, ["other", "content"], 0.0)
    p = p.select("page_id", "pos", F.when(F.col("label") == "content", F.col("confidence")).otherwise(1 - F.col("confidence")).alias("_p"))
    page = Window.partitionBy("page_id")
    b = blocks.join(p, ["page_id", "pos"], "left").withColumn("_keep", F.coalesce(F.col("_p") >= threshold, F.lit(False)))
    share = F.sum(F.when(F.col("_keep"), F.col("words")).otherwise(0)).over(page) / F.greatest(F.sum("words").over(page), F.lit(1))
    return b.withColumn("_share", share).where(F.col("_keep") | (F.col("_share") < least)).select(*blocks.columns)


def platform_page_type(html: Column) -> Column:
    """What a wiki's own classes say: ns-0 pages are articles, ns-14 pages lists; null elsewhere."""
    body = F.regexp_extract(html, r"(?is)<body\b[^>]*\bclass\s*=\s*[\"']([^\"']*)", 1)
    wiki = F.lower(html).contains("mediawiki")
    has = lambda c: F.array_contains(F.split(body, r"\s+"), c)
    return F.when(wiki & has("ns-0"), "article").when(wiki & has("ns-14"), "listing")


def route(scored: DataFrame, platform: DataFrame, least: float = 0.9) -> DataFrame:
    """scored pages (label, confidence, runner_up) with a platform's own word (page_id, page_type) in place of the model's,
    unless the model is surer than `least` of another."""
    j = scored.join(platform.where("page_type is not null"), "page_id", "left")
    ours = F.col("page_type").isNotNull() & ~((F.col("label") != F.col("page_type")) & (F.col("confidence") >= least))
    return j.withColumn("runner_up", F.when(ours & (F.col("label") != F.col("page_type")), F.col("label")).otherwise(F.col("runner_up"))).withColumn("label", F.when(ours, F.col("page_type")).otherwise(F.col("label"))).drop("page_type")


def payload_types(parsed: DataFrame) -> DataFrame:
    """(page_id, types): all @type names and og:type of a page, distinct, in order of name."""
    names = F.flatten(F.transform("payloads", lambda p: F.concat(F.regexp_extract_all(p["data"], F.lit(r'"@type":\s*(?:\[\s*)?"([^"]+)"'), F.lit(1)), F.regexp_extract_all(p["data"], F.lit(r'"og:type":\s*"([^"]+)"'), F.lit(1)))))
    return parsed.select("page_id", F.sort_array(F.array_distinct(F.transform(names, lambda t: F.regexp_extract(t, r"([^/#]+)$", 1)))).alias("types"))
