"""Pages to typed rows: one Arrow pass reads each page once, everything after it is relational."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions import html as H
from pagewright.functions import text as T
from pagewright.storage import staged

BLOCK = pa.struct(
    [("pos", pa.int32()), ("text", pa.string()), ("rich_text", pa.string()), ("tag", pa.string()), ("xpath", pa.string()), ("dom_index", pa.int32()), ("depth", pa.int32()), ("kind", pa.string()), ("level", pa.int32())]
    + [("ordered", pa.bool_()), ("href", pa.string()), ("alt", pa.string()), ("link", pa.string()), ("language", pa.string()), ("rows", pa.list_(pa.list_(pa.string()))), ("rich_rows", pa.list_(pa.list_(pa.string()))), ("table_html", pa.string()), ("region", pa.string()), ("widget", pa.string())]
    + [("quoted", pa.int32()), ("in_main", pa.bool_()), ("article", pa.string()), ("body_of", pa.string()), ("float_of", pa.string()), ("templated", pa.string()), ("aside", pa.string())]
)
LINK = pa.struct([("pos", pa.int32()), ("raw", pa.string()), ("href", pa.string()), ("anchor", pa.string()), ("region", pa.string())])
PAYLOAD = pa.struct([("seq", pa.int32()), ("source", pa.string()), ("data", pa.string())])
STATS = pa.struct([(k, pa.bool_() if k == "rel_next" else pa.int32()) for k in ("elements", "class_tokens", "itemprops", "rel_next", "scripts", "images", "anchors", "hidden_words")])
HIDDEN = pa.struct([("kind", pa.string()), ("words", pa.int32())])
HIDDEN_LINK = pa.struct([("href", pa.string()), ("kind", pa.string())])
FIELDS = [("error", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("rtl", pa.bool_()), ("blocks", pa.list_(BLOCK)), ("links", pa.list_(LINK)), ("payloads", pa.list_(PAYLOAD)), ("stats", STATS), ("hidden", pa.list_(HIDDEN)), ("hidden_links", pa.list_(HIDDEN_LINK))]


def read_page(html: str | None, url: str | None) -> dict:
    """Everything a page holds; one that cannot be read gives its error alone and harms no other."""
    try:
        root, words, hidden_links = H.read(html)
        base = url or ""
        blocks = H.Blocks(root, base).out
        for i, b in enumerate(blocks):
            b["pos"] = i
        meta = H.metadata(root, base)
        return {"error": None, "meta": list(meta.items()), "rtl": H.is_rtl(root), "blocks": blocks, "links": H.links(root, base), "payloads": H.payloads(root, html, meta), "stats": H.stats(root) | {"hidden_words": sum(words.values())}, "hidden": [{"kind": k, "words": n} for k, n in sorted(words.items())], "hidden_links": [x | {"href": H.absolute(x["href"], base)} for x in hidden_links]}
    except Exception as e:  # whatever a page of the web provokes
        return {"error": str(e) or type(e).__name__, "meta": [], "rtl": False, "blocks": [], "links": [], "payloads": [], "stats": None, "hidden": [], "hidden_links": []}


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_struct(kind):
        return "struct<" + ",".join(f"{f.name}:{_ddl(f.type)}" for f in kind) + ">"
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    if pa.types.is_map(kind):
        return "map<string,string>"
    return {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}[kind]


def parse_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, error, meta, rtl, blocks, links, payloads, stats); a page that cannot be read has its error."""

    def run(batches):
        for batch in batches:
            ids, urls, pages_ = (batch.column(i) for i in range(3))
            for s in range(0, batch.num_rows, 256):
                rows = [read_page(h, u) for h, u in zip(pages_.slice(s, 256).to_pylist(), urls.slice(s, 256).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(s, 256), urls.slice(s, 256), *(pa.array([r[k] for r in rows], t) for k, t in FIELDS)], ["page_id", "url", *(k for k, _ in FIELDS)])

    schema = "page_id long, url string, " + ", ".join(f"{k} {_ddl(t)}" for k, t in FIELDS)
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, schema)


def staged_pages(pages: DataFrame) -> DataFrame:
    """parse_pages, written to the shared folder: plans that use blocks, links and payloads read columns, not pages."""
    return staged(parse_pages(pages), "pages")


def blocks_of(parsed: DataFrame) -> DataFrame:
    """One row per block with its word count, key and link density."""
    b = parsed.select("page_id", "url", F.inline("blocks"))
    linked = F.aggregate(F.regexp_extract_all("rich_text", F.lit(r"\[([^\]]*)\]\([^)]*\)"), F.lit(1)), F.lit(0), lambda n, t: n + T.word_count(t))
    b = b.withColumn("words", T.word_count(F.col("text"))).withColumn("key", T.block_key(F.col("text")))
    return b.withColumn("link_density", F.when(F.col("words") > 0, F.least(F.lit(1.0), linked / F.col("words"))).otherwise(0.0))


def links_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "url", F.inline("links"))


def payloads_of(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "url", F.inline("payloads"))
