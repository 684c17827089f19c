"""Sinks: graphs as JSON lines, Cypher and JSON-LD; changes as feeds and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def graph_lines(tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON line per record, each with its kind; pages come before what refers to them by the column `ord`."""
    out = None
    for i, (kind, df) in enumerate(tables.items()):
        lines = df.select(F.lit(i).alias("ord"), F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value"))
        out = lines if out is None else out.unionByName(lines)
    return out


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    graph_lines(tables).select("value").write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = (), mode: str = "errorifexists", **options: str) -> None:
    """A table in any format that Spark writes, in folders by the given columns."""
    df.write.format(kind).mode(mode).options(**({"header": "true"} if kind == "csv" else {}) | options).partitionBy(*by).save(path)


def quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher_pages(pages: DataFrame) -> DataFrame:
    return pages.select(F.concat(F.lit("MERGE (p:Page {key: "), quoted(F.col("page_key")), F.lit("}) SET p.title = "), quoted(F.coalesce("title", F.lit(""))), F.lit(";")).alias("value"))


def cypher_links(edges: DataFrame) -> DataFrame:
    s = F.concat(F.lit("MATCH (a:Page {key: "), quoted(F.col("source")), F.lit("}), (b:Page {key: "), quoted(F.col("target")), F.lit("}) MERGE (a)-[l:LINKS]->(b) SET l.count = "), F.col("count").cast("string"), F.lit(";"))
    return edges.select(s.alias("value"))


def json_ld(entities: DataFrame) -> DataFrame:
    """One JSON-LD node per entity (entity_id, type, name, evidence)."""
    node = F.to_json(F.struct(F.concat(F.lit("urn:"), "entity_id").alias("@id"), F.col("type").alias("@type"), "name", F.col("evidence").alias("prov:count")))
    return entities.select(node.alias("value"))


def xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


DETAIL = "added array<string>, removed array<string>"


def body_markdown(detail: Column) -> Column:
    """New and gone paragraphs of a change as lists; empty without detail."""
    d = F.from_json(F.coalesce(detail, F.lit("{}")), DETAIL)
    part = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(f"\n\n**{head}**\n\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    return F.concat(part("Added", d["added"]), part("Removed", d["removed"]))


def body_html(detail: Column) -> Column:
    d = F.from_json(F.coalesce(detail, F.lit("{}")), DETAIL)
    part = lambda head, items: F.when(F.size(items) > 0, F.concat(F.lit(f"<p>{head}</p><ul>"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("<li>"), xml(x), F.lit("</li>"))), ""), F.lit("</ul>"))).otherwise("")
    return F.concat(part("Added", d["added"]), part("Removed", d["removed"]))


def feed(changes: DataFrame, title: str, link: str, kind: str = "rss", most: int = 100) -> DataFrame:
    """One row, the newest changes (url, change, at, title[, detail]) as rss, atom, markdown or json text: a top-k report.

    detail is JSON of new and gone paragraphs and makes each entry's body.
    """
    if "detail" not in changes.columns:
        changes = changes.withColumn("detail", F.lit(None).cast("string"))
    rows = changes.withColumn("at", F.col("at").cast("timestamp")).orderBy(F.desc("at"), "url").limit(most)
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.concat(F.initcap("change"), F.lit(": "), F.coalesce("title", "url"))
    mark = F.sha1(F.concat_ws("|", "url", "change", stamp))
    said = body_html(F.col("detail"))
    item = {
        "rss": F.concat(F.lit("<item><title>"), xml(name), F.lit("</title><link>"), xml(F.col("url")), F.lit('</link><guid isPermaLink="false">'), mark, F.lit("</guid><pubDate>"), F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"), F.lit("</pubDate>"), F.when(said != "", F.concat(F.lit("<description>"), xml(said), F.lit("</description>"))).otherwise(""), F.lit("</item>")),
        "atom": F.concat(F.lit("<entry><title>"), xml(name), F.lit('</title><link href="'), xml(F.col("url")), F.lit('"/><id>urn:sha1:'), mark, F.lit("</id><updated>"), stamp, F.lit("</updated>"), F.when(said != "", F.concat(F.lit('<content type="html">'), xml(said), F.lit("</content>"))).otherwise(""), F.lit("</entry>")),
        "markdown": F.concat(F.lit("## "), F.initcap("change"), F.lit(": ["), F.coalesce("title", "url"), F.lit("]("), "url", F.lit(")\n\n"), stamp, body_markdown(F.col("detail"))),
        "json": F.to_json(F.struct("url", "change", stamp.alias("at"), "title", F.from_json(F.coalesce("detail", F.lit("{}")), DETAIL).alias("detail"))),
    }[kind]
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_micros(F.col("at"))).alias("o"), "url", item.alias("i")))), lambda x: x["i"]), {"json": ",\n", "markdown": "\n\n"}.get(kind, "\n"))
    newest = F.coalesce(F.date_format(F.max("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("1970-01-01T00:00:00Z"))
    plain = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    around = {
        "rss": (F.lit(f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>{plain(title)}</title><link>{plain(link)}</link><description>{plain(title)}</description>'), "</channel></rss>"),
        "atom": (F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>{plain(title)}</title><id>{plain(link)}</id><updated>'), newest, F.lit("</updated>")), "</feed>"),
        "markdown": (F.lit(f"# {title}\n\n"), "\n"),
        "json": (F.lit("["), "]"),
    }[kind]
    return rows.agg(F.concat(around[0], body, F.lit(around[1])).alias("value"))
