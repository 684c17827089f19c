"""Graph, retrieval and change queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.catalog import Tables, query
from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators import classify, parse, site
from pagewright.plans.pages import SQL_URL
from pagewright.sources import sinks
from pagewright.storage import staged

TERMS = "the and est"
SQL_BM25 = """tok AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[A-Za-z0-9][A-Za-z0-9''_-]*') AS w FROM documents),
    len AS (SELECT id, len(w) AS len FROM tok), tot AS (SELECT count(*) AS n, avg(len) AS avg_len FROM len),
    tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM tok) WHERE term IN ('the', 'and', 'est') GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    ranked AS (SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))), 6) AS score FROM tf JOIN df USING (term) JOIN len USING (id), tot GROUP BY id)"""


@query(f"WITH {SQL_BM25} SELECT id, score FROM ranked")
def bm25_scores(t: Tables) -> DataFrame:
    """2.17.2, 2.17.3."""
    return site.bm25(t.documents, "doc_id", F.col("text"), TERMS)


@query(f"WITH {SQL_BM25} SELECT id, score FROM ranked ORDER BY score DESC, id LIMIT 20")
def bm25_top(t: Tables) -> DataFrame:
    return bm25_scores(t).orderBy(F.desc("score"), "id").limit(20)


@query(f"""WITH {SQL_BM25}, p AS (SELECT source AS page, id, score FROM ranked JOIN documents ON id = doc_id), s AS (SELECT page, sum(score) AS total FROM p GROUP BY page)
    SELECT page, id, round(score * (1 + 0.5 * total / (SELECT max(total) FROM s)), 4) AS score FROM p JOIN s USING (page)""")
def page_evidence_scores(t: Tables) -> DataFrame:
    """2.17.5."""
    ranked = staged(bm25_scores(t).join(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("page")), "id"), "ranked")
    return site.page_evidence(ranked, 0.5).select("page", "id", F.round("score", 4).alias("score"))


SQL_EDGES = f"""{SQL_URL}, a AS (SELECT u.page_id, regexp_replace(u.key, '^https?://', '') AS source, u.h, unnest(regexp_extract_all(pg.html, '<a href="([^"]*)"', 1)) AS raw FROM u JOIN pages pg USING (page_id)),
    e AS (SELECT page_id, source, regexp_replace(h, '^www\\.', '') || rtrim(raw, '/') AS target FROM a WHERE raw LIKE '/%')"""


def edges_of(t: Tables) -> DataFrame:
    return site.page_links(parse.links_of(t.parsed))


@query(f"WITH {SQL_EDGES} SELECT source, target, count(*) AS count FROM e WHERE source <> target GROUP BY ALL")
def link_edges(t: Tables) -> DataFrame:
    """2.16.9."""
    return edges_of(t).select("source", "target", "count")


@query(f"WITH {SQL_EDGES}, d AS (SELECT target, count(DISTINCT source) AS in_degree FROM e WHERE source <> target GROUP BY target) SELECT target, in_degree, round(CASE WHEN in_degree >= n THEN 0 ELSE ln(n / in_degree) / ln(n + 1.0) END, 9) AS specificity FROM d, (SELECT CAST(count(DISTINCT source) AS DOUBLE) AS n FROM (SELECT regexp_replace(key, '^https?://', '') AS source FROM u))")
def link_specificity(t: Tables) -> DataFrame:
    """2.16.16."""
    pages = t.pages.select(U.page_key(F.col("url"))).distinct().count()
    return site.specificity(edges_of(t), pages).withColumn("specificity", F.round("specificity", 9))


@query()
def page_sections(t: Tables) -> DataFrame:
    """2.16.1, 2.16.2: sections in pieces."""
    cut = site.pieces(site.sections(parse.blocks_of(parse.parse_pages(t.pages))))
    return cut.select("page_id", "section", "piece", "heading", "level", "parent", F.length("text").alias("chars"))


@query(f"""WITH {SQL_EDGES}, w AS (SELECT source, target, CAST(count(*) AS DOUBLE) AS w FROM e WHERE source <> target GROUP BY ALL), m AS (SELECT source, sum(w) AS mass FROM w GROUP BY source),
    s AS (SELECT source, target, w / mass AS share FROM w JOIN m USING (source)), seeds AS (SELECT DISTINCT source AS id, 1.0::DOUBLE AS score FROM w),
    g1 AS (SELECT s.target AS id, sum(score * share * 0.45) AS score FROM seeds JOIN s ON s.source = id GROUP BY s.target), f1 AS (SELECT * FROM g1 ANTI JOIN seeds USING (id)),
    g2 AS (SELECT s.target AS id, sum(score * share * 0.45 * 0.45) AS score FROM f1 JOIN s ON s.source = f1.id GROUP BY s.target)
    SELECT id, round(sum(score), 6) AS score FROM (SELECT * FROM seeds UNION ALL SELECT * FROM g1 UNION ALL SELECT * FROM g2) GROUP BY id""")
def graph_expansion(t: Tables) -> DataFrame:
    """2.17.6: two hops from every page that has links."""
    e = edges_of(t).select("source", "target", F.col("count").cast("double").alias("weight"))
    seeds = e.select(F.col("source").alias("id")).distinct().select("id", F.lit(1.0).alias("score"))
    return site.expand(seeds, e).select("id", F.round("score", 6).alias("score"))


@query("""SELECT coalesce(b.o_orderkey, a.o_orderkey) AS key, CASE WHEN b.o_orderkey IS NULL THEN 'added' WHEN a.o_orderkey IS NULL THEN 'removed' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS change
    FROM (SELECT o_orderkey, sha256(o_orderpriority) AS h FROM orders WHERE o_orderstatus <> 'P') b FULL OUTER JOIN (SELECT o_orderkey, sha256(CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderpriority END) AS h FROM orders WHERE o_orderpriority <> '5-LOW') a ON a.o_orderkey = b.o_orderkey""")
def snapshot_diff(t: Tables) -> DataFrame:
    """2.18.1: the settled orders before, the urgent ones after, dear ones changed."""
    o = t.orders.withColumnRenamed("o_orderkey", "key")
    before = o.where("o_orderstatus <> 'P'").select("key", F.sha2("o_orderpriority", 256).alias("content_hash"))
    after = o.where("o_orderpriority <> '5-LOW'").select("key", F.sha2(F.when(F.col("o_totalprice") > 200000, "X").otherwise(F.col("o_orderpriority")), 256).alias("content_hash"))
    return site.diff_pages(before, after)


@query("""WITH b AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations),
    a AS (SELECT conv_id, turn, role, CASE WHEN length(text) > 300 THEN text || ' more' ELSE text END AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE length(text) < 900)
    SELECT coalesce(b.conv_id, a.conv_id) AS key, coalesce(b.role, a.role) AS heading, CAST(coalesce(b.n, a.n) AS INTEGER) AS occurrence, CASE WHEN b.text IS NULL THEN 'added' WHEN a.text IS NULL THEN 'removed' ELSE 'edited' END AS change
    FROM b FULL OUTER JOIN a ON a.conv_id = b.conv_id AND a.role = b.role AND a.n = b.n WHERE trim(regexp_replace(a.text, '\\s+', ' ', 'g')) IS DISTINCT FROM trim(regexp_replace(b.text, '\\s+', ' ', 'g'))""")
def section_diff(t: Tables) -> DataFrame:
    """2.18.2: conversations as pages, roles as headings; very long turns are gone, long ones edited."""
    c = t.conversations.select(F.col("conv_id").alias("key"), F.col("turn").alias("section"), F.col("role").alias("heading"), "text")
    after = c.where(F.length("text") < 900).withColumn("text", F.when(F.length("text") > 300, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    return site.diff_sections(c, after)


@query("""SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 5 = 1 THEN 'added' WHEN doc_id % 5 = 2 THEN NULL WHEN doc_id % 5 = 3 THEN 'suppressed' ELSE 'changed' END AS verdict FROM documents""")
def watch_runs(t: Tables) -> DataFrame:
    """2.18.4, 2.18.10, 2.18.11: every document gone, new, failed, changed by a date line alone, or changed, by turns."""
    n = F.col("doc_id") % 5
    before = t.documents.select(F.col("doc_id").alias("key"), F.when(n == 1, 500).otherwise(200).alias("status"), F.sha2("text", 256).alias("content_hash"), "text")
    text = F.concat("text", F.when(n == 4, "\n\nan entirely new paragraph").otherwise("\n\nLast updated on 12 March 2024"))
    after = t.documents.select(F.col("doc_id").alias("key"), F.when(n == 0, 404).when(n == 2, 503).otherwise(200).alias("status"), F.sha2(text, 256).alias("content_hash"), text.alias("text"))
    return site.watch_verdicts(before, after)


@query("""WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, len(list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '')) AS words FROM documents)
    SELECT doc_id AS page_id, CASE WHEN words < 20 AND contains(lower(text), 'g-recaptcha') THEN 'challenge: recaptcha' WHEN length(text) <= 1500 AND contains(lower(text), 'access denied') THEN 'block page: access denied' END AS wall FROM documents JOIN t USING (doc_id)""")
def document_walls(t: Tables) -> DataFrame:
    """2.3.26-2.3.30: documents as answers of a server."""
    from pagewright.operators import walls

    d = t.documents.select(F.col("doc_id").alias("page_id"), F.lit(200).alias("status"), F.col("text").alias("html"), "text", F.lit("https://e.com/").alias("requested"), F.lit("https://e.com/").alias("url"), T.word_count(F.col("text")).alias("words"))
    return walls.walls(d)


@query("""WITH l AS (SELECT doc_id AS key, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    f AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY n) % 2 = 1 AS fenced FROM l),
    h AS (SELECT *, NOT fenced AND regexp_matches(line, '^#{1,6}\\s+\\S') AS head FROM f),
    s AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY n) AS section FROM h),
    g AS (SELECT key, section, bool_or(head) AS named, trim(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT head), ''), '\\s+', ' ', 'g')) AS body FROM s GROUP BY key, section)
    SELECT key, count(*) AS sections, CAST(sum(CASE WHEN named THEN 1 ELSE 0 END) AS BIGINT) AS headed, CAST(sum(length(body)) AS BIGINT) AS chars FROM g WHERE named OR body <> '' GROUP BY key""")
def markdown_sections(t: Tables) -> DataFrame:
    """2.18.12: sections of every document, with and without headings."""
    s = site.sections_from_markdown(t.documents.select(F.col("doc_id").alias("key"), F.col("text").alias("markdown")))
    return s.groupBy("key").agg(F.count("*").alias("sections"), F.sum((F.col("heading") != "").cast("long")).alias("headed"), F.sum(F.length(T.fold_space(F.col("text")))).cast("long").alias("chars"))


@query(f"""WITH c AS (SELECT conv_id, turn, text, length(regexp_replace(text, '\\s', '', 'g')) AS solid, length(regexp_replace(text, '\\P{{L}}', '', 'g')) AS letters, list_filter(string_split_regex(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '') AS words FROM conversations)
    SELECT conv_id, turn, round(coalesce(length(regexp_replace(text, '[^0-9]', '', 'g')) / nullif(solid, 0), 0), 9) AS digits, round(coalesce(length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) / nullif(letters, 0), 0), 9) AS capitals,
           round(coalesce(len(list_filter(words, lambda w: list_contains([{", ".join(f"'{w}'" for w in classify.STOP_WORDS)}], w))) / nullif(len(words), 0), 0), 9) AS stop_words,
           regexp_matches(text, '[.!?…][''")\\]]*\\s*$') AS ends_sentence, CAST(turn AS DOUBLE) / max(turn) OVER (PARTITION BY conv_id) AS place FROM c""")
def text_shapes(t: Tables) -> DataFrame:
    """2.11.2."""
    from pyspark.sql import Window

    shape = classify.text_shape(F.col("text"))
    return t.conversations.select("conv_id", "turn", *(F.round(shape[c], 9).alias(c) for c in ("digits", "capitals", "stop_words")), shape["ends_sentence"].alias("ends_sentence"), (F.col("turn") / F.max("turn").over(Window.partitionBy("conv_id"))).alias("place"))


@query()
def page_feature_table(t: Tables) -> DataFrame:
    """2.11.1, 2.11.6."""
    parsed = t.parsed
    return classify.page_features(parsed, parse.blocks_of(parsed))


@query()
def repeated_siblings(t: Tables) -> DataFrame:
    """2.9.17."""
    from pagewright.operators.assemble import repeat_groups

    return repeat_groups(parse.blocks_of(parse.parse_pages(t.pages)), share=0.1)


@query(f"WITH {SQL_URL}, k AS (SELECT DISTINCT regexp_replace(key, '^https?://', '') AS page_key FROM u) SELECT a.page_key, max_by(b.page_key, length(rtrim(b.page_key, '/'))) AS parent FROM k a LEFT JOIN k b ON a.page_key <> b.page_key AND starts_with(a.page_key, rtrim(b.page_key, '/') || '/') GROUP BY a.page_key")
def parent_pages(t: Tables) -> DataFrame:
    """2.16.18."""
    return site.parent_paths(t.pages.select(U.page_key(F.col("url")).alias("page_key")))


@query(f"WITH {SQL_EDGES}, g AS (SELECT source, target, count(*) AS n FROM e WHERE source <> target GROUP BY ALL) SELECT 'MATCH (a:Page {{key: ''' || source || '''}}), (b:Page {{key: ''' || target || '''}}) MERGE (a)-[l:LINKS]->(b) SET l.count = ' || n || ';' AS value FROM g")
def graph_cypher(t: Tables) -> DataFrame:
    """2.2.3."""
    return sinks.cypher_links(edges_of(t))


@query("""WITH n AS (SELECT 'http://e.example/' || event_id AS url, ts, event_type FROM events ORDER BY ts DESC, url LIMIT 100)
    SELECT '# Changes' || chr(10) || chr(10) || string_agg('## Changed: [' || event_type || '](' || url || ')' || chr(10) || chr(10) || strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), chr(10) || chr(10) ORDER BY ts DESC, url) || chr(10) AS value FROM n""")
def change_feed(t: Tables) -> DataFrame:
    """2.2.14-2.2.17: the newest changes as a feed, a top-k report."""
    c = t.events.select(F.concat(F.lit("http://e.example/"), F.col("event_id").cast("string")).alias("url"), F.lit("changed").alias("change"), F.col("ts").alias("at"), F.col("event_type").alias("title"))
    return sinks.feed(c, "Changes", "http://e.example/", "markdown")
