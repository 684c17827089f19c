"""One document for each page out of a plain and a rendered copy: what each adds, why one failed, and framesets.

Fetches are rows (page_id, url, status, error, html); nothing is fetched here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators.assemble import union_blocks

#: A page with fewer words than this in its plain copy is a shell.
SHELL_WORDS, FRAME_DEPTH, SAID = 20, 2, 140


def server_said(html: Column, limit: int = SAID) -> Column:
    """The words of an answer, tags stripped, clipped."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    said = T.fold_space(bare)
    return F.when(F.length(said) > limit, F.concat(F.substring(said, 1, limit - 1), F.lit("…"))).otherwise(said)


def static_failure(status: Column, error: Column, html: Column, words: Column) -> Column:
    """Why a plain fetch gave no page, null if it gave one."""
    said = server_said(F.coalesce(html, F.lit("")))
    return (
        F.when(error.isNotNull(), F.concat(F.lit("could not be fetched: "), error))
        .when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"), F.when(said != "", F.concat(F.lit(": "), said)).otherwise("")))
        .when(F.trim(F.coalesce(html, F.lit(""))) == "", F.lit("empty answer"))
        .when(words < SHELL_WORDS, F.lit("a script shell without readable text"))
    )


def choose(static: DataFrame, rendered: DataFrame, strategy: str = "union") -> DataFrame:
    """(page_id, strategy, error): what each page is resolved from, for (page_id, status, error, html, words) of both copies.

    union takes both where both are pages, else the one that is; static-only and rendered-only ask for one alone. Where
    neither is a page, error says why for both.
    """
    fail = lambda d, name: d.select("page_id", static_failure(F.col("status"), F.col("error"), F.col("html"), F.col("words")).alias(name), F.lit(True).alias(f"has_{name}"))
    both = fail(static, "plain").join(fail(rendered, "drawn"), "page_id", "full_outer")
    plain, drawn = F.coalesce("has_plain", F.lit(False)) & F.col("plain").isNull(), F.coalesce("has_drawn", F.lit(False)) & F.col("drawn").isNull()
    if strategy == "static-only":
        drawn = F.lit(False)
    elif strategy == "rendered-only":
        plain = F.lit(False)
    used = F.when(plain & drawn, "union").when(plain, "static-only").when(drawn, "rendered-only")
    why = F.concat_ws("; ", F.concat(F.lit("plain fetch: "), F.coalesce("plain", F.lit("not tried"))), F.concat(F.lit("browser: "), F.coalesce("drawn", F.lit("not tried"))))
    return both.select("page_id", used.alias("strategy"), F.when(used.isNull(), why).alias("error"))


def resolve(static: DataFrame, rendered: DataFrame, chosen: DataFrame) -> DataFrame:
    """Blocks of every page by its strategy, with from_static: those only the plain copy has; positions are anew."""
    of = lambda d, kind: d.join(chosen.where(F.col("strategy") == kind).select("page_id"), "page_id", "left_semi")
    columns = rendered.columns
    merged = union_blocks(of(static, "union").select(*columns), of(rendered, "union"))
    alone = of(static, "static-only").select(*columns).unionByName(of(rendered, "rendered-only")).withColumn("from_static", F.lit(False))
    return merged.unionByName(alone.select(*merged.columns))


def coverage(static: DataFrame, rendered: DataFrame, union: DataFrame) -> DataFrame:
    """(page_id, static_chars, rendered_chars, union_chars, static_coverage, rendered_coverage, render_lost_content) from
    the blocks of both copies and of their union; coverage is at most 1, and null for a page without text."""
    size = lambda d, name: d.where("kind not in ('image', 'media', 'rule')").groupBy("page_id").agg(F.sum(F.length("text")).alias(name))
    lost = union.groupBy("page_id").agg(F.coalesce(F.bool_or("from_static"), F.lit(False)).alias("render_lost_content"))
    c = lost.join(size(static, "static_chars"), "page_id", "left").join(size(rendered, "rendered_chars"), "page_id", "left").join(size(union, "union_chars"), "page_id", "left").na.fill(0, ["static_chars", "rendered_chars", "union_chars"])
    share = lambda name: F.when(F.col("union_chars") > 0, F.least(F.lit(1.0), F.col(name) / F.col("union_chars")))
    return c.select("page_id", "static_chars", "rendered_chars", "union_chars", share("static_chars").alias("static_coverage"), share("rendered_chars").alias("rendered_coverage"), "render_lost_content")


def runtime_evidence(requests: DataFrame) -> DataFrame:
    """(page_id, requests, hosts, scripts, xhr, cookies) of what a browser saw, for (page_id, url, resource, cookies)."""
    r = requests.withColumn("host", U.host(F.col("url")))
    return r.groupBy("page_id").agg(F.count("*").alias("requests"), F.sort_array(F.collect_set("host")).alias("hosts"), F.count_if(F.col("resource") == "script").alias("scripts"), F.count_if(F.col("resource").isin("xhr", "fetch")).alias("xhr"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cookies")))).alias("cookies"))


def frame_sources(pages: DataFrame) -> DataFrame:
    """(page_id, pos, src): frames of framesets in order, those of the page's own host."""
    tags = F.regexp_extract_all("html", F.lit(r"""(?is)<frame\b[^>]*?\bsrc\s*=\s*["']?([^"'\s>]+)"""), F.lit(1))
    f = pages.where(F.lower("html").contains("<frameset")).select("page_id", "url", F.posexplode(tags).alias("pos", "raw"))
    absolute = U.normalize_url(F.when(F.col("raw").rlike("^(?i)https?://"), F.col("raw")).when(F.col("raw").startswith("/"), F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+)", 1), "raw")).otherwise(F.concat(F.regexp_extract("url", r"^(https?://[^/?#]+(?:/(?:[^/?#]*/)*)?)", 1), "raw")))
    f = f.select("page_id", "url", "pos", absolute.alias("src"))
    return f.where(U.host(F.col("src")) == U.host(F.col("url"))).select("page_id", "pos", "src")


def compose_framesets(pages: DataFrame, known: DataFrame, depth: int = FRAME_DEPTH) -> DataFrame:
    """pages with each frameset replaced by its frames' documents in order, from known (url, html); frames of frames to a
    bounded depth. A frame that is not known leaves nothing; a page without known frames stays as it is."""
    bodies = known.select(U.normalize_url(F.col("url")).alias("src"), F.col("html").alias("body")).groupBy("src").agg(F.min("body").alias("body"))
    for _ in range(depth):
        parts = frame_sources(pages).join(bodies, "src").groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: F.concat(F.lit("<div>"), x["body"], F.lit("</div>"))), "\n").alias("_whole"))
        pages = pages.join(parts, "page_id", "left").withColumn("html", F.coalesce(F.concat(F.lit("<html><body>"), "_whole", F.lit("</body></html>")), "html")).drop("_whole")
    return pages


def declared_url(html: Column, url: Column) -> Column:
    """The address that a supplied page gives itself: canonical, else og:url; else the one it came with."""
    tag = lambda key, value, name: F.regexp_extract(F.regexp_extract(html, rf"""(?is)<{name}\b[^>]*\b{key}\s*=\s*["']?{value}\b[^>]*>""", 0), r"""(?is)\b(?:href|content)\s*=\s*["']?([^"'\s>]+)""", 1)
    found = F.coalesce(F.nullif(tag("rel", "canonical", "link"), F.lit("")), F.nullif(tag("property", "og:url", "meta"), F.lit("")))
    return F.coalesce(F.when(found.rlike("^(?i)https?://"), found), url)


def last_of(runs: DataFrame, by: str, at: str) -> DataFrame:
    """The newest row of each `by`."""
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at)))).where("_n = 1").drop("_n")
