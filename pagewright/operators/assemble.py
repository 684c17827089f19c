"""Page assembly: duplicates within a page, restated wholes, page text and hash, cross-page chrome, content selection.

All of it works on a table of blocks (page_id, pos, ...), by windows and joins on the page; a page's blocks are bounded by
the parser's size limit, a site's pages are not, so site-wide steps aggregate before they join. Where blocks lie in the
tasks of by_page, no step on pages shuffles them again, and no task holds more of them as a table grows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import restate
from pagewright.functions import text as T
from pagewright.functions import urls as U
from pagewright.operators.parse import blocks_of
from pagewright.storage import staged

# Fixed values of the selection rules.
CHROME_SHARE, CHROME_PAGES, CHROME_KEPT, SLOT_SHARE = 0.9, 6, 0.5, 0.6
LANDMARK_CHARS, MAIN_WORDS, MAIN_SHARE = 200, 100, 0.2
ARTICLE_WORDS, ARTICLE_SHARE, ARTICLE_LEAD = 100, 0.15, 3.0
COST_RATIO, COST_LEAST, COST_MOST, COST_CAP, RUN_SHARE = 0.6, 5.0, 18.0, 400, 0.02
RESTATED_WORDS, RESTATED_SHARE, RESTATED_SINGLE = 150, 0.7, 0.5
#: Blocks, and characters of their texts, that one task holds on average.
TASK_BLOCKS, TASK_CHARS = 20_000, 8_000_000
#: Rows of a short key up to which a table may be broadcast.
FEW = 200_000


def of_page():
    return Window.partitionBy("page_id")


def in_order():
    return of_page().orderBy("pos")


def tasks_of(parsed: DataFrame) -> int:
    """How many tasks hold the blocks of parsed pages: by their number and size, whatever the deployment's partitions are."""
    chars = F.aggregate("blocks.text", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.length(t), F.lit(0)))
    blocks, chars = parsed.agg(F.coalesce(F.sum(F.size("blocks.text")), F.lit(0)), F.coalesce(F.sum(chars), F.lit(0))).first()
    return max(blocks // TASK_BLOCKS, chars // TASK_CHARS) + 1


def by_page(rows: DataFrame, tasks: int) -> DataFrame:
    """rows in so many tasks, each page whole in one of them; AQE leaves the number as it is."""
    return rows.repartition(tasks, "page_id")


def link_targets() -> Column:
    """Addresses that a block links to, distinct."""
    return F.array_distinct(F.regexp_extract_all("rich_text", F.lit(r"\]\(([^()\s]*)\)"), F.lit(1)))


def outranks() -> Column:
    """How strongly a copy stands for its equals: headings and blocks in main before others."""
    return (F.col("kind") == "heading").cast("int") + F.col("in_main").cast("int")


def dedup_blocks(blocks: DataFrame) -> DataFrame:
    """One block of equal (key, href) on a page stays: a heading or one in main before others, then the first.

    Blocks without text stay. A linked block after an unlinked one of the same text stays, too (a link is not its label).
    Repeated tables and code stay, unless their first copy or another repeat of the same precedes at once.
    """
    same = Window.partitionBy("page_id", "key", F.coalesce("href", F.lit(""))).orderBy(outranks().desc(), "pos")
    before = F.lag("key").over(in_order())
    solid = F.col("kind").isin("table", "code") & (~before.eqNullSafe(F.col("key")))
    return blocks.withColumn("_copy", F.row_number().over(same)).withColumn("_solid", solid).where((F.col("_copy") == 1) | (F.col("key") == "") | F.col("_solid")).drop("_copy", "_solid")


def dedup_drawn(blocks: DataFrame) -> DataFrame:
    """dedup_blocks for blocks with a rect struct<x,y,width,height>: copies drawn at different places are both on the page;
    of a drawn and an undrawn copy the drawn one stays."""
    place = F.when(F.col("rect").isNotNull(), F.concat_ws(",", F.round("rect.x"), F.round("rect.y")))
    b = blocks.withColumn("_place", place).withColumn("_drawn", F.max(F.col("rect").isNotNull().cast("int")).over(Window.partitionBy("page_id", "key", F.coalesce("href", F.lit("")))))
    b = b.where((F.col("key") == "") | (F.col("_drawn") == 0) | F.col("rect").isNotNull())
    same = Window.partitionBy("page_id", "key", F.coalesce("href", F.lit("")), F.coalesce("_place", F.lit(""))).orderBy(outranks().desc(), "pos")
    return b.withColumn("_copy", F.row_number().over(same)).where((F.col("_copy") == 1) | (F.col("key") == "")).drop("_copy", "_place", "_drawn")


def without_structure(blocks: DataFrame) -> DataFrame:
    return blocks.where("kind <> 'rule'")


def canvas_pages(parsed: DataFrame, pages: DataFrame, least: int = 40) -> DataFrame:
    """(page_id, canvas): pages that draw on a canvas and hold fewer than `least` words of text."""
    words = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.size(F.filter(F.split(b["text"], r"\s+"), lambda w: w != "")))
    return parsed.select("page_id", words.alias("_w")).join(pages.select("page_id", F.lower("html").rlike(r"<canvas\b").alias("_c")), "page_id").select("page_id", (F.col("_c") & (F.col("_w") < least)).alias("canvas"))


def schema_types(payloads: DataFrame) -> DataFrame:
    """(page_id, types): distinct @type names over all payloads of a page, in order of name."""
    t = payloads.select("page_id", F.explode(F.regexp_extract_all("data", F.lit(r'"@type":\s*(?:\[\s*)?"([^"]+)"'), F.lit(1))).alias("t"))
    return t.groupBy("page_id").agg(F.sort_array(F.collect_set(F.regexp_extract("t", r"([^/#:]+)$", 1))).alias("types"))


def restated(blocks: DataFrame) -> DataFrame:
    """(page_id, pos) of long blocks whose 6-word shingles other blocks of the page hold to 0.7, and no single one to 0.5."""
    texts = blocks.where("kind not in ('image', 'media', 'rule') and page_id is not null and text is not null").select("page_id", "pos", F.lower("text").alias("text"))
    pages = texts.groupBy("page_id").agg(F.collect_list(F.struct("pos", "text")).alias("blocks")).where(F.exists("blocks", lambda b: F.length(b["text"]) >= 2 * RESTATED_WORDS - 1))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a page at a time
                page = batch.slice(i, 1)
                found = restate.restated([(b["pos"], b["text"]) for b in page.column(1)[0].as_py()], RESTATED_WORDS, RESTATED_SHARE, RESTATED_SINGLE)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(page.column(0).to_pylist() * len(found), batch.schema.field(0).type), pa.array(found, batch.schema.field(1).type.value_type.field("pos").type)], ["page_id", "pos"])

    return pages.mapInArrow(run, ", ".join(f"{c} {blocks.schema[c].dataType.simpleString()}" for c in ("page_id", "pos")))


def page_text(blocks: DataFrame) -> DataFrame:
    """(page_id, text, content_hash): texts in order, joined by a blank line, without images and media in the text; the
    hash is over all texts."""
    joined = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("pos", "text")))), lambda b: b["text"]), "\n\n")
    return blocks.groupBy("page_id").agg(joined(~F.col("kind").isin("image", "media", "rule")).alias("text"), F.sha2(joined(F.col("kind") != "rule"), 256).alias("content_hash"))


def _beside(table: DataFrame) -> DataFrame:
    """A staged table of short rows for the right side of a join: broadcast only if its rows, counted, are few."""
    return F.broadcast(table) if table.count() <= FEW else table.hint("merge")


def _sites(blocks: DataFrame, least_pages: int) -> DataFrame:
    pages = blocks.groupBy("site").agg(F.count_distinct("page_id").alias("pages")).where(F.col("pages") >= least_pages)
    return _beside(staged(pages, "sites"))


def site_chrome(blocks: DataFrame, share: float = CHROME_SHARE, least_pages: int = CHROME_PAGES) -> DataFrame:
    """(site, chrome_key, pages, df): keys on at least max(2, floor(share x pages)) pages of sites with enough pages."""
    seen = blocks.where("chrome_key <> ''").select("site", "chrome_key", "page_id").distinct().groupBy("site", "chrome_key").agg(F.count("*").alias("df")).where("df >= 2")
    return seen.join(_sites(blocks, least_pages), "site").where(F.col("df") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share + 1e-9))).select("site", "chrome_key", "pages", "df")


def site_slots(blocks: DataFrame, share: float = SLOT_SHARE, least_pages: int = CHROME_PAGES) -> DataFrame:
    """(site, xpath): places filled on enough pages of a site, always with one and the same text."""
    filled = blocks.groupBy("page_id", "site", "xpath").agg(F.min("chrome_key").alias("lo"), F.max("chrome_key").alias("hi"))  # a row a page, before any site is gathered
    slots = filled.groupBy("site", "xpath").agg(F.count("page_id").alias("on"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("on >= 2 and lo <=> hi")
    return slots.join(_sites(blocks, least_pages), "site").where(F.col("on") >= F.greatest(F.lit(2), F.floor(F.col("pages") * share + 1e-9))).select("site", "xpath")


def _mark(site: str, name: str) -> Column:
    """A site's key or place in 32 bytes; null where either is null, which equals nothing."""
    return F.unhex(F.sha2(F.concat(F.length(site).cast("string"), F.lit(":"), F.col(site), F.col(name)), 256))


def with_hits(blocks: DataFrame, chrome: dict[str, DataFrame]) -> DataFrame:
    """blocks with _hit: whether chrome, tables of (site, column) by column, holds the block's own.

    Few marks are broadcast. Of many, only (page_id, pos, mark) is shuffled by mark, since the blocks of a site's chrome
    all share one, and the hits of a page come back as one row.
    """
    marks = {c: staged(t.select(_mark("site", c).alias("_mark")).distinct(), "marks") for c, t in chrome.items()}
    if all(m.count() <= FEW for m in marks.values()):
        b = blocks
        for c, m in marks.items():
            b = b.withColumn("_mark", _mark("site", c)).join(F.broadcast(m.withColumn(f"_by_{c}", F.lit(True))), "_mark", "left").drop("_mark")
        hit = F.lit(False)
        for c in marks:
            hit = hit | F.col(f"_by_{c}").isNotNull()
        return b.withColumn("_hit", hit).drop(*(f"_by_{c}" for c in marks))
    found = None
    for c, m in marks.items():
        f = blocks.select("page_id", "pos", _mark("site", c).alias("_mark")).join(m.hint("merge"), "_mark", "left_semi").select("page_id", "pos")
        found = f if found is None else found.unionByName(f)
    return with_marked(blocks, found, "_hit")


def with_marked(blocks: DataFrame, marked: DataFrame, name: str) -> DataFrame:
    """blocks with `name`: whether (page_id, pos) is among marked; joined by page, so that blocks stay in their tasks."""
    at = marked.groupBy("page_id").agg(F.collect_set("pos").alias("_at"))
    return blocks.join(at.hint("merge"), "page_id", "left").withColumn(name, F.coalesce(F.array_contains("_at", F.col("pos")), F.lit(False))).drop("_at")


def strip_chrome(blocks: DataFrame, keys: DataFrame, slots: DataFrame | None = None, kept: float = CHROME_KEPT) -> DataFrame:
    """blocks without chrome: a page's first h1 or h2 stays where nothing is kept before it; a page that would lose more
    than half of its characters stays whole. Sites without chrome pass unchanged."""
    b = with_hits(blocks, {"chrome_key": keys} | ({"xpath": slots} if slots is not None else {}))
    title = (F.col("kind") == "heading") & (F.col("level") <= 2)
    before = F.coalesce(F.sum((~F.col("_hit")).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = b.withColumn("_keep", ~F.col("_hit") | (title & (before == 0)))
    size = F.length("text")
    share = F.sum(F.when(F.col("_keep"), size).otherwise(0)).over(of_page()) / F.greatest(F.sum(size).over(of_page()), F.lit(1))
    return b.withColumn("_share", share).where(F.col("_keep") | (F.col("_share") < kept)).select(*blocks.columns)


def _if_enough(blocks: DataFrame, keep: Column, enough: Column) -> DataFrame:
    """Rows to keep, or all rows of pages where that would not be enough."""
    return blocks.withColumn("_keep", keep).withColumn("_enough", enough).where(F.col("_keep") | ~F.col("_enough")).drop("_keep", "_enough")


@dataclass(frozen=True)
class Selection:
    """What content selection keeps: sizes and shares of its steps, and which of the prunes of a page type run."""

    landmark_chars: int = LANDMARK_CHARS
    comment_words: int = 60
    main_words: int = MAIN_WORDS
    main_share: float = MAIN_SHARE
    article_words: int = ARTICLE_WORDS
    article_share: float = ARTICLE_SHARE
    article_lead: float = ARTICLE_LEAD
    cost_ratio: float = COST_RATIO
    cost_least: float = COST_LEAST
    cost_most: float = COST_MOST
    run_share: float = RUN_SHARE
    lead_blocks: int = 12
    keep_comments: bool = False
    prune_sections: bool = False
    prune_product: bool = False
    drop_quotes: bool = False


#: What each page type changes: threads keep their comments and lose repeated quotes, products lose grids of others.
POLICIES = {
    "article": Selection(prune_sections=True),
    "product": Selection(prune_product=True, prune_sections=True),
    "forum": Selection(keep_comments=True, drop_quotes=True),
    "listing": Selection(article_share=1.1),
    "documentation": Selection(cost_ratio=0.4),
}


def policy_for(page_type: str | None) -> Selection:
    return POLICIES.get(page_type or "", Selection())


def widget_in(*names: str) -> Column:
    return F.coalesce(F.col("widget"), F.lit("")).isin(*names)


def strip_landmarks(blocks: DataFrame, least_chars: int = LANDMARK_CHARS) -> DataFrame:
    """Without dropdowns, unless the page is nothing else; then without nav, footer and aside regions outside main and
    filter, consent, rail and post-furniture widgets, if enough characters stay."""
    every = F.min(widget_in("select").cast("int")).over(of_page()) == 1
    b = blocks.withColumn("_all", every).where(~widget_in("select") | F.col("_all")).drop("_all")
    keep = ~(F.coalesce(F.col("region"), F.lit("")).isin("nav", "footer", "aside") & ~F.col("in_main")) & ~widget_in("filter", "consent", "rail", "post-furniture")
    chars = F.sum(F.when(F.col("_keep"), F.length("text")).otherwise(0)).over(of_page())
    return _if_enough(b, keep, chars >= least_chars)


def strip_comments(blocks: DataFrame, least_words: int = 60, most_share: float = 0.92) -> DataFrame:
    """Without comment panels, if the rest has enough words or the panels are not nearly all of the page."""
    words = F.sum(F.when(F.col("_keep"), F.col("words")).otherwise(0)).over(of_page())
    total = F.sum("words").over(of_page())
    return _if_enough(blocks, ~widget_in("comments"), (words >= least_words) & (words >= (1 - most_share) * total))


def scope_to_main(blocks: DataFrame, least: int = MAIN_WORDS, share: float = MAIN_SHARE) -> DataFrame:
    inside, total = F.sum(F.when(F.col("in_main"), F.col("words")).otherwise(0)).over(of_page()), F.sum("words").over(of_page())
    return _if_enough(blocks, F.col("in_main"), (inside >= least) & (inside >= share * total))


def scope_to_article(blocks: DataFrame, column: str = "article", least: int = ARTICLE_WORDS, share: float = ARTICLE_SHARE, lead: float = ARTICLE_LEAD) -> DataFrame:
    """Only the dominant article (or, by body_of, article body): enough words, a share of the page, and so many times the
    runner-up."""
    same = Window.partitionBy("page_id", column)
    b = blocks.withColumn("_w", F.sum("words").over(same)).withColumn("_first", F.min("pos").over(same))
    rank = F.when(F.col(column).isNotNull(), F.struct("_w", (-F.col("_first")).alias("_before"), F.col(column).alias("_name")))
    b = b.withColumn("_rank", rank).withColumn("_top", F.max("_rank").over(of_page())).withColumn("_total", F.sum("words").over(of_page()))
    b = b.withColumn("_next", F.max(F.when(F.col("_rank") != F.col("_top"), F.col("_w"))).over(of_page()))
    w = F.col("_top._w")
    chosen = F.coalesce((w >= least) & (w >= share * F.col("_total")) & (F.col("_next").isNull() | (w >= lead * F.col("_next"))), F.lit(False))
    return b.where(~chosen | F.coalesce(F.col("_rank") == F.col("_top"), F.lit(False))).select(*blocks.columns)


def block_value(cost: Column) -> Column:
    """What a block adds to the content run: words outside links less the cost, by kind."""
    free = F.col("words") * (1 - F.when(F.col("in_main"), 0.0).otherwise(F.col("link_density")))
    return (
        F.when(F.col("kind") == "rule", 0.0)
        .when(F.col("kind") == "image", -cost)
        .when(F.col("kind") == "heading", free + 4 - cost)
        .when(F.col("kind").isin("table", "code"), F.greatest(F.greatest(free, 0.5 * F.col("words")) - cost, F.lit(0.0)))
        .otherwise(free - cost)
    )


def introduces_code() -> Column:
    """A short paragraph right before code that leads up to it."""
    return (F.col("kind") == "paragraph") & (F.lead("kind").over(in_order()) == "code") & ((F.col("words") <= 12) | F.col("text").rlike(r":\s*$"))


def main_run(blocks: DataFrame, how: Selection = Selection()) -> DataFrame:
    """The contiguous run of blocks with the greatest value on each page; pages without a gain stay whole.

    Code without a value of its own, and what introduces it, extends the run on both sides.
    """
    mean = F.avg(F.least(F.col("words"), F.lit(COST_CAP))).over(of_page())
    cost = F.least(F.greatest(how.cost_ratio * mean, F.lit(how.cost_least)), F.lit(how.cost_most))
    b = blocks.withColumn("_v", block_value(cost)).withColumn("_lead", F.coalesce(introduces_code(), F.lit(False)))
    b = b.withColumn("_v", F.when(F.col("_lead"), F.greatest("_v", F.lit(0.0))).otherwise(F.col("_v"))).withColumn("_n", F.row_number().over(in_order()))
    items = F.array_sort(F.collect_list(F.struct("_n", "_v")))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(-1).alias("at"), F.lit(0.0).alias("best"), F.lit(-1).alias("a"), F.lit(-1).alias("b"))

    def step(s, x):
        anew = s["run"] <= 0
        run = F.when(anew, x["_v"]).otherwise(s["run"] + x["_v"])
        at = F.when(anew, x["_n"]).otherwise(s["at"])
        better = run > s["best"]
        return F.struct(run.alias("run"), at.alias("at"), F.when(better, run).otherwise(s["best"]).alias("best"), F.when(better, at).otherwise(s["a"]).alias("a"), F.when(better, x["_n"]).otherwise(s["b"]).alias("b"))

    b = b.withColumn("_r", F.aggregate(F.collect_list(F.struct("_n", "_v")).over(in_order().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), start, step))
    neutral = ((F.col("kind") == "code") & (F.col("_v") == 0)) | F.col("_lead")
    solid_after = F.sum(((F.col("_n") > F.col("_r.b")) & ~neutral).cast("int")).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    solid_before = F.sum(((F.col("_n") < F.col("_r.a")) & ~neutral).cast("int")).over(in_order().rowsBetween(0, Window.unboundedFollowing))
    inside = F.when(F.col("_n") > F.col("_r.b"), solid_after == 0).when(F.col("_n") < F.col("_r.a"), solid_before == 0).otherwise(True)
    b = b.withColumn("_in", inside & (F.col("_r.a") > 0))
    kept, total = F.sum(F.when(F.col("_in"), F.col("words")).otherwise(0)).over(of_page()), F.sum("words").over(of_page())
    return b.withColumn("_fine", (F.col("_r.a") > 0) & (kept >= how.run_share * total)).where(F.col("_in") | ~F.col("_fine")).select(*blocks.columns)


def restore(all_blocks: DataFrame, kept: DataFrame, titles: DataFrame, how: Selection = Selection()) -> DataFrame:
    """kept with its title, the few blocks between the title and the content, and the rules between kept neighbours put
    back: windows over all blocks with a mark on the kept ones."""
    core = F.regexp_extract("title", r"^(.*?)\s+[|·–—-]\s+", 1)
    t = titles.select("page_id", F.lower(T.fold_space(F.when(F.length(core) >= 8, core).otherwise(F.col("title")))).alias("_core"))
    b = with_marked(all_blocks, kept, "_kept").join(t.hint("merge"), "page_id", "left")
    said = F.lower(T.fold_space(F.col("text")))
    match = F.coalesce((F.length("_core") > 0) & F.length("text").between(8, 300) & (said.contains(F.col("_core")) | F.col("_core").contains(said)), F.lit(False))
    rank = F.when(match, F.struct((F.col("kind") == "heading").alias("h"), F.length("text").alias("l"), (-F.col("pos")).alias("p")))
    b = b.withColumn("_rank", rank).withColumn("_title", F.col("_rank").isNotNull() & (F.col("_rank") == F.max("_rank").over(of_page())))
    start = F.min(F.when(F.col("_kept"), F.col("pos"))).over(of_page())
    heading = F.min(F.when(F.col("_title") | (F.col("kind") == "heading"), F.col("pos"))).over(of_page())
    b = b.withColumn("_gap", F.coalesce((F.col("pos") > heading) & (F.col("pos") < start), F.lit(False)))
    n, lists = F.sum(F.col("_gap").cast("int")).over(of_page()), F.avg(F.when(F.col("_gap"), (F.col("kind") == "list-item").cast("double"))).over(of_page())
    b = b.withColumn("_lead", F.col("_gap") & (n <= how.lead_blocks) & (lists < 0.5))
    b = b.withColumn("_kept", F.col("_kept") | F.col("_title") | F.col("_lead"))
    solid = F.when(F.col("kind") != "rule", F.col("_kept"))
    before = F.last(solid, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(solid, ignorenulls=True).over(in_order().rowsBetween(0, Window.unboundedFollowing))
    rule = (F.col("kind") == "rule") & F.coalesce(before & after, F.lit(False))
    return b.withColumn("_kept", F.col("_kept") | rule).where("_kept").select(*all_blocks.columns)


def selection_steps(blocks: DataFrame, titles: DataFrame, keys: DataFrame | None = None, slots: DataFrame | None = None, how: Selection = Selection()) -> list[tuple[str, DataFrame]]:
    """The steps of content selection in order, each with the blocks it leaves."""
    steps = [("landmarks", strip_landmarks(blocks, how.landmark_chars))]

    def then(name: str, step) -> None:
        steps.append((name, step(steps[-1][1])))

    if not how.keep_comments:
        then("comments", lambda b: strip_comments(b, how.comment_words))
    then("main", lambda b: scope_to_main(b, how.main_words, how.main_share))
    for name, column in (("article", "article"), ("article-body", "body_of")):
        then(name, lambda b, column=column: scope_to_article(b, column, how.article_words, how.article_share, how.article_lead))
    if keys is not None:
        then("chrome", lambda b: strip_chrome(b, keys, slots))
    if how.prune_product:
        then("product", prune_product)
    if how.prune_sections:
        then("sections", prune_sections)
    if how.drop_quotes:
        then("quotes", drop_quoted_repeats)
    then("main-run", lambda b: main_run(b, how))
    return steps


def removals(blocks: DataFrame, steps: list[tuple[str, DataFrame]]) -> DataFrame:
    """(page_id, step, removed): how many blocks each step took from each page; steps that took none have no row."""
    n = lambda df, i: df.groupBy("page_id").agg(F.count("*").alias("n")).withColumn("i", F.lit(i))
    counts = n(blocks, 0)
    for i, (_, df) in enumerate(steps, 1):
        counts = counts.unionByName(n(df, i))
    every = counts.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("n"))
    got = lambda i: F.coalesce(F.col("n")[i], F.lit(0))
    rows = F.array(*(F.struct(F.lit(name).alias("step"), (got(i) - got(i + 1)).alias("removed")) for i, (name, _) in enumerate(steps)))
    return every.select("page_id", F.inline(F.filter(rows, lambda r: r["removed"] > 0)))


def select_content(blocks: DataFrame, titles: DataFrame, keys: DataFrame | None = None, slots: DataFrame | None = None, how: Selection = Selection()) -> DataFrame:
    """Landmarks, comments, main, article, article body, chrome, prunes of the page type, main run; then title, lead and
    rules: the content of every page."""
    return restore(blocks, selection_steps(blocks, titles, keys, slots, how)[-1][1], titles, how)


def content_of(parsed: DataFrame, keys: DataFrame | None = None, slots: DataFrame | None = None, how: Selection = Selection()) -> DataFrame:
    """(page_id, markdown): the content of parsed pages, under the chrome of their sites where it is given."""
    blocks = dedup_blocks(blocks_of(by_page(parsed, tasks_of(parsed)))).withColumn("site", U.site_host(F.col("url"))).withColumn("chrome_key", T.chrome_key(F.col("text")))
    return markdown_of(select_content(blocks, parsed.select("page_id", F.coalesce(F.col("meta")["title"], F.lit("")).alias("title")), keys, slots, how))


def markdown_of(blocks: DataFrame, links: bool = True) -> DataFrame:
    """(page_id, markdown): blocks in order; list items stand close together, everything else apart."""
    body = F.col("rich_text") if links else F.col("text")
    body = F.regexp_replace(F.regexp_replace(body, r"(?<![\\$\w])\$(?=\d)", r"\\\$"), r"(?m)^>", r"\\>")
    cell = lambda c: F.regexp_replace(F.regexp_replace(c, r"\|", r"\\|"), r"\s+", " ")
    cells = F.coalesce(F.col("rich_rows") if links and "rich_rows" in blocks.columns else F.lit(None).cast("array<array<string>>"), F.col("rows"))
    width = F.array_max(F.transform("rows", F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), width))
    table = F.array_join(F.concat(F.transform(F.slice(cells, 1, 1), line), F.array(rule), F.transform(F.slice(cells, F.lit(2), F.greatest(F.size(cells) - 1, F.lit(0))), line)), "\n")
    if "table_html" in blocks.columns:  # spans and nested tables are beyond pipes
        table = F.coalesce("table_html", table)
    indent = F.repeat(F.lit("  "), F.greatest(F.col("level") - 1, F.lit(0)))
    marker = F.when(F.col("tag") == "dt", "**").when(F.col("tag") == "dd", ": ").when(F.col("ordered"), "1. ").otherwise("- ")
    picture = F.concat(F.lit("!["), F.regexp_replace(F.coalesce("alt", F.lit("")), r"([\[\]])", r"\\$1"), F.lit("]("), "href", F.lit(")"))
    if links and "link" in blocks.columns:
        picture = F.when(F.col("link").isNotNull(), F.concat(F.lit("["), picture, F.lit("]("), "link", F.lit(")"))).otherwise(picture)
    md = (
        F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), F.regexp_replace(body, r"\s+", " ")))
        .when(F.col("kind") == "list-item", F.concat(indent, marker, body, F.when(F.col("tag") == "dt", "**").otherwise("")))
        .when(F.col("kind") == "code", F.concat(F.lit("```"), F.coalesce("language", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n```")))
        .when(F.col("kind") == "table", table)
        .when(F.col("kind") == "image", F.when(F.col("href").isNotNull(), picture))
        .when(F.col("kind") == "media", F.when(F.col("href").isNotNull(), F.concat(F.lit("["), F.when(F.col("text") != "", F.col("text")).otherwise("media"), F.lit("]("), "href", F.lit(")"))))
        .when(F.col("kind") == "rule", F.lit("---"))
        .when(F.col("kind") == "figure-caption", F.concat(F.lit("*"), body, F.lit("*")))
        .otherwise(F.regexp_replace(body, r"\n", "\\\\\n"))
    )
    md = F.when(F.col("quoted") > 0, F.concat(F.repeat(F.lit("> "), F.col("quoted")), F.regexp_replace(md, r"\n", "\n> "))).otherwise(md)
    tight = (F.col("kind") == "list-item") & (F.lag("kind").over(in_order()) == "list-item")
    rows = blocks.withColumn("_md", md).where("_md is not null and _md <> ''")
    rows = rows.withColumn("_md", F.concat(F.when(F.row_number().over(in_order()) == 1, "").when(tight, "\n").otherwise("\n\n"), "_md"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_md"))), lambda x: x["_md"]), "").alias("markdown"))


def union_blocks(static: DataFrame, rendered: DataFrame) -> DataFrame:
    """Rendered blocks in order, and blocks only the static copy has, each after the last shared block before it."""
    shared = rendered.groupBy("page_id", "key").agg(F.max("pos").alias("at"))
    s = static.join(shared, ["page_id", "key"], "left")
    anchor = F.last("at", ignorenulls=True).over(in_order())
    any_shared = F.max(F.col("at").isNotNull()).over(of_page())
    last = rendered.groupBy("page_id").agg(F.max("pos").alias("_end"))
    only = s.withColumn("_anchor", anchor).withColumn("_any", any_shared).where("at is null").join(last, "page_id", "left")
    only = only.withColumn("_anchor", F.coalesce("_anchor", F.when(F.col("_any"), F.lit(-1)).otherwise(F.coalesce("_end", F.lit(-1)))))
    both = rendered.withColumn("_anchor", F.col("pos")).withColumn("_late", F.lit(0)).unionByName(only.withColumn("_late", F.lit(1)).select(*rendered.columns, "_anchor", "_late"))
    order = of_page().orderBy("_anchor", "_late", "pos")
    return both.withColumn("from_static", F.col("_late") == 1).withColumn("pos", F.row_number().over(order) - 1).drop("_anchor", "_late")


def drop_quoted_repeats(blocks: DataFrame, share: float = 0.5) -> DataFrame:
    """blocks without quotes of which half of the 6-word shingles stood before on the page."""
    words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != "")
    s = blocks.select("page_id", "pos", "quoted", F.explode(T.shingles(words, 6)).alias("s"))
    firsts = s.groupBy("page_id", "s").agg(F.min("pos").alias("_first"))
    seen = s.where("quoted > 0").join(firsts, ["page_id", "s"]).groupBy("page_id", "pos").agg(F.avg((F.col("_first") < F.col("pos")).cast("double")).alias("_share")).where(F.col("_share") >= share)
    return blocks.join(seen.select("page_id", "pos"), ["page_id", "pos"], "left_anti")


def is_prose(least: int = 30, links: float = 0.3) -> Column:
    """A paragraph of enough words that is not mostly links."""
    return (F.col("kind") == "paragraph") & (F.col("words") >= least) & (F.col("link_density") <= links)


def is_sentence(least: int = 12, links: float = 0.3) -> Column:
    return (F.col("words") >= least) & F.col("text").rlike(r"[.!?…][\"'”’)\]]*\s*$") & (F.col("link_density") <= links)


def is_river_furniture() -> Column:
    """A picture or a label of a few words between the teasers of a river."""
    return (F.col("kind") == "image") | (F.col("words") < 4)


def is_spec() -> Column:
    """A line or table of properties: a name, a colon and a short value; or rows of two cells."""
    pairs = (F.col("kind") == "table") & F.coalesce(F.forall("rows", lambda r: F.size(r) == 2), F.lit(False))
    return pairs | (F.col("text").rlike(r"^[^:.]{2,40}:\s*\S.{0,80}$") & (F.col("words") <= 14))


#: What headings of sections that lead elsewhere begin with.
ELSEWHERE = r"(?i)^(?:also read|latest|more (?:from|on|stories)|most (?:popular|read)|popular|read (?:more|next)|recommended|related|see also|trending|you may (?:also )?like)\b"


def prune_sections(blocks: DataFrame, headings: str = ELSEWHERE) -> DataFrame:
    """blocks without the sections under headings that lead elsewhere: up to the next heading of the same or a higher level,
    or to where prose resumes, which is a paragraph of prose that a sentence or more prose follows."""
    h = F.col("kind") == "heading"
    mark = F.when(h & F.col("text").rlike(headings), F.struct("pos", "level"))
    b = blocks.withColumn("_cut", F.last(mark, ignorenulls=True).over(in_order()))
    follows = F.coalesce(F.lead(is_prose() | is_sentence()).over(in_order()), F.lit(True))
    ends = (h & ~F.col("text").rlike(headings) & (F.col("level") <= F.col("_cut.level"))) | (is_prose() & follows)
    b = b.withColumn("_ended", F.max(F.when(ends & (F.col("pos") > F.col("_cut.pos")), F.col("pos"))).over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return b.where(F.col("_cut").isNull() | (F.coalesce("_ended", F.lit(-1)) > F.col("_cut.pos"))).select(*blocks.columns)


def repeat_groups(blocks: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """(page_id, template, instances, words): repeated siblings, by their path without numbers at one place, that hold a
    good share of the page's words."""
    parts = F.split(F.substring("xpath", 2, 100000), "/")
    n = F.size(parts)
    p = blocks.where("xpath <> '' and words > 0").select("page_id", "words", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.array_join(F.slice(parts, F.lit(1), i), "/").alias("instance"), F.concat(F.array_join(F.slice(parts, F.lit(1), i - 1), "/"), F.lit("/"), F.regexp_replace(F.element_at(parts, i), r"\[\d+\]$", "")).alias("template")))).alias("p"))
    g = p.select("page_id", "words", "p.*").groupBy("page_id", "template").agg(F.count_distinct("instance").alias("instances"), F.sum("words").alias("words"))
    total = blocks.groupBy("page_id").agg(F.sum("words").alias("_total"))
    return g.join(total, "page_id").where((F.col("instances") >= least) & (F.col("words") >= share * F.col("_total"))).drop("_total")


def prune_product(blocks: DataFrame, least: int = 3, share: float = 0.6) -> DataFrame:
    """blocks of product pages without grids of other products: repeated siblings of which most hold a price and a link, or
    a date (reviews); the group that holds the page's h1 stays."""
    group = F.regexp_replace("xpath", r"\[\d+\](?=(?:/[^/]*){0,2}$)", "")
    instance = F.regexp_extract("xpath", r"^(.*\[\d+\])/?[^/]*$", 1)
    b = blocks.withColumn("_g", group).withColumn("_i", instance)
    per = b.groupBy("page_id", "_g", "_i").agg(
        F.bool_and(is_spec()).alias("spec"), F.bool_or(F.col("text").rlike(r"[$€£]\s?\d|\d\s?(?:USD|EUR|GBP)")).alias("priced"), F.bool_or(F.col("href").isNotNull()).alias("linked"), F.bool_or(F.col("text").rlike(r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2} \p{L}+ \d{4}\b")).alias("dated"), F.bool_or((F.col("kind") == "heading") & (F.col("level") == 1)).alias("title")
    )
    away = per.groupBy("page_id", "_g").agg(F.count("*").alias("n"), F.avg((((F.col("priced") & F.col("linked")) | F.col("dated")) & ~F.col("spec")).cast("double")).alias("r"), F.bool_or("title").alias("t")).where((F.col("n") >= least) & (F.col("r") >= share) & ~F.col("t"))
    return b.join(away.select("page_id", "_g"), ["page_id", "_g"], "left_anti").select(*blocks.columns)
