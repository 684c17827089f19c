"""Site report: crawler policies from robots.txt, readiness scores, evaluation measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.functions import urls as U

# Tokens of crawlers whose access the report states.
BOTS = ("GPTBot", "OAI-SearchBot", "ChatGPT-User", "ClaudeBot", "anthropic-ai", "PerplexityBot", "Google-Extended", "Googlebot", "Bingbot", "CCBot", "Applebot-Extended", "Bytespider", "Amazonbot", "meta-externalagent", "cohere-ai")
# Weights of the sub-scores.
WEIGHTS = {"readable": 25, "robots": 20, "walls": 15, "sitemap": 10, "structured": 10, "hidden": 10, "llms": 5, "dead": 5}


def robots_rules(files: DataFrame) -> DataFrame:
    """(origin, group, agent, allow, pattern, line) from robots.txt texts (origin, body); consecutive agents share a group."""
    lines = files.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"#.*$", "")))
    lines = lines.select("origin", "line", F.lower(F.trim(F.substring_index("raw", ":", 1))).alias("field"), F.trim(F.regexp_extract("raw", r"^[^:]*:(.*)$", 1)).alias("value")).where("field in ('user-agent', 'allow', 'disallow')")
    w = Window.partitionBy("origin").orderBy("line")
    starts = (F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")
    lines = lines.withColumn("starts", starts.cast("int")).withColumn("group", F.sum("starts").over(w))
    agents = lines.where("field = 'user-agent'").select("origin", "group", F.lower("value").alias("agent"))
    rules = lines.where("field <> 'user-agent' and value <> ''").select("origin", "group", (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"), "line")
    return agents.join(rules, ["origin", "group"], "left")


def policies(rules: DataFrame, urls: DataFrame, agents: tuple[str, ...] = BOTS) -> DataFrame:
    """(agent, url, allowed, pattern): an agent's own groups before *, the longest matching pattern, allow on ties."""
    spark = rules.sparkSession
    bots = spark.createDataFrame([(a, a.lower()) for a in agents], "bot string, token string")
    named = rules.join(F.broadcast(bots), rules.agent == F.col("token")).select("origin", "bot", "allow", "pattern")
    own = named.select("origin", "bot").distinct()
    general = rules.where("agent = '*'").select("origin", "allow", "pattern").crossJoin(F.broadcast(bots.select("bot"))).join(own, ["origin", "bot"], "left_anti").select("origin", "bot", "allow", "pattern")
    every = named.unionByName(general).where("pattern is not null").withColumn("regex", U.robots_pattern(F.col("pattern")))
    u = urls.select("url", F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("origin"), F.regexp_extract("url", r"^https?://[^/]+(.*)$", 1).alias("path"))
    hits = u.join(every, "origin").where(F.expr("path rlike regex")).groupBy("bot", "url").agg(F.max(F.struct(F.length("pattern"), "allow", "pattern")).alias("best"))
    all_pairs = u.select("url").distinct().crossJoin(F.broadcast(bots.select("bot")))  # a fixed list of agents
    return all_pairs.join(hits, ["bot", "url"], "left").select(F.col("bot").alias("agent"), "url", F.coalesce("best.allow", F.lit(True)).alias("allowed"), F.col("best.pattern").alias("pattern"))


# Path words of housekeeping, and hosts behind off-page links that make an injection.
HOUSEKEEPING = "account admin api auth basket cart cgi-bin checkout feed login logout register search signin signup user users wp-admin wp-json wp-login.php xmlrpc.php".split()
SPAM_HOSTS, STACK_YEARS, LINK_CHECKS = 5, 3.0, 30


def _bare(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def is_administrative(pattern: Column) -> Column:
    """Whether a robots pattern closes off housekeeping, not content: a path word of it, a query, or a file type."""
    bare = F.lower(F.regexp_replace(pattern, r"[*$]", ""))
    return F.arrays_overlap(F.split(bare, r"[/?=&]+"), F.array(*map(F.lit, HOUSEKEEPING))) | bare.rlike(r"^/?\?|\.(?:php|json|xml|cgi|aspx?)$")


def crawl_delays(files: DataFrame) -> DataFrame:
    """(origin, agent, delay): the first readable Crawl-delay of each agent's groups in robots texts (origin, body)."""
    lines = files.select("origin", F.posexplode(F.split("body", r"\r?\n")).alias("line", "raw")).withColumn("raw", F.trim(F.regexp_replace("raw", r"#.*$", "")))
    lines = lines.select("origin", "line", F.lower(F.trim(F.substring_index("raw", ":", 1))).alias("field"), F.trim(F.regexp_extract("raw", r"^[^:]*:(.*)$", 1)).alias("value")).where("field in ('user-agent', 'allow', 'disallow', 'crawl-delay')")
    w = Window.partitionBy("origin").orderBy("line")
    lines = lines.withColumn("group", F.sum(((F.col("field") == "user-agent") & (F.coalesce(F.lag("field").over(w), F.lit("")) != "user-agent")).cast("int")).over(w))
    delays = lines.where("field = 'crawl-delay'").withColumn("delay", F.col("value").try_cast("double")).where("delay is not null").groupBy("origin", "group").agg(F.min_by("delay", "line").alias("delay"), F.min("line").alias("at"))
    agents = lines.where("field = 'user-agent'").select("origin", "group", F.lower("value").alias("agent"))
    return agents.join(delays, ["origin", "group"]).groupBy("origin", "agent").agg(F.min_by("delay", "at").alias("delay"))


def bot_access(rules: DataFrame, agents: tuple[str, ...] = BOTS) -> DataFrame:
    """(origin, bot, access, via, content_paths): what each crawler may read, from robots_rules().

    blocked where the root is closed to it, partly where content paths are, else allowed; housekeeping paths do not count.
    A crawler's own groups decide (named), else those of * (wildcard), else nothing does (none).
    """
    bots = rules.sparkSession.createDataFrame([(a, a.lower()) for a in agents], "bot string, token string")  # a fixed list
    origins = rules.select("origin").distinct().crossJoin(F.broadcast(bots))
    named = rules.join(F.broadcast(bots), rules.agent == F.col("token")).select("origin", "bot", "allow", "pattern", F.lit("named").alias("via"))
    own = named.select("origin", "bot").distinct()
    rest = rules.where("agent = '*'").select("origin", "allow", "pattern").join(origins.join(own, ["origin", "bot"], "left_anti").select("origin", "bot"), "origin").select("origin", "bot", "allow", "pattern", F.lit("wildcard").alias("via"))
    every = named.unionByName(rest)
    root = F.col("pattern").rlike(r"^/?\*?\$?$")
    per = every.groupBy("origin", "bot").agg(
        F.max("via").alias("via"),
        F.bool_or(root & ~F.col("allow")).alias("closed"),
        F.bool_or(root & F.col("allow")).alias("open"),
        F.sort_array(F.collect_set(F.when(~F.col("allow") & ~root & ~is_administrative(F.col("pattern")), F.col("pattern")))).alias("content_paths"),
    )
    access = F.when(F.coalesce("closed", F.lit(False)) & ~F.coalesce("open", F.lit(False)), "blocked").when(F.size("content_paths") > 0, "partly").otherwise("allowed")
    out = origins.join(per, ["origin", "bot"], "left")
    return out.select("origin", "bot", access.alias("access"), F.coalesce("via", F.lit("none")).alias("via"), F.coalesce("content_paths", F.array().cast("array<string>")).alias("content_paths"))


def measure_pages(parsed: DataFrame) -> DataFrame:
    """Counters of every page: words, head fields, structured data, hidden words by kind, foreign hosts of hidden links."""
    words = F.aggregate(F.filter("blocks", lambda b: ~b["kind"].isin("image", "media", "rule")), F.lit(0), lambda n, b: n + F.size(F.split(F.trim(b["text"]), r"\s+")))
    said = lambda name: F.coalesce(F.col("meta")[name], F.lit("")) != ""
    has = lambda *kinds: F.exists("payloads", lambda p: p["source"].isin(*kinds))
    foreign = lambda keep: F.size(F.array_distinct(F.filter(F.transform(F.filter("hidden_links", keep), lambda x: U.host(x["href"])), lambda h: (h != "") & (_bare(h) != _bare(U.host(F.col("url")))))))
    return parsed.select(
        "page_id", "url", "error", words.alias("words"), F.col("meta")["title"].alias("title"), said("title").alias("has_title"), said("description").alias("has_description"), said("lang").alias("has_lang"),
        has("open-graph").alias("has_og"), has("json-ld", "microdata").alias("has_schema"), F.col("meta")["canonical"].alias("canonical"), F.map_from_entries(F.transform("hidden", lambda h: F.struct(h["kind"], h["words"]))).alias("hidden_words"),
        foreign(lambda x: x["kind"] == "offscreen").alias("offscreen_hosts"), foreign(lambda x: x["kind"] != "offscreen").alias("hidden_hosts"), F.size(F.filter("hidden_links", lambda x: x["kind"] == "offscreen")).alias("offscreen_links"),
        (F.col("stats.elements").isNotNull() & (words < 40)).alias("thin"),
    )


def hidden_links(parsed: DataFrame) -> DataFrame:
    """(page_id, host, external, offscreen, links): hidden links of each page by host."""
    h = parsed.select("page_id", "url", F.inline("hidden_links")).withColumn("host", U.host(F.col("href"))).where("host <> ''")
    external = _bare(F.col("host")) != _bare(U.host(F.col("url")))
    return h.groupBy("page_id", "host").agg(F.bool_or(external).alias("external"), F.bool_or(F.col("kind") == "offscreen").alias("offscreen"), F.count("*").alias("links"))


def check_links(links: DataFrame, statuses: DataFrame, most: int = LINK_CHECKS) -> DataFrame:
    """(page_id, checked, dead, unreachable, dead_links) of the first `most` distinct internal links of each page, for links
    (page_id, pos, url, href) and statuses (url, status): 4xx and 5xx are dead, a null status did not answer."""
    l = links.where(U.same_site(F.col("href"), F.col("url"))).select("page_id", "pos", U.page_key(F.col("href")).alias("key"), "href").where(U.page_key(F.col("href")) != U.page_key(F.col("url")))
    l = l.groupBy("page_id", "key").agg(F.min("pos").alias("pos"), F.min("href").alias("href"))
    l = l.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where(F.col("_n") <= most)
    s = statuses.select(U.page_key(F.col("url")).alias("key"), "status", F.lit(True).alias("_asked")).groupBy("key").agg(F.min("status").alias("status"), F.max("_asked").alias("_asked"))
    j = l.join(s, "key").withColumn("_dead", F.coalesce(F.col("status") >= 400, F.lit(False)))
    return j.groupBy("page_id").agg(F.count("*").alias("checked"), F.count_if("_dead").alias("dead"), F.count_if(F.col("status").isNull()).alias("unreachable"), F.sort_array(F.collect_list(F.when(F.col("_dead"), F.struct("href", "status")))).alias("dead_links"))


def sub_scores(pages: DataFrame, links: DataFrame | None = None, coverage: DataFrame | None = None, access: DataFrame | None = None, sitemap: DataFrame | None = None, llms: DataFrame | None = None) -> DataFrame:
    """(site, part, earned): the eight parts of each site's score; earned is null where a part was not measured.

    pages is (site, page_id, error, wall, has_*, offscreen_hosts), links is check_links(), coverage is (page_id,
    static_coverage, rendered_chars, union_chars), access is (site, bot, access), sitemap is (site, page_id, listed) with
    listed null where it is not known, and llms is (site, found).
    """
    one = lambda df, part, earned, by="site": df.groupBy(by).agg(earned.alias("earned")).select(F.col(by).alias("site"), F.lit(part).alias("part"), "earned")
    read = F.col("error").isNull()
    flag = lambda c: F.col(c).cast("double")
    meta = (flag("has_title") + flag("has_description") + flag("has_lang") + flag("has_og")) / 4
    spam, some = F.max(F.when(read, F.col("offscreen_hosts"))) >= SPAM_HOSTS, F.max(F.when(read, F.col("offscreen_hosts"))) > 0
    parts = [
        one(pages, "walls", 15 * (1 - F.avg(F.col("wall").isNotNull().cast("double")))),
        one(pages, "structured", 6 * F.avg(F.when(read, flag("has_schema"))) + 4 * F.avg(F.when(read, meta))),
        one(pages, "hidden", F.when(F.count_if(read) == 0, F.lit(None)).when(spam, 0.0).when(some, 5.0).otherwise(10.0)),
    ]
    sites = pages.select("site", "page_id")
    if coverage is not None:
        c = coverage.join(sites, "page_id").where("rendered_chars > 0 and union_chars > 0")
        parts.append(one(c, "readable", 25 * F.avg("static_coverage")))
    if access is not None:
        parts.append(one(access, "robots", 20 * (1 - F.avg((F.col("access") == "blocked").cast("double")))))
    if sitemap is not None:
        parts.append(one(sitemap, "sitemap", F.when(F.count("page_id") == 0, 0.0).otherwise(6 + 4 * F.coalesce(F.avg(F.col("listed").cast("double")), F.lit(1.0)))))
    if llms is not None:
        parts.append(one(llms, "llms", F.when(F.bool_or("found"), 5.0).otherwise(0.0)))
    if links is not None:
        parts.append(one(links.join(sites, "page_id"), "dead", 5 * (1 - F.sum("dead") / F.nullif(F.sum("checked"), F.lit(0)))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def site_score(parts: DataFrame) -> DataFrame:
    """(site, total) from (site, part, earned) with earned null where unmeasured: earned over the weights measured, of 100."""
    weight = F.create_map(*(x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(float(v)))))
    w = parts.withColumn("weight", weight[F.col("part")])
    measured = F.when(F.col("earned").isNotNull(), F.col("weight"))
    return w.groupBy("site").agg(F.bround(F.round(100 * F.sum("earned") / F.sum(measured), 9)).alias("total"))


def findings(pages: DataFrame, stack: DataFrame | None = None, sitemaps: DataFrame | None = None) -> DataFrame:
    """(site, kind, severity, pages, example): nine kinds of integrity findings of each site, the gravest first.

    pages is measure_pages() with site, status, wall, rendered (null: not tried), union_words and canvas; stack is (site,
    technology, old); sitemaps is (site, loc) of what sitemaps list.
    """
    elsewhere = (F.coalesce("canonical", F.lit("")) != "") & ~U.same_site(F.col("canonical"), F.col("url"))
    kinds = (
        ("injected_links", 3, F.col("offscreen_hosts") >= SPAM_HOSTS),
        ("wall", 3, F.col("wall").isNotNull()),
        ("unreadable_page", 3, F.col("error").isNotNull() & F.col("wall").isNull()),
        ("canonical_elsewhere", 2, elsewhere),
        ("hidden_external_links", 2, F.col("offscreen_hosts").between(1, SPAM_HOSTS - 1)),
        ("canvas_content", 2, F.col("canvas") & (F.col("words") < 40)),
        ("render_failed", 1, ~F.col("rendered")),
    )
    rows = F.array(*(F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(k).alias("kind"), F.lit(n).alias("severity"))) for k, n, test in kinds))
    found = pages.select("site", "url", F.inline(F.filter(rows, lambda r: r.isNotNull()))).groupBy("site", "kind", "severity").agg(F.count("*").alias("pages"), F.min("url").alias("example"))
    if sitemaps is not None:
        off = sitemaps.where(~U.same_site(F.col("loc"), F.concat(F.lit("https://"), F.col("site"), F.lit("/"))))
        found = found.unionByName(off.groupBy("site").agg(F.count("*").alias("pages"), F.min("loc").alias("example")).select("site", F.lit("sitemap_elsewhere").alias("kind"), F.lit(2).alias("severity"), "pages", "example"))
    if stack is not None:
        old = stack.where("old").groupBy("site").agg(F.count("*").alias("pages"), F.min("technology").alias("example"))
        found = found.unionByName(old.select("site", F.lit("outdated_stack").alias("kind"), F.lit(1).alias("severity"), "pages", "example"))
    return found.orderBy("site", F.desc("severity"), "kind")


def site_report(pages: DataFrame, **measured: DataFrame) -> DataFrame:
    """(site, total, parts, pages): the score with its parts as a map, over sub_scores()."""
    parts = sub_scores(pages, **measured)
    held = parts.groupBy("site").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("part", "earned")))).alias("parts"))  # at most eight
    return site_score(parts).join(held, "site").join(pages.groupBy("site").agg(F.count("*").alias("pages")), "site")


def site_names(pages: DataFrame, share: float = 0.5) -> DataFrame:
    """(site, name): the part of titles, set off by a bar or dash, that most pages of a site share."""
    part = pages.select("site", "page_id", F.explode(F.array_distinct(F.transform(F.split("title", r"\s+[|·–—»-]\s+"), lambda x: F.trim(x)))).alias("name")).where("name <> ''")
    n = pages.groupBy("site").agg(F.count("*").alias("pages"))
    seen = part.groupBy("site", "name").agg(F.count("*").alias("on")).join(n, "site").where((F.col("on") >= 2) & (F.col("on") >= share * F.col("pages")))
    return seen.groupBy("site").agg(F.max_by("name", F.struct("on", -F.length("name"), "name")).alias("name"))


def precision_recall(found: Column, wanted: Column) -> Column:
    """struct<precision, recall, f1> of two arrays as sets."""
    common = F.size(F.array_intersect(found, wanted))
    p, r = common / F.nullif(F.size(F.array_distinct(found)), F.lit(0)), common / F.nullif(F.size(F.array_distinct(wanted)), F.lit(0))
    p, r = F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"))


def token_f1(found: Column, wanted: Column) -> Column:
    """F1 over token multisets: equal tokens are told apart by their number."""
    numbered = lambda c: T.bound(T.tokenize(c), lambda w: F.transform(w, lambda t, i: F.concat(t, F.lit("#"), F.size(F.filter(F.slice(w, F.lit(1), i + 1), lambda x: x == t)).cast("string"))))
    return precision_recall(numbered(found), numbered(wanted))["f1"]


def consensus(texts: DataFrame, votes: int = 2, size: int = 5) -> DataFrame:
    """(id, shingle) on which at least `votes` extractors (id, extractor, text) agree."""
    words = F.filter(F.split(F.lower("text"), r"\W+"), lambda w: w != "")
    s = texts.select("id", "extractor", F.explode(T.shingles(words, size)).alias("shingle"))
    return s.groupBy("id", "shingle").agg(F.count_distinct("extractor").alias("n")).where(F.col("n") >= votes).select("id", "shingle")


def inversions(order: DataFrame) -> DataFrame:
    """(page_id, pairs, inverted): neighbours in true order that a produced order turns round; order is (page_id, truth, produced)."""
    after = F.lead("produced").over(Window.partitionBy("page_id").orderBy("truth"))
    return order.withColumn("_n", after).where("_n is not null").groupBy("page_id").agg(F.count("*").alias("pairs"), F.sum((F.col("_n") < F.col("produced")).cast("int")).alias("inverted"))
