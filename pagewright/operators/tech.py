"""Technology rules over pages: a literal test before each regular expression, versions, and implied technologies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of our own choosing: name, category, literal that any match holds, pattern (group 1 is the version, if any).
RULES = (
    ("WordPress", "cms", "wp-content", r"/wp-content/(?:themes|plugins)/"),
    ("WordPress", "cms", "wordpress", r"<meta[^>]+generator[^>]+wordpress ?([\d.]*)"),
    ("Drupal", "cms", "drupal", r"(?:drupal-settings-json|/sites/default/files|generator[^>]+drupal ?([\d.]*))"),
    ("Joomla", "cms", "joomla", r"<meta[^>]+generator[^>]+joomla"),
    ("MediaWiki", "cms", "mediawiki", r"<meta[^>]+generator[^>]+mediawiki ?([\d.]*)"),
    ("Shopify", "shop", "cdn.shopify.com", r"cdn\.shopify\.com"),
    ("WooCommerce", "shop", "woocommerce", r"/plugins/woocommerce/|woocommerce-page"),
    ("Magento", "shop", "mage", r"mage/cookies|magento_"),
    ("Next.js", "framework", "__next", r"id=\"__next_?data__?\"|/_next/static/"),
    ("Nuxt", "framework", "__nuxt", r"window\.__nuxt__|id=\"__nuxt\""),
    ("React", "library", "react", r"data-reactroot|react(?:-dom)?(?:\.production)?[.@/-]([\d.]*)[^\"']*\.js"),
    ("Vue.js", "library", "vue", r"data-v-[0-9a-f]{6,8}|vue(?:\.runtime)?[.@/-]([\d.]*)[^\"']*\.js"),
    ("Angular", "framework", "ng-version", r"ng-version=\"([\d.]+)\""),
    ("jQuery", "library", "jquery", r"jquery[.@/-]([\d.]*?)(?:\.min|\.slim)*\.js"),
    ("Bootstrap", "library", "bootstrap", r"bootstrap[.@/-]([\d.]*?)(?:\.min|\.bundle)*\.(?:css|js)"),
    ("Google Analytics", "analytics", "google", r"google-analytics\.com/|googletagmanager\.com/gtag"),
    ("Matomo", "analytics", "matomo", r"matomo\.(?:js|php)"),
    ("Cloudflare", "cdn", "cloudflare", r"cdnjs\.cloudflare\.com|/cdn-cgi/"),
    ("Inline tracker", "analytics", "track(", r"<script>[^<]*track\("),
    ("HTML5", "markup", "<!doctype html>", r"<!doctype html>"),
)
#: Technologies that others stand on.
IMPLIES = (("WooCommerce", "WordPress"), ("Next.js", "React"), ("Nuxt", "Vue.js"), ("WordPress", "PHP"), ("Drupal", "PHP"), ("Joomla", "PHP"), ("MediaWiki", "PHP"), ("Magento", "PHP"))


#: Rules over what a page is served with and loads: name, category, signal, key (a header's or cookie's name), pattern. A
#: table of any size in this form can be given instead.
SIGNAL_RULES = (
    ("nginx", "server", "header", "server", r"nginx(?:/([\d.]+))?"), ("Apache", "server", "header", "server", r"apache(?:/([\d.]+))?"), ("Microsoft IIS", "server", "header", "server", r"microsoft-iis(?:/([\d.]+))?"), ("LiteSpeed", "server", "header", "server", r"litespeed"), ("Caddy", "server", "header", "server", r"caddy"), ("Envoy", "server", "header", "server", r"envoy"),
    ("PHP", "language", "header", "x-powered-by", r"php(?:/([\d.]+))?"), ("Express", "framework", "header", "x-powered-by", r"express"), ("ASP.NET", "framework", "header", "x-powered-by", r"asp\.net"), ("Next.js", "framework", "header", "x-powered-by", r"next\.js(?: ([\d.]+))?"),
    ("Cloudflare", "cdn", "header", "cf-ray", r"."), ("Fastly", "cdn", "header", "x-served-by", r"cache-"), ("Amazon CloudFront", "cdn", "header", "x-amz-cf-id", r"."), ("Vercel", "hosting", "header", "x-vercel-id", r"."), ("Netlify", "hosting", "header", "x-nf-request-id", r"."), ("Varnish", "cache", "header", "via", r"varnish"),
    ("PHP", "language", "cookie", "phpsessid", r""), ("Java", "language", "cookie", "jsessionid", r""), ("Laravel", "framework", "cookie", "laravel_session", r""), ("Django", "framework", "cookie", "csrftoken", r""), ("ASP.NET", "framework", "cookie", "asp.net_sessionid", r""), ("Google Analytics", "analytics", "cookie", "_ga", r""),
    ("jQuery", "library", "asset", "", r"jquery[.@/-]([\d.]*\d)?[^/]*\.js"), ("Bootstrap", "library", "asset", "", r"bootstrap[.@/-]([\d.]*\d)?[^/]*\.(?:css|js)"), ("Font Awesome", "library", "asset", "", r"font-?awesome|fontawesome"), ("Google Fonts", "library", "asset", "", r"fonts\.googleapis\.com"), ("D3", "library", "asset", "", r"/d3(?:[.@-]v?([\d.]*\d))?[^/]*\.js"), ("Swiper", "library", "asset", "", r"swiper[^/]*\.(?:css|js)"),
    ("Stripe", "payment", "request", "", r"js\.stripe\.com"), ("PayPal", "payment", "request", "", r"paypal\.com/sdk"), ("Hotjar", "analytics", "request", "", r"static\.hotjar\.com"), ("Segment", "analytics", "request", "", r"cdn\.segment\.com"), ("Sentry", "monitoring", "request", "", r"sentry(?:-cdn)?\.(?:io|com)"), ("reCAPTCHA", "security", "request", "", r"google\.com/recaptcha"), ("Intercom", "support", "request", "", r"widget\.intercom\.io"), ("YouTube", "media", "request", "", r"youtube(?:-nocookie)?\.com/embed"),
    ("React", "library", "global", "react", r""), ("Vue.js", "library", "global", "vue", r""), ("Angular", "framework", "global", "ng", r""), ("jQuery", "library", "global", "jquery", r""), ("Svelte", "library", "global", "__svelte", r""), ("Alpine.js", "library", "global", "alpine", r""), ("webpack", "build", "bundle", "", r"webpackchunk|__webpack_require__"), ("Vite", "build", "bundle", "", r"import\.meta\.hot|/@vite/"),
)
#: What a match by each signal is worth.
CONFIDENCE = {"header": 1.0, "global": 1.0, "request": 0.95, "cookie": 0.9, "asset": 0.85, "markup": 0.8, "bundle": 0.75}
ORDER = "cms shop framework library language server hosting cdn cache analytics payment monitoring security support media build markup implied".split()


def required_literals(pattern: str) -> list[set[str]]:
    """Clauses of lower-case literals: whatever matches the pattern, whatever its case, holds one literal of every clause."""

    def choices(node) -> set[str] | None:
        """Every text that a small node can match, or None if there are too many."""
        out = {""}
        for op, arg in node:
            name = str(op)
            if name == "LITERAL":
                more = {chr(arg).lower()}
            elif name == "SUBPATTERN":
                more = choices(arg[3])
            elif name == "BRANCH":
                parts = [choices(b) for b in arg[1]]
                more = None if None in parts else set().union(*parts)
            elif name == "IN" and all(str(o) == "LITERAL" for o, _ in arg) and len(arg) <= 4:
                more = {chr(a).lower() for _, a in arg}
            elif name == "AT":
                continue
            else:
                return None
            if more is None or len(out) * len(more) > 16:
                return None
            out = {a + b for a in out for b in more}
        return out

    clauses: list[set[str]] = []

    def walk(node) -> None:
        run = {""}

        def end() -> None:
            nonlocal run
            if "" not in run:
                clauses.append(run)
            run = {""}

        for op, arg in node:
            one = choices([(op, arg)]) if str(op) != "AT" else {""}
            if one is not None and len(run) * len(one) <= 16:
                run = {a + b for a in run for b in one}
                continue
            end()
            if one is not None:
                run = one
            elif str(op) == "SUBPATTERN":
                walk(arg[3])
            elif str(op) in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
                walk(arg[2])
        end()

    walk(re._parser.parse(pattern))
    return clauses


def best_clause(pattern: str) -> set[str]:
    """The most selective clause: that with the longest shortest literal; empty if a match needs no literal."""
    return max(required_literals(pattern), key=lambda c: (min(map(len, c)), -len(c)), default=set())


def prefiltered(text: Column, lowered: Column, pattern: str) -> Column:
    """rlike behind a test for literals that it cannot match without."""
    literals = sorted(best_clause(pattern))
    found = lowered.rlike(pattern)
    return reduce(lambda a, b: a | b, (lowered.contains(x) for x in literals)) & found if literals and min(map(len, literals)) > 1 else found


def _version(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1) if re.compile(pattern).groups else F.lit("")


def detect(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, technology, category, version, implied): one scan tests all rules, each behind its literal."""
    lowered = F.lower(html)
    tests = [F.when(F.col("_l").contains(lit) & F.col("_l").rlike(p), F.struct(F.lit(name).alias("technology"), F.lit(kind).alias("category"), _version(F.col("_l"), p).alias("version"))) for name, kind, lit, p in RULES]
    found = pages.select("page_id", lowered.alias("_l")).select("page_id", F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("t")).select("page_id", "t.*")
    found = found.groupBy("page_id", "technology").agg(F.min("category").alias("category"), F.max("version").alias("version"))
    return close(found.withColumn("implied", F.lit(False)))


def assets(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, asset, same_site): addresses of scripts, styles and pictures of each page, distinct."""
    found = F.array_distinct(F.regexp_extract_all(html, F.lit(r"""(?is)<(?:script|link|img)\b[^>]*?\b(?:src|href)\s*=\s*["']?([^"'\s>]+)"""), F.lit(1)))
    a = pages.select("page_id", "url", F.explode(found).alias("asset"))
    own = ~F.col("asset").rlike(r"^(?i)(?:https?:)?//") | (F.regexp_extract("asset", r"^(?:https?:)?//(?:www\.)?([^/?#]+)", 1) == F.regexp_extract("url", r"^https?://(?:www\.)?([^/?#]+)", 1))
    return a.select("page_id", "asset", own.alias("same_site"))


def detect_signals(signals: DataFrame, rules=SIGNAL_RULES) -> DataFrame:
    """(page_id, technology, category, version, confidence) from signals (page_id, signal, key, value): headers, cookies,
    assets, requests, globals and bundle sources, each row tested against the rules of its kind in one expression."""
    s = signals.select("page_id", "signal", F.lower("key").alias("key"), F.lower(F.coalesce("value", F.lit(""))).alias("value"))
    tests = []
    for name, kind, signal, key, pattern in rules:
        hit = (F.col("signal") == signal) & ((F.col("key") == key) if key else F.lit(True))
        if pattern and pattern != ".":
            hit = hit & prefiltered(F.col("value"), F.col("value"), pattern)
        tests.append(F.when(hit, F.struct(F.lit(name).alias("technology"), F.lit(kind).alias("category"), (_version(F.col("value"), pattern) if pattern else F.lit("")).alias("version"), F.lit(CONFIDENCE.get(signal, 0.5)).alias("confidence"))))
    found = s.select("page_id", F.explode(F.filter(F.array(*tests), lambda t: t.isNotNull())).alias("t")).select("page_id", "t.*")
    return merge_technologies(found)


def merge_technologies(found: DataFrame) -> DataFrame:
    """One row a page and technology: the most specific version, the highest confidence, the first category in order."""
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("category"))
    best = found.groupBy("page_id", "technology").agg(F.min_by("category", F.struct(F.when(place > 0, place).otherwise(len(ORDER) + 1), "category")).alias("category"), F.max_by("version", F.struct(F.length("version"), "version")).alias("version"), F.max("confidence").alias("confidence"))
    return best.select("page_id", "technology", "category", "version", "confidence")


def profile_pages(pages: DataFrame, parsed: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """(page_id, frameworks, technologies, has_json_ld, has_microdata, has_state, requires_render): what each page is built
    with, and whether it needs a browser."""
    found = detect(pages).withColumn("confidence", F.lit(CONFIDENCE["markup"])).drop("implied")
    if signals is not None:
        found = merge_technologies(found.unionByName(detect_signals(signals)))
    t = found.groupBy("page_id").agg(F.sort_array(F.collect_set("technology")).alias("technologies"), F.sort_array(F.collect_set(F.when(F.col("category") == "framework", F.col("technology")))).alias("frameworks"))
    has = lambda *kinds: F.exists("payloads", lambda p: p["source"].isin(*kinds))
    words = F.aggregate("blocks", F.lit(0), lambda n, b: n + F.length(b["text"]))
    p = parsed.select("page_id", has("json-ld").alias("has_json_ld"), has("microdata").alias("has_microdata"), has("next-data", "rsc-flight", "nuxt", "initial-state").alias("has_state"), words.alias("_chars"))
    j = pages.select("page_id", "html").join(p, "page_id").join(t, "page_id", "left")
    none = F.array().cast("array<string>")
    return j.select("page_id", F.coalesce("frameworks", none).alias("frameworks"), F.coalesce("technologies", none).alias("technologies"), "has_json_ld", "has_microdata", "has_state", needs_render(F.col("html"), F.col("_chars")).alias("requires_render"))


def close(found: DataFrame) -> DataFrame:
    """With everything implied, over all steps: the closure of the small rule table is taken beforehand."""
    reach = {a: {b} for a, b in IMPLIES} and reduce(lambda acc, ab: acc | {ab[0]: acc.get(ab[0], set()) | {ab[1]}}, IMPLIES, {})
    for _ in reach:
        reach = {a: bs | {c for b in bs for c in reach.get(b, ())} for a, bs in reach.items()}
    rows = [(a, b) for a, bs in sorted(reach.items()) for b in sorted(bs)]
    table = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in rows))
    more = found.select("page_id", F.explode(F.filter(table, lambda r: r["a"] == F.col("technology"))).alias("r")).select("page_id", F.col("r.b").alias("technology")).distinct()
    more = more.join(found, ["page_id", "technology"], "left_anti")
    return found.unionByName(more.select("page_id", "technology", F.lit("implied").alias("category"), F.lit("").alias("version"), F.lit(True).alias("implied")))


def needs_render(html: Column, text_length: Column) -> Column:
    """Whether a page's text probably comes from scripts only: an empty application root, a wish for scripts, no text at
    all beside scripts, little text in much markup, or little text beside an application's data."""
    low = F.lower(html)
    root = low.rlike(r"<div id=[\"']?(?:root|app|__next|__nuxt)[\"']?>\s*</div>")
    asks = (text_length < 500) & low.rlike(r"<noscript>[^<]{0,200}(?:enable|requires?|turn on|need)[^<]{0,60}javascript")
    scripts = low.contains("<script")
    thin = (text_length < 200) & (F.length(html) > 20 * F.greatest(text_length, F.lit(1))) & scripts
    state = (text_length < 200) & low.rlike(r"__next_data__|__nuxt__|__initial_state__|__apollo_state__")
    return root | asks | ((text_length == 0) & scripts) | thin | state
