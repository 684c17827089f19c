"""Machine-readable signals of a site: headers, licences, llms files, findings and proposals; and versions' ages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link_header(value: Column) -> Column:
    """array<struct<url, rel, params>> of a Link header."""
    parts = F.regexp_extract_all(value, F.lit(r"(<[^>]*>[^,<]*)"), F.lit(1))
    params = lambda p: F.str_to_map(F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"^<[^>]*>\s*;?\s*", ""), r"\s*;\s*", ";"), '"', ""), F.lit(";"), F.lit("="))
    return F.transform(parts, lambda p: F.struct(F.regexp_extract(p, "^<([^>]*)>", 1).alias("url"), F.regexp_extract(p, r'rel="?([^";]+)', 1).alias("rel"), params(p).alias("params")))


def robots_tokens(values: Column) -> Column:
    """Distinct directives of robots headers or metas, lower-case."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(values), ","), lambda t: F.trim(t)), lambda t: t != ""))


def content_signals(files: DataFrame) -> DataFrame:
    """(origin, name, value) of Content-Signal lines in robots texts (origin, body)."""
    lines = files.select("origin", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*content-signal:\s*(.+)$"), F.lit(1))).alias("line"))
    return lines.select("origin", F.explode(F.split("line", r"\s*,\s*")).alias("p")).select("origin", F.lower(F.trim(F.split_part("p", F.lit("="), F.lit(1)))).alias("name"), F.lower(F.trim(F.split_part("p", F.lit("="), F.lit(2)))).alias("value"))


def licence_lines(files: DataFrame) -> DataFrame:
    return files.select("origin", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*license:\s*(\S+)"), F.lit(1))).alias("licence"))


def is_llms_file(status: Column, content_type: Column, body: Column) -> Column:
    return (status == 200) & ~F.coalesce(content_type, F.lit("")).contains("html") & ~F.lower(body).rlike(r"^\s*<(!doctype|html)") & body.rlike(r"(?m)^#\s+\S")


def llms_links(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"\[[^\]]*\]\(([^()\s]+)\)"), F.lit(1)))


def script_links(source: Column, most: int = 60) -> Column:
    """Distinct addresses that scripts hold under a key, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(source, F.lit(r"""["']?(?:url|href|link|src|path|to)["']?\s*:\s*["']((?:https?://|/)[^"'\s<>]+)["']"""), F.lit(1))), 1, most)


def stack_ages(technologies: DataFrame, releases: DataFrame, today: str, old_years: float = 3.0) -> DataFrame:
    """(page_id, technology, version, years, old) against a table of releases (technology, version, released)."""
    joined = technologies.join(releases, ["technology", "version"])
    years = F.datediff(F.lit(today).cast("date"), F.col("released")) / 365.25
    return joined.select("page_id", "technology", "version", F.round(years, 2).alias("years"), (years >= old_years).alias("old"))


def joined_headers(headers: DataFrame) -> DataFrame:
    """(url, name, value): repeated headers (url, seq, name, value) joined with a comma in their order, names lower-case."""
    h = headers.select("url", "seq", F.lower("name").alias("name"), F.trim("value").alias("value"))
    return h.groupBy("url", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"]), ", ").alias("value"))


def content_usage(files: DataFrame) -> DataFrame:
    """(origin, path, category, value) of Content-Usage lines: a path is optional, y and n are yes and no."""
    lines = files.select("origin", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*content-usage:\s*(.+)$"), F.lit(1))).alias("line"))
    path = F.when(F.col("line").startswith("/"), F.regexp_extract("line", r"^(\S+)", 1))
    rest = F.when(F.col("line").startswith("/"), F.regexp_extract("line", r"^\S+\s+(.*)$", 1)).otherwise(F.col("line"))
    pairs = lines.select("origin", path.alias("path"), F.explode(F.split(rest, r"\s*,\s*")).alias("p"))
    value = F.lower(F.trim(F.split_part("p", F.lit("="), F.lit(2))))
    return pairs.select("origin", "path", F.lower(F.trim(F.split_part("p", F.lit("="), F.lit(1)))).alias("category"), F.when(value == "y", "yes").when(value == "n", "no").otherwise(value).alias("value")).where("category <> '' and value <> ''")


#: What an owner allows or declines by each signal.
MEANINGS = {"search": "index it for search", "ai-input": "use it as input to AI answers", "ai-train": "train AI models on it"}


def signal_meaning(values: Column) -> Column:
    """A sentence for a map of content signals to yes or no; null if it holds none that is known."""
    said = lambda v: F.filter(F.array(*(F.when(values[F.lit(k)] == v, F.lit(text)) for k, text in MEANINGS.items())), lambda x: x.isNotNull())
    yes, no = F.array_join(said("yes"), " and "), F.array_join(said("no"), " or ")
    return F.when((yes != "") & (no != ""), F.concat(F.lit("AI systems may "), yes, F.lit(", but should not "), no, F.lit("."))).when(yes != "", F.concat(F.lit("AI systems may "), yes, F.lit("."))).when(no != "", F.concat(F.lit("AI systems should not "), no, F.lit(".")))


#: The machine-readable signals of a site by group, and where each is looked for: a robots line, a header, a head field, a
#: payload, or a file under the root.
SIGNALS = (
    ("content_signal", "rules", "robots", r"(?im)^\s*content-signal:"), ("content_usage", "rules", "robots", r"(?im)^\s*content-usage:"), ("rsl", "rules", "robots", r"(?im)^\s*license:"), ("sitemap", "discovery", "robots", r"(?im)^\s*sitemap:"),
    ("tdm", "rules", "header", "tdm-reservation"), ("link_header", "discovery", "header", "link"), ("robots_header", "rules", "header", "x-robots-tag"),
    ("noai", "rules", "meta", "noai"), ("robots_meta", "rules", "meta", "robots"), ("canonical", "metadata", "meta", "canonical"), ("hreflang", "metadata", "meta", "hreflang:"), ("open_graph", "metadata", "meta", "og:"), ("json_ld", "metadata", "payload", "json-ld"),
    ("llms_txt", "files", "file", "/llms.txt"), ("ai_txt", "files", "file", "/ai.txt"), ("indexnow", "discovery", "file", "/indexnow.txt"), ("agent_card", "agents", "file", "/.well-known/agent-card.json"), ("agents_json", "agents", "file", "/agents.json"), ("mcp", "agents", "file", "/.well-known/mcp.json"),
    ("api_catalog", "agents", "file", "/.well-known/api-catalog"), ("security_txt", "trust", "file", "/.well-known/security.txt"), ("humans_txt", "trust", "file", "/humans.txt"), ("manifest", "trust", "file", "/manifest.json"), ("feeds", "discovery", "file", "/feed"),
)


def collect_signals(roots: DataFrame, robots: DataFrame, headers: DataFrame, files: DataFrame) -> DataFrame:
    """(site, signal, group, present): the machine-readable signals of each site.

    roots is (site, meta, payloads) of its first page, robots is (site, body), headers is (site, name, value) and files is
    (site, path, status).
    """
    h = headers.groupBy("site").agg(F.collect_set(F.lower("name")).alias("_h"))
    f = files.where("status = 200").groupBy("site").agg(F.collect_set("path").alias("_f"))
    r = robots.groupBy("site").agg(F.first("body").alias("_r"))
    s = roots.join(r, "site", "left").join(h, "site", "left").join(f, "site", "left")
    none = F.array().cast("array<string>")
    keys = F.map_keys("meta")
    test = {
        "robots": lambda x: F.coalesce(F.col("_r"), F.lit("")).rlike(x),
        "header": lambda x: F.array_contains(F.coalesce("_h", none), x),
        "meta": lambda x: F.exists(F.map_values(F.map_filter("meta", lambda k, v: k == "robots")), lambda v: F.lower(v).contains("noai")) if x == "noai" else F.exists(keys, lambda k: k.startswith(x) if x.endswith(":") else k == x),
        "payload": lambda x: F.exists("payloads", lambda p: p["source"] == x),
        "file": lambda x: F.array_contains(F.coalesce("_f", none), x),
    }
    return s.select("site", F.inline(F.array(*(F.struct(F.lit(k).alias("signal"), F.lit(g).alias("group"), F.coalesce(test[where](x), F.lit(False)).alias("present")) for k, g, where, x in SIGNALS))))


def suggest_robots(host: str, sitemap: str | None, decline_training: bool, trainers: tuple[str, ...] = ("GPTBot", "ClaudeBot", "CCBot", "Google-Extended", "Applebot-Extended", "Bytespider", "meta-externalagent")) -> str:
    """A commented robots.txt: everything open, or open to search and assistants but not to training."""
    lines = [f"# robots.txt for {host}", "# Everyone may read everything that is not listed below.", "User-agent: *", "Allow: /", ""]
    if decline_training:
        lines += ["# Crawlers that gather training data are asked to stay away.", *(f"User-agent: {t}" for t in trainers), "Disallow: /", "", "Content-Signal: search=yes, ai-input=yes, ai-train=no"]
    else:
        lines += ["Content-Signal: search=yes, ai-input=yes, ai-train=yes"]
    return "\n".join([*lines, *(["", f"Sitemap: {sitemap}"] if sitemap else []), ""])


def suggest_security(host: str, contact: str, expires: str) -> str:
    return f"Contact: {contact}\nExpires: {expires}\nPreferred-Languages: en\nCanonical: https://{host}/.well-known/security.txt\n"


def suggest_llms(pages: DataFrame) -> DataFrame:
    """(section, pos, line): lines of an llms.txt, a heading and its pages for each section; a section's lines stay rows, so
    a site of any size is written as it is read."""
    section = F.coalesce(F.nullif(F.regexp_extract("url", r"^https?://[^/]+/([^/?#]+)/", 1), F.lit("")), F.lit("pages"))
    line = F.concat(F.lit("- ["), F.coalesce("title", "url"), F.lit("]("), "url", F.lit(")"))
    rows = pages.select(section.alias("section"), F.col("url").alias("pos"), line.alias("line"))
    return rows.unionByName(rows.select("section").distinct().select("section", F.lit("").alias("pos"), F.concat(F.lit("## "), "section").alias("line"))).orderBy("section", "pos")
