"""Walls: pages that answer with a block, a challenge or a login instead of content; and addresses that must not be fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import urls as U

# The longest block page, the longest login page, and parameters that bring a visitor back.
BLOCK_CHARS, LOGIN_WORDS, PAGE_WORDS = 1500, 150, 20
RETURN_KEYS = "dest next redirect redirectto redirecturi redirecturl return returnto returnurl continue sessionredirect goto".split()
#: Marks of our own choosing in the markup of challenges, by vendor; and phrases that give a wall away.
VENDORS = (("cloudflare", "cf-challenge|challenge-platform|cf_chl_"), ("akamai", "_abck|akam/1"), ("datadome", "datadome"), ("perimeterx", "px-captcha|_pxhd"), ("imperva", "_incapsula_|incapsula incident"), ("recaptcha", "g-recaptcha"), ("hcaptcha", "h-captcha"))
PHRASES = ("access denied", "verify you are human", "checking your browser", "enable javascript and cookies", "unusual traffic", "are you a robot", "request blocked", "too many requests")
# What statuses say.
STATUS = {401: "sign-in required", 402: "payment required", 403: "refused", 429: "rate limited", 451: "legal reasons", 503: "too busy"}


def challenge_vendor(html: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(VENDORS):
        out = F.when(F.lower(html).rlike(pattern), name).otherwise(out)
    return out


def block_evidence(text: Column) -> Column:
    """The phrase that gives a short page away as a wall, null if there is none."""
    found = F.regexp_extract(F.lower(text), "(" + "|".join(PHRASES) + ")", 1)
    return F.when(F.length(text) <= BLOCK_CHARS, F.nullif(found, F.lit("")))


def returns_to(final: Column, requested: Column) -> Column:
    """Whether the final address names the requested one in a return parameter."""
    value = F.regexp_extract(final, "(?i)[?&](?:" + "|".join(RETURN_KEYS) + r")=([^&#]+)", 1)
    decoded = F.coalesce(F.try_url_decode(value), value)
    return (value != "") & (F.contains(decoded, U.path(requested)) | F.contains(requested, decoded))


def login_redirect(requested: Column, final: Column, words: Column) -> Column:
    return ~U.same_page(requested, final) & U.is_login_path(final) & (words <= LOGIN_WORDS) & (returns_to(final, requested) | ~U.is_login_path(requested))


def wall(status: Column, html: Column, text: Column, requested: Column, final: Column, words: Column) -> Column:
    """The first reason not to take a page for content: status, challenge, login or phrase; null for a page."""
    said = F.lit(None).cast("string")
    for code, meaning in STATUS.items():
        said = F.when(status == code, meaning).otherwise(said)
    vendor = challenge_vendor(html)
    login = F.when(login_redirect(requested, final, words), "login")
    return F.coalesce(said, F.when(words < PAGE_WORDS, F.concat(F.lit("challenge: "), vendor)), login, F.concat(F.lit("block page: "), block_evidence(text)))


def is_public(url: Column) -> Column:
    """Whether a host may be fetched: no loopback, private, link-local, reserved or metadata address, no bare or local name."""
    h = U.host(url)
    private = r"^(127|10|0)\.|^192\.168\.|^172\.(1[6-9]|2\d|3[01])\.|^169\.254\.|^100\.(6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|^(22[4-9]|2[3-5]\d)\.|^198\.1[89]\."
    literal = h.rlike(r"^(\d+|0x[0-9a-f]+)$") | h.rlike(r"^\[(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:.*)\]$")
    local = ~h.contains(".") & ~h.startswith("[") | h.rlike(r"(^|\.)(localhost|local|internal|lan)$")
    return (h != "") & ~h.rlike(private) & ~literal & ~local


def walls(pages: DataFrame) -> DataFrame:
    """(page_id, wall) for (page_id, status, html, text, requested, url, words)."""
    return pages.select("page_id", wall(F.col("status"), F.col("html"), F.col("text"), F.col("requested"), F.col("url"), F.col("words")).alias("wall"))


#: What servers say that admit automated clients only by name.
DECLARE = r"(?i)undeclared automated|declare your (?:traffic|client|tool|automated)|user[- ]agent to include"


def declaration_demanded(said: Column) -> Column:
    """The sentence in which a server asks an automated client to say who runs it; null in any other answer."""
    sentence = F.when(said.rlike(DECLARE), F.trim(F.regexp_extract(said, r"(?i)([^.!?]*(?:" + DECLARE.removeprefix("(?i)") + r")[^.!?]*[.!?]?)", 1)))
    return F.substring(sentence, 1, 200)


def sanctioned(pages: DataFrame, hints: DataFrame) -> DataFrame:
    """(page_id, hint): what a site itself offers to programs, by hints (domain, hint) for a host or any domain above it; the
    longest domain decides."""
    labels = F.split(U.host(F.col("url")), r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    p = pages.select("page_id", above.alias("_d")).select("page_id", F.explode("_d").alias("domain"))
    return p.join(hints, "domain").groupBy("page_id").agg(F.max_by("hint", F.length("domain")).alias("hint"))
