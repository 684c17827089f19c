"""Text functions on columns: folding, tokens, words, shingles, hashes, names, numbers, noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token of retrieval, and scripts whose characters count as words of their own.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9'_-]*"
WIDE = r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}\p{IsHangul}\p{IsThai}]"


def fold_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def chrome_key(text: Column) -> Column:
    """Space-folded, lower-case: the key of cross-page chrome."""
    return F.lower(fold_space(text))


def block_key(text: Column) -> Column:
    """All white space removed, lower-case: the key of duplicates within a page."""
    return F.lower(F.regexp_replace(text, r"\s", ""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    """Runs of non-space, where every character of a script without spaces counts as one."""
    wide = F.length(text) - F.length(F.regexp_replace(text, WIDE, ""))
    return F.size(F.regexp_extract_all(F.regexp_replace(text, WIDE, " "), F.lit(r"\S+"), F.lit(0))) + wide


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body and its lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingles(words: Column, size: int) -> Column:
    """Distinct runs of `size` words, joined by a space; none for fewer words."""

    def runs(w):
        return F.when(F.size(w) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " ")))).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def snake_case(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"([a-z0-9])([A-Z])", "$1_$2"), r"[^A-Za-z0-9]+", "_"), r"^_+|_+$", ""))


def normalize_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^A-Za-z0-9]", ""))


def norm_name(name: Column) -> Column:
    """Name key: space folded, edge punctuation and possessive dropped, lower-case."""
    bare = F.regexp_replace(fold_space(name), r"^[\p{Punct}\s]+|[\p{Punct}\s]+$", "")
    return F.lower(F.regexp_replace(bare, r"['’]s$", ""))


def short_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16))


def name_grams(name: Column) -> Column:
    """Distinct character 3-grams of the padded name key."""
    padded = F.concat(F.lit("  "), norm_name(name), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def to_number(raw: Column) -> Column:
    """A price-like text as a number, whatever its separators; null where it is ambiguous or none."""
    kept = F.regexp_replace(F.regexp_replace(raw, r"[^0-9.,\- ]", ""), r"^[ .,]+|[ .,]+$", "")
    sign = F.when(kept.startswith("-"), -1.0).otherwise(1.0)
    n = F.trim(F.regexp_replace(kept, "^-", ""))
    grouped = n.rlike(r"^\d{1,3}([ .,]\d{3})+$")
    plain = n.rlike(r"^\d+$")
    decimal = n.rlike(r"^(\d+|\d{1,3}([ .,]\d{3})+)[.,]\d{1,2}$")
    whole, part = F.regexp_extract(n, r"^(.*)[.,](\d{1,2})$", 1), F.regexp_extract(n, r"[.,](\d{1,2})$", 1)
    digits = lambda c: F.regexp_replace(c, r"[ .,]", "")
    return sign * F.when(plain, n.try_cast("double")).when(grouped, digits(n).try_cast("double")).when(decimal, F.concat(digits(whole), F.lit("."), part).try_cast("double"))


MONTHS = "january february march april may june july august september october november december".split()


def _passing() -> str:
    """What changes on a page although the page does not, as token classes: dates, clock times, ages, counters, bare
    amounts, stamps, years of rights."""
    month = "(?:" + "|".join(f"{m[:3]}t?(?:{m[3:]})?" for m in MONTHS) + r")\b\.?"
    nth, year = r"\d{1,2}(?:\p{L}{2})?", r"\d{2,4}"
    number = r"\d+(?:[.,]\d+)*"
    counted = r"(?:(?:page|unique)\s+)?(?:counter|hits?|members?|users?|views?|visitors?|visits?)(?:\s+online)?|online"
    stamp = "|".join(("generat", "modifi", "post", "publish", "refresh", "revis", "updat"))
    unit = "second|minute|hour|day|week|month|year"
    classes = {
        "numeric date": r"\b\d{1,4}([-/.])\d{1,2}\1\d{1,4}",
        "written date": rf"\b{nth}\s+{month},?(?:\s+{year})?\b|\b{month}\s+{nth}(?:,?\s+{year})?\b",
        "clock": r"(?:\b|T)\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*[ap]\.?m\b\.?|Z|[+-]\d{2}:?\d{2})?",
        "age": rf"\b(?:{number}|an?)\s+(?:{unit})s?\s+ago\b|\bjust\s+now\b",
        "counter": rf"\b(?:{counted})\b\s*:?\s*{number}|\b{number}\s*(?:{counted})\b",
        "stamp": rf"\b(?:last\s+)?(?:{stamp})(?:ed|d)\b(?:\s+(?:at|by|in|on))?:?",
        "rights": rf"(?:©|\(c\)|\bcopyright\b)\s*(?:©|\(c\))?\s*{year}(?:\s*[-–]\s*{year})?",
        "amount": r"\b\d{1,3}(?:,\d{3})+\b|\b\d{4,}\b",
    }
    return "|".join(f"(?:{c})" for c in classes.values())


NOISE = (_passing(),)


def is_noise(block: Column, extra: tuple[str, ...] = (), least: int = 3) -> Column:
    """A block that matches a noise pattern and has fewer than `least` words of two letters without it."""
    rest = block
    for pattern in (*NOISE, *extra):
        rest = F.regexp_replace(rest, "(?i)" + pattern, " ")
    words = F.size(F.regexp_extract_all(rest, F.lit(r"\p{L}{2,}"), F.lit(0)))
    return (rest != block) & (words < least)
