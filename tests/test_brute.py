"""Queries that SQL cannot say, derived anew in plain Python from the pages of the table."""

import hashlib
import math
import re
from collections import defaultdict

import pytest
from conftest import SMALL

from pagewright import catalog
from pagewright.operators.knowledge import PATTERNS
from pagewright.operators.parse import read_page

catalog.load()


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    return {r.page_id: (r.url, read_page(r.html, r.url)) for r in rows}


def squeeze(text):
    return re.sub(r"\s", "", text).lower()


def folded(text):
    return re.sub(r"\s+", " ", text).strip().lower()


def host(url):
    return re.sub(r"^www\.", "", re.match(r"https?://([^/?#:]+)", url)[1].lower())


def deduped(blocks):
    first = {}
    for b in blocks:
        k = (squeeze(b["text"]), b["href"] or "")
        rank = ((b["kind"] == "heading") + b["in_main"], -b["pos"])
        if k not in first or rank > first[k][0]:
            first[k] = (rank, b["pos"])
    kept = []
    for i, b in enumerate(blocks):
        again = b["kind"] in ("table", "code") and (i == 0 or squeeze(blocks[i - 1]["text"]) != squeeze(b["text"]))
        if squeeze(b["text"]) == "" or first[squeeze(b["text"]), b["href"] or ""][1] == b["pos"] or again:
            kept.append(b)
    return kept


def test_page_blocks(spark, pages):
    want = defaultdict(lambda: [0, 0])
    for p, (_, page) in pages.items():
        for b in deduped(page["blocks"]):
            want[p, b["kind"]][0] += 1
            want[p, b["kind"]][1] += len(b["text"].split())
    assert {(r.page_id, r.kind): [r.blocks, r.words] for r in catalog.QUERIES["page_blocks"](spark, SMALL).collect()} == dict(want)


def test_page_hashes(spark, pages):
    got = {r.page_id: (r.content_hash, r.chars) for r in catalog.QUERIES["page_hashes"](spark, SMALL).collect()}
    for p, (_, page) in pages.items():
        blocks = page["blocks"]
        every = "\n\n".join(b["text"] for b in blocks if b["kind"] != "rule")
        text = "\n\n".join(b["text"] for b in blocks if b["kind"] not in ("image", "media", "rule"))
        assert got[p] == (hashlib.sha256(every.encode()).hexdigest(), len(text))


def test_site_chrome_pages(spark, pages):
    sites = defaultdict(list)
    for p, (url, _) in pages.items():
        sites[host(url)].append(p)
    want = {}
    for site, members in sites.items():
        on, places, n = defaultdict(set), defaultdict(lambda: (set(), set())), len(members)
        for p in members:
            for b in pages[p][1]["blocks"]:
                on[folded(b["text"])].add(p)
                places[b["xpath"]][0].add(p)
                places[b["xpath"]][1].add(folded(b["text"]))
        enough = n >= 6
        keys = {k for k, v in on.items() if k and enough and len(v) >= max(2, math.floor(n * 0.9 + 1e-9))}
        slots = {x for x, (v, t) in places.items() if enough and len(t) <= 1 and len(v) >= max(2, math.floor(n * 0.6 + 1e-9))}
        for p in members:
            blocks, kept, seen = pages[p][1]["blocks"], [], 0
            for b in blocks:
                hit = folded(b["text"]) in keys or b["xpath"] in slots
                if not hit or (b["kind"] == "heading" and b["level"] <= 2 and seen == 0):
                    kept.append(b)
                seen += not hit
            total = max(1, sum(len(b["text"]) for b in blocks))
            if sum(len(b["text"]) for b in kept) / total < 0.5:
                kept = blocks
            if kept:
                want[p] = (site, len(blocks), len(kept), sum(len(b["text"]) for b in kept))
    got = {r.page_id: (r.site, r.blocks_total, r.blocks_kept, r.content_chars) for r in catalog.QUERIES["site_chrome_pages"](spark, SMALL).collect()}
    assert got == want


def test_page_sections(spark, pages):
    want = set()
    for p, (_, page) in pages.items():
        section, held, open_ = 0, {0: ("", 0, [])}, []
        for b in page["blocks"]:
            if b["kind"] == "heading":
                section += 1
                held[section] = (b["text"], b["level"], [])
            elif b["kind"] not in ("image", "media", "rule"):
                held[section][2].append(b["text"])
        for s, (heading, level, texts) in held.items():
            text = "\n\n".join(texts)
            if not text or len(text) + len(heading) < 40:
                continue
            parent = next((t for t, lv in reversed(open_) if 0 < lv < level), None)
            open_.append((s, level))
            pieces = [""]
            for part in text.split("\n\n"):
                if pieces[-1] and len(pieces[-1]) + len(part) + 2 > 6000:
                    pieces.append(part)
                else:
                    pieces[-1] = f"{pieces[-1]}\n\n{part}" if pieces[-1] else part
            want |= {(p, s, i, heading, level, parent, len(x)) for i, x in enumerate(pieces)}
    assert {tuple(r) for r in catalog.QUERIES["page_sections"](spark, SMALL).collect()} == want


def test_graph_expansion(spark):
    weight = {(r.source, r.target): float(r["count"]) for r in catalog.QUERIES["link_edges"](spark, SMALL).collect()}
    mass = defaultdict(float)
    for (a, _), w in weight.items():
        mass[a] += w
    total = {a: 1.0 for a, _ in weight}
    front = dict(total)
    for hop in (1, 2):
        got = defaultdict(float)
        for (a, b), w in weight.items():
            if a in front:
                got[b] += front[a] * w / mass[a] * 0.45**hop
        front = {k: v for k, v in got.items() if k not in total}
        for k, v in got.items():
            total[k] = total.get(k, 0.0) + v
    found = {r.id: r.score for r in catalog.QUERIES["graph_expansion"](spark, SMALL).collect()}
    assert set(found) == set(total) and all(abs(found[k] - v) < 2e-6 for k, v in total.items())


def test_document_entities(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    on = defaultdict(set)
    for kind, pattern in PATTERNS.items():
        plain = pattern.replace(r"\p{Lu}", "[A-ZÀ-ÖØ-Þ]").replace(r"\p{Ll}", "[a-zß-öø-ÿ]")
        for d in docs:
            for m in re.finditer(plain, d.text or ""):
                on[kind, m[0].lower()].add((d.doc_id, m.start()))
    got = {(r.type, r.name.lower()): (r.evidence, r.pages) for r in catalog.QUERIES["document_entities"](spark, SMALL).collect()}
    exact = {k: (len(v), len({d for d, _ in v})) for k, v in on.items() if k[0] in ("Money", "Date", "Email", "Phone")}
    assert {k: v for k, v in got.items() if k[0] in ("Money", "Date", "Email", "Phone")} == exact


def test_restated_and_repeated(spark, pages):
    """Long blocks that others restate, and repeated siblings: by all pairs of blocks and all paths."""
    want = set()
    for p, (_, page) in pages.items():
        runs = {}
        for b in page["blocks"]:
            w = b["text"].lower().split()
            if b["kind"] not in ("image", "media", "rule"):
                runs[b["pos"]] = (len(w), {tuple(w[i : i + 6]) for i in range(len(w) - 5)})
        for pos, (n, s) in runs.items():
            shared = [s & t for q, (_, t) in runs.items() if q != pos and s & t]
            if n >= 150 and shared and len(set().union(*shared)) >= 0.7 * len(s) and max(map(len, shared)) < 0.5 * len(s):
                want.add((p, pos))
    assert {tuple(r) for r in catalog.QUERIES["restated_blocks"](spark, SMALL).collect()} == want
    groups = set()
    for p, (_, page) in pages.items():
        inst, words, total = defaultdict(set), defaultdict(int), 0
        for b in page["blocks"]:
            n = len(b["text"].split())
            total += n
            parts = b["xpath"][1:].split("/")
            for i in range(1, len(parts) + 1) if n else ():
                t = "/".join(parts[: i - 1]) + "/" + re.sub(r"\[\d+\]$", "", parts[i - 1])
                inst[t].add("/".join(parts[:i]))
                words[t] += n
        groups |= {(p, t, len(v), words[t]) for t, v in inst.items() if len(v) >= 3 and words[t] >= 0.1 * total}
    assert {(r.page_id, r.template, r.instances, r.words) for r in catalog.QUERIES["repeated_siblings"](spark, SMALL).collect()} == groups
