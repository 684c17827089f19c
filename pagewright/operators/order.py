"""Reading order from measured boxes, as a pandas step for each page: recursive cuts along the widest gaps, in which the
parts of a repeated container (a card) stay together.

A box is (id, x, y, width, height). Boxes that only confuse a cut lose their measure first: upright rails in a gutter, and
textless backdrops under other boxes. What is not measured follows the block before it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Gaps in line units that part rows and columns, their floor in pixels, depth, and the share of boxes needed.
ROW_GAP, COLUMN_GAP, LEAST_GAP, DEPTH, MEASURED = 0.6, 1.0, 8.0, 24, 0.3
# Shape of a rail, boxes on a backdrop, bridging boxes of a tolerant cut, siblings and share of a card.
RAIL_ASPECT, BACKDROP, BRIDGES, SIBLINGS, CARD_SHARE = 8.0, 3, 0.04, 3, 0.2
STEP = re.compile(r"\[\d+\]")


class Box(NamedTuple):
    id: int
    x: float
    y: float
    width: float
    height: float

    def span(self, axis: int) -> tuple[float, float]:
        return (self.x, self.x + self.width) if axis == 0 else (self.y, self.y + self.height)


def overlap(a: Box, b: Box, axis: int) -> float:
    """How far two boxes share an axis; not positive if they do not."""
    (a0, a1), (b0, b1) = a.span(axis), b.span(axis)
    return min(a1, b1) - max(a0, b0)


def holds(outer: Box, inner: Box, slack: float = 0.5) -> bool:
    return all(outer.span(k)[0] - slack <= inner.span(k)[0] and inner.span(k)[1] <= outer.span(k)[1] + slack for k in (0, 1))


def bounds(boxes: list[Box], name: int) -> Box:
    x, y = min(b.x for b in boxes), min(b.y for b in boxes)
    return Box(name, x, y, max(b.x + b.width for b in boxes) - x, max(b.y + b.height for b in boxes) - y)


def line_unit(heights: list[float]) -> float:
    """The height of a line: the lower quartile of box heights."""
    known = sorted(h for h in heights if h > 0)
    return known[min(len(known) - 1, len(known) // 4)] if known else 16.0


def unmeasured(boxes: list[Box], silent: set[int], unit: float) -> set[int]:
    """Ids of rails and of textless boxes (silent) that lie under at least BACKDROP others."""
    out = {b.id for b in boxes if b.width <= unit and b.height >= RAIL_ASPECT * b.width}
    for b in boxes:
        if b.id in silent and b.id not in out:
            under = (o for o in boxes if o.id != b.id and holds(b, o))
            if sum(1 for _, _ in zip(under, range(BACKDROP), strict=False)) == BACKDROP:
                out.add(b.id)
    return out


def gaps(spans: list[tuple[float, float]], least: float) -> tuple[list[float], float]:
    """Middles of the widest gaps (to 95 %) between merged intervals, and the widest one's size."""
    found, reach = [], None
    for a, b in sorted(spans):
        if reach is not None and a - reach >= least:
            found.append((a - reach, (a + reach) / 2))
        reach = b if reach is None else max(reach, b)
    widest = max((g for g, _ in found), default=0.0)
    return [m for g, m in found if g >= 0.95 * widest], widest


def parted(boxes: list[Box], axis: int, cuts: list[float]) -> list[list[Box]]:
    out: list[list[Box]] = [[] for _ in range(len(cuts) + 1)]
    for b in boxes:
        out[sum(b[1 + axis] >= c for c in cuts)].append(b)
    return [p for p in out if p]


def tolerant(boxes: list[Box], least: float) -> tuple[list[list[Box]], list[Box]] | None:
    """Columns beside a gutter that few boxes bridge, and the bridging boxes; None if there is no such gutter."""
    spare = int(BRIDGES * len(boxes))
    if not spare:
        return None
    wide = sorted(boxes, key=lambda b: -b.width)[:spare]
    for n in range(1, spare + 1):
        bridging = {b.id for b in wide[:n]}
        rest = [b for b in boxes if b.id not in bridging]
        cuts, _ = gaps([b.span(0) for b in rest], least)
        if cuts:
            return parted(rest, 0, cuts), wide[:n]
    return None


def banded(boxes: list[Box], rtl: bool) -> list[Box]:
    """By rows that overlap by half of the smaller height, and across each row."""
    bands: list[list[Box]] = []
    for b in sorted(boxes, key=lambda b: (b.y, b.id)):
        if bands:
            row = bounds(bands[-1], -1)
            if overlap(row, b, 1) >= 0.5 * max(b.height, row.height):
                bands[-1].append(b)
                continue
        bands.append([b])
    return [b for band in bands for b in sorted(band, key=lambda b: (-(b.x + b.width) if rtl else b.x, b.id))]


def cut(boxes: list, unit: float, rtl: bool, depth: int = 0) -> list:
    """Boxes in reading order."""
    if len(boxes) < 2:
        return boxes
    boxes = [b if isinstance(b, Box) else Box(*b) for b in boxes]
    least = max(LEAST_GAP, COLUMN_GAP * unit)
    rows, row_gap = gaps([b.span(1) for b in boxes], max(LEAST_GAP, ROW_GAP * unit))
    columns, column_gap = gaps([b.span(0) for b in boxes], least)
    if depth < DEPTH and (rows or columns):
        by_columns = column_gap > row_gap
        parts = parted(boxes, 0, columns) if by_columns else parted(boxes, 1, rows)
        if by_columns and rtl:
            parts.reverse()
        if len(parts) > 1:
            return [b for p in parts for b in cut(p, unit, rtl, depth + 1)]
    if depth < DEPTH and (found := tolerant(boxes, least)):
        parts, bridging = found
        out = [b for p in (reversed(parts) if rtl else parts) for b in cut(p, unit, rtl, depth + 1)]
        for b in sorted(bridging, key=lambda b: b.y):  # a bridge stands before the first box below it
            at = next((i for i, o in enumerate(out) if o.y >= b.y), len(out))
            out.insert(at, b)
        return out
    return banded(boxes, rtl)


def columns_of(boxes: list[Box], unit: float) -> int:
    """Columns of a page: one more than its gutters from top to bottom."""
    return 1 + len(gaps([b.span(0) for b in boxes], max(LEAST_GAP, COLUMN_GAP * unit))[0]) if boxes else 0


def cards(boxes: list[Box], paths: dict[int, str], limit: int, within: str = "") -> dict[str, list[Box]]:
    """The boxes of each card: the outermost container below `within` of at least SIBLINGS alike, none of them too large."""
    siblings, sizes = defaultdict(set), defaultdict(int)
    for b in boxes:
        path = paths[b.id]
        for m in STEP.finditer(path, len(within)):
            siblings[path[: m.start()]].add(m[0])
            sizes[path[: m.end()]] += 1
    out = defaultdict(list)
    for b in boxes:
        path = paths[b.id]
        for m in STEP.finditer(path, len(within)):
            if len(siblings[path[: m.start()]]) >= SIBLINGS and sizes[path[: m.end()]] <= limit:
                out[path[: m.end()]].append(b)
                break
    return {k: v for k, v in out.items() if len(v) > 1}


def in_a_row(boxes: list[Box], unit: float) -> bool:
    """Whether boxes stand side by side: each shares rows with each other and keeps to one side of it."""
    by_x = sorted(boxes, key=lambda b: b.x)
    top, bottom = max(b.y for b in boxes), min(b.y + b.height for b in boxes)
    return len(boxes) >= SIBLINGS and top < bottom and all(a.x + a.width <= b.x + unit for a, b in zip(by_x, by_x[1:], strict=False))


def with_cards(boxes: list[Box], paths: dict[int, str], floats: dict[int, str], unit: float, rtl: bool, limit: int | None = None, within: str = "", depth: int = 0) -> list[Box]:
    """The cut over cards and loose boxes alike; each card is then ordered by itself.

    Within a card only rows of cards side by side are bound again: stacked ones are read rightly by their gaps.
    """
    limit = limit or max(1, int(CARD_SHARE * len(boxes)))
    groups = defaultdict(list)
    for b in boxes:
        if b.id in floats and not within:
            groups[floats[b.id]].append(b)
    groups = {k: v for k, v in groups.items() if len(v) > 1}
    floating = {b.id for v in groups.values() for b in v}
    found = cards([b for b in boxes if b.id not in floating], paths, limit, within)
    if within:
        rows = defaultdict(list)
        for k in found:
            rows[STEP.sub("", k)].append(k)
        found = {k: found[k] for keys in rows.values() if in_a_row([bounds(found[k], -1) for k in keys], unit) for k in keys}
    groups |= found
    if not groups or depth >= DEPTH:
        return cut(boxes, unit, rtl)
    owned = {b.id for v in groups.values() for b in v}
    names = {-2 - i: k for i, k in enumerate(groups)}
    whole = [b for b in boxes if b.id not in owned] + [bounds(groups[k], i) for i, k in names.items()]
    out = []
    for b in cut(whole, unit, rtl):
        out += with_cards(groups[names[b.id]], paths, floats, unit, rtl, limit, names[b.id], depth + 1) if b.id in names else [b]
    return out


def order_blocks(blocks: DataFrame, rects: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(page_id, pos, reading_pos, method, columns, differs) for blocks (page_id, pos, xpath[, text, float_of]), rects
    (page_id, xpath, x, y, width, height) and pages (page_id, rtl), whose pages are read from right to left if rtl.

    Pages with too few measured blocks keep document order (dom); unmeasured blocks follow the block before them
    (anchored); differs says that the order is not the document's.
    """

    def arrange(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("pos")
        known = page[page.x.notna() & (page.height > 0)]
        out = pd.DataFrame({"page_id": page.page_id, "pos": page.pos})
        if len(page) < 2 or not len(known):
            return out.assign(reading_pos=range(len(page)), method="single" if len(page) < 2 else "dom", columns=int(len(known) > 0), differs=False)
        boxes = [Box(*r) for r in known[["pos", "x", "y", "width", "height"]].itertuples(index=False, name=None)]
        unit = line_unit([b.height for b in boxes])
        silent = set(known[known.text.fillna("").str.strip() == ""].pos)
        gone = unmeasured(boxes, silent, unit)
        boxes = [b for b in boxes if b.id not in gone]
        if len(boxes) < len(page) * MEASURED or not boxes:
            return out.assign(reading_pos=range(len(page)), method="dom", columns=columns_of(boxes, unit), differs=False)
        floats = {p: f for p, f in zip(known.pos, known.float_of, strict=True) if isinstance(f, str)}
        done = [b.id for b in with_cards(boxes, dict(zip(known.pos, known.xpath, strict=True)), floats, unit, bool(page.rtl.iloc[0]))]
        after: dict = {}
        last, placed = None, set(done)
        for pos in page.pos:
            if pos in placed:
                last = pos
            else:
                after.setdefault(last, []).append(pos)
        order = after.get(None, []) + [q for p in done for q in (p, *after.get(p, []))]
        return pd.DataFrame({"page_id": page.page_id.iloc[0], "pos": order, "reading_pos": range(len(order)), "method": "xy-cut" if len(boxes) == len(page) else "anchored", "columns": columns_of(boxes, unit), "differs": order != sorted(order)})

    own = [F.col(c) if c in blocks.columns else F.lit(d).cast("string").alias(c) for c, d in (("text", "x"), ("float_of", None))]
    joined = blocks.select("page_id", "pos", "xpath", *own).join(rects, ["page_id", "xpath"], "left")
    joined = joined.join(pages.select("page_id", "rtl"), "page_id", "left") if pages is not None else joined.withColumn("rtl", F.lit(False))
    joined = joined.select("page_id", "pos", "xpath", "text", "float_of", F.coalesce("rtl", F.lit(False)).alias("rtl"), "x", "y", "width", "height")
    return joined.groupBy("page_id").applyInPandas(arrange, "page_id long, pos int, reading_pos int, method string, columns int, differs boolean")
