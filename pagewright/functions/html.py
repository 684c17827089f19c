"""What a page holds, read from its tree: typed blocks, links, head, structured payloads, markup counts.

Runs inside Arrow batches (operators/parse.py); nothing here touches Spark.
"""

from __future__ import annotations

import functools
import html as entities
import json
import re
from urllib.parse import urljoin

from pagewright.functions.dom import ABSENT, BLOCK, EDITORS, FLOATS, HIDDEN_BY, MARK, Node, first, fold, hidden_by, read, tree

__all__ = ["Blocks", "Node", "absolute", "first", "fold", "is_rtl", "links", "loads", "metadata", "payloads", "read", "stats", "tree"]

SKIP = frozenset("script style template noscript head textarea colgroup source track param".split())
#: Sizes that decide tables, pictures and panels.
LONG_CELL, GRID, FILLED, BLANK_ROWS, TABLE_MARKUP = 200, 2, 0.4, 0.2, 200_000
LEAST_PICTURE, PANEL_SHARE, COMMENT_SHARE, HEADER_WORDS, DIAGRAM_LABELS, DIAGRAM_WORDS = 32, 0.4, 0.92, 4, 2, 3

# Words of class, id and label that name parts of a page, in alphabetical order.
TOKEN = re.compile(r"[^a-z0-9]+")
FILTERS = set("facet faceted facets filter filterbar filternav filters filtersidebar refine refinement refinements".split())
CALLOUTS = set("admonition alert callout caution danger hint important info note notes tip tips warning".split())
CALLOUT_LABEL = re.compile(r"(?:caution|danger|example|hint|important|info|note|see also|tip|warning)\b", re.I)
COMMENTS = set("commentbox commentlist commentlisting commento commentsarea commentsection commentwrap disqus_thread isso-thread remark42 wpdiscuz".split())
NO_COMMENTS = set("author btn button closed count counts date disabled enabled field has icon input js label link message meta no nonce notification open privacy recent reply toggle with".split())
CONSENT_VENDORS = ("cc-window", "cookiebot", "cookieconsent", "didomi", "onetrust", "optanon", "ot-sdk", "qc-cmp2", "sp_message", "truste")
CONSENT_SUBJECTS, CONSENT_FORMS = {"consent", "cookie", "gdpr", "privacy"}, set("alert banner bar box consent container dialog disclaimer info law manager message modal msg notice overlay policy popup prompt settings wrap wrapper".split())
RAILS = set(
    "addthis adsbygoogle breadcrumb breadcrumbs colophon footer footer-container footer-inner footer-wrap footer-wrapper global-footer main-footer main-menu main-nav main-navigation mainmenu mainnav marquee "
    "mega-menu megamenu mgid nav navbar navigation newsticker outbrain page-footer primary-nav primary-navigation revcontent sharedaddy sharethis site-footer site-nav site-navigation skyscraper taboola ticker top-nav topnav yarpp zergnet".split()
)
RAIL_PAIRS = (
    "ad-container ad-slot ad-unit ad-wrapper also-read breaking-news latest-news latest-posts more-stories most-popular most-read most-viewed news-ticker newsletter-form newsletter-signup popular-posts promo-box "
    "read-next recent-posts related-articles related-content related-news related-posts related-stories share-bar share-buttons sharing-buttons social-share sticky-ad top-stories trending-now trending-posts you-may-like"
).split()
POST_FURNITURE = set(
    "author-info authorinfo extrauserinfo member-info memberinfo message-signature message-user message-userbanner message-userdetails message-userextras messageuserinfo post-count post-profile post-signature "
    "postcount postprofile postsignature reputation-score signature signature-content user-info user-title userinfo usertitle".split()
)
BODIES = set("article-body article-content article__body article__content articlebody entry-body entry-content entrycontent post-body post-content post_body post_content postbody postcontent story-body".split())
TEMPLATES = "ng-hide ng-if ng-show ng-switch-default ng-switch-when v-else v-else-if v-if v-show x-if x-show".split()
NO_LANGUAGE = {"", "nohighlight", "none", "null", "plain", "plaintext", "text", "undefined"}
LANGUAGES = set("bash c cpp cs csharp css go html http java javascript js json jsx kotlin less php python rb ruby rust scss sh shell sql swift text ts tsx txt typescript xml yaml".split())
CODE_CONTROLS = set("clipboard copied copied! copy edit play raw reset run".split())
UPPER, LOWER = str.maketrans("0123456789+-=()ni", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ⁿⁱ"), str.maketrans("0123456789+-=()", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎")
PANEL_TAGS = frozenset("aside details div dl fieldset footer form header li nav ol p section span table tbody td tr ul article".split())
WRAPS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`", "del": "~~", "s": "~~"}
TABLE_TAGS, TABLE_ATTRIBUTES = frozenset("a br caption img sub sup table tbody td tfoot th thead tr".split()), ("colspan", "rowspan", "href", "src", "alt")


def landmark(node: Node) -> str | None:
    a = node.attrs
    if "role" in a:
        by_role = {"navigation": "nav", "contentinfo": "footer", "complementary": "aside", "main": "main", "banner": "header"}.get(a["role"].strip().lower())
        if by_role:
            return by_role
    if node.tag == "aside" and (CALLOUT_LABEL.match(a.get("aria-label", "").strip()) or CALLOUTS & set(TOKEN.split(node.names()))):
        return None
    return node.tag if node.tag in ("nav", "footer", "aside", "main", "header") else None


def holds_article(node: Node) -> bool:
    return any(n.tag == "h1" or "articlebody" in n.attrs.get("itemprop", "").lower() for n in node.walk())


def names_rail(names: str) -> bool:
    """A token that names a rail, or a pair of words that does, set off inside a longer token."""
    return any(t in RAILS or any(p in t and (t == p or not t.replace(p, "x").isalnum()) for p in RAIL_PAIRS) for t in names.split())


def names_comments(names: str) -> bool:
    if "comment" not in names and "disqus" not in names and "wpdiscuz" not in names:
        return False
    return any(t in COMMENTS or (parts := set(TOKEN.split(t))) & {"comment", "comments"} and not parts & NO_COMMENTS for t in names.split())


def names_consent(names: str) -> bool:
    for t in names.split():
        parts = [x for x in re.split(r"[_-]", t) if x]
        if any(v in t for v in CONSENT_VENDORS) or any(a in CONSENT_SUBJECTS and b in CONSENT_FORMS for a, b in zip(parts, parts[1:], strict=False)):
            return True
        if any(t.startswith(s) and t[len(s) :] in CONSENT_FORMS for s in ("cookie", "consent", "gdpr")):
            return True
    return False


def widget(node: Node, body_words: int) -> str | None:
    """The kind of panel an element names itself, unless it holds too much of the page for a panel."""
    if node.tag not in PANEL_TAGS:
        return None
    names = node.names()
    small = node.size <= PANEL_SHARE * body_words
    if names:
        if small and POST_FURNITURE & set(names.split()):
            return "post-furniture"
        if small and names_rail(names) and not holds_article(node):
            return "rail"
        if node.size <= COMMENT_SHARE * body_words:
            if names_consent(names):
                return "consent"
            if names_comments(names):
                return "comments"
    if small and node.tag in ("aside", "details", "div", "fieldset", "form", "nav", "section", "ul"):
        label = f"{names} {node.attrs.get('aria-label', '')} {node.attrs.get('data-testid', '')}".lower()
        if FILTERS & set(TOKEN.split(label)):
            return "filter" if any(n.tag in ("input", "select") for n in node.walk()) else None
        if node.tag == "fieldset" and any(n.tag == "input" and n.attrs.get("type") == "checkbox" for n in node.walk()):
            return "filter"
    return None


def names_body(node: Node) -> bool:
    return node.tag in ("div", "section", "article", "main") and ("articlebody" in node.attrs.get("itemprop", "").lower() or bool(BODIES & set(node.names().split())))


def span(cell: Node, name: str) -> int:
    try:
        return min(1000, max(1, int(cell.attrs.get(name, "1"))))
    except ValueError:
        return 1


def own_rows(table: Node) -> list[Node]:
    """Rows of a table but not of tables within it, header rows first as they stand."""
    out = []
    for k in table.elements():
        if k.tag == "tr":
            out.append(k)
        elif k.tag in ("thead", "tbody", "tfoot"):
            out += [r for r in k.elements() if r.tag == "tr"]
    return out


def cells_of(row: Node) -> list[Node]:
    return [k for k in row.elements() if k.tag in ("td", "th")]


def cell_text(cell: Node) -> str:
    """Text of a cell without that of tables within it."""
    out, stack = [], list(reversed(cell.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag not in ("script", "style", "template", "table"):
            if k.tag in BLOCK or k.tag == "br":
                out.append(" ")
                stack.append(" ")
            stack.extend(reversed(k.kids))
    return fold("".join(out))


def grid(table: Node, render=cell_text) -> list[list[str]]:
    """Cells of a table with row and column spans filled in."""
    rows: list[list[str]] = []
    pending: dict[int, tuple[int, str]] = {}
    for tr in own_rows(table):
        row: list[str] = []
        cells = iter(cells_of(tr))
        cell = next(cells, None)
        while cell is not None or any(c >= len(row) for c in pending):
            at = len(row)
            if at in pending:
                left, text = pending.pop(at)
                row.append(text)
                if left > 1:
                    pending[at] = (left - 1, text)
                continue
            if cell is None:
                row.append("")
                continue
            text = render(cell)
            for _ in range(span(cell, "colspan")):
                if (down := span(cell, "rowspan")) > 1:
                    pending[len(row)] = (down - 1, text)
                row.append(text)
            cell = next(cells, None)
        rows.append(row)
    return rows


def header_depth(table: Node) -> int:
    """Leading header rows: those of thead, else the first rows of nothing but th."""
    head = [r for k in table.elements() if k.tag == "thead" for r in k.elements() if r.tag == "tr"]
    if head:
        return len(head)
    depth = 0
    for row in own_rows(table):
        cells = cells_of(row)
        if not cells or any(c.tag != "th" for c in cells):
            break
        depth += 1
    return depth


def collapse_header(rows: list[list[str]], depth: int) -> list[list[str]]:
    """One label a column out of several header rows, without repeats."""
    if depth < 2 or depth > len(rows):
        return rows
    width = max(map(len, rows[:depth]))
    head = [" ".join(dict.fromkeys(r[c] for r in rows[:depth] if c < len(r) and r[c])) for c in range(width)]
    return [head, *rows[depth:]]


def is_layout(table: Node) -> bool:
    """A table that only arranges a page: no header of its own, and tables or whole passages in its cells or no grid's shape."""
    if table.attrs.get("role") in ("presentation", "none"):
        return True
    rows = own_rows(table)
    if any(k.tag in ("caption", "thead") for k in table.elements()) or any(c.tag == "th" for r in rows for c in cells_of(r)):
        return False
    if any(n.tag == "table" for n in table.walk() if n is not table):
        return True
    cells = [c for r in rows for c in cells_of(r)]
    if not cells:
        return False
    filled = [bool(c.text()) for c in cells]
    if len(rows) < GRID or max(len(cells_of(r)) for r in rows) < GRID:
        return True
    if sum(not r.text() for r in rows) > BLANK_ROWS * len(rows) or sum(filled) < FILLED * len(filled):
        return True
    return sum(map(is_page_like, cells)) * 2 >= len(cells)


def is_page_like(cell: Node) -> bool:
    inner = [n.tag for n in cell.walk() if n is not cell]
    return any(t in ("table", "form", "section", "article", "h1", "h2", "h3") for t in inner) or inner.count("p") >= 2 or len(cell.text()) >= LONG_CELL


def is_complex(table: Node) -> bool:
    """A table that pipes cannot say: spans or tables within."""
    return any(n.tag == "table" and n is not table or n.tag in ("td", "th") and (span(n, "colspan") > 1 or span(n, "rowspan") > 1) for n in table.walk())


def table_markup(table: Node, base: str) -> str | None:
    """A table's own markup with nothing but structure, links and pictures; None if it is too long."""
    out: list[str] = []

    def render(node: Node) -> None:
        a, tag = node.attrs, node.tag
        target = absolute(a.get("href" if tag == "a" else "src", ""), base) if tag in ("a", "img") and a.get("href" if tag == "a" else "src") else None
        keep = tag in TABLE_TAGS and (tag not in ("a", "img") or target is not None and not tiny(node))
        if keep:
            kept = {k: a[k] for k in TABLE_ATTRIBUTES if k in a} | ({"href" if tag == "a" else "src": target} if target else {})
            out.append(f"<{tag}" + "".join(f' {k}="{entities.escape(v)}"' for k, v in kept.items()) + ">")
        elif tag in BLOCK and out and not out[-1].startswith("<t"):
            out.append("<br>")
        for k in node.kids:
            if isinstance(k, str):
                out.append(entities.escape(re.sub(r"\s+", " ", k), quote=False))
            elif k.tag not in SKIP:
                render(k)
        if keep and tag not in ("br", "img"):
            out.append(f"</{tag}>")

    render(table)
    markup = re.sub(r"(?:<br>\s*){2,}", "<br>", "".join(out))
    markup = re.sub(r"\s*<br>\s*(?=</t[dh]>)", "", markup).strip()
    return markup if len(markup.encode()) <= TABLE_MARKUP else None


def tiny(image: Node) -> bool:
    return any((v := image.attrs.get(k, "")).isdigit() and int(v) < LEAST_PICTURE for k in ("width", "height"))


def largest(srcset: str) -> str | None:
    """The candidate of a srcset with the greatest width or density."""
    best, most = None, -1.0
    for part in re.split(r",\s+|,(?=https?:|/)", srcset.strip()):
        words = part.split()
        if words and not words[0].startswith("data:"):
            size = re.fullmatch(r"(\d+(?:\.\d+)?)[wx]", words[1]) if len(words) > 1 else None
            if (value := float(size[1]) if size else 0.0) > most:
                best, most = words[0].rstrip(","), value
    return best


def picture_source(image: Node) -> str | None:
    a = image.attrs
    sets = [a[k] for k in ("srcset", "data-srcset") if a.get(k)]
    if image.up is not None and image.up.tag == "picture":
        sets += [k.attrs["srcset"] for k in image.up.elements() if k.tag == "source" and k.attrs.get("srcset")]
    plain = next((a[k] for k in ("src", "data-src", "data-lazy-src", "data-original") if a.get(k) and not a[k].startswith("data:")), None)
    return next((x for x in map(largest, sets) if x), None) or plain


def code_language(node: Node) -> str | None:
    for n in (node, *(k for k in node.walk() if k.tag == "code" and k is not node)):
        for key in ("data-language", "data-lang"):
            if n.attrs.get(key, "").strip():
                found = n.attrs[key].strip().lower()
                return None if found in NO_LANGUAGE else found
        classes = n.classes()
        for i, c in enumerate(classes):
            found = next((c[len(p) :] for p in ("language-", "lang-", "highlight-") if c.startswith(p) and len(c) > len(p)), None)
            if c == "brush:" and i + 1 < len(classes):
                found = classes[i + 1].rstrip(";")
            if found:
                return None if found.lower() in NO_LANGUAGE else found
    return None


#: Where an editor's lines stand: the class of their holder and of each line, and the attribute that names the language.
EDITOR_LINES = {"cm-editor": ("cm-content", "cm-line"), "CodeMirror": ("CodeMirror-code", "CodeMirror-line"), "monaco-editor": ("view-lines", "view-line"), "ace_editor": ("ace_text-layer", "ace_line")}


def editor_code(node: Node) -> tuple[str, str | None] | None:
    """Text and language of a browser-side code editor: its lines in order, without gutters and layers."""
    kind = next((c for c in node.classes() if c in EDITORS), None)
    if kind is None:
        return None
    holder_class, line_class = EDITOR_LINES[kind]
    holder = next((n for n in node.walk() if holder_class in n.classes()), None)
    lines = [n for n in holder.walk() if line_class in n.classes()] if holder else []
    if kind == "monaco-editor":  # drawn in the order of painting

        def top(n: Node) -> float:
            m = re.search(r"(?:^|;)\s*top\s*:\s*(-?[\d.]+)px", n.attrs.get("style", ""))
            return float(m[1]) if m else 0.0

        lines.sort(key=top)
    text = "\n".join(raw_text(n).replace("\xa0", " ").rstrip() for n in lines).strip("\n")
    near = [holder, node, *list(node.ups())[:4]] if holder else [node]
    declared = next((n.attrs[k].strip().lower() for n in near for k in ("data-language", "data-lang", "data-mode-id", "language") if n.attrs.get(k, "").strip()), None)
    return text, declared or code_language(node)


def raw_text(node: Node) -> str:
    """Text as written, with br as a newline."""
    out, stack = [], list(reversed(node.kids))
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            out.append(k)
        elif k.tag == "br":
            out.append("\n")
        elif k.tag != "button":
            stack.extend(reversed(k.kids))
    return "".join(out)


def svg_labels(svg: Node) -> list[str]:
    return [t for n in svg.walk() if n.tag in ("text", "foreignobject") and (t := n.text())]


BLANK = {"region": None, "widget": None, "in_main": False, "article": None, "body_of": None, "float_of": None, "templated": None, "aside": None, "quoted": 0, "kind": "paragraph", "level": 0, "ordered": False, "depth": 0}
KEPT = tuple(BLANK)


class Blocks:
    """Typed blocks of a page in document order."""

    def __init__(self, root: Node, base: str):
        self.base, self.out, self.plain, self.rich = base, [], [], []
        body = first(root, "body") or root
        self.words = max(1, body.size)
        self.order = {id(n): i for i, n in enumerate(root.walk())}
        self.hidden_code: list[dict] = []
        context = BLANK | {"node": body}
        self.visit(body, context)
        self.flush(context)
        self.complete_editors()

    def emit(self, context: dict, **fields) -> None:
        node = context["node"]
        row = {"text": "", "tag": node.tag, "xpath": node.xpath(), "dom_index": self.order.get(id(node), 0), "href": None, "alt": None, "link": None, "language": None, "rows": None, "rich_rows": None, "table_html": None, "rich_text": ""}
        for k in KEPT:
            row[k] = context[k]
        row.update(fields)
        row["rich_text"] = row["rich_text"] or row["text"]
        self.out.append(row)

    def flush(self, context: dict) -> None:
        if not self.plain:
            return
        text, rich = fold("".join(self.plain)), fold("".join(self.rich))
        self.plain, self.rich = [], []
        if not text:
            return
        link = re.search(r"\]\(([^()\s]*)\)", rich)
        href = link[1] if link else None
        if "\n\n" in text and text.count("\n\n") == rich.count("\n\n"):
            for part, rich_part in zip(text.split("\n\n"), rich.split("\n\n"), strict=True):
                self.emit(context, text=part, rich_text=rich_part, href=href)
        else:
            self.emit(context, text=text, rich_text=rich, href=href)

    def add(self, text: str, rich: str | None = None) -> None:
        self.plain.append(text)
        self.rich.append(text if rich is None else rich)

    def inline(self, node: Node, context: dict) -> None:
        tag = node.tag
        if node.blocky or node.pictured:
            for kid in node.kids:
                self.visit_kid(kid, context)
            return
        wrap = WRAPS.get(tag)
        if wrap is None and tag not in ("a", "sup", "sub"):
            for kid in node.kids:
                self.visit_kid(kid, context)
            return
        held, self.plain, held_rich, self.rich = self.plain, [], self.rich, []
        for kid in node.kids:
            self.visit_kid(kid, context)
        text, rich = "".join(self.plain), "".join(self.rich)
        self.plain, self.rich = held, held_rich
        if tag in ("sup", "sub"):
            table = UPPER if tag == "sup" else LOWER
            if text and all(ord(c) in table for c in text.strip()):
                text = rich = text.strip().translate(table)
        elif tag == "a":
            if node.attrs.get("href") and text.strip():
                rich = f"[{fold(rich)}]({absolute(node.attrs['href'], self.base) or node.attrs['href']})"
        elif text.strip():
            core = rich.strip(" \t\r\n\f\v\x00")
            at = rich.index(core)
            rich = f"{rich[:at]}{wrap}{core}{wrap}{rich[at + len(core) :]}"
        self.add(text, rich)

    def visit_kid(self, kid, context: dict) -> None:
        if kid.__class__ is str:
            self.plain.append(kid)
            self.rich.append(kid)
        else:
            self.visit(kid, context)

    def image(self, node: Node, context: dict) -> None:
        src = picture_source(node)
        if not src or tiny(node):
            return
        self.flush(context)
        anchor = next((u for u in node.ups() if u.tag == "a" and u.attrs.get("href")), None)
        link = absolute(anchor.attrs["href"], self.base) if anchor is not None and not anchor.text() else None
        self.emit(context | {"kind": "image", "node": node}, text=fold(node.attrs.get("alt", "")), alt=node.attrs.get("alt"), href=absolute(src, self.base), link=link)

    def media(self, node: Node, context: dict) -> None:
        src = node.attrs.get("src") or node.attrs.get("data") or next((n.attrs.get("src") for n in node.walk() if n.tag == "source"), None)
        if node.tag in ("iframe", "embed", "object") and not src:
            return
        self.flush(context)
        self.emit(context | {"kind": "media", "node": node}, text=node.attrs.get("title") or node.attrs.get("aria-label", ""), href=absolute(src, self.base) if src else None)

    def code(self, node: Node, context: dict) -> None:
        text = raw_text(node).strip("\n")
        if text.strip():
            row = {"text": text, "language": code_language(node)}
            if any(hidden_by(n) in ABSENT for n in (node, *node.ups())):
                self.hidden_code.append(row)
            else:
                self.emit(context | {"kind": "code"}, **row)

    def table(self, node: Node, context: dict) -> None:
        depth = header_depth(node)
        rows = collapse_header([r for r in grid(node) if any(r)], depth)
        if not rows:
            return
        rich = collapse_header([r for r in grid(node, self.cell_rich) if any(r)], depth)
        caption = next((k.text() for k in node.elements() if k.tag == "caption"), "")
        flat = "\n".join(" | ".join(r) for r in rows)
        self.emit(context | {"kind": "table"}, text=f"{caption}\n{flat}" if caption else flat, rows=rows, rich_rows=rich if len(rich) == len(rows) and rich != rows else None, table_html=table_markup(node, self.base) if is_complex(node) else None)

    def cell_rich(self, cell: Node) -> str:
        held = self.plain, self.rich
        self.plain, self.rich, out = [], [], []
        stack = list(reversed(cell.kids))
        while stack:
            k = stack.pop()
            if isinstance(k, str):
                self.add(k)
            elif k.tag == "table" or k.tag in SKIP:
                continue
            elif k.tag in BLOCK or k.tag == "br":
                self.add(" ")
                stack.append(" ")
                stack.extend(reversed(k.kids))
            elif k.tag == "img":
                src = picture_source(k)
                if src and not tiny(k):
                    self.add("", f"![{fold(k.attrs.get('alt', ''))}]({absolute(src, self.base)})")
            elif k.blocky or k.pictured:
                stack.extend(reversed(k.kids))
            else:
                self.inline(k, BLANK | {"node": cell})
        out = fold("".join(self.rich))
        self.plain, self.rich = held
        return out

    def is_code_header(self, node: Node) -> bool:
        """The strip above a code block: a few words with a control, or nothing but labels."""
        if node.size > HEADER_WORDS or node.up is None:
            return False
        kids = node.up.elements()
        at = next(i for i, k in enumerate(kids) if k is node)
        if at + 1 >= len(kids) or kids[at + 1].tag != "pre" or not node.text():
            return False
        if any(n.tag == "button" or n.attrs.get("role") == "button" or n.tag == "a" and n.attrs.get("href", "#").startswith(("#", "javascript:")) for n in node.walk()):
            return True
        known = LANGUAGES | CODE_CONTROLS | {(code_language(kids[at + 1]) or "").lower()}
        return node.tag != "p" and all(t.strip(":").lower() in known for t in node.text().split())

    def visit(self, node: Node, context: dict) -> None:
        tag = node.tag
        if tag in SKIP or node.attrs.get("aria-hidden") == "true":
            return
        if tag == "br":
            self.add(MARK)
            return
        if tag == "img":
            self.image(node, context)
            return
        if tag == "svg":
            labels = svg_labels(node)
            if len(labels) >= DIAGRAM_LABELS or sum(len(x.split()) for x in labels) >= DIAGRAM_WORDS:
                self.flush(context)
                self.emit(context | {"kind": "paragraph", "node": node}, text=", ".join(dict.fromkeys(labels)))
            return
        if tag in ("video", "audio", "iframe", "embed", "object"):
            self.media(node, context)
            return
        if tag == "select":
            choices = [t for n in node.walk() if n.tag == "option" and (t := n.text())]
            if choices:
                self.flush(context)
                self.emit(context | {"kind": "paragraph", "widget": "select", "node": node}, text=" · ".join(choices))
            return
        if tag == "button":
            if HIDDEN_BY in node.attrs:  # a control that readers do not see
                return
            self.flush(context)
            for kid in node.kids:
                self.visit_kid(kid, context | {"node": node})
            self.flush(context | {"node": node})
            return
        if tag not in BLOCK and tag != "#document":
            self.inline(node, context)
            return
        self.flush(context)
        attrs = node.attrs
        here = context.copy()
        here["node"], here["depth"] = node, context["depth"] + 1
        mark = landmark(node)
        if mark == "main":
            here["in_main"], here["region"] = True, None
        elif mark and not (mark == "header" and (context["article"] or context["in_main"])):
            here["region"] = mark
        if attrs:
            if context["widget"] is None:
                here["widget"] = widget(node, self.words)
            if context["body_of"] is None and names_body(node):
                here["body_of"] = node.xpath()
            if FLOATS in attrs and context["float_of"] is None:
                here["float_of"] = node.xpath()
            for name in TEMPLATES:
                if name in attrs:
                    here["templated"] = name
                    break
            if "class" in attrs and not EDITORS.isdisjoint(node.classes()) and (found := editor_code(node)) is not None:
                if found[0].strip():
                    self.emit(here | {"kind": "code"}, text=found[0], language=found[1], alt="editor")
                return
        if tag == "article":
            here["article"] = context["article"] or node.xpath()
        elif tag == "aside":
            here["aside"] = node.xpath()
        if tag in ("div", "p", "header", "figcaption") and node.size and self.is_code_header(node):
            return
        if tag[0] == "h" and len(tag) == 2 and tag[1].isdigit():
            here["kind"], here["level"] = "heading", int(tag[1])
        elif tag in ("ul", "ol", "menu"):
            here["ordered"], here["level"] = tag == "ol", context["level"] + 1 if context["kind"] == "list-item" else 1
        elif tag == "li":
            here["kind"] = "list-item"
            here["level"] = max(1, context["level"]) if context["kind"] != "heading" else 1
        elif tag in ("dt", "dd"):
            here["kind"], here["level"] = "list-item", 0
        elif tag == "blockquote":
            here["kind"], here["quoted"] = "quote" if context["kind"] == "paragraph" and not node.blocky else context["kind"], context["quoted"] + 1
            if context["kind"] == "paragraph" and not any(n.tag in ("ul", "ol", "pre", "table", "dl") or n.tag[:1] == "h" and n.tag[1:].isdigit() for n in node.walk()):
                here["kind"] = "quote"
        elif tag == "figcaption":
            here["kind"] = "figure-caption"
        elif tag == "hr":
            self.emit(here | {"kind": "rule"})
            return
        elif tag == "pre":
            self.code(node, here)
            return
        elif tag == "table" and not is_layout(node):
            self.table(node, here)
            return
        for kid in node.kids:
            self.visit_kid(kid, here)
        self.flush(here)

    def complete_editors(self) -> None:
        """An editor draws the lines in view; the hidden source that starts with them, or holds them, is the whole."""
        sources = list(self.hidden_code)
        for row in self.out:
            if row["kind"] == "code" and row["alt"] == "editor":
                row["alt"] = None
                drawn = row["text"].strip()
                found = next((s for s in sources if len(s["text"]) > len(drawn) and s["text"].strip().startswith(drawn)), None)
                if found:
                    sources.remove(found)
                    row["text"] = row["rich_text"] = found["text"]


@functools.lru_cache(maxsize=8)
def origin(base: str) -> str | None:
    m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+", base)
    return m[0] if m else None


@functools.lru_cache(maxsize=1 << 14)
def absolute(href: str, base: str) -> str | None:
    href = href.strip()
    if not base:
        return href
    if href[:1] == "/" and href[1:2] != "/" and "/." not in href and (at := origin(base)):
        return at + href
    try:
        return urljoin(base, href)
    except ValueError:
        return None


def links(root: Node, base: str) -> list[dict]:
    """Anchors in order, nofollow ones left out: href (absolute), anchor text of at most 160 characters, region."""
    out = []
    regions: dict[int, str | None] = {}
    for n in root.walk():
        own = landmark(n) if n.tag in ("nav", "footer", "aside", "main", "header") or "role" in n.attrs else None
        regions[id(n)] = own or (regions.get(id(n.up)) if n.up is not None else None)
        if n.tag == "a" and n.attrs.get("href") and "nofollow" not in n.attrs.get("rel", "").lower().split():
            region = regions[id(n)]
            out.append({"pos": len(out), "raw": n.attrs["href"], "href": absolute(n.attrs["href"], base), "anchor": n.text()[:160], "region": region})
    return out


def metadata(root: Node, base: str) -> dict[str, str]:
    """Head fields by name: title, description, canonical, lang, and every named meta under its own name."""
    metas: dict[str, str] = {}
    out: dict[str, str] = {"title": "", "description": ""}
    titled, rest = False, {}
    for n in root.walk():
        tag, a = n.tag, n.attrs
        if tag == "title" and not titled:
            out["title"], titled = n.text(), True
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or a.get("itemprop") or ("charset" if "charset" in a else "")).lower()
            if name and name not in metas:
                metas[name] = fold(a.get("content", a.get("charset", "")))
        elif tag == "link":
            rel = a.get("rel", "").lower().split()
            if "canonical" in rel:
                rest.setdefault("canonical", absolute(a.get("href", ""), base) or "")
            if "alternate" in rel and a.get("hreflang"):
                rest[f"hreflang:{a['hreflang']}"] = absolute(a.get("href", ""), base) or ""
            if "icon" in rel:
                rest.setdefault("icon", absolute(a.get("href", ""), base) or "")
            if "next" in rel or "prev" in rel:
                rest.setdefault("rel:next" if "next" in rel else "rel:prev", absolute(a.get("href", ""), base) or "")
        elif tag == "html":
            rest.setdefault("lang", a.get("lang", ""))
    out["description"] = metas.get("description") or metas.get("og:description") or metas.get("twitter:description") or ""
    out |= {"lang": ""} | rest
    return out | {k: v for k, v in metas.items() if k not in out and v}


def loads(raw: str):
    """JSON, or JSON with trailing commas; None if it is neither."""
    for text in (raw, re.sub(r",\s*([}\]])", r"\1", raw)):
        try:
            return json.loads(text)
        except (ValueError, RecursionError):
            continue
    return None


def js_string(literal: str) -> str | None:
    """The value of a JavaScript string literal, whatever its quotes, with the escapes that JSON lacks."""
    body = literal[1:-1]
    body = re.sub(r"\\x([0-9a-fA-F]{2})", r"\\u00\1", body)
    body = re.sub(r"\\u\{([0-9a-fA-F]{1,6})\}", lambda m: json.dumps(chr(int(m[1], 16)))[1:-1] if int(m[1], 16) < 0x110000 else "", body)
    body = body.replace("\\'", "'").replace("\\`", "`").replace("\\0", "\\u0000").replace("\\v", "\\u000b").replace("\\\n", "")
    if literal[:1] != '"':
        body = re.sub(r'(?<!\\)"', r'\\"', body)
    found = loads('"' + body.replace("\n", "\\n").replace("\t", "\\t") + '"')
    return found if isinstance(found, str) else None


def balanced(text: str, start: int) -> str | None:
    """The JSON object or array that begins at a place, by brackets outside strings."""
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"' or text[i] != '"'
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
        i += 1
    return None


def json_ld(data) -> list:
    """Nodes of a JSON-LD value: arrays and @graph unwrapped, however deep."""
    out, stack = [], [data]
    while stack:
        d = stack.pop()
        if isinstance(d, list):
            stack.extend(reversed(d))
        elif isinstance(d, dict) and "@graph" in d:
            rest = {k: v for k, v in d.items() if k not in ("@graph", "@context")}
            if rest.get("@type"):
                out.append(rest)
            stack.append(d["@graph"])
        elif isinstance(d, dict):
            out.append(d)
    return out


def microdata(scope: Node) -> dict:
    """An itemscope as a dictionary; repeated properties are lists."""
    out: dict = {}
    if scope.attrs.get("itemtype"):
        out["@type"] = scope.attrs["itemtype"].rstrip("/").rsplit("/", 1)[-1]
    stack = [k for k in reversed(scope.kids) if isinstance(k, Node)]
    while stack:
        n = stack.pop()
        inner = "itemscope" in n.attrs
        if name := n.attrs.get("itemprop"):
            a = n.attrs
            value = microdata(n) if inner else a.get("content") or a.get("datetime") or a.get("href") or a.get("src") or a.get("value") or n.text()
            out[name] = value if name not in out else [*(out[name] if isinstance(out[name], list) else [out[name]]), value]
        if not inner:
            stack.extend(k for k in reversed(n.kids) if isinstance(k, Node))
    return out


#: Global names under which pages publish their initial state.
STATES = {"__NUXT__": "nuxt", "__INITIAL_STATE__": "initial-state", "__APOLLO_STATE__": "initial-state", "__PRELOADED_STATE__": "initial-state"}


def payloads(root: Node, html: str, meta: dict[str, str] | None = None) -> list[dict]:
    """Structured data in order of trust: JSON-LD, microdata, framework data, initial states, Open Graph."""
    out = []
    scripts = [n for n in root.walk() if n.tag == "script"]
    raw = lambda n: "".join(k for k in n.kids if isinstance(k, str))
    for n in scripts:
        if n.attrs.get("type", "").lower().split(";")[0].strip() == "application/ld+json":
            out += [("json-ld", x) for x in json_ld(loads(raw(n)))]
    for n in root.walk():
        if "itemscope" in n.attrs and "itemprop" not in n.attrs:
            out.append(("microdata", microdata(n)))
    for n in scripts:
        if n.attrs.get("id") == "__NEXT_DATA__" and (data := loads(raw(n))) is not None:
            out.append(("next-data", data))
    chunks = [js_string(m) for m in re.findall(r'self\.__next_f\.push\(\[1,("(?:[^"\\]|\\.)*")\]\)', html)]
    for line in "".join(c for c in chunks if isinstance(c, str)).split("\n"):
        if (data := loads(line.partition(":")[2])) is not None and isinstance(data, dict | list):
            out.append(("rsc-flight", data))
    for name, source in STATES.items():
        for m in re.finditer(rf"window\.{name}\s*=\s*(?=[{{\[])", html):
            if (found := balanced(html, m.end())) and (data := loads(found)) is not None:
                out.append((source, data))
    social = {k: v for k, v in (meta or metadata(root, "")).items() if k.startswith(("og:", "twitter:", "article:", "product:"))}
    if social:
        out.append(("open-graph", social))
    said = [(s, text) for s, d in out if (text := dumps(d)) is not None]
    return [{"seq": i, "source": s, "data": text} for i, (s, text) in enumerate(said)]


def dumps(data) -> str | None:
    """JSON of a payload; None if it is nested too deep to be written."""
    try:
        return json.dumps(data, ensure_ascii=False, sort_keys=True)
    except RecursionError:
        return None


def stats(root: Node) -> dict:
    out = {"elements": 0, "class_tokens": 0, "itemprops": 0, "rel_next": False, "scripts": 0, "images": 0, "anchors": 0}
    for n in root.walk():
        if n.up is None:
            continue
        out["elements"] += 1
        tag, a = n.tag, n.attrs
        if tag in ("script", "img", "a"):
            out[{"script": "scripts", "img": "images", "a": "anchors"}[tag]] += 1
        if a:
            out["class_tokens"] += len(n.classes())
            out["itemprops"] += "itemprop" in a
            out["rel_next"] = out["rel_next"] or "next" in a.get("rel", "").lower().split()
    return out


# Languages and scripts written from right to left.
RTL_LANGUAGES = set("ar arc ckb dv fa he iw ji ks ku nqo prs ps sd syr ug ur yi".split())
RTL_SCRIPTS = set("adlm arab hebr mand nkoo rohg samr syrc thaa yezi".split())


def is_rtl(root: Node) -> bool:
    """dir of html or body decides, else the language."""
    for tag in ("html", "body"):
        if (n := first(root, tag)) and n.attrs.get("dir", "").lower() in ("rtl", "ltr"):
            return n.attrs["dir"].lower() == "rtl"
    lang = (first(root, "html") or root).attrs.get("lang", "").lower()
    return lang.split("-")[0] in RTL_LANGUAGES or bool(RTL_SCRIPTS & set(lang.split("-")))
