"""A tolerant HTML tree in plain Python, built in one pass over the text, and the passes that clean it before it is read.

Everything is linear in the page's length: siblings are counted as they come, and markup deeper than DEPTH hangs on the
element at that depth, so later visitors may recurse. Runs inside Arrow batches; nothing here touches Spark.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

from pagewright.functions.mathml import latex

MAX_BYTES = 32 << 20
DEPTH = 160
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes plaintext".split())
RAW_TEXT = frozenset("title textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul video audio".split()
)
#: A start tag of the key closes an open element of these, up to the nearest boundary.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
PARAGRAPH_BORDER = {"td", "th", "li", "div", "article", "section", "body", "button"}
HEADINGS = {f"h{i}" for i in range(1, 7)}
HEADING_BORDER = {"div", "article", "section", "body", "td"}
MARK = "\x00"  # a line break, until text is folded
SPACE = re.compile(r"\s+")
#: A tag with its attributes (quotes count only after an equals sign), the start of a comment, or a declaration.
TAG = re.compile(r"""<(?:(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>|(!--)|[!?][^>]*+>|/[^A-Za-z][^>]*+>)""")
ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")

#: Attributes by which a renderer tells what it measured: how an element is hidden (display, visibility, overflow,
#: offscreen, clipped, opacity), and that it floats.
HIDDEN_BY, FLOATS = "data-hidden-by", "data-floats"
ABSENT = {"display", "visibility", "overflow", "offscreen"}
UNSHOWN = {"display", "visibility", "offscreen"}

# Names of markup that is not content.
PERMALINKS = {"anchor-link", "hash-link", "header-anchor", "headerlink", "heading-link", "permalink"}
PERMALINK_SIGNS = set("#§¶↩⚓🔗︎")
EDIT_CONTROLS = {"editsection", "mw-editsection"}
SCREEN_READER = set(
    "a11y-hidden assistive-text clip-hidden hidden-visually is-visually-hidden offscreen screen-reader-only screen-reader-text sr-only sr_only u-visually-hidden visually-hidden visually_hidden visuallyhidden".split()
)
OPENERS = ("aria-controls", "aria-owns", "data-bs-target", "data-panel", "data-tab", "data-target", "data-toggle-target", "for")
OPEN_ROLES = {"listbox", "menu", "region", "tabpanel", "tree"}
EDITORS = {"CodeMirror", "ace_editor", "cm-editor", "monaco-editor"}
OFFSCREEN = re.compile(r"(?:^|;)\s*(left|top|right|bottom|text-indent|margin-left|margin-top)\s*:\s*-(\d+(?:\.\d+)?)px", re.I)
OFFSCREEN_PIXELS = 999


class Node:
    __slots__ = ("tag", "attrs", "kids", "up", "place", "counts", "level", "path", "blocky", "pictured", "size")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.kids, self.up = tag, attrs, [], up
        self.counts: dict[str, int] | None = None
        self.path: str | None = None
        self.blocky = self.pictured = False
        self.size = 0  # words of the text, by a pass over the whole tree
        if up is None:
            self.place, self.level = 1, 0
        else:
            if up.counts is None:
                up.counts = {}
            self.place = up.counts[tag] = up.counts.get(tag, 0) + 1
            self.level = up.level + 1
            up.kids.append(self)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.kids:
                stack.extend([k for k in reversed(node.kids) if k.__class__ is Node])

    def elements(self) -> list[Node]:
        return [k for k in self.kids if k.__class__ is Node]

    def text(self, breaks: bool = False) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if node.__class__ is str:
                out.append(node)
            elif node.tag == "br":
                out.append(MARK if breaks else " ")
            elif node.tag not in ("script", "style", "template"):
                if node.tag in BLOCK:
                    out.append(" ")
                    stack.append(" ")
                stack.extend(reversed(node.kids))
        return fold("".join(out))

    def xpath(self) -> str:
        chain, node = [], self
        while node.path is None and node.up is not None:
            chain.append(node)
            node = node.up
        for n in reversed(chain):
            n.path = f"{n.up.path or ''}/{n.tag}[{n.place}]"
        return self.path or "/"

    def classes(self) -> list[str]:
        return self.attrs["class"].split() if "class" in self.attrs else []

    def names(self) -> str:
        """class and id, lower-case; empty for most elements."""
        a = self.attrs
        return f"{a.get('class', '')} {a.get('id', '')}".strip().lower() if "class" in a or "id" in a else ""

    def ups(self) -> Iterator[Node]:
        node = self.up
        while node is not None:
            yield node
            node = node.up


def drop(nodes: list[Node]) -> None:
    """Take elements out of the tree, each parent once; the text around them stays."""
    gone = {id(n) for n in nodes}
    for up in {id(n.up): n.up for n in nodes if n.up is not None}.values():
        up.kids = [k for k in up.kids if id(k) not in gone]


def fold(text: str) -> str:
    """White space folded; line breaks of the source kept as newlines."""
    if MARK not in text:
        return " ".join(text.split())
    return re.sub(r"\n{3,}", "\n\n", "\n".join(SPACE.sub(" ", x).strip() for x in text.split(MARK))).strip()


def attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(raw):
        value = double or single or bare
        out.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return out


class Builder:
    def __init__(self):
        self.root = Node("#document", {}, None)
        self.open = [self.root]
        self.seen: set[str] = set()

    def close(self, tags: set[str], border: set[str]) -> None:
        """Close the outermost open element of the tags within the nearest border."""
        found = 0
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in border:
                break
            if tag in tags:
                found = i
        if found:
            del self.open[found:]

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        elif tag in BLOCK and tag not in ("html", "body"):
            self.close({"p"}, PARAGRAPH_BORDER)
            if tag in HEADINGS:
                self.close(HEADINGS, HEADING_BORDER)
        if tag in ("html", "body", "head"):
            if tag in self.seen:
                if tag == "html" and len(self.open) > 1:
                    self.open[1].attrs |= attrs
                return
            self.seen.add(tag)
            if tag == "body" and self.open[-1].tag == "head":
                self.open.pop()
        node = Node(tag, attrs, self.open[-1] if len(self.open) <= DEPTH else self.open[DEPTH])
        if tag not in VOID:
            self.open.append(node)

    def end(self, tag: str) -> None:
        border = tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html")
        for i in range(len(self.open) - 1, 0, -1):
            at = self.open[i].tag
            if at == tag:
                del self.open[i:]
                return
            if border and at in ("td", "th", "table") or at == "body" and tag != "html":
                return

    def data(self, text: str) -> None:
        at = self.open[-1]
        if len(self.open) > DEPTH + 1:  # flattened: the text stays in its place
            border = self.open[DEPTH]
            if border.kids[-1] is not at:
                at = border
        at.kids.append(text)

    def feed(self, html: str) -> None:
        at, end, search, unescape = 0, len(html), TAG.search, entities.unescape
        last = html.rfind(">")  # beyond it nothing closes, and everything is text
        while True:
            m = search(html, at, last + 1) if at <= last else None
            text = html[at : m.start() if m else end]
            if text:
                self.data(unescape(text) if "&" in text else text)
            if m is None:
                return
            closing, tag, raw, comment = m.groups()
            at = m.end()
            if comment:
                stop = html.find("-->", at)
                if stop < 0:
                    return
                at = stop + 3
            elif tag:
                tag = tag.lower()
                if closing:
                    self.end(tag)
                    continue
                if len(tag) > 100:
                    continue
                empty = raw.endswith("/") and tag in ("circle", "g", "line", "path", "polygon", "rect", "svg", "use")
                self.start(tag, attributes(raw) if raw and not raw.isspace() else {})
                if empty and self.open[-1].tag == tag:
                    self.open.pop()
                if tag in RAW or tag in RAW_TEXT:
                    stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                    body = html[at : stop.start() if stop else end]
                    if body:
                        self.data(unescape(body) if tag in RAW_TEXT and "&" in body else body)
                    at = stop.end() if stop else end
                    if self.open[-1].tag == tag:
                        self.open.pop()


def tree(html: str | None, keep_hidden: bool = False) -> Node:
    """The cleaned tree of a page; ValueError for an empty or oversized one.

    keep_hidden leaves text that only screen readers hear and elements that are not shown.
    """
    return read(html, keep_hidden)[0]


def read(html: str | None, keep_hidden: bool = False) -> tuple[Node, dict[str, int], list[dict]]:
    """The cleaned tree, and what was hidden before: words by kind of hiding, and links {href, kind}."""
    html = re.sub(r"^\s*<\?xml[^>]*\?>", "", html or "")
    if not html.strip():
        raise ValueError("empty document")
    if len(html) > MAX_BYTES:
        raise ValueError("document too large")
    builder = Builder()
    builder.feed(html)
    root = builder.root
    compose_shadows(root)
    unwrap_noscript(root)
    words, links = hidden_matter(root)
    clean(root, keep_hidden)
    measure(root)
    return root, words, links


def hidden_matter(root: Node) -> tuple[dict[str, int], list[dict]]:
    """Words under the outermost hidden elements by kind, and the links in them."""
    words: dict[str, int] = {}
    links, stack = [], [(root, None)]
    while stack:
        node, kind = stack.pop()
        if kind is None and node.attrs:
            kind = hidden_by(node) or ("offscreen" if "style" in node.attrs and off_the_page(node) else "clipped" if "class" in node.attrs and SCREEN_READER.intersection(x.lower() for x in node.classes()) else None)
        if kind is not None and node.tag == "a" and node.attrs.get("href"):
            links.append({"href": node.attrs["href"], "kind": kind})
        for k in reversed(node.kids):
            if k.__class__ is Node:
                if k.tag not in ("script", "style", "template"):
                    stack.append((k, kind))
            elif kind is not None and (n := len(k.split())):
                words[kind] = words.get(kind, 0) + n
    return words, links


def measure(root: Node) -> None:
    """Words of every subtree, and whether it holds block elements or pictures."""
    for n in reversed(list(root.walk())):
        size = n.size
        for k in n.kids:
            if k.__class__ is str:
                if n.tag not in ("script", "style", "template"):
                    size += len(k.split())
            elif k.tag not in ("script", "style", "template"):
                size += k.size
                n.blocky = n.blocky or k.blocky or k.tag in BLOCK
                n.pictured = n.pictured or k.pictured or k.tag in ("img", "svg", "select", "iframe", "embed", "object")
        n.size = size


def compose_shadows(root: Node) -> None:
    """Declarative shadow roots in place of their hosts' children, which go to the slots of their names."""
    shadows = [n for n in root.walk() if n.tag == "template" and n.up is not None and (n.attrs.get("shadowrootmode") or n.attrs.get("shadowroot"))]
    for shadow in shadows:
        host = shadow.up
        light: dict[str, list] = {}
        for k in host.kids:
            if k is not shadow:
                light.setdefault(k.attrs.get("slot", "") if isinstance(k, Node) else "", []).append(k)
        for slot in [n for n in shadow.walk() if n.tag == "slot"]:
            slot.kids = light.pop(slot.attrs.get("name", ""), None) or slot.kids
            slot.tag = "span"
            for k in slot.elements():
                k.up = slot
        host.kids = shadow.kids
        for k in host.elements():
            k.up = host


def first(root: Node, tag: str) -> Node | None:
    return next((n for n in root.walk() if n.tag == tag), None)


def unwrap_noscript(root: Node, shell: int = 150, least: int = 100) -> None:
    """A page that is nothing without scripts but says what it holds in noscript is read from there."""
    body = first(root, "body") or root
    parts = [n for n in body.walk() if n.tag == "noscript"]
    words = sum(len(n.text().split()) for n in parts)
    if parts and words > least and len(body.text().split()) - words < shell:
        for n in parts:
            n.tag = "div"


def hidden_by(node: Node) -> str | None:
    """How an element is hidden: as a renderer measured it, else by its own attributes."""
    a = node.attrs
    if HIDDEN_BY in a:
        return a[HIDDEN_BY]
    if "hidden" in a:
        return "display"
    if "style" in a:
        style = a["style"].replace(" ", "").lower()
        if "display:none" in style:
            return "display"
        if "visibility:hidden" in style:
            return "visibility"
    return None


def off_the_page(node: Node) -> bool:
    """An inline style that puts an element where nobody can scroll to."""
    style = node.attrs.get("style", "")
    if "px" not in style:
        return False
    placed = re.search(r"(?:^|;)\s*position\s*:\s*(?:absolute|fixed)\b", style, re.I)
    return any(float(px) >= OFFSCREEN_PIXELS and (placed or name.lower() not in ("left", "top", "right", "bottom")) for name, px in OFFSCREEN.findall(style))


def closed_dialog(node: Node) -> bool:
    if node.tag == "dialog":
        return "open" not in node.attrs
    if node.attrs.get("role", "").strip().lower() in ("dialog", "alertdialog"):
        return hidden_by(node) in ABSENT or node.attrs.get("aria-hidden", "").strip().lower() == "true"
    return False


def is_permalink(node: Node) -> bool:
    if node.tag != "a":
        return False
    if PERMALINKS.intersection(x.lower() for x in node.classes()):
        return True
    if not node.attrs.get("href", "").startswith("#"):
        return False
    said = "".join(node.text().split())
    return bool(said) and set(said) <= PERMALINK_SIGNS


def for_screen_readers(node: Node) -> bool:
    """Edit controls beside headings, and clipped labels but those that are headings of their own."""
    names = {x.lower() for x in node.classes()}
    if names & EDIT_CONTROLS:
        return True
    return bool(names & SCREEN_READER) and not (node.tag in ("h1", "h2", "h3") and len(node.text().split()) >= 4)


def squeezed(node: Node) -> str:
    return "".join(node.text().split())


def clean(root: Node, keep_hidden: bool) -> None:
    """Take out what is not on the page: permalinks, closed dialogs, clipped and off-screen text, hidden elements that
    nothing opens or that repeat a visible sibling, pictures beside formulas; formulas become text."""
    named, hidden, marked, doomed, maths, opened = False, [], [], [], [], set()
    for n in root.walk():
        a, tag = n.attrs, n.tag
        if tag == "math" or tag == "script" and a.get("type", "").startswith("math/tex"):
            maths.append(n)
        if tag not in ("pre", "code", "script", "style", "textarea"):
            for i, k in enumerate(n.kids):
                if k.__class__ is str and "\\" in k:
                    n.kids[i] = re.sub(r"\\\((.+?)\\\)", r"$\1$", re.sub(r"\\\[(.+?)\\\]", r"$$\1$$", k, flags=re.S), flags=re.S)
        if not a and tag != "dialog":
            continue
        if tag == "a" and is_permalink(n) or closed_dialog(n):
            doomed.append(n)
        elif not keep_hidden and ("class" in a and for_screen_readers(n) or a.get(HIDDEN_BY) == "clipped" or "style" in a and off_the_page(n) and n.text()):
            doomed.append(n)
        elif hidden_by(n):
            hidden.append(n)
        if not EDITORS.isdisjoint(n.classes()):
            named = True
        for key in OPENERS:
            if key in a:
                opened.update(v.lstrip("#") for v in a[key].split())
        if a.get("href", "").startswith("#"):
            opened.add(a["href"][1:])
    drop(doomed)
    if not keep_hidden and hidden:
        drop_twins(hidden)
        marked = [n for n in hidden if hidden_by(n) in UNSHOWN and not any(hidden_by(u) in UNSHOWN for u in n.ups())]
        drop([n for n in marked if n.text() and not reachable(n, opened) and not (named and first(n, "pre"))])
    for n in maths:
        formula_text(n)


def reachable(node: Node, opened: set[str]) -> bool:
    """Whether a control on the page opens a hidden element, one within it or one around it."""
    role = lambda n: n.attrs.get("role", "").strip().lower()
    if any(n.attrs.get("id") in opened or role(n) in OPEN_ROLES for n in node.walk()):
        return True
    for u in node.ups():
        if u.tag == "details" or role(u) in OPEN_ROLES:
            return True
        if u.attrs.get("id") in opened and u.tag not in ("html", "body", "main", "article") and role(u) not in ("main", "document"):
            return True
    return False


def drop_twins(hidden: list[Node]) -> None:
    """Hidden children that together, or one by one, say what their visible siblings say."""
    parents = {id(n.up): n.up for n in hidden if n.up is not None}
    for parent in parents.values():
        absent = [k for k in parent.elements() if hidden_by(k) in ABSENT]
        gone = {id(k) for k in absent}
        said = "".join(squeezed(k) for k in absent)
        shown = "".join("".join(k.split()) if isinstance(k, str) else squeezed(k) for k in parent.kids if id(k) not in gone)
        if said and said == shown:
            drop(absent)
            continue
        others = {squeezed(k) for k in parent.elements() if not hidden_by(k)}
        drop([k for k in parent.elements() if hidden_by(k) and (t := squeezed(k)) and t in others])


def formula_text(node: Node) -> None:
    """A formula as delimited LaTeX in place of its markup, without the picture or the layout drawn beside it."""
    holder = node.up
    if holder is None:
        return
    if node.tag == "script":
        formula, display = node.text() or "".join(k for k in node.kids if isinstance(k, str)).strip(), "mode=display" in node.attrs.get("type", "").replace(" ", "")
        drop([k for k in holder.elements() if any(c.startswith(("MathJax", "mjx")) for c in k.classes()) or k.tag == "mjx-container"])
    else:
        formula, display = latex(node), node.attrs.get("display") == "block"
        top = holder
        for _ in range(2):  # the holder of the formula and its picture
            drop([k for k in top.elements() if k.tag == "img" and ("math" in k.names() or k.attrs.get("alt", "").startswith(("{\\", "\\", "$")))])
            if top.up is None or top.tag in BLOCK:
                break
            top = top.up
    if formula:
        mark = "$$" if display else "$"
        holder.kids = [f"{mark}{formula}{mark}" if k is node else k for k in holder.kids]
    else:
        drop([node])
