"""MathML trees to LaTeX."""

from __future__ import annotations

from collections.abc import Callable

#: Signs whose LaTeX name differs from themselves.
SIGNS = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int", "∞": r"\infty", "≤": r"\leq", "≥": r"\geq", "≠": r"\neq", "×": r"\times", "·": r"\cdot", "±": r"\pm", "→": r"\to", "∈": r"\in", "∂": r"\partial", "√": r"\surd", "−": "-", "α": r"\alpha", "β": r"\beta", "γ": r"\gamma", "δ": r"\delta", "ε": r"\epsilon", "λ": r"\lambda", "μ": r"\mu", "π": r"\pi", "σ": r"\sigma", "θ": r"\theta", "φ": r"\phi", "ω": r"\omega", "{": r"\{", "}": r"\}", "%": r"\%", "⁡": "", "⁢": ""}
ACCENTS = {"^": "hat", "¯": "bar", "‾": "overline", "→": "vec", "~": "tilde", "˙": "dot"}
NODES = 2000


def latex(math) -> str:
    """LaTeX of a math element: the author's own annotation, else alttext, else by structure; '' if it is too large."""
    for n in math.walk():
        if n.tag == "annotation" and "tex" in n.attrs.get("encoding", "").lower():
            return n.text()
    if math.attrs.get("alttext"):
        return math.attrs["alttext"].strip()
    if sum(1 for _ in math.walk()) > NODES:
        return ""
    return " ".join(_node(math).split())


def _group(text: str) -> str:
    return text if len(text) == 1 else "{" + text + "}"


def _node(n) -> str:
    kids = [k for k in n.kids if not isinstance(k, str)]
    part: Callable[[int], str] = lambda i: _node(kids[i]).strip() if i < len(kids) else ""
    if n.tag in ("mi", "mn", "mo", "mtext", "ms"):
        text = n.text()
        if n.tag == "mtext":
            return rf"\text{{{text}}}"
        if n.tag == "mi" and len(text) > 1 and text.isalpha() and text not in SIGNS:
            return rf"\{text} " if text in ("sin", "cos", "tan", "log", "ln", "exp", "lim", "max", "min") else rf"\mathrm{{{text}}}"
        return "".join(SIGNS.get(c, c) + (" " if SIGNS.get(c, "").startswith("\\") else "") for c in text)
    if n.tag == "mfrac":
        return rf"\frac{{{part(0)}}}{{{part(1)}}}"
    if n.tag == "msqrt":
        return rf"\sqrt{{{''.join(map(_node, kids)).strip()}}}"
    if n.tag == "mroot":
        return rf"\sqrt[{part(1)}]{{{part(0)}}}"
    if n.tag in ("msub", "munder"):
        return f"{_group(part(0)) if n.tag == 'msub' else part(0)}_{_group(part(1))} "
    if n.tag in ("msup", "mover"):
        if n.tag == "mover" and (accent := ACCENTS.get(kids[1].text() if len(kids) > 1 else "")):
            return rf"\{accent}{{{part(0)}}}"
        return f"{_group(part(0)) if n.tag == 'msup' else part(0)}^{_group(part(1))} "
    if n.tag in ("msubsup", "munderover"):
        return f"{part(0)}_{_group(part(1))}^{_group(part(2))} "
    if n.tag == "mtable":
        rows = [" & ".join(_node(c).strip() for c in r.kids if not isinstance(c, str)) for r in kids]
        return r"\begin{matrix} " + r" \\ ".join(rows) + r" \end{matrix}"
    if n.tag == "mfenced":
        return n.attrs.get("open", "(") + ",".join(_node(k).strip() for k in kids) + n.attrs.get("close", ")")
    if n.tag in ("annotation", "annotation-xml", "mphantom"):
        return ""
    return "".join(map(_node, kids))
