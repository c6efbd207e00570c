"""TEI as the HTML of the reading theme, by a table of rules: an element's rule says what it becomes, and what has none keeps its name and attributes.

Rules are looked up by name, within a heading first by name under head. A null or broken document is null; comments and
processing instructions go; text and attributes are escaped."""

from __future__ import annotations

from collections.abc import Callable
from xml.dom import Node, minidom
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What elements become, and the class that it has.
PLAIN = {
    "hi": ("em", None), "q": ("q", None), "quote": ("blockquote", None), "table": ("table", None), "row": ("tr", None), "cell": ("td", None), "lg": ("div", "lg"), "l": ("p", "l"), "speaker": ("span", "speaker"), "stage": ("p", "stage"),
    "epigraph": ("p", "epigraph"), "subtitle": ("p", "subtitle"), "trailer": ("p", "trailer"), "opener": ("p", "opener"), "closer": ("p", "closer"),
}
HEADINGS = {f"div{n}": f"h{n}" for n in range(1, 9)}
SEPARATOR = '<p class="deco-title-author-separator">❖</p>'
MAPPED = ("data-source-path", "data-fragment-from", "data-fragment-to", "data-fragment-version")
UNMAPPED = ("data-projection-id", "data-fragment-text-from", "data-fragment-text-to")


def _name(node) -> str:
    return (node.localName or node.nodeName).split(":")[-1]


def _tag(name: str, attributes: list[tuple[str, str]], inner: str | None) -> str:
    own = "".join(f" {k}={_quoted(v)}" for k, v in attributes)
    return f"<{name}{own}/>" if inner is None else f"<{name}{own}>{inner}</{name}>"


def _quoted(value: str) -> str:
    return '"' + escape(value, {'"': "&quot;"}) + '"'


def _mapped(node) -> list[tuple[str, str]]:
    return [(a, node.getAttribute(a)) for a in MAPPED if node.hasAttribute(a)]


def _text(node) -> str:
    return node.data if node.nodeType in (Node.TEXT_NODE, Node.CDATA_SECTION_NODE) else "".join(_text(c) for c in node.childNodes if c.nodeType != Node.COMMENT_NODE)


class Theme:
    """The rules with what they need beside the document: who wrote it, and at which address it stands."""

    def __init__(self, author: str = "", address: str = ""):
        self.author, self.address = author, address
        self.rules: dict[str, Callable] = {name: self._plain(*rule) for name, rule in PLAIN.items()}
        self.rules |= {"head": self._head, "lb": lambda n, h: "<br/>", "note": self._note, "sp": self._speech, "ptr": self._pointer, "figure": self._figure, "sourceDesc": self.inner}
        self.in_heading: dict[str, Callable] = {"label": lambda n, h: _tag("span", [("class", "head-label")], self.inner(n, h)), "lb": lambda n, h: " "}

    def of(self, node, heading: bool = False) -> str:
        if node.nodeType in (Node.TEXT_NODE, Node.CDATA_SECTION_NODE):
            return escape(node.data)
        if node.nodeType != Node.ELEMENT_NODE:
            return ""
        name = _name(node)
        if name in ("anchor", "ptr") and _name(node.parentNode) == "head":
            return ""
        rule = (self.in_heading.get(name) if heading else None) or self.rules.get(name, self._other)
        return rule(node, heading)

    def inner(self, node, heading: bool = False) -> str:
        return "".join(self.of(c, heading) for c in node.childNodes)

    def _plain(self, tag: str, kind: str | None) -> Callable:
        return lambda n, h: _tag(tag, ([("class", kind)] if kind else []) + _mapped(n), self.inner(n, h))

    def _other(self, node, heading: bool) -> str:
        own = [(k, v) for k, v in node.attributes.items() if not k.startswith("xmlns") and k not in UNMAPPED]
        kind = [("class", node.getAttribute("rend"))] if node.hasAttribute("rend") else []
        return _tag(_name(node), kind + [(k, v) for k, v in own if not (kind and k == "class")], self.inner(node, heading))

    def _head(self, node, _) -> str:
        kind, inner = node.parentNode.getAttribute("type") if node.parentNode.nodeType == Node.ELEMENT_NODE else "", self.inner(node, True)
        if not kind:
            return _tag("p", [("class", "unspecified-heading"), *_mapped(node)], inner)
        if kind not in HEADINGS:
            return ""
        more = SEPARATOR + _tag("h2", [("class", "author")], escape(self.author)) if kind == "div1" else ""
        return _tag(HEADINGS[kind], _mapped(node), inner) + more

    def _note(self, node, _) -> str:
        number = _tag("sup", [], escape(node.getAttribute("n")))
        return _tag("button", [("type", "button"), ("class", "btn note"), ("data-toggle", "tooltip"), ("data-placement", "top"), ("title", _text(node))], number)

    def _speech(self, node, heading: bool) -> str:
        who = [("data-who", node.getAttribute("who").replace("#", ""))] if node.hasAttribute("who") else []
        return _tag("div", [("class", "sp"), *_mapped(node), *who], self.inner(node, heading))

    def _pointer(self, node, heading: bool) -> str:
        target, below = node.getAttribute("target"), any(c.nodeType == Node.ELEMENT_NODE for c in node.childNodes)
        return _tag("a", [("href", target)], self.inner(node, heading) if below else escape(target))

    def _figure(self, node, _) -> str:
        own = next((c for c in node.childNodes if c.nodeType == Node.ELEMENT_NODE and _name(c) == "binaryObject"), None)
        return _tag("img", [("class", "illustration"), ("src", f"{self.address}/_binary/{own.getAttribute('xml:id') if own else ''}")], None)


def html_of(source: str | None, author: str | None = "", address: str | None = "") -> str | None:
    try:
        root = minidom.parseString((source or "").encode()).documentElement
    except Exception:  # noqa: BLE001  any column may hold broken XML
        return None
    return Theme(author or "", address or "").of(root)


def themed(xml: Column, author: Column, address: Column) -> Column:
    """Documents as HTML of the theme; author and address go where the rules want them."""

    @F.pandas_udf("string")
    def run(sources: pd.Series, authors: pd.Series, addresses: pd.Series) -> pd.Series:
        return pd.Series([html_of(*r) for r in zip(sources, authors, addresses, strict=True)], dtype=object)

    return run(xml, author, address)
