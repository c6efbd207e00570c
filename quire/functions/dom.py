"""Nodes of XML columns by position, and XML without some of its elements: what xpath() can't give. Arrow batches of Python."""

from __future__ import annotations

from collections.abc import Callable
from xml.dom import Node, minidom

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def local(node: Node) -> str:
    return (node.localName or node.nodeName).split(":")[-1]


def elements(node: Node) -> list[Node]:
    return [c for c in node.childNodes if c.nodeType == Node.ELEMENT_NODE]


def dom_path(node: Node) -> str:
    """Places from the document down, from 1, among children of all kinds."""
    out = []
    while node.parentNode is not None:
        out.append(str(node.parentNode.childNodes.index(node) + 1))
        node = node.parentNode
    return "/".join(reversed(out))


def at_dom_path(root: Node, path: str) -> Node | None:
    """The node at such a path; None if the document has none there any more."""
    for step in path.split("/"):
        i = int(step) - 1
        if not 0 <= i < len(root.childNodes):
            return None
        root = root.childNodes[i]
    return root


def x_path(node: Node) -> str:
    """Names from the document down. A name has its number among those of the same name wherever the node has any element beside it."""
    out = []
    while node.parentNode is not None:
        beside = elements(node.parentNode)
        same = [e for e in beside if local(e) == local(node) and e.namespaceURI == node.namespaceURI]
        out.append(local(node) + (f"[{same.index(node) + 1}]" if len(beside) > 1 else ""))
        node = node.parentNode
    return "/" + "/".join(reversed(out))


def whole_text(node: Node) -> str:
    if node.nodeType in (Node.TEXT_NODE, Node.CDATA_SECTION_NODE):
        return node.data
    return "".join(map(whole_text, node.childNodes))


def removed(node: Node, names: frozenset[str]) -> None:
    """Takes away all elements of some names, with what is in them."""
    for child in elements(node):
        if local(child) in names:
            node.removeChild(child)
        else:
            removed(child, names)


def has_heading(div: Node) -> bool:
    head = next((e for e in elements(div) if local(e) == "head"), None)
    return head is not None and bool(whole_text(head).strip())


def pruned(node: Node, levels: int) -> None:
    """Takes away divisions more than some levels below the node. A division without a heading is no level: what is in it counts as its parent's."""
    for child in elements(node):
        if local(child) != "div":
            continue
        if not has_heading(child):
            pruned(child, levels)
        elif levels <= 0:
            node.removeChild(child)
        else:
            pruned(child, levels - 1)


def _of(xml: Column, use: Callable[[minidom.Document], str | None], other: Column | None = None) -> Column:
    """use of each parsed document; null for a null, and for what is no XML."""

    two = other is not None

    def one(text, more=None):
        if text is None:
            return None
        try:
            doc = minidom.parseString(text.encode())
        except Exception:  # noqa: BLE001  any column may hold broken XML
            return None
        return use(doc, more) if two else use(doc)

    if not two:

        @F.pandas_udf("string")
        def run(s: pd.Series) -> pd.Series:
            return s.map(one)

        return run(xml)

    @F.pandas_udf("string")
    def run_two(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([one(a, b) for a, b in zip(s, t, strict=True)], dtype=object)

    return run_two(xml, other)


def text_at(xml: Column, path: Column) -> Column:
    """The text of the node at a dom path; null where there is none."""

    def use(doc, at):
        node = at_dom_path(doc, at) if at else None
        return None if node is None else whole_text(node)

    return _of(xml, use, path)


def without(xml: Column, *names: str) -> Column:
    """The XML without elements of some names below its root."""

    def use(doc):
        removed(doc.documentElement, frozenset(names))
        return doc.documentElement.toxml()

    return _of(xml, use)


def to_depth(xml: Column, levels: int | None) -> Column:
    """A division's XML with its own divisions down to some levels; None keeps all."""

    def use(doc):
        if levels is not None:
            pruned(doc.documentElement, levels)
        return doc.documentElement.toxml()

    return _of(xml, use)


def x_paths(xml: Column, name: str) -> Column:
    """The paths of all elements of a name, in order, one a line."""
    return _of(xml, lambda doc: "\n".join(x_path(e) for e in doc.getElementsByTagName("*") if local(e) == name))
