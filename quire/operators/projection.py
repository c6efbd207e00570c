"""A division's text with the place of each of its nodes, and slices of it as text, HTML or with a passage marked."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from html import escape
from typing import NamedTuple
from xml.dom import Node, minidom

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quire.operators.fragments import MOST, Selector, parse_selector, units
from quire.sources.tei import IMAGE, local

LARGEST = 8 << 20
NODES = 100_000
VERSION = "fragment-projection-v1\n"
# HTML tags for elements; others are spans.
TAGS = {"p": "p", "head": "h2", "div": "section", "l": "div", "lg": "div", "list": "ul", "item": "li", "table": "table", "row": "tr", "cell": "td", "hi": "em", "note": "aside", "q": "q", "quote": "blockquote"}


class Span(NamedTuple):
    start: int
    end: int


class Projection:
    """Offsets are in UTF-16 units. Nodes are addressed by steps: positions among element children."""

    def __init__(self, xml: str):
        if len(xml.encode()) > LARGEST:
            raise ValueError("division too large")
        self.revision = hashlib.sha256((VERSION + xml).encode()).hexdigest()
        self.root = minidom.parseString(xml.encode()).documentElement
        self.parts: list[str] = []
        self.at, self.count = 0, 0
        self.spans: dict[tuple[int, ...], Span] = {}
        self.nodes: dict[tuple[int, ...], Node] = {}
        self._walk(self.root, (), True)
        self.text = "".join(self.parts)
        self._raw = self.text.encode("utf-16-le")

    def _put(self, text: str) -> None:
        self.parts.append(text)
        self.at += units(text)

    def _walk(self, node: Node, steps: tuple[int, ...], last: bool) -> None:
        self.count += 1
        if self.count > NODES:
            raise ValueError("too many nodes")
        if node.nodeType != Node.ELEMENT_NODE:
            self._put(node.data)
            return
        name, start = local(node), self.at
        if name == "lb":
            self._put("\n")
        elif name in ("figure", "binaryObject"):
            self._put(IMAGE)
        else:
            if name == "note":
                self._put(" [")
            kept = [c for c in node.childNodes if c.nodeType == Node.ELEMENT_NODE or c.nodeType in (Node.TEXT_NODE, Node.CDATA_SECTION_NODE) and c.data.strip()]
            n = 0
            for i, child in enumerate(kept):
                n += child.nodeType == Node.ELEMENT_NODE
                self._walk(child, (*steps, n) if child.nodeType == Node.ELEMENT_NODE else steps, i == len(kept) - 1)
            if name == "note":
                self._put("]\n")
            elif name == "label":
                self._put(" ")
        self.spans[steps] = Span(start, self.at)
        self.nodes[steps] = node
        if not last and name in ("p", "lg", "table", "l", "head"):
            self._put("\n\n" if name == "head" else "\n")

    def cut(self, start: int, end: int) -> str:
        try:
            return self._raw[2 * start : 2 * end].decode("utf-16-le")
        except UnicodeDecodeError:
            raise ValueError("offset inside a surrogate pair") from None

    def boundary(self, steps: tuple[int, ...], offset: int | None, end: bool) -> int:
        span = self.spans.get(steps)
        if span is None:
            raise LookupError("no such node")
        if offset is None:
            return span.end if end else span.start
        if offset > span.end - span.start:
            raise ValueError("offset outside the node")
        return span.start + offset

    def resolve(self, selector: str | Selector, revision: str | None = None) -> dict:
        """text, html, start, end, selector, revision. ValueError for ranges that are empty, reversed or too long, or another revision."""
        if revision is not None and revision != self.revision:
            raise ValueError("the division has changed")
        own = parse_selector(selector) if isinstance(selector, str) else selector
        start = self.boundary(own.start.steps, own.start.offset, False)
        last = own.end or own.start
        end = self.boundary(last.steps, last.offset if own.end else None, True)
        if not start < end or end - start > MOST:
            raise ValueError("empty, reversed or too long a range")
        return {"text": self.cut(start, end), "html": self.html(start, end), "start": start, "end": end, "selector": own.normal(), "revision": self.revision}

    def html(self, start: int, end: int, mark: bool = False) -> str:
        """The slice inside its ancestors; mark: the whole division with the slice in mark elements."""
        at = 0

        def own(text: str) -> str:
            nonlocal at
            a, b = at, at + units(text)
            at = b
            raw = text.encode("utf-16-le")
            piece = lambda x, y: escape(raw[2 * max(0, x - a) : 2 * max(0, min(b, y) - a)].decode("utf-16-le", "ignore"))
            inner = piece(max(a, start), end) if a < end and b > start else ""
            if not mark:
                return inner
            return piece(a, min(start, b)) + (f"<mark>{inner}</mark>" if inner else "") + piece(max(end, a), b)

        def walk(node: Node, last: bool) -> str:
            if node.nodeType != Node.ELEMENT_NODE:
                return own(node.data)
            name = local(node)
            if name == "lb":
                return "<br>" if own("\n") else ""
            if name in ("figure", "binaryObject"):
                return own(IMAGE)
            kept = [c for c in node.childNodes if c.nodeType == Node.ELEMENT_NODE or c.nodeType in (Node.TEXT_NODE, Node.CDATA_SECTION_NODE) and c.data.strip()]
            inner = (own(" [") if name == "note" else "") + "".join(walk(c, i == len(kept) - 1) for i, c in enumerate(kept))
            inner += own("]\n") if name == "note" else own(" ") if name == "label" else ""
            tag = TAGS.get(name, "span")
            out = f"<{tag}>{inner}</{tag}>" if inner else ""
            if not last and name in ("p", "lg", "table", "l", "head"):
                own("\n\n" if name == "head" else "\n")
            return out

        return walk(self.root, True)


def to_json(node: Node) -> dict | str:
    """A node as {name, attributes, children}."""
    if node.nodeType != Node.ELEMENT_NODE:
        return node.data
    return {"name": local(node), "attributes": {k: v for k, v in node.attributes.items() if not k.startswith("xmlns")}, "children": [to_json(c) for c in node.childNodes if c.nodeType in (Node.ELEMENT_NODE, Node.TEXT_NODE, Node.CDATA_SECTION_NODE)]}


PROJECTED = "text string, revision string, spans array<struct<steps:string,start:int,end:int>>, error string"
RESOLVED = "text string, html string, json string, start int, end int, selector string, revision string, path string, pages array<string>, error string"


def projected(rows: DataFrame, key: str, xml: str) -> DataFrame:
    """key, text, revision, spans (of each node, in order of their start), error of the divisions in an XML column."""

    def one(source: str | None) -> dict:
        try:
            p = Projection(source or "")
        except Exception as e:  # noqa: BLE001  any column may hold broken or too large XML; the row says so
            return {"text": None, "revision": None, "spans": None, "error": str(e)[:200] or type(e).__name__}
        spans = sorted(((s.start, -s.end, steps) for steps, s in p.spans.items()))
        return {"text": p.text, "revision": p.revision, "spans": [{"steps": ".".join(map(str, steps)), "start": a, "end": -b} for a, b, steps in spans], "error": None}

    return _mapped(rows.select(key, xml), key, PROJECTED, lambda r: one(r[xml]))


def resolved_fragments(rows: DataFrame, key: str, xml: str, path: str, selector: str, revision: str | None = None) -> DataFrame:
    """key and RESOLVED: what a selector names in a division: its text, HTML and JSON, the canonical address with its revision, and the
    pages (elements of the division) on which it begins and ends; or why it names nothing. A blank selector names the whole division."""

    def one(r: dict) -> dict:
        none = dict.fromkeys(x.split()[0] for x in RESOLVED.split(", "))
        try:
            p = Projection(r[xml] or "")
            if not (r[selector] or "").strip():
                if revision and r[revision] is not None and r[revision] != p.revision:
                    raise ValueError("the division has changed")
                if not p.text or units(p.text) > MOST:
                    raise ValueError("empty, reversed or too long a range")
                found = {"text": p.text, "html": p.html(0, units(p.text)), "start": 0, "end": units(p.text), "selector": "", "revision": p.revision}
                ends, node = [], p.root
            else:
                own = parse_selector(r[selector])
                found = p.resolve(own, r[revision] if revision else None)
                last = own.end or own.start
                ends, node = [own.start.steps[0], last.steps[0]], p.nodes[own.start.steps]
            at = "/" + (r[path] or "").strip("/")
            pages = list(dict.fromkeys(f"{at}/_{i}" for i in ends)) or [at]
            return none | found | {"json": json.dumps(to_json(node), ensure_ascii=False), "path": f"{at}{'/' + found['selector'] if found['selector'] else ''}?rev={p.revision}", "pages": pages}
        except (ValueError, LookupError) as e:
            return none | {"error": str(e)[:200]}
        except Exception as e:  # noqa: BLE001  broken XML
            return none | {"error": f"no XML: {e}"[:200]}

    columns = list(dict.fromkeys([key, xml, path, selector, *([revision] if revision else [])]))
    return _mapped(rows.select(*columns), key, RESOLVED, one)


def _mapped(rows: DataFrame, key: str, schema: str, one) -> DataFrame:
    """one(row) of each row, with its key, in Arrow batches."""
    kind = rows.schema[key].dataType.simpleString()
    full = f"`{key}` {kind}, {schema}"
    arrow = to_arrow_schema(rows.sparkSession.createDataFrame([], full).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 100):
                part = b.slice(at, 100).to_pylist()
                yield pa.RecordBatch.from_pylist([{key: r[key], **one(r)} for r in part], arrow)

    return rows.mapInArrow(run, full)


FORMS = ("text", "xml", "json", "html")


def rendered(xml: Column, form: str = "text", depth: int | None = None) -> Column:
    """A division's XML as a document's text, XML, JSON or HTML, with its own divisions down to some levels; null for what is no XML."""
    from quire.functions import dom
    from quire.sources.tei import document_text

    if form not in FORMS:
        raise ValueError(f"one of {', '.join(FORMS)}")

    def one(source: str | None) -> str | None:
        try:
            root = minidom.parseString((source or "").encode()).documentElement
            if depth is not None:
                dom.pruned(root, depth)
            if form == "text":
                return document_text(root)
            if form == "json":
                return json.dumps(to_json(root), ensure_ascii=False)
            if form == "xml":
                return root.toxml()
            p = Projection(root.toxml())
            return p.html(0, units(p.text))
        except Exception:  # noqa: BLE001  any column may hold broken XML
            return None

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(one)

    return run(xml)
