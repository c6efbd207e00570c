"""XPath over XML columns, in the JVM; what a cover shows, in one reading. Paths carry no prefixes: elements match by local name, with or without a namespace."""

from __future__ import annotations

import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T

# Where a TEI header, and a work itself (the element in which it stands), keep what a cover shows: elements from the root down (** for
# any between, * for any root), an attribute of the last, and its values that count (None: it isn't there).
HEADER = {
    "editor": ("TEI/teiHeader/fileDesc/titleStmt/editor", "role", (None, "editor")),
    "translator": ("TEI/teiHeader/fileDesc/titleStmt/editor", "role", ("translator",)),
    "pubPlace": ("TEI/teiHeader/fileDesc/publicationStmt/pubPlace", None, ()),
    "date": ("TEI/teiHeader/fileDesc/editionStmt/edition/date", None, ()),
    "isbn": ("TEI/teiHeader/fileDesc/sourceDesc/**/idno", "type", ("ISBN",)),
    "series": ("TEI/teiHeader/fileDesc/seriesStmt/title", None, ()),
    "volume": ("TEI/teiHeader/fileDesc/seriesStmt/biblScope", "unit", ("volume",)),
    "genre": ("TEI/teiHeader/profileDesc/textClass/keywords/term", None, ()),
}
#: Of this element only the text that stands right in it.
EDITION_NOTICE = "TEI/teiHeader/fileDesc/editionStmt/edition"
WORK = {"subtitle": ("*/subtitle", None, ()), "tagline_quote": ("*/epigraph", None, ())}
PUBLISHER = "Biblioteca"
LICENCE = "/TEI/teiHeader/fileDesc/publicationStmt/availability"


def plain(xml: Column) -> Column:
    """XML without a document type and without default namespaces, which xpath() doesn't know."""
    return F.regexp_replace(F.regexp_replace(xml, r"<!DOCTYPE[^>]*>", ""), r"\sxmlns=(\"[^\"]*\"|'[^']*')", "")


def strings(xml: Column, path: str) -> Column:
    """The texts of all matches."""
    return F.xpath(plain(xml), F.lit(path + "//text()"))


def string(xml: Column, path: str) -> Column:
    """The texts of all matches, with nothing between them; empty if none match."""
    return F.array_join(strings(xml, path), "")


def matches(xml: Column, path: str) -> Column:
    return F.xpath_int(plain(xml), F.lit(f"count({path})"))


def only(xml: Column, path: str) -> Column:
    """The text of the one match; an error for none or several."""
    return F.when(matches(xml, path) == 1, F.xpath_string(plain(xml), F.lit(path))).otherwise(F.raise_error(F.lit(f"not exactly one {path}")).cast("string"))


def _at(path: list[str], stack: list[str]) -> bool:
    if "**" in path:
        i = path.index("**")
        return len(stack) >= len(path) - 1 and stack[:i] == path[:i] and stack[-1] == path[-1]
    return len(path) == len(stack) and all(p in ("*", e) for p, e in zip(path, stack, strict=True))


def texts_at(xml: str | None, places: dict[str, tuple[str, str | None, tuple]], own: dict[str, str] | None = None) -> dict[str, str]:
    """The text within the elements at each of some places, in one reading; own: places whose elements' text counts only right in them. Names are compared as written."""
    out: dict[str, list[str]] = {k: [] for k in (*places, *(own or {}))}
    rules = [(k, p.split("/"), attribute, values) for k, (p, attribute, values) in places.items()]
    direct = {k: p.split("/") for k, p in (own or {}).items()}
    stack: list[str] = []
    within: list[list[str]] = []

    def start(name: str, attributes: dict[str, str]) -> None:
        stack.append(name)
        above = within[-1] if within else []
        new = [k for k, p, a, values in rules if k not in above and p[-1] == name and _at(p, stack) and (a is None or attributes.get(a) in values)]
        within.append(above + new if new else above)

    def end(_: str) -> None:
        stack.pop()
        within.pop()

    def text(data: str) -> None:
        for k in within[-1]:
            out[k].append(data)
        for k, p in direct.items():
            if p == stack:
                out[k].append(data)

    if xml:
        parser = expat.ParserCreate()
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
        parser.Parse(re.sub(r"<!DOCTYPE[^>]*>", "", xml), True)
    return {k: "".join(v) for k, v in out.items()}


def book_metadata(header: Column, work: Column, head: Column, author: Column, lang: Column) -> Column:
    """A struct of what a cover shows, from the header's XML, the work's own XML, and its row; empty where nothing is said. Each XML is read once."""

    @F.pandas_udf(", ".join(f"{k} string" for k in (*HEADER, "edition_notice", *WORK)))
    def read(headers: pd.Series, works: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([texts_at(h, HEADER, {"edition_notice": EDITION_NOTICE}) | texts_at(w, WORK) for h, w in zip(headers, works, strict=True)], columns=[*HEADER, "edition_notice", *WORK])

    told = lambda c: F.coalesce(c, F.lit(""))
    row = {"title": told(head), "author": told(author), "publisher": F.lit(PUBLISHER), "language": told(lang)}
    keys = sorted((*HEADER, "edition_notice", *WORK, *row))
    found = F.transform(F.array(read(header, work)), lambda x: F.struct(*((row[k] if k in row else x[k]).alias(k) for k in keys)))
    return F.element_at(found, 1)


def licence_text(xml: Column) -> Column:
    """The licence with the targets of its pointers."""
    base = LICENCE
    targets = F.xpath(plain(xml), F.lit(f"{base}//@target"))
    return T.squeeze(F.concat_ws(" ", string(xml, base), F.array_join(targets, " ")))
