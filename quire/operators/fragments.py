"""Addresses inside a text: selectors, legacy ranges, and the text between two points.

Offsets count UTF-16 units, as in the addresses that exist; slices never split a surrogate pair."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LONGEST = 1000
STEPS = 64
MOST = 30_000
#: _a.b:off..c.d:off, a fixed format; groups: steps, offset, steps, offset.
GRAMMAR = r"^_(\d+(?:\.\d+)*)(?::(\d+))?(?:\.\.(\d+(?:\.\d+)*)(?::(\d+))?)?$"


class Point(NamedTuple):
    steps: tuple[int, ...]
    offset: int | None


class Selector(NamedTuple):
    start: Point
    end: Point | None

    def normal(self) -> str:
        show = lambda p: ".".join(map(str, p.steps)) + ("" if p.offset is None else f":{p.offset}")
        return "_" + show(self.start) + (f"..{show(self.end)}" if self.end else "")


def parse_selector(raw: str) -> Selector:
    """ValueError if it is none: too long, a step below 1, too many steps, or a single point with an offset."""
    m = re.match(GRAMMAR, raw) if len(raw) <= LONGEST else None
    if not m:
        raise ValueError("bad selector")
    a, x, b, y = m.groups()
    points = [Point(tuple(map(int, s.split("."))), None if o is None else int(o)) for s, o in ((a, x), (b, y)) if s]
    if any(min(p.steps) < 1 or len(p.steps) > STEPS for p in points) or len(points) == 1 and points[0].offset is not None:
        raise ValueError("bad selector")
    return Selector(points[0], points[1] if len(points) > 1 else None)


def parse_legacy(raw: str) -> tuple[tuple[int, ...], int]:
    """Steps from 1 and a last offset from 0, separated by dots."""
    parts = raw.split(".")
    if len(parts) < 2 or not all(p.isdigit() for p in parts) or any(int(p) < 1 for p in parts[:-1]):
        raise ValueError("bad range point")
    return tuple(int(p) for p in parts[:-1]), int(parts[-1])


def selector_columns(c: Column) -> Column:
    """struct(valid, start, start_offset, end, end_offset): the selector by regular expressions, in the JVM."""
    part = lambda i: F.regexp_extract(c, GRAMMAR, i)
    steps = lambda i: F.when(part(i) != "", F.transform(F.split(part(i), r"\."), lambda s: s.try_cast("int")))
    offset = lambda i: F.nullif(part(i), F.lit("")).try_cast("int")
    fine = lambda i: F.coalesce((F.size(steps(i)) <= STEPS) & F.forall(steps(i), lambda s: F.coalesce(s >= 1, F.lit(False))), F.lit(True))
    lone = (part(3) == "") & (part(2) != "")
    valid = (F.length(c) <= LONGEST) & c.rlike(GRAMMAR) & fine(1) & fine(3) & ~lone
    return F.struct(valid.alias("valid"), steps(1).alias("start"), offset(2).alias("start_offset"), steps(3).alias("end"), offset(4).alias("end_offset"))


def units(text: str) -> int:
    return len(text.encode("utf-16-le")) // 2


def cut(text: str, start: int | None, end: int | None) -> str:
    """Between two offsets in UTF-16 units; ValueError outside the text or inside a pair."""
    raw = text.encode("utf-16-le")
    a, b = (start or 0) * 2, len(raw) if end is None else end * 2
    if not 0 <= a <= b <= len(raw):
        raise ValueError("offset outside the text")
    try:
        return raw[a:b].decode("utf-16-le")
    except UnicodeDecodeError:
        raise ValueError("offset inside a surrogate pair") from None


def resolve(paragraphs: list[str], first: int, start: int | None, last: int, end: int | None) -> str:
    """Paragraphs first to last (from 1), the ends trimmed to the offsets; ValueError for reversed, empty or outside ranges."""
    if not 1 <= first <= last <= len(paragraphs):
        raise ValueError("paragraph outside the division")
    own = paragraphs[first - 1 : last]
    if first == last:
        out = cut(own[0], start, end)
    else:
        out = "\n".join([cut(own[0], start, None), *own[1:-1], cut(own[-1], None, end)])
    if not out or len(out) > MOST:
        raise ValueError("empty or too long a range")
    return out


def range_text(paragraphs: DataFrame, by: str, first: int, start: int, last: int, end: int) -> DataFrame:
    """by, text: the range of each unit that has it, for texts of the basic plane (where a character is a unit)."""
    own = paragraphs.where((F.col("nth") >= first) & (F.col("nth") <= last))
    text = F.col("text")
    text = F.when(F.col("nth") == last, F.substring(text, 1, end)).otherwise(text)
    text = F.when(F.col("nth") == first, F.substr(text, F.lit(start + 1))).otherwise(text)
    whole = F.max(F.when(F.col("nth") == last, F.length("text") >= end)) & F.max(F.when(F.col("nth") == first, F.length("text") >= start))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("nth", text.alias("t")))), lambda x: x["t"])
    return own.groupBy(by).agg(F.array_join(parts, "\n").alias("text"), whole.alias("_w")).where("_w and text != ''").drop("_w")
