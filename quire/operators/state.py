"""Readers' state as keyed tables: progress, collections, saved searches, versioned workspaces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

READ_AFTER = 3


def progress(visits: DataFrame, user: str, work: str, at: str, division: str, tie: str) -> DataFrame:
    """user, work, touches, division (last), at (last), read: visits folded by user and work. A plain aggregate: max_by keeps the last."""
    last = F.max_by(division, F.struct(at, tie))
    out = visits.groupBy(user, work).agg(F.count("*").alias("touches"), last.alias("division"), F.max(at).alias("at"))
    return out.withColumn("read", F.col("touches") >= READ_AFTER)


def attention(rows: DataFrame, by: list[str], seconds: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(seconds).alias("attention_seconds"))


def scrolls(updates: DataFrame, current: DataFrame, by: list[str], division: str, fraction: str, *at: str) -> DataFrame:
    """The last scroll position of each key, of updates for its current division only, within 0 and 1. at: a total order."""
    own = updates.join(current.select(*by, division), [*by, division], "left_semi")
    return own.groupBy(*by).agg(F.max_by(T.clamp(F.col(fraction)), F.struct(*at)).alias("scroll"))


def reading_state(events: DataFrame, by: list[str], kind: str, division: str, value: str, *at: str) -> DataFrame:
    """What a log of events (kind: save, scroll or attention) comes to for each reader and work.

    touches, division (of the last save), attention_seconds, scroll, read, refused. A save of another division starts at its
    top, one of the same division keeps the place. A scroll update counts if it names the division that is saved at that
    time. Updates before the first save are refused and only counted."""
    order = Window.partitionBy(*by).orderBy(*at)
    before = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    saved = F.when(F.col(kind) == "save", F.col(division))
    rows = events.withColumn("_now", F.last(saved, ignorenulls=True).over(before)).withColumn("_was", F.lag("_now").over(order))
    place = F.struct(*at)
    moved = (F.col(kind) == "save") & ~F.col("_now").eqNullSafe(F.col("_was"))
    here = (F.col(kind) == "scroll") & F.col("_now").isNotNull() & (F.col("_now") == F.col(division))
    known = F.col("_now").isNotNull()
    out = rows.groupBy(*by).agg(
        F.count_if(F.col(kind) == "save").alias("touches"),
        F.max_by("_now", place).alias("division"),
        F.coalesce(F.sum(F.when((F.col(kind) == "attention") & known, F.col(value))), F.lit(0.0)).alias("attention_seconds"),
        F.max(F.when(moved, place)).alias("_moved"),
        F.max(F.when(here, F.struct(place.alias("p"), T.clamp(F.col(value)).alias("v")))).alias("_scroll"),
        F.count_if((F.col(kind) != "save") & ~known).alias("refused"),
    )
    scroll = F.when(F.col("_scroll.p") > F.col("_moved"), F.col("_scroll.v")).otherwise(F.lit(0.0))
    return out.select(*by, "touches", "division", "attention_seconds", F.when(F.col("touches") > 0, scroll).alias("scroll"), (F.col("touches") >= READ_AFTER).alias("read"), "refused")


def reordered(items: DataFrame, listed: DataFrame, by: str, id_: str, old: str) -> DataFrame:
    """Adds position: the ids of listed (id, place) first, in that order, the others after them as they were."""
    joined = items.join(listed.select(id_, "place"), id_, "left")
    w = Window.partitionBy(by).orderBy(F.col("place").asc_nulls_last(), old, id_)
    return joined.withColumn("position", F.row_number().over(w) - 1).drop("place")


def next_order(items: DataFrame, by: str, order: str) -> DataFrame:
    return items.groupBy(by).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_order"))


MAX_NAME = 200
MAX_QUERY = 500
MAX_SNIPPET = 2000


def first_free(base: str, used: set[str], most: int = MAX_NAME) -> str:
    """base, or with " (2)", " (3)", ... the first that isn't used; cut so that it keeps the limit."""
    return _first_free(base, used, most)[0]


def _first_free(base: str, used: set[str], most: int = MAX_NAME, n: int = 2) -> tuple[str, int]:
    """The name, and the number to go on with: all before it are used. n: such a number, where one is known."""
    name = base
    while name in used:
        suffix = f" ({n})"
        name, n = base[: most - len(suffix)] + suffix, n + 1
    return name, n


#: Characters of a stem, at most: numbering a name that is too long never cuts so much of it.
STEM = 100


def unique_names(saved: DataFrame, owner: str, name: str, order: str) -> DataFrame:
    """saved, in order, with names that their owner has not used before.

    All that a name may become begins with its stem (up to where a number in brackets starts), so names of an owner with different stems never
    meet: those of one stem come in order to one function, which goes on numbering where it stopped. Null names stay."""
    names, at = saved.columns, saved.columns.index(name)
    stem = F.substring(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)^(.*?)(?: \([0-9].*)?\z", 1), 1, STEM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used, going = None, set(), {}
        for b in batches:
            out = []
            for key in zip(b.column("_owner").to_pylist(), b.column("_stem").to_pylist(), b.column(at).to_pylist(), strict=True):
                if group != key[:2]:
                    group, used, going = key[:2], set(), {}
                base = own = key[2]
                if base is not None:
                    own, going[base] = _first_free(base, used, n=going.get(base, 2))
                    used.add(own)
                out.append(own)
            columns = [b.column(c) for c in names]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = saved.withColumn("_owner", F.col(owner).cast("string")).withColumn("_stem", stem).repartition("_owner", "_stem").sortWithinPartitions("_owner", "_stem", F.col(order).asc_nulls_last())
    return rows.mapInArrow(run, saved.schema)


def searches_saved(hits: DataFrame, searches: DataFrame, owner: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Saved searches (owner, order, name, query) as collections, and their hits (owner, order, place, path, snippet) as items.

    The name is the query where none is given; blank queries are refused, blank paths left out, positions close up."""
    if not searches.where(F.coalesce(F.trim("query"), F.lit("")) == "").isEmpty():
        raise ValueError("a search has a query")
    base = F.substring(F.trim(F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.col("query"))), 1, MAX_NAME)
    named = unique_names(searches.withColumn("name", base), owner, "name", order).withColumn("query", F.substring("query", 1, MAX_QUERY))
    kept = hits.where(F.coalesce(F.trim("path"), F.lit("")) != "").withColumn("snippet", F.substring("snippet", 1, MAX_SNIPPET))
    position = F.row_number().over(Window.partitionBy(owner, order).orderBy("place")) - 1
    return named, kept.withColumn("position", position)


def compare_and_set(stored: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """stored (key, revision, value) after updates (key, revision, value) that name the current revision, one for each key at most."""
    new = updates.join(stored.select(key, "revision"), [key, "revision"])
    one = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("value"))).where("_n = 1").select(key, (F.col("revision") + 1).alias("_r"), F.col("value").alias("_v"))
    joined = stored.join(one, key, "left")
    return joined.select(key, F.coalesce("_r", "revision").alias("revision"), F.when(F.col("_r").isNotNull(), F.col("_v")).otherwise(F.col("value")).alias("value"))


def preference(c: Column, path: str) -> Column:
    """A value of a JSON column, null where the JSON is bad or has none."""
    return F.try_variant_get(F.try_parse_json(c), f"$.{path}", "string")


FAVOURITES = "favourites"


def collection_added(collections: DataFrame, owner: str, name: str) -> DataFrame:
    """collections (owner, name, ...) with one more; ValueError for a bad or used name."""
    if not name.strip() or len(name) > MAX_NAME:
        raise ValueError("bad name")
    if not collections.where((F.col("owner") == owner) & (F.col("name") == name.strip())).isEmpty():
        raise ValueError("name is used")
    row = collections.sparkSession.range(1).select(F.lit(owner).alias("owner"), F.lit(name.strip()).alias("name"))
    return collections.unionByName(row, allowMissingColumns=True)


def collection_removed(collections: DataFrame, items: DataFrame, owner: str, name: str) -> tuple[DataFrame, DataFrame]:
    """collections and items (owner, name, ...) without one; favourites stay."""
    if name == FAVOURITES:
        raise ValueError("favourites can't be removed")
    other = ~((F.col("owner") == owner) & (F.col("name") == name))
    return collections.where(other), items.where(other)


def items_added(items: DataFrame, new: DataFrame, by: list[str], order: str = "sort_order") -> DataFrame:
    """Items with new ones (place: their order among themselves) behind those that their collection has."""
    last = items.groupBy(*by).agg(F.max(order).alias("_m"))
    n = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    own = new.withColumn("_n", n).join(last, by, "left").withColumn(order, (F.coalesce("_m", F.lit(-1)) + F.col("_n")).cast(items.schema[order].dataType))
    return items.unionByName(own.drop("_n", "_m", "place"), allowMissingColumns=True)


def available(failures: DataFrame, by: str, at: str, now: Column, cooldown_seconds: int) -> DataFrame:
    """by, available: whether the last failure of a service is a cooldown ago."""
    last = failures.groupBy(by).agg(F.max(at).alias("_at"))
    return last.select(by, (F.unix_timestamp(now) - F.unix_timestamp("_at") >= cooldown_seconds).alias("available"))
