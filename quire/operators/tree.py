"""The hierarchy of works: paths, preorder, neighbours, leaves, paragraphs, depth. Paths are materialised once, then joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.shared import written


def paths(elems: DataFrame, id_: str = "id", parent: str = "parent_id", name: str = "slug", order: str = "pos") -> DataFrame:
    """id, root_id, path, depth (0 for roots) and place (array of sibling orders: its order is preorder).

    A level is one equi-join of the elements with the level above, written once: no level is computed again, whatever the
    depth. It ends with the first level without rows; elements in a cycle hang on no root and come in no level."""
    own = elems.select(F.col(id_).alias("id"), F.col(parent).alias("parent_id"), F.col(name).alias("name"), F.struct(F.col(order).alias("o"), F.col(id_).alias("i")).alias("o"))
    level = out = written(own.where("parent_id is null").select("id", F.col("id").alias("root_id"), F.col("name").alias("path"), F.lit(0).alias("depth"), F.array("o").alias("place")), "level")
    below = written(own.where("parent_id is not null"), "elements")
    while True:
        up = level.select(F.col("id").alias("parent_id"), "root_id", F.col("path").alias("up"), F.col("place").alias("above"), "depth")
        level = written(below.join(up, "parent_id").select("id", "root_id", F.concat_ws("/", "up", "name").alias("path"), (F.col("depth") + 1).alias("depth"), F.concat("above", F.array("o")).alias("place")), "level")
        if level.isEmpty():
            return out
        out = out.unionAll(level)


def preorder(placed: DataFrame, by: str = "root_id") -> DataFrame:
    """pos from 1 in each root's tree."""
    return placed.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("place")))


def neighbours(rows: DataFrame, by: str, order: str, of: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn(f"prev_{of}", F.lag(of).over(w)).withColumn(f"next_{of}", F.lead(of).over(w))


def leaves(elems: DataFrame, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    """Rows that are no row's parent. (A left-anti join: null parents don't matter.)"""
    up = elems.select(F.col(parent).alias("_up")).where("_up is not null").distinct()
    return elems.join(up, elems[id_] == up["_up"], "left_anti")


def child_counts(elems: DataFrame, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    n = elems.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias(id_)).agg(F.count("*").alias("children"))
    return elems.select(id_).join(n, id_, "left").select(id_, F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def breadcrumb(path: Column) -> Column:
    """The path's ancestors from the top, itself last."""
    parts = T.path_fragments(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def pruned(placed: DataFrame, root_depth: int, levels: int | None) -> DataFrame:
    return placed if levels is None else placed.where(F.col("depth") - root_depth <= levels)


def paragraphs(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, nth (from 1), text: the lines of a text."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "text")).select(key, (F.col("n") + 1).alias("nth"), "text")


def slice_of(rows: DataFrame, by: list[str], order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit of each unit."""
    w = Window.partitionBy(*by).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where((F.col("_n") > offset) & (F.col("_n") <= offset + limit)).drop("_n")


def joined_text(rows: DataFrame, by: str, order: str, text: str = "text", mark: str = "\n\n") -> DataFrame:
    """by, content: texts in order, blank ones left out."""
    kept = rows.where(F.trim(text) != "")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return kept.groupBy(by).agg(F.array_join(ordered, mark).alias("content"))


def frontier(placed: DataFrame, depth: int, id_: str = "id", parent: str = "parent_id") -> DataFrame:
    """Of rows (id, parent_id, path, depth), those that an export writes: at the depth, or above it without children."""
    kids = placed.select(F.col(parent).alias("_p")).where("_p is not null").distinct()
    marked = placed.join(kids, placed[id_] == kids["_p"], "left")
    return marked.where((F.col("depth") == depth) | ((F.col("depth") < depth) & F.col("_p").isNull())).drop("_p")


def spans(rows: DataFrame, by: str, order: str, text: str = "text", gap: int = 1) -> DataFrame:
    """Character offsets of nodes in their unit's text, with gap characters between them."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0))
    return rows.withColumn("start", start.cast("long")).withColumn("end", (start + F.length(text)).cast("long"))


def virtual(files: DataFrame, folders: list[str], name: str, columns: list[str], ending: str = ".txt") -> DataFrame:
    """path, is_file and columns of an exported tree: a file for each row, under the folders that columns name, and these."""
    at = lambda n: F.concat(*(x for c in folders[:n] for x in (F.lit("/"), F.col(c))))
    out = files.select(F.concat(at(len(folders)), F.lit("/"), F.col(name), F.lit(ending)).alias("path"), F.lit(True).alias("is_file"), *columns)
    for n in range(1, len(folders) + 1):
        own = files.select(at(n).alias("path")).distinct()
        out = out.unionAll(own.select("path", F.lit(False).alias("is_file"), *(F.lit(None).cast(files.schema[c].dataType).alias(c) for c in columns)))
    return out


def member_neighbours(rows: DataFrame, by: str, order: str, of: str, member) -> DataFrame:
    """The row of one member with those before and after it; ValueError if it is none."""
    own = neighbours(rows, by, order, of).where(F.col(of) == member)
    if own.isEmpty():
        raise ValueError(f"{member} is not in the table of contents")
    return own


def to_levels(placed: DataFrame, levels: int | None, headed: str = "headed", deepest: int | None = None) -> DataFrame:
    """Of trees' rows (path, depth, place, headed), those at most some levels below their root. A row without a heading is no level: what is below it counts as its parent's.

    place begins with the root's. Rows no deeper than the levels need no look at what is above them. The deeper ones are joined with the headed rows of one depth
    at a time, and go on only while they are within the levels. A place counts once, however many rows have it. deepest: the size of the longest place, which is
    looked up where it isn't given; a longer one than given is an error."""
    if levels is None:
        return placed
    size, title = F.size("place"), F.coalesce(F.col(headed).cast("int"), F.lit(0))
    key = lambda p: F.xxhash64(p)  # noqa: E731  numbers are sorted faster than arrays; these are compared where numbers are equal
    out = placed.where(size <= levels + 1)
    below = placed.where(size > levels + 1).withColumn("_n", title)
    if deepest is None:
        deepest = placed.agg(F.max(size)).first()[0] or 0
    else:
        below = below.where(F.when(size <= deepest, True).otherwise(F.raise_error(F.lit(f"a place is longer than {deepest}")).cast("boolean")))
    for n in range(1, deepest):
        if n > levels + 1:  # rows of this depth have met all that is above them
            below = written(below, "below")
            out = out.unionAll(below.where(size <= n).drop("_n"))
            below = below.where(size > n)
        up = placed.where((size == n) & (title == 1)).select(key("place").alias("_k"), F.col("place").alias("_p")).distinct()
        above = F.slice("place", 1, n)
        met = below.withColumn("_a", above).join(up, (key(F.col("_a")) == F.col("_k")) & (F.col("_a") == F.col("_p")), "left")
        below = met.withColumn("_n", F.col("_n") + F.when(F.col("_k").isNull(), 0).otherwise(1)).drop("_k", "_p", "_a").where(F.col("_n") <= levels + 1)
    return out.unionAll(below.where(F.col("_n") <= levels + 1).drop("_n"))


def listing(works: DataFrame, authors: str = "authors") -> DataFrame:
    """place (from 1, among the entries of its folder) and path of each folder and work of an exported tree: languages by code, authors by
    identifier, an author's works by filename and fragment. works: lang, authors (array of identifiers), filename, fragment."""
    rows = works.where("lang is not null").select("lang", F.explode(authors).alias("author"), "filename", "fragment").distinct()
    at = lambda *c: F.concat_ws("/", F.lit(""), *c)
    langs = rows.select("lang").distinct().select(F.lit("").alias("folder"), at("lang").alias("path"), F.struct(F.col("lang").alias("a"), F.lit("").alias("b")).alias("_o"))
    people = rows.select("lang", "author").distinct().select(at("lang"), at("lang", "author"), F.struct("author", F.lit("")))
    own = rows.select(at("lang", "author"), at("lang", "author", "fragment"), F.struct("filename", "fragment"))
    every = langs.unionAll(people).unionAll(own)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("folder").orderBy("_o"))).drop("_o")


def exported(placed: DataFrame, works: DataFrame, depth: int, ending: str = ".txt", authors: str = "authors") -> DataFrame:
    """folder, path, place (from 1 within the folder), collection of all entries of an export: languages, authors, works, and the divisions below these.

    placed: rows of paths() with parent_id; works: root_id, lang, authors (array of identifiers), filename. A division is a file if it has none below or lies at
    the depth (works have 1), which ends the folders; a file's name ends in `ending`. Works come by filename and slug, divisions in their order."""
    kids = placed.select(F.col("parent_id").alias("_p")).where("_p is not null").distinct()
    shown = placed.where(F.col("depth") < depth).join(kids, placed["id"] == kids["_p"], "left")
    file = (F.col("depth") + 1 >= depth) | F.col("_p").isNull()
    own = shown.join(works.where("lang is not null").select("root_id", "lang", F.explode(authors).alias("author"), "filename"), "root_id")
    at = F.concat_ws("/", F.lit(""), "lang", "author", "path")
    work_order = F.when(F.col("depth") == 0, F.struct(F.col("filename").alias("f"), F.col("path").alias("p")))
    entries = own.select(F.regexp_replace(at, "/[^/]*$", "").alias("folder"), F.concat(at, F.when(file, ending).otherwise("")).alias("path"), (~file).alias("collection"), work_order.alias("_w"), "place")
    below = entries.withColumn("_n", F.row_number().over(Window.partitionBy("folder").orderBy("_w", "place"))).select("folder", "path", F.col("_n").alias("place"), "collection")
    tops = listing(works.select("lang", authors, "filename", F.lit("").alias("fragment")), authors).where(F.size(T.path_fragments(F.col("folder"))) < 2).where(F.size(T.path_fragments(F.col("path"))) <= 2)
    return tops.select("folder", "path", "place", F.lit(True).alias("collection")).unionAll(below)
