"""The catalogue's joins and aggregates: works with all their authors, media, saved paths, paging and projection by selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.frames import whole

MAX_DEPTH = 12
MAX_PAGE = 100


def with_authors(works: DataFrame, file_authors: DataFrame, authors: DataFrame, how: str = "inner") -> DataFrame:
    """works (file_id, ...) with their files' authors: a row for each work and author, through the bridge file_authors (file_id,
    author_id). how: left keeps works without an author, with nulls."""
    of = file_authors.join(authors.withColumnRenamed("id", "author_id"), "author_id")
    return works.join(of, "file_id", how)


def work_counts(works: DataFrame, file_authors: DataFrame, authors: DataFrame) -> DataFrame:
    """id, works: how many works each author has, 0 included."""
    n = works.join(file_authors, "file_id").groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("works"))
    return authors.select("id").join(n, "id", "left").select("id", F.coalesce("works", F.lit(0).cast("long")).alias("works"))


def works_with_author_lists(rows: DataFrame, key: str, first: list[str], author: list[str], order: str) -> DataFrame:
    """A row for each work of rows (one for each work and author): its own columns, and its authors in order (none: empty)."""
    kept = F.filter(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *author))), lambda x: x[author[0]].isNotNull())
    names = F.transform(kept, lambda x: F.struct(*(x[a].alias(a) for a in author)))
    return rows.groupBy(key).agg(*(F.min_by(c, F.struct(order)).alias(c) for c in first), names.alias("authors"))


def media_of(authors: DataFrame, media: DataFrame, key: str, path: str, url: str, order: str) -> DataFrame:
    """path, name, urls: each owner that media (path, url, order) name, with their urls, each once, in order. An owner who isn't
    an author (key, display_name) goes by the path."""
    first = media.groupBy(path, url).agg(F.min(order).alias("_o"))
    urls = first.groupBy(path).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", url))), lambda x: x[url]).alias("urls"))
    named = urls.join(authors.select(F.col(key).alias(path), "display_name"), path, "left")
    return named.select(path, F.coalesce("display_name", path).alias("name"), "urls")


def located(items: DataFrame, divisions: DataFrame, path: str = "path") -> DataFrame:
    """Items of a collection, progress rows or media with the id and head of the division at their path; null where it is gone."""
    of = divisions.select(T.canonical_path(F.col("path")).alias("_p"), F.col("id").alias("div_id"), "head")
    return items.withColumn("_p", T.canonical_path(F.col(path))).join(of, "_p", "left").drop("_p")


def in_file_order(divisions: DataFrame) -> DataFrame:
    """By filename and then by XPath as a string (div[10] before div[2])."""
    return divisions.orderBy("filename", "xpath")


def refusing_page(rows: DataFrame, order: list[str], page: int, size: int) -> DataFrame:
    """A page from 0 on; ValueError where the catalogue's own paging would clamp."""
    if page < 0 or not 1 <= size <= MAX_PAGE:
        raise ValueError(f"page must be 0 or more and size between 1 and {MAX_PAGE}")
    return rows.orderBy(*order).offset(page * size).limit(size)


def depth_of(selection: dict | None) -> int:
    return 0 if not selection else 1 + max(depth_of(v if isinstance(v, dict) else None) for v in selection.values())


def selected(rows: DataFrame, selection: dict, kind: str | None = None) -> DataFrame:
    """Only what a selection asks for: {field: None, relation: {field: ...}, alias: "field"}. Fields of a type of their own
    stand under "... on Type"; a row of another type (by the column kind) has null there. ValueError beyond MAX_DEPTH levels."""
    if depth_of(selection) > MAX_DEPTH:
        raise ValueError(f"a selection has {MAX_DEPTH} levels at most")

    def chosen(of, own: dict, known: list[str]) -> list[Column]:
        out = []
        for name, inner in own.items():
            if name.startswith("... on "):
                mine = F.col(kind) == name.removeprefix("... on ")
                out += [F.when(mine, of(k)).alias(k) for k in inner if k in known]
            elif isinstance(inner, dict):
                out.append(F.when(of(name).isNotNull(), F.struct(*chosen(lambda k, up=of(name): up[k], inner, list(inner)))).alias(name))
            else:
                out.append(of(inner or name).alias(name))
        return out

    return rows.select(*chosen(F.col, selection, rows.columns))


def outcome(before: DataFrame, after: DataFrame, relocations: DataFrame, moves: DataFrame, references: DataFrame) -> DataFrame:
    """One row of what a new edition did: moved, parent, unrecognised (old paths without a trace), repointed and dropped (earlier
    relocations), references (rewritten). moves: old, new, reason; relocations: old, new; references: path."""
    live = after.select("path").distinct()
    gone = before.join(live, "path", "left_anti")
    lost = gone.join(moves.select(F.col("old").alias("path")), "path", "left_anti")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    to = moves.select(F.col("old").alias("new"))
    parts = [
        moves.agg(F.count_if(F.col("reason") == "MOVED").alias("moved"), F.count_if(F.col("reason") == "PARENT").alias("parent")),
        n(lost, "unrecognised"),
        n(relocations.join(live.select(F.col("path").alias("old")), "old", "left_anti").join(to, "new", "left_semi"), "repointed"),
        n(relocations.join(live.select(F.col("path").alias("old")), "old", "left_semi"), "dropped"),
        n(references.join(moves.select(F.col("old").alias("path")), "path", "left_semi"), "references"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(F.broadcast(p))  # one row each
    return out


def batch_stats(batches: DataFrame, by: list[str], size: str, seconds: str) -> DataFrame:
    """How batches went, by model: their number, mean and total size, the longest, and sizes a second."""
    return batches.groupBy(*by).agg(F.count("*").alias("batches"), F.avg(size).alias("mean"), F.sum(size).alias("total"), F.max(seconds).alias("longest"), (F.sum(size) / F.nullif(F.sum(seconds), F.lit(0.0))).alias("rate"))


def work_ids(divisions: DataFrame) -> DataFrame:
    """The ids of works alone."""
    return divisions.where("parent_id is null").select("id")


def works_of_files(divisions: DataFrame, files: DataFrame) -> DataFrame:
    """id, filename of works."""
    return work_ids_with_files(divisions).join(files.select(F.col("id").alias("file_id"), "filename"), "file_id").select("id", "filename")


def work_ids_with_files(divisions: DataFrame) -> DataFrame:
    return divisions.where("parent_id is null").select("id", "file_id")


def random_works(works: DataFrame, present: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n works by a hash of seed and id, of those whose file (filename) is still there."""
    if not 1 <= n <= 50:
        raise ValueError("1 to 50 works")
    kept = works.join(present.select("filename").distinct(), "filename", "left_semi")
    return kept.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(n)


def first_of_each(rows: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """k rows: the first of each group, then others in order. Only k rows of a group go to the window over it."""
    first = rows.groupBy(by).agg(F.min(order).alias(order))
    heads = rows.join(first, [by, order], "left_semi").withColumn("_n", F.lit(0))
    rest = rows.join(first, [by, order], "left_anti").orderBy(order).limit(k).withColumn("_n", F.lit(1))
    return heads.unionByName(rest).orderBy("_n", order).limit(k).drop("_n")


def unclashing(incoming: DataFrame, taken: DataFrame, name: str, owner: str, order: str) -> DataFrame:
    """Incoming works (owner, order, head, name) with names that no work of their owner has: those that clash are made anew from the head."""
    import pandas as pd

    from quire.functions.names import next_slug

    def fold(key, mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        used, proposals = set(others[name]), {}
        out = []
        for r in mine.sort_values(order).itertuples():
            own = getattr(r, name)
            if own in used:
                own = next_slug(r.head, used, "", proposals)
            used.add(own)
            out.append(own)
        return whole(mine.sort_values(order).assign(**{name: out}))

    return incoming.groupBy(owner).cogroup(taken.select(owner, name).groupBy(owner)).applyInPandas(fold, incoming.schema)


def merge_summary(moves: DataFrame, files: DataFrame, media: DataFrame) -> DataFrame:
    """id, target, files, media, dropped of each merge: files that change hands, media that follow, and media that the target has already."""
    n = files.join(moves.select(F.col("id").alias("author_id")), "author_id", "left_semi").groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("files"))
    own = media.join(moves, media["owner"] == moves["id"]).select("id", "target", "url")
    has = media.select(F.col("owner").alias("target"), "url").distinct().withColumn("_has", F.lit(True))
    m = own.join(has, ["target", "url"], "left").groupBy("id").agg(F.count_if(F.col("_has").isNull()).alias("media"), F.count_if(F.col("_has").isNotNull()).alias("dropped"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return moves.join(n, "id", "left").join(m, "id", "left").select("id", "target", zero("files"), zero("media"), zero("dropped"))
