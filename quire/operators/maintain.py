"""Keeping the catalogue in order: freshness, pruning, orphans, merging authors, filling in metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def fresher(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (filename, modified) that aren't known (filename, timestamp) or were changed since."""
    joined = files.join(known.select("filename", "timestamp"), "filename", "left")
    return joined.where(~F.coalesce(F.col("timestamp") > F.col("modified"), F.lit(False))).drop("timestamp")


def not_held_back(files: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """files without those whose failures (filename, attempts, last, modified) are too recent, unless the file changed since."""
    wait = T.backoff_hours(F.col("attempts")) * 3600
    held = failures.where((F.unix_timestamp(now) - F.unix_timestamp("last")) < wait).select("filename", F.col("modified").alias("_m"))
    return files.join(held, (files["filename"] == held["filename"]) & (files["modified"] == held["_m"]), "left_anti")


def removed(known: DataFrame, present: DataFrame, key: str) -> DataFrame:
    return known.join(present.select(key).distinct(), key, "left_anti")


def orphans(rows: DataFrame, parents: DataFrame, key: str, of: str) -> DataFrame:
    """Rows whose reference is null or names no parent (an anti-join keeps null references)."""
    own = parents.select(F.col(of).alias("_k")).distinct()
    return rows.join(own, rows[key] == own["_k"], "left_anti")


def variants(authors: DataFrame, name: str = "original_name") -> DataFrame:
    """key, n, ids of authors whose names are spellings of one: groups of two or more."""
    keyed = authors.withColumn("key", T.name_key(F.col(name))).where("key != ''")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).where("n > 1")


def canonical(rows: DataFrame, by: str, count: str, id_: str = "id") -> DataFrame:
    """Of each group the row with the largest count, then the smallest id."""
    best = Window.partitionBy(by).orderBy(F.desc(count), F.asc(id_))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def merge_map(authors: DataFrame, files: DataFrame, name: str = "original_name") -> DataFrame:
    """id, target: every author of a variant group that isn't its canonical one, with the canonical one."""
    n = files.groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("n_files"))
    keyed = authors.withColumn("key", T.name_key(F.col(name))).where("key != ''").join(n, "id", "left").select("id", "key", F.coalesce("n_files", F.lit(0)).alias("n_files"))
    best = canonical(keyed, "key", "n_files").select("key", F.col("id").alias("target"))
    return keyed.join(best, "key").where("id != target").select("id", "target")


def merged(authors: DataFrame, moves: DataFrame, fill: list[str]) -> DataFrame:
    """Authors without the merged ones; the canonical ones take what they lack from these (the smallest id that has it)."""
    given = authors.join(moves, "id").select("target", "id", *fill)
    first = [F.min_by(c, F.when(F.col(c).isNotNull() & (F.trim(F.col(c)) != ""), F.col("id"))).alias(f"_{c}") for c in fill]
    extra = given.groupBy(F.col("target").alias("id")).agg(*first)
    kept = authors.join(moves.select("id"), "id", "left_anti").join(extra, "id", "left")
    own = {c: F.coalesce(F.when(F.trim(F.col(c)) != "", F.col(c)), F.col(f"_{c}"), F.col(c)) for c in fill}
    return kept.select(*(own[c].alias(c) if c in own else F.col(c) for c in authors.columns))


def moved_references(rows: DataFrame, moves: DataFrame, column: str, unique: list[str] | None = None) -> DataFrame:
    """Rows with merged ids replaced; unique: columns of which the result keeps one row."""
    step = moves.select(F.col("id").alias(column), F.col("target").alias("_t"))
    out = rows.join(step, column, "left").withColumn(column, F.coalesce("_t", column)).drop("_t")
    return out.dropDuplicates(unique) if unique else out


def enriched(rows: DataFrame, given: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """Rows with blank columns (or, if overwrite, all that are given) filled from given."""
    new = given.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    text = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c))
    pick = lambda c: F.coalesce(text(f"_{c}"), F.col(c)) if overwrite else F.coalesce(text(c), F.col(f"_{c}"), F.col(c))
    return rows.join(new, key, "left").select(*(pick(c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def image_urls(urls: Column, most: int = 3) -> Column:
    """The first few http(s) URLs with their content type."""
    kind = lambda u: F.when(u.rlike(r"(?i)\.png($|\?)"), "image/png").when(u.rlike(r"(?i)\.gif($|\?)"), "image/gif").when(u.rlike(r"(?i)\.webp($|\?)"), "image/webp").when(u.rlike(r"(?i)\.svg($|\?)"), "image/svg+xml").otherwise("image/jpeg")
    return F.transform(F.slice(F.filter(urls, lambda u: u.rlike("^https?://")), 1, most), lambda u: F.struct(u.alias("url"), kind(u).alias("type")))


def images_added(media: DataFrame, given: DataFrame, path: str = "path", url: str = "url", role: str = "ENRICHMENT") -> DataFrame:
    """media (path, url, role) with the images (path, urls) that enrichment gives: none for a path that has any of the role already, none twice."""
    has = media.where(F.col("role") == role).select(path).distinct()
    new = given.join(has, path, "left_anti").select(path, F.explode(image_urls(F.col("urls"))["url"]).alias(url)).distinct()
    return media.unionByName(new.join(media.select(path, url), [path, url], "left_anti").withColumn("role", F.lit(role)), allowMissingColumns=True)


def without_image_data(c: Column) -> Column:
    """Null where a description is really base64 image data (fixed values: how PNG, JPEG and GIF begin in base64)."""
    return F.when(c.rlike("^(iVBORw0KGgo|/9j/|R0lGOD)"), F.lit(None)).otherwise(c)


def not_repeated(requests: DataFrame, key: str, at: str, minutes: int) -> DataFrame:
    """Requests of which none of the key was granted in the minutes before: one in each, counted from the one granted.

    Rows are sorted by key and time within partitions and streamed: what is kept is the last grant of one key."""
    from collections.abc import Iterator

    import numpy as np
    import pyarrow as pa

    least = minutes * 60_000_000

    def granted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last = object(), 0
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (k, t) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if k != last_key or t - last >= least:
                    keep[i], last_key, last = True, k, t
            yield b.filter(pa.array(keep))

    rows = requests.where(F.col(at).isNotNull()).select(key, F.unix_micros(F.col(at).cast("timestamp")).alias("_us"))
    rows = rows.repartition(key).sortWithinPartitions(key, "_us")
    return rows.mapInArrow(granted, rows.schema).select(key, F.timestamp_micros("_us").cast(requests.schema[at].dataType).alias(at))


def replaced(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Existing rows with those of the keys that new has (a file that is imported again) replaced by new ones."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def import_plan(files: DataFrame, known: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """filename, action: import, hold (failed of late), keep or prune, for every file on disk or known."""
    fresh = fresher(files, known)
    go = not_held_back(fresh, failures, now).select("filename", F.lit("import").alias("_a"))
    held = removed(fresh, go, "filename").select("filename", F.lit("hold").alias("_a"))
    gone = removed(known, files, "filename").select("filename", F.lit("prune").alias("_a"))
    rest = files.select("filename").join(fresh.select("filename"), "filename", "left_anti").select("filename", F.lit("keep").alias("_a"))
    return go.unionAll(held).unionAll(gone).unionAll(rest).withColumnRenamed("_a", "action")
