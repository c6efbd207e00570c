"""Full-text ranking, grep and entity search. Every result has a total order, so limits are stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T

K1, B = 1.2, 0.75
HEAD_BOOST = 3.0
MAX_RESULTS = 500
GREP_BOUND = 50_000
#: Rows of a file of paragraphs in order.
FILE_ROWS = 50_000


def search_limit(requested: int | None) -> int:
    return min(max(10 if requested is None else requested, 1), MAX_RESULTS)


def query_terms(q: str, least: int = 3) -> list[str]:
    """Distinct terms of a query, nothing in it an operator; ValueError if it is too short."""
    import re

    if len(q.strip()) < least:
        raise ValueError(f"a query has {least} characters at least")
    return list(dict.fromkeys(re.findall(r"[^\W_]+", T.folded(q))))


def field_postings(docs: DataFrame, key: str, field: Column) -> tuple[DataFrame, DataFrame]:
    """(key, len) of all documents with a token in the field, and (key, term, tf)."""
    tokens = once(docs, key, T.tokens(field)).where(F.size("w") > 0)
    lengths = tokens.select(key, F.size("w").alias("len"))
    return lengths, tokens.select(key, F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def field_scores(docs: DataFrame, key: str, field: Column, terms: list[str]) -> DataFrame:
    """(key, score): BM25 of the field for the terms, over documents that hold one.

    Only the terms' counts leave a document (no explode of all tokens). Statistics take a pass over all documents and are
    one small row, joined by broadcast; the scoring pass reads on only where a term occurs as a substring."""
    equals = lambda t: lambda x: x == t
    counts = [F.size(F.filter("w", equals(t))).alias(f"tf{i}") for i, t in enumerate(terms)]
    some = F.lit(False)
    for t in terms:
        some = some | F.contains(T.fold(field), F.lit(t))
    held = lambda rows: once(rows, key, T.tokens(field)).select(key, F.size("w").alias("len"), *counts).where("len > 0")
    stats = held(docs).agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, df = F.col(f"tf{i}"), F.col(f"df{i}")
        idf = F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        score = score + idf * tf / (tf + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    hit = " or ".join(f"tf{i} > 0" for i in range(len(terms)))
    return held(docs.where(some)).where(hit).crossJoin(F.broadcast(stats)).select(key, score.alias("score"))  # stats is one row


def once(docs: DataFrame, key: str, value: Column) -> DataFrame:
    """key, w: a costly value, which filters above are not to compute again (they stop at a generator)."""
    return docs.select(key, F.explode(F.array(value)).alias("w"))


def top(df: DataFrame, score: str, key: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(key)).limit(k)


def bm25(docs: DataFrame, key: str, q: str, k: int, content: Column, head: Column | None = None, where: Column | None = None) -> DataFrame:
    """key, score of the k best documents. where filters after the statistics, as a filter that doesn't score."""
    terms = query_terms(q)
    scores = field_scores(docs, key, content, terms)
    if head is not None:
        heads = field_scores(docs, key, head, terms).select(key, (F.col("score") * HEAD_BOOST).alias("score"))
        scores = scores.unionAll(heads).groupBy(key).agg(F.sum("score").alias("score"))
    if where is not None:
        scores = scores.join(docs.where(where).select(key), key, "left_semi")
    return top(scores, "score", key, k)


def grep(paragraphs: DataFrame, q: str, k: int, order: list[str], where: Column | None = None, bound: int | None = None) -> DataFrame:
    """The first k paragraphs, in order, that hold q in any case. bound: only so many paragraphs are looked at, in that order."""
    rows = paragraphs if where is None else paragraphs.where(where)
    if bound is not None:
        rows = rows.orderBy(*order).limit(bound)
    return rows.where(T.contains_ci(F.col("text"), q)).orderBy(*order).limit(k)


class Ordered:
    """Paragraphs on disk in their order: files of some FILE_ROWS rows, each before the next, and the first key of each.

    A search for the first few reads files in order, twice as many each time, and stops once it has them or has looked at as many paragraphs as
    it may; what comes later is never read. The list of files (a row for FILE_ROWS paragraphs) is all that the driver holds."""

    def __init__(self, spark: SparkSession, path: str, order: tuple[str, ...] = ("path", "nth")):
        self.spark, self.path, self.order = spark, path.rstrip("/"), order

    @classmethod
    def write(cls, rows: DataFrame, path: str, order: tuple[str, ...] = ("path", "nth"), file_rows: int = FILE_ROWS) -> Ordered:
        own = cls(rows.sparkSession, path, order)
        n = max(1, -(-rows.count() // file_rows))
        rows.repartitionByRange(n, *order).sortWithinPartitions(*order).write.parquet(f"{own.path}/rows")
        low = F.min(F.struct(*order)).alias("low")
        own.rows().groupBy(F.col("_metadata.file_path").alias("file")).agg(low, F.count("*").alias("n")).coalesce(1).write.parquet(f"{own.path}/files")
        return own

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def files(self) -> list[str]:
        return [r["file"] for r in self.spark.read.parquet(f"{self.path}/files").orderBy("low").select("file").collect()]

    def first(self, hit: Column, k: int, where: Column | None = None, bound: int | None = None) -> tuple[DataFrame, int]:
        """The first k rows, in order, that are hits, and how many files were looked into. bound: only the first so many rows (that where holds for) are looked at."""
        where, files = F.lit(True) if where is None else where, self.files()
        looked, seen, hits, step = [], 0, 0, 1
        while len(looked) < len(files) and hits < k and (bound is None or seen < bound):
            batch = files[len(looked) : len(looked) + step]
            rows = self.spark.read.parquet(*batch).where(where).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"), F.count_if(hit).alias("h"))
            found = {r["file"]: (r["n"], r["h"]) for r in rows.collect()}  # a row a file
            for f in batch:
                n, h = found.get(f, (0, 0))
                looked.append((f, n))
                seen, hits = seen + n, hits + h
            step *= 2
        whole, rest, left = [], [], bound
        for f, n in looked:  # the file in which the bound falls is cut; later ones are out
            if left is None or n <= left:
                whole.append(f)
                left = None if left is None else left - n
            elif left > 0:
                rest, left = [f], 0
            else:
                break
        own = self.spark.read.parquet(*whole).where(where) if whole else self.rows().limit(0)
        if rest:
            own = own.unionByName(self.spark.read.parquet(*rest).where(where).orderBy(*self.order).limit(bound - sum(n for f, n in looked if f in whole)))
        return own.where(hit).orderBy(*self.order).limit(k), len(looked)


def union_by_key(parts: list[DataFrame], key: str) -> DataFrame:
    """Rows of all parts, one for each key (parts agree on the other columns)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates([key])


def page(df: DataFrame, order: list, number: int, size: int, most: int = 100, first: int = 1) -> DataFrame:
    """A page in a total order; number and size are clamped, never refused."""
    size = min(max(size, 1), most)
    number = max(number, first) - first
    return df.orderBy(*order).offset(number * size).limit(size)


def page_totals(df: DataFrame, size: int) -> DataFrame:
    n = F.count("*")
    return df.agg(n.alias("total_items"), F.ceil(n / size).cast("long").alias("total_pages"))


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
