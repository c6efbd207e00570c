"""Links of HTML pages, and walking them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.shared import written

HREF = 'href="([^"]*)"'


def links(pages: DataFrame) -> DataFrame:
    """page_id, href: every link, repeats included."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("href"))


def child_links(pages: DataFrame, base: str) -> DataFrame:
    """page_id, href: distinct links one level below base, without a fragment or further level."""
    rest = F.substr(F.col("href"), F.lit(len(base) + 1))
    return links(pages).where(F.startswith("href", F.lit(base)) & (rest != "") & ~rest.rlike("[#/]")).distinct()


def walk(edges: DataFrame, start: str) -> DataFrame:
    """Paths (from, to) reached from start: each once, with its least depth; leaves have no further link. A level is written once; the walk ends with the first that reaches nothing new."""
    seen = level = written(edges.sparkSession.createDataFrame([(start, 0)], "path string, depth int"), "walk")
    while not level.isEmpty():
        reached = level.join(edges, level["path"] == edges["from"]).groupBy(F.col("to").alias("path")).agg((F.min("depth") + 1).alias("depth"))
        level = written(reached.join(seen, "path", "left_anti"), "walk")
        seen = seen.unionAll(level)
    leaf = edges.select(F.col("from").alias("path")).distinct().withColumn("_inner", F.lit(True))
    return seen.join(leaf, "path", "left").select("path", "depth", F.col("_inner").isNull().alias("leaf"))
