"""Repositories of text files: listing, reading, language by path, and repositories combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.shared import written

# The language codes of the catalogue.
LANGUAGES = ("bg", "br", "ca", "da", "de", "en", "es", "fi", "fr", "gr", "hu", "it", "la", "nl", "no", "pt", "ro", "ru", "zh")


def listed(spark: SparkSession, root: str, find: str | None = None) -> DataFrame:
    """name (below root), modified, bytes, content of the .xml files at any depth. Only what is selected is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[xX][mM][lL]").load(root)
    inner = F.regexp_replace(F.col("path"), r"^[a-zA-Z][\w+.-]*:/*", "/")
    base = "/" + root.split(":", 1)[-1].strip("/") + "/"
    named = files.select(F.when(F.startswith(inner, F.lit(base)), F.substr(inner, F.lit(len(base) + 1))).otherwise(inner).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")
    return named if find is None else named.where(F.col("name").rlike(f"(?i){find}"))


def combined(repos: list[DataFrame], name: str = "name") -> DataFrame:
    """One row for each name, of the first repository that has it; repo is that one's number from 1."""
    out = None
    for i, r in enumerate(repos, 1):
        own = r.withColumn("repo", F.lit(i).cast("long"))
        out = own if out is None else out.unionByName(own)
    first = Window.partitionBy(name).orderBy("repo")
    return out.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def language_hint(name: Column) -> Column:
    """The first path segment that is a language code."""
    return F.try_element_at(F.filter(F.split(F.lower(name), "/"), lambda s: s.isin(*LANGUAGES)), F.lit(1))


def settings(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a properties file: lines k=v, those with # left out."""
    lines = spark.read.text(path).where("trim(value) != '' and not ltrim(value) like '#%'")
    return lines.select(F.trim(F.substring_index("value", "=", 1)).alias("key"), F.trim(F.regexp_extract("value", "^[^=]*=(.*)$", 1)).alias("value"))


def union_all(repos: list[DataFrame], enabled: list[bool] | None = None) -> DataFrame:
    """What all enabled repositories list, names that several have included."""
    out = None
    for i, r in enumerate(repos, 1):
        if enabled is None or enabled[i - 1]:
            own = r.withColumn("repo", F.lit(i).cast("long"))
            out = own if out is None else out.unionByName(own)
    return repos[0].limit(0).withColumn("repo", F.lit(0).cast("long")) if out is None else out


#: What a repository lists if it isn't told otherwise.
GLOBS = ("**/*.tei.xml", "**/*.xml")


def matches_globs(name: Column, globs: tuple[str, ...] = GLOBS) -> Column:
    """Whether a name below the root matches any of some globs: ** any folders, * and ? within one. Names that leave the root match none."""
    found = F.lit(False)
    for g in globs:
        found = found | name.rlike("^" + _regex(g) + "$")
    leaves = F.exists(F.split(name, "/"), lambda s: s == "..") | F.startswith(name, F.lit("/"))
    return F.coalesce(found & ~leaves, F.lit(False))


def _regex(glob: str) -> str:
    import re

    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    kinds = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(kinds.get(p) or re.escape(p) for p in parts if p)


def globbed(files: DataFrame, globs: tuple[str, ...] = GLOBS) -> DataFrame:
    """Listed files (name, ...) that match any of the globs, each once, by name."""
    return files.where(matches_globs(F.col("name"), globs)).dropDuplicates(["name"]).orderBy("name")


def entries(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a resource, each once, trimmed, without those that begin with #."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("not value like '#%'").distinct()


def special_authors(spark: SparkSession, path: str) -> DataFrame:
    """display_name, str_id, first_name, last_name of lines key=str_id;first;last;display; an error for a line without four parts."""
    parts = F.split(F.regexp_extract("value", "^[^=]*=(.*)$", 1), ";", -1)
    checked = F.when(F.size(parts) == 4, parts).otherwise(F.raise_error(F.lit("a special author has four parts")).cast("array<string>"))
    rows = entries(spark, path).where("value != ''").select(checked.alias("p"))
    return rows.select(*(F.trim(F.col("p")[i]).alias(n) for i, n in ((3, "display_name"), (0, "str_id"), (1, "first_name"), (2, "last_name"))))


def numbered(rows: DataFrame, key: str, size: int = 1000) -> DataFrame:
    """rows with batch (from 0): so many rows each, in order of a key (ties by the other columns). Each partition of a sort knows its
    rows' places once the sizes of those before it are known; only these sizes come to the driver."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [key, *(c for c in rows.columns if c != key)]
    own = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the lower 33 bits count within a partition, the upper ones are its number
    own = written(own.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftrightunsigned("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    before, at = {}, 0
    for r in own.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row a partition
        before[r["p"]], at = at, at + r["count"]
    start = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))[part] if before else F.lit(0)
    return own.withColumn("batch", F.floor((start + place) / size).cast("long")).drop("_id")


def in_batches(rows: DataFrame, key: str, size: int = 1000):
    """The rows in order of a key, as lists of some size, for a caller who takes them one by one: one batch is here at a time. For work on a cluster, see numbered()."""
    own = numbered(rows, key, size)
    order = [key, *(c for c in rows.columns if c != key)]
    for n in range((own.agg(F.max("batch")).first()[0] or 0) + 1):
        held = own.where(F.col("batch") == n).drop("batch").orderBy(*order).collect()  # size rows
        if held:
            yield held


def binary_object(content: Column, xml_id: str) -> Column:
    """The bytes of the embedded object with this xml:id; null if there is none."""
    from quire.functions import xml
    from quire.functions.text import binary_object as decoded

    found = F.xpath(xml.plain(content), F.lit(f"//binaryObject[@*[name()='xml:id' or local-name()='id']='{xml_id}']/text()"))
    return F.when(F.size(found) > 0, decoded(F.array_join(found, "")))
