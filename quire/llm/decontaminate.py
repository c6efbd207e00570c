"""Operator 4, benchmark decontamination: test items of which a document holds at least 0.8 of the five-word shingles.

Method: size-partitioned MinHash containment search. Items are partitioned by their number of shingles; the partition's
upper size u sets how many minimum hashes (the smallest of one hash function, a bottom-k sketch) stand for each of its
items: u - ceil(0.8 u) + 1, or all that it has. A document that holds 0.8 of an item's shingles lacks fewer than that, so
it holds one of the sketch; the search loses nothing, however long the document. Only document shingles whose hash is not
above the largest sketch hash are looked up. Candidates are verified by exact containment of shingles, as strings.

Everything is DataFrame functions. Sketches, candidates and documents found are broadcast only while they are below a
checked size; beyond it their joins are shuffled.

Words are runs of letters and digits of the lower-cased text. An item or document of fewer than five words has no
shingles: the item matches nothing, the document holds nothing. Null texts have none. Rows with a null or repeated item_id
or doc_id are judged each on its own text, and equal (doc_id, item_id) pairs come once, with the largest containment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

SHINGLE = 5
CONTAINMENT = 0.8
#: Upper sizes of the partitions grow by this factor.
GROWTH = 1.25
#: Rows up to which a side is broadcast: sketches, candidate pairs, documents found (16 to 24 bytes each).
BROADCAST_ROWS = 1_000_000

SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS k FROM d)),
s AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS k FROM i)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id)
SELECT doc_id, item_id, CAST(count(*) AS BIGINT) AS n_shared, CAST(any_value(n) AS BIGINT) AS n_shingles, round(count(*) / any_value(n), 6) AS containment
FROM ds JOIN s USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n) - 1e-9
"""


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(w: Column) -> Column:
    """The shingles of an array of words, in order, repeats included."""
    starts = F.when(F.size(w) >= SHINGLE, F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", F.slice(w, i, SHINGLE)))


def shingled(benchmark: DataFrame) -> DataFrame:
    """item_id, s: the sorted distinct shingles of each item that has any."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") >= SHINGLE)
    return w.select("item_id", F.sort_array(F.array_distinct(shingles(F.col("w")))).alias("s"))


def allowed(n: Column) -> Column:
    """Least number of minimum hashes of an item of n shingles of which one is in any document that contains it."""
    return n - F.ceil(n * F.lit(CONTAINMENT) - 1e-9) + 1


def sketches(benchmark: DataFrame) -> DataFrame:
    """item (hash of the item's shingles), n, sketch: the bottom-k hashes by the upper size of the item's partition."""
    sets = shingled(benchmark).select("s").distinct()
    n = F.size("s")
    upper = F.floor(F.pow(F.lit(GROWTH), F.ceil(F.log(n.cast("double")) / F.log(F.lit(GROWTH))) + 1))
    own = sets.select("s", n.alias("n"), F.greatest(upper, n).alias("upper"))
    hashes = F.sort_array(F.transform("s", lambda x: F.xxhash64(x)))
    return own.select(F.xxhash64("s").alias("item"), "s", "n", F.slice(hashes, 1, F.least(F.col("n"), allowed(F.col("upper"))).cast("int")).alias("sketch"))


def verified(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, rid (hash of the text), item, n_shared, n_shingles of the pairs with containment of 0.8 or more."""
    items = sketches(benchmark)
    lookup = items.select("item", F.explode("sketch").alias("h"))
    found = lookup.agg(F.count("*").alias("n"), F.max("h").alias("top")).first()
    rows, top = found["n"], found["top"]
    if not rows:
        top = -(1 << 63)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("rid"), "text")
    hashed = d.select("doc_id", "rid", words(F.col("text")).alias("w")).select("doc_id", "rid", shingles(F.col("w")).alias("s"))
    low = hashed.select("doc_id", "rid", F.explode(F.array_distinct(F.filter(F.transform("s", lambda x: F.xxhash64(x)), lambda h: h <= F.lit(top)))).alias("h"))
    if rows <= BROADCAST_ROWS:
        lookup = F.broadcast(lookup)
    # written first: whether the texts are then found by broadcast or by a shuffled join hangs on its size
    candidates = written(low.join(lookup, "h").select("doc_id", "rid", "item").distinct(), "candidates", narrow=True)
    # a document is tokenised once, whatever the number of its candidate items (at most those of the benchmark)
    of = candidates.groupBy("doc_id", "rid").agg(F.collect_set("item").alias("items"))
    if candidates.count() <= BROADCAST_ROWS:
        of = F.broadcast(of)
    exact = d.join(of, (d["doc_id"].eqNullSafe(of["doc_id"])) & (d["rid"] == of["rid"])).select(d["doc_id"], d["rid"], "items", words(F.col("text")).alias("w"))
    split = exact.select("doc_id", "rid", "items", shingles(F.col("w")).alias("own")).select("doc_id", "rid", F.explode("items").alias("item"), "own")
    shared = F.size(F.array_intersect("s", "own")).cast("long")
    pairs = split.join(items.select("item", "s", "n"), "item").select("doc_id", "rid", "item", shared.alias("n_shared"), F.col("n").cast("long").alias("n_shingles"))
    return pairs.where(F.col("n_shared") >= F.col("n_shingles") * CONTAINMENT - 1e-9)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles, containment of the pairs with containment of 0.8 or more."""
    pairs = verified(docs, benchmark).select("doc_id", "item", "n_shared", "n_shingles")
    named = shingled(benchmark).select("item_id", F.xxhash64("s").alias("item")).distinct()
    best = pairs.join(named, "item").groupBy("doc_id", "item_id").agg(F.max(F.struct(F.round(F.col("n_shared") / F.col("n_shingles"), 6).alias("c"), "n_shared", "n_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_shingles", F.col("b.c").alias("containment"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text contains an item."""
    hit = written(verified(docs, benchmark).select(F.col("doc_id").alias("__hit"), F.col("rid").alias("__rid")).distinct(), "leaks", narrow=True)
    if hit.count() <= BROADCAST_ROWS:  # else the texts are shuffled
        hit = F.broadcast(hit)
    same = docs["doc_id"].eqNullSafe(hit["__hit"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == hit["__rid"])
    return docs.join(hit, same, "left_anti")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
