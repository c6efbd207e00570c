"""Addresses of elements, many at once: /author/work/heading/_3/_1 walked down a level a join.

A step is the slug of a division below, or _N: the Nth element of what is there, division or not, at any step. Each address ends with a code:
200 found; 400 fewer than two segments; 404 no such work, division or element; 500 several works or divisions that answer, _N whose N is no
number, or an element that is a division without a row of its own (it has no heading)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

FOUND, BAD, MISSING, BROKEN = 200, 400, 404, 500
INT = 1 << 31


def step_key(segment: Column) -> Column:
    """A segment as children are looked up: a slug as it is, _N with its number in plain digits, null where N is none."""
    digits = F.regexp_extract(segment, r"^_([+-]?\d+)$", 1)
    number = F.when(digits != "", digits.try_cast("long"))
    return F.when(~segment.startswith("_"), segment).when(number.between(-INT, INT - 1), F.concat(F.lit("_"), number.cast("string")))


def children(elements: DataFrame) -> DataFrame:
    """up, key, down, n, stored: what answers to a step from up, and how many do. elements: id, parent_id, slug (null for what is no division with a heading), nth, name."""
    below = elements.where("parent_id is not null")
    stored = (F.col("name") != "div") | F.col("slug").isNotNull()
    by_slug = below.where("slug is not null").select(F.col("parent_id").alias("up"), F.col("slug").alias("key"), F.col("id").alias("down"), F.lit(True).alias("stored"))
    by_nth = below.where("nth > 0").select("parent_id", F.concat(F.lit("_"), F.col("nth").cast("string")), "id", stored)
    return by_slug.unionAll(by_nth).groupBy("up", "key").agg(F.min("down").alias("down"), F.count("*").alias("n"), F.every("stored").alias("stored"))


def walked(addresses: DataFrame, works: DataFrame, elements: DataFrame, address: str = "address") -> DataFrame:
    """addresses with code, and id of what is found. works: author, slug, id. A null address has no segments."""
    parts = T.path_fragments(T.canonical_path(F.col(address)))
    own = addresses.select(address).distinct().withColumn("parts", parts)
    most = own.agg(F.max(F.size("parts"))).first()[0] or 0
    top = works.groupBy(F.col("author").alias("_a"), F.col("slug").alias("_s")).agg(F.min("id").alias("at"), F.count("*").alias("n"))
    first = own.withColumn("_a", F.try_element_at("parts", F.lit(1))).withColumn("_s", F.try_element_at("parts", F.lit(2))).join(top, ["_a", "_s"], "left")
    code = F.when(F.size("parts") < 2, BAD).when(F.col("n").isNull(), MISSING).when(F.col("n") > 1, BROKEN)
    state = first.select(address, "parts", code.alias("code"), F.when(code.isNull(), F.col("at")).alias("at"))
    steps = children(elements)
    for i in range(3, most + 1):
        segment = F.try_element_at("parts", F.lit(i))
        going = F.col("code").isNull() & (F.size("parts") >= i)
        # an address that has ended looks up a key that none has, its own, so that no partition fills with them
        asked = state.withColumn("_g", going).withColumn("key", F.when(going, step_key(segment))).withColumn("_key", F.coalesce("key", F.concat(F.lit("\0"), address)))
        found = asked.alias("a").join(steps.alias("s"), (F.col("a.at") == F.col("s.up")) & (F.col("a._key") == F.col("s.key")), "left")
        now = F.when(F.col("a.key").isNull(), BROKEN).when(F.col("s.n").isNull(), MISSING).when((F.col("s.n") > 1) | ~F.col("s.stored"), BROKEN)
        state = found.select(F.col(f"a.{address}").alias(address), "a.parts", F.when(F.col("_g"), now).otherwise(F.col("a.code")).alias("code"), F.when(F.col("_g"), F.when(now.isNull(), F.col("s.down"))).otherwise(F.col("a.at")).alias("at"))
    end = state.select(address, F.coalesce("code", F.lit(FOUND)).alias("code"), F.col("at").alias("id"))
    return addresses.join(end.withColumnRenamed(address, "_address"), addresses[address].eqNullSafe(F.col("_address")), "left").drop("_address")
