"""Writers: tables replaced by partition, keyed upserts, texts as files, events as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.shared import spread

TOPICS = ("opusAdded", "opusChanged", "opusRemoved", "coverRequested", "search", "reading")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Only the partitions that df has are replaced: a work's postings, say, when it is indexed anew."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def remove_partition(spark: SparkSession, path: str, by: str, value: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/{by}={value}")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def events(kind: Column, user: Column, at: Column, service: str, **details: Column) -> Column:
    """The JSON of an event; details that are null are left out."""
    fields = {"type": kind, "at": F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), "service": F.lit(service), "user": user, **details}
    return F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())), {"ignoreNullFields": "true"})


def publish(df: DataFrame, topic: str, servers: str):
    """A streaming DataFrame (key, value) to a Kafka topic, at least once."""
    if topic not in TOPICS:
        raise ValueError(f"no topic {topic!r}")
    return df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic)


def leaf_files(leaves: DataFrame, path: str) -> None:
    """path, text of leaves as one text file each, in folders name=<path with / as __>."""
    named = leaves.select(F.replace("path", F.lit("/"), F.lit("__")).alias("name"), F.col("text").alias("value"))
    spread(named, "name").write.mode("overwrite").partitionBy("name").text(path)
