"""Readers' events as streams: the operators of quire.operators.state with event time, watermarks and kept state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LATE = "1 hour"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", schema: str = SCHEMA) -> DataFrame:
    """The files called name in a folder, as they come, by event time."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def attention(events: DataFrame) -> DataFrame:
    """user_id, event_type, seconds, touches so far."""
    return events.groupBy("user_id", "event_type").agg(F.sum("value").alias("seconds"), F.count("*").alias("touches"))


def first_in_time(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events without those whose key came before, within the watermark."""
    return events.dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, end, events, seconds of runs of events with pauses shorter than the gap."""
    own = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.sum("value").alias("seconds"))
    return own.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events", "seconds")


def windows(events: DataFrame, size: str = "1 hour") -> DataFrame:
    own = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"))
    return own.select(F.col("w.start").alias("start"), "event_type", "events")


def progress(events: DataFrame) -> DataFrame:
    """user_id, event_type, touches, division (last), read: kept per key, a row out at each change. State is a count and the last place, in the JVM's store."""
    last = F.max_by(F.get_json_object("props", "$.k"), F.struct("ts", "event_id")).alias("division")
    own = events.groupBy("user_id", "event_type").agg(F.count("*").alias("touches"), last)
    return own.select("user_id", "event_type", "touches", "division", (F.col("touches") >= 3).alias("read"))


def drained(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """Runs a stream over what is there; gives what it wrote.

    append: a Parquet table. complete: the table of the last batch. update: each batch's changes are appended with the
    batch's number, and of each key the last counts, so a batch that is run again does no harm."""
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    schema = stream.schema
    if mode == "append":
        q = out.format("parquet").option("path", path).start()
    elif mode == "complete":
        q = out.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    else:
        schema = StructType([*schema.fields, StructField("_batch", LongType())])
        q = out.foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n).cast("long")).write.mode("append").parquet(path)).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    table = stream.sparkSession.read.schema(schema).parquet(path)
    if mode != "update":
        return table
    last = Window.partitionBy(*keys).orderBy(F.desc("_batch"))
    return table.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_batch")
