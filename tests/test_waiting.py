"""Streams with timers over several batches, and scans that stop early."""

import datetime
import random

from pyspark.sql import functions as F

from quire.operators import search
from quire.streaming import reading, timers


def minutes(n):
    return datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(minutes=n)


def streamed(spark, tmp_path, make, rows):
    """Rows of a stream that reads a file a batch, and what was kept after the last."""
    for i, own in enumerate(rows):
        spark.createDataFrame([(k, minutes(m)) for k, m in own], "key string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in{i}")
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in*").withWatermark("ts", "1 hour")
    q = make(stream).writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None
    kept = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    return spark.read.parquet(f"{tmp_path}/out").collect(), kept[-1]


def test_a_gate_forgets(spark, tmp_path):
    lots = [[("a", 0), ("a", 10), ("b", 5), ("a", 29)], [("a", 31), ("c", 40), (None, 41), ("a", 60)], [("d", 400)]]
    rows, kept = streamed(spark, tmp_path, lambda s: timers.let_through(s, "key", "ts", 30), lots)
    got = sorted(((r["key"] or "-", (r["us"] - int(minutes(0).timestamp()) * 1_000_000) / 60_000_000) for r in rows))
    assert got == [("-", 41), ("a", 0), ("a", 31), ("b", 5), ("c", 40), ("d", 400)]
    assert kept <= 3  # d alone, and its timer: the others' have ended


def test_services_come_up_by_themselves(spark, tmp_path):
    lots = [[("a", 0), ("b", 3)], [("a", 20), ("b", 100)], [("z", 500)]]
    rows, _ = streamed(spark, tmp_path, lambda s: timers.availability(s, "key", "ts", 1800), lots)
    got = sorted((r["key"], (r["us"] - int(minutes(0).timestamp()) * 1_000_000) / 60_000_000, r["up"]) for r in rows)
    assert got == [("a", 0, False), ("a", 50, True), ("b", 3, False), ("b", 33, True), ("b", 100, False), ("b", 130, True), ("z", 500, False)]


def test_a_scan_stops_when_it_has_enough(spark, tmp_path):
    draw = random.Random(1)
    rows = [(f"/a/{i:05d}", n, "early word" if i < 40 and n == 1 else "rare" if i == 1900 else draw.choice(["x", "y"]), i % 7 == 0) for i in range(2000) for n in (1, 2)]
    draw.shuffle(rows)
    own = search.Ordered.write(spark.createDataFrame(rows, "path string, nth int, text string, licence boolean"), f"file://{tmp_path}/o", file_rows=100)
    assert len(own.files()) > 30

    def by_force(word, k, bound):
        allowed = [r for r in sorted(rows) if not r[3]][:bound]
        return [r[:2] for r in allowed if word in r[2]][:k]

    for word, k, bound in (("early", 10, None), ("early", 100, 60), ("rare", 5, None), ("rare", 5, 1000), ("none", 5, 333), ("x", 7, 0)):
        got, looked = own.first(F.contains("text", F.lit(word)), k, ~F.col("licence"), bound)
        assert [(r["path"], r["nth"]) for r in got.collect()] == by_force(word, k, bound), (word, k, bound)
        if word == "early":
            assert looked <= 3
    empty = search.Ordered.write(spark.createDataFrame([], "path string, nth int, text string, licence boolean"), f"file://{tmp_path}/e")
    assert empty.first(F.lit(True), 5)[0].collect() == []
