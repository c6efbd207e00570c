"""What the operators share: the shared folder, packed arrays, whole texts as bytes."""

from __future__ import annotations

import contextlib
import ctypes
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are worked on at a time; bounds the memory of a Python worker.
PIECE = 1 << 20
#: Blocks of documents, and buckets, for each shuffle partition at least, and bytes of text of a block at most on average:
#: a block is held in a worker's memory, whatever the number of partitions. A block and a bucket exchange one packed row at
#: most, and none for nothing, so an exchange has no more rows than it has stretches or windows to send.
BLOCKS = 2
BUCKETS = 2
BLOCK_BYTES = 16 << 20
#: Rows from which a key may be hot.
HOT_ROWS = 10_000
#: Stands for a null doc_id: such rows come after all others in the order of documents.
NO_ID = (1 << 63) - 1
U = np.uint64


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0


def blocks_and_buckets(spark: SparkSession, size: int) -> tuple[int, int]:
    """Their numbers, from the bytes of text and the number of shuffle partitions."""
    least, n = -(-size // BLOCK_BYTES), partitions(spark)
    return max(BLOCKS * n, least), max(BUCKETS * n, least)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir; where that is unset, a local one if all of Spark runs in this machine, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        kept = getattr(shared_dir, "own", None)
        if kept is None:
            import tempfile

            kept = shared_dir.own = "file://" + tempfile.mkdtemp(prefix="quire-")
        at = kept
    return at.rstrip("/")


#: What this driver has written to the shared folder and not removed, in order.
PATHS: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quire/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    PATHS.append(path)
    return path


def written(df: DataFrame, name: str, narrow: bool = False) -> DataFrame:
    """df, written as a table to the shared folder and read again: cuts the lineage and survives lost executors.

    narrow: the rows are few and short beside what a shuffle partition holds; an eighth as many files do."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    if narrow:
        df = df.coalesce(max(1, partitions(spark) // 8))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_keys(rows: DataFrame, key: str) -> list:
    """The keys that hold a thousandth of all rows or more, and HOT_ROWS at least: a thousand of them at most."""
    least = max(HOT_ROWS, rows.count() // 1000 + 1)
    return [r[0] for r in rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") >= least).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: list) -> DataFrame:
    """left.join(right, key, "left") for a right side with one narrow row a key; left rows of hot_keys() are spread over all partitions."""
    n = partitions(left.sparkSession)
    if not hot:
        return left.join(right, key, "left")
    is_hot = F.col(key).isin(hot)
    spread = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(n)).cast("int")).otherwise(0))
    copies = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))))
    return spread.join(copies, [key, "__salt"], "left").drop("__salt")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remove_since(spark: SparkSession, mark: int, keep: str | None = None) -> None:
    """Removes what was written since PATHS had mark entries, but for one path: for when all that was made of it is written."""
    for path in [p for p in PATHS[mark:] if p != keep]:
        remove(spark, path)
        PATHS.remove(path)


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays as one compressed value; the bytes of numbers are put by significance, which compresses better."""
    head, body = [struct.pack("<B", len(arrays))], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head.append(struct.pack("<2sq", a.dtype.str[1:].encode(), a.size))
        body.append(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if a.itemsize > 1 and a.size else a.tobytes())
    return zstandard.ZstdCompressor(level=level).compress(b"".join(head + body))


def unpack(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, at, kinds = raw[0], 1, []
    for _ in range(n):
        kind, size = struct.unpack_from("<2sq", raw, at)
        at += 10
        kinds.append((np.dtype("<" + kind.decode()), size))
    out = []
    for kind, size in kinds:
        own = np.frombuffer(raw, np.uint8, size * kind.itemsize, at)
        out.append(np.ascontiguousarray(own.reshape(kind.itemsize, size).T).view(kind).ravel() if size else np.zeros(0, kind))
        at += kind.itemsize * size
    return out


def keyed(docs: DataFrame, n_blocks: int, more: tuple[str, ...] = ()) -> DataFrame:
    """did (long, NO_ID for null), rid (a hash of the text: with did it orders the rows of a block), block, text (empty for null); more: other columns, and no_text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    extra = [F.col(c) for c in more] + [F.col("text").isNull().alias("no_text")] * bool(more)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("did"), text.alias("text"), *extra)
    rid = F.xxhash64("text")
    # by text too: rows that share a doc_id, or have none, may be many
    own = (rid.alias("rid"), F.pmod(F.xxhash64("did", rid), F.lit(n_blocks)).cast("int").alias("block"))
    return rows.select("did", *own, "text", *(c for c in rows.columns if c not in ("did", "text")))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bytes of a string column, without a copy of the bytes."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # an empty or oversized one
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bounds - bounds[0], raw[bounds[0] : bounds[-1]]


class Docs(NamedTuple):
    """The documents of a block in the order of (did, rid): bounds[i] to bounds[i + 1] of raw is the text of document i."""

    did: np.ndarray
    rid: np.ndarray
    block: int
    bounds: np.ndarray
    raw: np.ndarray


def block_docs(rows: pa.Table) -> Docs:
    """A block of keyed(). Whoever reads the block gets the same order, so that (block, index) names a document."""
    did, rid = (rows.column(i).to_numpy() for i in ("did", "rid"))
    if not len(did):
        return Docs(did.astype(np.int64), rid.astype(np.int64), -1, np.zeros(1, np.int64), np.zeros(0, np.uint8))
    order = np.lexsort((rid, did))
    bounds, raw = text_bytes(rows.column("text").take(pa.array(order)))
    return Docs(did[order], rid[order], rows.column("block")[0].as_py(), bounds, raw)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result may serve as a bucket."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buckets_of(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket in 0..n-1 from the high 32 bits."""
    return ((h >> U(32)) * U(n) >> U(32)).astype(np.int32)


def grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The indexes of each value of keys."""
    order = np.argsort(keys, kind="stable")
    if len(order):
        for part in np.split(order, np.flatnonzero(np.diff(keys[order])) + 1):
            yield int(keys[part[0]]), part


def exclusive(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... of counts[0] values, then those of starts[1], ..."""
    at = exclusive(counts)
    return np.arange(at[-1]) + np.repeat(starts - at[:-1], counts)


#: What goes to buckets, and what comes back to blocks.
PACKED = "bucket int, packed binary"
MARKS = "block int, marks binary"


def several_blocks(parts: list[tuple[int, np.ndarray, np.ndarray]], more: list[np.ndarray] = []) -> pa.Table:  # noqa: B006
    """(block, hashes, place deltas): each hash once a block -> by block, the places whose hash another block has too, or more holds."""
    every = np.sort(np.concatenate([np.zeros(0, U), *(p[1] for p in parts), *more]))
    twice = np.unique(every[1:][every[1:] == every[:-1]])
    blocks, marks = [], []
    for block, h, place in parts:
        hit = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h) if len(twice) else np.zeros(0, np.int64)
        if len(hit):
            blocks.append(block)
            marks.append(pack(np.diff(np.cumsum(place, dtype=np.int64)[hit], prepend=0).astype(np.int32)))
    return pa.table([pa.array(blocks, pa.int32()), pa.array(marks, pa.binary())], ["block", "marks"])


def places(marks: pa.Table) -> np.ndarray:
    """The places that several_blocks() gave to a block."""
    return np.concatenate([np.zeros(0, np.int64), *(np.cumsum(unpack(v.as_py())[0], dtype=np.int64) for v in marks.column("marks"))])


#: What to call to empty the caches that operators keep in a Python worker.
CACHES: list = []


def release(caches: bool = True) -> None:
    """Gives back what a worker that lives on has no use for: workers outlast their tasks, and stages share executors."""
    for clear in CACHES if caches else ():
        clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A function of batches that releases memory when it is done."""

    def batches_run(batches):
        try:
            yield from run(batches)
        finally:
            release()

    batches_run.__name__ = run.__name__  # plans name it
    return batches_run


def lean_group(run):
    """The same of a function of a group."""

    def group_run(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    group_run.__name__ = run.__name__  # plans name it
    return group_run


def lean_cogroup(run):
    def cogroup_run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    cogroup_run.__name__ = run.__name__  # plans name it
    return cogroup_run
