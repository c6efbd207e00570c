"""Operator 5, SimHash near-dedup: fingerprints of 64 bits, links at 2 or fewer differing bits, components.

Method: binary trie self-join. Of two fingerprints within two bits one of three blocks of bits is equal, and one of three
blocks of the rest; so each distinct fingerprint goes to nine groups by (block, inner block), where those 36 bits agree.
In its group a fingerprint is a leaf of a binary trie (a sorted array, whose nodes are ranges). Pairs of nodes go down
together, from (root, root), a bit at a time; they gather differing bits and are dropped beyond two. Each group gives a
spanning forest of its links, not its pairs; copies of a text are one fingerprint before any of this. Components come from
alternating large-star and small-star rounds over joins and minima, each written to the shared folder.

Every row is a document. A null doc_id counts as larger than any other, and as component_id comes out null. A null or
empty text has fingerprint zero, which is linked like any other. Rows that share a doc_id are linked through it only if
their fingerprints are. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import NO_ID, PIECE, U, lean, lean_group, partitions, written

SHINGLE = 3
BUDGET = 2
SEED = 42
#: First bits of the three blocks, and of the three inner blocks of 14 bits of the 42 or 43 others.
OUTER = (0, 22, 43, 64)
INNER = (0, 14, 28)
#: By view, the bits that its groups agree in.
FIXED = np.array([OUTER[i + 1] - OUTER[i] + 14 for i in range(3) for _ in INNER])
#: Node pairs that are held at a time.
FRONTIER = 1 << 20
SEPARATOR = re.compile(rb"[\x20\x09-\x0d]")


def shingle_hashes(raw: bytes, size: int, seed: int) -> Iterator[list[int]]:
    """Hashes of the shingles of a text, some at a time."""
    held: list[bytes] = []
    at, any_yet = 0, False
    while at < len(raw) or not at:
        to = len(raw)
        if to - at > PIECE and (cut := SEPARATOR.search(raw, at + PIECE)):
            to = cut.start()
        words = held + raw[at:to].split()
        at = max(to, 1)
        if len(words) >= size:
            joined = b" ".join(words)
            ends = list(accumulate([len(w) + 1 for w in words]))
            yield [xxh64_intdigest(joined[a : b - 1], seed) for a, b in zip([0, *ends], ends[size - 1 :], strict=False)]
            any_yet, held = True, words[-(size - 1) :]
        else:
            held = words
    if not any_yet and held:
        yield [xxh64_intdigest(b" ".join(held), seed)]


def fingerprint(raw: bytes) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(raw.lower(), SHINGLE, SEED):
        n += len(hashes)
        for a in range(0, len(hashes), 4096):
            ones += np.unpackbits(np.array(hashes[a : a + 4096], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]) if n else 0


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = np.array([fingerprint(memoryview(t.as_buffer()).tobytes() if t.is_valid else b"") for t in b.column(1)], U)
        yield pa.RecordBatch.from_arrays([b.column(0), *b.columns[2:], pa.array(out.view(np.int64))], ["did", *b.schema.names[2:], "fp"])


def rotated(fp: np.ndarray, first: int, width: int, total: int = 64) -> np.ndarray:
    """Numbers of total bits with the block of width bits at first (from the top) moved to the top."""
    if first == 0:
        return fp
    mask = (U(1) << U(total)) - U(1) if total < 64 else ~U(0)
    return ((fp << U(first)) | (fp >> U(total - first))) & mask


def views(fp: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Nine rearrangements of the bits, in each of which the top FIXED are a block and an inner block."""
    for i in range(3):
        width = OUTER[i + 1] - OUTER[i]
        turned = rotated(fp, OUTER[i], width)
        rest = 64 - width
        head, tail = (turned >> U(rest)) << U(rest), turned & ((U(1) << U(rest)) - U(1))
        for j, first in enumerate(INNER):
            yield 3 * i + j, head | rotated(tail, first, 14, rest)


def dealt(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy().view(U)
            for k, view in views(fp):
                key = (view >> U(64 - FIXED[k])) * U(16) + U(k)
                bucket = ((key * U(0x9E3779B97F4A7C15)) >> U(32)) * U(n_buckets) >> U(32)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(np.full(len(fp), k, np.int8)), pa.array(view.view(np.int64)), pa.array(fp.view(np.int64))], ["bucket", "kind", "view", "fp"])

    return run


def close_pairs(view: np.ndarray, kind: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaves (indexes) within the budget, of tries that agree in kind and its top FIXED bits. Sorted by (kind, view)."""
    n = len(view)
    top = view >> (64 - FIXED[kind]).astype(U)
    head = np.flatnonzero(np.append(True, (top[1:] != top[:-1]) | (kind[1:] != kind[:-1]))) if n else np.zeros(0, np.int64)
    end = np.append(head[1:], n)
    several = end - head > 1
    head, end = head[several], end[several]
    ones: dict[int, np.ndarray] = {}
    stack = [(int(FIXED.min()), head, end, head, end, np.zeros(len(head), np.int8))]
    while stack:
        depth, al, ah, bl, bh, err = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(depth, al[half:], ah[half:], bl[half:], bh[half:], err[half:]), (depth, al[:half], ah[:half], bl[:half], bh[:half], err[:half])]
            continue
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            x, y = al[leaf], bl[leaf]
            near = np.bitwise_count(view[x] ^ view[y]) <= BUDGET
            near &= x != y
            yield x[near], y[near]
            al, ah, bl, bh, err = (v[~leaf] for v in (al, ah, bl, bh, err))
        if not len(al) or depth == 64:
            continue  # at depth 64 all that is left are equal leaves; distinct fingerprints have none
        if depth not in ones:
            ones[depth] = np.append(0, np.cumsum((view >> U(63 - depth)) & U(1), dtype=np.int64))
        c = ones[depth]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        same = (al == bl) & (ah == bh)
        other = ~same
        children = [(al, am, bl, bm, err), (am, ah, bm, bh, err), (al, am, bm, bh, err + 1), tuple(v[other] for v in (am, ah, bl, bm, err + 1))]
        al, ah, bl, bh, err = (np.concatenate([x[i] for x in children]) for i in range(5))
        live = (ah > al) & (bh > bl) & (err <= BUDGET) & ~((al == bl) & (ah == bh) & (ah - al == 1))
        stack.append((depth + 1, al[live], ah[live], bl[live], bh[live], err[live]))


def roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index of each leaf's component."""
    label = np.arange(n)
    for x, y in pairs:
        while len(x):
            a, b = label[x], label[y]
            open_ = a != b
            x, y, a, b = x[open_], y[open_], a[open_], b[open_]
            if not len(x):
                break
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (deeper := label[label] != label).any():
                label = label[label] if deeper.any() else label
    return label


def links(table: pa.Table) -> pa.Table:
    """A bucket -> (a, b), b < a: a spanning forest of the links of its groups."""
    kind, view, fp = (table.column(c).to_numpy() for c in ("kind", "view", "fp"))
    view = view.view(U)
    order = np.lexsort((view, kind))
    kind, view, fp = kind[order], view[order], fp[order]
    root = roots(len(fp), close_pairs(view, kind))
    far = root != np.arange(len(fp))
    a, b = fp[far], fp[root[far]]
    both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
    return pa.table([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], ["a", "b"])


def trie_links(distinct: DataFrame) -> DataFrame:
    """(a, b): fingerprints of distinct (fp) within the budget, enough of them that components are those of all links."""
    n = 8 * partitions(distinct.sparkSession)
    spread = distinct.select("fp").mapInArrow(lean(dealt(n)), "bucket int, kind byte, view long, fp long")
    return spread.groupBy("bucket").applyInArrow(lean_group(links), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a > b) but the roots, the least node of each component. Rounds are written to the shared folder."""
    edges = written(edges, "links", narrow=True)
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.unionAll(least.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "links", narrow=True)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did (NO_ID for null), fp, component (least did reachable): a row for each of docs."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.col(text_col).alias("text"))
    own = written(rows.mapInArrow(lean(fingerprints), "did long, fp long"), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("did").alias("least"))
    root = components(trie_links(distinct))
    of = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = of.groupBy("root").agg(F.min("least").alias("component"))
    return own.join(of.select("fp", "root").join(first, "root").select("fp", "component"), "fp").select("did", "fp", "component")


def first_of_group(docs: DataFrame) -> DataFrame:
    """A row of each component, all columns: that with the least doc_id, of rows that share it the one whose text hashes least."""
    did, text_hash = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64("text")
    own = docs.select(did.alias("did"), "text", text_hash.alias("h")).mapInArrow(lean(fingerprints), "did long, h long, fp long")
    distinct = written(own, "fingerprints").groupBy("fp").agg(F.min(F.struct("did", "h")).alias("least"))
    root = components(trie_links(distinct))
    of = distinct.join(root, distinct["fp"] == root["node"], "left").select("least", F.coalesce("root", "fp").alias("root"))
    keep = of.groupBy("root").agg(F.min("least").alias("k")).select(F.col("k.did").alias("__did"), F.col("k.h").alias("__h"))
    rows = docs.withColumn("__did", did).withColumn("__h", text_hash).join(keep, ["__did", "__h"], "left_semi")
    one = Window.partitionBy("__did", "__h").orderBy("__did")  # repeated rows
    return rows.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n", "__did", "__h")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return found.select(real("did").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real("component").alias("component_id"))
