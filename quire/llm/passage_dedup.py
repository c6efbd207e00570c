"""Operator 2, substring dedup: removes the words of every window of 13 words that also starts in a document of smaller doc_id.

Method: difference-cover anchors. Of each document only the 7-word runs at word positions that lie, modulo 7, in the
difference cover {0, 1, 3} are hashed: two equal windows of 13 words always hold equal runs at the same shift from both
starts (a shift of 0 to 6 takes both starts into the cover). Anchors are dealt by hash; only those seen twice go back to
their documents, where they are extended: the 13-word windows about them are hashed in full, dealt by that hash, and
compared by doc_id. A block of documents sends each of its anchors and windows once, however many copies it holds.

Words are what lies between bytes 0x20 and 0x09-0x0D, unchanged. A null text is empty, a null doc_id counts as larger
than any other, rows that share a doc_id never remove each other's words. Texts of under 13 words and empty tables give
rows with nothing removed, or none. Anchors only propose, by 64 bits; windows are compared by 128 bits, of words that are
themselves hashed to 128 bits, so that among 10^13 windows a chance agreement is out of the question.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from .common import BUCKETS, MARKS, NO_ID, PACKED, U, Docs, block_docs, blocks_and_buckets, buckets_of, grouped, keyed, lean_cogroup, lean_group, mixed, pack, places, ranges, several_blocks, text_size, unpack

WINDOW = 13
#: A perfect difference set: each residue modulo 7 is a difference of two of these (fixed values).
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LONG = 256


SQL = r"""
WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, k, md5(array_to_string(w[k : k + 12], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
late AS (SELECT doc_id, k FROM (SELECT doc_id, k, min(doc_id) OVER (PARTITION BY h) AS least FROM t) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM late, range(0, 13) AS r(j)),
lost AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY k) AS text, count(*) AS n
         FROM (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS k FROM d)
         ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""


class Words:
    """The words of a block: start and end in raw, a hash, the document and the place in it."""

    def __init__(self, docs: Docs):
        self.raw = raw = docs.raw
        bounds = docs.bounds
        inside = ~SEPARATOR[raw]
        edge = np.zeros(len(raw), bool)
        edge[bounds[:-1][bounds[:-1] < len(raw)]] = True
        before = np.append(False, inside[:-1]) if len(raw) else inside
        self.start = np.flatnonzero(inside & (~before | edge))
        after, last = np.append(~inside[1:], True) if len(raw) else inside, np.append(edge[1:], True) if len(raw) else inside
        self.end = np.flatnonzero(inside & (after | last)) + 1
        self.first = np.searchsorted(self.start, bounds)  # of each document, and the count
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(docs.did)), self.count)
        self.place = np.arange(len(self.start)) - self.first[self.doc]
        self.hash = word_hashes(raw, self.start, self.end)
        self.other: np.ndarray | None = None

    def runs(self, length: int) -> np.ndarray:
        """Whether length words of the document start at each word."""
        return self.place + length <= self.count[self.doc]

    def hashes(self, at: np.ndarray, length: int, second: bool = False) -> np.ndarray:
        """64 bits of the runs at some words; second: 64 others, of other hashes of the words."""
        if second and self.other is None:
            self.other = word_hashes(self.raw, self.start, self.end, 1)
        own, factor = (self.other, U(0xD1342543DE82EF95)) if second else (self.hash, U(0x9E3779B97F4A7C15))
        h = own[at]
        for i in range(1, length):
            h = h * factor + own[at + i]
        return mixed(h)


#: Factors of the two hashes of a word (odd numbers).
FACTORS = ((0xD6E8FEB86659FD93, 0x9E3779B97F4A7C15), (0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Eight bytes at a time; of very long words, by their XXH64 (their number of steps would be that of all)."""
    by_length, by_lane = map(U, FACTORS[which])
    eight = np.ndarray((len(raw) + 1,), "<u8", np.append(raw, np.zeros(8, np.uint8)), 0, (1,))
    length = end - start
    h = length.astype(U) * by_length
    live, at = np.flatnonzero((length > 0) & (length <= LONG)), 0
    while len(live):
        lane, rest = eight[start[live] + at].astype(U), length[live] - at
        part = rest < 8
        lane[part] &= (U(1) << (rest[part].astype(U) * U(8))) - U(1)
        h[live] = (h[live] ^ mixed(lane * by_lane if which else lane)) * by_lane
        at += 8
        live = live[rest > 8]
    for i in np.flatnonzero(length > LONG).tolist():
        h[i] = U(xxhash.xxh64_intdigest(raw[start[i] : end[i]].tobytes(), which))
    return mixed(h)


def alike(h: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of hashes: the first place of each distinct pair, in the order of h, and the number of each place's pair."""
    order = np.lexsort((h2, h))
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (h2[order][1:] != h2[order][:-1]))[: len(h)]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def anchors(n_buckets: int):
    """A block -> its anchors by bucket: each hash once, with its place (word of the block), or apart if the block repeats it."""

    def run(rows: pa.Table) -> pa.Table:
        docs = block_docs(rows)
        words = Words(docs)
        at = np.flatnonzero(words.runs(ANCHOR) & np.isin(words.place % PERIOD, COVER))
        h, first, count = np.unique(words.hashes(at, ANCHOR), return_index=True, return_counts=True)
        keys, values = [], []
        for bucket, part in grouped(buckets_of(h, n_buckets)):
            several = count[part] > 1
            one = part[~several]
            one = one[np.argsort(first[one])]
            keys.append(bucket)
            values.append(pack(np.array([docs.block]), h[part[several]], h[one], np.diff(at[first[one]], prepend=0).astype(np.int32)))
        return pa.table([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], ["bucket", "packed"])

    return run


def repeated(table: pa.Table) -> pa.Table:
    """A bucket of anchors -> by block, the places of those that other blocks hold too."""
    parts = [unpack(v.as_py()) for v in table.column("packed")]
    return several_blocks([(int(p[0][0]), p[2], p[3]) for p in parts], [p[1] for p in parts])


def candidates(docs: Docs, words: Words, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and both hashes of the windows that hold a repeated anchor: one that other blocks hold, or that this block holds twice."""
    at = np.flatnonzero(words.runs(ANCHOR) & np.isin(words.place % PERIOD, COVER))
    _, back, count = np.unique(words.hashes(at, ANCHOR), return_inverse=True, return_counts=True)
    near = np.zeros(len(words.start) + 1, np.int64)
    hit = np.concatenate([marked, at[count[back] > 1]])
    hit = np.unique(hit)
    np.add.at(near, np.maximum(hit - (PERIOD - 1), words.first[words.doc[hit]]), 1)
    np.add.at(near, hit + 1, -1)
    starts = np.flatnonzero((np.cumsum(near[:-1]) > 0) & words.runs(WINDOW))
    return starts, words.hashes(starts, WINDOW), words.hashes(starts, WINDOW, True)


def extended(n_buckets: int):
    """A block and its repeated anchors -> its candidate windows by bucket: each hash once, with the least doc_id that holds it."""

    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        docs = block_docs(rows)
        keys, values = [], []
        if len(docs.did):
            words = Words(docs)
            starts, h, h2 = candidates(docs, words, places(marks))
            first, _ = alike(h, h2)
            did = docs.did[words.doc[starts[first]]]
            for bucket, part in grouped(buckets_of(h[first], n_buckets)):
                part = part[np.argsort(first[part])]
                own = first[part]
                keys.append(bucket)
                values.append(pack(np.array([docs.block]), h[own], np.diff(did[part], prepend=0), np.diff(own, prepend=0).astype(np.int32), h2[own]))
        return pa.table([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], ["bucket", "packed"])

    return run


def earlier(table: pa.Table) -> pa.Table:
    """A bucket of windows -> by block, which of its candidates start in a document of smaller doc_id elsewhere."""
    parts = [unpack(v.as_py()) for v in table.column("packed")]
    h = np.concatenate([p[1] for p in parts])
    did = np.concatenate([np.cumsum(p[2]) for p in parts])
    _, back = alike(h, np.concatenate([p[4] for p in parts]))
    least = np.full(int(back.max()) + 1 if len(back) else 0, NO_ID)
    np.minimum.at(least, back, did)
    late = did > least[back]
    blocks, marks, at = [], [], 0
    for p in parts:
        hit = np.flatnonzero(late[at : at + len(p[1])])
        at += len(p[1])
        if len(hit):
            blocks.append(int(p[0][0]))
            marks.append(pack(np.diff(np.cumsum(p[3], dtype=np.int64)[hit], prepend=0).astype(np.int32)))
    return pa.table([pa.array(blocks, pa.int32()), pa.array(marks, pa.binary())], ["block", "marks"])


def removed(docs: Docs, words: Words, anchored: np.ndarray, late: np.ndarray) -> np.ndarray:
    """Which words go."""
    starts, h, h2 = candidates(docs, words, anchored)
    first, back = alike(h, h2)
    did = docs.did[words.doc[starts]]
    gone = did > did[first[back]]  # an earlier document of this block holds it
    known = np.zeros(len(starts), bool)
    known[late] = True
    gone |= known[first[back]]
    cover = np.zeros(len(words.start) + WINDOW + 1, np.int64)
    np.add.at(cover, starts[gone], 1)
    np.add.at(cover, starts[gone] + WINDOW, -1)
    return np.cumsum(cover[: len(words.start)]) > 0


def split_marks(marks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    late = marks.column("late").to_numpy(zero_copy_only=False).astype(bool) if marks.num_rows else np.zeros(0, bool)
    return places(marks.filter(pa.array(~late))), places(marks.filter(pa.array(late)))


def kept_bytes(docs: Docs, words: Words, gone: np.ndarray) -> list[bytes]:
    """Of each document, the words that stay, joined by one space."""
    stay = np.flatnonzero(~gone)
    length = words.end[stay] - words.start[stay] + 1
    text = np.append(docs.raw, np.uint8(0x20))
    at = ranges(words.start[stay], length)
    at[np.cumsum(length) - 1] = len(docs.raw)  # the space after each
    held = text[at].tobytes()
    ends = np.concatenate([[0], np.cumsum(length)])[np.searchsorted(stay, words.first)]
    return [held[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def digests(rows: pa.Table, marks: pa.Table) -> pa.Table:
    docs = block_docs(rows)
    words = Words(docs)
    gone = removed(docs, words, *split_marks(marks)) if len(docs.did) else np.zeros(0, bool)
    lost = np.bincount(words.doc[gone], minlength=len(docs.did)).astype(np.int64)
    ids = pa.array(docs.did, pa.int64(), mask=docs.did == NO_ID)
    return pa.table([ids, pa.array(words.count, pa.int64()), pa.array(lost, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept_bytes(docs, words, gone)], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def kept_texts(rows: pa.Table, marks: pa.Table) -> pa.Table:
    docs = block_docs(rows)
    words = Words(docs)
    gone = removed(docs, words, *split_marks(marks)) if len(docs.did) else np.zeros(0, bool)
    lost = np.bincount(words.doc[gone], minlength=len(docs.did)).astype(np.int64)
    ids = pa.array(docs.did, pa.int64(), mask=docs.did == NO_ID)
    return pa.table([ids, pa.array([x.decode() for x in kept_bytes(docs, words, gone)], pa.string()), pa.array(lost, pa.int64())], ["doc_id", "text", "n_removed"])


def run(docs: DataFrame, last, schema: str) -> DataFrame:
    from pyspark.sql import functions as F

    n_blocks, n_buckets = blocks_and_buckets(docs.sparkSession, text_size(docs))
    n = max(1, n_buckets // BUCKETS)  # one bucket a partition is enough here
    rows = keyed(docs, n_blocks)
    blocks = rows.groupBy("block")
    again = blocks.applyInArrow(lean_group(anchors(n)), PACKED).groupBy("bucket").applyInArrow(lean_group(repeated), MARKS)
    late = blocks.cogroup(again.groupBy("block")).applyInArrow(lean_cogroup(extended(n)), PACKED).groupBy("bucket").applyInArrow(lean_group(earlier), MARKS)
    marks = again.withColumn("late", F.lit(False)).unionAll(late.withColumn("late", F.lit(True)))
    return rows.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(lean_cogroup(last), schema)


def passage_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, text of the words that stay (joined by one space), n_removed: a row for each of docs (doc_id, text)."""
    return run(docs, kept_texts, "doc_id long, text string, n_removed long")


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
