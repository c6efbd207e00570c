"""Operator 9, suffix-array dedup: removes every byte that lies in a window of 100 bytes that also starts earlier.

Method: blockwise suffix sorting with a difference cover. Which windows are equal is read off sorted suffixes alone. In each
window one 16-byte word is chosen, that of least hash, so that equal windows choose the same at the same offset; the
suffixes that begin at chosen words are sorted. Windows that choose the same word place are one stretch of text: what
follows the word is the suffix, and what lies before it, read backwards, a second one. Buckets are ranges of the suffixes'
lexicographic order, parted by splitters from a sample of all suffixes, and are sorted one at a time: by the first 31 bytes,
and what ties there by the ranks of a sample of suffixes at the positions of a difference cover modulo 31, which are
computed first. Two windows are equal if the common prefixes along both orders reach as far as the window does to both
sides of the word. Memory is that of one bucket.

Copies: a block of documents sorts its own stretches in the same way first. Stretches all of whose windows start earlier in
the block stay behind, so that thousands of copies of a document or passage send each stretch once for each block; in the
order of a bucket copies are runs of equal suffixes, of which the first stands for all. Stretches whose word no other
stretch has chosen hold no repeat and stay behind too (words go round first, by hash). A word that very many different
stretches have chosen is hot: its windows go one by one, each to the range of its own suffix, so that no bucket gets all
the surroundings of a common passage.

Order: by doc_id, then by start. A null doc_id comes last. Rows that share a doc_id count as one document, in which
starts decide; repeated rows therefore never remove each other. A null text is empty; texts of under 100 bytes and empty
tables give rows with nothing removed, or none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MARKS, NO_ID, PACKED, PIECE, U, Docs, block_docs, blocks_and_buckets, buckets_of, exclusive, grouped, keyed, lean_cogroup, lean_group, mixed, pack, ranges, text_size, unpack

WINDOW = 100
WORD = 16
#: Different stretches from which a class is hot.
HOT = 20_000
#: Ranges of the suffix order at most (their splitters go with each task); further buckets part a range by hash. Sampled
#: suffixes for each range.
RANGES = 1024
SAMPLED = 32
#: Suffixes of a bucket that are sorted together; a word's suffixes stay together.
LOT = 1 << 15
#: A perfect difference set: each residue modulo 31 is a difference of two of these (fixed values).
PERIOD = 31
COVER = np.array([0, 1, 3, 8, 12, 18])


SQL = """
WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
t AS MATERIALIZED (SELECT doc_id, k, md5(hex(array_slice(b, k, k + 99))) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS k FROM d)),
late AS MATERIALIZED (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY h ORDER BY doc_id, k) AS n FROM t) WHERE n > 1),
runs AS MATERIALIZED (
    SELECT doc_id, run, min(k) AS a, max(k) + 99 AS z
    FROM (SELECT doc_id, k, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY k) AS run
          FROM (SELECT doc_id, k, k - lag(k, 1, -1000) OVER (PARTITION BY doc_id ORDER BY k) > 100 AS new FROM late))
    GROUP BY doc_id, run),
cut AS MATERIALIZED (
    SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, sum(z - a + 1) AS lost, count(*) AS n FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(lost, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN n IS NULL THEN b ELSE unhex(array_to_string(list_transform(range(0, n + 1), lambda i:
           hex(array_slice(b, CASE WHEN i = 0 THEN 1 ELSE z[i] + 1 END, CASE WHEN i = n THEN octet_length(b) ELSE a[i + 1] - 1 END))), '')) END) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def shift_table(period: int = PERIOD, cover: np.ndarray = COVER) -> np.ndarray:
    """For residues a and b the least shift that takes both into the cover."""
    table = np.full((period, period), -1, np.int64)
    inside = np.zeros(period, bool)
    inside[cover] = True
    at = np.arange(period)
    for shift in range(period - 1, -1, -1):
        hit = inside[(at + shift) % period]
        table[np.ix_(hit, hit)] = shift
    assert (table >= 0).all(), "not a difference cover"
    return table


SHIFT = shift_table()


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the WORD bytes at each position."""
    n = len(raw) - WORD + 1
    if n <= 0:
        return np.zeros(0, U)
    eight = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,))
    h = eight[:n] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    h += eight[8 : 8 + n]
    return mixed(h)


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of width keys."""
    span = 1
    while span * 2 <= width:
        keys = np.minimum(keys[:-span], keys[span:])
        span *= 2
    return np.minimum(keys[: len(keys) - (width - span)], keys[width - span :]) if width > span else keys


def stretches(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First start, number of starts, place and hash of the chosen word, of each run of windows that choose the same word."""
    h = word_hashes(raw)
    width = WINDOW - WORD + 1
    if len(h) < width:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    bits = U(max(1, int(len(h)).bit_length()))
    low = (U(1) << bits) - U(1)
    chosen = (least((h & ~low) | np.arange(len(h), dtype=U), width) & low).astype(np.int64)
    inside = np.zeros(len(chosen) + 1, bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        inside[a : max(a, b - WINDOW + 1)] = True
    inside[len(chosen) :] = False
    new = inside[:-1].copy()
    new[1:] &= ~inside[:-2] | (chosen[1:] != chosen[:-1])
    for a in bounds[:-1].tolist():  # documents of exactly one window may touch
        if a < len(new):
            new[a] |= inside[a]
    first = np.flatnonzero(new)
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    if not len(first):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    last = np.minimum(np.append(first[1:], len(chosen)), ends[np.searchsorted(ends, first, "right")])
    return first, last - first, chosen[first], h[chosen[first]]


def pieces(docs: Docs) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Index of the documents, where in them the piece starts, bounds and bytes; long documents come in pieces that overlap by a window less a byte."""
    at = 0
    while at < len(docs.did):
        to = max(at + 1, int(np.searchsorted(docs.bounds, docs.bounds[at] + PIECE, "right")) - 1)
        own = docs.raw[docs.bounds[at] : docs.bounds[to]]
        if to > at + 1 or len(own) <= PIECE:
            yield np.arange(at, to), np.zeros(to - at, np.int64), docs.bounds[at : to + 1] - docs.bounds[at], own
        else:
            for start in range(0, len(own), PIECE):
                piece = own[start : start + PIECE + WINDOW - 1]
                yield np.array([at]), np.array([start]), np.array([0, len(piece)]), piece
        at = to


class Stretches:
    """The stretches of a block: document, start in it and in raw, number of windows, place of the word, its hash."""

    def __init__(self, docs: Docs):
        parts = []
        for which, offset, bounds, raw in pieces(docs):
            first, count, word, h = stretches(raw, bounds)
            own = np.searchsorted(bounds, first, "right") - 1
            parts.append((which[own].astype(np.int32), first - bounds[own] + offset[own], count.astype(np.int8), (word - first).astype(np.int8), h))
        kinds = (np.int32, np.int64, np.int8, np.int8, U)
        self.doc, self.start, self.count, self.word, self.hash = (np.concatenate([np.zeros(0, k), *(p[i] for p in parts)]) for i, k in enumerate(kinds))
        self.at = docs.bounds[self.doc] + self.start

    def variants(self, raw: np.ndarray) -> np.ndarray:
        """A number of both ends and the length of each stretch: different numbers, different stretches."""
        eight = np.ndarray((len(raw) - 7,), "<u8", np.ascontiguousarray(raw), 0, (1,)) if len(self.at) else np.zeros(0, U)
        last = self.at + self.count + (WINDOW - 9)
        return mixed(eight[self.at] * U(0x9E3779B97F4A7C15) + eight[last] + self.count.astype(U))


def classes(n_buckets: int):
    """A block -> (bucket, hashes): each class of stretches that it holds, once, with how many different ones it has at least."""

    def run(rows: pa.Table) -> pa.Table:
        docs = block_docs(rows)
        s = Stretches(docs)
        h, first, back = np.unique(s.hash, return_index=True, return_inverse=True)
        different = np.unique(np.stack([back.astype(U), s.variants(docs.raw)], 1), axis=0)[:, 0].astype(np.int64)
        count = np.bincount(different, minlength=len(h)).astype(np.int32)
        keys, values = [], []
        for bucket, part in grouped(buckets_of(mixed(h), n_buckets)):  # mixed again: a least hash is a small number
            part = part[np.argsort(first[part])]
            keys.append(bucket)
            values.append(pack(np.array([docs.block]), h[part], np.diff(first[part], prepend=0).astype(np.int32), count[part]))
        return pa.table([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], ["bucket", "packed"])

    return run


def shared(table: pa.Table) -> pa.Table:
    """A bucket of classes -> by block, the places of those that other blocks hold too, and whether they are hot."""
    parts = [unpack(v.as_py()) for v in table.column("packed")]
    every, back = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
    several = np.bincount(back) > 1
    hot = np.bincount(back, weights=np.concatenate([p[3] for p in parts])) > HOT
    blocks, marks, at = [], [], 0
    for block, h, place, _ in parts:
        own = back[at : at + len(h)]
        at += len(h)
        hit = np.flatnonzero(several[own])
        if len(hit):
            blocks.append(int(block[0]))
            marks.append(pack(np.diff(np.cumsum(place, dtype=np.int64)[hit], prepend=0).astype(np.int32), hot[own[hit]].astype(np.int8)))
    return pa.table([pa.array(blocks, pa.int32()), pa.array(marks, pa.binary())], ["block", "marks"])


def splitters(docs: DataFrame, n: int, size: int) -> np.ndarray:
    """Ends of n ranges at most of the order of suffixes, from some SAMPLED * n suffixes at hashed places of documents drawn by length. size: bytes of all texts."""
    length = F.octet_length("text")
    chance = (F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    place = (F.pmod(F.xxhash64("text", "doc_id"), F.length("text")) + 1).cast("int")
    drawn = docs.where((length >= WINDOW) & (-F.log(chance) / length <= F.lit(SAMPLED * n / max(1, size))))
    found = drawn.select(F.substring(F.col("text"), place, F.lit(WINDOW)).alias("suffix")).collect()  # its expected size is bounded
    ordered = np.sort(np.array([r["suffix"].encode()[:WINDOW] for r in found], f"S{WINDOW}"))
    return np.unique(ordered[(np.arange(1, n) * len(ordered)) // n]) if len(ordered) else ordered


def deal(n_buckets: int, ends: np.ndarray):
    """A block and its shared classes -> (bucket, stretches) of classes that other blocks hold too and, with a bucket of
    -1 - block, the marks of windows that start earlier in the block."""
    n_ranges = len(ends) + 1
    parts_of_range = max(1, n_buckets // n_ranges)

    def bucket_of(raw: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        own = padded(raw, at, np.full(len(at), length), length, False)
        where = np.searchsorted(ends, own.view(f"S{length}").ravel().astype(f"S{WINDOW}"), "right") if len(at) else at
        return where * parts_of_range + buckets_of(mixed(word_hashes_at(raw, at)), parts_of_range)

    def run(rows: pa.Table, marks: pa.Table) -> pa.Table:
        docs = block_docs(rows)
        s = Stretches(docs)
        _, back, size = np.unique(s.hash, return_inverse=True, return_counts=True)
        elsewhere, hot = np.zeros(len(size), bool), np.zeros(len(size), bool)
        for v in marks.column("marks"):
            place, is_hot = unpack(v.as_py())
            own = back[np.cumsum(place, dtype=np.int64)]
            elsewhere[own], hot[own] = True, is_hot > 0
        keys, values = [], []
        near = np.flatnonzero(size[back] > 1)
        which, first, n = repeats(docs.raw, s.at[near], docs.did[s.doc[near]], s.start[near], s.count[near].astype(np.int64), s.word[near].astype(np.int64))
        which = near[which]
        if len(which):
            keys.append(-1 - docs.block)
            values.append(pack(*joined(s.doc[which], s.start[which] + first, n)))
        left = s.count - np.bincount(which, n, len(s.at)).astype(np.int64) > 0
        ship = left & elsewhere[back]
        cold, warm = np.flatnonzero(ship & ~hot[back]), np.flatnonzero(ship & hot[back])
        count = s.count[warm].astype(np.int64)
        inside = exclusive(count)
        gone = np.zeros(inside[-1] + 1, np.int32)
        of = np.full(len(s.at), -1)
        of[warm] = np.arange(len(warm))
        hit = of[which] >= 0
        np.add.at(gone, inside[of[which[hit]]] + first[hit], 1)
        np.add.at(gone, inside[of[which[hit]]] + first[hit] + n[hit], -1)
        stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
        one = lambda x: ranges(x[warm], count)[stay]
        at = np.concatenate([s.at[cold], one(s.at)])
        doc = np.concatenate([s.doc[cold], np.repeat(s.doc[warm], count)[stay]])
        start = np.concatenate([s.start[cold], one(s.start)])
        count = np.concatenate([s.count[cold], np.ones(len(stay), np.int8)])
        word = np.concatenate([s.word[cold], np.zeros(len(stay), np.int8)])  # a window that goes alone is its own suffix
        bucket = np.concatenate([bucket_of(docs.raw, at[: len(cold)] + word[: len(cold)], WORD), bucket_of(docs.raw, at[len(cold) :], WINDOW)])
        for b, own in grouped(bucket):
            keys.append(b)
            values.append(pack(np.array([docs.block]), np.diff(docs.did[doc[own]], prepend=0), np.diff(doc[own], prepend=0).astype(np.int32), start[own].astype(np.int64), count[own].astype(np.int8), word[own].astype(np.int8), docs.raw[ranges(at[own], count[own].astype(np.int64) + (WINDOW - 1))]))
        return pa.table([pa.array(keys, pa.int32()), pa.array(values, pa.binary())], ["bucket", "packed"])

    return run


def word_hashes_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The hash of word_hashes() at some positions."""
    eight = np.ndarray((max(0, len(raw) - 7),), "<u8", np.ascontiguousarray(raw), 0, (1,))
    h = eight[at] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    return mixed(h + eight[at + 8])


def padded(text: np.ndarray, begin: np.ndarray, length: np.ndarray, width: int, backwards: bool) -> np.ndarray:
    """A row for each stretch of text, filled up with zeros; backwards: read from its end."""
    out = np.zeros((len(begin), width), np.uint8)
    if backwards:
        inside = np.arange(int(length.sum())) - np.repeat(exclusive(length)[:-1], length)
        out[np.arange(width) < length[:, None]] = text[np.repeat(begin + length - 1, length) - inside]
    else:
        out[np.arange(width) < length[:, None]] = text[ranges(begin, length)]
    return out


def refine(group: np.ndarray, keys: list, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts order inside its groups by one key after another; only suffixes that still tie are looked at.

    group: ascending group numbers along order; keys: functions of suffixes. Gives order and the finer groups."""
    for key in keys:
        size = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        tied = np.flatnonzero(size[group] > 1) if len(group) else np.zeros(0, np.int64)
        if not len(tied):
            break
        value = key(order[tied])
        inside = np.lexsort((value, group[tied]))
        value, where = value[inside], group[tied][inside]
        order[tied] = order[tied][inside]
        split = np.zeros(len(group), bool)
        split[tied[1:]] = (where[1:] == where[:-1]) & (value[1:] != value[:-1])
        split[1:] |= group[1:] != group[:-1]
        group = np.cumsum(split)
    return order, group


def big_endian(text: np.ndarray, ahead: int):
    """Eight bytes of the text from suffix + ahead, as a number that orders them."""
    eight = np.ndarray((max(0, len(text) - 7),), ">u8", text, 0, (1,))
    return lambda at: eight[at + ahead].astype(U)


def cover_ranks(text: np.ndarray, sample: np.ndarray, depth: int) -> np.ndarray:
    """By position of the text, the rank of the sampled suffixes there by their first depth bytes; equal bytes, equal ranks."""
    steps = [*range(0, depth - 8, 8), depth - 8]
    order, group = refine(np.zeros(len(sample), np.int64), [big_endian(text, a) for a in steps], sample.copy())
    ranks = np.zeros(len(text), np.int32)
    ranks[order] = group
    return ranks


def by_cover(group: np.ndarray, order: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Splits groups of tied suffixes three ways about a pivot, again and again, by the cover ranks at their shift from it."""
    done = np.zeros(len(order), bool)
    while len(order):
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(heads, len(order)))
        live = np.flatnonzero(~done & (np.repeat(size, size) > 1))
        if not len(live):
            break
        pivot = order[np.repeat(heads + size // 2, size)[live]]
        mine = order[live]
        shift = SHIFT[mine % PERIOD, pivot % PERIOD]
        side = np.sign(ranks[mine + shift] - ranks[pivot + shift])
        inside = np.lexsort((side, group[live]))
        order[live], side, where = mine[inside], side[inside], group[live][inside]
        split = np.append(True, group[1:] != group[:-1])
        split[live[1:]] |= (where[1:] == where[:-1]) & (side[1:] != side[:-1])
        done[live] = side == 0
        group = np.cumsum(split) - 1
    return order, group


def suffix_order(rows: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The lexicographic order of rows by their first depth bytes at least, and how many of the first depth bytes each has in common with the one before it.

    Rows have PERIOD bytes more. Those that tie on PERIOD bytes are ordered by the ranks of the cover sample at the shift at which both meet it."""
    n, width = rows.shape
    text = np.append(rows.ravel(), np.zeros(8, np.uint8))
    order, group = refine(np.zeros(n, np.int64), [big_endian(text, a) for a in (0, 8, 16, PERIOD - 8)], np.arange(n) * width)
    size = np.bincount(group) if n else np.zeros(0, np.int64)
    tied = np.flatnonzero(size[group] > 1) if n else np.zeros(0, np.int64)
    if len(tied):
        residue = np.zeros(PERIOD, bool)
        residue[COVER] = True
        near = (np.sort(order[tied])[:, None] + np.arange(PERIOD)).ravel()
        ranks = cover_ranks(text, near[residue[near % PERIOD]], depth)
        order[tied], _ = by_cover(group[tied], order[tied].copy(), ranks)
    order //= width
    common = np.zeros(n, np.int64)
    for a in range(1, n, 1 << 14):
        to = min(n, a + (1 << 14))
        other = rows[order[a:to], :depth] != rows[order[a - 1 : to - 1], :depth]
        common[a:to] = np.where(other.any(1), other.argmax(1), depth)
    return order, common


def runs(order: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """By row, the number of its run of rows that have depth bytes in common."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(common < depth)
    return out


def reach(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """By row, how many bytes it has in common with any other row."""
    out = np.empty(len(order), np.int64)
    out[order] = np.maximum(common, np.append(common[1:], 0))
    return out


def repeats(text: np.ndarray, begin: np.ndarray, did: np.ndarray, start: np.ndarray, count: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (begin in text; document; start there; number of windows; place of the word) -> windows that start earlier
    elsewhere among them: stretch, first window, number of windows."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 3]
    if len(begin):
        eight = np.ndarray((len(text) - 7,), ">u8", np.ascontiguousarray(text), 0, (1,))
        high, low = eight[begin + word], eight[begin + word + 8]
        order = np.lexsort((low, high))
        same = np.cumsum(np.append(0, (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])))
        order = order[np.bincount(same)[same] > 1]
        same = same[np.bincount(same)[same] > 1]
        for part in lots(same, np.ones(len(same), np.int64), LOT):
            own = order[part]
            own = own[np.lexsort(((start + word)[own], did[own]))]  # from here on the smaller index is the earlier
            found += [(own[w], k, n) for w, k, n in repeats_of_lot(text, begin[own], did[own], (start + word)[own], count[own], word[own])]
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def repeats_of_lot(text: np.ndarray, begin: np.ndarray, did: np.ndarray, place: np.ndarray, count: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of stretches in order of (did, place of the word)."""
    n = len(begin)
    least = word - count + 1  # the least offset of the word in its windows
    right, left = (WINDOW, WINDOW - least), (WINDOW - WORD, word)
    after = suffix_order(padded(text, begin + word, right[1], right[0] + PERIOD + 1, False), right[0])
    before = suffix_order(padded(text, begin, left[1], left[0] + PERIOD + 1, True), left[0])
    # of runs of equal stretches the first stands for all
    kind = ((runs(*after, right[0]) * n + runs(*before, left[0])) * WINDOW + word) * WINDOW + count
    _, first, back = np.unique(kind, return_index=True, return_inverse=True)
    first = first[back]
    copy = (first != np.arange(n)) & ((did != did[first]) | (place != place[first]))
    yield np.flatnonzero(copy), np.zeros(int(copy.sum()), np.int64), count[copy]
    low, high = np.maximum(least, WINDOW - reach(*after)), np.minimum(word, reach(*before))
    live = np.flatnonzero(~copy & (low <= high))
    low, high = low[live], high[live]
    for offset in range(int(low.min()), int(high.max()) + 1) if len(live) else ():
        own = live[(low <= offset) & (offset <= high)]
        _, first, back = np.unique(runs(*after, WINDOW - offset)[own] * n + runs(*before, offset)[own], return_index=True, return_inverse=True)
        first = own[first[back]]
        late = own[(did[own] != did[first]) | (place[own] != place[first])]
        yield late, word[late] - offset, np.ones(len(late), np.int64)


def lots(classes: np.ndarray, size: np.ndarray, limit: int) -> Iterator[slice]:
    """Whole classes (equal numbers in a row), some at a time, of some limit together; a larger class comes alone."""
    ends = np.append(np.flatnonzero(np.diff(classes)) + 1, len(classes)) if len(classes) else np.zeros(0, np.int64)
    total, at, before = exclusive(size), 0, 0
    for end in ends.tolist():
        if end > before > at and total[end] - total[at] > limit:
            yield slice(at, before)
            at = before
        before = end
    if at < before:
        yield slice(at, before)


def sort_bucket(table: pa.Table) -> pa.Table:
    """The stretches of a bucket -> by block, the marks of the windows that start earlier elsewhere."""
    if table.num_rows and table.column("bucket")[0].as_py() < 0:
        blocks = [-1 - b for b in table.column("bucket").to_pylist()]
        return pa.table([pa.array(blocks, pa.int32()), table.column("packed").cast(pa.binary())], ["block", "marks"])
    parts = [unpack(v.as_py()) for v in table.column("packed")]
    block = np.repeat([int(p[0][0]) for p in parts], [len(p[1]) for p in parts])
    did, doc = (np.concatenate([np.cumsum(p[i], dtype=np.int64) for p in parts]) for i in (1, 2))
    start, count, word = (np.concatenate([p[i] for p in parts]).astype(np.int64) for i in (3, 4, 5))
    text = np.concatenate([p[6] for p in parts])
    which, first, n = repeats(text, exclusive(count + WINDOW - 1)[:-1], did, start, count, word)
    out_b, out_m = [], []
    for b, part in grouped(block[which]):
        out_b.append(b)
        out_m.append(pack(*joined(doc[which[part]], start[which[part]] + first[part], n[part])))
    return pa.table([pa.array(out_b, pa.int32()), pa.array(out_m, pa.binary())], ["block", "marks"])


def joined(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks with those that follow one another as one."""
    by = np.lexsort((start, doc))
    doc, start, count = doc[by], start[by], count[by]
    head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + count[:-1]))) if len(by) else by
    end = np.maximum.reduceat(start + count, head) if len(head) else start
    return doc[head].astype(np.int32), start[head], end - start[head]


def removed(docs: Docs, marks: pa.Table) -> np.ndarray:
    """Which bytes of the block go."""
    cover = np.zeros(len(docs.raw) + 1, np.int32)
    for v in marks.column("marks"):
        doc, start, count = unpack(v.as_py())
        at = docs.bounds[doc] + start
        np.add.at(cover, at, 1)
        np.add.at(cover, at + count + (WINDOW - 1), -1)
    return np.cumsum(cover[:-1], dtype=np.int32) > 0


def digests(rows: pa.Table, marks: pa.Table) -> pa.Table:
    docs = block_docs(rows)
    gone = removed(docs, marks)
    out: list[list] = [[], [], [], []]
    for a, b in zip(docs.bounds[:-1].tolist(), docs.bounds[1:].tolist(), strict=True):
        own = gone[a:b]
        edge = int(np.count_nonzero(own[1:] & ~own[:-1])) + int(own[:1].sum())
        for column, value in zip(out, (b - a, int(np.count_nonzero(own)), edge, hashlib.sha256(docs.raw[a:b][~own].tobytes()).hexdigest()), strict=True):
            column.append(value)
    ids = pa.array(docs.did, pa.int64(), mask=docs.did == NO_ID)
    return pa.table([ids, *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def kept_texts(rows: pa.Table, marks: pa.Table) -> pa.Table:
    docs = block_docs(rows)
    gone = removed(docs, marks)
    texts, lost = [], []
    for a, b in zip(docs.bounds[:-1].tolist(), docs.bounds[1:].tolist(), strict=True):
        own, out = docs.raw[a:b], gone[a:b]
        if out.any():  # a character goes if all its bytes go
            lead = np.flatnonzero((own & 0xC0) != 0x80)
            whole = np.logical_and.reduceat(out, lead)
            own = own[~np.repeat(whole, np.diff(np.append(lead, len(own))))]
        texts.append(own.tobytes().decode("utf-8", "replace"))
        lost.append(int(np.count_nonzero(out)))
    ids = pa.array(docs.did, pa.int64(), mask=docs.did == NO_ID)
    return pa.table([ids, pa.array(docs.rid, pa.int64()), pa.array(texts, pa.string()), pa.array(lost, pa.int64())], ["doc_id", "rid", "text", "n_removed"])


def run(docs: DataFrame, last, schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    size = text_size(docs)
    n_blocks, n_buckets = blocks_and_buckets(docs.sparkSession, size)
    ends = splitters(docs, min(n_buckets, RANGES), size)
    blocks = keyed(docs, n_blocks, more).groupBy("block")
    alike = blocks.applyInArrow(lean_group(classes(n_buckets)), PACKED).groupBy("bucket").applyInArrow(lean_group(shared), MARKS)
    dealt = blocks.cogroup(alike.groupBy("block")).applyInArrow(lean_cogroup(deal(n_buckets, ends)), PACKED)
    marks = dealt.groupBy("bucket").applyInArrow(lean_group(sort_bucket), MARKS)
    return blocks.cogroup(marks.groupBy("block")).applyInArrow(lean_cogroup(last), schema)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, rid (xxhash64 of the old text), text without what repeats (only whole characters go), n_removed bytes: a row for each of docs (doc_id, text)."""
    return run(docs, kept_texts, "doc_id long, rid long, text string, n_removed long")


def restored(rows: pa.Table, marks: pa.Table) -> pa.Table:
    """kept_texts() with the other columns of documents, in the order of block_docs()."""
    order = np.lexsort((rows.column("rid").to_numpy(), rows.column("did").to_numpy())) if rows.num_rows else np.zeros(0, np.int64)
    new, old = kept_texts(rows, marks), rows.take(pa.array(order))
    chars = pa.array([len(t) if n else c for t, n, c in zip(new.column("text").to_pylist(), new.column("n_removed").to_pylist(), old.column("n_chars").to_pylist(), strict=True)], pa.int64())
    text = pc.if_else(old.column("no_text"), pa.scalar(None, pa.string()), new.column("text"))
    return pa.table([new.column("doc_id"), text, old.column("lang"), old.column("source"), chars], ["doc_id", "text", "lang", "source", "n_chars"])


def replaced(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source, n_chars) with texts without what repeats, and n_chars of the texts that changed."""
    return run(docs, restored, "doc_id long, text string, lang string, source string, n_chars long", ("lang", "source", "n_chars"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
