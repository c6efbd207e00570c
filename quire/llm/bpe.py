"""Operator 8, byte-level BPE encoding and decoding, by recursive queries of DuckDB in each partition.

Method: the distinct words (matches of the pattern) of some documents that are no token themselves become rows (word,
position, token), a byte each. A recursive query joins neighbours with the merge table and contracts, in each word and
step, the leftmost pair of least rank, until no word has one. Documents are then sequences of ids; decoding joins the ids
of every document with the vocabulary and puts their bytes together by ordered aggregation.

A recursive query keeps the rows of all its steps, the square of a word's length. Words of more than WHOLE bytes therefore
enter it in parts. They are cut wherever two neighbouring bytes stand side by side in no token, which no merge can cross.
What is still longer enters as overlapping spans, which are joined at a token that two spans have in common. That is exact:
ids are those of the whole word if each two neighbouring ids are what their own bytes give (the first merge across a
boundary would also be made in these two alone), and each such pair was made inside one span. Spans without a common token
are made anew twice as long.

The ranks are those of a file in tiktoken's format, given as a parameter; special tokens are ordinary text. A null text is
empty (no ids). Memory is bounded by lots of distinct words; known words are kept for later texts up to a bound (CACHE), those met
of late first. Rows are judged one by one: null and repeated ids stay.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, release

#: Characters of text that are split into words at a time.
PIECE = 2 << 20
#: Distinct words that go through a recursive query together, the rows that its steps may keep, and words that are kept.
LOT = 20_000
STEPS = 4_000_000
CACHE = 450_000
#: The first and the last of these for executors that hold what earlier stages left: less memory, more time.
SMALL = (1 << 20, 200_000)
#: Bytes of a word that enters a query whole; bytes of a span at first, of which half is also in the next.
WHOLE = 192
SPAN = 96
#: Tokens that are decoded together.
IDS = 2_000_000

#: step: k is the rank of the pair that begins at p, with p itself in the low 32 bits (null if it is no pair). Each step
#: finds the least k of each word, best. The second row of that pair goes, the first takes the merged token; only it and
#: the row before it get another pair, so only they are joined with the merge table again. A word without a pair is done.
ENCODE = """
WITH RECURSIVE step(w, p, t, k, done) {kept} AS (
    SELECT w, p, t, (CAST(id AS BIGINT) << 32) + p, FALSE FROM bytes LEFT JOIN merges ON a = t AND b = n
  UNION ALL
    SELECT w, p, t, CASE WHEN n IS NULL THEN k ELSE (CAST(id AS BIGINT) << 32) + p END, done
    FROM (SELECT w, p,
                 CASE WHEN k = best THEN CAST(best >> 32 AS INTEGER) ELSE t END AS t,
                 CASE WHEN k = best THEN coalesce(after, -1) WHEN following = best THEN CAST(best >> 32 AS INTEGER) END AS n,
                 CASE WHEN k = best THEN NULL ELSE k END AS k,
                 best IS NULL AS done
          FROM (SELECT w, p, t, k, lag(k) OVER o AS before, lead(k) OVER o AS following, lead(t, 2) OVER o AS after,
                       min(k) OVER (PARTITION BY w ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best
                FROM step WHERE NOT done WINDOW o AS (PARTITION BY w ORDER BY p))
          WHERE best IS NULL OR before IS DISTINCT FROM best)
    LEFT JOIN merges ON a = t AND b = n
)
SELECT w, string_agg(t, ' ' ORDER BY p) AS ids FROM step WHERE done GROUP BY w
"""
DECODE = "SELECT s, unhex(string_agg(hex, '' ORDER BY p)) AS raw FROM ids JOIN vocabulary USING (id) GROUP BY s"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encoder and decoder over one DuckDB connection."""

    def __init__(self, path: str, pattern: str, cache: int | None = None):
        import duckdb
        import regex

        self.find = regex.compile(pattern).findall
        self.cache = CACHE if cache is None else cache
        self.ranks = read_ranks(path)
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.size = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.beside = np.zeros((256, 256), bool)  # bytes that stand side by side in a token
        for t, r in self.ranks.items():
            self.size[r] = len(t)
            own = np.frombuffer(t, np.uint8)
            self.beside[own[:-1], own[1:]] = True
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        self.db.execute("SET allocator_flush_threshold = '1MB'")
        a, b, r = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
        self.load("merges", pa.table([a, b, r], ["a", "b", "id"]))
        self.load("vocabulary", pa.table([pa.array(self.ranks.values(), pa.int32()), pa.array([t.hex() for t in self.ranks])], ["id", "hex"]))
        #: By word, the ids in decimal joined by a space, of words met of late, and of those before.
        self.ids: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.long: list[str] = []

    def load(self, name: str, table: pa.Table) -> None:
        self.db.register("incoming", table)
        self.db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.db.unregister("incoming")

    def add(self, words: list[str]) -> None:
        """Codes distinct words that aren't known yet. A word that is a token is that token, as in tiktoken."""
        todo: list[str] = []
        for w in words:
            rank = self.ranks.get(w.encode())
            if rank is None:
                todo.append(w)
            else:
                self.ids[w] = str(rank)
        raws = [w.encode() for w in todo]
        whole = [i for i, raw in enumerate(raws) if len(raw) <= WHOLE]
        self.ids.update(zip([todo[i] for i in whole], self.contracted([raws[i] for i in whole]), strict=True))
        for w, raw in zip(todo, raws, strict=True):
            if len(raw) > WHOLE:
                self.ids[w] = self.in_parts(raw)

    def contracted(self, raws: list[bytes]) -> list[str]:
        """The ids of byte strings, in lots of similar length: a lot takes as many steps as its longest."""
        out = [""] * len(raws)
        order = sorted(range(len(raws)), key=lambda i: len(raws[i]))
        at = 0
        while at < len(order):
            longest = len(raws[order[min(len(order), at + LOT) - 1]])
            kept = longest <= WHOLE  # spans that had to grow keep the last row of each position only, which takes longer
            to = min(len(order), at + min(LOT, max(1, STEPS // (longest**2 if kept else 16 * longest))))
            for i, ids in zip(order[at:to], self.contract([raws[i] for i in order[at:to]], "" if kept else "USING KEY (w, p)"), strict=True):
                out[i] = ids
            at = to
        return out

    def contract(self, raws: list[bytes], kept: str) -> list[str]:
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(lengths)
        t = self.byte[np.frombuffer(b"".join(raws), np.uint8)]
        last = np.zeros(len(t), bool)
        last[ends - 1] = True
        n = pa.array(np.append(t[1:], np.int32(0)), mask=last)
        w, p = np.repeat(np.arange(len(raws), dtype=np.int32), lengths), (np.arange(len(t)) - np.repeat(ends - lengths, lengths)).astype(np.int32)
        self.load("bytes", pa.table([pa.array(w), pa.array(p), pa.array(t), n], ["w", "p", "t", "n"]))
        found = self.db.sql(ENCODE.format(kept=kept)).to_arrow_table()
        out = [""] * len(raws)
        for k, ids in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            out[k] = ids
        return out

    def in_parts(self, raw: bytes) -> str:
        """The ids of a word that is too long to enter whole."""
        own = np.frombuffer(raw, np.uint8)
        cuts = [0, *(np.flatnonzero(~self.beside[own[:-1], own[1:]]) + 1).tolist(), len(raw)]
        parts = [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        short = [*{x for x in parts if len(x) <= WHOLE}]
        ids = dict(zip(short, self.contracted(short), strict=True))
        for x in parts:
            if x not in ids:
                ids[x] = self.in_spans(x)
        return " ".join([ids[x] for x in parts])

    def in_spans(self, raw: bytes) -> str:
        """The ids of a byte string, by spans that overlap."""
        spans = laid(0, len(raw), SPAN)
        known: dict[bytes, np.ndarray] = {}
        while True:
            new = [*{raw[a:b] for a, b in spans}.difference(known)]
            known.update((x, np.array(ids.split(), np.int64)) for x, ids in zip(new, self.contracted(new), strict=True))
            bounds = [np.append(a, a + np.cumsum(self.size[known[raw[a:b]]])) for a, b in spans]
            seams, failed, least = [], [], 0
            for i in range(len(spans) - 1):
                seam = common_token(bounds[i], bounds[i + 1], least)
                failed.append(seam is None)
                least = spans[i + 1][0] if seam is None else seam
                seams.append(least)
            if not any(failed):
                break
            longer, i = [], 0
            while i < len(spans):
                j = i
                while j < len(failed) and failed[j]:
                    j += 1
                if j > i:
                    longer += laid(spans[i][0], spans[j][1], 2 * max(b - a for a, b in spans[i : j + 1]))
                else:
                    longer.append(spans[i])
                i = j + 1
            spans = longer
        out = []
        for (a, b), own, start, end in zip(spans, bounds, [0, *seams], [*seams, len(raw)], strict=True):
            out += known[raw[a:b]][np.searchsorted(own, start) : np.searchsorted(own, end)].tolist()
        return " ".join(map(str, out))

    def decode(self, lengths: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """The bytes of sequences of ids, which lie one after another."""
        out = [b""] * len(lengths)
        s = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        self.load("ids", pa.table([pa.array(s), pa.array(np.arange(len(s))), pa.array(ids, pa.int32())], ["s", "p", "id"]))
        found = self.db.sql(DECODE).to_arrow_table()
        for k, raw in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True):
            out[k] = raw
        return out

    def coded(self, texts: list[list[str]]) -> dict[str, str]:
        """Ids by word, of the words of some texts at least."""
        met = set().union(*texts)
        if len(self.ids) + len(met) > self.cache:
            self.old, self.ids = self.ids, {}
        missing = met.difference(self.ids)
        known = missing.intersection(self.old)
        self.ids.update(zip(known, map(self.old.__getitem__, known), strict=True))
        new = [*missing.difference(known)]
        self.add(new)
        self.long += [w for w in new if len(w) > WHOLE]
        return self.ids

    def forget(self) -> None:
        """Long words aren't kept: known words are bounded in number, so their length must be too."""
        for w in self.long:
            del self.ids[w]
        self.long = []

    def words(self, text: str) -> list[str]:
        return self.find(text)


def laid(a: int, b: int, span: int) -> list[tuple[int, int]]:
    """Spans from a to b, each of which has its second half in common with the next."""
    step = span // 2
    n = max(1, -(-(b - a - step) // step))
    return [(a + i * step, b if i == n - 1 else a + i * step + span) for i in range(n)]


def common_token(left: np.ndarray, right: np.ndarray, least: int) -> int | None:
    """The first boundary from least on at which the same token begins in two overlapping spans, by the boundaries of their tokens."""
    left = left[np.searchsorted(left, right[0]) :]
    begin, i, j = np.intersect1d(left[:-1], right[:-1], return_indices=True)
    hit = np.flatnonzero((left[i + 1] == right[j + 1]) & (begin >= least))
    return int(begin[hit[0]]) if len(hit) else None


CODECS: dict[tuple, Codec] = {}
CACHES.append(CODECS.clear)


def codec(path: str, pattern: str, cache: int | None = None) -> Codec:
    """One for each Python worker."""
    if (path, pattern, cache) not in CODECS:
        CODECS[path, pattern, cache] = Codec(path, pattern, cache)
    return CODECS[path, pattern, cache]


def lots(texts: list[str], limit: int) -> Iterator[list[str]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def ids_of(own: Codec, texts: list[str]) -> list[str]:
    """The ids of some texts, in decimal joined by a space."""
    split = [own.words(t) for t in texts]
    of = own.coded(split)
    out = [" ".join(map(of.__getitem__, words)) for words in split]
    own.forget()
    return out


def numbers(joined: list[str]) -> np.ndarray:
    return np.fromstring(" ".join(joined), np.int32, sep=" ")


def raws(own: Codec, joined: list[str]) -> Iterator[bytes]:
    """What sequences of ids decode to, some of them at a time."""
    for some in lots(joined, 6 * IDS):
        yield from own.decode(np.array([x.count(" ") + bool(x) for x in some]), numbers([x for x in some if x]))


def digests(path: str, pattern: str, passed: int = 1, piece: int = PIECE, cache: int | None = None):
    """Rows (others..., text) -> (others..., n_tokens, ids_sha256, decoded_sha256), decoded from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, cache)  # with its known words it stays for the worker's next task
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            counts, ids, decoded_to = [], [], []
            for texts in lots([t or "" for t in b.column(passed).to_pylist()], piece):
                joined = ids_of(own, texts)
                counts += [x.count(" ") + bool(x) for x in joined]
                ids += [sha(x.encode()) for x in joined]
                decoded_to += map(sha, raws(own, joined))
            yield pa.RecordBatch.from_arrays([*b.columns[:passed], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded_to, pa.string())], [*b.schema.names[:passed], "n_tokens", "ids_sha256", "decoded_sha256"])
        release(caches=False)

    return run


def encoded(path: str, pattern: str):
    """Rows (id, text) -> (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            joined = [x for texts in lots([t or "" for t in b.column(1).to_pylist()], PIECE) for x in ids_of(own, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([numbers([x]) for x in joined], pa.list_(pa.int32()))], [b.schema.names[0], "ids"])

    return run


def decoded(path: str, pattern: str):
    """Rows (id, ids) -> (id, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            sequences = [x or [] for x in b.column(1).to_pylist()]
            raw = own.decode(np.array([len(x) for x in sequences], np.int64), np.array([i for x in sequences for i in x], np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], [b.schema.names[0], "raw"])

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(encoded(path, pattern), "doc_id long, ids array<int>")


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, raw: the bytes of ids (doc_id, ids)."""
    return ids.select("doc_id", "ids").mapInArrow(decoded(path, pattern), "doc_id long, raw binary")


def bpe_digests(docs: DataFrame, path: str, pattern: str, piece: int = PIECE, cache: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256. piece, cache: characters split at a time and words kept, which set a worker's memory, not the result."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(digests(path, pattern, 1, piece, cache), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
