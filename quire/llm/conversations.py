"""Operator 12, conversation structure repair: the cheapest edits that give a conversation's turns the form (system? (user assistant)+)?.

Method: forward dynamic programming (Viterbi) per grouped conversation over four states of the grammar (nothing yet, after
system, after user, after assistant). Each state carries the least (cost, audit): audit has a letter an edit, and equal costs
are settled by it. A row keeps its state's layer closed under insertions: two in a row reach every state that insertions reach
at all. No audit of a layer is the beginning of another of equal cost (it would have more insertions, which cost), so the least
so far stays the least.

Edits: Keep (0), Rerole to user or assistant (3), Delete (4; blank and duplicate rows must go), Insert an empty user or assistant
row (3); a truncated row that stays adds 3. Rows come by turn (null first); rows of one turn by role, then text, and copies of a row one after
the other. A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation), truncated.

Conversations of up to LONG rows and LONG_BYTES of text are repaired as they stream past, sorted, one in memory at a time. Longer ones take
blocks: rows are dealt by ranges of their order, each block becomes a matrix of least (cost, audit) from state to state, the matrices
of a conversation are multiplied in order, and its repaired text is hashed as it streams past with the audit. Either way gives the same rows; no
worker holds a long conversation's texts (its audit, which is one value of the result, it does hold).

A null role or text is one space, and so is a null conv_id or turn in what damage hashes; an empty role, or one
with another initial than s, u or a, fits nowhere unless it is changed. All rows with a null conv_id are one conversation. Repeated
rows are duplicates. A conversation without rows (all dropped) has zeros and the hash of the empty string; an empty table
gives no rows. Extra columns are ignored."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, partitions, written

#: Rows and bytes of text from which a conversation is repaired by blocks.
LONG = 4096
LONG_BYTES = 32 << 20
#: Conversations up to which their list is broadcast (8 bytes each).
BROADCAST_ROWS = 1_000_000
#: Memory of patterns: conversations of so many rows, so many patterns.
SHORT, PATTERNS = 32, 1 << 16

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: From which states a role leads to which.
GRAMMAR = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
MOVES = [(a, b) for role in "ua" for a, b in GRAMMAR[role].items()]
FINAL = (START, ASSISTANT)
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
GONE = "x"

ROW = "conv_id long, turn long, role string, text string, dropped boolean"
REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

SQL = """
WITH RECURSIVE bits(v, c, k) AS (SELECT v, v, 0 FROM range(256) t(v) UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
filled AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
bytes AS (SELECT *, list_concat([4294967295::BIGINT], list_transform(range(1, length(k) + 1), lambda i: ascii(substr(k, i, 1))::BIGINT)) AS b FROM filled),
coded AS (SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 20 AS code FROM bytes, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE code WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM coded),
numbered AS (SELECT conv_id, turn, role, text, row_number() OVER o AS i, substr(role, 1, 1) AS r,
 NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS ended FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM numbered),
rows AS (SELECT *, CASE WHEN blank THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT ended THEN 't' ELSE '' END AS fault, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au') AS illegal FROM seen),
totals AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
 count(*) FILTER (illegal) AS illegal, count(*) AS n FROM rows GROUP BY conv_id),
grammar(r, s, e) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
inserted AS (SELECT s, e, 'I' AS a, 3 AS c, chr(10) || CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END AS o FROM grammar WHERE r <> 's'),
closed AS (SELECT s, s AS e, '' AS a, 0 AS c, '' AS o FROM range(4) t(s) UNION ALL FROM inserted UNION ALL SELECT x.s, y.e, 'II', 6, x.o || y.o FROM inserted x JOIN inserted y ON x.e = y.s WHERE x.s <> y.e),
edits AS (SELECT r, s, e, 'K' AS a, 0 AS c FROM grammar UNION ALL SELECT NULL, s, e, 'R', 3 FROM grammar WHERE r <> 's' UNION ALL SELECT NULL, s, s, 'D', 4 FROM range(4) t(s)),
steps AS (SELECT d.r, d.s, d.e AS mid, k.e, d.a AS edit, d.a || k.a AS a, d.c + k.c AS c, k.o FROM edits d JOIN closed k ON k.s = d.e),
layers(conv_id, i, s, c, a, o) AS (SELECT conv_id, 0::BIGINT, e, c, a, o FROM totals, closed WHERE s = 0
 UNION ALL SELECT l.conv_id, l.i + 1, t.e, min(l.c + t.c + CASE WHEN fault = 't' AND edit <> 'D' THEN 3 ELSE 0 END), arg_min(l.a || t.a, (l.c + t.c + CASE WHEN fault = 't' AND edit <> 'D' THEN 3 ELSE 0 END, l.a || t.a)),
 arg_min(l.o || CASE edit WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || CASE mid WHEN 2 THEN 'user:' ELSE 'assistant:' END || text END || t.o, (l.c + t.c + CASE WHEN fault = 't' AND edit <> 'D' THEN 3 ELSE 0 END, l.a || t.a))
 FROM layers l JOIN rows x ON x.conv_id IS NOT DISTINCT FROM l.conv_id AND x.i = l.i + 1 JOIN steps t ON t.s = l.s AND (t.r IS NULL OR t.r = x.r) AND (edit = 'D' OR fault NOT IN ('b', 'd')) GROUP BY l.conv_id, l.i + 1, t.e),
best AS (SELECT l.conv_id, min(c) AS cost, arg_min(a, (c, a)) AS audit, substr(arg_min(o, (c, a)), 2) AS o FROM layers l JOIN totals t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND i = n WHERE s IN (0, 3) GROUP BY l.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(o, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
"""

Layer = dict[int, tuple[int, str]]


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, dropped: by crc32 of conv_id:turn modulo 20, 0 drops a row (it stays, marked, so that its conversation does), 1 empties
    its text, 2 takes the ends of sentences out, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    code = F.pmod(F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")))), F.lit(20)).alias("code")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), code)
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text")
    copies = F.explode(F.array_repeat(F.col("code") == 0, F.when(F.col("code") == 3, 2).otherwise(1))).alias("dropped")
    return rows.select("conv_id", "turn", role, text, copies)


def closed(layer: Layer) -> Layer:
    """layer with all that insertions reach."""
    for _ in range(2):
        for a, b in MOVES:
            if a in layer:
                found = (layer[a][0] + INSERT, layer[a][1] + "I")
                if b not in layer or found < layer[b]:
                    layer[b] = found
    return layer


def row_edits(layer: Layer, symbol: str) -> Layer:
    """The layer after a row: its role's initial (a capital where truncated, - for others), or GONE where it must be deleted."""
    out = {s: (c + DELETE, a + "D") for s, (c, a) in layer.items()}
    if symbol != GONE:
        more, keep = TRUNCATED if symbol.isupper() or symbol == "=" else 0, GRAMMAR.get(symbol.lower(), {})
        for moves, cost, letter in ((keep.items(), more, "K"), (MOVES, REROLE + more, "R")):
            for a, b in moves:
                if a in layer:
                    found = (layer[a][0] + cost, layer[a][1] + letter)
                    if b not in out or found < out[b]:
                        out[b] = found
    return closed(out)


def through(layer: Layer, symbols: str) -> tuple[str, Layer]:
    """What all audits begin with, and the layer after the rows, its audits without that."""
    settled = []
    for i, symbol in enumerate(symbols):
        layer = row_edits(layer, symbol)
        if i % 256 == 255:
            settled.append(os.path.commonprefix([a for _, a in layer.values()]))
            layer = {s: (c, a[len(settled[-1]) :]) for s, (c, a) in layer.items()}
    return "".join(settled), layer


def repair(symbols: str) -> tuple[int, str]:
    """cost, audit of a whole conversation."""
    settled, layer = through(closed({START: (0, "")}), symbols)
    cost, audit = min(layer[s] for s in FINAL if s in layer)
    return cost, settled + audit


known = lru_cache(PATTERNS)(repair)


def symbol_of(role: str, text: str, duplicate: bool) -> tuple[str, str]:
    """The row for row_edits(), and its fault: b, d, t or none."""
    end = text.rstrip(SPACES)[-1:]
    if not end or duplicate:
        return GONE, "d" if end else "b"
    initial = role[:1] if role[:1] in GRAMMAR else "-"
    if end in ENDS:
        return initial, ""
    return "=" if initial == "-" else initial.upper(), "t"


def lines(audit: str, rows: Iterator[tuple[str, str]], state: int = START) -> Iterator[str]:
    """role:text of what the edits leave."""
    for letter in audit:
        if letter == "I":
            state = ASSISTANT if state == USER else USER
            yield NAMES[state] + ":"
            continue
        role, text = next(rows)
        if letter == "K":
            state = GRAMMAR[role[:1]][state]
            yield f"{role}:{text}"
        elif letter == "R":
            state = ASSISTANT if state == USER else USER
            yield f"{NAMES[state]}:{text}"


class Digest:
    """SHA-256 of lines joined by newlines."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, line: str) -> None:
        self.sha.update(("\n" if self.any else "").encode() + line.encode())
        self.any = True


def gaps_of(turns: list) -> int:
    turns = [t for t in turns if t is not None]
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def illegal_of(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def streamed(batches, names: tuple[str, ...]) -> Iterator[tuple]:
    """The rows of sorted batches, strings of a slice at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield from zip(*(part.column(part.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


RESULT = pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in "gaps blank duplicate truncated illegal cost".split()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def whole(conv_id, rows: list[tuple]) -> tuple:
    """The result of a conversation in memory: (turn, role, text) in order."""
    seen, symbols, faults = set(), [], []
    for _, role, text in rows:
        symbol, fault = symbol_of(role, text, (role, text) in seen)
        seen.add((role, text))
        symbols.append(symbol)
        faults.append(fault)
    cost, audit = (known if len(rows) <= SHORT else repair)("".join(symbols))
    digest = Digest()
    for line in lines(audit, iter([r[1:] for r in rows])):
        digest.add(line)
    return conv_id, gaps_of([r[0] for r in rows]), faults.count("b"), faults.count("d"), faults.count("t"), illegal_of([r[1][:1] for r in rows]), cost, audit, digest.sha.hexdigest()


@lean
def repaired_short(batches):
    """REPAIRED of conversations that come one after the other."""
    last, rows, done = None, None, []
    for conv_id, turn, role, text, dropped in streamed(batches, ("conv_id", "turn", "role", "text", "dropped")):
        if rows is None or conv_id != last:
            if rows is not None:
                done.append(whole(last, rows))
            if len(done) >= 2048:
                yield table(done, RESULT)
                done = []
            last, rows = conv_id, []
        if not dropped:
            rows.append((turn, role, text))
    if rows is not None:
        done.append(whole(last, rows))
    yield table(done, RESULT)


BLOCK = "conv_id long, part long, costs array<int>, audits array<string>, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long"
BLOCK_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("costs", pa.list_(pa.int32())), ("audits", pa.list_(pa.string())), *((n, pa.int64()) for n in "n blank duplicate truncated illegal".split()), ("first", pa.string()), ("last", pa.string()), *((n, pa.int64()) for n in "turns low high".split())]
)


def block_of(conv_id, part: int, rows: list[tuple]) -> tuple:
    """(turn, initial, symbol, fault) of a stretch of a conversation, in order -> BLOCK; costs and audits from each state to each, -1 and none where there is no way."""
    costs, audits, symbols = [], [], "".join(r[2] for r in rows)
    for start in range(4):
        settled, layer = through(closed({start: (0, "")}), symbols)
        for end in range(4):
            cost, audit = layer.get(end, (-1, None))
            costs.append(cost)
            audits.append(None if audit is None else settled + audit)
    turns, faults, initials = [r[0] for r in rows if r[0] is not None], [r[3] for r in rows], [r[1] for r in rows]
    bounds = (len(set(turns)), min(turns), max(turns)) if turns else (0, None, None)
    return conv_id, part, costs, audits, len(rows), faults.count("b"), faults.count("d"), faults.count("t"), illegal_of(initials), *((initials[0], initials[-1]) if rows else (None, None)), *bounds


def blocks_of(size: int):
    @lean
    def blocks(batches):
        """BLOCK of each `size` rows of a conversation; parts are in order within a conversation, over all tasks."""
        part, last, rows, before, done = TaskContext.get().partitionId() << 32, None, None, None, []
        for conv_id, turn, role, text, dropped, late in streamed(batches, ("conv_id", "turn", "role", "text", "dropped", "late")):
            if rows is None or conv_id != last or len(rows) >= size:
                if rows is not None:
                    done.append(block_of(last, part, rows))
                    part += 1
                    if len(done) >= 64:
                        yield table(done, BLOCK_SCHEMA)
                        done = []
                if rows is None or conv_id != last:
                    before = None
                last, rows = conv_id, []
            if not dropped:
                rows.append((turn, role[:1], *symbol_of(role, text, late or before == (turn, role, text))))
                before = (turn, role, text)
        if rows is not None:
            done.append(block_of(last, part, rows))
        yield table(done, BLOCK_SCHEMA)

    return blocks


class Product:
    """What is known of a conversation after some of its blocks."""

    def __init__(self, conv_id):
        self.conv_id, self.settled, self.layer = conv_id, [], {START: (0, "")}
        self.counts, self.last, self.turns, self.low, self.high = [0, 0, 0, 0], None, 0, None, None

    def add(self, costs, audits, n, counts, first, last, turns, low, high) -> None:
        out: Layer = {}
        for start, (cost, audit) in self.layer.items():
            for end in range(4):
                if audits[4 * start + end] is not None:
                    found = (cost + costs[4 * start + end], audit + audits[4 * start + end])
                    if end not in out or found < out[end]:
                        out[end] = found
        self.settled.append(os.path.commonprefix([a for _, a in out.values()]))
        self.layer = {s: (c, a[len(self.settled[-1]) :]) for s, (c, a) in out.items()}
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]
        if n:
            self.counts[3] += self.last is not None and self.last + first not in LEGAL
            self.last = last
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = low if self.low is None else self.low, high

    def result(self) -> tuple:
        cost, audit = min(self.layer[s] for s in FINAL if s in self.layer)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, *self.counts, cost, "".join(self.settled) + audit, ""


@lean
def multiplied(batches):
    """REPAIRED, without the hash, of conversations whose blocks come in order."""
    at, names = None, ("conv_id", "costs", "audits", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high")
    for conv_id, costs, audits, n, blank, duplicate, truncated, illegal, *ends in streamed(batches, names):
        if at is None or conv_id != at.conv_id:
            if at is not None:
                yield table([at.result()], RESULT)
            at = Product(conv_id)
        at.add(costs, audits, n, (blank, duplicate, truncated, illegal), *ends)
    yield table([] if at is None else [at.result()], RESULT)


HASH_SCHEMA = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])


@lean
def hashed(batches):
    """conv_id, sha of conversations that stream past: first a row whose text is the audit, then the rows in order."""
    done: list[tuple] = []
    for conv_id, rows in groupby(streamed(batches, ("conv_id", "role", "text")), key=itemgetter(0)):
        digest, (_, _, audit) = Digest(), next(rows)
        for line in lines(audit, (r[1:] for r in rows)):
            digest.add(line)
        done.append((conv_id, digest.sha.hexdigest()))
        if len(done) >= 2048:
            yield table(done, HASH_SCHEMA)
            done = []
    yield table(done, HASH_SCHEMA)


ORDER = ("conv_id", "turn", "role", "text")


def by_blocks(rows: DataFrame, size: int) -> DataFrame:
    """REPAIRED of damaged rows of long conversations."""
    n = partitions(rows.sparkSession)
    digest = F.sha2(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.length("role").cast("string"), "role", "text"), 256)
    kept = rows.withColumn("digest", digest)
    # what is said more than once, and when first; counted before it is shuffled
    repeated = kept.where(~F.col("dropped")).groupBy("digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times")).where("times > 1").select("digest", "first")
    late = F.coalesce(F.struct("turn") > F.col("first"), F.lit(False)).alias("late")
    ordered = kept.join(repeated, "digest", "left").select("conv_id", "turn", "role", "text", "dropped", late)
    # the beginning of a text is enough to deal by, and no bound of a range gets long
    ordered = ordered.repartitionByRange(n, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(*ORDER)
    blocks = written(ordered.mapInArrow(blocks_of(size), BLOCK), "blocks")
    found = written(blocks.repartition(n, "conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(multiplied, REPAIRED), "repaired")
    head = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    body = rows.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    stream = head.unionByName(body).repartition(n, "conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "text")
    hashes = stream.mapInArrow(hashed, "id long, sha string")
    return found.join(hashes, found["conv_id"].eqNullSafe(hashes["id"])).select(*[c for c in found.columns if c != "repaired_sha256"], F.col("sha").alias("repaired_sha256"))


def repaired(rows: DataFrame, long_rows: int = LONG, long_bytes: int = LONG_BYTES) -> DataFrame:
    """REPAIRED of the damaged rows of all conversations."""
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"))
    long = written(sizes.where((F.col("n") > long_rows) | (F.col("b") > long_bytes)).select(F.col("conv_id").alias("long_id")), "long", narrow=True)
    number = long.count()
    listed = F.broadcast(long) if number <= BROADCAST_ROWS else long
    short = rows.join(listed, rows["conv_id"].eqNullSafe(listed["long_id"]), "left_anti") if number else rows
    n = partitions(rows.sparkSession)
    out = short.repartition(n, "conv_id").sortWithinPartitions(*ORDER).mapInArrow(repaired_short, REPAIRED)
    if number:
        out = out.unionByName(by_blocks(rows.join(listed, rows["conv_id"].eqNullSafe(listed["long_id"]), "left_semi"), long_rows))
    return out


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
