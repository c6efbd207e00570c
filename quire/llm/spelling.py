"""Operator 11, spelling variant grouping: words of a corpus that are one code point apart, and the frequent form of each.

Method: rare-first prefix filter over positional bigrams. All bigrams of the vocabulary are put into one order, by the
number of words they are in; a word is looked up by its three rarest alone. An edit destroys two bigrams at most, and three
is one more, so two words that are one edit apart share one of their rarest three, moved by one position at most. Such
a shared bigram also says that the text on one side of it is the same in both words, and of the text on the other
side either the front or the back half: the join is on the bigram, its position, the lengths and these parts (as one hash), so that its
rows are few beside all pairs of a bigram's words. Pairs found are verified by edit distance, so a hash that collides
adds nothing.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z in lower case; crc32 of '<doc_id>:<run>' says which
runs of which documents are misspelt first (see misspelt). Documents are counted in workers, whole texts a MiB at a time; words of fewer than FEWEST occurrences or SHORTEST
code points are no words. Bigrams are at most the square of 90 letters, so their order is known to each worker.

Null texts have no words; a null doc_id reads as the empty string. Rows are counted as they come, repeated ones too. Empty tables, and words that
no other is near to, are no special case: form is null, root is the word. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import PIECE, lean, written

SHORTEST = 5
FEWEST = 3
#: A form is this many times as frequent as its variants.
TIMES = 2
#: One run in so many is misspelt by the query.
ONE_IN = 97
#: Bigrams that an edit destroys, and one.
RAREST = 3
#: Different words that a worker counts before it sends them on.
HELD = 1 << 17
RUN = re.compile("[a-zÀ-ÿ]+")
BREAK = re.compile("[^A-Za-zÀ-ÿ]")

SQL = """
WITH RECURSIVE bits(v, c, k) AS (SELECT v, v, 0 FROM range(256) t(v) UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
own AS (SELECT doc_id, w, count(*) AS n FROM runs WHERE length(w) >= 5 GROUP BY ALL),
bytes AS (SELECT doc_id, w, n, list_concat([4294967295::BIGINT], list_transform(range(1, 2 * strlen(k) + 1, 2), lambda i: ('0x' || substr(hex(encode(k)), i, 2))::BIGINT)) AS b FROM (SELECT *, coalesce(doc_id::VARCHAR, '') || ':' || w AS k FROM own)),
hashed AS (SELECT w, n, xor(list_reduce(b, lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) AS h FROM bytes, crc),
misspelt AS (SELECT CASE WHEN h % 97 = 0 THEN w[: h % length(w)] || w[h % length(w) + 2 :] ELSE w END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM misspelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, word[: i] || word[i + 2 :] AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
 UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.d = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.d = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS o, arg_min(m, (-m, other)) AS m, any_value(n) AS n FROM near GROUP BY word),
forms AS (SELECT word, n_near, CASE WHEN m >= 2 * n THEN o END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM best),
walk(word, last, k) AS (SELECT word, form, 1 FROM forms WHERE form IS NOT NULL UNION ALL SELECT w.word, f.form, k + 1 FROM walk w JOIN forms f ON f.word = w.last WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(last, k) AS root FROM walk GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM words LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""


def pieces(text: str):
    """text in pieces of some PIECE code points that end where no run does go on."""
    at = 0
    while at < len(text):
        end = BREAK.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def runs_of(text: str) -> Counter:
    found = Counter()
    for piece in pieces(text):
        found.update(RUN.findall(piece.encode().lower().decode()))  # of bytes, lower() changes A-Z alone
    return found


def misspelt(run: str, start: int) -> str:
    """run, or where ONE_IN divides its crc32 (which goes on from that of what stands before it) run without the code point that the crc32 names."""
    h = zlib.crc32(run.encode(), start)
    if h % ONE_IN:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


@lean
def counted(batches):
    """word, n of the documents of a task: a word comes several times where there are more than HELD."""
    total: Counter = Counter()

    def flush():
        words, numbers = list(total), list(total.values())
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], ["word", "n"])

    for batch in batches:
        for doc_id, text in zip(*(batch.column(i) for i in range(2)), strict=True):
            start = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
            for run, n in runs_of(text.as_py() or "").items():
                if len(run) >= SHORTEST:
                    word = misspelt(run, start)
                    if len(word) >= SHORTEST:
                        total[word] += n
            if len(total) > HELD:
                yield flush()
    yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words of whole texts, with those that the query misspells."""
    found = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(counted, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= FEWEST)


def rarest(words: DataFrame) -> DataFrame:
    """word, n, len, p: the start (from 0) of each of the three rarest bigrams of a word."""
    gram = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.col("word").substr(i, F.lit(2))))
    order = {r["g"]: i for i, r in enumerate(words.select(gram.alias("g")).groupBy("g").count().orderBy("count", "g").toLocalIterator())}

    def chosen(batches):
        for batch in batches:
            at = []
            for word in batch.column(0).to_pylist():
                ranks = [order[word[i : i + 2]] for i in range(len(word) - 1)]
                at.append(sorted(range(len(ranks)), key=lambda i: (ranks[i], i))[:RAREST])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.list_(pa.int32()))], ["word", "n", "p"])

    found = words.select("word", "n").mapInArrow(chosen, "word string, n long, p array<int>")
    return found.select("word", "n", F.length("word").alias("len"), F.explode("p").alias("p"))


def _keys(longer: bool) -> Column:
    """What a word shares with another if the edit is after, or before, the bigram at p: an array of hashes.

    The text on the near side of the bigram, the bigram included, is the same in both words. Of the far side, of m code points in the
    shorter word, the edit leaves the first half (h code points) or the rest. longer: the word is the longer of the two, by one."""
    word, p, more = F.col("word"), F.col("p"), int(longer)
    length = F.col("len") - more  # of the shorter word
    m_after, m_before = F.col("len") - p - 2 - more, p - more
    out = []
    for side, m, kept, far, place in (("a", m_after, word.substr(F.lit(1), p + 2), p + 2, p), ("b", m_before, word.substr(p + 1, F.col("len")), F.lit(0), F.col("len") - p)):
        h = F.floor(m / 2).cast("int")
        front, back = word.substr(far + 1, h), word.substr(far + 1 + h + more, m - h)
        for half, part in (("f", front), ("r", back)):
            out.append(F.when(m >= 0, F.xxhash64(F.lit(side + half), length, place, kept, part)))
    return F.array_compact(F.array(*out))


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, m: each pair of words one edit apart, once."""
    grams = rarest(words)
    base = grams.select(F.explode(_keys(False)).alias("key"), F.col("word").alias("other"), F.col("n").alias("m"))
    probe = grams.select("word", "n", F.explode(_keys(True)).alias("key")).withColumn("same", F.lit(False))
    probe = probe.unionByName(grams.select("word", "n", F.explode(_keys(False)).alias("key")).withColumn("same", F.lit(True)))
    # Spark takes the compressed words for the size of their keys, of which there are a dozen a word: without the hints it broadcasts them
    found = probe.join(base.hint("merge"), "key").where((~F.col("same") | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1))
    return found.select("word", "n", "other", "m").distinct()


def followed(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow from a word, for words that have one. Steps double with each round; counts double with
    each step, so there are six rounds at most."""
    at = written(forms.select("word", F.col("form").alias("root")), "forms", narrow=True)
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(at.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms", narrow=True)
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            return at


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs: see the module."""
    words = written(vocabulary(docs), "words", narrow=True)
    pairs = near_pairs(words)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))
    best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("b"))
    frequent = -F.col("b.less") >= TIMES * F.col("n")
    near = written(best.select("word", "n_near", F.when(frequent, F.col("b.other")).alias("form"), F.when(frequent, -F.col("b.less")).alias("form_n")), "near", narrow=True)
    roots = followed(near.where("form is not null"))
    out = words.join(near.hint("merge"), "word", "left").join(roots.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))
