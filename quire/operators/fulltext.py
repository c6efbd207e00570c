"""A stored full-text index: built, appended to, replaced by work, and searched without reading the corpus.

An index is a folder of segments (see quire.sources.commits). A segment holds postings (field, term, key, work, tf, len), dealt by ranges
of term and key to as many files as the texts need, so that a frequent term has files of its own; the range of terms of each file, by which a
search names the files that it reads; what its works add to the statistics; and the works that it replaces in earlier segments. A commit names
the segments and has, by field, how many documents have it and their length in all. A segment that no commit names doesn't exist: a build that
was cut short goes on after the last key committed, and of two writers at a time one gets a Conflict. Once the newest segments
are several of about one size they are merged, and what was replaced among them goes.

Fields are the head and the content, and both again for each language that has an analyzer, from texts of that language. A
query's text holds no operators. Any field may match any term; scores are BM25 of each, heads count threefold, and add up.
Documents without content are not indexed."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.analyze import ENDINGS, analyzed
from quire.functions.frames import one_of
from quire.functions.language import FUNCTION_WORDS
from quire.functions.shared import scratch, written
from quire.sources.commits import Commits, Conflict

from .search import B, HEAD_BOOST, K1, top

#: Bytes of text whose postings one file holds, about; a smaller segment is spread over all tasks that run at once as long as each has LEAST_BYTES.
FILE_BYTES, LEAST_BYTES = 8 << 20, 1 << 20
#: Newest segments that are merged, at least, where the older is at most RATIO times as large as all newer ones.
MERGED, RATIO = 4, 2
#: Clauses (a term in a field) of a query at most; beyond them the first half of its words is searched.
CLAUSES = 1024
#: Files that a query names; beyond them their folder is read, and Parquet's own statistics choose.
FILES = 4096
RANGES = "file string, low string, high string, postings long"
POSTINGS = "field string, term string, key string, work string, tf long, len long, _seq long"
PARTS = {
    "postings": POSTINGS,
    "ranges": RANGES,
    "works": "work string, field string, n double, len long, _seq long",
    "replaced": "work string, _seq long",
}
LANGUAGES = tuple(sorted(ENDINGS))


def stem(lang: str):
    """The term that a folded word is in a language, or None (as analyzed() does it)."""
    stop, ending = frozenset(FUNCTION_WORDS.get(lang, "").split()), re.compile(rf"(.{{4,}}?)(?:{ENDINGS[lang]})")
    return lambda w: None if w in stop else m[1] if (m := ending.fullmatch(w)) else w


def counted(languages: tuple[str, ...]):
    """Rows (key, work, lang, content, head), words of which the last two are, in order of key -> postings. Rows that agree in key, work and length are one document."""
    stems = {x: stem(x) for x in languages if x in ENDINGS}

    def of(field: str, t: pa.Table, row: np.ndarray, code: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
        long = np.bincount(row, minlength=t.num_rows)
        group: dict[tuple, int] = {}
        own = np.array([group.setdefault(x, i) for i, x in enumerate(zip(t.column("key").to_pylist(), t.column("work").to_pylist(), long.tolist(), strict=True))], np.int64)
        found, n = np.unique(own[row] * len(terms) + code, return_counts=True)
        at, term = np.divmod(found, max(1, len(terms)))
        columns = [pa.array([field] * len(found), pa.string()), terms.take(pa.array(term)), *(t.column(c).combine_chunks().take(pa.array(at)) for c in ("key", "work")), pa.array(n), pa.array(long[at])]
        return pa.RecordBatch.from_arrays(columns, ["field", "term", "key", "work", "tf", "len"])

    def fields(t: pa.Table) -> Iterator[pa.RecordBatch]:
        langs = np.array(t.column("lang").to_pylist(), object)
        for f in ("content", "head"):
            lists = t.column(f).combine_chunks()
            words = lists.flatten().dictionary_encode()
            row, code = np.repeat(np.arange(t.num_rows), lists.value_lengths().to_numpy()), words.indices.to_numpy()
            yield of(f, t, row, code, words.dictionary)
            for lang, to in stems.items():
                mine = (langs == lang)[row]
                if mine.any():
                    cut = pa.array([to(w) for w in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
                    new = cut.indices.fill_null(-1).to_numpy()[code]
                    mine &= new >= 0
                    yield of(f"{f}_{lang}", t, row[mine], new[mine], cut.dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
            keys = t.column("key").to_pylist()
            at = next((i for i in range(len(keys) - 1, 0, -1) if keys[i - 1] != keys[-1]), 0)  # the last key may go on
            held = t.slice(at)
            if at:
                yield from fields(t.slice(0, at))
        if held is not None:
            yield from fields(held)

    return run


def postings(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, tasks: int | None = None) -> DataFrame:
    """field, term, key, work, tf, len of documents (key, work, lang, head, content), dealt by key to so many tasks. A text is folded once, whatever fields come from it, and counted where it is."""
    held = docs.where(F.trim(F.coalesce("content", F.lit(""))) != "").select("key", "work", "lang", "head", "content")
    dealt = (held.repartition("key") if tasks is None else held.repartition(tasks, "key")).sortWithinPartitions("key")
    split = dealt.select("key", "work", "lang", T.tokens(F.col("content")).alias("content"), T.tokens(F.coalesce("head", F.lit(""))).alias("head"))
    return split.mapInArrow(counted(languages), "field string, term string, key string, work string, tf long, len long")


def ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, term) -> RANGES of each batch. (Spark would sort all rows by file for the least and greatest of strings.)"""
    for b in batches:
        files = b.column(0).dictionary_encode()
        for i, name in enumerate(files.dictionary.to_pylist()):
            own = b.column(1).filter(pc.equal(files.indices, i))
            ends = pc.min_max(own).as_py()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([ends["min"]]), pa.array([ends["max"]]), pa.array([len(own)])], ["file", "low", "high", "postings"])


class Index:
    """The index in a folder that all machines share."""

    def __init__(self, spark: SparkSession, path: str, languages: tuple[str, ...] = LANGUAGES):
        self.spark, self.path, self.languages = spark, path.rstrip("/"), languages
        self.log = Commits(spark, self.path)

    def commits(self) -> list[dict]:
        """The state of each version: seq, last_key, complete, stats, segments."""
        return [self.log.state(v) for v in self.log.versions()]

    def _state(self) -> tuple[int, dict]:
        version, state = self.log.head()
        return version, state or {"seq": 0, "last_key": None, "complete": False, "stats": {}, "segments": {}}

    def _read(self, part: str, segments: dict, paths: list[str] | None = None) -> DataFrame:
        at = [self.log.data("segments", s, part) for s, info in segments.items() if part in info["parts"]] if paths is None else paths
        return self.spark.read.schema(PARTS[part]).parquet(*at) if at else self.spark.createDataFrame([], PARTS[part])

    def _live(self, part: str, segments: dict, rows: DataFrame | None = None) -> DataFrame:
        """Rows of segments that no later one of them replaces."""
        rows = self._read(part, segments) if rows is None else rows
        if len(segments) < 2 or not any("replaced" in i["parts"] for i in segments.values()):
            return rows
        later = self._read("replaced", segments).groupBy(F.col("work").alias("_w")).agg(F.max("_seq").alias("_s"))
        return rows.join(later, (rows["work"] == later["_w"]) & (rows["_seq"] < later["_s"]), "left_anti")

    def live(self) -> DataFrame:
        """All postings that count."""
        return self._live("postings", self._state()[1]["segments"]).drop("_seq")

    def _files(self, size: int) -> int:
        """How many files the postings of so many bytes of text are dealt to, and tasks before them the texts: no task waits for a last few."""
        at_once = self.spark.sparkContext.defaultParallelism
        n = -(-size // FILE_BYTES)
        return -(-n // at_once) * at_once if n > at_once else max(1, n, min(at_once, -(-size // LEAST_BYTES)))

    def _write(self, seg: str, seq: int, rows: DataFrame, size: int, info: dict) -> None:
        """postings, their files' ranges and their works' statistics. size: bytes of text that they come from."""
        at, n = self.log.data("segments", seg, "postings"), self._files(size)
        rows = rows.withColumn("_seq", F.lit(seq).cast("long")).select(*[x.split()[0] for x in POSTINGS.split(", ")])
        rows.repartitionByRange(n, "term", "field", "key").sortWithinPartitions("term").write.parquet(at)
        back = self._read("postings", {}, [at])
        ranges = back.select(F.col("_metadata.file_path").alias("file"), "term").mapInArrow(ranges_of, RANGES).groupBy("file").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("postings").alias("postings"))
        ranges.repartitionByRange("low").sortWithinPartitions("low").write.parquet(self.log.data("segments", seg, "ranges"))
        # tf / len of a document's postings add up to 1 in a field
        works = back.groupBy("work", "field").agg(F.sum(F.col("tf") / F.col("len")).alias("n"), F.sum("tf").alias("len")).withColumn("_seq", F.lit(seq).cast("long"))
        works.write.parquet(self.log.data("segments", seg, "works"))
        info["parts"] += ["postings", "ranges", "works"]
        info["rows"] += self._read("ranges", {}, [self.log.data("segments", seg, "ranges")]).agg(F.sum("postings")).first()[0] or 0

    @staticmethod
    def _totals(works: DataFrame) -> dict:
        """By field: documents, and their length in all."""
        return {r["field"]: (round(r["n"]), r["len"]) for r in works.groupBy("field").agg(F.sum("n").alias("n"), F.sum("len").alias("len")).collect()}  # a row a field

    def _commit(self, docs: DataFrame | None, works: DataFrame | None, last_key: str | None, complete: bool) -> None:
        version, state = self._state()
        seq, seg, info = state["seq"] + 1, self.log.new_segment(), {"seq": state["seq"] + 1, "parts": [], "rows": 0}
        change: dict = {}
        if docs is not None:
            sizes = docs.agg(F.sum(F.octet_length(F.coalesce("content", F.lit("")))), F.sum(F.octet_length(F.coalesce("head", F.lit(""))))).first()
            size = sum(x or 0 for x in sizes)
            with scratch(self.spark):
                # a task counts FILE_BYTES of text, however large the input; the sort by ranges looks at its rows twice, so they are written first
                rows = written(postings(docs, self.languages, self._files(size)), "postings")
                self._write(seg, seq, rows, size, info)
            change = self._totals(self._read("works", {seg: info}))
        if works is not None:
            at = self.log.data("segments", seg, "replaced")
            works.select("work").distinct().withColumn("_seq", F.lit(seq).cast("long")).write.parquet(at)
            info["parts"].append("replaced")
            gone = self._live("works", state["segments"]).join(self._read("replaced", {}, [at]).select("work"), "work", "left_semi")
            less = self._totals(gone)
            change = {k: (change.get(k, (0, 0))[0] - less.get(k, (0, 0))[0], change.get(k, (0, 0))[1] - less.get(k, (0, 0))[1]) for k in {*change, *less}}
        before = state["stats"]
        stats = {k: [a + b for a, b in zip(before.get(k, (0, 0)), change.get(k, (0, 0)), strict=True)] for k in {*before, *change}}
        self.log.commit(version, {"seq": seq, "last_key": last_key, "complete": complete, "stats": stats, "segments": {**state["segments"], seg: info}})
        self._merge_newest()

    def _merge_newest(self) -> None:
        segments = self._state()[1]["segments"]
        newest = sorted(segments, key=lambda s: -segments[s]["seq"])
        chosen, size = newest[:1], segments[newest[0]]["rows"]
        for s in newest[1:]:
            if segments[s]["rows"] > RATIO * max(1, size):
                break
            chosen.append(s)
            size += segments[s]["rows"]
        if len(chosen) >= MERGED:
            try:
                self.merge(len(chosen))
            except Conflict:  # the next commit does it
                return

    def merge(self, newest: int | None = None) -> int:
        """Makes one segment of the newest (all), of the postings that count. Gives the version."""
        version, state = self._state()
        segments = state["segments"]
        chosen = sorted(segments, key=lambda s: -segments[s]["seq"])[:newest]
        if len(chosen) < 2:
            return version
        part, seg = {s: segments[s] for s in chosen}, self.log.new_segment()
        seq = max(i["seq"] for i in part.values())
        info = {"seq": seq, "parts": [], "rows": 0}
        files = self._read("ranges", part).count()  # each holds FILE_BYTES of text, about
        self._write(seg, seq, self._live("postings", part).drop("_seq"), files * FILE_BYTES, info)
        if len(chosen) < len(segments):
            self._read("replaced", part).select("work").distinct().withColumn("_seq", F.lit(seq).cast("long")).write.parquet(self.log.data("segments", seg, "replaced"))
            info["parts"].append("replaced")
        return self.log.commit(version, {**state, "segments": {**{s: i for s, i in segments.items() if s not in part}, seg: info}})

    def vacuum(self, keep: int = 1, least_age_s: float = 3600) -> list[str]:
        return self.log.vacuum(keep, least_age_s)

    def build(self, docs: DataFrame, lots: int = 1) -> Index:
        """Indexes docs (key, work, lang, head, content) in lots of keys, each a commit; goes on where an earlier build stopped."""
        version, state = self._state()
        if state["complete"]:
            return self
        ends = [*(self._ends(docs, lots) if lots > 1 else []), None]
        last = state["last_key"]
        for end in ends:
            if end is not None and last is not None and end <= last:
                continue
            own = docs if last is None else docs.where(F.col("key") > last)
            self._commit(own if end is None else own.where(F.col("key") <= end), None, end, end is None)
            last = end
        return self

    def _ends(self, docs: DataFrame, lots: int) -> list[str]:
        """Keys that part docs in lots: of the range partitions of a sort, the largest keys."""
        parts = docs.select("key").repartitionByRange(lots, "key").groupBy(F.spark_partition_id()).agg(F.max("key").alias("m"))
        return sorted(r["m"] for r in parts.collect())[:-1]  # a row a lot

    def replace(self, docs: DataFrame, works: DataFrame | None = None) -> Index:
        """docs in the place of all that is indexed of their works (and of works, which may have no document now)."""
        own = docs.select("work")
        self._commit(docs, own if works is None else own.unionAll(works.select("work")), None, True)
        return self

    def remove(self, works: DataFrame) -> Index:
        self._commit(None, works, None, True)
        return self

    def clauses(self, q: str) -> list[tuple[str, str, float]]:
        """field, term, boost of what a query asks; of a query with too many clauses, that of the first half of its words, and so on."""
        words = q.split()
        while words:
            text = F.lit(" ".join(words))
            terms = {"": T.tokens(text)} | {f"_{x}": analyzed(text, x) for x in self.languages}
            row = self.spark.range(1).select(*(c.alias(f"t{k}") for k, c in terms.items())).first()
            found = [(f + k, t, boost) for k in terms for t in dict.fromkeys(row[f"t{k}"]) for f, boost in (("content", 1.0), ("head", HEAD_BOOST))]
            if len(found) <= CLAUSES:
                return found
            words = words[: len(words) // 2]
        return []

    def hits(self, clauses: list[tuple[str, str, float]]) -> DataFrame:
        """Postings of clauses that count, from the files whose terms may be among them."""
        segments, terms = self._state()[1]["segments"], sorted({t for _, t, _ in clauses})
        where = one_of(F.col("term"), terms)
        within = F.exists(F.array(*map(F.lit, terms)), lambda t: (F.col("low") <= t) & (t <= F.col("high"))) if terms else F.lit(False)
        files = [r["file"] for r in self._read("ranges", segments).where(within).select("file").limit(FILES + 1).collect()]
        rows = self._read("postings", segments, files if 0 < len(files) <= FILES else None) if files else self._read("postings", {})
        return self._live("postings", segments, rows.where(where))

    def scores(self, q: str) -> DataFrame:
        """key, work, score of the documents that hold any clause."""
        asked = self.clauses(q)
        wanted = self.spark.createDataFrame(asked, "field string, term string, boost double")
        stats = self._state()[1]["stats"]
        of = self.spark.createDataFrame([(k, n, size / max(1, n)) for k, (n, size) in stats.items()], "field string, n long, mean double")
        hits = self.hits(asked).join(F.broadcast(wanted), ["field", "term"])  # CLAUSES rows at most
        # a document's postings go together; both uses below share this exchange, so the index is read once
        per = hits.groupBy("key", "work").agg(F.collect_list(F.struct("field", "term", "tf", "len", "boost")).alias("c")).select("key", "work", F.explode("c").alias("c"))
        df = per.groupBy(F.col("c.field").alias("field"), F.col("c.term").alias("term")).agg(F.count("*").alias("df"))
        rows = per.select("key", "work", "c.*").join(F.broadcast(df), ["field", "term"]).join(F.broadcast(of), "field")  # rows of both: clauses and fields at most
        idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        own = F.col("boost") * idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
        return rows.groupBy("key", "work").agg(F.sum(own).alias("score"))

    def search(self, q: str, k: int, where: Column | None = None) -> DataFrame:
        """The k best; where (of key and work) filters without scoring."""
        found = self.scores(q)
        return top(found if where is None else found.where(where), "score", "key", k)
