"""Collections of vectors in a folder that all machines share: inverted lists and codes of 8 bits a component, on disk.

An upsert writes a segment: rows (key, ..., embedding, list) sorted by list and key; codes, in blocks of up to BLOCK vectors of a list, each
a row; and the keys of earlier segments that it replaces. The lists' centres come from a bounded sample of the first upsert. A search reads
the codes of the lists nearest to the query, takes OVERSAMPLING times as many candidates as asked for, and reads these alone by their list and key.
Versions are commits (see commits.py): two upserts at a time can't both be made. Small segments are merged when there are more than
SEGMENTS of a size, and what a segment replaces is merged away with it.

metric: euclidean, cosine (one minus it; codes are of unit vectors) or dot (less its negative). Rows with a null key or vector are not stored;
of several rows with one key the one of the largest seq is, of equal ones any."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.frames import one_of
from quire.functions.shared import written
from quire.operators import vectors as V

from .commits import Commits

BLOCK = 4096
OVERSAMPLING = 3
#: Vectors of a list that an automatic number of lists aims at, and such lists at most.
LIST_ROWS, MOST_LISTS = 1024, 8192
#: Segments of about a size (within a factor of TIER) from which they are merged.
SEGMENTS, TIER = 4, 8
#: Components of rows that a task assigns to lists at a time.
SLICE = 1 << 18
METRICS = ("euclidean", "cosine", "dot")
BLOCKS = "list int, n int, keys array<string>, codes binary, steps binary"


def unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A column of arrays of numbers, none null, as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, size)


def coded(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes and the step of each row: its largest component over 127."""
    step = np.abs(m).max(1, initial=0) / 127
    step = np.where(step > 0, step, 1.0)
    return np.round(m / step[:, None]).astype(np.int8), step.astype(np.float32)


def near(metric: str, q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of rows of q (queries) and v, smaller is nearer; those of unit vectors for cosine."""
    product = q @ v.T
    if metric == "dot":
        return -product
    if metric == "cosine":
        return 1 - product
    return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * product, 0))


def exact(metric: str, a: Column, b: Column) -> Column:
    return {"euclidean": T.l2, "cosine": lambda x, y: 1 - T.cosine(x, y), "dot": lambda x, y: -T.dot(x, y)}[metric](a, b)


def assigned(centre: np.ndarray, metric: str, probes: int, column: str = "embedding"):
    """A function of batches that adds list, or a row for each of the nearest `probes` lists."""

    def run(batches: Iterator[pa.RecordBatch]):
        size = centre.shape[1]
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, SLICE // size)):
                part = batch.slice(at, max(1, SLICE // size))
                own = matrix(part.column(part.schema.get_field_index(column)), size)
                far = near("euclidean", unit(own) if metric == "cosine" else own, centre)
                best = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
                out = part.take(pa.array(np.repeat(np.arange(len(own)), best.shape[1])))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(best.ravel())], [*out.schema.names, "list"])

    return run


def packed(size: int, metric: str, key: str):
    """A function of batches of rows in order of list: codes of up to BLOCK rows of a list as one row."""

    def block(number: int, keys: list, parts: list[np.ndarray]):
        m = np.concatenate(parts)
        codes, steps = coded(unit(m) if metric == "cosine" else m)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([len(keys)], pa.int32()), pa.array([keys], pa.list_(pa.string())), pa.array([codes.tobytes()]), pa.array([steps.tobytes()])], ["list", "n", "keys", "codes", "steps"])

    def run(batches: Iterator[pa.RecordBatch]):
        at, keys, parts = None, [], []
        for batch in batches:
            lists, names, own = batch.column("list").to_numpy(), batch.column(key), matrix(batch.column("embedding"), size)
            cuts = [0, *(np.flatnonzero(np.diff(lists)) + 1).tolist(), len(lists)] if len(lists) else [0]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    if keys and (lists[a] != at or len(keys) >= BLOCK):
                        yield block(at, keys, parts)
                        keys, parts = [], []
                    at, take = int(lists[a]), min(b - a, BLOCK - len(keys))
                    keys += names.slice(a, take).to_pylist()
                    parts.append(own[a : a + take])
                    a += take
        if keys:
            yield block(at, keys, parts)

    return run


FOUND = "query string, key string, seg string, list int, near double"


def candidates(size: int, metric: str, k: int):
    """A function of batches of (seg, block of codes, gone: its keys that are replaced, block of queries): of each query the k nearest by code that aren't replaced."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in batch.schema.names}
                seg, number = row["seg"].as_py(), row["list"].as_py()
                steps = np.frombuffer(row["steps"].as_buffer(), np.float32)
                codes = np.frombuffer(row["codes"].as_buffer(), np.int8).reshape(len(steps), size) * steps[:, None].astype(np.float64)
                asked = np.frombuffer(row["q"].as_buffer(), np.float64).reshape(-1, size)
                far = np.round(near(metric, asked, codes), 9)
                keys = np.array(row["keys"].as_py(), object)
                if row["gone"].as_py():
                    here = ~np.isin(keys.astype(str), row["gone"].as_py())
                    far, keys = far[:, here], keys[here]
                take = min(k, len(keys))
                if not take:
                    continue
                part = np.argpartition(far, take - 1, axis=1)[:, :take] if take < len(keys) else np.tile(np.arange(take), (len(asked), 1))
                n = part.size
                names = np.repeat(np.array(row["queries"].as_py(), object), take)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(keys[part.ravel()], pa.string()), pa.array([seg] * n), pa.array(np.full(n, number, np.int32)), pa.array(np.take_along_axis(far, part, 1).ravel())], ["query", "key", "seg", "list", "near"])

    return run


def pack_queries(t: pa.Table) -> pa.Table:
    v = np.array(t.column("q").to_pylist(), np.float64)
    return pa.table([pa.array([t.column("list")[0].as_py()], pa.int32()), pa.array([t.column("query").to_pylist()], pa.list_(pa.string())), pa.array([v.tobytes()])], ["list", "queries", "q"])


class Collections:
    """Named collections: parameters and segments of each are in its commits."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self, name: str) -> Commits:
        return Commits(self.spark, f"{self.path}/{name}")

    def names(self) -> list[str]:
        top = Commits(self.spark, self.path)
        fs, at = top._fs(), top._at()
        found = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in found if self._log(n).versions())

    def create(self, name: str, size: int, metric: str = "euclidean", quantised: bool = True, lists: int | None = None) -> None:
        """lists: their number; None: by the rows of the first upsert. Not quantised: candidates come from the vectors themselves."""
        if metric not in METRICS:
            raise ValueError(f"metrics are {', '.join(METRICS)}")
        log = self._log(name)
        if log.versions():
            raise ValueError(f"there is a collection {name}")
        log.commit(0, {"name": name, "size": size, "metric": metric, "quantised": quantised, "lists": lists, "segments": {}})

    def parameters(self, name: str) -> dict:
        state = self._state(name)[1]
        return {k: state[k] for k in ("name", "size", "metric", "quantised", "lists")}

    def _state(self, name: str) -> tuple[int, dict]:
        version, state = self._log(name).head()
        if not version:
            raise ValueError(f"no collection {name}")
        return version, state

    def drop(self, name: str) -> None:
        log = self._log(name)
        log._fs().delete(log._at(), True)

    def _segments(self, log: Commits, state: dict, part: str, segments: list[str] | None = None) -> DataFrame | None:
        """Rows of a part of segments, with seg."""
        names = list(state["segments"]) if segments is None else segments
        parts = [self.spark.read.parquet(log.data("segments", s, part)).withColumn("seg", F.lit(s)) for s in names if part != "dead" or state["segments"][s]["dead"]]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _live(self, log: Commits, state: dict, part: str = "rows", segments: list[str] | None = None) -> DataFrame | None:
        rows, dead = self._segments(log, state, part, segments), self._segments(log, state, "dead")
        if rows is None or dead is None:
            return rows
        gone = dead.select(F.col("key").alias("_key"), F.col("of").alias("_of"))
        return rows.join(gone, (rows[state["key"]] == gone["_key"]) & (rows["seg"] == gone["_of"]), "left_anti")

    def read(self, name: str) -> DataFrame | None:
        """The rows that no later upsert replaced; None before the first."""
        _, state = self._state(name)
        rows = self._live(self._log(name), state)
        return None if rows is None else rows.drop("seg", "list")

    def by_key(self, name: str, keys: list[str]) -> DataFrame:
        """The rows of some keys: files are sorted by list and key, and their statistics tell which parts may hold them."""
        _, state = self._state(name)
        rows = self._segments(self._log(name), state, "rows").where(one_of(F.col(state["key"]), keys))
        dead = self._segments(self._log(name), state, "dead")
        if dead is not None:
            gone = dead.where(one_of(F.col("key"), keys)).select(F.col("key").alias("_key"), F.col("of").alias("_of"))
            rows = rows.join(gone, (rows[state["key"]] == gone["_key"]) & (rows["seg"] == gone["_of"]), "left_anti")
        return rows.drop("seg", "list")

    def _centres(self, log: Commits, state: dict) -> np.ndarray:
        rows = self.spark.read.parquet(log.data("segments", state["centres"], "centres")).orderBy("list").collect()  # MOST_LISTS at most
        return np.array([r["centre"] for r in rows], np.float64).reshape(len(rows), state["size"])

    def upsert(self, name: str, new: DataFrame, key: str = "sha256") -> int:
        """new (key, ..., embedding, seq) in the place of rows with their key: a segment of its own. Gives the version; Conflict if another upsert was first."""
        version, state = self._state(name)
        log, size, metric = self._log(name), state["size"], state["metric"]
        held = new.where(F.col(key).isNotNull() & F.col("embedding").isNotNull())
        if not held.where((F.size("embedding") != size) | F.exists("embedding", lambda x: x.isNull())).isEmpty():
            raise ValueError(f"vectors of {name} have {size} components")
        last = Window.partitionBy(key).orderBy(F.desc("seq"))
        own = held.withColumn(key, F.col(key).cast("string")).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "seq")
        seg, added = log.new_segment(), {}
        if "centres" not in state:
            rows = own.count()
            lists = state["lists"] if state["lists"] is not None else min(MOST_LISTS, rows // LIST_ROWS)
            sample = own.select("embedding" if metric != "cosine" else self._unit().alias("embedding"))
            centre = V.centres(sample, lists) if lists > 1 and rows else np.zeros((1, size))
            points = [(i, c.tolist()) for i, c in enumerate(centre)]
            self.spark.createDataFrame(points, "list int, centre array<double>").coalesce(1).write.parquet(log.data("segments", seg, "centres"))
            added = {"centres": seg, "key": key}
        elif state["key"] != key:
            raise ValueError(f"the key of {name} is {state['key']}")
        state = {**state, **added}
        info = self._write(log, state, seg, own.mapInArrow(assigned(self._centres(log, state), metric, 1), own.withColumn("list", F.lit(0)).schema))
        info["dead"] = 0
        before = self._live(log, state)
        if before is not None:
            mine = self.spark.read.parquet(log.data("segments", seg, "rows")).select(key)
            gone = before.select(key, "seg", "list").join(mine, key, "left_semi").select(F.col(key).alias("key"), F.col("seg").alias("of"), "list")
            gone.write.parquet(log.data("segments", seg, "dead"))
            info["dead"] = self.spark.read.parquet(log.data("segments", seg, "dead")).count()
        made = log.commit(version, {**state, "segments": {**state["segments"], seg: info}})
        self._merge(name)
        return made

    @staticmethod
    def _unit() -> Column:
        size = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
        return F.transform("embedding", lambda x: x / F.when(size > 0, size).otherwise(1.0))

    def _write(self, log: Commits, state: dict, seg: str, rows: DataFrame) -> dict:
        """rows (with list) as the rows and codes of a segment."""
        key, at = state["key"], log.data("segments", seg, "rows")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartitionByRange(n, "list", key).sortWithinPartitions("list", key).write.parquet(at)
        back = self.spark.read.parquet(at)
        if state["quantised"]:
            # a file is in order; the codes of a task are those of the files that it reads
            back.select(key, "list", "embedding").mapInArrow(packed(state["size"], state["metric"], key), BLOCKS).write.parquet(log.data("segments", seg, "codes"))
        return {"rows": back.count()}

    def _merge(self, name: str) -> None:
        """Merges segments of about one size where there are more than SEGMENTS of them; a Conflict leaves it to the next upsert."""
        from .commits import Conflict

        version, state = self._state(name)
        tiers: dict[int, list[str]] = {}
        for s, info in state["segments"].items():
            tiers.setdefault(int(np.log(max(1, info["rows"])) / np.log(TIER)), []).append(s)
        chosen = next((t for _, t in sorted(tiers.items()) if len(t) > SEGMENTS), None)
        if chosen:
            try:
                self.merge(name, chosen)
            except Conflict:
                return

    def merge(self, name: str, segments: list[str] | None = None) -> int:
        """Makes one of some segments (all): what later ones replace goes, as do their notes of it where the older segment is among them."""
        version, state = self._state(name)
        log, chosen = self._log(name), list(state["segments"]) if segments is None else segments
        seg = log.new_segment()
        rows = self._live(log, state, segments=chosen)
        if rows is None:
            return version
        info = self._write(log, state, seg, rows.drop("seg"))
        dead = self._segments(log, state, "dead")
        info["dead"] = 0
        if dead is not None:
            rest = dead.where(F.col("seg").isin(chosen) & ~F.col("of").isin(chosen)).select("key", "of", "list")
            rest.write.parquet(log.data("segments", seg, "dead"))
            info["dead"] = self.spark.read.parquet(log.data("segments", seg, "dead")).count()
        kept = {s: i for s, i in state["segments"].items() if s not in chosen}
        if state["centres"] in chosen:  # they move with the segment that holds them
            self.spark.read.parquet(log.data("segments", state["centres"], "centres")).coalesce(1).write.parquet(log.data("segments", seg, "centres"))
            state = {**state, "centres": seg}
        return log.commit(version, {**state, "segments": {**kept, seg: info}})

    def vacuum(self, name: str, keep: int = 1, least_age_s: float = 3600) -> list[str]:
        return self._log(name).vacuum(keep, least_age_s)

    def _candidates(self, log: Commits, state: dict, queries: DataFrame, k: int, probes: int | None) -> DataFrame:
        """query, key, seg, list, near of (query, q): k nearest by code and more."""
        size, metric, centre = state["size"], state["metric"], self._centres(log, state)
        asked = queries.select(F.col("query").cast("string").alias("query"), F.col("q").cast("array<double>").alias("q"))
        probes = len(centre) if probes is None else min(probes, len(centre))
        listed = asked.mapInArrow(assigned(centre, metric, probes, "q"), "query string, q array<double>, list int")
        if metric == "cosine":
            listed = listed.withColumn("q", F.transform("q", lambda x: x / F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, y: s + y * y))))
        blocks = max(1, -(-queries.count() // BLOCK))
        listed = written(listed.groupBy("list", F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("b")).applyInArrow(pack_queries, "list int, queries array<string>, q binary"), "asked")
        lists = sorted(r[0] for r in listed.select("list").distinct().collect())  # MOST_LISTS at most
        if state["quantised"]:
            codes = self._segments(log, state, "codes")
        else:
            rows = self._segments(log, state, "rows")
            codes = rows.select(F.col(state["key"]).alias("key"), "list", "embedding", "seg")
        codes = codes if len(lists) == len(centre) else codes.where(one_of(F.col("list"), lists))
        dead = self._segments(log, state, "dead")
        if state["quantised"]:
            # what is replaced never is a candidate: of each block its keys that are (BLOCK at most) go with it; a block's first key is its own
            codes = codes.withColumn("block", F.element_at("keys", 1))
            if dead is None:
                codes = codes.withColumn("gone", F.array().cast("array<string>"))
            else:
                held = codes.select("seg", "block", F.explode("keys").alias("key"))
                gone = held.join(dead.select(F.col("of").alias("seg"), "key"), ["seg", "key"], "left_semi").groupBy("seg", "block").agg(F.collect_list("key").alias("gone"))
                codes = codes.join(gone, ["seg", "block"], "left")
            found = codes.join(listed, "list").mapInArrow(candidates(size, metric, k), FOUND)
        else:
            single = listed.select("list", F.explode("queries").alias("query")).join(asked, "query")
            far = exact(metric, F.col("embedding"), F.col("q"))
            if dead is not None:
                codes = codes.join(dead.select("key", F.col("of").alias("seg")), ["key", "seg"], "left_anti")
            found = codes.join(single, "list").select("query", "key", "seg", "list", F.round(far, 9).alias("near"))
        best = Window.partitionBy("query").orderBy("near", "key")
        return found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k).drop("n")

    def search(self, name: str, vector: list[float], k: int, probes: int | None = None, where: Column | None = None) -> DataFrame:
        """key and other columns, distance of the k nearest to a vector in the nearest `probes` lists (None: all). Codes are read, then the candidates' rows alone.

        where (over the other columns) filters candidates before the limit: of those OVERSAMPLING * k, so with a rare condition fewer than k may come."""
        _, state = self._state(name)
        log, key = self._log(name), state["key"]
        if not state["segments"]:
            raise ValueError(f"{name} is empty")
        asked = self.spark.range(1).select(F.lit("q").alias("query"), F.array(*map(F.lit, map(float, vector))).alias("q"))
        found = self._candidates(log, state, asked, k * OVERSAMPLING, probes).collect()  # k * OVERSAMPLING rows
        at: dict[tuple[str, int], list[str]] = {}
        for r in found:
            at.setdefault((r["seg"], r["list"]), []).append(r["key"])
        rows = self._segments(log, state, "rows", sorted({s for s, _ in at}) or list(state["segments"])[:1])
        mine = [(F.col("seg") == s) & (F.col("list") == n) & one_of(F.col(key), keys) for (s, n), keys in sorted(at.items())]
        rows = rows.where(reduce(lambda a, b: a | b, mine) if mine else F.lit(False))
        if where is not None:
            rows = rows.where(where)
        q = F.array(*map(F.lit, map(float, vector)))
        return rows.withColumn("distance", exact(state["metric"], F.col("embedding"), q)).drop("seg", "list", "embedding").orderBy("distance", key).limit(k)

    def search_all(self, name: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """query, key, distance, rank of the k nearest to each of a stated set of queries (query, q)."""
        _, state = self._state(name)
        log, key = self._log(name), state["key"]
        found = written(self._candidates(log, state, queries, k * OVERSAMPLING, probes), "candidates")
        rows = self._segments(log, state, "rows").select(F.col(key).alias("key"), "seg", "list", "embedding")
        pairs = found.select("query", "key", "seg", "list").join(rows, ["seg", "list", "key"]).join(queries.select(F.col("query").cast("string").alias("query"), "q"), "query")
        far = pairs.select("query", "key", exact(state["metric"], F.col("embedding"), F.col("q")).alias("distance"))
        return far.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))).where(F.col("rank") <= k)

    def reembed(self, source: str, target: str, embedding: Column, size: int) -> None:
        """A new collection of the same rows with other vectors (a Column over the old rows)."""
        if source == target:
            raise ValueError("a collection can't be embedded into itself")
        rows, (_, old) = self.read(source), self._state(source)
        self.create(target, size, old["metric"], old["quantised"], old["lists"])
        self.upsert(target, rows.withColumn("embedding", embedding).withColumn("seq", F.lit(0)), old.get("key", "sha256"))
