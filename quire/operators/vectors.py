"""Vector search: exact nearest neighbours, joins of query blocks, fusion of rankings and their evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quire.functions import text as T
from quire.functions.shared import written

#: Vectors of a block of knn_join.
BLOCK = 4096


def knn(vectors: DataFrame, query: Column, k: int, key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """key, distance of the k nearest by Euclidean distance; filters come before the limit. One pass, k rows a task."""
    rows = vectors if where is None else vectors.where(where)
    return rows.select(key, T.l2(F.col("embedding"), query).alias("distance")).orderBy("distance", key).limit(k)


def more_like(vectors: DataFrame, own: int, k: int, key: str = "vec_id", keep_self: bool = False) -> DataFrame:
    """Neighbours of a stored vector, which is one row that is broadcast."""
    query = vectors.where(F.col(key) == own).select(F.col("embedding").alias("q")).limit(1)
    rows = vectors if keep_self else vectors.where(F.col(key) != own)
    return rows.crossJoin(F.broadcast(query)).select(key, T.l2(F.col("embedding"), F.col("q")).alias("distance")).orderBy("distance", key).limit(k)


def packed(vectors: DataFrame, key: str, side: str, label: str | None = None, by: str | None = None) -> DataFrame:
    """{side}_ids, {side}_block, {side}_labels: the vectors in blocks of some BLOCK rows, each a row; labels if one is named. by: a column of integers,
    which the rows of a block share and which is before these."""
    with_label = [] if label is None else [F.col(label).cast("string").alias("l")]
    rows = vectors.where("embedding is not null").select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("v"), *with_label, *([] if by is None else [F.col(by).cast("long").alias(by)]))
    apart = 1 if by is None else max(1, rows.select(by).distinct().count())
    n = max(1, -(-rows.count() // (BLOCK * apart)))

    def pack(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy())
        values = np.array(t.column("v").to_pylist(), np.float32)[order]
        own = pa.table([pa.array([t.column("id").to_numpy()[order].tobytes()]), pa.array([values.tobytes()])], [f"{side}_ids", f"{side}_block"])
        if by is not None:
            own = own.add_column(0, by, t.column(by).slice(0, 1))
        return own if label is None else own.append_column(f"{side}_labels", pa.array([t.column("l").take(pa.array(order)).to_pylist()], pa.list_(pa.string())))

    made = ("" if by is None else f"{by} long, ") + f"{side}_ids binary, {side}_block binary" + ("" if label is None else f", {side}_labels array<string>")
    return rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(n))).groupBy("b", *([] if by is None else [by])).applyInArrow(pack, made)


#: Blocks of queries whose nearest a task holds, and candidates a query up to which a block's are taken one by one.
OPEN, FEW = 32, 64


class Nearest:
    """The k nearest so far of each query of a block, by distance and key."""

    def __init__(self, ids: np.ndarray, block: np.ndarray, k: int):
        self.ids, self.block, self.k = ids, block, k
        self.squares = (block * block).sum(1)
        self.far, self.keys = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def meet(self, keys: np.ndarray, own: np.ndarray) -> None:
        """Vectors whose keys ascend. Once k are known, only what is nearer than the last of them is looked at."""
        squares = (own * own).sum(1)
        for at in range(0, len(self.ids), 256):
            part, here = self.block[at : at + 256], slice(at, at + 256)
            far = np.maximum(self.squares[here, None] + squares[None, :] - 2 * part @ own.T, 0)
            limit = self.far[here, -1] ** 2 * (1 + SAME) + SAME
            near = far <= limit[:, None]
            if np.count_nonzero(near) <= FEW * len(part):
                row, col = np.nonzero(near)
            else:
                best = least(np.round(far, 12), self.k)
                row, col = np.repeat(np.arange(len(part)), best.shape[1]), best.ravel()
            if not len(row):
                continue
            exact = np.sqrt(((own[col] - part[row]) ** 2).sum(1))
            rows = np.concatenate([np.repeat(np.arange(len(part)), self.k), row])
            fars, all_keys = np.concatenate([self.far[here].ravel(), exact]), np.concatenate([self.keys[here].ravel(), keys[col]])
            order = np.lexsort((all_keys, fars, rows))
            begin = np.searchsorted(rows[order], np.arange(len(part)))
            first = order[begin[:, None] + np.arange(self.k)]
            self.far[here], self.keys[here] = fars[first], all_keys[first]

    def rows(self) -> pa.RecordBatch:
        some = np.isfinite(self.far)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.ids, some.sum(1))), pa.array(self.keys[some]), pa.array(self.far[some])], ["query", "key", "distance"])


def least(values: np.ndarray, k: int) -> np.ndarray:
    """Of each row the places of its k least values in order, the first of equal ones."""
    if values.shape[1] <= 4 * k:
        return np.argsort(values, axis=1, kind="stable")[:, :k]
    some = np.sort(np.argpartition(values, k - 1, axis=1)[:, :k], axis=1)
    own = np.take_along_axis(values, some, 1)
    best = np.take_along_axis(some, np.argsort(own, axis=1, kind="stable"), 1)
    tied = np.flatnonzero((values <= own.max(1)[:, None]).sum(1) > k)
    if len(tied):
        best[tied] = np.argsort(values[tied], axis=1, kind="stable")[:, :k]
    return best


def nearest_in_blocks(k: int):
    """Pairs of blocks -> query, key, distance: the k nearest for each query of a block among all blocks that a task has in a row for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, Nearest] = {}
        for b in batches:
            for r in range(b.num_rows):
                q_ids, q, v_ids, v = (b.column(i)[r].as_py() for i in range(4))
                keys = np.frombuffer(v_ids, np.int64)
                if q_ids not in held:
                    if len(held) == OPEN:
                        yield held.pop(next(iter(held))).rows()
                    ids = np.frombuffer(q_ids, np.int64)
                    held[q_ids] = Nearest(ids, np.frombuffer(q, np.float32).astype(np.float64).reshape(len(ids), -1), k)
                held[q_ids].meet(keys, np.frombuffer(v, np.float32).astype(np.float64).reshape(len(keys), -1))
        for own in held.values():
            yield own.rows()

    return run


def knn_join(queries: DataFrame, vectors: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """query, key, distance, rank: the k nearest of vectors for each of a stated set of queries.

    Both sides are packed in blocks; each block of queries meets each block of vectors as one matrix product; k rows a query
    leave a task. A window over these few gives the ranks."""
    pairs = packed(queries, key, "q").crossJoin(packed(vectors, key, "v"))
    found = pairs.mapInArrow(nearest_in_blocks(k), "query long, key long, distance double")
    best = Window.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def sparse_scores(weights: DataFrame, query: dict[str, float], key: str) -> DataFrame:
    """key, score: the dot product of (key, term, weight) with a query, of each term its largest weight."""
    if not query:
        return weights.limit(0).select(key, F.lit(0.0).alias("score"))
    of = F.create_map(*(x for t, w in query.items() for x in (F.lit(t), F.lit(float(w)))))
    best = weights.where(F.col("term").isin(*query)).groupBy(key, "term").agg(F.max("weight").alias("weight"))
    return best.groupBy(key).agg(F.sum(F.col("weight") * of[F.col("term")]).alias("score"))


def maxsim(query: Column, doc: Column) -> Column:
    """Of two arrays of vectors, the mean over the query's of the largest dot product with one of the document's."""
    best = F.transform(query, lambda q: F.array_max(F.transform(doc, lambda d: T.dot(q, d))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(query), F.lit(0))


def fused(parts: list[tuple[DataFrame, float]], key: str) -> DataFrame:
    """key, score: the weighted sum of scores; who is missing from a part has 0 there."""
    out = None
    for df, w in parts:
        own = df.select(key, (F.col("score") * w).alias("score"))
        out = own if out is None else out.unionAll(own)
    return out.groupBy(key).agg(F.sum("score").alias("score"))


def reciprocal_ranks(parts: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """key, score: the sum of 1 / (k + rank) over rankings (key, rank)."""
    return fused([(p.select(key, (1 / (F.col("rank") + k)).alias("score")), 1.0) for p in parts], key)


def judged(ranking: DataFrame, cut: int = 10) -> DataFrame:
    """query, precision, ndcg, rr of rankings (query, rank from 1, relevant 0/1), of which all rows are given."""
    top = ranking.where(F.col("rank") <= cut)
    gain = F.sum(F.col("relevant") / F.log2(F.col("rank") + 1))
    got = top.groupBy("query").agg((F.sum("relevant") / cut).alias("precision"), gain.alias("dcg"))
    first = ranking.groupBy("query").agg(F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"), F.least(F.sum("relevant"), F.lit(cut)).alias("ideal"))
    best = F.aggregate(F.when(F.col("ideal") > 0, F.sequence(F.lit(1).cast("long"), F.col("ideal"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    return got.join(first, "query").select("query", "precision", F.coalesce(F.col("dcg") / F.nullif(best, F.lit(0.0)), F.lit(0.0)).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"))


def judged_neighbours(queries: DataFrame, vectors: DataFrame, label: str, cut: int = 10, key: str = "vec_id") -> DataFrame:
    """query, precision, ndcg, rr of the ranking of vectors by distance to each of a stated set of queries (itself left out), relevant those of its label.

    Only the nearest few leave a block. The first relevant one's rank is one more than the number of nearer ones, which is
    counted only for queries without a relevant one among the few."""
    own = queries.select(F.col(key).alias("query"), F.col(label).alias("m"), F.col("embedding").alias("q"))
    of = vectors.select(F.col(key).alias("key"), F.col(label).alias("l"))
    near = knn_join(queries, vectors, cut + 1, key).where("query != key").join(of, "key").join(own.select("query", "m"), "query")
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))).where(F.col("rank") <= cut)
    gain = F.when(F.col("l") == F.col("m"), 1).otherwise(0)
    some = ranked.groupBy("query").agg((F.sum(gain) / cut).alias("precision"), F.sum(gain / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(gain == 1, F.col("rank"))).alias("first"))
    n = vectors.groupBy(F.col(label).alias("m")).agg(F.count("*").alias("n"))
    sized = own.join(n, "m", "left").select("query", "m", "q", F.least(F.coalesce("n", F.lit(1)) - 1, F.lit(cut)).alias("ideal"))
    out = sized.join(some, "query", "left").select("query", "m", "q", "ideal", "precision", "dcg", "first")
    late = out.where("first is null and ideal > 0").select("query", "m", "q")
    # the nearest of the query's own label, then how many of all vectors are nearer: both block by block
    asked = written(late.select(F.col("query").alias(key), F.col("m").alias(label), F.col("q").alias("embedding")), "late")
    hit = nearest_alike(asked, vectors, label, key)
    asked = asked.join(hit, asked[key] == hit["query"]).select(key, "embedding", "hit")
    behind = nearer(written(asked, "late"), vectors, key).select("query", (F.col("n") + 1).alias("later"))
    best = F.aggregate(F.when(F.col("ideal") > 0, F.sequence(F.lit(1).cast("long"), F.col("ideal"))).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda x, r: x + 1 / F.log2(r + 1))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return out.join(behind, "query", "left").select("query", zero(F.col("precision")).alias("precision"), zero(F.col("dcg") / F.nullif(best, F.lit(0.0))).alias("ndcg"), zero(1 / F.coalesce("first", "later")).alias("rr"))


def nearest_alike(queries: DataFrame, vectors: DataFrame, label: str, key: str) -> DataFrame:
    """query, hit (distance, key): of each of queries, the nearest of vectors with its label, itself left out. A row a query leaves a pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in b.schema.names}
                ids, keys = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["v_ids"], np.int64)
                block, own = (np.frombuffer(row[x], np.float32).astype(float).reshape(n, -1) for x, n in (("q_block", len(ids)), ("v_block", len(keys))))
                code = {x: i for i, x in enumerate(dict.fromkeys(x for x in row["q_labels"] if x is not None))}
                asked, have = (np.array([code.get(x, none) for x in row[f"{side}_labels"]]) for side, none in (("q", -2), ("v", -1)))
                squares = (own * own).sum(1)
                for at in range(0, len(ids), 256):
                    part = block[at : at + 256]
                    far = np.maximum((part * part).sum(1)[:, None] + squares[None] - 2 * part @ own.T, 0)
                    far[(asked[at : at + 256, None] != have[None]) | (ids[at : at + 256, None] == keys[None])] = np.inf
                    best = np.argmin(np.round(far, 12), axis=1)  # keys ascend, so ties go by key
                    some = np.flatnonzero(np.isfinite(far[np.arange(len(part)), best]))
                    exact = np.sqrt(((own[best[some]] - part[some]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at : at + 256][some]), pa.array(exact), pa.array(keys[best[some]])], ["query", "distance", "key"])

    pairs = packed(queries, key, "q", label).crossJoin(packed(vectors, key, "v", label))
    return pairs.mapInArrow(run, "query long, distance double, key long").groupBy("query").agg(F.min(F.struct("distance", "key")).alias("hit"))


#: Two distances are one if they differ by less: a matrix product rounds otherwise than a sum of squares.
SAME = 1e-9


def nearer(queries: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """query, n: how many of vectors come before (hit: distance, key) of each of queries (key, embedding, hit), itself left out. Blocks of queries meet blocks of vectors; a number a query leaves a pair."""
    hits = queries.select(F.col(key).cast("long").alias("query"), "hit.distance", F.col("hit.key").alias("at"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {n: b.column(n)[r].as_py() for n in b.schema.names}
                ids, keys = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["v_ids"], np.int64)
                q, v = np.frombuffer(row["q_block"], np.float32).reshape(len(ids), -1).astype(float), np.frombuffer(row["v_block"], np.float32).reshape(len(keys), -1).astype(float)
                far = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (v * v).sum(1)[None] - 2 * q @ v.T, 0))
                at = {i: n for n, i in enumerate(ids.tolist())}
                order = [at[i] for i in row["asked"]]
                limit, where = np.array(row["distances"])[:, None], np.array(row["ats"])[:, None]
                far = far[order]
                before = (far < limit - SAME) | ((far <= limit + SAME) & (keys[None] < where))
                before &= keys[None] != ids[order][:, None]
                yield pa.RecordBatch.from_arrays([pa.array(ids[order]), pa.array(before.sum(1))], ["query", "n"])

    # the hits of a block go with it
    block = packed(queries, key, "q")
    ids = block.select("q_ids", F.explode(longs(F.col("q_ids"))).alias("query"))
    own = ids.join(hits, "query").groupBy("q_ids").agg(F.collect_list(F.struct("query", "distance", "at")).alias("h")).select("q_ids", F.col("h.query").alias("asked"), F.col("h.distance").alias("distances"), F.col("h.at").alias("ats"))
    pairs = block.join(own, "q_ids").crossJoin(packed(vectors, key, "v"))
    return pairs.mapInArrow(counted, "query long, n long").groupBy("query").agg(F.sum("n").alias("n"))


def longs(packed_ids: Column) -> Column:
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: np.frombuffer(b, np.int64).tolist())

    return F.pandas_udf(read, ArrayType(LongType()))(packed_ids)


def upserted(stored: DataFrame, new: DataFrame, key: str = "sha256") -> DataFrame:
    """Stored rows with new ones in the place of those with their key; of several new ones the last by seq."""
    last = Window.partitionBy(key).orderBy(F.desc("seq"))
    own = new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "seq")
    return stored.join(own.select(key), key, "left_anti").unionByName(own)


#: How many more candidates than asked for a quantised search rescores.
OVERSAMPLING = 3


def quantized(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    """key, code (array of small integers), step: each vector in 8 bits a component, by its own largest component."""
    step = F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))) / 127
    rows = vectors.select(key, F.col("embedding").alias("v"), F.when(step > 0, step).otherwise(F.lit(1.0)).alias("step"))
    return rows.select(key, F.transform("v", lambda x: F.round(x.cast("double") / F.col("step")).cast("tinyint")).alias("code"), "step")


def knn_quantized(codes: DataFrame, vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", oversampling: int = OVERSAMPLING) -> DataFrame:
    """key, distance of the k nearest: k * oversampling candidates by their codes, rescored by their full vectors. Only the codes are read for all rows."""
    q = F.array(*map(F.lit, map(float, query)))
    near = F.sqrt(F.aggregate(F.zip_with("code", q, lambda c, x: (c * F.col("step") - x) * (c * F.col("step") - x)), F.lit(0.0), lambda s, x: s + x))
    found = codes.select(key, F.round(near, 9).alias("_near")).orderBy("_near", key).limit(k * oversampling).select(key)
    return knn(vectors.join(F.broadcast(found), key, "left_semi"), q, k, key)


def centres(vectors: DataFrame, lists: int, sample: int = 20_000, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """The centres of an inverted file: k-means on a bounded sample, those of least hash."""
    rows = vectors.where("embedding is not null").select(F.xxhash64(F.lit(seed), "embedding").alias("h"), F.col("embedding").cast("array<double>").alias("v"))
    least = rows.count()
    if least > sample:  # about as many as asked for, by their hash alone
        rows = rows.where(F.pmod("h", F.lit(1 << 40)) < F.lit(int((1 << 40) * sample / least)))
    points = np.array([r["v"] for r in rows.select("h", "v").orderBy("h", "v").collect()])
    own = points[:: max(1, len(points) // lists)][:lists].copy()
    for _ in range(rounds):
        at = ((points[:, None, :] - own[None]) ** 2).sum(2).argmin(1) if len(points) * len(own) < 1 << 22 else np.concatenate([((p[:, None, :] - own[None]) ** 2).sum(2).argmin(1) for p in np.array_split(points, 1 + len(points) * len(own) // (1 << 22))])
        for i in range(len(own)):
            if (at == i).any():
                own[i] = points[at == i].mean(0)
    return own


def in_lists(vectors: DataFrame, centre: np.ndarray, probes: int = 1, name: str = "list", place: str | None = None) -> DataFrame:
    """vectors with the number of their nearest centre (probes: a row for each of the nearest ones; place: a column for which of them it is, from 0). The centres go with the task."""
    of = F.array(*(F.array(*map(F.lit, c.tolist())) for c in centre))
    far = F.transform(of, lambda c, i: F.struct(T.l2(F.col("embedding"), c).alias("d"), i.alias("i")))
    nearest = F.transform(F.slice(F.array_sort(far), 1, probes), lambda x: x["i"])
    if place is None:
        return vectors.withColumn(name, F.explode(nearest))
    return vectors.select("*", F.posexplode(nearest).alias(place, name))


#: Tasks of a list's vectors.
SHARES = 4


def knn_by_lists(queries: DataFrame, indexed: DataFrame, centre: np.ndarray, k: int, probes: int = 8, key: str = "vec_id") -> DataFrame:
    """query, key, distance, rank: the k nearest among the lists (see in_lists) nearest to each query. Approximate: recall grows with the probes."""
    asked = in_lists(queries.select(key, "embedding"), centre, probes)
    # the blocks of a list are dealt to SHARES tasks by those of the queries, which each meet all of its vectors
    q = packed(asked, key, "q", by="list").withColumn("share", F.pmod(F.xxhash64("q_ids"), F.lit(SHARES)))
    v = packed(indexed, key, "v", by="list").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    pairs = q.join(v.hint("merge"), ["list", "share"]).select("q_ids", "q_block", "v_ids", "v_block")
    found = pairs.mapInArrow(nearest_in_blocks(k), "query long, key long, distance double")
    best = Window.partitionBy("query").orderBy("distance", "key")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def probes_for(queries: DataFrame, vectors: DataFrame, centre: np.ndarray, k: int, least: float = 0.95, sample: int = 512, key: str = "vec_id") -> int:
    """In how many lists nearest to a query its k nearest are to be looked for, so that a share of `least` is found: measured against an exact
    search with a bounded sample of the queries, those of least hash. The lists' number at most, with which nothing is lost."""
    some = written(queries.where("embedding is not null").orderBy(F.xxhash64(key), key).limit(sample).select(key, "embedding"), "probed")
    exact = written(knn_join(some, vectors, k, key).select("query", "key"), "probed")
    lists = in_lists(vectors.select(F.col(key).alias("key"), "embedding").join(F.broadcast(exact.select("key").distinct()), "key", "left_semi"), centre).select("key", "list")  # sample * k rows at most
    order = in_lists(some.select(F.col(key).alias("query"), "embedding"), centre, len(centre), place="place").select("query", "list", "place")
    found = exact.join(lists, "key").join(order, ["query", "list"]).groupBy("place").count().collect()  # a row a list at most
    n, total = 0, sum(r["count"] for r in found)
    for r in sorted(found, key=lambda r: r["place"]):
        n += r["count"]
        if n >= least * total:
            return r["place"] + 1
    return len(centre)


def method_scores(scores: DataFrame, key: str, least: int = 150) -> DataFrame:
    """method, key, score of the seven ways to rank passages (key, dense, sparse, multi, chars); "passages only" leaves out those shorter than least."""
    dense, sparse, multi, long = F.col("dense"), F.col("sparse"), F.col("multi"), F.col("chars") >= least
    both, all_three = dense + 0.3 * sparse, dense + 0.3 * sparse + multi
    ways = {"dense": (dense, False), "dense, passages only": (dense, True), "sparse": (sparse, False), "multi-vector": (multi, False), "dense+sparse+multi": (all_three, False), "dense+sparse, passages only": (both, True), "all three, passages only": (all_three, True)}
    rows = F.array(*(F.struct(F.lit(n).alias("method"), F.when(long | F.lit(not cut), s).alias("score")) for n, (s, cut) in ways.items()))
    return scores.select(key, F.explode(rows).alias("m")).select("m.method", key, "m.score").where("score is not null")


def reembedded(rows: DataFrame, embedding: Column) -> DataFrame:
    """The same rows with other vectors."""
    return rows.withColumn("embedding", embedding)


def by_sha(vectors: DataFrame, wanted: DataFrame) -> DataFrame:
    """Stored vectors (sha256, ...) of wanted digests (sha256), with the id of their point."""
    return vectors.join(wanted.select("sha256").distinct(), "sha256", "left_semi").withColumn("point", T.point_id(F.col("sha256")))


def to_embed(texts: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (sha256, url, text) whose vector isn't stored, one for each digest; and stored vectors (sha256, url, ...) whose text now stands
    at another url, with that url (the least)."""
    known = vectors.select("sha256").distinct()
    new = texts.join(known, "sha256", "left_anti").groupBy("sha256").agg(F.min(F.struct("url", "text")).alias("t")).select("sha256", "t.url", "t.text")
    at = texts.groupBy("sha256").agg(F.min("url").alias("_url"), F.collect_set("url").alias("_urls"))
    moved = vectors.join(at, "sha256").where(~F.array_contains("_urls", F.col("url"))).withColumn("url", F.col("_url")).drop("_url", "_urls")
    return new, moved


def with_texts(hits: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Hits of a search (key, ...) with the text that they stand for; those whose text is gone or blank drop out, after the limit."""
    return hits.join(texts, key).where(F.trim("text") != "")
