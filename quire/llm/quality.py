"""Operator 1, quality classifier: co-training of a text-content view and a page-metadata view.

Method: two targets, low quality and toxicity. For each there is a classifier of the content (which words and beginnings of
words occur) and one of the metadata: what is recorded of a page (language, source, length) and statistics of its layout
(shares of capitals, symbols, repeated lines and the like), nothing of which words it holds. Both are trained on labelled
rows. Then, in each round, either view labels all rows without a label that it is surest of, for the other view: of the rows
that it gives to a class, the half with the highest probability, judged by calibration on labelled rows that neither view has
seen. What a view gets from these rows is how often each of its features occurs in either class; a document's likelihood
ratio by these counts is a feature of the next round's classifier, which learns on labelled rows how far to trust it. Last,
the calibrated views are combined by a logistic model fitted on the same held-out rows, and every document is scored. A
document is kept if it is rather good than bad and rather clean than toxic.

Classifiers are fitted on a bounded sample of labelled rows, the LABELLED ones with the least hash of their doc_id (found
by a broadcast of their ids); a row's features are SPACE at most. All rows without a label take part in the exchange and
all are scored, each whole. Features are made once and written to the shared folder; a round reads them.

Null texts are empty and null metadata a value of its own; null labels are left out, a doc_id with several label rows
trains once for each. A target without rows of both kinds (so also an empty labels table) rejects nothing. Rows are judged
one by one; repeated rows get equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import grouped, lean, lean_group, pack, unpack, written

LABELLED = 12_000
ROUNDS = 2
#: Of the rows that a view gives to a class, the share that it is surest of and labels for the other view.
SUREST = 0.5
SPACE = 1 << 18
#: Features that a text model keeps, by the z-score of their rates; least number of rows that have them; least z-score, for
#: which chance among some ten thousand features is slight.
KEPT = 6_000
LEAST_ROWS = 3
SURE_Z = 4
WORD = re.compile(r"[^\W\d_]+")
TARGETS = ("low", "toxic")
SHAPE = 10
FEATURES = "doc_id long, words array<int>, shape array<double>, meta array<int>"
COUNTS = "target int, view int, class int, feature int, n long"
PACKED_COUNTS = "target int, view int, class int, chunk int, packed binary"
#: Rows that a worker turns into features, or judges, at a time; features whose counts travel as one value.
SLICE = 500
CHUNK = 1 << 12
#: Stands for the documents themselves among the features that are counted, and for all rows among classes.
DOCUMENTS = -1
ALL = 2
SCORES = "p_quality double, p_toxic double, keep boolean"


def hashed(kind: str, value: str) -> int:
    return zlib.crc32(value.encode(), ord(kind)) & (SPACE - 1)


def text_features(text: str) -> tuple[set[int], list[float]]:
    """Hashes of the words and of their first 4 and 5 letters; the shape of the text."""
    words = WORD.findall(text.lower())
    own = set(words)
    crc, mask = zlib.crc32, SPACE - 1
    found = {crc(w.encode(), 119) & mask for w in own}
    found |= {crc(w.encode(), 53) & mask for w in {w[:5] for w in own if len(w) > 5}}
    found |= {crc(w.encode(), 52) & mask for w in {w[:4] for w in own if len(w) > 4}}
    tokens = text.split()
    n, chars = max(1, len(tokens)), max(1, len(text))
    letters = sum(map(len, words))
    lines = text.split("\n")
    upper = sum(map(str.isupper, tokens))
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:], strict=False))
    shape = [upper / n, 1 - letters / chars, text.count("|") / n, len(set(tokens)) / n, letters / max(1, len(words)), sum(map(text.count, "$%&*#")) / n, repeats / n, len(set(lines)) / len(lines), np.log1p(n), text.count("!") / n]
    return found, shape


def meta_features(lang: str | None, source: str | None, n_chars: int | None, shape: list[float]) -> list[int]:
    size = "none" if n_chars is None else str(int(np.log2(1 + max(0, n_chars)) * 2))
    recorded = [hashed("l", str(lang)), hashed("s", str(source)), hashed("n", size), hashed("b", f"{lang} {size}")]
    return recorded + [hashed("v", f"{i} {int(min(x, 9) * 20)}") for i, x in enumerate(shape)]


def features_of(b: pa.RecordBatch) -> tuple[list[set[int]], list[list[float]], list[list[int]]]:
    """Content features, layout and metadata features of rows (doc_id, text, lang, source, n_chars)."""
    texts = [text_features(t or "") for t in b.column(1).to_pylist()]
    metas = [meta_features(*m, t[1]) for m, t in zip(zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True), texts, strict=True)]
    return [t[0] for t in texts], [t[1] for t in texts], metas


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches):
        words, shape, meta = features_of(b)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(w) for w in words], pa.list_(pa.int32())), pa.array(shape, pa.list_(pa.float64())), pa.array(meta, pa.list_(pa.int32()))], ["doc_id", "words", "shape", "meta"])


class Rows(NamedTuple):
    """Sparse rows: the features of row i are at[i] to at[i + 1] of index; dense ones beside them."""

    at: np.ndarray
    index: np.ndarray
    dense: np.ndarray

    def take(self, rows: np.ndarray) -> Rows:
        size = np.diff(self.at)[rows]
        at = np.append(0, np.cumsum(size))
        return Rows(at, self.index[np.repeat(self.at[rows] - at[:-1], size) + np.arange(at[-1])], self.dense[rows])


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[at[1:]] - total[at[:-1]]


class Linear:
    """A logistic model of some sparse and standardised dense features."""

    def __init__(self, rows: Rows, y: np.ndarray, l2: float = 1e-3, steps: int = 150):
        n, n1 = len(y), max(1.0, y.sum())
        n0 = max(1.0, n - y.sum())
        of = np.repeat(np.arange(n), np.diff(rows.at))
        have1 = np.bincount(rows.index, weights=y[of], minlength=SPACE)
        have = np.bincount(rows.index, minlength=SPACE)
        rate = have / max(1, n)
        z = (have1 / n1 - (have - have1) / n0) / np.sqrt(np.maximum(rate * (1 - rate), 1e-9) * (1 / n1 + 1 / n0))
        z[have < LEAST_ROWS] = 0
        kept = np.argsort(-np.abs(z), kind="stable")[:KEPT]
        kept = kept[np.abs(z[kept]) > SURE_Z]
        where = np.full(SPACE, -1, np.int32)
        where[kept] = np.arange(len(kept))
        self.mean, self.scale = rows.dense.mean(0), rows.dense.std(0) + 1e-6
        dense = (rows.dense - self.mean) / self.scale
        live = where[rows.index] >= 0
        index, of = where[rows.index[live]], of[live]
        w, v, b = np.zeros(len(kept)), np.zeros(dense.shape[1]), float(np.log(n1 / n0))
        moments = [np.zeros(len(kept)), np.zeros(len(v)), 0.0]
        second = [np.zeros(len(kept)), np.zeros(len(v)), 0.0]
        for step in range(1, steps + 1):  # Adam on all rows
            p = sigmoid(np.bincount(of, weights=w[index], minlength=n) + dense @ v + b)
            error = (p - y) / n
            grads = [np.bincount(index, weights=error[of], minlength=len(kept)) + l2 / 10 * w, error @ dense + l2 * v, float(error.sum())]
            for i, g in enumerate(grads):
                moments[i] = 0.9 * moments[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
            w, v, b = (x - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8) for x, m, s in zip((w, v, b), moments, second, strict=True))
        self.weight = np.zeros(SPACE, np.float32)
        self.weight[kept] = w
        self.dense, self.bias = v, b

    def logits(self, rows: Rows) -> np.ndarray:
        return sums(self.weight[rows.index].astype(float), rows.at) + (rows.dense - self.mean) / self.scale @ self.dense + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and a constant of a logistic model of a few columns, by Newton steps with a little shrinkage. A column that would count against itself gets no weight."""
    used = np.ones(x.shape[1], bool)
    while True:
        own = np.column_stack([x[:, used], np.ones(len(x))])
        w = np.zeros(own.shape[1])
        ridge = np.diag([1e-2] * int(used.sum()) + [1e-4])
        for _ in range(30):
            p = sigmoid(own @ w)
            step = np.linalg.solve((own * (p * (1 - p) + 1e-9)[:, None]).T @ own + ridge, own.T @ (p - y) + ridge @ w)
            w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        out = np.zeros(x.shape[1] + 1)
        out[np.append(used, True)] = w
        if not (out[:-1] < 0).any():
            return out
        used &= out[:-1] >= 0


class View(NamedTuple):
    """A classifier, its calibration, what it got from the other view, and from where on it labels for that view."""

    model: Linear
    scale: np.ndarray
    ratio: np.ndarray
    sure: tuple[float, float]

    def logits(self, rows: Rows) -> np.ndarray:
        return np.clip(self.model.logits(with_ratio(rows, self.ratio)), -30, 30) * self.scale[0] + self.scale[1]

    def given(self, rows: Rows) -> list[np.ndarray]:
        """The rows that this view labels 0, and 1."""
        z = self.logits(rows)
        return [np.flatnonzero(z <= self.sure[0]), np.flatnonzero(z >= self.sure[1])]


class Target(NamedTuple):
    views: tuple[View, View]
    mix: np.ndarray

    def score(self, views: tuple[Rows, Rows]) -> np.ndarray:
        return sigmoid(np.column_stack([v.logits(r) for v, r in zip(self.views, views, strict=True)]) @ self.mix[:-1] + self.mix[-1])


def with_ratio(rows: Rows, ratio: np.ndarray) -> Rows:
    """rows with the log-likelihood ratio of their features as one more dense value."""
    total = sums(ratio[rows.index].astype(float), rows.at)
    return rows._replace(dense=np.column_stack([rows.dense, total / np.sqrt(np.maximum(1, np.diff(rows.at)))]))


def likelihood(counts: dict[int, np.ndarray], documents: dict[int, int]) -> np.ndarray:
    """Log ratio of each feature's rate in class 1 and in class 0; all rows stand for a class that no row was given."""
    rates = [np.log((counts[c] + 0.5) / (documents[c] + 1)) for c in (1 if documents[1] else ALL, 0 if documents[0] else ALL)]
    ratio = (rates[0] - rates[1]).astype(np.float32)
    ratio[counts[0] + counts[1] < LEAST_ROWS] = 0
    return ratio


def fitted_view(rows: Rows, y: np.ndarray, held: np.ndarray, ratio: np.ndarray) -> View:
    """A view trained on the rows that are not held, calibrated on those that are."""
    whole = with_ratio(rows, ratio)
    fit, check = np.flatnonzero(~held), np.flatnonzero(held)
    model = Linear(whole.take(fit), y[fit])
    scale = fitted(np.clip(model.logits(whole.take(check)), -30, 30)[:, None], y[check])
    view = View(model, scale, ratio, (0.0, 0.0))
    z = view.logits(rows.take(check))
    low, high = z[z < 0], z[z >= 0]
    return view._replace(sure=(float(np.quantile(low, SUREST)) if len(low) else -np.inf, float(np.quantile(high, 1 - SUREST)) if len(high) else np.inf))


def trained(views: tuple[Rows, Rows], y: np.ndarray, held: np.ndarray, ratios: tuple[np.ndarray, np.ndarray] | None = None) -> Target | None:
    """Both views from labelled rows (y: 0, 1, or nan for rows without a label) and from what they got so far."""
    known = ~np.isnan(y)
    if min((y[known & ~held] == k).sum() for k in (0, 1)) < 2 or min((y[known & held] == k).sum() for k in (0, 1)) < 1:
        return None
    at = np.flatnonzero(known)
    own = tuple(fitted_view(r.take(at), y[at], held[at], ratio) for r, ratio in zip(views, ratios or (np.zeros(SPACE, np.float32),) * 2, strict=True))
    check = np.flatnonzero(known & held)
    return Target(own, fitted(np.column_stack([v.logits(r.take(check)) for v, r in zip(own, views, strict=True)]), y[check]))


def as_rows(lists: pa.Array, dense: np.ndarray) -> Rows:
    at = lists.offsets.to_numpy().astype(np.int64)
    return Rows(at - at[0], lists.values.to_numpy()[at[0] : at[-1]], dense)


def views_of(table: pa.Table | pa.RecordBatch) -> tuple[Rows, Rows]:
    """The content view (no dense values) and the metadata view of featured rows."""
    flat = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    flat_all = lambda c: pa.concat_arrays(flat(c).chunks) if isinstance(flat(c), pa.ChunkedArray) and flat(c).num_chunks else flat(c)
    shape = flat_all(table.column("shape"))
    return as_rows(flat_all(table.column("words")), np.zeros((table.num_rows, 0))), as_rows(flat_all(table.column("meta")), shape.flatten().to_numpy().reshape(-1, SHAPE))


def counted(models: dict[str, Target | None], labelled: np.ndarray):
    """Featured rows -> how often each feature of a view occurs in the rows that the other view labels, and in all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], np.ndarray] = {}

        def add(target: int, view: int, kind: int, rows: Rows) -> None:
            n = total.setdefault((target, view, kind), np.zeros(SPACE + 1, np.int64))
            n[:SPACE] += np.bincount(rows.index, minlength=SPACE)
            n[SPACE] += len(rows.at) - 1

        for b in sliced(batches):
            b = b.filter(pa.array(~np.isin(b.column(0).fill_null(0).to_numpy(), labelled) | b.column(0).is_null().to_numpy(zero_copy_only=False)))
            if not b.num_rows:
                continue
            views = views_of(b)
            for k, rows in enumerate(views):
                add(DOCUMENTS, k, ALL, rows)
            for t, name in enumerate(TARGETS):
                for k, view in enumerate(models[name].views if models[name] else ()):
                    for label, own in enumerate(view.given(views[k])):
                        add(t, 1 - k, label, views[1 - k].take(own))
        rows = []
        for key, n in total.items():
            at = np.flatnonzero(n)
            for chunk, own in grouped(at // CHUNK):
                rows.append((*key, chunk, pack(np.diff(at[own], prepend=chunk * CHUNK).astype(np.int32), n[at[own]])))
        kinds = (*[pa.int32()] * 4, pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in PACKED_COUNTS.split(", ")])

    return run


def summed(table: pa.Table) -> pa.Table:
    """A chunk of counts from all tasks -> what each feature comes to; the number of rows stands at the feature DOCUMENTS."""
    target, view, kind, chunk = (table.column(i)[0].as_py() for i in range(4))
    n = np.zeros(CHUNK, np.int64)
    for v in table.column("packed"):
        step, own = unpack(v.as_py())
        n[np.cumsum(step)] += own
    at = np.flatnonzero((n >= LEAST_ROWS) | (n > 0) & (chunk * CHUNK + np.arange(CHUNK) == SPACE))
    constant = lambda v: pa.array(np.full(len(at), v, np.int32))
    feature = chunk * CHUNK + at
    return pa.table([constant(target), constant(view), constant(kind), pa.array(np.where(feature == SPACE, DOCUMENTS, feature).astype(np.int32)), pa.array(n[at])], ["target", "view", "class", "feature", "n"])


def exchanged(rows: DataFrame, models: dict[str, Target | None], labelled: np.ndarray) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], dict[tuple[str, int, int], int]]:
    """What each view gets from the other (rows: all featured rows): ratios by target and view, and how many rows of each class."""
    found = rows.mapInArrow(lean(counted(models, labelled)), PACKED_COUNTS).groupBy("target", "view", "class", "chunk").applyInArrow(lean_group(summed), COUNTS)
    table = found.toArrow()  # at most SPACE rows of each target, view and class
    columns = [table.column(c).to_numpy() for c in ("target", "view", "class", "feature", "n")]

    def group(target: int, view: int, kind: int) -> tuple[np.ndarray, int]:
        own = (columns[0] == target) & (columns[1] == view) & (columns[2] == kind)
        feature, n = columns[3][own], columns[4][own]
        out = np.zeros(SPACE)
        out[feature[feature >= 0]] = n[feature >= 0]
        return out, int(n[feature == DOCUMENTS].sum())

    ratios, given = {}, {}
    for t, name in enumerate(TARGETS):
        own = []
        for view in (0, 1):
            of = {0: group(t, view, 0), 1: group(t, view, 1), ALL: group(DOCUMENTS, view, ALL)}
            own.append(likelihood({k: v[0] for k, v in of.items()}, {k: v[1] for k, v in of.items()}))
            given.update({(name, 1 - view, k): of[k][1] for k in (0, 1)})
        ratios[name] = tuple(own)
    return ratios, given


def columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def train(rows: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, report: list | None = None) -> dict[str, Target | None]:
    """The models of both targets, from featured rows. report gets, of each round, how many rows of each class each view gave."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic")).where("doc_id is not null")
    known = marks.orderBy(F.xxhash64("doc_id"), "quality", "toxic").limit(labelled).collect()  # at most the bound
    by: dict[int, list[tuple]] = {}
    for r in known:
        by.setdefault(r["doc_id"], []).append((r["quality"], r["toxic"]))
    if not by:
        return dict.fromkeys(TARGETS)
    ids = rows.sparkSession.createDataFrame([(i,) for i in by], "doc_id long")
    sample = rows.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "words", "shape", "meta").toArrow()
    ids_of = sample.column("doc_id").to_numpy()
    at, low, toxic = [], [], []
    for i in np.lexsort((ids_of, [zlib.crc32(str(d).encode()) for d in ids_of.tolist()])).tolist():
        for quality, bad in by[ids_of[i]]:
            at.append(i)
            low.append(np.nan if quality is None else 1.0 - quality)
            toxic.append(np.nan if bad is None else float(bad))
    if not at:
        return dict.fromkeys(TARGETS)
    at = np.array(at)
    views = tuple(v.take(at) for v in views_of(sample))
    held = np.array([zlib.crc32(f"held {d}".encode()) % 4 == 0 for d in ids_of[at].tolist()])
    truth = dict(zip(TARGETS, (np.array(low), np.array(toxic)), strict=True))
    models = {t: trained(views, y, held) for t, y in truth.items()}
    for _ in range(rounds if any(models.values()) else 0):
        ratios, given = exchanged(rows, models, np.array(sorted(by), np.int64))
        models = {t: trained(views, y, held, ratios[t]) for t, y in truth.items()}
        if report is not None:
            report.append(given)
    return models


def judged(models: dict[str, Target | None], views: tuple[Rows, Rows], n: int) -> list[pa.Array]:
    """p_quality, p_toxic, keep."""
    low, toxic = (np.zeros(n) if models[t] is None else models[t].score(views) for t in TARGETS)
    return [pa.array(np.round(1 - low, 6)), pa.array(np.round(toxic, 6)), pa.array((low < 0.5) & (toxic < 0.5))]


def scored(models: dict[str, Target | None]):
    """Featured rows -> doc_id, p_quality, p_toxic, keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *judged(models, views_of(b), b.num_rows)], ["doc_id", "p_quality", "p_toxic", "keep"])

    return run


def features(docs: DataFrame) -> DataFrame:
    """The features of all docs, as a table in the shared folder."""
    return written(columns(docs).mapInArrow(lean(featured), FEATURES), "features")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_quality, p_toxic, keep: a row for each of docs."""
    rows = features(docs)
    return rows.mapInArrow(lean(scored(train(rows, labels))), f"doc_id long, {SCORES}")


def kept_rows(models: dict[str, Target | None]):
    """Rows (doc_id, text, lang, source, n_chars) -> those to keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            words, shape, meta = features_of(part)
            size = lambda own: np.append(0, np.cumsum([len(x) for x in own]))
            index = lambda own: np.fromiter((i for x in own for i in x), np.int64)
            views = Rows(size(words), index(words), np.zeros((len(words), 0))), Rows(size(meta), index(meta), np.array(shape).reshape(-1, SHAPE))
            yield part.filter(judged(models, views, part.num_rows)[2])

    return run


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, source, n_chars of the rows of docs that are kept."""
    return columns(docs).mapInArrow(lean(kept_rows(train(features(docs), labels))), "doc_id long, text string, lang string, source string, n_chars long")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
