"""One object over the tables of a corpus: what a reader, a catalogue or a tool asks for, as DataFrames.

Tables: authors (id, str_id, first_name, last_name, display_name, original_name), files (id, filename, author_id, repo),
divisions (id, parent_id, file_id, path, head, lang, pos, depth, root_id), paragraphs (div_id, path, nth, text, sha256),
vectors (sha256, url, embedding), relocations (old, new, reason), and, where files have several authors, file_authors
(file_id, author_id) in the place of files.author_id."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions.frames import one_of
from quire.operators import address, catalog, relocate, search, tree, vectors
from quire.operators.fulltext import Index


def hash_embedding(text: str, size: int = 64) -> list[float]:
    """A unit vector that hangs on the text alone: stands for a model where there is none."""
    import hashlib

    seed = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little")
    v = np.random.default_rng(seed).normal(size=size)
    return (v / np.linalg.norm(v)).tolist()


#: What models want before a text, by model and whether it is a query (fixed values).
PREFIXES = {("nomic", True): "search_query: ", ("nomic", False): "search_document: ", ("e5", True): "query: ", ("e5", False): "passage: "}


@dataclass
class Corpus:
    authors: DataFrame
    files: DataFrame
    divisions: DataFrame
    paragraphs: DataFrame
    vectors: DataFrame | None = None
    relocations: DataFrame | None = None
    file_authors: DataFrame | None = None
    index: Index | None = None
    ordered: search.Ordered | None = None
    embed: object = field(default=hash_embedding)

    # search

    def find_authors(self, q: str, limit: int | None = None) -> DataFrame:
        a = self.authors
        parts = [a.where(T.like_ci(F.col(c), q)) for c in ("last_name", "first_name", "str_id", "display_name")]
        return search.union_by_key(parts, "id").orderBy("last_name", "first_name", "str_id").limit(search.search_limit(limit))

    def find_heads(self, q: str, limit: int | None = None, scopes: list[str] | None = None) -> DataFrame:
        own = self.divisions.where(T.like_ci(F.col("head"), q) & T.in_scope(F.col("path"), T.normal_scopes(scopes)))
        return own.orderBy("id").limit(search.search_limit(limit))

    def grep(self, q: str, limit: int | None = None, scopes: list[str] | None = None) -> DataFrame:
        licences = self.divisions.where(T.is_licence(F.col("head"))).select(F.col("id").alias("div_id"))
        if self.ordered is not None:
            return self.ordered.first(T.contains_ci(F.col("text"), q), search.search_limit(limit), ~F.col("licence") & T.in_scope(F.col("path"), T.normal_scopes(scopes)), search.GREP_BOUND)[0].drop("licence")
        rows = self.paragraphs.join(licences, "div_id", "left_anti")
        return search.grep(rows, q, search.search_limit(limit), ["path", "nth"], T.in_scope(F.col("path"), T.normal_scopes(scopes)), bound=search.GREP_BOUND)

    def order_paragraphs(self, path: str, file_rows: int = search.FILE_ROWS) -> search.Ordered:
        """Writes the paragraphs in their order; grep() then reads as much of them as it needs."""
        licences = self.divisions.where(T.is_licence(F.col("head"))).select(F.col("id").alias("div_id"), F.lit(True).alias("licence"))
        rows = self.paragraphs.join(licences, "div_id", "left").withColumn("licence", F.coalesce("licence", F.lit(False)))
        self.ordered = search.Ordered.write(rows, path, ("path", "nth"), file_rows)
        return self.ordered

    def leaf_texts(self, paths: list[str] | None = None) -> DataFrame:
        """id, path, head, lang, content of the divisions that full-text search knows: leaves with any text. paths: of these alone; only their paragraphs are put together."""
        own = tree.leaves(self.divisions).select("id", "path", "head", "lang")
        paragraphs = self.paragraphs
        if paths is not None:
            own = own.where(one_of(F.col("path"), paths))
            paragraphs = paragraphs.where(one_of(F.col("path"), paths))
        text = tree.joined_text(paragraphs, "div_id", "nth").withColumnRenamed("div_id", "id")
        return own.join(text, "id")

    def full_text(self, q: str, limit: int | None = None, scopes: list[str] | None = None) -> DataFrame:
        """Of a stored index where there is one, else of the texts themselves."""
        if self.index is not None:
            search.query_terms(q)
            hits = self.index.search(q, search.search_limit(limit), T.in_scope(F.col("key"), T.normal_scopes(scopes))).collect()  # the limit's rows, MAX_RESULTS at most
            found = self.divisions.sparkSession.createDataFrame([(r["key"], r["score"]) for r in hits], "path string, score double")
            docs = self.leaf_texts([r["key"] for r in hits])
            return F.broadcast(found).join(docs, "path").orderBy(F.desc("score"), "path")
        docs = self.leaf_texts()
        hits = search.bm25(docs, "path", q, search.search_limit(limit), F.col("content"), F.coalesce("head", F.lit("")), T.in_scope(F.col("path"), T.normal_scopes(scopes)))
        return hits.join(docs, "path").orderBy(F.desc("score"), "path")

    def by_vector(self, vector: list[float], limit: int = 20, scopes: list[str] | None = None) -> DataFrame:
        """Nearest stored texts by path and score; scopes hold before the limit, texts that are gone drop after it."""
        if self.vectors is None:
            raise RuntimeError("no vector store")
        stored = self.vectors.withColumn("path", T.url_path(F.col("url")))
        near = vectors.knn(stored, F.array(*map(F.lit, vector)), limit, "sha256", T.in_scope(F.col("path"), T.normal_scopes(scopes)))
        text = self.paragraphs.select("sha256", "path", "nth", "text").dropDuplicates(["sha256"])
        return near.join(text, "sha256").where(F.trim("text") != "").orderBy("distance", "sha256")

    def semantic(self, q: str, limit: int = 20, scopes: list[str] | None = None) -> DataFrame:
        return self.by_vector(self.embed(q), limit, scopes)

    def more_like(self, sha256: str, limit: int = 20) -> DataFrame:
        return vectors.more_like(self.vectors.withColumnRenamed("sha256", "vec_id"), sha256, limit, "vec_id", keep_self=True)

    # catalogue

    def works(self) -> DataFrame:
        """A row for each work and author; works without an author have one row."""
        own = self.divisions.where("parent_id is null").join(self.files.select(F.col("id").alias("file_id"), "repo", "filename"), "file_id", "left")
        return catalog.with_authors(own, self.bridge(), self.authors.select("id", "str_id", "first_name", "last_name", "display_name"), "left")

    def bridge(self) -> DataFrame:
        """file_id, author_id."""
        return self.files.select(F.col("id").alias("file_id"), "author_id").where("author_id is not null") if self.file_authors is None else self.file_authors.select("file_id", "author_id")

    def index_documents(self) -> DataFrame:
        """key, work, lang, head, content: what an index of this corpus holds."""
        work = F.array_join(F.slice(T.path_fragments(F.col("path")), 1, 2), "/")
        return self.leaf_texts().select(F.col("path").alias("key"), work.alias("work"), "lang", "head", "content")

    def works_page(self, q: str | None = None, lang: str | None = None, page: int = 1, size: int = 12) -> DataFrame:
        return search.page(self._works(q, lang), ["id"], page, size)

    def _works(self, q: str | None, lang: str | None) -> DataFrame:
        rows = self.works()
        if lang:
            rows = rows.where(F.col("lang") == lang)
        if q:
            rows = rows.where(T.like_ci(F.col("head"), q) | T.like_ci(F.col("str_id"), q) | T.like_ci(F.col("first_name"), q) | T.like_ci(F.col("last_name"), q))
        return rows

    def works_totals(self, q: str | None = None, lang: str | None = None, size: int = 12) -> DataFrame:
        return search.page_totals(self._works(q, lang), size)

    def authors_page(self, q: str | None = None, page: int = 1, size: int = 12) -> DataFrame:
        """Authors with a work."""
        rows = self.authors.join(self.works().select(F.col("author_id").alias("id")), "id", "left_semi")
        if q:
            rows = rows.where(T.like_ci(F.col("str_id"), q) | T.like_ci(F.col("first_name"), q) | T.like_ci(F.col("last_name"), q) | T.like_ci(F.col("display_name"), q))
        return search.page(rows, ["last_name", "first_name", "str_id"], page, size)

    def work_counts(self) -> DataFrame:
        n = self.works().groupBy(F.col("author_id").alias("id")).agg(F.count("*").alias("works"))
        return self.authors.select("id", "str_id").join(n, "id", "left").select("id", "str_id", F.coalesce("works", F.lit(0)).alias("works"))

    def by_language(self, lang: str, most: int = 200) -> DataFrame:
        return self.works().where(F.col("lang") == lang).orderBy("id").limit(most)

    def by_author(self, str_id: str, most: int = 200) -> DataFrame:
        return self.works().where(F.col("str_id") == str_id).orderBy("id").limit(most)

    def by_repo(self, repo: str, most: int = 200) -> DataFrame:
        return self.works().where(F.col("repo") == repo).orderBy("id").limit(most)

    def repos(self) -> DataFrame:
        return self.files.where("repo is not null").select("repo").distinct()

    def featured(self, paths: list[str]) -> DataFrame:
        listed = self.divisions.sparkSession.createDataFrame(list(enumerate(paths)), "place long, path string")
        return F.broadcast(listed).join(self.works(), "path").orderBy("place")

    def discover(self, n: int, seed: int = 0) -> DataFrame:
        """n works by a hash of seed and id: another seed, another choice."""
        if not 1 <= n <= 50:
            raise ValueError("1 to 50 works")
        return self.works().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(n)

    @staticmethod
    def like_example(rows: DataFrame, **values) -> DataFrame:
        """Rows that equal all given values that aren't None."""
        for k, v in values.items():
            if v is not None:
                rows = rows.where(F.col(k) == v)
        return rows

    # hierarchy

    def by_path(self, path: str) -> DataFrame:
        """The division at a path; where it has moved, the one that it moved to. The _N of an address is among paragraphs()."""
        want = T.canonical_path(F.lit(path))
        if self.relocations is None:
            return self.divisions.where(T.canonical_path(F.col("path")) == want)
        asked = self.divisions.sparkSession.range(1).select(want.alias("path"))
        to = relocate.resolved(self.relocations, asked).select(F.coalesce("target", "path").alias("_p"))
        return self.divisions.join(F.broadcast(to), T.canonical_path(F.col("path")) == F.col("_p"), "left_semi")

    def element(self, path: str) -> DataFrame:
        """The division at a path, or for an address that ends in _N its Nth element as a paragraph row."""
        import re

        m = re.match(r"(.*)/_(\d+)(?:\.\w+)?$", path)
        if not m:
            return self.by_path(path)
        div = self.by_path(m.group(1)).select(F.col("id").alias("div_id"))
        return self.paragraphs.where(F.col("nth") == int(m.group(2))).join(div, "div_id", "left_semi")

    def walk(self, addresses: DataFrame) -> DataFrame:
        """addresses (address) with code and id of what each leads to, all at once: see quire.operators.address. Ids of paragraphs are their division's and nth.
        _N counts divisions too where divisions have elem_nth."""
        parts = T.path_fragments(F.col("path"))
        nth = F.col("elem_nth") if "elem_nth" in self.divisions.columns else F.lit(0)
        works = self.divisions.where("parent_id is null").select(parts[0].alias("author"), parts[1].alias("slug"), F.col("id").cast("string").alias("id"))
        divs = self.divisions.where("parent_id is not null").select(F.col("id").cast("string").alias("id"), F.col("parent_id").cast("string").alias("parent_id"), F.element_at(parts, -1).alias("slug"), nth.alias("nth"), F.lit("div").alias("name"))
        own = self.paragraphs.select(F.concat_ws("/", "div_id", F.concat(F.lit("_"), "nth")).alias("id"), F.col("div_id").cast("string").alias("parent_id"), F.lit(None).cast("string").alias("slug"), "nth", F.lit("p").alias("name"))
        return address.walked(addresses, works, divs.unionAll(own))

    def at(self, path: str) -> DataFrame:
        """The one division at a path; ValueError for fewer than two segments, LookupError for none, RuntimeError for several."""
        if len([s for s in path.split("/") if s]) < 2:
            raise ValueError("a path has two segments at least")
        found = self.by_path(path)
        n = found.limit(2).count()
        if n != 1:
            raise RuntimeError(f"several divisions at {path}") if n else LookupError(f"nothing at {path}")
        return found

    def context(self, division) -> DataFrame:
        """A division with those before and after it in its work; ValueError if it is none of it."""
        root = self.divisions.where(F.col("id") == division).select("root_id")
        rows = self.divisions.join(F.broadcast(root.limit(1)), "root_id", "left_semi")
        return tree.member_neighbours(rows, "root_id", "pos", "id", division)

    def located(self, items: DataFrame, path: str = "path") -> DataFrame:
        """Items with the id and head of what is at their path."""
        return catalog.located(items, self.divisions, path)

    def authors_by_work(self) -> DataFrame:
        """A row for each work with all its authors."""
        return catalog.works_with_author_lists(self.works(), "id", ["path", "head", "lang", "filename"], ["str_id", "display_name"], "str_id")

    def toc(self, root_id) -> DataFrame:
        rows = self.divisions.where(F.col("root_id") == root_id)
        return tree.neighbours(rows, "root_id", "pos", "id").orderBy("pos")

    def page_of_paragraphs(self, root_id, offset: int = 0, limit: int = 20, licences: bool = False) -> DataFrame:
        divs = self.divisions.where(F.col("root_id") == root_id)
        if not licences:
            divs = divs.where(~T.is_licence(F.col("head")))
        rows = self.paragraphs.join(divs.select(F.col("id").alias("div_id"), "pos"), "div_id")
        return rows.orderBy("pos", "nth").offset(max(0, offset)).limit(min(max(1, limit), 2000))

    def random_leaf(self, seed: int = 0) -> DataFrame:
        own = tree.leaves(self.divisions).where(~T.is_licence(F.col("head")))
        return own.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(1)

    def to_vectorise(self, low: int = 20, high: int = 3000) -> DataFrame:
        """Paragraphs of a fitting length whose text isn't stored yet: one for each text."""
        own = self.paragraphs.where(F.length("text").between(low, high)).dropDuplicates(["sha256"])
        return own if self.vectors is None else own.join(self.vectors.select("sha256"), "sha256", "left_anti")


def prefixed(c: Column, model: str, query: bool) -> Column:
    return F.concat(F.lit(PREFIXES.get((model, query), "")), c)
