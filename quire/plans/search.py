"""Search over documents: a work is a document, its head the first line, its path source/doc_<id>, its paragraphs the lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import search as S
from quire.operators import tree
from quire.operators import vectors as V

from .registry import Tables, query

Q = "with nicht from"


def works(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang", "source", F.split("text", "\n")[0].alias("head"), F.concat("source", F.lit("/doc_"), F.col("doc_id")).alias("path"))


W = "w AS (SELECT doc_id, text, lang, source, split_part(text, chr(10), 1) AS head, source || '/doc_' || doc_id AS path FROM documents)"
P = "p AS (SELECT doc_id, path, lang, nth, line AS text FROM (SELECT doc_id, path, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS nth FROM w))"


def fold(c: str) -> str:
    return f"replace(strip_accents(lower({c})), 'ß', 'ss')"


def scored(field: str, name: str, terms: str = Q) -> str:
    quoted = ", ".join(f"'{t}'" for t in terms.split())
    return f"""{name}_t AS (SELECT doc_id, regexp_extract_all({fold(field)}, '[\\p{{L}}\\p{{N}}]+') AS a FROM w),
{name}_l AS (SELECT doc_id, len(a) AS len, a FROM {name}_t WHERE len(a) > 0),
{name}_s AS (SELECT count(*) AS n, avg(len) AS mean FROM {name}_l),
{name}_f AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len, unnest(a) AS term FROM {name}_l) WHERE term IN ({quoted}) GROUP BY ALL),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY term),
{name} AS (SELECT doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))) AS score
    FROM {name}_f JOIN {name}_d USING (term), {name}_s GROUP BY doc_id)"""


@query(f"WITH {W}, {scored('text', 'b')} SELECT doc_id, round(score, 6) AS score FROM b ORDER BY b.score DESC, doc_id LIMIT 10")
def search_bm25_topk(spark, d):
    return S.bm25(works(Tables(spark, d).documents), "doc_id", Q, 10, F.col("text")).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {W}, {scored('text', 'b')} SELECT doc_id, round(score, 6) AS score FROM b JOIN w USING (doc_id) WHERE path = 'src3/doc_3' OR starts_with(path, 'src3/doc_1') AND source = 'src3' AND path = 'src3/doc_123' OR lang = 'de' ORDER BY b.score DESC, doc_id LIMIT 10")
def search_bm25_scoped(spark, d):
    w = works(Tables(spark, d).documents)
    scope = T.in_scope(F.col("path"), T.normal_scopes(["/src3/doc_3/", "src3/doc_123"])) | (F.col("lang") == "de")
    return S.bm25(w, "doc_id", Q, 10, F.col("text"), where=scope).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {W}, {scored('text', 'b', 'the and')}, {scored('head', 'h', 'the and')}
SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT * FROM b UNION ALL SELECT doc_id, 3 * score FROM h) GROUP BY doc_id ORDER BY sum(score) DESC, doc_id LIMIT 20""")
def search_bm25_boosted_head(spark, d):
    return S.bm25(works(Tables(spark, d).documents), "doc_id", "the and", 20, F.col("text"), F.col("head")).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {W}, {scored('text', 'b', 'nicht')} SELECT lang, doc_id, score, rank FROM (
SELECT lang, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) AS rank FROM b JOIN w USING (doc_id)) WHERE rank <= 5""")
def search_bm25_by_language(spark, d):
    w = works(Tables(spark, d).documents)
    s = S.field_scores(w, "doc_id", F.col("text"), ["nicht"]).join(w.select("doc_id", "lang"), "doc_id")
    return S.ranked(s, ["lang"], F.desc("score"), F.asc("doc_id")).where("rank <= 5").select("lang", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(f"WITH {W} SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all({fold('text')}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM w) GROUP BY ALL) GROUP BY term")
def fulltext_postings(spark, d):
    _, postings = S.field_postings(works(Tables(spark, d).documents), "doc_id", F.col("text"))
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def lines(w: DataFrame) -> DataFrame:
    return w.select("doc_id", "path", "lang", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", "path", "lang", (F.col("n") + 1).cast("long").alias("nth"), F.col("line").alias("text"))


@query(f"WITH {W}, {P} SELECT doc_id, nth, text FROM p WHERE contains(lower(text), 'mit license') ORDER BY doc_id, nth LIMIT 25")
def search_grep_lines(spark, d):
    return S.grep(lines(works(Tables(spark, d).documents)), "MIT License", 25, ["doc_id", "nth"]).select("doc_id", "nth", "text")


@query(f"WITH {W}, {P}, q AS (SELECT * FROM p ORDER BY doc_id, nth LIMIT {S.GREP_BOUND}) SELECT doc_id, nth, text FROM q WHERE contains(lower(text), 'the of') ORDER BY doc_id, nth LIMIT 10")
def search_grep_bounded(spark, d):
    return S.grep(lines(works(Tables(spark, d).documents)), "the of", 10, ["doc_id", "nth"], bound=S.GREP_BOUND).select("doc_id", "nth", "text")


@query(f"WITH {W} SELECT doc_id, head FROM w WHERE lower(head) LIKE '%the%' AND lang = 'en' ORDER BY doc_id LIMIT 30")
def search_heads_like(spark, d):
    return works(Tables(spark, d).documents).where(T.like_ci(F.col("head"), "The") & (F.col("lang") == "en")).orderBy("doc_id").limit(30).select("doc_id", "head")


@query("SELECT * FROM (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE lower(s_name) LIKE '%7%' UNION SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 3 UNION SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 9000) ORDER BY id LIMIT 40")
def search_authors_union(spark, d):
    s = Tables(spark, d).supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_nationkey", "s_acctbal")
    parts = [s.where(T.like_ci(F.col("name"), "7")), s.where("s_nationkey < 3"), s.where("s_acctbal > 9000")]
    return S.union_by_key([p.select("id", "name") for p in parts], "id").orderBy("id").limit(40)


@query(f"WITH {W} SELECT doc_id, path FROM w WHERE path = 'src1/doc_21' OR starts_with(path, 'src1/doc_21/') OR path = 'src4/doc_4' OR starts_with(path, 'src4/doc_4/')")
def scope_normalize_match(spark, d):
    scopes = T.normal_scopes([" /src1/doc_21/ ", "src4/doc_4", "src1/doc_21", ""])
    return works(Tables(spark, d).documents).where(T.in_scope(F.concat(F.lit("/"), "path", F.lit(".txt")), scopes)).select("doc_id", "path")


@query("SELECT page_id, '/' || regexp_replace(array_to_string(list_filter(string_split(regexp_replace(url, '[?#].*$', ''), '/'), lambda x: x <> ''), '/'), '\\.[^./]*$', '') AS path FROM pages")
def canonical_paths(spark, d):
    return Tables(spark, d).pages.select("page_id", T.canonical_path(F.col("url")).alias("path"))


@query("SELECT page_id, '/' || regexp_replace(split_part(regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', ''), '.', 1), '^/+', '') AS path, regexp_extract(url, '^([a-z]+)://([^:/?#]+)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^:/?#]+)', 2) AS host FROM pages")
def url_path_of(spark, d):
    e = T.endpoint(F.col("url"))
    return Tables(spark, d).pages.select("page_id", T.url_path(F.col("url")).alias("path"), e["scheme"].alias("scheme"), e["host"].alias("host"))


QV = "(SELECT embedding AS q FROM embeddings WHERE vec_id = 7)"
DIST = "round(array_distance(CAST(embedding AS DOUBLE[64]), CAST(q AS DOUBLE[64])), 6)"


def vector(spark, d, i: int):
    e = Tables(spark, d).embeddings
    return e.crossJoin(F.broadcast(e.where(F.col("vec_id") == i).select(F.col("embedding").alias("q"))))


@query(f"SELECT vec_id, {DIST} AS distance FROM embeddings, {QV} ORDER BY {DIST}, vec_id LIMIT 10")
def vector_knn(spark, d):
    return V.more_like(Tables(spark, d).embeddings, 7, 10, keep_self=True).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, {DIST} AS distance FROM embeddings, {QV} WHERE label = 2 ORDER BY {DIST}, vec_id LIMIT 10")
def vector_knn_scoped(spark, d):
    return V.knn(vector(spark, d, 7), F.col("q"), 10, where=F.col("label") == 2).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"SELECT vec_id, {DIST} AS distance FROM embeddings, {QV} WHERE vec_id <> 7 ORDER BY {DIST}, vec_id LIMIT 20")
def vector_more_like_this(spark, d):
    return V.more_like(Tables(spark, d).embeddings, 7, 20).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT query, key, distance, rank FROM (SELECT a.vec_id AS query, b.vec_id AS key, round(array_distance(CAST(a.embedding AS DOUBLE[64]), CAST(b.embedding AS DOUBLE[64])), 6) AS distance,
row_number() OVER (PARTITION BY a.vec_id ORDER BY array_distance(CAST(a.embedding AS DOUBLE[64]), CAST(b.embedding AS DOUBLE[64])), b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) WHERE rank <= 5""")
def vector_knn_join_all(spark, d):
    e = Tables(spark, d).embeddings
    return V.knn_join(e.where("vec_id % 20 = 0"), e, 5).select("query", "key", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query(f"SELECT vec_id, {DIST} AS distance, length(text) AS chars FROM embeddings JOIN documents ON doc_id = vec_id, {QV} WHERE length(text) >= 150 ORDER BY {DIST}, vec_id LIMIT 10")
def vector_min_length_filter(spark, d):
    v = vector(spark, d, 7).join(Tables(spark, d).documents, F.col("doc_id") == F.col("vec_id")).where(F.length("text") >= 150)
    near = V.knn(v, F.col("q"), 10)
    return near.join(v.select("vec_id", F.length("text").cast("long").alias("chars")), "vec_id").select("vec_id", F.round("distance", 6).alias("distance"), "chars")


DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(q[i] AS DOUBLE)))"


@query(f"""WITH {W}, {scored('text', 'b', 'the')}, v AS (SELECT vec_id AS doc_id, {DOT} AS score FROM embeddings, {QV})
SELECT doc_id, round(sum(score), 6) AS score FROM (SELECT doc_id, score FROM v UNION ALL SELECT doc_id, 0.3 * score FROM b) GROUP BY doc_id ORDER BY sum(score) DESC, doc_id LIMIT 10""")
def hybrid_weighted_fusion(spark, d):
    dense = vector(spark, d, 7).select(F.col("vec_id").alias("doc_id"), T.dot(F.col("embedding"), F.col("q")).alias("score"))
    words = S.field_scores(works(Tables(spark, d).documents), "doc_id", F.col("text"), ["the"])
    return S.top(V.fused([(dense, 1.0), (words, 0.3)], "doc_id"), "score", "doc_id", 10).select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {W}, {scored('text', 'b', 'the')}, v AS (SELECT vec_id AS doc_id, {DIST} AS far FROM embeddings, {QV}),
r AS (SELECT doc_id, row_number() OVER (ORDER BY far, doc_id) AS rank FROM v UNION ALL SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) FROM b)
SELECT doc_id, round(sum(1 / (60 + rank)), 8) AS score FROM r WHERE rank <= 50 GROUP BY doc_id ORDER BY round(sum(1 / (60 + rank)), 8) DESC, doc_id LIMIT 10""")
def hybrid_rrf(spark, d):
    near = V.knn(vector(spark, d, 7), F.col("q"), 50).select(F.col("vec_id").alias("doc_id"), F.round("distance", 6).alias("far"))
    words = S.top(S.field_scores(works(Tables(spark, d).documents), "doc_id", F.col("text"), ["the"]), "score", "doc_id", 50)
    one = F.row_number().over(Window.orderBy("far", "doc_id"))  # over the 50 rows of a top-k
    two = F.row_number().over(Window.orderBy(F.desc("score"), "doc_id"))
    out = V.reciprocal_ranks([near.select("doc_id", one.alias("rank")), words.select("doc_id", two.alias("rank"))], "doc_id")
    return S.top(out.select("doc_id", F.round("score", 8).alias("score")), "score", "doc_id", 10)


J = f"""j AS (SELECT a.vec_id AS query, b.vec_id AS key, CAST(a.label = b.label AS INT) AS relevant,
row_number() OVER (PARTITION BY a.vec_id ORDER BY array_distance(CAST(a.embedding AS DOUBLE[64]), CAST(b.embedding AS DOUBLE[64])), b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
m AS (SELECT query, sum(relevant) FILTER (rank <= 10) / 10 AS precision, sum(relevant / log2(rank + 1)) FILTER (rank <= 10) AS dcg, min(rank) FILTER (relevant = 1) AS first, least(sum(relevant), 10) AS ideal FROM j GROUP BY query)"""
IDEAL = "list_sum(list_transform(range(1, CAST(ideal AS BIGINT) + 1), lambda r: 1 / log2(r + 1)))"


def rankings(spark, d) -> DataFrame:
    """query, precision, ndcg, rr: the ten nearest of each query, how many are relevant at all, and the rank of the first relevant one."""
    e = Tables(spark, d).embeddings
    return V.judged_neighbours(e.where("vec_id % 20 = 0"), e, "label")


@query(f"WITH {J} SELECT round(avg(precision), 6) AS precision_at_10 FROM m")
def ir_precision_at_10(spark, d):
    return rankings(spark, d).agg(F.round(F.avg("precision"), 6).alias("precision_at_10"))


@query(f"WITH {J} SELECT round(avg(coalesce(dcg / {IDEAL}, 0)), 6) AS ndcg_at_10 FROM m")
def ir_ndcg_at_10(spark, d):
    return rankings(spark, d).agg(F.round(F.avg("ndcg"), 6).alias("ndcg_at_10"))


@query(f"WITH {J} SELECT round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM m")
def ir_mrr(spark, d):
    return rankings(spark, d).agg(F.round(F.avg("rr"), 6).alias("mrr"))


@query("""WITH t AS (SELECT doc_id, term, max(1 / sqrt(pos)) AS weight FROM (SELECT doc_id, unnest(a) AS term, unnest(range(1, len(a) + 1)) AS pos FROM (SELECT doc_id, regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\\p{L}\\p{N}]+') AS a FROM documents)) GROUP BY ALL)
SELECT doc_id, round(sum(weight * CASE term WHEN 'the' THEN 0.5 WHEN 'nicht' THEN 2.0 ELSE 1.0 END), 6) AS score FROM t WHERE term IN ('the', 'nicht', 'pour') GROUP BY doc_id""")
def sparse_dot_score(spark, d):
    docs = Tables(spark, d).documents
    weights = docs.select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term")).select("doc_id", "term", (1 / F.sqrt(F.col("pos") + 1)).alias("weight"))
    return V.sparse_scores(weights, {"the": 0.5, "nicht": 2.0, "pour": 1.0}, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT vec_id, [embedding[1:16], embedding[17:32], embedding[33:48], embedding[49:64]] AS m FROM embeddings), q AS (SELECT m AS qm FROM v WHERE vec_id = 7)
SELECT vec_id, round(list_sum(list_transform(qm, lambda x: list_max(list_transform(m, lambda y: list_sum(list_transform(range(1, 17), lambda i: CAST(x[i] AS DOUBLE) * CAST(y[i] AS DOUBLE))))))) / 4, 6) AS score FROM v, q""")
def maxsim_score(spark, d):
    e = Tables(spark, d).embeddings
    m = F.array(*(F.slice("embedding", 16 * i + 1, 16) for i in range(4)))
    v = e.select("vec_id", m.alias("m"))
    q = F.broadcast(v.where("vec_id = 7").select(F.col("m").alias("qm")))
    return v.crossJoin(q).select("vec_id", F.round(V.maxsim(F.col("qm"), F.col("m")), 6).alias("score"))


@query(f"WITH {W}, {P} SELECT doc_id, nth, text FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nth) AS n FROM p) WHERE n > 2 AND n <= 5")
def paragraphs_page(spark, d):
    return tree.slice_of(tree.paragraphs(Tables(spark, d).documents, "doc_id"), ["doc_id"], "nth", 2, 3).select("doc_id", F.col("nth").cast("long").alias("nth"), "text")
