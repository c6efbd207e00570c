"""Scalar functions, set operations and the smaller operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.functions import xml
from quire.functions.shared import spread
from quire.operators import maintain, relocate, tree
from quire.operators import search as S
from quire.operators import vectors as V

from .registry import Tables, query
from .search import W, works


@query("SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 20")
def discover_sample(spark, d):
    return Tables(spark, d).documents.select("doc_id").orderBy(F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))), "doc_id").limit(20)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def query_by_example(spark, d):
    from quire.engine import Corpus

    return Corpus.like_example(Tables(spark, d).orders, o_orderstatus="O", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey")


@query("SELECT c_custkey AS id, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey > 3 LEFT JOIN region ON r_regionkey = n_regionkey")
def works_left_authors(spark, d):
    t = Tables(spark, d)
    n = F.broadcast(t.nation.where("n_nationkey > 3"))
    out = t.customer.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return out.select(F.col("c_custkey").alias("id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("SELECT p_partkey AS work, s_name AS author FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey")
def bridge_join_counts(spark, d):
    from quire.operators.catalog import with_authors

    works, of, authors = bridge(spark, d)
    return with_authors(works, of, authors).select(F.col("id").alias("work"), F.col("name").alias("author"))


def bridge(spark, d):
    """Parts as works, suppliers as authors, order lines as the bridge between them."""
    t = Tables(spark, d)
    works = t.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("file_id"), F.col("p_name").alias("head"))
    of = t.lineitem.select(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("author_id")).distinct()
    return works, of, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), "s_acctbal")


@query("SELECT conv_id, a.turn AS turn, b.turn AS next, b.role AS next_role FROM conversations a JOIN conversations b USING (conv_id) WHERE b.turn = a.turn + 1")
def sibling_self_join(spark, d):
    c = Tables(spark, d).conversations.select("conv_id", "turn", "role")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("next"), F.col("role").alias("next_role"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", "next", "next_role")


AGENTS = ("Mozilla/5.0 Chrome/120.0 Safari/537.36", "Mozilla/5.0 (compatible; Googlebot/2.1) Chrome/120", "curl/8.1", "Mozilla/5.0 Firefox/121.0", "Lynx/2.8", "", "Opera/9.8 OPR/70")


@query(f"""SELECT page_id, coalesce(trim(a) <> '' AND regexp_matches(a, '(?i)Chrome/|Chromium/|CriOS/|Edg/|OPR/|Firefox/|FxiOS/|Safari/') AND NOT regexp_matches(a, '(?i)bot|crawl|spider|curl|wget|python-requests|httpclient|okhttp|libwww|lynx|links|w3m|postman|axios|go-http-client|java/'), FALSE) AS modern
FROM (SELECT page_id, CASE WHEN page_id % 8 < 7 THEN [{', '.join(repr(a) for a in AGENTS)}][1 + page_id % 8] END AS a FROM pages)""")
def user_agent_filter(spark, d):
    agents = F.array(*map(F.lit, AGENTS))
    agent = F.try_element_at(agents, (F.col("page_id") % 8 + 1).cast("int"))
    return Tables(spark, d).pages.select("page_id", T.is_modern_browser(agent).alias("modern"))


@query("SELECT DISTINCT sha256(text) AS sha FROM conversations WHERE length(text) BETWEEN 20 AND 3000")
def vectorise_window(spark, d):
    return Tables(spark, d).conversations.where(F.length("text").between(20, 3000)).select(F.sha2("text", 256).alias("sha")).distinct()


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END AS label FROM embeddings UNION ALL SELECT 1000000 + vec_id, label FROM embeddings WHERE vec_id % 50 = 0")
def embedding_upsert(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", "label")
    old = e.where("vec_id % 3 = 0").select("vec_id", F.lit(-1).alias("label"), F.lit(1).alias("seq"))
    new = e.where("vec_id % 3 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("seq"))
    more = e.where("vec_id % 50 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), "label", F.lit(1).alias("seq"))
    return V.upserted(e, old.unionAll(new).unionAll(more), "vec_id")


@query("SELECT d.doc_id, e.label FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE doc_id IN (3, 5, 8))")
def find_by_sha(spark, d):
    t = Tables(spark, d)
    docs = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    return docs.join(F.broadcast(docs.where("doc_id in (3, 5, 8)").select("sha").distinct()), "sha", "left_semi").join(t.embeddings, F.col("vec_id") == F.col("doc_id")).select("doc_id", "label")


@query("SELECT vec_id, label, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE) * 2, 6)) AS embedding FROM embeddings")
def reembed_collection(spark, d):
    again = V.reembedded(Tables(spark, d).embeddings, F.transform("embedding", lambda x: T.rounded(x.cast("double") * 2, 6)))
    return again.select("vec_id", "label", "embedding")


@query("""WITH l AS (SELECT 'p' || doc_id AS old, 'p' || (doc_id + 1000000) AS new, doc_id FROM documents), m AS (SELECT 'p' || (doc_id + 1000000) AS old, 'q' || doc_id AS new FROM documents WHERE doc_id % 2 = 0)
SELECT l.old, coalesce(m.new, l.new) AS new FROM l LEFT JOIN m ON m.old = l.new WHERE doc_id % 10 <> 3 UNION ALL SELECT old, new FROM m""")
def relocation_repoint(spark, d):
    i, docs = F.col("doc_id"), Tables(spark, d).documents
    name = lambda p, c: F.concat(F.lit(p), c)
    earlier = docs.select(name("p", i).alias("old"), name("p", i + 1000000).alias("new"), F.lit("MOVED").alias("reason"))
    moves = docs.where(i % 2 == 0).select(name("p", i + 1000000).alias("old"), name("q", i).alias("new"), F.lit("MOVED").alias("reason"))
    return relocate.repointed(earlier, moves, docs.where(i % 10 == 3).select(name("p", i).alias("path"))).select("old", "new")


@query("SELECT s_suppkey AS id, split_part(s_name, '#', 2) AS last, split_part(s_name, '#', 1) AS first FROM supplier")
def author_name_parse(spark, d):
    name = F.concat_ws(" ", F.split("s_name", "#"))
    p = T.parsed_name(F.when(F.col("s_suppkey") % 2 == 0, name).otherwise(F.concat_ws(" , ", F.reverse(F.split("s_name", "#")))))
    return Tables(spark, d).supplier.select(F.col("s_suppkey").alias("id"), p["last"].alias("last"), p["first"].alias("first"))


@query(f"WITH {W}, s AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS q FROM w) SELECT doc_id, CASE WHEN length(q) > 280 THEN substr(q, 1, 280) || '…' ELSE q END AS preview FROM s")
def text_preview(spark, d):
    return works(Tables(spark, d).documents).select("doc_id", T.preview(F.col("text")).alias("preview"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS safe FROM pages")
def xml_escape(spark, d):
    return Tables(spark, d).pages.select("page_id", T.escape_xml(F.col("html")).alias("safe"))


COVER = "title author editor translator pubPlace date isbn series volume genre edition_notice subtitle tagline_quote language publisher".split()


@query("""SELECT p_partkey AS id, p_name AS title, p_brand AS author, 'E' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE '' END AS editor, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE '' END AS translator, 'Town ' || p_partkey AS "pubPlace",
'19' || (p_partkey % 100) AS date, 'isbn-' || p_partkey AS isbn, p_type AS series, CAST(p_partkey % 9 AS VARCHAR) AS volume, 'novel' || CASE WHEN p_partkey % 2 = 0 THEN 'verse' ELSE '' END AS genre, 'Edition of ' AS edition_notice,
CASE WHEN p_partkey % 4 = 0 THEN 'sub ' || p_partkey ELSE '' END AS subtitle, 'to ' || p_type AS tagline_quote, CASE WHEN p_partkey % 5 > 0 THEN 'ro' ELSE '' END AS language, 'Biblioteca' AS publisher FROM part""")
def cover_metadata(spark, d):
    k = F.col("p_partkey")
    when = lambda m, text: F.when(k % m == 0, text).otherwise("")
    header = F.concat(
        F.lit('<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><editor>E'), k, F.lit("</editor>"), when(2, "<editor role='editor'>F</editor>"), when(3, F.concat(F.lit("<editor role='translator'>"), "p_brand", F.lit("</editor>"))),
        F.lit("</titleStmt><editionStmt><edition>Edition of <date>19"), k % 100, F.lit("</date></edition></editionStmt><publicationStmt><pubPlace>Town "), k, F.lit("</pubPlace></publicationStmt><seriesStmt><title>"), "p_type",
        F.lit("</title><biblScope unit='page'>1</biblScope><biblScope unit='volume'>"), k % 9, F.lit("</biblScope></seriesStmt><sourceDesc><bibl><idno type='ISBN'>isbn-"), k, F.lit("</idno><idno>other</idno></bibl></sourceDesc></fileDesc><profileDesc><textClass><keywords><term>novel</term>"),
        when(2, "<term>verse</term>"), F.lit("</keywords></textClass></profileDesc></teiHeader></TEI>"),
    )
    work = F.concat(F.lit("<div xmlns='http://www.tei-c.org/ns/1.0'>"), when(4, F.concat(F.lit("<subtitle>sub "), k, F.lit("</subtitle>"))), F.lit("<epigraph><p>to "), "p_type", F.lit("</p></epigraph><div><epigraph>inner</epigraph></div></div>"))
    m = xml.book_metadata(header, work, F.col("p_name"), F.col("p_brand"), F.when(k % 5 > 0, "ro"))
    return spread(Tables(spark, d).part).select(k.alias("id"), m.alias("m")).select("id", *(F.col("m")[c].alias(c) for c in COVER))


@query("SELECT source FROM documents WHERE lang = 'fr' INTERSECT SELECT source FROM documents WHERE lang = 'de'")
def languages_in_both(spark, d):
    docs = Tables(spark, d).documents
    return docs.where("lang = 'fr'").select("source").intersect(docs.where("lang = 'de'").select("source"))


@query("""WITH b AS (SELECT '/' || source || '/d' || doc_id AS path, doc_id FROM documents), a AS (SELECT path FROM b WHERE doc_id % 5 <> 0), m AS (SELECT path AS old, CASE WHEN doc_id % 10 = 0 THEN 'MOVED' ELSE 'PARENT' END AS reason FROM b WHERE doc_id % 5 = 0 AND doc_id % 15 <> 0)
SELECT count(*) FILTER (reason = 'MOVED') AS moved, count(*) FILTER (reason = 'PARENT') AS parent, (SELECT count(*) FROM b WHERE doc_id % 15 = 0) AS unrecognised,
(SELECT count(*) FROM b WHERE doc_id % 4 = 0 AND doc_id % 5 = 0 AND doc_id % 15 <> 0) AS repointed, (SELECT count(*) FROM a JOIN b USING (path) WHERE doc_id % 7 = 0) AS dropped, (SELECT count(*) FROM b JOIN labels USING (doc_id) JOIN m ON old = path) AS "references" FROM m""")
def outcome_counters(spark, d):
    from quire.operators.catalog import outcome

    t, i = Tables(spark, d), F.col("doc_id")
    b = t.documents.select("doc_id", F.concat(F.lit("/"), "source", F.lit("/d"), "doc_id").alias("path"))
    moves = b.where((i % 5 == 0) & (i % 15 != 0)).select(F.col("path").alias("old"), F.concat(F.lit("/new"), "path").alias("new"), F.when(i % 10 == 0, "MOVED").otherwise("PARENT").alias("reason"))
    earlier = b.where(i % 4 == 0).select(F.concat(F.lit("/was"), "path").alias("old"), F.col("path").alias("new")).unionAll(b.where(i % 7 == 0).select(F.col("path").alias("old"), F.lit("/x").alias("new")))
    return outcome(b, b.where(i % 5 != 0), earlier, moves, b.join(t.labels, "doc_id").select("path"))


@query("SELECT c_custkey AS id, least(greatest(c_acctbal / 10000, 0), 1) AS fraction, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_name END AS kept FROM customer")
def clamp_and_clear(spark, d):
    name = maintain.without_image_data(F.when(F.col("c_acctbal") < 0, F.lit("iVBORw0KGgoAAA")).otherwise(F.col("c_name")))
    return Tables(spark, d).customer.select(F.col("c_custkey").alias("id"), T.clamp(F.col("c_acctbal") / 10000, 0, 1).alias("fraction"), name.alias("kept"))


@query(f"""WITH {W} SELECT '/' || lang || '/' || source || '/doc_' || doc_id || '.txt' AS path, TRUE AS is_file, sha256(text) AS digest FROM w
UNION ALL SELECT DISTINCT '/' || lang, FALSE, CAST(NULL AS VARCHAR) FROM w UNION ALL SELECT DISTINCT '/' || lang || '/' || source, FALSE, CAST(NULL AS VARCHAR) FROM w""")
def export_tree(spark, d):
    w = works(Tables(spark, d).documents).select("lang", F.col("source").alias("author"), F.concat(F.lit("doc_"), "doc_id").alias("name"), F.sha2("text", 256).alias("digest"))
    return tree.virtual(w, ["lang", "author"], "name", ["digest"])


@query("SELECT doc_id, n FROM (SELECT doc_id, (length(text) - length(replace(lower(text), 'the', ''))) / 3 AS k, CAST(len(string_split(lower(text), 'the')) - 1 AS BIGINT) AS n FROM documents) WHERE n > 20 ORDER BY n DESC, doc_id LIMIT 15")
def occurrences_topk(spark, d):
    n = (F.size(F.split(F.lower("text"), "the")) - 1).cast("long")
    return S.top(Tables(spark, d).documents.select("doc_id", n.alias("n")).where("n > 20"), "n", "doc_id", 15)


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(replace(strip_accents(lower(text)), 'ß', 'ss'), '[\\p{L}\\p{N}]+'), lambda w: NOT list_contains(string_split('der die das und ist nicht ein eine zu den mit sich auf von', ' '), w)) AS a FROM documents WHERE lang = 'de')
SELECT doc_id, CAST(len(a) AS BIGINT) AS terms, CAST(len(list_distinct(list_transform(a, lambda w: regexp_replace(w, '^(.{4,}?)(?:ungen|keiten|heiten|ung|keit|heit|lich|isch|en|er|es|em|e|n|s)$', '\\1')))) AS BIGINT) AS stems FROM t""")
def language_analyzer(spark, d):
    from quire.functions.analyze import analyzed

    a = Tables(spark, d).documents.where("lang = 'de'").select("doc_id", F.explode(F.array(analyzed(F.col("text"), "de"))).alias("a"))
    return a.select("doc_id", F.size("a").cast("long").alias("terms"), F.size(F.array_distinct("a")).cast("long").alias("stems"))
