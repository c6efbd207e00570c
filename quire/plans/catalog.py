"""Catalogue, hierarchy, fragments, relocation, maintenance and state over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import fragments, maintain, relocate, state, tree
from quire.operators import search as S

from .registry import Tables, query
from .search import P, W, lines, works

L = lambda c: F.col(c).cast("long").alias(c)


@query("SELECT o_orderkey AS id, c_name AS author, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND (lower(c_name) LIKE '%9%' OR lower(o_orderpriority) LIKE '%9%') ORDER BY id LIMIT 12 OFFSET 12")
def catalog_works_page(spark, d):
    t = Tables(spark, d)
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).where("o_orderstatus = 'F'")
    rows = rows.where(T.like_ci(F.col("c_name"), "9") | T.like_ci(F.col("o_orderpriority"), "9"))
    return S.page(rows.select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("author"), F.col("o_orderstatus").alias("status")), ["id"], 2, 12)


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AND lower(c_name) LIKE '%1%' ORDER BY c_mktsegment, c_name, id LIMIT 10 OFFSET 20")
def catalog_authors_page(spark, d):
    t = Tables(spark, d)
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").where(T.like_ci(F.col("c_name"), "1"))
    return S.page(rows, ["c_mktsegment", "c_name", "c_custkey"], 3, 10).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("SELECT count(*) AS total_items, CAST(ceil(count(*) / 12.0) AS BIGINT) AS total_pages FROM documents WHERE lang = 'en'")
def catalog_page_totals(spark, d):
    return S.page_totals(Tables(spark, d).documents.where("lang = 'en'"), 12)


@query("SELECT c_custkey AS id, count(o_orderkey) AS works FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 400000 GROUP BY c_custkey")
def works_count_per_author(spark, d):
    t = Tables(spark, d)
    n = t.orders.where("o_totalprice > 400000").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("works"))
    return t.customer.select(F.col("c_custkey").alias("id")).join(n, "id", "left").select("id", F.coalesce("works", F.lit(0).cast("long")).alias("works"))


@query("SELECT lang, count(*) AS works, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def works_by_language(spark, d):
    return Tables(spark, d).documents.groupBy("lang").agg(F.count("*").alias("works"), F.sum("n_chars").alias("chars"))


@query("SELECT source AS repo, count(*) AS works, min(doc_id) AS first FROM documents GROUP BY source")
def works_by_repo(spark, d):
    return Tables(spark, d).documents.groupBy(F.col("source").alias("repo")).agg(F.count("*").alias("works"), F.min("doc_id").alias("first"))


@query("SELECT DISTINCT source AS repo FROM documents WHERE source IS NOT NULL")
def repo_names(spark, d):
    return Tables(spark, d).documents.where("source is not null").select(F.col("source").alias("repo")).distinct()


FEATURED = (77, 3, 512, 48, 9, 123456789, 230)


@query(f"WITH f AS (SELECT CAST(unnest([{', '.join(map(str, FEATURED))}]) AS BIGINT) AS doc_id, unnest(range(0, {len(FEATURED)})) AS place), {W} SELECT place, doc_id, path FROM f JOIN w USING (doc_id)")
def featured_in_order(spark, d):
    listed = spark.createDataFrame([(i, p) for p, i in enumerate(FEATURED)], "doc_id long, place long")
    return works(Tables(spark, d).documents).join(F.broadcast(listed), "doc_id").select("place", "doc_id", "path")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def authors_with_works_semi(spark, d):
    t = Tables(spark, d)
    return t.documents.join(t.labels, "doc_id", "left_semi").select("doc_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def authors_orphaned_anti(spark, d):
    t = Tables(spark, d)
    return maintain.removed(t.documents, t.labels, "doc_id").select("doc_id")


@query("SELECT id, file_id FROM (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN -doc_id - 1 ELSE doc_id END AS file_id FROM documents) r LEFT JOIN (SELECT doc_id FROM documents) f ON file_id = doc_id WHERE doc_id IS NULL")
def orphan_opera_nullsafe(spark, d):
    docs = Tables(spark, d).documents.select("doc_id")
    file_id = F.when(F.col("doc_id") % 10 == 0, None).when(F.col("doc_id") % 7 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return maintain.orphans(docs.select(F.col("doc_id").alias("id"), file_id.alias("file_id")), docs, "file_id", "doc_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def elems_without_file(spark, d):
    t = Tables(spark, d)
    kept = t.orders.where("o_orderstatus = 'F'")
    return maintain.orphans(t.lineitem, kept, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("""SELECT p AS path, coalesce(n_name, p) AS name, list(u ORDER BY o) AS urls FROM (SELECT p, u, min(o) AS o FROM (SELECT 'n' || (s_nationkey + 3) AS p, s_suppkey AS o, 'http://m/' || (s_suppkey % 40) || '.png' AS u FROM supplier) GROUP BY p, u)
LEFT JOIN nation ON 'n' || n_nationkey = p GROUP BY ALL""")
def author_media_left(spark, d):
    from quire.operators.catalog import media_of

    t = Tables(spark, d)
    media = t.supplier.select(F.concat(F.lit("n"), F.col("s_nationkey") + 3).alias("path"), F.concat(F.lit("http://m/"), F.col("s_suppkey") % 40, F.lit(".png")).alias("url"), "s_suppkey")
    authors = t.nation.select(F.concat(F.lit("n"), "n_nationkey").alias("str_id"), F.col("n_name").alias("display_name"))
    return media_of(authors, media, "str_id", "path", "url", "s_suppkey")


@query("SELECT i AS place, CAST(k AS BIGINT) AS id, p_name AS name FROM (SELECT unnest([5, 1, 99, 5, 42]) AS k, unnest(range(0, 5)) AS i) JOIN part ON p_partkey = k")
def in_list_key_order(spark, d):
    keys = spark.range(1).select(F.posexplode(F.array(*map(F.lit, (5, 1, 99, 5, 42)))).alias("place", "id"))
    part = Tables(spark, d).part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return F.broadcast(keys).join(part, "id").select(L("place"), L("id"), "name")


NAMES = """a AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'Nume' || (s_suppkey % 20) || ', Ána' WHEN s_suppkey % 3 = 1 THEN 'ana  NUME' || (s_suppkey % 20) ELSE 'Ana-Nume' || (s_suppkey % 20) END AS original_name FROM supplier),
k AS (SELECT id, original_name, array_to_string(list_sort(string_split_regex(trim(regexp_replace(strip_accents(lower(original_name)), '[^a-z0-9]+', ' ', 'g')), ' +')), ' ') AS key FROM a)"""


def spelled(spark, d) -> DataFrame:
    n = (F.col("s_suppkey") % 20).cast("string")
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Nume"), n, F.lit(", Ána"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("ana  NUME"), n)).otherwise(F.concat(F.lit("Ana-Nume"), n))
    return Tables(spark, d).supplier.select(F.col("s_suppkey").alias("id"), name.alias("original_name"), F.col("s_acctbal"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_name")).alias("bio"))


@query(f"WITH {NAMES} SELECT key, count(*) AS n, list(id ORDER BY id) AS ids FROM k GROUP BY key HAVING count(*) > 1")
def name_variant_groups(spark, d):
    return maintain.variants(spelled(spark, d))


@query(f"WITH {NAMES}, n AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1) SELECT key, arg_min(id, (-coalesce(n, 0), id)) AS id, max(coalesce(n, 0)) AS n_files FROM k LEFT JOIN n USING (id) GROUP BY key")
def canonical_pick(spark, d):
    n = Tables(spark, d).lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("n"))
    keyed = spelled(spark, d).withColumn("key", T.name_key(F.col("original_name"))).join(n, "id", "left").select("id", "key", F.coalesce("n", F.lit(0)).alias("n_files"))
    return maintain.canonical(keyed, "key", "n_files").select("key", "id", L("n_files"))


@query(f"""WITH {NAMES}, n AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT key, arg_min(id, (-coalesce(n, 0), id)) AS target FROM k LEFT JOIN n USING (id) GROUP BY key),
b AS (SELECT id, target, CASE WHEN s_suppkey % 4 > 0 THEN s_name END AS bio FROM k JOIN c USING (key) JOIN supplier ON s_suppkey = id)
SELECT target AS id, coalesce(max(bio) FILTER (id = target), arg_min(bio, id) FILTER (bio IS NOT NULL AND id <> target)) AS bio FROM b GROUP BY target""")
def author_merge_result(spark, d):
    authors = spelled(spark, d)
    moves = maintain.merge_map(authors, Tables(spark, d).lineitem.select(F.col("l_suppkey").alias("author_id")))
    return maintain.merged(authors, moves, ["bio"]).select("id", "bio")


# The hierarchy region / nation / customer.
ELEMS = """e AS (SELECT 'r' || r_regionkey AS id, NULL AS parent_id, lower(r_name) AS slug, r_regionkey AS pos FROM region
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, lower(n_name), n_nationkey FROM nation
UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'c' || c_custkey, c_custkey FROM customer),
t AS (WITH RECURSIVE t AS (SELECT id, id AS root_id, slug AS path, 0 AS depth, [CAST(pos AS BIGINT)] AS place FROM e WHERE parent_id IS NULL
UNION ALL SELECT e.id, root_id, path || '/' || slug, depth + 1, list_append(place, CAST(pos AS BIGINT)) FROM e JOIN t ON e.parent_id = t.id) SELECT * FROM t)"""


def elems(spark, d) -> DataFrame:
    t = Tables(spark, d)
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    r = t.region.select(key("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lower("r_name").alias("slug"), F.col("r_regionkey").cast("long").alias("pos"))
    n = t.nation.select(key("n", "n_nationkey"), key("r", "n_regionkey"), F.lower("n_name"), F.col("n_nationkey").cast("long"))
    c = t.customer.select(key("c", "c_custkey"), key("n", "c_nationkey"), key("c", "c_custkey"), F.col("c_custkey").cast("long"))
    return r.unionAll(n).unionAll(c)


@query(f"WITH {ELEMS} SELECT id, root_id, path, CAST(depth AS BIGINT) AS depth FROM t")
def tree_paths(spark, d):
    return tree.paths(elems(spark, d)).select("id", "root_id", "path", L("depth"))


@query(f"WITH {ELEMS} SELECT id, path, row_number() OVER (PARTITION BY root_id ORDER BY place) AS pos FROM t")
def toc_preorder(spark, d):
    return tree.preorder(tree.paths(elems(spark, d))).select("id", "path", L("pos"))


@query(f"WITH {ELEMS} SELECT id, lag(id) OVER (PARTITION BY root_id ORDER BY place) AS prev_id, lead(id) OVER (PARTITION BY root_id ORDER BY place) AS next_id FROM t")
def toc_prev_next(spark, d):
    return tree.neighbours(tree.paths(elems(spark, d)), "root_id", "place", "id").select("id", "prev_id", "next_id")


@query(f"WITH {ELEMS} SELECT id FROM e WHERE id NOT IN (SELECT parent_id FROM e WHERE parent_id IS NOT NULL)")
def tree_leaves(spark, d):
    return tree.leaves(elems(spark, d)).select("id")


@query(f"WITH {ELEMS} SELECT id, list_transform(range(1, depth + 2), lambda i: array_to_string(string_split(path, '/')[1:i], '/')) AS crumbs FROM t")
def tree_breadcrumb(spark, d):
    return tree.paths(elems(spark, d)).select("id", tree.breadcrumb(F.col("path")).alias("crumbs"))


@query(f"WITH {ELEMS} SELECT id, path FROM t WHERE root_id = 'r2' AND depth - 0 <= 1")
def tree_depth_prune(spark, d):
    return tree.pruned(tree.paths(elems(spark, d)).where("root_id = 'r2'"), 0, 1).select("id", "path")


@query(f"WITH {ELEMS} SELECT id, (SELECT count(*) FROM e c WHERE c.parent_id = e.id) AS children FROM e")
def tree_child_counts(spark, d):
    return tree.child_counts(elems(spark, d))


@query(f"WITH {ELEMS}, p AS (SELECT * FROM t JOIN e USING (id)) SELECT path FROM p WHERE depth = 1 OR depth < 1 AND id NOT IN (SELECT parent_id FROM e WHERE parent_id IS NOT NULL)")
def dav_frontier(spark, d):
    e = elems(spark, d)
    return tree.frontier(tree.paths(e).join(e.select("id", "parent_id"), "id"), 1).select("path")


@query(f"WITH {W}, {P} SELECT doc_id, nth, sha256(text) AS sha FROM p")
def paragraph_sha(spark, d):
    return lines(works(Tables(spark, d).documents)).select("doc_id", "nth", F.sha2("text", 256).alias("sha"))


SQUEEZE = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"WITH {W}, s AS (SELECT doc_id, {SQUEEZE} AS q, trim(head) AS head FROM w) SELECT doc_id, length(q) AS size, CAST(len(string_split(q, ' ')) AS BIGINT) AS word_size, sha256(CASE WHEN head <> '' AND starts_with(q, head) THEN trim(substr(q, length(head) + 1)) ELSE q END) AS digest FROM s")
def div_size_wordsize(spark, d):
    w = works(Tables(spark, d).documents)
    return w.select("doc_id", F.length(T.squeeze(F.col("text"))).cast("long").alias("size"), T.word_size(F.col("text")).cast("long").alias("word_size"), T.text_digest(F.col("head"), F.col("text")).alias("digest"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE trim(text) <> '' GROUP BY conv_id")
def leaf_text_concat(spark, d):
    return tree.joined_text(Tables(spark, d).conversations, "conv_id", "turn").select("conv_id", F.sha2("content", 256).alias("digest"))


@query('SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER w, 0) AS BIGINT) AS start, CAST(coalesce(sum(length(text) + 1) OVER w, 0) + length(text) AS BIGINT) AS "end" FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)')
def node_spans(spark, d):
    return tree.spans(Tables(spark, d).conversations, "conv_id", "turn").select("conv_id", "turn", "start", "end")


@query(f"WITH {W}, {P}, r AS (SELECT doc_id, string_agg(CASE nth WHEN 2 THEN substr(text, 6) WHEN 4 THEN substr(text, 1, 20) ELSE text END, chr(10) ORDER BY nth) AS text, bool_or(nth = 4 AND length(text) >= 20) AND bool_or(nth = 2 AND length(text) >= 5) AS ok FROM p WHERE nth BETWEEN 2 AND 4 GROUP BY doc_id) SELECT doc_id, text FROM r WHERE ok AND text <> ''")
def fragment_range(spark, d):
    return fragments.range_text(lines(works(Tables(spark, d).documents)), "doc_id", 2, 5, 4, 20)


@query("""WITH s AS (SELECT l_orderkey AS id, l_linenumber AS n, l_partkey % 9 AS a, l_suppkey % 7 AS b, CASE l_orderkey % 9 WHEN 0 THEN '_' || a || '.93:5..4.1:7' WHEN 1 THEN '_' || a WHEN 2 THEN '_3:' || b WHEN 3 THEN '_0.' || a || '..2' WHEN 4 THEN '_2..' || b WHEN 5 THEN a || '.3' WHEN 6 THEN '_0' || a || '.2:' || b || '..1.20:9' WHEN 7 THEN '_1..2..' || b ELSE '' END AS s FROM lineitem),
m AS (SELECT *, regexp_matches(s, '^_(\\d+(?:\\.\\d+)*)(?::(\\d+))?(?:\\.\\.(\\d+(?:\\.\\d+)*)(?::(\\d+))?)?$') AS ok FROM s)
SELECT id, n, s, ok AND NOT regexp_matches(s, '([_.]|\\.\\.)0+([.:]|$)') AND NOT (contains(s, ':') AND NOT contains(s, '..')) AS valid FROM m""")
def fragment_selector_parse(spark, d):
    a, b, k = F.col("l_partkey") % 9, F.col("l_suppkey") % 7, F.col("l_orderkey") % 9
    forms = [("_", a, ".93:5..4.1:7"), ("_", a), ("_3:", b), ("_0.", a, "..2"), ("_2..", b), (a, ".3"), ("_0", a, ".2:", b, "..1.20:9"), ("_1..2..", b)]
    s = F.lit("")
    for i, f in enumerate(forms):
        s = F.when(k == i, F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in f))).otherwise(s)
    rows = Tables(spark, d).lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), s.alias("s"))
    return rows.select("id", "n", "s", fragments.selector_columns(F.col("s"))["valid"].alias("valid"))


# Two editions: before, every document; after, those without id 0 modulo 5, moved to another source where id is 1 modulo 5.
OLD = "o AS (SELECT doc_id, '/' || source || '/d' || doc_id AS path, source AS parent, md5(text) AS digest, split_part(text, chr(10), 1) AS head FROM documents)"
NEW = "n AS (SELECT doc_id, '/' || source || CASE WHEN doc_id % 5 = 1 THEN '/moved' ELSE '' END || '/d' || doc_id AS path, source AS parent, md5(text) AS digest, split_part(text, chr(10), 1) AS head FROM documents WHERE doc_id % 5 <> 0)"


def edition(spark, d, new: bool) -> DataFrame:
    docs = Tables(spark, d).documents
    moved = F.when(F.col("doc_id") % 5 == 1, "/moved").otherwise("") if new else F.lit("")
    out = docs.select("doc_id", F.concat(F.lit("/"), "source", moved, F.lit("/d"), F.col("doc_id")).alias("path"), F.col("source").alias("parent"), F.md5("text").alias("digest"), F.split("text", "\n")[0].alias("head"))
    return out.where("doc_id % 5 != 0") if new else out


UNIQUE = "{0}u AS (SELECT digest, any_value(path) AS path FROM {0} GROUP BY digest HAVING count(*) = 1)"


@query(f"WITH {OLD}, {NEW}, {UNIQUE.format('o')}, {UNIQUE.format('n')} SELECT ou.path AS old, nu.path AS new FROM ou JOIN nu USING (digest) WHERE ou.path <> nu.path")
def relocation_match_digest(spark, d):
    return relocate.by_digest(edition(spark, d, False), edition(spark, d, True))


@query(f"WITH {OLD}, {NEW}, {UNIQUE.format('o')}, {UNIQUE.format('n')} SELECT count(*) AS matched FROM ou JOIN nu USING (digest)")
def digest_unique_both(spark, d):
    old, new = (relocate.unique_by(edition(spark, d, x), "digest").select("digest") for x in (False, True))
    return old.join(new, "digest").agg(F.count("*").alias("matched"))


CHAIN = "{0}c AS (SELECT path, parent || ' / ' || lower(head) AS chain, row_number() OVER (PARTITION BY parent, lower(head) ORDER BY doc_id) AS occurrence FROM {0})"


@query(f"WITH {OLD}, {NEW}, {CHAIN.format('o')}, {CHAIN.format('n')} SELECT oc.path AS old, nc.path AS new FROM oc JOIN nc USING (chain, occurrence) WHERE oc.path <> nc.path")
def relocation_match_chain(spark, d):
    def chained(x):
        own = edition(spark, d, x).select(F.col("parent").alias("file"), "parent", "path", F.col("doc_id").alias("nth"), F.col("doc_id").alias("id"), F.col("doc_id").alias("place"), F.concat("parent", F.lit(" / "), F.lower("head")).alias("chain"))
        return relocate.editions(own)

    return relocate.by_chain(chained(False), chained(True))


@query(f"WITH {OLD}, live AS (SELECT DISTINCT '/' || source || '/part' || (doc_id % 3) AS path FROM documents WHERE doc_id % 2 = 0), q AS (SELECT doc_id, '/' || parent || '/part' || (doc_id % 3) || '/d' || doc_id AS path FROM o) SELECT q.doc_id, live.path AS ancestor FROM q LEFT JOIN live ON starts_with(q.path, live.path || '/')")
def nearest_ancestor(spark, d):
    docs = Tables(spark, d).documents
    up = F.concat(F.lit("/"), "source", F.lit("/part"), F.col("doc_id") % 3)
    live = docs.where("doc_id % 2 = 0").select(up.alias("path"))
    return relocate.nearest(docs.select("doc_id", F.concat(up, F.lit("/d"), F.col("doc_id")).alias("path")), "path", live).select("doc_id", "ancestor")


# Chains of up to fourteen moves; every third ends in a loop. Some old paths lack their slash, new ones have an ending.
RELOCATIONS = "r AS (SELECT '/src/p' || doc_id AS old, '/src/p' || (CASE WHEN doc_id % 15 < 14 THEN doc_id + 1 ELSE doc_id - 3 END) AS new FROM documents WHERE doc_id % 15 < 14 OR (doc_id // 15) % 3 = 0)"


@query(f"""WITH RECURSIVE {RELOCATIONS}, s AS (SELECT '/src/p' || doc_id AS path, '/src/p' || doc_id AS pos, ['/src/p' || doc_id] AS seen, 0 AS hop, FALSE AS loop FROM documents
UNION ALL SELECT path, new, list_append(seen, new), hop + 1, list_contains(seen, new) AND hop + 1 < 10 FROM s JOIN r ON r.old = pos WHERE hop < 10 AND NOT loop)
SELECT path, CASE WHEN arg_max(loop, hop) OR arg_max(pos, hop) = path THEN NULL ELSE arg_max(pos, hop) END AS target FROM s GROUP BY path""")
def relocation_resolve(spark, d):
    i = F.col("doc_id")
    docs = Tables(spark, d).documents
    to = F.when(i % 15 < 14, i + 1).when(F.floor(i / 15) % 3 == 0, i - 3)
    r = docs.where(to.isNotNull()).select(F.concat(F.when(i % 4 == 1, "src/p").otherwise("/src/p"), i).alias("old"), F.concat(F.lit("/src/p"), to, F.lit(".html")).alias("new"))
    return relocate.resolved(r, docs.select(F.concat(F.lit("/src/p"), i).alias("path")))


@query(f"WITH {OLD}, {NEW}, g AS (SELECT path, parent FROM o WHERE path NOT IN (SELECT path FROM n)) SELECT g.path AS old, '/' || parent || '/d' AS up FROM g WHERE EXISTS (SELECT 1 FROM n WHERE n.parent = g.parent)")
def relocation_parent_fallback(spark, d):
    new = edition(spark, d, True)
    gone = maintain.removed(edition(spark, d, False), new, "path")
    live = new.select(F.concat(F.lit("/"), "parent", F.lit("/d")).alias("path"))
    return relocate.nearest(gone.select(F.concat(F.lit("/"), "parent", F.lit("/d/"), F.col("doc_id")).alias("at"), F.col("path").alias("old")), "at", live).where("ancestor is not null").select("old", F.col("ancestor").alias("up"))


NORMAL = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '[[:punct:][:space:]]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(f"WITH {W}, h AS (SELECT a.doc_id, {NORMAL.format('a.head')} AS x, {NORMAL.format('b.head')} AS y FROM w a JOIN w b ON b.doc_id = a.doc_id + 20) SELECT doc_id, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 WHEN len(list_intersect(x, y)) IN (len(x), len(y)) THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) END, 6) AS score FROM h")
def heading_similarity(spark, d):
    w = works(Tables(spark, d).documents)
    b = w.select((F.col("doc_id") - 20).alias("doc_id"), F.col("head").alias("other"))
    return w.join(b, "doc_id").select("doc_id", F.round(relocate.heading_similarity(F.col("head"), F.col("other")), 6).alias("score"))


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha, count(*) AS copies FROM documents GROUP BY text")
def dedupe_by_sha(spark, d):
    return Tables(spark, d).documents.select("doc_id", F.sha2("text", 256).alias("sha")).groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def embed_only_unseen(spark, d):
    docs = Tables(spark, d).documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    return maintain.removed(docs, docs.where("doc_id % 2 = 0"), "sha").select("doc_id")


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def prune_removed(spark, d):
    t = Tables(spark, d)
    return maintain.removed(t.pages.select("page_id"), t.labels.select(F.col("doc_id").alias("page_id")), "page_id")


@query("SELECT o_orderkey AS filename FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE NOT coalesce(ts > o_orderdate, FALSE)")
def fresher_files(spark, d):
    t = Tables(spark, d)
    known = t.lineitem.groupBy(F.col("l_orderkey").alias("filename")).agg(F.max("l_shipdate").alias("timestamp"))
    return maintain.fresher(t.orders.select(F.col("o_orderkey").alias("filename"), F.col("o_orderdate").alias("modified")), known).select("filename")


@query("SELECT doc_id, total FROM (SELECT doc_id, count(*) OVER () AS total FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) ORDER BY doc_id LIMIT 25")
def missing_toc(spark, d):
    t = Tables(spark, d)
    missing = maintain.removed(t.documents.select("doc_id"), t.labels, "doc_id")
    total = F.broadcast(missing.agg(F.count("*").alias("total")))
    return missing.orderBy("doc_id").limit(25).crossJoin(total)


@query("SELECT user_id, event_type, count(*) AS touches, arg_max(CAST(json_extract_string(props, '$.k') AS INT), (ts, event_id)) AS division, max(ts) AS at, count(*) >= 3 AS read FROM events GROUP BY ALL")
def progress_latest(spark, d):
    e = Tables(spark, d).events.withColumn("division", F.get_json_object("props", "$.k").cast("int"))
    return state.progress(e, "user_id", "event_type", "ts", "division", "event_id")


@query("SELECT user_id, event_type, count(*) AS touches, count(*) >= 3 AS read FROM events GROUP BY ALL")
def progress_touch_read(spark, d):
    e = Tables(spark, d).events
    return state.progress(e, "user_id", "event_type", "ts", "event_id", "event_id").select("user_id", "event_type", "touches", "read")


@query("SELECT user_id, event_type, round(sum(value), 2) AS attention_seconds FROM events GROUP BY ALL")
def attention_sum(spark, d):
    return state.attention(Tables(spark, d).events, ["user_id", "event_type"], "value").select("user_id", "event_type", F.round("attention_seconds", 2).alias("attention_seconds"))


@query("WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) % 3 AS division FROM events), c AS (SELECT user_id, arg_max(division, (ts, event_id)) AS division FROM e GROUP BY user_id) SELECT user_id, round(arg_max(least(greatest(value / 50, 0), 1), (ts, event_id)), 6) AS scroll FROM e JOIN c USING (user_id, division) GROUP BY user_id")
def scroll_clamped(spark, d):
    e = Tables(spark, d).events.withColumn("division", F.get_json_object("props", "$.k").cast("int") % 3).withColumn("fraction", F.col("value") / 50)
    now = e.groupBy("user_id").agg(F.max_by("division", F.struct("ts", "event_id")).alias("division"))
    return state.scrolls(e, now, ["user_id"], "division", "fraction", "ts", "event_id").select("user_id", F.round("scroll", 6).alias("scroll"))


@query("WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), m AS (SELECT DISTINCT l_partkey, -l_partkey AS place FROM l WHERE l_partkey % 3 = 0) SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY place NULLS LAST, l_linenumber, l_partkey, l_suppkey) - 1 AS position FROM l LEFT JOIN m USING (l_partkey)")
def collection_reorder(spark, d):
    items = Tables(spark, d).lineitem.withColumn("old", F.struct("l_linenumber", "l_partkey", "l_suppkey"))
    listed = items.where("l_partkey % 3 = 0").select("l_partkey", (-F.col("l_partkey")).alias("place")).distinct()
    return state.reordered(items, listed, "l_orderkey", "l_partkey", "old").select("l_orderkey", "l_linenumber", "l_partkey", L("position"))


@query("SELECT l_orderkey, CAST(coalesce(max(l_linenumber), -1) + 1 AS BIGINT) AS next_order FROM lineitem GROUP BY l_orderkey")
def next_sort_order(spark, d):
    return state.next_order(Tables(spark, d).lineitem, "l_orderkey", "l_linenumber").select("l_orderkey", L("next_order"))


@query("""WITH RECURSIVE o AS (SELECT c_nationkey AS owner, c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN c_mktsegment || ' (2)' ELSE c_mktsegment END AS base, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS k FROM customer),
s AS (SELECT owner, id, base AS name, k, [base] AS used FROM o WHERE k = 1
UNION ALL SELECT owner, id, name, k, list_append(used, name) FROM (
  SELECT o.owner, o.id, o.k, used, CASE WHEN NOT list_contains(used, base) THEN base ELSE list_filter(list_transform(range(2, len(used) + 3), lambda n: base || ' (' || n || ')'), lambda x: NOT list_contains(used, x))[1] END AS name
  FROM s JOIN o ON o.owner = s.owner AND o.k = s.k + 1))
SELECT id, name FROM s""")
def saved_search_unique_name(spark, d):
    base = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_mktsegment", F.lit(" (2)"))).otherwise(F.col("c_mktsegment"))
    own = Tables(spark, d).customer.select(F.col("c_nationkey").alias("owner"), F.col("c_custkey").alias("id"), base.alias("name"))
    return state.unique_names(own, "owner", "name", "id").select("id", "name")


@query("""WITH RECURSIVE e AS (SELECT DISTINCT user_id, ts FROM events), g AS (SELECT user_id, min(ts) AS ts FROM e GROUP BY user_id
UNION ALL SELECT g.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = g.user_id AND e.ts >= g.ts + INTERVAL 30 MINUTE) FROM g WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = g.user_id AND e.ts >= g.ts + INTERVAL 30 MINUTE)) SELECT user_id, ts FROM g""")
def request_dedupe_30min(spark, d):
    return maintain.not_repeated(Tables(spark, d).events, "user_id", "ts", 30)


@query("WITH f AS (SELECT l_orderkey AS id, count(*) + l_orderkey % 8 AS n FROM lineitem GROUP BY l_orderkey) SELECT id, n AS attempts, least(pow(2, least(n - 1, 10)), 24) AS hours FROM f")
def failure_backoff(spark, d):
    f = Tables(spark, d).lineitem.groupBy(F.col("l_orderkey").alias("id")).agg((F.count("*") + F.col("l_orderkey") % 8).alias("attempts"))
    return f.select("id", "attempts", T.backoff_hours(F.col("attempts")).alias("hours"))


@query("SELECT event_type AS model, count(*) AS batches, round(avg(value), 6) AS mean, round(sum(value), 2) AS total, max(event_id % 60) AS longest, round(sum(value) / sum(event_id % 60), 6) AS rate FROM events GROUP BY event_type")
def embedding_batch_stats(spark, d):
    from quire.operators.catalog import batch_stats

    e = Tables(spark, d).events.select(F.col("event_type").alias("model"), "value", (F.col("event_id") % 60).alias("seconds"))
    return batch_stats(e, ["model"], "value", "seconds").select("model", "batches", F.round("mean", 6).alias("mean"), F.round("total", 2).alias("total"), "longest", F.round("rate", 6).alias("rate"))


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) ORDER BY CAST(n > 1 AS INT), doc_id LIMIT 10")
def language_diverse_pick(spark, d):
    from quire.operators.catalog import first_of_each

    return first_of_each(Tables(spark, d).documents.select("doc_id", "lang"), "lang", "doc_id", 10)


@query("SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS k FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS n FROM documents) WHERE n <= 3) WHERE k <= 14")
def topk_per_group_capped(spark, d):
    best = (F.desc("n_chars"), F.asc("doc_id"))
    r = S.ranked(Tables(spark, d).documents, ["lang", "source"], *best, name="n").where("n <= 3")
    return S.ranked(r, ["lang"], *best, name="k").where("k <= 14").select("doc_id", "source", "lang")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, d):
    return Tables(spark, d).pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT DISTINCT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) WHERE starts_with(href, '/') AND length(href) > 1 AND NOT regexp_matches(substr(href, 2), '[#/]')")
def html_child_links(spark, d):
    from quire.sources.html import child_links

    return child_links(Tables(spark, d).pages, "/")


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang FROM pages")
def html_title_text(spark, d):
    return Tables(spark, d).pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))


@query("SELECT event_id, map_keys(m) AS keys, map_values(m) AS vals FROM (SELECT event_id, map_from_entries(list_filter([('k', json_extract_string(props, '$.k')), ('type', CASE WHEN value > 20 THEN event_type END)], lambda x: x[2] IS NOT NULL)) AS m FROM events)")
def event_details_nonnull(spark, d):
    m = T.event_details(k=F.get_json_object("props", "$.k"), type=F.when(F.col("value") > 20, F.col("event_type")))
    return Tables(spark, d).events.select("event_id", F.map_keys(m).alias("keys"), F.map_values(m).alias("vals"))


@query("SELECT event_id, CASE WHEN event_id % 9 > 0 THEN json_extract_string(props, '$.k') END AS k FROM events")
def json_prefs_get(spark, d):
    broken = F.when(F.col("event_id") % 9 == 0, F.lit("{bad")).otherwise(F.col("props"))
    return Tables(spark, d).events.select("event_id", state.preference(broken, "k").alias("k"))


@query("SELECT c_custkey AS id, CAST(CASE WHEN c_custkey % 4 = 0 THEN 2 ELSE 1 END AS BIGINT) AS revision, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_mktsegment END AS value FROM customer")
def workspace_compare_and_set(spark, d):
    own = Tables(spark, d).customer.select(F.col("c_custkey").alias("id"), F.lit(1).cast("long").alias("revision"), F.col("c_mktsegment").alias("value"))
    updates = own.where("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, 1).otherwise(7).cast("long").alias("revision"), F.lit("new").alias("value"))
    return state.compare_and_set(own, updates, "id")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'given ' || s_suppkey END AS bio FROM supplier")
def enrichment_fill_blanks(spark, d):
    s = Tables(spark, d).supplier.select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).when(F.col("s_suppkey") % 3 == 0, F.lit(" ")).alias("bio"))
    return maintain.enriched(s, s.select("id", F.concat(F.lit("given "), F.col("id")).alias("bio")), "id", ["bio"])


REPOS = "(SELECT doc_id, lang, name, CASE WHEN source IN ('src1', 'src3', 'src5') THEN 1 WHEN source IN ('src2', 'src4') THEN 2 ELSE 3 END AS repo FROM (SELECT *, lang || '/' || (doc_id // 3) AS name FROM documents))"


def repositories(spark, d) -> list[DataFrame]:
    docs = Tables(spark, d).documents.select("doc_id", "lang", "source", F.concat("lang", F.lit("/"), F.floor(F.col("doc_id") / 3)).alias("name"))
    first, second = F.col("source").isin("src1", "src3", "src5"), F.col("source").isin("src2", "src4")
    return [docs.where(w).drop("source") for w in (first, second, ~(first | second))]


@query(f"SELECT name, CAST(min(repo) AS BIGINT) AS repo FROM {REPOS} GROUP BY name")
def combined_repo_first(spark, d):
    from quire.sources.repos import combined

    return combined([r.select("name").distinct() for r in repositories(spark, d)]).select("name", "repo")


@query(f"SELECT doc_id, name, CAST(repo AS BIGINT) AS repo FROM {REPOS} WHERE repo <> 2")
def combined_repo_list(spark, d):
    from quire.sources.repos import union_all

    return union_all(repositories(spark, d), [True, False, True]).select("doc_id", "name", "repo")
