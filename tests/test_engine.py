import time

import pytest
from pyspark.sql import functions as F

from quire.engine import Corpus, hash_embedding, prefixed
from quire.functions import xml
from quire.operators import fragments
from quire.operators.projection import Projection, to_json

TEI = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>My <hi>Book</hi></title><author>Doe</author></titleStmt><publicationStmt><publisher>P</publisher><availability><p>Free. <ptr target="http://l"/></p></availability></publicationStmt></fileDesc></teiHeader></TEI>'


@pytest.fixture(scope="module")
def corpus(spark):
    make = spark.createDataFrame
    authors = make([(1, "doe", "Jane", "Doe", None, "Doe, Jane"), (2, "roe", None, "Roe", "R. Roe", "Roe"), (3, "poe", None, "Poe", None, "Poe")], "id long, str_id string, first_name string, last_name string, display_name string, original_name string")
    files = make([(1, "a.xml", 1, "r1"), (2, "b.xml", 2, "r2"), (3, "c.xml", 1, None)], "id long, filename string, author_id long, repo string")
    divs = make([(1, None, 1, "/doe/sea", "The Sea", "en", 1, 0, 1), (2, 1, 1, "/doe/sea/one", "One", "en", 2, 1, 1), (3, 1, 1, "/doe/sea/two", "The Full Project Gutenberg License", "en", 3, 1, 1), (4, None, 2, "/roe/land", "Land", "fr", 1, 0, 4), (5, None, 3, "/doe/sky", "Sky", "en", 1, 0, 5)], "id long, parent_id long, file_id long, path string, head string, lang string, pos int, depth int, root_id long")
    rows = [(2, "/doe/sea/one", 1, "The whale swims in the deep sea."), (2, "/doe/sea/one", 2, "A second whale came, and a third."), (3, "/doe/sea/two", 1, "whale licence text"), (4, "/roe/land", 1, "No water here at all, only land."), (5, "/doe/sky", 1, "The sky is over the sea and the land.")]
    paragraphs = make(rows, "div_id long, path string, nth int, text string").withColumn("sha256", F.sha2("text", 256))
    stored = paragraphs.where("div_id in (2, 4)").collect()
    vectors = make([(r["sha256"], f"http://h:80{r['path']}.html", hash_embedding(r["text"])) for r in stored], "sha256 string, url string, embedding array<double>")
    moved = make([("/old/sea", "/doe/sea", "MOVED")], "old string, new string, reason string")
    return Corpus(authors, files, divs, paragraphs, vectors, moved)


def ids(df):
    return [r["id"] for r in df.collect()]


def test_search(corpus):
    assert ids(corpus.find_authors("oe")) == [1, 3, 2]
    assert ids(corpus.find_heads("s", scopes=["doe/sky"])) == [5]
    assert [(r["path"], r["nth"]) for r in corpus.grep("WHALE").collect()] == [("/doe/sea/one", 1), ("/doe/sea/one", 2)]
    hits = corpus.full_text("whale land").collect()
    assert {h["path"] for h in hits} == {"/doe/sea/one", "/doe/sea/two", "/roe/land", "/doe/sky"} and hits[0]["path"] == "/roe/land"
    assert [h["path"] for h in corpus.full_text("whale", scopes=["doe/sea"]).collect()][0].startswith("/doe/sea")
    with pytest.raises(ValueError):
        corpus.full_text("a")


def test_vectors(corpus):
    found = corpus.semantic("No water here at all, only land.", 2).collect()
    assert found[0]["path"] == "/roe/land" and found[0]["distance"] < 1e-6
    assert [r["path"] for r in corpus.semantic("No water here at all, only land.", 5, ["doe/sea"]).collect()] == ["/doe/sea/one"] * 2
    assert corpus.to_vectorise().count() == 1
    with pytest.raises(RuntimeError):
        Corpus(corpus.authors, corpus.files, corpus.divisions, corpus.paragraphs).semantic("x")


def test_catalogue(corpus):
    assert ids(corpus.works_page(size=2)) == [1, 4] and ids(corpus.works_page(page=2, size=2)) == [5]
    assert ids(corpus.works_page("doe", "en")) == [1, 5]
    assert tuple(corpus.works_totals(size=2).first()) == (3, 2)
    assert ids(corpus.authors_page()) == [1, 2]
    assert {r["str_id"]: r["works"] for r in corpus.work_counts().collect()} == {"doe": 2, "roe": 1, "poe": 0}
    assert ids(corpus.by_language("fr")) == [4] and ids(corpus.by_author("doe")) == [1, 5] and ids(corpus.by_repo("r1")) == [1]
    assert sorted(r[0] for r in corpus.repos().collect()) == ["r1", "r2"]
    assert ids(corpus.featured(["/doe/sky", "/none", "/doe/sea"])) == [5, 1]
    assert ids(corpus.discover(3, 1)) == ids(corpus.discover(3, 1)) and corpus.discover(2).count() == 2
    assert ids(corpus.like_example(corpus.divisions, lang="fr", head=None)) == [4]
    with pytest.raises(ValueError):
        corpus.discover(51)


def test_hierarchy(corpus):
    assert ids(corpus.by_path("doe/sea/one.html?x")) == [2] and ids(corpus.by_path("/old/sea")) == [1]
    assert [r["text"] for r in corpus.element("/doe/sea/one/_2.txt").collect()] == ["A second whale came, and a third."]
    assert ids(corpus.element("/doe/sky")) == [5]
    toc = corpus.toc(1).collect()
    assert [(r["id"], r["prev_id"], r["next_id"]) for r in toc] == [(1, None, 2), (2, 1, 3), (3, 2, None)]
    assert [r["nth"] for r in corpus.page_of_paragraphs(1, 1, 5).collect()] == [2]
    assert corpus.page_of_paragraphs(1, 0, 50, licences=True).count() == 3
    assert corpus.random_leaf(3).first()["id"] in (2, 4, 5)


def test_stored_index(corpus, spark, tmp_path):
    """Searched without accents, by the stems of a text's language, after replacing and removing works; scopes don't score."""
    from quire.operators.fulltext import Index

    docs = [("a/w1/1", "a/w1", "ro", "Pădurea", "Ștefan merge în pădure și cântă."), ("a/w1/2", "a/w1", "ro", "Marea", "Marea e liniștită."), ("b/w2/1", "b/w2", "en", "Oceans", "The oceans are calm, the boats sailing."), ("b/w3/1", "b/w3", "la", "Mare", "mare nostrum"), ("b/w3/2", "b/w3", "en", "Empty", "  ")]
    schema = "key string, work string, lang string, head string, content string"
    index = Index(spark, f"file://{tmp_path}/index").build(spark.createDataFrame(docs, schema), 2)
    keys = lambda q, **k: [r["key"] for r in index.search(q, 10, **k).collect()]
    assert keys("STEFAN") == ["a/w1/1"] and keys("padure") == ["a/w1/1"] and keys("Ştefan + -x") == ["a/w1/1"]
    assert keys("ocean") == ["b/w2/1"] and keys("sails boat") == ["b/w2/1"]
    assert keys("mare")[0] == "b/w3/1" and "a/w1/2" in keys("mare")
    assert keys("mare", where=F.startswith("key", F.lit("a/"))) == ["a/w1/2"]
    assert len(index.commits()) == 2 and index.commits()[-1]["complete"] and index.build(spark.createDataFrame(docs, schema)).commits() == index.commits()
    index.replace(spark.createDataFrame([("a/w1/9", "a/w1", "ro", "Nou", "Marea nouă")], schema))
    assert keys("stefan") == [] and "a/w1/9" in keys("marea")
    index.remove(spark.createDataFrame([("b/w3",)], "work string"))
    assert keys("nostrum") == []
    again = Index(spark, f"file://{tmp_path}/other").build(spark.createDataFrame([d for d in docs if d[1] not in ("a/w1", "b/w3")] + [("a/w1/9", "a/w1", "ro", "Nou", "Marea nouă")], schema))
    scored = lambda i: [(r["key"], round(r["score"], 9)) for r in i.search("marea the oceans nou", 10).collect()]
    assert scored(index) == scored(again) and scored(index)
    assert len(index.clauses(" ".join(f"word{i}" for i in range(400)))) <= 1024 and index.clauses("  ") == []
    corpus.index = Index(spark, f"file://{tmp_path}/third").build(corpus.index_documents())
    assert [h["path"] for h in corpus.full_text("whale land").collect()][0] == "/roe/land"
    corpus.index = None


def test_a_search_reads_the_files_of_its_terms_once(spark, tmp_path, monkeypatch):
    from quire.operators import fulltext

    monkeypatch.setattr(fulltext, "FILE_BYTES", 2000)
    schema = "key string, work string, lang string, head string, content string"
    docs = spark.createDataFrame([(f"a/w{i % 9}/{i:03d}", f"a/w{i % 9}", "en", f"Head {i}", "common " + " ".join(f"{c}{i % 23}word" for c in "abcdefghij")) for i in range(200)], schema)
    index = fulltext.Index(spark, f"file://{tmp_path}/index", ()).build(docs)
    state = index.log.head()[1]
    ranges = index._read("ranges", state["segments"]).collect()
    assert len(ranges) > 8  # more text, more files
    assert sum(r["low"] <= "common" <= r["high"] for r in ranges) > 1  # a frequent term has several
    hits = index.hits([("content", "c7word", 1.0)])
    assert len(hits.inputFiles()) == sum(r["low"] <= "c7word" <= r["high"] for r in ranges) < 3
    plan = index.scores("c7word common")
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("FileScan parquet") == 1 and "ReusedExchange" in final
    assert "In(term" in final


def test_segments_of_an_index_merge(spark, tmp_path):
    from quire.operators.fulltext import MERGED, Index

    schema = "key string, work string, lang string, head string, content string"
    index = Index(spark, f"file://{tmp_path}/index", ()).build(spark.createDataFrame([(f"a/w{i}/1", f"a/w{i}", "en", "H", f"text {i} same") for i in range(3)], schema))
    for i in range(MERGED):
        index.replace(spark.createDataFrame([("a/w1/1", "a/w1", "en", "H", f"again {i} same")], schema))
        assert len(index.log.head()[1]["segments"]) < MERGED
    found = lambda: {q: sorted((r["key"], round(r["score"], 9)) for r in index.search(q, 10).collect()) for q in ("same", "again", "text", str(MERGED - 1))}
    before, stats = found(), index.log.head()[1]["stats"]
    assert len(before["same"]) == 3 and [k for k, _ in before["again"]] == ["a/w1/1"] and len(before["text"]) == 2
    index.merge()
    assert found() == before and len(index.log.head()[1]["segments"]) == 1
    other = Index(spark, f"file://{tmp_path}/other", ()).build(spark.createDataFrame([(f"a/w{i}/1", f"a/w{i}", "en", "H", f"text {i} same" if i != 1 else f"again {MERGED - 1} same") for i in range(3)], schema))
    assert other.log.head()[1]["stats"] == stats == index.log.head()[1]["stats"]
    assert index.vacuum(least_age_s=0) and found() == before


def test_full_text_puts_only_found_paragraphs_together(corpus, spark, tmp_path):
    from quire.operators.fulltext import Index

    corpus.index = Index(spark, f"file://{tmp_path}/index").build(corpus.index_documents())
    plan = corpus.full_text("whale land")._jdf.queryExecution().optimizedPlan().toString()
    corpus.index = None
    below = plan[plan.index("collect_list") :]
    assert "/roe/land" in below  # the filter by path is below the aggregate


def test_paths_and_neighbours(corpus):
    assert ids(corpus.at("/doe/sea/one.xml")) == [2]
    for path, error in (("/doe", ValueError), ("/doe/none", LookupError)):
        with pytest.raises(error):
            corpus.at(path)
    own = corpus.context(2).first()
    assert (own["prev_id"], own["next_id"]) == (1, 3)
    with pytest.raises(ValueError):
        corpus.context(99)
    items = corpus.divisions.sparkSession.createDataFrame([("doe//sea.html", 1), ("/gone", 2)], "path string, n int")
    assert {(r["n"], r["div_id"], r["head"]) for r in corpus.located(items).collect()} == {(1, 1, "The Sea"), (2, None, None)}
    assert {r["id"]: [a["str_id"] for a in r["authors"]] for r in corpus.authors_by_work().collect()} == {1: ["doe"], 4: ["roe"], 5: ["doe"]}


def test_several_authors(corpus):
    from dataclasses import replace

    both = corpus.files.sparkSession.createDataFrame([(1, 1), (1, 2), (2, 2)], "file_id long, author_id long")
    own = replace(corpus, file_authors=both)
    assert {r["id"]: [a["str_id"] for a in r["authors"]] for r in own.authors_by_work().collect()} == {1: ["doe", "roe"], 4: ["roe"], 5: []}
    assert {r["str_id"]: r["works"] for r in own.work_counts().collect()} == {"doe": 1, "roe": 2, "poe": 0}


def test_xml(spark):
    row = spark.createDataFrame([(TEI,)], "x string")
    work = F.lit("<div><subtitle>Sub</subtitle><epigraph>A <hi>b</hi></epigraph><div><epigraph>inner</epigraph></div></div>")
    m = row.select(xml.book_metadata(F.col("x"), work, F.lit("My Book"), F.lit("Jane Doe"), F.lit(None).cast("string")).alias("m")).first()["m"]
    assert (m["title"], m["author"], m["publisher"], m["editor"], m["subtitle"], m["tagline_quote"], m["language"]) == ("My Book", "Jane Doe", "Biblioteca", "", "Sub", "A b", "")
    assert row.select(xml.licence_text(F.col("x"))).first()[0] == "Free. http://l"
    assert row.select(xml.only(F.col("x"), "//author")).first()[0] == "Doe"
    with pytest.raises(Exception, match="not exactly one"):
        row.select(xml.only(F.col("x"), "//none")).collect()


def test_projection():
    p = Projection("<div><head>Head</head><p>One <hi>t🙂wo</hi> three</p><p>Last<note>n</note></p></div>")
    assert p.text == "Head\n\nOne t🙂wo three\nLast [n]\n"
    assert p.resolve("_2")["text"] == "One t🙂wo three"
    assert p.resolve("_2.1:1..3:4")["text"] == "🙂wo three\nLast"
    assert p.resolve("_2.1")["html"] == "<section><p><em>t🙂wo</em></p></section>"
    assert "<mark>t🙂wo</mark>" in p.html(*p.spans[(2, 1)], mark=True)
    for bad in ("_2.1:2..3", "_3..2", "_2:99..3"):
        with pytest.raises(ValueError):
            p.resolve(bad)
    with pytest.raises(LookupError):
        p.resolve("_9")
    with pytest.raises(ValueError):
        p.resolve("_1", "0" * 64)
    assert p.resolve(fragments.parse_selector("_1"), p.revision)["text"] == "Head"
    assert to_json(p.root)["children"][0] == {"name": "head", "attributes": {}, "children": ["Head"]}


def test_prefixes(spark):
    assert spark.range(1).select(prefixed(F.lit("x"), "e5", True)).first()[0] == "query: x"


def test_cover_reads_each_xml_once():
    header = '<!DOCTYPE TEI><TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><editor>A <hi>b</hi></editor><editor role="editor">C</editor><editor role="translator">D &amp; E</editor><editor role="x">no</editor></titleStmt><editionStmt><edition>First <date>1900</date> one</edition></editionStmt><sourceDesc><bibl><idno type="ISBN">1<idno type="ISBN">2</idno></idno><idno>no</idno></bibl></sourceDesc></fileDesc></teiHeader><text><editor>no</editor></text></TEI>'
    got = xml.texts_at(header, xml.HEADER, {"edition_notice": xml.EDITION_NOTICE})
    assert {k: v for k, v in got.items() if v} == {"editor": "A bC", "translator": "D & E", "date": "1900", "isbn": "12", "edition_notice": "First  one"}
    assert set(xml.texts_at(None, xml.WORK).values()) == set(xml.texts_at("", xml.WORK).values()) == {""}
    began = time.monotonic()
    for _ in range(2000):
        xml.texts_at(header, xml.HEADER)
    assert time.monotonic() - began < 2  # evaluating paths one by one takes about a millisecond a row


def test_rows_that_much_is_done_with_are_spread(spark):
    from quire.functions.shared import spread

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert spread(spark.range(100).coalesce(1)).select(F.spark_partition_id()).distinct().count() == n


def test_postings_are_counted_where_a_text_is(spark):
    from quire.functions.analyze import analyzed
    from quire.operators import fulltext

    texts = ["Die Häuser scheinen, die Haus und 2 häusern", "", None, "les maisons MAISON de", "x́y \U0001d400b 𝐀b nichten"]
    rows = [(f"k{i % 12:02d}", f"w{i % 2}", (None, "de", "fr", "en")[i % 4], (texts * 2)[i % 5 + 1], texts[i % 5]) for i in range(60)] + [(None, "w", "de", "H", "same same")] * 2
    docs = spark.createDataFrame(rows, "key string, work string, lang string, head string, content string")
    own = fulltext.postings(docs, ("de", "fr"), 5)
    assert own.rdd.getNumPartitions() == 5  # as many tasks as asked for, whatever a shuffle has
    parts = []
    for f, c in (("content", F.col("content")), ("head", F.coalesce("head", F.lit("")))):
        for lang, where in ((None, F.lit(True)), ("de", F.col("lang") == "de"), ("fr", F.col("lang") == "fr")):
            w = docs.where("trim(content) <> ''").where(where).select("key", "work", F.explode(F.array(analyzed(c, lang))).alias("w"))
            parts.append(w.select(F.lit(f if lang is None else f"{f}_{lang}").alias("field"), F.explode("w").alias("term"), "key", "work", F.size("w").cast("long").alias("len")).groupBy("field", "term", "key", "work", "len").agg(F.count("*").alias("tf")))
    want = parts[0]
    for p in parts[1:]:
        want = want.unionByName(p)
    listed = lambda df: sorted(map(str, df.select("field", "term", "key", "work", "tf", "len").collect()))
    assert listed(own) == listed(want) and any("tf=4" in x for x in listed(own))


def test_the_nearest_of_a_label_is_found_without_sorting_pairs(spark):
    import math
    import random

    from quire.operators import vectors as V

    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), [rng.choice([0.0, 1.0, 2.0]) for _ in range(3)]) for i in range(120)] + [(500, "alone", [0.0] * 3), (501, "a", None)]
    v = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    got = {r["query"]: (r["hit"]["distance"], r["hit"]["key"]) for r in V.nearest_alike(v, v, "label", "vec_id").collect()}
    want = {}
    for i, m, q in rows:
        far = [(math.dist(q, e), k) for k, n, e in rows if n == m and k != i and e is not None] if m is not None and q is not None else []
        if far:
            want[i] = min(far)
    assert got == want and 500 not in got


def test_levels_of_deep_trees_without_exploding_places(spark):
    """Rows within some levels of headings, compared with a count by hand: deep places, ones without a row, and ones that several rows have."""
    import itertools

    from quire.operators import tree

    places = [("r", *p) for n in range(6) for p in itertools.product("ab", repeat=n) if p[:2] != ("b", "b") or n != 2]
    headed = {p: hash_embedding("/".join(p), 8)[0] > 0 or len(p) == 1 for p in places}
    twice = [p for p in places if len(p) == 2]
    df = spark.createDataFrame([(list(p), headed[p]) for p in places + twice], "place array<string>, headed boolean")
    for levels in (0, 1, 2, 9):
        want = sorted(p for p in places + twice if sum(headed.get(p[:n], False) for n in range(1, len(p) + 1)) - 1 <= levels)
        got = tree.to_levels(df, levels)
        assert sorted(tuple(r["place"]) for r in got.collect()) == want
        assert "Generate" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert any(len(p) > 3 for p in places if sum(headed.get(p[:n], False) for n in range(1, len(p) + 1)) == 2)
    with pytest.raises(Exception, match="longer than 4"):
        tree.to_levels(df, 1, deepest=4).collect()
