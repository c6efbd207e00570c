import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import names
from quire.functions import text as T
from quire.functions.language import detect
from quire.operators import fragments
from quire.operators import relocate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "slug"),
    [("Nicolae Bălcescu", "nicolae_balcescu"), ("Țara & Șarpele!", "tara_sarpele"), ("Où est-il ?", "ou_est_il"), ("Война и мир", "voina_i_mir"), ("100% #1", "100_percent_hash_1"), ("(…)", ""), ("a — b.", "a_b"), ("Straße", "strasse")],
)
def test_slug(text, slug):
    assert names.slug(text) == slug


def test_slug_candidates():
    first = lambda s, n: list(itertools.islice(names.slug_candidates(s), n))
    assert first("", 3) == ["1", "2", "3"]
    assert first("35", 3) == ["35", "35_2", "35_3"]
    assert first("The Cat", 3) == ["the_cat", "the_cat_2", "the_cat_3"]
    assert first("Romanii supt Mihai voievod viteazul", 3) == ["romanii", "romanii_supt", "romanii_supt_mihai"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=150), max_size=12))
def test_slugs_are_unique_and_short(heads):
    taken = set()
    own = [names.unique_slug(h, taken) for h in heads]
    assert len(set(own)) == len(own)
    assert all(len(s) <= names.MAX_SLUG for s in own)


def test_author_ids():
    first = lambda s, n, **k: list(itertools.islice(names.author_ids(s, **k), n))
    assert first("Caragiale, Ion Luca", 4) == ["caragiale", "caragiale_ion_luca", "caragiale_ion_luca_2", "caragiale_ion_luca_3"]
    assert first("Anonymous", 3) == ["trad"]
    assert first("Caragiale, Mateiu", 2, recommended={"caragiale": "Caragiale, Ion Luca"}) == ["caragiale_mateiu", "caragiale_mateiu_2"]
    assert first("Caragiale, Ion-Luca", 2, recommended={"caragiale": "Caragiale, Ion Luca"}) == ["caragiale"]
    assert first("Css", 2, forbidden=frozenset(["css"])) == ["css_2", "css_3"]


def test_names(spark):
    assert names.name_key("Pérez, José") == names.name_key("jose PEREZ") == one(spark, T.name_key(F.lit("José  Pérez")))
    assert names.parse_name("Alexandru Ioan Cuza") == ("Cuza", "Ioan Alexandru")
    assert one(spark, T.parsed_name(F.lit("Doe , Jane")))["first"] == "Jane"
    assert one(spark, T.parsed_name(F.lit("Plato")))["first"] is None
    assert names.is_anonymous("  Anónimo ") and names.is_anonymous(None) and not names.is_anonymous("Homer")


def test_paths(spark):
    for raw, want in (("a//b/c.html?x#y", "/a/b/c"), ("", "/"), ("/a.b/c", "/a.b/c"), (None, "/")):
        assert one(spark, T.canonical_path(F.lit(raw))) == want
    assert one(spark, T.url_path(F.lit("http://h:80/a%20b/c.xml?q"))) == "/a b/c"
    assert one(spark, T.prefixes(F.lit("/a/b/c/d"))) == ["/a/b/c/d", "/a/b/c", "/a/b"]
    assert tuple(one(spark, T.endpoint(F.lit("https://x.org:8080/y")))) == ("https", "x.org", 8080)


def test_scopes(spark):
    assert T.normal_scopes(["/a/b/", "a/b", "", " c/d "]) == ["a/b", "c/d"]
    for bad in ("a", "a//b", "a/../b", "a/.b", "a/b?c", "a/" + "b" * 600):
        with pytest.raises(ValueError):
            T.normal_scopes([bad])
    rows = spark.createDataFrame([("/a/b.txt",), ("a/b/c",), ("a/bc",), ("x",)], "p string")
    assert [r[0] for r in rows.select(T.in_scope(F.col("p"), ["a/b"])).collect()] == [True, True, False, False]
    assert one(spark, T.in_scope(F.lit("anything"), []))


def test_strings(spark):
    assert one(spark, T.fold(F.lit("ÉÀÇ œuvre Ñ"))) == "eac oeuvre n"
    assert one(spark, T.heading_normal(F.lit("  Chap. I -- The END! "))) == "chap i the end"
    assert one(spark, T.is_licence(F.lit("THE FULL  Project Gutenberg License"))) is True
    assert one(spark, T.is_x_marked(F.lit("a [xx] b"))) is True and one(spark, T.is_x_marked(F.lit(None).cast("string"))) is False
    assert one(spark, T.byte_truncate(F.lit("aé漢"), 3)) == "aé" and one(spark, T.byte_truncate(F.lit("aé漢"), 5)) == "aé"
    assert one(spark, T.ellipsis(F.lit("abcdef"), 3)) == "abc..." and one(spark, T.word_size(F.lit(" "))) == 1
    assert one(spark, T.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("b"), F.lit("c")))) == 1.0
    assert one(spark, T.escape_xml(F.lit("<a&'\">"))) == "&lt;a&amp;&apos;&quot;&gt;"
    assert one(spark, T.escape_query(F.lit("a+b (c)"))) == r"a\+b \(c\)"
    assert bytes(one(spark, T.binary_object(F.lit("aGVs\n bG8=")))) == b"hello"


def test_selectors(spark):
    good, bad = ("_2.93:5..4.1:7", "_3", "_2..3", "_01.2:0..1.20:9"), ("_3:4", "_0.1..2", "2.3", "_1..2..3", "", "_" + "1." * 65 + "1")
    for s in good:
        assert fragments.parse_selector(s).normal().replace("01", "1") == s.replace("01", "1")
    for s in bad:
        with pytest.raises(ValueError):
            fragments.parse_selector(s)
    rows = spark.createDataFrame([(s,) for s in good + bad], "s string")
    assert [r[0] for r in rows.select(fragments.selector_columns(F.col("s"))["valid"]).collect()] == [True] * len(good) + [False] * len(bad)
    assert fragments.parse_legacy("2.93") == ((2,), 93)
    for s in ("20", "2:93", "0.1", "1.x"):
        with pytest.raises(ValueError):
            fragments.parse_legacy(s)


def test_ranges():
    paragraphs = ["one two", "a🙂b", "three"]
    assert fragments.resolve(paragraphs, 1, 4, 3, 2) == "two\na🙂b\nth"
    assert fragments.resolve(paragraphs, 2, 1, 2, 3) == "🙂"
    for args in ((2, 2, 2, 3), (2, 1, 1, 1), (1, 0, 9, 1), (1, 3, 1, 3), (1, 0, 1, 99)):
        with pytest.raises(ValueError):
            fragments.resolve(paragraphs, *args)


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=30))
def test_whole_paragraph_round_trip(text):
    assert fragments.cut(text, 0, fragments.units(text)) == text


def test_language():
    assert detect("<TEI><teiHeader>le la les</teiHeader><p>" + "the cat of the house was in that street with it and he was for his " * 3) == "en"
    assert detect("der hund und die katze nicht ein haus mit dem von sich auf zu den und das ist " * 3) == "de"
    assert detect("short") is None


def test_relocation(spark):
    cols = "path string, parent string, head string, position int, chain string, occurrence int, digest string"
    before = spark.createDataFrame([("/a/b/one", "/a/b", "One", 0, "one", 1, "d1"), ("/a/b/two", "/a/b", "The second chapter", 1, "the second chapter", 1, "d2"), ("/a/b/gone", "/a/b", "Quite other", 2, "quite other", 1, "d3"), ("/a/b/same", "/a/b", "Same", 3, "same", 1, "d4"), ("/a/b/chain", "/a/b", "Chain", 4, "chain", 1, "d5")], cols)
    after = spark.createDataFrame([("/a/b/uno", "/a/b", "Uno", 0, "uno", 1, "d1"), ("/a/b/second", "/a/b", "Second chapter", 1, "second chapter", 1, "x2"), ("/a/b/same", "/a/b", "Same", 2, "same", 1, "d4"), ("/a/b/chain_2", "/a/b", "Chain", 3, "chain", 1, "x5"), ("/a/b", "/a", "B", 0, "b", 1, "x6")], cols)
    got = {r["old"]: (r["new"], r["reason"]) for r in relocate.match(before, after).collect()}
    assert got == {"/a/b/one": ("/a/b/uno", "MOVED"), "/a/b/two": ("/a/b/second", "MOVED"), "/a/b/chain": ("/a/b/chain_2", "MOVED"), "/a/b/gone": ("/a/b", "PARENT")}


def test_repointing_swaps(spark):
    earlier = spark.createDataFrame([("/o", "/a", "MOVED"), ("/b", "/z", "MOVED")], "old string, new string, reason string")
    moves = spark.createDataFrame([("/a", "/b", "MOVED"), ("/c", "/a", "MOVED")], "old string, new string, reason string")
    live = spark.createDataFrame([("/b",), ("/a",)], "path string")
    got = {r["old"]: r["new"] for r in relocate.repointed(earlier, moves, live).collect()}
    assert got == {"/o": "/b", "/a": "/b", "/c": "/a"}
    refs = spark.createDataFrame([(1, "/a"), (2, "/c"), (3, "/x")], "id int, path string")
    assert {r["id"]: r["path"] for r in relocate.rewritten(refs, moves).collect()} == {1: "/b", 2: "/a", 3: "/x"}


@pytest.mark.parametrize("query", ["reembed_collection", "reembed_stored"])
def test_reembedded_zeros_keep_their_sign(spark, duck, tmp_path, query):
    """What rounds to zero from below is -0.0, as in the SQL; ties of the scaled value go away from zero."""
    import math

    from quire import plans

    values = [-1e-8, 1e-8, -0.0, 0.0, -2.5e-7, 2.5e-7, 0.12345675, -1.00000025, 3.0] + [0.5] * 55
    spark.createDataFrame([(0, 1, values)], "vec_id long, label long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = plans.QUERIES[query](spark, str(tmp_path)).first()["embedding"]
    want = duck.execute(plans.SQL[query].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchone()[2]
    assert [(x, math.copysign(1, x)) for x in got] == [(x, math.copysign(1, x)) for x in want]
    assert math.copysign(1, got[0]) == -1


def test_many_clashing_names_take_linear_time(spark):
    import time

    from quire.operators import catalog

    n = 15_000
    rows = spark.range(n).select(F.col("id"), F.lit(1).alias("owner"), F.lit("Work").alias("head"), F.lit("work").alias("slug"))
    taken = spark.createDataFrame([(1, "work")], "owner int, slug string")
    start = time.time()
    got = {r["slug"] for r in catalog.unclashing(rows, taken, "slug", "owner", "id").collect()}
    assert got == {f"work_{i + 2}" for i in range(n)} and time.time() - start < 10


def test_many_last_names_take_little_time_each(spark):
    """A last name costs no call of a function of its own; a name known in another spelling keeps its identifier."""
    import time

    from quire.sources.library import authors_found

    n = 12_000
    parsed = spark.range(n).select(F.array(F.concat(F.lit("Jo N"), "id")).alias("authors"))
    known = spark.range(5).select(F.concat(F.lit("N"), "id", F.lit(", Jó")).alias("original_name"), F.lit("").alias("key"), F.concat(F.lit("k"), "id").alias("author_id"))
    start = time.time()
    got = {r["original_name"]: r["author_id"] for r in authors_found(parsed, known).collect()}
    assert got == {f"Jo N{i}": f"k{i}" if i < 5 else f"n{i}" for i in range(n)}
    assert time.time() - start < 30  # of which Spark takes some ten to start its workers
