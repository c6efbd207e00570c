"""Addresses, includes and languages on small made cases."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import address, languages
from quire.sources import include

XI = 'xmlns:xi="http://www.w3.org/2001/XInclude"'


def test_addresses_end_with_a_code(spark):
    works = spark.createDataFrame([("doe", "sea", "1"), ("doe", "sky", "2"), ("roe", "twin", "3"), ("roe", "twin", "4")], "author string, slug string, id string")
    rows = [("1a", "1", "one", 2, "div"), ("1b", "1", None, 3, "div"), ("1p", "1", None, 1, "p"), ("1q", "1p", None, 1, "hi"), ("1c", "1a", "deep", 1, "div"), ("1d", "1a", "same", 2, "div"), ("1e", "1a", "same", 3, "div"), ("2a", "2", "x", 1, "div")]
    elements = spark.createDataFrame(rows, "id string, parent_id string, slug string, nth int, name string")
    want = {"/doe/sea": (200, "1"), "doe//sea/one.html?x": (200, "1a"), "/doe/sea/_2": (200, "1a"), "/doe/sea/_+2/_1": (200, "1c"), "/doe/sea/_1/_1": (200, "1q"), "/doe/sea/_2/deep": (200, "1c"), "/doe/sea/_3": (500, None), "/doe/sea/one/same": (500, None), "/doe/sea/one/_3": (200, "1e"), "/roe/twin": (500, None), "/roe/twin/_1": (500, None), "/doe/none": (404, None), "/doe/sea/_4": (404, None), "/doe/sea/_0": (404, None), "/doe/sea/_-1": (404, None), "/doe/sea/_": (500, None), "/doe/sea/_x/_1": (500, None), "/doe/sea/nope/_1": (404, None), "/doe": (400, None), "": (400, None), None: (400, None)}
    got = address.walked(spark.createDataFrame([(a,) for a in want], "address string").withColumn("extra", F.lit(1)), works, elements).collect()
    assert {r["address"]: (r["code"], r["id"]) for r in got} == want and len(got) == len(want) and got[0]["extra"] == 1
    assert address.walked(spark.createDataFrame([], "address string"), works, elements).collect() == []


def test_includes(spark):
    one = f'<a {XI}><xi:include href="sub/b.xml"/><xi:include href="c.txt" parse="text"/></a>'
    files = {
        "x/a.xml": one, "x/sub/b.xml": f'<b {XI}><xi:include href="../../shared.xml"/></b>', "shared.xml": "<s>é</s>", "x/c.txt": "1 < 2", "x/again.xml": one,
        "self.xml": f'<a {XI}><xi:include href="self.xml"/></a>', "above.xml": f'<a {XI}><xi:include href="self.xml"/></a>', "text.xml": f'<a {XI}><xi:include href="text.xml" parse="text"/></a>',
        "gone.xml": f'<a {XI}><xi:include href="no.xml"/></a>', "fall.xml": f'<a {XI}><xi:include href="no.xml"><xi:fallback>F<i/></xi:fallback></xi:include></a>', "bad.xml": f'<a {XI}><xi:include href="broken.xml"/></a>', "broken.xml": "<b>", "point.xml": f'<a {XI}><xi:include href="shared.xml" xpointer="p"/></a>', "plain.xml": "<p/>",
    }
    rows = spark.createDataFrame([(n, c.encode()) for n, c in files.items()], "name string, content binary")
    wanted = rows.where(~F.col("name").isin("shared.xml", "x/c.txt", "x/sub/b.xml", "broken.xml"))
    got = {r["name"]: (bytes(r["content"]).decode().replace(f" {XI}", "").split("?>")[-1] if r["content"] is not None else None, r["error"]) for r in include.expanded(wanted, rows).collect()}
    assert got["x/a.xml"] == got["x/again.xml"] == ("<a><b><s>é</s></b>1 &lt; 2</a>", None)
    assert got["plain.xml"] == ("<p/>", None) and got["fall.xml"] == ("<a>F<i/></a>", None) and got["text.xml"][0].startswith("<a>&lt;a")
    for name, said in (("self.xml", "itself"), ("above.xml", "itself"), ("gone.xml", "no.xml is not there"), ("bad.xml", "no element"), ("point.xml", "xpointer")):
        assert got[name][0] is None and said in got[name][1], (name, got[name])
    assert len(got) == 10


def test_import_with_includes(spark, tmp_path):
    from quire.sources.library import Library

    tei = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title><author>Doe</author></titleStmt></fileDesc></teiHeader><text><body><div><head>Play</head>{}</div></body></text></TEI>'
    part = '<div xmlns="http://www.tei-c.org/ns/1.0"><head>Scene</head><p>words</p></div>'
    rows = spark.createDataFrame([("a.xml", tei.format(f'<xi:include {XI} href="p.xml"/>').encode()), ("b.xml", tei.format(f'<xi:include {XI} href="b.xml"/>').encode()), ("p.xml", part.encode())], "name string, content binary")
    own = Library(spark, f"file://{tmp_path}/library")
    done = own.import_files(rows.where("name != 'p.xml'"), repository=rows)
    assert (done["files"], done["divisions"], done["failed"]) == (1, 2, 1)
    assert {r["path"] for r in own.read("divisions").collect()} == {"/doe/play", "/doe/play/scene"} and "itself" in own.read("failures").first()["error"]


def test_languages_are_learned(spark):
    texts = {"en": "the cat of the house was in that street with it and he was for his house and cat ", "de": "der hund und die katze nicht ein haus mit dem von sich auf zu den und das ist ", "gr": "και το σπίτι της γάτας είναι στον δρόμο που δεν ξέρω με τον σκύλο "}
    rows = spark.createDataFrame([(k, t * 3) for k, t in texts.items()] + [("en", None), (None, "xx")], "lang string, text string")
    det = languages.Detector(languages.trained(rows))
    asked = [("the house of the cat was with his street and that was it in the house of his cat", "en"), ("<TEI><teiHeader>the cat of the house</teiHeader><p>" + "das haus und der hund ist nicht auf dem " * 3, "de"), ("Το σπίτι της γάτας δεν είναι με τον σκύλο " * 3, "gr"), ("the cat", None), ("12345 " * 40, None), (None, None), ("", None)]
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(asked)], "i int, t string").select("i", det.detected(F.col("t")).alias("lang")).collect()
    assert [r["lang"] for r in sorted(got)] == [w for _, w in asked]
    assert languages.Detector(languages.trained(rows.limit(0))).of("any text " * 20) is None


def test_language_of_a_text_with_longer_quotes(spark):
    """A passage of another language, even a longer one, does not make the text's language; a line that all languages share says nothing."""
    en, de = "the cat of the house was in that street with it and he was for his house and cat. ", "der hund und die katze nicht ein haus mit dem von sich auf zu den und das ist. "
    notice = "\nall rights reserved by license "
    rows = spark.createDataFrame([(k, f"{t * 3}{notice}{i}") for k, t in (("en", en), ("de", de)) for i in range(20)], "lang string, text string")
    det = languages.Detector(languages.trained(rows))
    quote = de.capitalize() * 2
    asked = [(f"He was in the street with {quote}that cat of the house and it was his.", "en"), (f"{quote}The cat was in that house of the street, and it was his.", "en"), (f"Der hund und das haus.{notice * 6}", "de")]
    assert [det.of(t) for t, _ in asked] == [w for _, w in asked]
    assert det.of("der " * 40 + "the cat of the house was in that street with it") == "en"


def test_every_text_teaches_as_a_whole(spark):
    """However many texts a language has, and wherever in a text a word stands, it counts."""
    rows = spark.range(2600).select(F.lit("en").alias("lang"), F.concat(F.repeat(F.lit("the cat "), 500), F.lit("late "), F.col("id")).alias("text"))
    model = {r["gram"]: (r["n"], r["total"]) for r in languages.trained(rows).collect()}
    assert model["=the"] == model["=cat"] == model["=late"] == (2600, 2600)


def test_language_of_a_text_that_ends_in_passages_of_two_others(spark):
    texts = {"en": "the cat of the house was in that street with it and he was for his house and cat. ", "de": "der hund und die katze nicht ein haus mit dem von sich auf zu den und das ist. ", "fr": "le chat de la maison est dans une rue que les chiens pas des qui et avec elle. "}
    det = languages.Detector(languages.trained(spark.createDataFrame([(k, t * 3) for k, t in texts.items()], "lang string, text string")))
    en, de, fr = (texts[k].capitalize() for k in ("en", "de", "fr"))
    assert det.of(f"{en * 6}\n{fr}\n{de}") == "en" and det.of(f"{de * 6}\n{en}\n{fr}") == "de"


@pytest.mark.parametrize(("text", "want"), [("ÉTÉ Łódź", "ete lodz"), ("Ἀνθρώπους", "ανθρωπους"), ("Ёлка ЙОД", "елка иод"), ("Việt ẞ Ǆ", "viet ss ǆ"), ("é", "e")])
def test_accents_of_any_script_fold(spark, text, want):
    assert T.folded(text) == want == spark.range(1).select(T.fold(F.lit(text))).first()[0]


def test_theme_by_rules(spark):
    from quire.functions import theme

    cases = {
        '<div><head>A &amp; B</head><p class="x" rend="y">t</p></div>': '<div><p class="unspecified-heading">A &amp; B</p><p class="y" rend="y">t</p></div>',
        '<div type="div2"><head data-fragment-from="1">A<lb/>B</head></div>': '<div type="div2"><h2 data-fragment-from="1">A B</h2></div>',
        '<div type="other"><head>gone</head><figure/><!-- c --><?pi x?></div>': '<div type="other"><img class="illustration" src="/at/_binary/"/></div>',
        "<sp><l>a<note n='1'>say \"no\"</note></l></sp>": '<div class="sp"><p class="l">a<button type="button" class="btn note" data-toggle="tooltip" data-placement="top" title="say &quot;no&quot;"><sup>1</sup></button></p></div>',
        "<p data-projection-id='2'/>": "<p></p>",
        "<broken>": None,
        "": None,
        None: None,
    }
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    got = rows.select("i", theme.themed(F.col("x"), F.lit("Doe"), F.lit("/at")).alias("h")).orderBy("i").collect()
    assert [r["h"] for r in got] == list(cases.values())
    assert "<h2 class=\"author\">Doe &lt;</h2>" in theme.html_of('<div type="div1"><head>x</head></div>', "Doe <")


def test_export_ends_at_its_depth(spark):
    from quire.operators import tree

    elems = spark.createDataFrame([("w", None, "work", 1), ("a", "w", "one", 2), ("b", "w", "two", 1), ("c", "b", "deep", 1), ("v", None, "leaf", 1)], "id string, parent_id string, slug string, pos int")
    placed = tree.paths(elems).join(elems.select("id", "parent_id"), "id")
    works = spark.createDataFrame([("w", "en", ["doe", "roe"], "f"), ("v", "en", ["doe"], "e"), ("x", None, ["doe"], "e")], "root_id string, lang string, authors array<string>, filename string")
    rows = {d: sorted((r["path"], r["place"], r["collection"]) for r in tree.exported(placed, works, d).collect()) for d in (1, 2, 3)}
    top = [("/en", 1, True), ("/en/doe", 1, True), ("/en/roe", 2, True)]
    assert rows[1] == sorted([*top, ("/en/doe/leaf.txt", 1, False), ("/en/doe/work.txt", 2, False), ("/en/roe/work.txt", 1, False)])
    two = [("/en/doe/leaf.txt", 1, False), ("/en/doe/work", 2, True), ("/en/roe/work", 1, True)]
    assert rows[2] == sorted([*top, *two, *((f"/en/{a}/work/{n}.txt", p, False) for a in ("doe", "roe") for n, p in (("two", 1), ("one", 2)))])
    assert ("/en/roe/work/two/deep.txt", 1, False) in rows[3] and ("/en/roe/work/two", 1, True) in rows[3]


def test_batches_are_numbered_without_the_driver(spark):
    from quire.sources import repos

    rows = spark.createDataFrame([(i % 37, str(i)) for i in range(500)], "k int, v string").repartition(7)
    want = [(k, v, n // 64) for n, (k, v) in enumerate(sorted((i % 37, str(i)) for i in range(500)))]
    assert sorted((r["k"], r["v"], r["batch"]) for r in repos.numbered(rows, "k", 64).collect()) == sorted(want)
    assert repos.numbered(rows.limit(0), "k").collect() == []


def test_scratch_is_removed(spark, tmp_path, monkeypatch):
    from quire.functions import shared

    monkeypatch.setattr(shared, "root", lambda spark: f"file://{tmp_path}")
    with shared.scratch(spark):
        shared.written(spark.range(3), "a")
        with shared.scratch(spark):
            shared.written(spark.range(3), "b")
        assert len(list((tmp_path / "quire").iterdir())) == 1
    assert list((tmp_path / "quire").iterdir()) == [] and shared.written(spark.range(2), "c").count() == 2


def test_names_of_an_owner_go_on_where_numbering_stopped(spark):
    from pyspark.sql import functions as F

    from quire.operators import state

    rng = random.Random(3)
    long = "n" * 199
    names = ["a", "a (2)", "a (2) (2)", "a\n", "a\n (3)", "b (x", long, long[:195] + " (2)", "c" * 94 + " (2) (2)" * 15]
    rows = [(o, i, rng.choice(names)) for o in ("x", "y", None) for i in range(300)]
    want = []
    for o in ("x", "y", None):
        used: set[str] = set()
        for _, i, n in (r for r in rows if r[0] == o):
            want.append((o, i, state.first_free(n, used)))
            used.add(want[-1][2])
    saved = spark.createDataFrame(rows, "owner string, id long, name string")
    got = [tuple(r) for r in state.unique_names(saved.orderBy(F.rand(1)), "owner", "name", "id").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    # as many of one name as would take an hour if each were counted from two on
    one = state.unique_names(spark.range(60_000).select(F.lit(1).alias("owner"), "id", F.lit("a").alias("name")), "owner", "name", "id")
    began = time.monotonic()
    assert one.agg(F.max(F.when(F.col("id") == 59_999, F.col("name")))).first()[0] == "a (60000)"
    assert time.monotonic() - began < 60


def test_files_are_parsed_in_parts(spark):
    from quire.sources import tei

    rng = random.Random(2)
    words = ["some", "Words", "é", " of", "a b", "\n"]
    div = lambda h: f"<div><head>{h}</head>" + "".join(f"<p>{' '.join(rng.choices(words, k=400_000))}</p>" for _ in range(6)) + "</div>"
    x = f'<TEI><teiHeader><fileDesc><titleStmt><title>T</title><author>A</author></titleStmt></fileDesc></teiHeader><text><body><div><head>All</head>{div("One ")}{div("Two")}</div></body></text></TEI>'
    files = spark.createDataFrame([("a.xml", x.encode()), ("b.xml", b"<TEI>"), ("c.xml", b"<TEI/>")], "name string, content binary")
    rows = tei.parsed_in_parts(files).collect()
    large = sorted((r for r in rows if r["name"] == "a.xml"), key=lambda r: r["part"])
    # no row is as large as the file, and all is there once
    assert len(large) > 3 and max(sum(len(p["text"]) for p in r["paragraphs"]) for r in large) < 2 * tei.PART
    whole = tei.parse("a.xml", x.encode())
    assert [p.asDict() for r in large for p in r["paragraphs"]] == whole["paragraphs"]
    assert [d.asDict() | {"text": None} for d in large[0]["divs"]] == [d | {"text": None} for d in whole["divs"]] and not any(r["divs"] or r["authors"] for r in large[1:])
    assert [(r["name"], r["part"], r["error"] is None) for r in rows if r["name"] != "a.xml"] == [("b.xml", 0, False), ("c.xml", 0, True)]
    made = spark.createDataFrame([(d["head"], d["text"], d["digest"]) for d in whole["divs"]], "head string, text string, digest string")
    assert made.where(T.text_digest(F.col("head"), F.col("text")) != F.col("digest")).isEmpty()


def test_a_file_in_pieces_is_read_as_a_whole_one():
    """Divisions, their digests and paragraphs are those of the whole file, wherever the pieces end; nothing of a body stays."""
    from quire.sources import tei

    rng = random.Random(7)
    words = ["a", "É b", " ", "\n", "[x]", "<!-- c -->", "<![CDATA[<d>]]>", "&amp;", "<?p q?>", "<hi>e  f</hi>", "A"]
    text = lambda n: "".join(rng.choices(words, k=rng.randint(0, n)))

    def div(depth):
        head = lambda: rng.choice(["", "<head>A</head>", f"<head>A{text(3)}</head>", "<head>B <note>n</note></head>", "<head>[x]</head>" if rng.random() < 0.2 else ""])
        inner = [f"<p>{text(9)}</p>", text(4), "<p><floatingText><body><div><head>F</head>g</div></body></floatingText></p>"] + [div(depth + 1) for _ in range(rng.randint(0, 3 if depth < 3 else 0))]
        rng.shuffle(inner)
        return f"<div>{head()}{''.join(inner)}{head()}</div>"

    for round_ in range(150):
        body = f"<body>{text(3)}<p>out</p>{div(0)}{text(2)}{div(0)}</body>"
        front = "<front><div><head>No</head></div></front>"
        inner = f"<group><text>{body}</text></group>" if round_ % 5 == 0 else front + body
        x = f'<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title><author>A</author></titleStmt></fileDesc></teiHeader><text>{inner}</text></TEI>'.encode()
        whole, own, at = tei.parse("a.xml", x), tei.Stream(), 0
        while at < len(x):
            n = rng.randint(1, 60)
            own.feed(x[at : at + n])
            at += n
        root = own.done()
        rows = list(own.rows())
        assert rows == [d | {"text": None} for d in whole["divs"]]
        known = {d["dom_path"] for d in rows}
        key = lambda p: (p["div"], p["nth"])
        assert sorted((p for p in own.paragraphs if p["div"] in known), key=key) == sorted(whole["paragraphs"], key=key)
        assert tei.stated(root) == (["T"], ["A"]) and not root.getElementsByTagName("body")[0].childNodes
    long = "<TEI><teiHeader>das ist ein Haus</teiHeader><text>" + "<p a='b'>the house of the cat and his street </p>" * 4000 + "</text></TEI>"
    for size in (1000, 70_001):
        seen = tei.Opening()
        for at in range(0, len(long), size):
            seen.feed(long[at : at + size].encode())
        assert seen.language() == tei.detect(long) == "en" and len(seen.body) < len(long)


def test_a_file_of_many_rows_is_never_whole(spark, tmp_path):
    from quire.sources import tei
    from quire.sources.library import Library

    head = '<TEI><teiHeader><fileDesc><titleStmt><title>T</title><author>Doe</author></titleStmt></fileDesc></teiHeader><text><body><div><head>All</head>'
    n = tei.LOT + 50
    first = spark.createDataFrame([("a.xml", 0, head.encode()), ("a.xml", n + 1, b"</div></body></text></TEI>"), ("a.xml", n + 2, None), ("b.xml", 0, head.encode())], "name string, seq long, content binary")
    files = first.unionByName(spark.range(1, n + 1).select(F.lit("a.xml").alias("name"), F.col("id").alias("seq"), F.encode(F.format_string("<div><head>Doc %d</head><p>t%d</p></div>", "id", "id"), "UTF-8").alias("content")))
    own = Library(spark, f"file://{tmp_path}/library")
    done = own.import_files(files)
    assert (done["files"], done["divisions"], done["failed"]) == (1, n + 1, 1)
    last = own.read("divisions").where(f"head = 'Doc {n}'").first()
    assert (last["path"], last["xpath"], last["chain"]) == (f"/doe/all/doc_{n}", f"div[1]/div[{n}]", f"all / doc {n}")
    assert own.read("paragraphs").where("name = 'p' and text = concat('t', regexp_extract(path, '([0-9]+)$', 1))").count() == n
    rows = tei.parsed_in_parts(files).where("name = 'a.xml'")
    assert rows.agg(F.max(F.size("divs"))).first()[0] == tei.LOT


def test_many_includes_take_time_in_proportion():
    def took(n):
        x = f"<b {XI}>" + "".join(f'<xi:include href="{i}.xml"/>-' for i in range(n)) + "</b>"
        parts = {(f"{i}.xml", False): b"<p>%d</p>" % i for i in range(n)}
        began = time.perf_counter()
        out = include.put_in("a.xml", x.encode(), parts)
        assert out.decode().split(f"<b {XI}>")[1] == "".join(f"<p>{i}</p>-" for i in range(n)) + "</b>"
        return time.perf_counter() - began

    few = min(took(2000) for _ in range(3))
    assert took(16000) < 18 * few
