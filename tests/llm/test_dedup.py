import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import common, passage_dedup, simhash_dedup, suffix_dedup
from quire.llm.queries import QUERIES, SQL

LAST = 1 << 63


@pytest.mark.parametrize("name", ["op2_passage_dedup", "op9_suffix_dedup"])
def test_equals_sql(name, same_rows):
    assert same_rows(QUERIES[name], SQL[name]) == 200


def order(row):
    return LAST if row[0] is None else row[0]


def passages(rows):
    """Brute force of operator 2."""
    least = {}
    split = [(order(r), re.findall(rb"[^\x20\x09-\x0d]+", r[1].encode())) for r in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            least[key] = min(least.get(key, LAST), i)
    for i, w in split:
        gone = set()
        for k in range(len(w) - 12):
            if least[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        yield len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()


def test_passages_of_odd_rows(odd_documents, plain):
    rows = plain(odd_documents)
    got = passage_dedup.run(odd_documents, passage_dedup.digests, "doc_id long, n_words long, n_removed long, kept_sha256 string").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *x) for r, x in zip(rows, passages(rows), strict=True))


def test_windows_that_agree_in_one_hash_stay(odd_documents, plain, monkeypatch):
    """A chance agreement of the first 64 bits removes nothing."""
    rows = plain(odd_documents)
    docs = common.Docs(np.arange(len(rows)), np.arange(len(rows)), 0, np.append(0, np.cumsum([len(t.encode()) for _, t in rows])), np.frombuffer("".join(t for _, t in rows).encode(), np.uint8))
    true = passage_dedup.Words.hashes
    monkeypatch.setattr(passage_dedup.Words, "hashes", lambda self, at, n, second=False: true(self, at, n, second) if second else np.zeros(len(at), np.uint64))
    words, none = passage_dedup.Words(docs), np.zeros(0, np.int64)
    gone = passage_dedup.removed(docs, words, none, none)
    want = [x[1] for x in passages([(i, t) for i, (_, t) in enumerate(rows)])]
    assert np.bincount(words.doc[gone], minlength=len(rows)).tolist() == want and sum(want)


def suffixes(rows):
    """Brute force of operator 9."""
    first = {}
    raw = [(order(r), r[1].encode()) for r in rows]
    for i, b in raw:
        for k in range(len(b) - 99):
            key = b[k : k + 100]
            first[key] = min(first.get(key, (LAST + 1, 0)), (i, k))
    for i, b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if first[b[k : k + 100]] < (i, k):
                gone[k : k + 100] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        yield len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


SUFFIX = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def test_suffixes_of_odd_rows(odd_documents, plain):
    rows = plain(odd_documents)
    got = suffix_dedup.run(odd_documents, suffix_dedup.digests, SUFFIX).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], *x) for r, x in zip(rows, suffixes(rows), strict=True))


def by_key(tables, key):
    whole = pa.concat_tables(tables)
    return {k: whole.filter(pc.equal(whole.column(key), k)).combine_chunks() for k in whole.column(key).unique().to_pylist()}


def by_steps(rows):
    """The operator's steps in this process, over three blocks."""
    table = pa.table({"did": [order(r) if r[0] is not None else common.NO_ID for r in rows], "rid": [zlib.crc32(r[1].encode()) for r in rows], "block": pa.array([i % 3 for i in range(len(rows))], pa.int32()), "text": [r[1] for r in rows]})
    ends = np.array([b"a", b"d", b"start"], "S100")
    blocks = by_key([table], "block")
    marks = by_key([suffix_dedup.shared(t) for t in by_key([suffix_dedup.classes(4)(t) for t in blocks.values()], "bucket").values()], "block")
    none = pa.table({"block": pa.array([], pa.int32()), "marks": pa.array([], pa.binary())})
    dealt = by_key([suffix_dedup.deal(9, ends)(t, marks.get(k, none)) for k, t in blocks.items()], "bucket")
    final = by_key([suffix_dedup.sort_bucket(t) for t in dealt.values()], "block")
    return [tuple(r.values()) for k, t in blocks.items() for r in suffix_dedup.digests(t, final.get(k, none)).to_pylist()]


@pytest.fixture
def many_rows(odd_documents, plain):
    passage = "a passage that many of the documents hold in their middle, word by word, and longer than a window of a hundred bytes is, surely. "
    return plain(odd_documents) + [(200 + i, f"start {i} " * 9 + passage + f"end {i} " * 9) for i in range(12)] + [(300 + i, "x" * 120 + passage[i : i + 101]) for i in range(7)]


@pytest.mark.parametrize(("piece", "hot", "lot"), [(common.PIECE, suffix_dedup.HOT, suffix_dedup.LOT), (1500, suffix_dedup.HOT, 50), (common.PIECE, 1, suffix_dedup.LOT), (1500, 0, 50)])
def test_pieces_lots_and_hot_classes(many_rows, monkeypatch, piece, hot, lot):
    """Texts longer than a piece, buckets larger than a lot, classes that go by window."""
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "LOT", lot)
    assert Counter(by_steps(many_rows)) == Counter((r[0], *x) for r, x in zip(many_rows, suffixes(many_rows), strict=True))


def test_all_comes_from_the_order_of_suffixes(many_rows, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "suffix_order", lambda rows, depth: (np.arange(len(rows)), np.zeros(len(rows), np.int64)))
    assert {r[2] for r in by_steps(many_rows)} == {0}


def test_empty_tables(odd_documents):
    none = odd_documents.limit(0)
    assert suffix_dedup.run(none, suffix_dedup.digests, SUFFIX).count() == 0
    assert passage_dedup.passage_dedup(none).count() == 0
    assert simhash_dedup.simhash_components(none).count() == 0


def test_removed_characters_are_whole(spark):
    a = "é" * 200
    docs = spark.createDataFrame([(1, "z" + a, "en", "s", 201), (2, a, "en", "s", 200), (3, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in suffix_dedup.replaced(docs).collect()}
    assert len(got) == 3 and got[3]["text"] is None and got[3]["n_chars"] is None
    assert set(got[2]["text"]) <= {"é"} and got[2]["n_chars"] == len(got[2]["text"]) < 200


def test_difference_covers():
    assert (suffix_dedup.SHIFT >= 0).all() and suffix_dedup.SHIFT.max() < suffix_dedup.PERIOD
    inside = set(passage_dedup.COVER)
    for a in range(7):
        for b in range(7):
            assert any((a + s) % 7 in inside and (b + s) % 7 in inside for s in range(7))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 3), st.integers(1, 300))
def test_suffix_order_is_lexicographic(seed, letters, n):
    r = np.random.default_rng(seed)
    base = r.integers(97, 97 + letters, 400).astype(np.uint8)
    base[r.integers(0, 400, 3)] += 1
    rows = base[r.integers(0, 260, n)[:, None] + np.arange(132)]
    got, common_bytes = suffix_dedup.suffix_order(rows, 100)
    texts = [rows[i, :100].tobytes() for i in got.tolist()]
    assert sorted(got.tolist()) == list(range(n)) and texts == sorted(texts)
    for a, b, k in zip(texts, texts[1:], common_bytes[1:].tolist(), strict=False):
        assert a[:k] == b[:k] and (k == 100 or a[k] != b[k])


def test_buckets_are_ranges_of_suffixes(many_rows, spark):
    docs = spark.createDataFrame(many_rows, "doc_id long, text string")
    ends = suffix_dedup.splitters(docs, 8, common.text_size(docs))
    assert 1 <= len(ends) < 8 and ends.tolist() == sorted(ends.tolist())
    assert len(suffix_dedup.splitters(docs.limit(0), 8, 0)) == 0


def brute_components(fps):
    n = len(fps)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def fingerprint(text):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0d]+", text.encode().lower())
    s = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_of_odd_rows(odd_documents, plain):
    rows = plain(odd_documents)
    fps = [fingerprint(t) for _, t in rows]
    label = brute_components(fps)
    least = {x: min(order(r) for r, y in zip(rows, label, strict=True) if y == x) for x in label}
    want = Counter((common.NO_ID if r[0] is None else r[0], f, min(least[x], common.NO_ID)) for r, f, x in zip(rows, fps, label, strict=True))
    got = Counter((r["did"], r["fp"] % (1 << 64), r["component"]) for r in simhash_dedup.simhash_components(odd_documents).collect())
    assert got == want


def test_one_of_each_group_stays(odd_documents):
    kept = [r["doc_id"] for r in simhash_dedup.first_of_group(odd_documents).collect()]
    assert 1 in kept and 2 not in kept and 12 not in kept
    assert sorted(kept, key=str).count(6) == 2  # two texts that share a doc_id are two components


def test_a_row_of_each_component_stays(odd_documents, plain):
    """Also of components whose rows share a doc_id or have none."""
    rows = [*plain(odd_documents), (None, "alone here"), (None, "quite another text")]
    docs = odd_documents.select("doc_id", "text").unionAll(odd_documents.sparkSession.createDataFrame(rows[-2:], "doc_id long, text string"))
    label = brute_components([fingerprint(t) for _, t in rows])
    want = sorted(min(order(r) for r, y in zip(rows, label, strict=True) if y == x) for x in set(label))
    got = simhash_dedup.first_of_group(docs).collect()
    assert sorted(order(r) for r in got) == want
    assert {(6, "a b c"), (None, "alone here"), (None, "quite another text")} <= {tuple(r) for r in got}
    assert any(r["doc_id"] == 6 and r["text"] != "a b c" for r in got)


def test_trie_join_finds_all_links(spark):
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(0, 2**63, 60)]
    fps = list({*base, *(b ^ (1 << int(i)) for b in base for i in r.integers(0, 64, 4)), *(b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 64, (4, 2)))})
    label = brute_components(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash_dedup.trie_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    assert all(((e["a"] ^ e["b"]) % (1 << 64)).bit_count() > 0 for e in edges.collect())
    root = {r["node"]: r["root"] for r in simhash_dedup.components(edges).collect()}
    got = [root.get(s, s) for s in signed]
    assert len(set(zip(got, label, strict=True))) == len(set(got)) == len(set(label))
