import pytest

#: Names that the operators use inside, or that documents have in another case.
CLASHING = "block int, bucket int, did long, rid long, fp long, view long, kind int, marks binary, packed binary, w string, s string, h long, item long, key string, top int, n int, row long, sha string, component long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty texts, ties, repeated rows, ids with two texts, and extra columns with clashing names."""
    long = " ".join(f"word{i % 97} and{i % 13}" for i in range(400))
    other = long[:700] + " something else entirely stands here " + long[700:1500]
    rows = [(1, long), (2, long), (2, long), (None, long), (None, None), (3, None), (4, ""), (5, "  \n\t "), (6, other), (6, "a b c"), (7, "é漢🙂 " * 60), (8, "é漢🙂 " * 60), (9, "one"), (10, "x" * 5000), (11, "x" * 5000 + " y"), (12, other)]
    n = len(CLASHING.split(", "))
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None, len(t) if t and i != 6 else None, *[None] * n) for i, t in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


@pytest.fixture(scope="session")
def plain(spark):
    def rows(df):
        return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]

    return rows
