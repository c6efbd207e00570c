"""The pipeline against brute force, stage by stage on what the stage before kept."""

import hashlib


from test_dedup import brute_components, fingerprint, suffixes

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "benchmark decontamination", "byte-level BPE"]

    def after(name, df):
        out = corpus_pipeline.common.written(stages[name](spark, df, SMALL), "test")
        return out, sorted((r["doc_id"], r["text"]) for r in out.collect()) if "text" in out.columns else None

    judged = {r["doc_id"]: r["keep"] for r in corpus_pipeline.quality.op1_quality(spark, SMALL).collect()}
    kept, rows = after("quality classifier", docs)
    assert kept.columns == docs.columns
    assert rows == sorted((r["doc_id"], r["text"]) for r in docs.collect() if judged[r["doc_id"]])

    label = brute_components([fingerprint(t) for _, t in rows])
    want = [r for i, r in enumerate(rows) if label[i] == i]
    kept, rows = after("SimHash near-dedup", kept)
    assert kept.columns == docs.columns and rows == want

    found = list(suffixes(rows))
    before = rows
    kept, rows = after("suffix-array dedup", kept)
    assert kept.columns == docs.columns and [r[0] for r in rows] == [r[0] for r in before]
    for old, new, (size, gone, _, digest) in zip(before, rows, found, strict=True):
        if not gone:
            assert old[1] == new[1]
        elif old[1].isascii():
            assert len(new[1]) == size - gone and hashlib.sha256(new[1].encode()).hexdigest() == digest
        else:
            assert size - gone <= len(new[1].encode()) + 3 * 50

    leaks = {r["doc_id"] for r in corpus_pipeline.decontaminate.contaminated(kept, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    want = [r for r in rows if r[0] not in leaks]
    kept, rows = after("benchmark decontamination", kept)
    assert kept.columns == docs.columns and rows == want

    last, _ = after("byte-level BPE", kept)
    assert {r["doc_id"]: r["decoded_sha256"] for r in last.collect()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}


def test_run_is_the_stages(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 50


def test_odd_rows(odd_documents, spark, tmp_path):
    """Nulls in any column, repeated rows, shared ids, clashing columns: stage by stage by texts, and an empty table."""
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = stages["quality classifier"](spark, odd_documents, str(tmp_path))
    assert rows(kept) == rows(odd_documents)
    label = brute_components([fingerprint(t or "") for _, t in rows(kept)])
    alone = stages["SimHash near-dedup"](spark, kept, str(tmp_path))
    assert alone.count() == len(set(label))
    texts = stages["suffix-array dedup"](spark, alone, str(tmp_path))
    assert sorted(map(str, (r[0] for r in rows(texts)))) == sorted(map(str, (r[0] for r in rows(alone))))
    clean = stages["benchmark decontamination"](spark, texts, str(tmp_path))
    assert rows(clean) == rows(texts)
    last = stages["byte-level BPE"](spark, clean, str(tmp_path)).collect()
    want = sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows(clean))
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in last) == want
    odd_documents.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_only_the_last_stage_stays_on_disk(spark):
    mark = len(corpus_pipeline.common.PATHS)
    corpus_pipeline.run(spark, SMALL).count()
    assert len(corpus_pipeline.common.PATHS) == mark + 1
