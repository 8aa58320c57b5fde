from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, seen = [n for n, _ in corpus_pipeline.STAGES], {"input": docs.count()}
    assert names == ["quality", "line_dedup", "near_copies", "mix", "pack"]
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, sf).collect(), docs.schema)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert {r.doc_id for r in rows} <= set(before)
        if name == "line_dedup":
            assert len(rows) == len(before) and all(r.n_chars == len(r.text) for r in rows)
            assert any(len(r.text) < len(before[r.doc_id].text) for r in rows)
        elif name == "mix":
            assert max(Counter(r.doc_id for r in rows).values()) <= 3
        else:
            assert len(rows) < len(before)
        seen[name] = len(rows)
    assert seen["quality"] > 0.7 * seen["input"]
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in kept.collect())


def test_run_equals_the_stages(spark, sf):
    a = corpus_pipeline.run(spark, sf)
    assert a.count() > 0 and a.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_clean_labelled_documents_stay(spark, sf):
    d = sf.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = [r.doc_id for r in spark.read.parquet(f"{d}/labels.parquet").where("quality = 1").collect()]
    kept = {r.doc_id for r in corpus_pipeline.keep_good(spark, docs, d).collect()}
    assert sum(g in kept for g in good) >= 0.99 * len(good)


def test_empty_documents(spark, sf):
    none = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 0")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf).collect() == []


def test_one_of_near_copies_stays_whatever_the_ids(spark, sf, documents):
    text = lambda w: " ".join(f"{w}{i}" for i in range(60))
    rows = [(i, text(w) + end) for i, w, end in [
        (None, "a", ""), (None, "a", " one"), (None, "a", " two"),
        (None, "b", ""), (7, "b", " one"), (8, "b", " two"),
        (9, "c", ""), (9, "c", " one"), (9, "c", " one"),
        (None, "alone", ""), (9, "other", ""),
    ]] + [(10, ""), (10, ""), (11, " ")]
    got = corpus_pipeline.keep_one_of_near_copies(spark, documents(rows), sf).collect()
    assert Counter((r.text or "").split("0")[0] for r in got) == {"a": 1, "b": 1, "c": 1, "alone": 1, "other": 1, "": 1, " ": 1}
    assert [r.doc_id for r in got if r.text.startswith("b0")] == [7]


def test_columns_that_clash(spark, sf):
    """Columns named like what operators make or hold themselves come out as they were."""
    names = ["lost", "all_lines", "kept_text", "n_lines", "h", "ps", "f", "u", "q", "cut", "fit", "certain", "size", "copy", "copies", "target", "score", "predicted", "root", "key", "th", "_row", "_copy"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 40")
    docs = docs.selectExpr("*", *[f"concat('{n} of ', doc_id) as {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name == "pack":
            break
        rows = docs.collect()
        docs = spark.createDataFrame(rows, docs.schema)
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names)
    assert docs.count() > 0


def test_odd_rows(spark, sf, documents):
    from conftest_llm import ODD, prose

    docs = documents(ODD + [(d, prose(d, 60) + "\na line that many documents share", None) for d in (20, 20, 21, None, None)])
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "line_dedup":
            assert len(rows) == docs.count()
        elif name == "near_copies":
            assert Counter((r.doc_id, r.text) for r in rows).most_common(1)[0][1] == 1
        docs = spark.createDataFrame(rows, out.schema)
