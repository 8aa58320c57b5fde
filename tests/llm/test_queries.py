"""The contract queries against their DuckDB twins, at the smallest size."""

import duckdb
import pytest

from fluxgate.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    res = duck.execute(ORACLES[name])
    own = [d[0] for d in res.description]
    assert sorted(own) == names
    want = sorted(str([r[own.index(c)] for c in names]) for r in res.fetchall())
    assert sorted(str([r[c] for c in names]) for r in df.collect()) == want


def test_columns_of_the_others(spark, sf):
    want = {
        "op2_kd_tree_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
        "op4_crf_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op5_large_item_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op7_byte_cnn_quality": ["doc_id", "held_out", "score", "predicted"],
    }
    for name, columns in want.items():
        df = QUERIES[name](spark, sf)
        assert df.columns == columns and df.count() > 0


def test_base_digest_of_the_query(spark, sf):
    from fluxgate.llm.pii_crf import base_digest, base_spans, span_text

    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op4_crf_pii"](spark, sf).collect():
        base = base_spans(text[r.doc_id])
        assert r.base_sha256 == base_digest(base) and r.n_email == sum(k == "email" for k, _, _ in base)
        assert set(filter(None, span_text(base).split(","))) <= set(r.spans.split(","))
