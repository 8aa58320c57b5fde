import zlib

import pytest
from conftest_llm import ODD, prose
from pyspark.sql import functions as F

from fluxgate.llm import kd_shards as K


def check(rows, out):
    want = sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows if d is not None)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in out if r.doc_id is not None) == want
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


@pytest.mark.parametrize("shards", [16, 5, 1])
@pytest.mark.parametrize("block", [10, 20_000])
def test_even_bytes(documents, monkeypatch, shards, block):
    monkeypatch.setattr(K, "ROWS_PER_BLOCK", block)
    rows = [(d, prose(d, 5 + d % 30), "hot" if d % 3 else f"s{d % 17}") for d in range(1500)]
    out = K.kd_shards(documents(rows, shard="x", slot="y", tie="z"), shards).collect()
    check(rows, out)
    total = sum(r["size"] for r in out)
    by = {}
    for r in out:
        by[r.shard] = by.get(r.shard, 0) + r["size"]
    assert set(by) == set(range(shards))
    assert all(abs(v - total / shards) < 0.05 * total / shards + 400 for v in by.values())


def test_equal_rows_can_be_divided(documents):
    rows = [(7, "the same text", "hot")] * 900 + [(d, prose(d, 4), "b") for d in range(100)]
    out = K.kd_shards(documents(rows), 8).collect()
    check(rows, out)
    by = [sum(r["size"] for r in out if r.shard == s) for s in range(8)]
    assert max(by) < 1.2 * min(by)


def test_target_bytes(documents):
    rows = [(d, "x" * 99) for d in range(100)]
    assert {r.shard for r in K.kd_shards(documents(rows), target_bytes=2500).collect()} == {0, 1, 2, 3}


def test_odd_rows(documents):
    check(ODD, K.kd_shards(documents(ODD), 16).collect())
    assert K.kd_shards(documents([]), 16).collect() == []


def test_splits_follow_metadata(documents):
    rows = [(d, "some words of one length", "abcdefgh"[d // 100]) for d in range(800)]
    out = K.kd_shards(documents(rows), 2)
    left, right = (out.where(F.col("shard") == s).agg(F.min("doc_id"), F.max("doc_id")).first() for s in (0, 1))
    assert left[1] < right[0] or right[1] < left[0]
