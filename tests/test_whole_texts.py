"""The text queries over whole documents."""

import pytest

from fluxgate.plans import values  # noqa: F401
from fluxgate.plans.registry import QUERIES

LONG = "mot " * 100
TEXTS = [LONG + "\u00e9t\u00e9 \u00fc", LONG + "\u793e\u5b89 \u00e9", LONG + "end \t\n ", "", None, "\u00e9"]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame([(i, x, "en") for i, x in enumerate(TEXTS)], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    return d


def run(spark, docs, name):
    return {r.doc_id: r for r in QUERIES[name](spark, docs).collect()}


def test_latin1_repair(spark, docs):
    got = run(spark, docs, "latin1_repair")
    assert [(got[i].utf8, got[i].latin1) for i in range(len(TEXTS))] == [(x, x) for x in TEXTS]


def test_pad_trim(spark, docs):
    got = run(spark, docs, "string_pad_trim")
    for i, x in enumerate(TEXTS):
        n = None if x is None else len(x.encode())
        assert (got[i].text, got[i].bytes, got[i].padded) == (x and x.rstrip(), n, None if n is None else n + 160)


def test_rle_roundtrip(spark, docs):
    got = run(spark, docs, "rle_roundtrip")
    assert [(got[i].bytes, got[i].back) for i in range(len(TEXTS))] == [(None if x is None else len(x.encode()), x) for x in TEXTS]
