import random

import pytest
from conftest_llm import ODD, prose
from pyspark.sql import functions as F

from fluxgate.llm import mixing
from fluxgate.llm.mixing import mix_sources


def targets(sizes):
    """Shares by weight, with the excess over three times the size shared again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * left / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * left / w for s in free}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets(spark):
    r = random.Random(1)
    for _ in range(8):
        sizes = {s: r.choice([0, 1, 5, 50, 1000, 40000]) for s in ["a", "B", "ä", "z", "zz", None][: r.randrange(1, 7)]}
        if not sum(sizes.values()):
            continue
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {x.source: x.target for x in mixing.source_targets(df).collect()}
        assert got == pytest.approx(targets(sizes))


@pytest.mark.parametrize("slice_rows", [7, 20_000])
def test_near_targets(spark, documents, monkeypatch, slice_rows):
    monkeypatch.setattr(mixing, "ROWS_PER_SLICE", slice_rows)
    rows = [(d, prose(d, 3 + d * d % 40), "abcde"[min(4, d % 11)]) for d in range(600)]
    out = mix_sources(documents(rows, ps="x", q="y", fit="z", cut="w")).cache()
    for r in out.groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("copies").alias("c")).collect():
        assert abs(r.k - r.t) <= 2 and r.c <= 3
    again = mix_sources(documents(rows).repartition(5)).select("doc_id", "taken")
    assert sorted(again.collect()) == sorted(out.select("doc_id", "taken").collect())


def test_slices_do_not_matter(documents, monkeypatch):
    rows = [(d, prose(d, 3 + d * d % 40), "ab"[d % 7 > 0]) for d in range(300)]
    one = sorted(mix_sources(documents(rows)).select("doc_id", "taken").collect())
    monkeypatch.setattr(mixing, "ROWS_PER_SLICE", 11)
    assert sorted(mix_sources(documents(rows)).select("doc_id", "taken").collect()) == one


def test_odd_rows(documents):
    out = mix_sources(documents(ODD)).collect()
    assert len(out) == len(ODD)
    assert all(r.taken == r.copies * r["size"] and 0 <= r.copies <= 3 for r in out)
    assert {r.copies for r in out if r.doc_id == 4} and len({r.copies for r in out if r.doc_id == 4}) == 1


def test_empty_and_wordless(documents):
    assert mix_sources(documents([])).collect() == []
    assert [r.taken for r in mix_sources(documents([(1, "", "a"), (2, None, None)])).collect()] == [0, 0]


def test_rates_reach_the_target(spark):
    r = random.Random(4)
    for most in (3, 2):
        sizes = {s: [(r.choice([1, 2, 5, 20, 100, 3000]), r.randrange(1, 9)) for _ in range(r.randrange(1, 6))] for s in "abcdef"}
        sizes = {s: sorted(dict(v).items()) for s, v in sizes.items()}
        total = {s: sum(k * n for k, n in v) for s, v in sizes.items()}
        target = {s: total[s] * r.choice([0.1, 0.5, 1.0, 1.7, float(most)]) for s in sizes}
        df = spark.createDataFrame([(s, k, n) for s, v in sizes.items() for k, n in v], "source string, size long, n long")
        rates = mixing.copy_rates(df, spark.createDataFrame(list(target.items()), "source string, target double"), most)
        for x in rates.collect():
            got = sum(n * k * min(most, x.rate * int(k**0.5 * 16)) for k, n in sizes[x.source])
            assert got == pytest.approx(target[x.source])


def test_inclusion_frequencies(spark, documents):
    """Documents of one size come as often as their expected copies say."""
    rows = [(d, prose(d, [5, 20, 80, 320][d % 4]), "ab"[d % 3 > 0]) for d in range(1200)]
    copies, size = {}, {}
    for r in mix_sources(documents(rows)).collect():
        copies[r.doc_id], size[r.doc_id] = r.copies, (r.source, r["size"], r.target)
    for source in "ab":
        own = [d for d in size if size[d][0] == source]
        weight = {d: int(size[d][1] ** 0.5 * 16) for d in own}
        low, high = 0.0, 1.0
        for _ in range(100):
            rate = (low + high) / 2
            low, high = (rate, high) if sum(min(3, rate * weight[d]) * size[d][1] for d in own) < size[own[0]][2] else (low, rate)
        wants = {k: min(3, rate * int(k**0.5 * 16)) for k in {size[d][1] for d in own}}
        assert len(set(wants.values())) > 1
        for k, want in wants.items():
            same = [d for d in own if size[d][1] == k]
            assert abs(sum(copies[d] for d in same) / len(same) - want) < 0.15
            assert all(int(want) <= copies[d] <= int(want) + 1 for d in same)


def test_columns_that_clash(documents):
    rows = [(d, prose(d, 3 + d % 9), "ab"[d % 3 > 0]) for d in range(60)]
    names = ("h", "ps", "f", "u", "q", "cut", "fit", "certain", "rate", "most", "every", "copy")
    got = mix_sources(documents(rows, **{n: n.upper() for n in names}, size="old")).collect()
    assert all(r[n] == n.upper() for r in got for n in names) and all(isinstance(r["size"], int) for r in got)
