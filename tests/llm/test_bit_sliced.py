import math
import random
from fractions import Fraction

import numpy as np
import pytest

from fluxgate.llm import bit_sliced as B


def brute(rows, every, k):
    good = []
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [math.floor(Fraction(x) * 1024) for x in v]))
    out, asked = [], {}
    for i, v in good:
        if i % every == 0:
            asked[i] = min(asked.get(i, v), v)
    for q, a in asked.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=True)), i) for i, v in good if i != q and len(v) == len(a))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def frame(spark, rows, **more):
    return spark.createDataFrame([(*r, *more.values()) for r in rows], "vec_id long, embedding array<double>" + "".join(f", {c} string" for c in more))


@pytest.mark.parametrize(("dim", "spread"), [(64, 0.1), (5, 3.0), (1, 100.0), (8, 0.0005)])
def test_equals_brute_force(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(B, "BLOCK", 70)
    monkeypatch.setattr(B, "GROUP_QUERIES", 5)
    monkeypatch.setattr(B, "PASS_GROUPS", 2)
    rng = np.random.default_rng(dim)
    rows = [(i, (rng.standard_normal(dim) * spread).tolist()) for i in range(600)]
    got = B.exact_top_k(frame(spark, rows, ids="a", data="b", part="c", dim="d", at="e"), every=25, k=7).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 25, 7)


def test_ties_and_hot_vector(spark):
    rows = [(i, [0.5, 0.25]) for i in range(300)] + [(1000 + i, [0.5, 0.5]) for i in range(3)]
    got = B.exact_top_k(frame(spark, rows), every=100, k=5).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 100, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (None, [1.0, 1.0]), (6, [1.0]), (7, [0.0, -1.0]), (7, [0.0, -1.0]), (0, [1.0, 2.0]), (8, [1e12, -1e12]), (-100, [3.0, 1.0])]
    got = B.exact_top_k(frame(spark, rows), every=100, k=3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 100, 3)


def test_empty(spark):
    assert B.exact_top_k(frame(spark, [])).collect() == []
    assert B.exact_top_k(frame(spark, [(1, [1.0])])).collect() == []


def test_add_slices():
    r = random.Random(2)
    numbers = [[r.randrange(1 << 9) for _ in range(128)] for _ in range(13)]
    columns = [np.stack([B.bitmap(np.array([x >> b & 1 for x in row], np.uint8)) for row in numbers]) for b in range(9)]
    sums = B.add_slices(columns)
    bits = [np.unpackbits(s.view(np.uint8), bitorder="little") if s is not None else np.zeros(128) for s in sums]
    assert [sum(int(b[i]) << c for c, b in enumerate(bits)) for i in range(128)] == [sum(row[i] for row in numbers) for i in range(128)]


def test_few_rows_are_resolved():
    rng = np.random.default_rng(1)
    rows = np.floor(rng.standard_normal((4096, 64)) / 8 * 1024).astype(np.int64)
    block = B.Block(np.arange(4096), rows)
    assert len(B.block_top(block, rows[5], 5, 10, None)[0]) < 400


def test_repeated_query_with_an_odd_copy(spark):
    odd = [None, [], [None, 5.0], [float("-inf"), 1.0], [float("nan"), 1.0]]
    rows = [(100 * i, v) for i, v in enumerate(odd)] + [(100 * i, [1.0, float(i)]) for i in range(len(odd))] + [(1, [2.0, 1.0]), (2, [0.0, 3.0])]
    got = B.exact_top_k(frame(spark, rows), every=100, k=3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 100, 3) and {r[0] for r in got} == {0, 100, 200, 300, 400}


def test_wide_components_are_exact(spark):
    rows = [(0, [1.0, 1.0]), (1, [200000.0, 0.0]), (2, [190000.0, 0.0]), (3, [180000.0, 0.0]), (4, [3e9, -1.0]), (5, [2.0**40, 0.5]), (6, [2.0**40, 0.25]), (7, [2.0**42, -1.0]), (8, [0.5, 0.125])]
    got = B.exact_top_k(frame(spark, rows), every=100, k=6).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 100, 6)
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == [7, 5, 6, 4, 1, 2]
    rows = [(0, [2.0**21, 2.0**21 - 1]), (1, [200000.0, -0.001]), (2, [199999.0, 1.0]), (3, [-1e6, 1e6]), (4, [1e6, 1e6])]
    got = B.exact_top_k(frame(spark, rows), every=100, k=3).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 100, 3)


@pytest.mark.parametrize("x", [1e30, 1.7e308])
def test_what_leaves_64_bits_raises(spark, x):
    with pytest.raises(Exception, match="beyond"):
        B.exact_top_k(frame(spark, [(0, [x]), (1, [x])])).collect()
