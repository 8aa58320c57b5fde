import random

import numpy as np
import pytest
from conftest_llm import ODD, prose
from pyspark.sql import functions as F

from fluxgate.llm import ngram_join as N


def brute(rows, n=3, percent=90):
    """(doc_id, n_shingles, component) by comparing all pairs."""
    sets = [(i, N.shingles(t, n)) for i, t, *_ in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=str)


def near_copies(seed=5):
    """Chains of copies with more and more edits, around the threshold."""
    r = random.Random(seed)
    rows, d = [], 0
    for g in range(25):
        base = prose(g, r.choice([4, 8, 15, 40, 120, 300])).split()
        for _ in range(12):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
                w[r.randrange(len(w))] = f"edit{r.randrange(1000)}"
            rows.append((d, " ".join(w)))
            d += 1
            if r.random() < 0.3:
                base = w
    return rows


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 75)])
def test_equals_brute_force(documents, n, percent):
    rows = near_copies()
    got = N.ngram_jaccard_components(documents(rows, key="k", label="l", n="z"), n, percent).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, n, percent)


def test_odd_rows(documents):
    got = N.ngram_jaccard_components(documents(ODD), 3, 90).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(ODD)


def test_ids_repeated_with_other_texts(documents):
    a, b = prose(1, 50), prose(2, 50)
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (None, a)]
    got = N.ngram_jaccard_components(documents(rows), 3, 90).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_empty(documents):
    assert N.ngram_jaccard_components(documents([])).collect() == []


def test_hot_group_emits_no_pairs(spark, documents):
    base = prose(9, 150).split()
    rows = [(i, " ".join(base[: i % 140] + [f"e{i}"] + base[i % 140 + 1 :])) for i in range(400)] + [(1000 + i, " ".join(base)) for i in range(300)]
    got = N.ngram_jaccard_components(documents(rows)).agg(F.countDistinct("component_id"), F.min("component_id")).first()
    assert tuple(got) == (1, 0)


def test_hamming_bounds_the_difference():
    r = random.Random(3)
    for _ in range(200):
        a = {r.getrandbits(64) for _ in range(r.randrange(1, 300))}
        b = set(r.sample(sorted(a), r.randrange(0, len(a) + 1))) | {r.getrandbits(64) for _ in range(r.randrange(0, 30))}
        if not b:
            continue
        for parts in (1, 4, 16, 32):
            x, y = (N.parity_words(np.array(sorted(s), np.uint64), parts) for s in (a, b))
            assert int(np.bitwise_count(x ^ y).sum()) <= len(a ^ b)


def test_linked_sets_share_a_signature():
    r = random.Random(4)
    for percent in (75, 80, 90, 95):
        for _ in range(300):
            n = r.randrange(1, 400)
            a = {r.getrandbits(64) for _ in range(n)}
            b = set(a)
            while True:
                c = set(b)
                if r.random() < 0.5 and len(c) > 1:
                    c.remove(r.choice(sorted(c)))
                else:
                    c.add(r.getrandbits(64))
                if 100 * len(a & c) < percent * len(a | c):
                    break
                b = c
            if a != b:
                hashes = [np.array(sorted(s), np.uint64) for s in (a, b)]
                x, y = (set(N.signatures(h, percent)[1].tolist()) for h in hashes)
                assert x & y, (percent, len(a), len(b))
                # whichever parts are hot
                hot = np.array(r.sample(sorted(x | y), len(x | y) // 2), np.uint64)
                x, y = (set(N.signatures(h, percent, hot)[1].tolist()) for h in hashes)
                assert x & y, (percent, len(a), len(b))


def test_folded_sketches():
    h = np.array([random.Random(8).getrandbits(64) for _ in range(300)], np.uint64)
    wide = N.parity_words(h, 16)
    assert (wide[:8] ^ wide[8:] == N.parity_words(h, 8)).all()


def test_holders_in_bounded_memory(monkeypatch):
    monkeypatch.setattr(N, "COUNTED", 50)
    r, holders = random.Random(6), N.Holders()
    for _ in range(200):
        holders.add(np.array([7, 9, *(r.getrandbits(60) for _ in range(8))], np.uint64))
    holders.merge()
    got = dict(zip(holders.sig.tolist(), holders.n.tolist(), strict=True))
    assert len(got) <= 50 and 150 < got[7] <= 200 and 150 < got[9] <= 200


@pytest.mark.parametrize(("hot", "cell"), [(10, 1_000), (10, 7)])
def test_hot_signatures_and_cells(documents, monkeypatch, hot, cell):
    monkeypatch.setattr(N, "HOT", hot)
    monkeypatch.setattr(N, "CELL", cell)
    rows = near_copies(12)
    shared = prose(99, 60)
    rows += [(5000 + i, prose(500 + i // 2, 40) + (f" x{i} " if i % 2 else " ") + shared) for i in range(80)]
    got = N.ngram_jaccard_components(documents(rows), 5, 80).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 5, 80)


def test_long_texts_that_share_a_passage(documents):
    shared = prose(77, 150)
    rows = [(i, prose(1000 + i, 500) + " " + shared) for i in range(1000)]
    rows += [(2000 + i, rows[i][1] + " tail") for i in range(0, 40, 2)]
    got = {r.doc_id: r.component_id for r in N.ngram_jaccard_components(documents(rows), 5, 80).collect()}
    assert all(got[i] == (i - 2000 if i >= 2000 else i) for i in got) and len(got) == len(rows)


def test_percent_range(documents):
    with pytest.raises(ValueError):
        N.ngram_jaccard_components(documents([]), 3, 50)
