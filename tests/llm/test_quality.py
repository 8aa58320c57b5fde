import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, prose

from fluxgate.llm import quality_cnn as Q
from fluxgate.llm.quality_rules import judge_quality


def brute_rules(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    hit = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


def test_rules_equal_brute_force(documents):
    rep = prose(1, 30)
    rows = [(i, t) for i, t in enumerate([prose(2, 100), rep + " " + rep, rep + "\n" + prose(3, 200) + "\t" + rep, "a " * 50, "b " * 8, "c " * 9, "x\n" * 40, "# $ | < > " * 9, " \n \n\t\n", "\x0b\x0cq", "É w   v " * 7, prose(5, 8), "one two three four five six seven eight nine one two three four five six seven eight"])]
    rows += [(d, t) for d, t, *_ in ODD]
    out = judge_quality(documents(rows, kept="x", n_words="y", _words="z")).collect()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((d, *brute_rules(t)) for d, t in rows)
    assert all(not r.kept for r in out if r.base_failed)


def test_rules_verdicts(documents):
    good, junk = prose(8, 120), [" ".join(x + "$$$" for x in prose(9, 60).split()), " | ".join(prose(10, 60).split()), prose(11, 60).upper(), "zxq " * 5 + " ".join(f"qqqq{i}" for i in range(60))]
    out = {r.doc_id: r.kept for r in judge_quality(documents([(0, good), *[(i + 1, j) for i, j in enumerate(junk)]])).collect()}
    assert out == {0: True, 1: False, 2: False, 3: False, 4: False}


def test_rules_are_one_native_stage(documents, capsys):
    judge_quality(documents([(1, "a")])).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan


def test_rules_empty(documents):
    assert judge_quality(documents([])).collect() == []


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = Q.Net.random(rng, 2, 3)
    net.filters = net.filters.astype(np.float64)
    net.table, net.out, net.bias, net.shift = (x.astype(np.float64) for x in (net.table, net.out, net.bias, net.shift))
    raw = prose(1, 150).encode()

    def loss():
        p = net.score(raw)
        return -np.log(p)

    grads = Q.gradients(net, raw, 1, 1.0)
    for p, g in zip(net.params(), grads, strict=True):
        for i in rng.integers(0, p.size, 12):
            old = p.flat[i]
            p.flat[i] = old + 1e-6
            up = loss()
            p.flat[i] = old - 1e-6
            down = loss()
            p.flat[i] = old
            if p is not net.table or i >= p.shape[1]:
                assert abs((up - down) / 2e-6 - g.flat[i]) < 1e-3 + 0.02 * abs(g.flat[i])


def test_chunks_cover_the_whole_document(monkeypatch):
    net = Q.Net.random(np.random.default_rng(1))
    raw = prose(1, 3000).encode()
    whole = net.features(raw)
    monkeypatch.setattr(Q, "PART", 4 * Q.HALF)
    assert np.allclose(net.features(raw), whole, atol=1e-5)
    monkeypatch.undo()
    # a byte anywhere, the last one included, can change the result
    for at in (0, len(raw) // 2, len(raw) - 1):
        assert any(not np.array_equal(net.features(raw[:at] + bytes([b]) + raw[at + 1 :]), whole) for b in range(1, 256))


def test_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.quality_scores(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [(r.score, truth[r.doc_id]) for r in out.collect() if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50
    assert np.mean([(s >= 0.3) == y for s, y in held]) > 0.93
    assert np.mean([s >= 0.3 for s, y in held if y]) > 0.97


def test_labels_of_the_held_out_fold_do_not_matter(spark, documents):
    rows = [(i, prose(i, 30) if i % 2 else "$$$ ### " * 20) for i in range(60)]
    label = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    a, b = (sorted((r.doc_id, r.score) for r in Q.quality_scores(documents(rows), label(f)).collect()) for f in (0, 1))
    assert a == b


def test_odd_rows_and_labels(spark, documents):
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 7), (4, 1), (4, 0), (5, 1)], "doc_id long, quality int")
    out = Q.quality_scores(documents(ODD, score="x", predicted="y"), odd).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    none = odd.where("doc_id > 99")
    assert {r.score for r in Q.quality_scores(documents(ODD), none).collect()} == {0.5}
    assert Q.quality_scores(documents([]), odd).collect() == []


@pytest.mark.parametrize("raw", [b"", b"a", b"a" * 127, b"a" * 128, b"a" * 129, b"\0" * 5000])
def test_any_length(raw):
    assert 0 <= Q.Net.random(np.random.default_rng(2)).score(raw) <= 1
