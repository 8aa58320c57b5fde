import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import ODD, prose

from fluxgate.llm import packing as P


def lengths_of(runs):
    return Counter(length for r in runs for length, _, _ in r.held for _ in range(r.count))


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    r = random.Random(seed)
    top = r.choice([30, 400, 1023, 1024])
    counts = Counter(r.randrange(1, top + 1) for _ in range(r.choice([1, 10, 5000])))
    runs = P.plan(dict(counts), 1024)
    assert lengths_of(runs) == counts
    # bins are numbered without gaps, and what a bin holds lies side by side
    ranges = sorted((x.first, x.first + x.count) for x in runs)
    assert ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    for x in runs:
        at = 0
        for length, _, offset in x.held:
            assert offset == at
            at += length
        assert at + x.room == 1024
        assert sum(3 * length > 1024 for length, _, _ in x.held) <= 2
    # every rank of a length has one place
    for length in counts:
        spans = sorted((a, b) for ln, a, b, _, _ in P.segments(runs) if ln == length)
        assert spans[0][0] == 0 and spans[-1][1] == counts[length] and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_near_the_lower_bound():
    r = random.Random(1)
    counts = Counter(int(min(1024, r.lognormvariate(5, 1)) + 1) for _ in range(20_000))
    counts = Counter({min(1024, k): v for k, v in counts.items()})
    bins = sum(x.count for x in P.plan(dict(counts), 1024))
    assert bins <= 1.01 * sum(k * v for k, v in counts.items()) / 1024 + 1


def test_pairs_of_large_items():
    runs = P.plan({600: 5, 400: 5, 24: 5}, 1024)
    assert [(r.count, sorted(x[0] for x in r.held), r.room) for r in runs] == [(5, [24, 400, 600], 0)]


def test_cut():
    assert P.cut(1024, 1024) == [(0, 1024)] and P.cut(1, 1024) == [(0, 1)]
    assert P.cut(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and P.cut(2048, 1024) == [(0, 1024), (1024, 1024)]


def test_encoders_agree():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.vocabulary_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    own = P.Encoder()
    enc = lambda x: np.frombuffer(own([x])[0], "<u4").tolist()
    texts = ["", " ", "  a  b\n\n c", "don't I'LL 123 4567", "é ü 社安 \U0001f600", "<|endoftext|> as text", "\x00\t\r\x0b", "a" * 5000, prose(1, 300), "x y z", "١٢٣ ⅷ ²", "a b c d", "one, two.\n\nThree 4 five  six", "it's Bob's  x", "end ", " a", "a  b", "a b", "é a b é"]
    r = random.Random(3)
    texts += ["".join(r.choice(["a", "B", " ", " ", "  ", "\n", "'s", "7", ".", "é", "\u00a0", "\x1c", "word"]) for _ in range(60)) for _ in range(300)]
    for x in texts:
        assert enc(x) == t.encode(x, add_special_tokens=False).ids


@pytest.mark.parametrize("block", [5, 20_000])
def test_round_trip(documents, monkeypatch, block):
    monkeypatch.setattr(P, "ROWS_PER_BLOCK", block)
    rows = [(d, prose(d, d * 7 % 900)) for d in range(60)] + [(100 + d, "same") for d in range(40)] + [(3, prose(3, 21))] + ODD
    out = P.pack(documents(rows, salt="a", rank="b", first="c", length="d")).collect()
    own = P.Encoder()
    enc = lambda x: np.frombuffer(own([x])[0], "<u4")
    want = Counter()
    for d, text, *_ in rows:
        ids = np.array([*enc(text or ""), 2], "<u4")
        for i, (s, n) in enumerate(P.cut(len(ids), 1024)):
            want[d, i, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= 1.05 * sum(r.length for r in out) / 1024 + 1


def test_batches_of_texts_agree_with_single_ones():
    r, own = random.Random(4), P.Encoder()
    texts = [" ".join(r.choice(["one", "two,", "Zz'll", "3rd", "É", "x\n\ny", "a", "don't", "(b)", "社安x", "w\u00a0v"]) for _ in range(40)) for _ in range(50)]
    every = own(texts)
    for t, ids in zip(texts, every, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.of.encode(t, add_special_tokens=False).ids


def test_very_long_texts(documents):
    rows = [(1, " " * 1_000_000), (2, "\n" * 1_000_000), (3, "x" * 1_000_000), (4, "a b" * 300_000)]
    out = P.pack(documents(rows)).collect()
    assert {r.doc_id for r in out} == {1, 2, 3, 4} and max(r.length for r in out) <= 1024


def test_registered_query_packs_each_document(spark, sf):
    """All ids of all documents, from the pieces' checksums, and no gap or overlap."""
    from fluxgate.llm.queries import op5_large_item_packing

    enc, want = P.Encoder(), {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        want[r.doc_id] = np.frombuffer(enc([r.text or ""])[0] + b"\x02\0\0\0", "<u4")
    pieces, seqs = {}, {}
    for r in op5_large_item_packing(spark, sf).collect():
        pieces.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == want.keys()
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(want[d])
        assert len(own) == 1 or len(want[d]) > 1024 and all(r.length == 1024 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(want[d][r.start : r.start + r.length].tobytes())
    for s in seqs.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1].tolist()] and ends[-1] <= 1024
    assert len(seqs) <= 1.02 * sum(map(len, want.values())) / 1024 + 1


def first_fit(counts, capacity):
    """Bins by plain first fit on falling lengths, one item at a time."""
    rooms = []
    for n in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        i = next((i for i, r in enumerate(rooms) if r >= n), None)
        if i is None:
            rooms.append(capacity - n)
        else:
            rooms[i] -= n
    return len(rooms)


def test_plan_against_first_fit():
    r = random.Random(5)
    for _ in range(60):
        capacity = r.choice([10, 31, 100])
        counts = Counter(r.choice([r.randrange(1, capacity + 1), r.randrange(1, capacity // 3 + 1)]) for _ in range(r.randrange(1, 200)))
        bins = sum(run.count for run in P.plan(counts, capacity))
        assert bins <= 1.05 * first_fit(counts, capacity) + 1
        assert bins >= sum(k * v for k, v in counts.items()) / capacity


def test_empty(documents):
    assert P.pack(documents([])).collect() == []
    assert [(r.length, r.offset) for r in P.pack(documents([(1, None)])).collect()] == [(1, 0)]


def test_memory_does_not_grow_with_the_words():
    """A worker keeps its encoder between tasks: what it remembers must stay small."""
    own = P.Encoder()
    tracemalloc.start()
    for k in range(95):
        own([" ".join(f"w{k * 10_000 + i}x" for i in range(10_000))])
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 80e6


def test_words_that_come_again_cost_little():
    """Less CPU time, from a cold start, than to cut the texts into words in Python alone."""
    r, seam = random.Random(8), re.compile(r"(?<=\S)(?= )|(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])")
    words = ["".join(r.choice("abcdefgéhijklmno") for _ in range(r.randrange(5, 12))) for _ in range(2000)]
    texts = [" ".join(r.choices(words, k=400)) for _ in range(2500)]

    def cost(f, *a):
        began = time.process_time()
        f(*a)
        return time.process_time() - began

    encoders = [P.Encoder() for _ in range(3)]
    assert min(cost(own, texts) for own in encoders) < min(cost(lambda: [*map(seam.split, texts)]) for _ in range(3))


@pytest.mark.parametrize("window", [1, 7, 4 << 20])
def test_windows_and_seams(monkeypatch, window):
    """Texts of odd white space, marks and letters, cut into windows of any size."""
    monkeypatch.setattr(P, "WINDOW", window)
    r, own = random.Random(9), P.Encoder()
    kinds = ["a", "B", " ", " ", "  ", "\n", "\n", "'s", "'", "7", ".", ",", "é", "×", " ", "\x1c", "\x85", " ", " ", " ", "　", "word", "\t", "\r", "社", "ж", "ʰ", "ª", "\x00", "\x7f", "—", "\U0001f600", "ế", "́", "٣"]
    for _ in range(60):
        texts = ["".join(r.choice(kinds) for _ in range(r.randrange(40))) for _ in range(r.randrange(30))]
        for t, ids in zip(texts, own(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == own.of.encode(t, add_special_tokens=False).ids
