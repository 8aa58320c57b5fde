import itertools
import random
import re

import numpy as np
import pytest
from conftest_llm import ODD, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from fluxgate.llm import pii_crf as P


def plain_base(text):
    """The base kinds by their patterns as given."""
    out = []
    tests = {"ip": lambda m: all(int(p) <= 255 for p in m.split(".")), "card": lambda m: 13 <= len(re.sub("[ -]", "", m)) <= 19 and P.luhn(re.sub("[ -]", "", m)), "phone": lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15, "email": lambda m: True}
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, p in patterns.items():
        out += [(k, *m.span()) for m in re.finditer(p, text) if tests[k](m[0])]
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@-+() 0123456789%_\nB", max_size=60))
def test_base_equals_patterns(text):
    assert P.base_spans(text) == plain_base(text)


@pytest.mark.parametrize("text", ["a@b.c@d.e.f", "x@y", "a@b..c", "@b.c a@b.c", "1.2.3.4.5.6.7.8", "256.1.1.1 1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111-0", "+1 (974) 555-3436.", "+49 30 1234567", "é1.2.3.4ü", "000000000001.1.1.1", "٣.1.1.1.1"])
def test_base_cases(text):
    assert P.base_spans(text) == plain_base(text)


def test_long_runs_are_quick():
    import time

    began = time.time()
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "+1" + "(" * 400_000, "1." * 200_000):
        P.base_spans(text)
    assert time.time() - began < 10


def small_field(seed):
    f, rng = P.Field(), np.random.default_rng(seed)
    f.emit[:], f.move[:] = rng.standard_normal(f.emit.shape), rng.standard_normal(f.move.shape)
    return f


def test_viterbi_equals_enumeration():
    r = random.Random(1)
    f = small_field(1)
    chains = [[[r.randrange(P.SLOTS) for _ in range(12)] for _ in range(n)] for n in (1, 2, 3, 4, 5, 1, 3)]
    for chain, got in zip(chains, f.decode(chains), strict=True):
        def score(labels):
            path = [0, *labels, 0]
            return sum(f.emit[chain[t]].sum(axis=0)[x] for t, x in enumerate(labels)) + sum(f.move[a, b] for a, b in itertools.pairwise(path))  # noqa: B023

        assert tuple(got) == max(itertools.product(range(len(P.LABELS)), repeat=len(chain)), key=score)


def test_training_separates_its_table():
    table = P.labelled_table()
    f, wrong, n = P.trained(table), 0, 0
    held = P.labelled_table(200, seed=99)
    for tokens, labels in held:
        for a, b in P.chains_of(tokens):
            got = f.decode([P.slots(tokens[a:b], tokens[a - 1] if a else "", tokens[b] if b < len(tokens) else "")])[0]
            wrong += sum(P.LABELS[x] != y for x, y in zip(got, labels[a:b], strict=True))
            n += b - a
    assert wrong / n < 0.03


def test_closed_tokens_split_the_chain():
    # decoding a text in pieces equals decoding its chains one by one
    f = P.trained(P.labelled_table())
    text = "call (974) 555-3436 or mail a.b12@mail.example.com. Not 12 or 2024-01-01!\n\n" + prose(4, 200)
    every = P.added_spans(f, [text, "", text * 3])
    assert every[0] == P.added_spans(f, [text])[0] and every[1] == []
    assert [(k, a, b) for k, a, b in every[2] if b <= len(text)] == every[0]


def test_adds_and_keeps(documents):
    rows = [(1, "mail jo.doe12@mail.example.com now"), (2, "call (974) 555-3436 or 555-123-4567."), (3, prose(1, 400)), (4, "Total 1234 of 5678 on 2024-05-06 at 10:20")]
    out = {r.doc_id: r for r in P.find_pii(documents(rows, base="x", spans="y")).collect()}
    text = dict(rows)
    spans = {d: [(s.kind, text[d][s.start : s.end]) for s in r.spans] for d, r in out.items()}
    assert spans[1] == [("email", "jo.doe12@mail.example.com")] and ("phone", "555-123-4567") in spans[2] and not out[2].base
    assert spans[3] == [] and spans[4] == []


def test_odd_rows(documents):
    out = P.find_pii(documents(ODD)).collect()
    assert len(out) == len(ODD) and all([tuple(s) for s in r.base] == P.base_spans(r.text or "") for r in out)
    assert P.find_pii(documents([])).collect() == []


def test_untrained_field_adds_nothing(documents):
    out = P.find_pii(documents([(1, "call 555-123-4567 a@b.cd")]), table=[]).first()
    assert out.spans == out.base


def test_digest():
    assert P.span_text([("email", 1, 5), ("ip", 7, 9)]) == "email:1:5,ip:7:9"
    assert P.base_digest([]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_long_runs_are_decoded_whole(monkeypatch):
    f = P.trained(P.labelled_table())
    for n in range(60, 68):
        numbers = ["a@b.com"] * n
        tokens = [*numbers, "(555)", "123-4567", *numbers]
        text = " ".join(tokens)
        labels = f.decode([P.slots(tokens, "", "")])[0]
        at = len(" ".join(numbers)) + 1
        assert labels[n : n + 2] == [P.LABELS.index("phone")] * 2
        assert ("phone", at, at + 14) in P.added_spans(f, [text])[0]
    whole = P.added_spans(f, [text, text * 3])
    monkeypatch.setattr(P, "PART", 7)
    monkeypatch.setattr(P, "CELLS", 100)
    assert P.added_spans(f, [text, text * 3]) == whole


def test_features_see_whole_tokens():
    assert P.shape("ab-" * 40 + "7") != P.shape("ab-" * 40 + "x")
    assert "n=1" in P.own_features("x" * 300 + "7y")
