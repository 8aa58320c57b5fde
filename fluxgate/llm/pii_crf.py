"""Personal data by patterns and a linear-chain conditional random field.

The patterns find the four base kinds.  The field labels tokens by features of
their word shapes; it is trained by maximum likelihood on a small labelled table
and decoded by Viterbi, a numpy batch of token chains at a time.  Its spans are
added where no base span lies."""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches

#: Kinds in the order of the results, with their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
# a run of digits either begins a match or holds none, so only its start is tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
#: Tokens that can be labelled; all others are outside by the model's constraint.
_OPEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
#: What does not belong to a span at a token's ends.
_TRIM_LEFT, _TRIM_RIGHT = "\"'`<[{,;:!?*#$%&|~_=/\\", "\"'`>]},;:!?*#$%&|~_=/\\."
LABELS = ("O", *KINDS)
#: Results that a remembered function keeps, and characters of an argument it keeps
#: (a longer one is worked out each time).
MEMORY, SHORT = 50_000, 200
#: Feature slots; features are hashed into them.
SLOTS = 1 << 12


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from their @ so that a long run
    without one costs nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at):
            i = at
            while i > done and (text[i - 1].isascii() and text[i - 1].isalnum() or text[i - 1] in "._%+-"):
                i -= 1
            if i < at:
                out.append((i, domain.end()))
                done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The four base kinds, each leftmost non-overlapping, in the order of KINDS."""
    if not _MARK.search(text):
        return []
    out = [("email", *s) for s in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return out


class remembered:
    """A function of one argument with its last results, as many as memory allows."""

    def __init__(self, f):
        self.f, self.got = f, {}

    def __call__(self, x):
        try:
            return self.got[x]
        except KeyError:
            if len(x) > SHORT:
                return self.f(x)
            if len(self.got) >= MEMORY:
                self.got.clear()
            self.got[x] = y = self.f(x)
            return y


def shape(token: str) -> str:
    """Digits as 9 with their run's length up to 6, letters as a or A, runs once."""
    token = re.sub(r"[0-9]+", lambda m: f"9{min(len(m[0]), 6)}", token)
    return re.sub(r"[^\W\d_A-Z]+", "a", re.sub(r"[A-Z]+", "A", token))


@remembered
def own_features(token: str) -> tuple[str, ...]:
    core = token.strip(_TRIM_LEFT + _TRIM_RIGHT)
    digits = re.sub(r"\D", "", core)
    parts = core.split(".")
    ip = len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) <= 3 and int(p) <= 255 for p in parts)
    card = 13 <= len(digits) <= 19 and not re.search("[^0-9 -]", core) and luhn(digits)
    groups = shape(core)
    return (f"s={groups}", f"n={min(len(digits), 20)}", f"at={core.count('@')}", f"ip={ip}", f"card={card}", f"letters={bool(re.search('[A-Za-z]', core))}", f"plus={core[:1] == '+'}", f"paren={core[:1] + core[-1:] == '()'}")


@remembered
def near_features(token: str) -> str:
    core = token.strip(_TRIM_LEFT + _TRIM_RIGHT)
    return shape(core) if _MARK.search(core) else "word"


@remembered
def slot(feature: str) -> int:
    return int.from_bytes(hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % SLOTS


def slots(chain: list[str], before: str, after: str) -> list[list[int]]:
    """Feature slots of each token of a chain between two other tokens."""
    around = [before, *chain, after]
    out = []
    for i, token in enumerate(chain, 1):
        own = own_features(token)
        left, right = near_features(around[i - 1]), near_features(around[i + 1])
        out.append([slot(f) for f in (*own, f"l={left}", f"r={right}", f"ls={left}|{own[0]}", f"rs={right}|{own[0]}")])
    return out


class Field:
    """Weights of a linear-chain field: emissions per feature slot, and transitions.
    Outside a chain there are closed tokens, which all are O."""

    def __init__(self):
        self.emit = np.zeros((SLOTS, len(LABELS)))
        self.move = np.zeros((len(LABELS), len(LABELS)))

    def padded(self, chains: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
        """(emission scores, lengths); beyond a chain's end only O is free."""
        n = np.array([len(c) for c in chains])
        out = np.full((len(chains), n.max(), len(LABELS)), -1e9)
        out[:, :, 0] = 0
        at = np.array([(b, t) for b, c in enumerate(chains) for t in range(len(c))])
        out[at[:, 0], at[:, 1]] = self.emit[np.array([x for c in chains for x in c])].sum(axis=1)
        return out, n

    def decode(self, chains: list[list[list[int]]]) -> list[list[int]]:
        """Viterbi over all chains at once: the best labels of each."""
        n = np.array([len(c) for c in chains])
        b, t, k = len(chains), int(n.max()), len(LABELS)
        back = np.zeros((t + 1, b, k), np.int8)
        for i in range(t + 1):
            if i < t and i % PART == 0:
                scores, _ = self.padded([c[i : i + PART] for c in chains])
            own = scores[:, i % PART] if i < t else np.r_[0.0, [-1e9] * (k - 1)]
            if i == 0:
                best = own + self.move[0]
                continue
            step = best[:, :, None] + self.move[None]
            # a finished chain keeps its best final label through O
            back[i] = step.argmax(axis=1)
            best = step.max(axis=1) + own
        labels = np.zeros((b, t), np.int8)
        last = np.zeros(b, np.int64)
        for i in range(t, 0, -1):
            last = back[i][np.arange(b), last]
            labels[:, i - 1] = last
        return [labels[j, : n[j]].tolist() for j in range(b)]

    def fit(self, chains: list[list[list[int]]], labels: list[list[int]], steps: int = 120, rate: float = 0.2, decay: float = 1e-3) -> Field:
        """Ascend the penalised log likelihood with Adam; gradients by forward and
        backward sums over all chains at once."""
        n = np.array([len(c) for c in chains])
        b, t, k = len(chains), n.max(), len(LABELS)
        real = np.arange(t)[None] < n[:, None]
        gold = np.zeros((b, t), np.int64)
        gold[real] = [x for row in labels for x in row]
        flat = np.array([x for c in chains for x in c])
        prev = np.concatenate([np.zeros((b, 1), np.int64), gold], axis=1)
        seen = np.zeros((k, k))
        np.add.at(seen, (prev.ravel(), np.concatenate([gold, np.zeros((b, 1), np.int64)], axis=1).ravel()), 1)
        params, m, v = [self.emit, self.move], [0, 0], [0, 0]

        def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis=axis, keepdims=True)
            return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

        for s in range(1, steps + 1):
            e, _ = self.padded(chains)
            closed = np.concatenate([e, np.broadcast_to(np.r_[0.0, [-1e9] * (k - 1)], (b, 1, k))], axis=1)
            fore = [closed[:, 0] + self.move[0]]
            for i in range(1, t + 1):
                fore.append(closed[:, i] + log_sum(fore[-1][:, :, None] + self.move[None], 1))
            after = [np.zeros((b, k))]
            for i in range(t, 0, -1):
                after.append(log_sum(self.move[None] + (closed[:, i] + after[-1])[:, None, :], 2))
            after.reverse()
            z = log_sum(fore[-1], 1)
            p = np.exp(np.stack(fore, 1) + np.stack(after, 1) - z[:, None, None])
            expected = np.zeros((k, k))
            expected[0] += p[:, 0].sum(axis=0)
            for i in range(1, t + 1):
                pair = fore[i - 1][:, :, None] + self.move[None] + (closed[:, i] + after[i])[:, None, :] - z[:, None, None]
                expected += np.exp(pair).sum(axis=0)
            diff = -p[:, :t]
            np.put_along_axis(diff, gold[:, :, None], np.take_along_axis(diff, gold[:, :, None], 2) + 1, 2)
            d_emit = np.zeros_like(self.emit)
            np.add.at(d_emit, flat, diff[real][:, None, :])
            for q, g in enumerate((d_emit / b - decay * self.emit, (seen - expected) / b - decay * self.move)):
                m[q] = 0.9 * m[q] + 0.1 * g
                v[q] = 0.99 * v[q] + 0.01 * g * g
                params[q] += rate * (m[q] / (1 - 0.9**s)) / (np.sqrt(v[q] / (1 - 0.99**s)) + 1e-8)
        return self


def labelled_table(rows: int = 400, seed: int = 11) -> list[tuple[list[str], list[str]]]:
    """The small training table: (tokens, labels) rows, made by a rule.  Words
    surround personal data in usual notations, and numbers that are none."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[rng.integers(len(x))]
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("aeioulnrstdhm"), rng.integers(2, 9)))

    def card(ok: bool) -> str:
        head = d(15)
        last = next(c for c in "0123456789" if luhn(head + c))
        return head + (last if ok else str((int(last) + rng.integers(1, 10)) % 10))

    def email() -> list[str]:
        return [f"{word()}{pick('', '.', '_')}{pick(word(), d(2))}@{word()}{pick('', d(1))}.{pick('com', 'org', 'net', 'example.com')}"]

    def phone() -> list[str]:
        a, b, c = d(3), d(3), d(4)
        return pick([f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"+{pick('1', '33', '49')}", f"({a})", f"{b}-{c}"], [f"{a}.{b}.{c}"], [f"+{d(2)}", a, b, c])

    def number() -> list[str]:
        c = card(False)
        return pick([card(False)], [f'"{rng.bytes(20).hex()}"'], [d(int(rng.integers(1, 8)))], [f"{d(2)}:{d(2)}"], [f"20{d(2)}-{d(2)}-{d(2)}"], [f"{d(1)}.{d(1)}.{d(1)}"], [f"${d(2)}.{d(2)}"], [f"{word()}{d(2)}"], [f"@{word()}"], [f"https://{word()}.com/{d(4)}"], [f"{d(1)}.{d(2)}"], [f"{300 + int(rng.integers(0, 600))}.{d(3)}.{d(2)}.{d(2)}"], [d(20)], [c[:4], c[4:8], c[8:12], c[12:]], [f"{d(2)}/{d(2)}/{d(4)}"], [f"{d(3)},{d(3)}"], [d(10)], [f"{d(3)}-{d(4)}"], [d(4)])

    ip = lambda: [".".join(str(rng.integers(0, 256)) for _ in range(4))]
    makers = {"email": email, "ip": ip, "card": lambda: [card(True)], "phone": phone, "O": number}
    out = []
    for _ in range(rows):
        tokens, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            kind = pick("email", "ip", "card", "phone", "O", "O", "O")
            own = makers[kind]()
            own[-1] += pick("", "", "", ".", ",", "!!", "###", "$$$")
            words = [word() + pick("", "", ".") for _ in range(int(rng.integers(1, 4)))]
            tokens += [*words, *own]
            labels += ["O"] * len(words) + [kind] * len(own)
        out.append((tokens, labels))
    return out


def chains_of(tokens: list[str]) -> list[tuple[int, int]]:
    """[start, end) of each maximal run of open tokens.  A closed token is O in any
    case, so the field falls apart there and runs can be decoded on their own."""
    out, start = [], None
    for i, t in enumerate([*tokens, ""]):
        if _MARK.search(t):
            start = i if start is None else start
        elif start is not None:
            out.append((start, i))
            start = None
    return out


def trained(table: list[tuple[list[str], list[str]]]) -> Field:
    chains, labels = [], []
    for tokens, own in table:
        for a, b in chains_of(tokens):
            chains.append(slots(tokens[a:b], tokens[a - 1] if a else "", tokens[b] if b < len(tokens) else ""))
            labels.append([LABELS.index(x) for x in own[a:b]])
    return Field().fit(chains, labels) if chains else Field()


#: Tokens of a chain whose scores are held at a time (the best scores and the back
#: pointers go on from part to part), and chains and padded tokens of a batch; one
#: chain may be longer.
PART, CHAINS, CELLS = 1024, 2048, 1 << 17


def open_chains(text: str) -> Iterator[tuple[list[tuple[int, int]], list[list[int]]]]:
    """(token spans, feature slots) of each chain in a text."""
    group: list[tuple[int, int]] = []

    def close() -> tuple[list[tuple[int, int]], list[list[int]]]:
        # the tokens around a chain are closed, which all look alike to it
        return list(group), slots([text[x:y] for x, y in group], "", "")

    for m in _OPEN.finditer(text):
        if group and text[group[-1][1] : m.start()].strip(" \t\n\x0b\x0c\r"):
            yield close()
            group = []
        group.append(m.span())
    if group:
        yield close()


def added_spans(field: Field, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """The field's spans of each text: runs of tokens of one label, without the
    punctuation at their ends."""
    found = [(i, spans, chain) for i, t in enumerate(texts) if _MARK.search(t) for spans, chain in open_chains(t)]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    # chains of like length share a batch, so that padding stays small
    order = sorted(range(len(found)), key=lambda j: len(found[j][2]))
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and end - at < CHAINS and (end - at + 1) * len(found[order[end]][2]) <= CELLS:
            end += 1
        own, at = order[at:end], end
        for j, labels in zip(own, field.decode([found[j][2] for j in own]), strict=True):
            i, spans, _ = found[j]
            t, k = texts[i], 0
            while k < len(labels):
                end = k + 1
                while end < len(labels) and labels[end] == labels[k]:
                    end += 1
                if labels[k]:
                    a, b = spans[k][0], spans[end - 1][1]
                    while a < b and t[a] in _TRIM_LEFT:
                        a += 1
                    while a < b and t[b - 1] in _TRIM_RIGHT:
                        b -= 1
                    if a < b:
                        out[i].append((LABELS[labels[k]], a, b))
                k = end
    return out


def merged_spans(base: list[tuple[str, int, int]], more: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """All base spans, and those of the field that overlap none of them."""
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    # of the base spans that begin before a span's end, the farthest end tells
    free = [x for x in more if (k := bisect.bisect_left(starts, x[2])) == 0 or ends[k - 1] <= x[1]]
    return sorted({*base, *free}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _find(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            base = [base_spans(t) for t in texts]
            every = [merged_spans(b, m) for b, m in zip(base, added_spans(field, texts), strict=True)]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            for name, rows in (("base", base), ("spans", every)):
                batch = batch.append_column(name, pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in r] for r in rows], kind))
            yield batch

    return run


def find_pii(docs: DataFrame, table: list[tuple[list[str], list[str]]] | None = None) -> DataFrame:
    """``docs`` with base and spans added: arrays of (kind, start, end) in code
    points, end exclusive, by kind as in KINDS, then start.

    base: the four patterns, each leftmost and non-overlapping for itself; a match
    that fails its test (parts of an ip over 255, digits and Luhn sum of a card,
    digits of a phone) is dropped without another try.  spans: these, and the spans
    of a conditional random field that overlap none of them.  ``table``: labelled
    rows (tokens, labels) to train the field on, else ``labelled_table()``.

    Texts are read whole, row by row, without a shuffle.  A null or empty text has
    no spans.  Repeated rows come out repeated; an empty table gives an empty
    result; columns of ``docs`` named base or spans are replaced."""
    bounded_batches(docs.sparkSession)
    field = trained(labelled_table() if table is None else table)
    rest = docs.drop("base", "spans").withColumn("text", F.col("text").cast("string"))
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return rest.mapInArrow(_find(field), T.StructType([*rest.schema, T.StructField("base", kind), T.StructField("spans", kind)]))


def base_digest(base: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(span_text(base).encode()).hexdigest()
