"""Best-fit packing of tokenized documents by large-item matching."""

from __future__ import annotations

import bisect
import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_batches, fewer_tasks

#: Rows of one length that one window task ranks, on average.
ROWS_PER_BLOCK = 200
#: Texts are cut and looked up in windows of so many bytes (more where they have no seam).
WINDOW = 4 << 20
#: Parts of a generation that a worker remembers (it has two), and bytes of such a part.
PARTS, PART_BYTES = 1 << 17, 40
#: Words of one kind of letter, maybe behind a space: one unit of the vocabulary's rules.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xca\xd0\xd1][\x80-\xbf]|[\xe5-\xe8][\x80-\xbf]{2})+")
#: What a byte may be: of a space's, mark's or (surely) other visible character's begin ...
_WHITE, _MARK = 1, 2
_AT = np.array([_WHITE if b in b" \t\n\x0b\x0c\r" else _MARK if re.match(rb"[!-/:-@\[-`{-~]", bytes([b])) else 0 for b in range(256)], np.uint8)
_SEEN = np.array([0x21 <= b <= 0x7E or 0xC3 <= b <= 0xDF for b in range(256)])
#: ... and what seams may follow it: before white space behind what may be visible, before marks behind ASCII letters.
_BEHIND = np.array([(0x21 <= b <= 0x7E or b >= 0x80) * _WHITE + chr(b).isalpha() * (b < 0x80) * _MARK for b in range(256)], np.uint8)


def vocabulary_path(name: str) -> str:
    """Where an installed public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def seams(data: np.ndarray, start: int, stop: int) -> np.ndarray:
    """For each place from start to stop whether UTF-8 bytes may be cut there without
    changing the ids: between what is surely no white space and ASCII white space,
    between an ASCII letter and an ASCII mark, and behind a lone line feed."""
    out = np.zeros(stop - start, bool)
    np.bitwise_and(_AT[data[start + 1 : stop]], _BEHIND[data[start : stop - 1]], out=out[1:].view(np.uint8))
    at = np.flatnonzero(out.view(np.uint8)) + start
    # white space outside ASCII is U+0085, U+00A0, U+1680, U+2000 to U+205F and U+3000
    far = np.flatnonzero(data[at - 1] >= 0x80)
    one, two = data[np.maximum(at[far] - 2, 0)], data[np.maximum(at[far] - 3, 0)]
    maybe = (one == 0xC2) | (two == 0xE1) & (one == 0x9A) | (two == 0xE2) & ((one == 0x80) | (one == 0x81)) | (two == 0xE3) & (one == 0x80)
    out[at - start] = True
    out[at[far[maybe]] - start] = False
    lone = np.flatnonzero(out & (data[start:stop] == 10)) + 1
    lone = lone[lone < len(out)]
    out[lone[_SEEN[data[lone + start]]]] = True
    return out


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)}.difference(own)))}


class Encoder:
    """Texts to ids of the named vocabulary, by ``tokenizers``.

    The vocabulary's rules take a space only at the head of a word or within a run of
    white space, and marks never with letters before them: nothing they join crosses a
    seam (see ``seams``), and none looks back across it.  So a text may be cut there,
    and the parts' ids are the text's ids.  Each window's different parts are looked up
    once, and those that come often are remembered: two generations of PARTS parts, and
    what one window adds, of at most PART_BYTES each; the older goes when the younger is full.
    Names of special tokens in a text are ordinary text."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(vocabulary_path(name))
        self.of.encode_special_tokens = True
        self.letters = byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _new(self, parts: list[bytes]) -> list[bytes]:
        """Ids of parts.  Plain words are one unit of the rules, so they go to the
        vocabulary's model at once; the rules cut all others first."""
        # a line feed's letter is none of a word's
        plain = [p if _WORD.fullmatch(p) else b"" for p in parts]
        words = b"\n".join(plain).decode("latin-1").translate(self.letters).split(self.letters[10])
        tokenize, encode, id_of = self.of.model.tokenize, self.of.encode, attrgetter("id")
        ids, ends = [], [0]
        for p, w in zip(parts, words, strict=False):
            ids.extend(map(id_of, tokenize(w)) if w else encode(p.decode(), add_special_tokens=False).ids)
            ends.append(4 * len(ids))
        raw = np.array(ids, "<u4").tobytes()
        return [raw[a:b] for a, b in pairwise(ends)]

    def _look_up(self, parts: list[bytes]) -> list[bytes]:
        """Ids of different parts."""
        young, old = self.young, self.old
        out, new = [*map(young.get, parts)], []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            ids = out[i] = old.get(parts[i])
            if ids is None:
                new.append(i)
            else:
                young[parts[i]] = ids
        for i, ids in zip(new, self._new([parts[i] for i in new]), strict=True):
            out[i] = ids
            if len(parts[i]) <= PART_BYTES:
                young[parts[i]] = ids
        if len(young) > PARTS:
            self.young, self.old = {}, young
        return out

    def flat(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that lie one behind the other in UTF-8 bytes, text i from
        ``bounds[i]`` to ``bounds[i + 1]``; and where each text's ids begin, and their end."""
        data = data[: bounds[-1]]
        ids, starts, done = [np.empty(0, "<u4")], np.zeros(len(bounds), np.int64), 0
        at, n, step = int(bounds[0]), int(bounds[-1]), WINDOW
        while at < n:
            stop = min(at + step, n)
            seam = seams(data, at, stop)
            seam[bounds[np.searchsorted(bounds, at, "right") : np.searchsorted(bounds, stop, "left")] - at] = True
            cuts = np.flatnonzero(seam) + at
            if stop < n and not len(cuts):
                step *= 2
                continue
            cuts = np.concatenate(([at], cuts, [n] if stop == n else [])).astype(np.int64)
            end = int(cuts[-1])
            offsets = pa.py_buffer((cuts - at).astype(np.int32))
            parts = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, offsets, pa.py_buffer(data[at:end])]).dictionary_encode()
            found = self._look_up(parts.dictionary.to_pylist())
            size = np.fromiter(map(len, found), np.int64, len(found)) // 4
            which = parts.indices.to_numpy()
            sizes = size[which]
            ends = np.cumsum(sizes)
            from_ = np.repeat((np.cumsum(size) - size)[which] - ends + sizes, sizes)
            from_ += np.arange(len(from_))
            ids.append(np.frombuffer(b"".join(found), "<u4")[from_])
            within = slice(np.searchsorted(bounds, at, "right"), np.searchsorted(bounds, end, "right"))
            starts[within] = done + ends[np.searchsorted(cuts, bounds[within]) - 1]
            done, at, step = done + int(ends[-1]), end, WINDOW
        return np.concatenate(ids), starts

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``flat`` of an Arrow column of texts (null: empty)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
        raw = texts.buffers()[2]
        return self.flat(np.frombuffer(raw, np.uint8) if raw else np.empty(0, np.uint8), bounds)

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        ids, starts = self.column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in pairwise(starts)]


@functools.cache
def shared_encoder(name: str) -> Encoder:
    """One for all tasks of a worker process: what it remembers helps the next task."""
    return Encoder(name)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: one if it fits, else full pieces
    behind a first piece that takes what is left over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(name: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = shared_encoder(name), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            every, starts = encode.column(batch.column("text"))
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = np.frombuffer(every[starts[k] : starts[k + 1]].tobytes() + end, "<u4")
                for i, (start, length) in enumerate(cut(len(ids), capacity)):
                    for c, v in zip(out, (doc, i, start, length, zlib.crc32(ids[start : start + length].tobytes())), strict=True):
                        out[c].append(v)
            kinds = {"piece": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int64())) for c, v in out.items()], names=list(out))

    return run


@dataclass
class Run:
    """``count`` equal bins from number ``first`` on: what each holds, as (length,
    rank of the first bin's item among its length, offset), and its free room."""

    first: int
    count: int
    held: list[tuple[int, int, int]]
    room: int

    def split(self, n: int) -> tuple[Run, Run]:
        """The first n bins, and the rest."""
        rest = [(length, rank + n, offset) for length, rank, offset in self.held]
        return Run(self.first, n, self.held, self.room), Run(self.first + n, self.count - n, rest, self.room)


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Pack ``counts`` items of each length into bins, as runs of equal bins.

    Lengths above a third of the capacity pair at most twice per bin: from the
    longest down, each is matched with the longest that still fits beside it.  The
    others go, longest first, to the bin whose room fits them best, else into new
    bins.  All items of one length move together, so the work depends on the number
    of lengths (at most the capacity), not on the number of documents."""
    left = Counter({k: v for k, v in counts.items() if v})
    used: Counter = Counter()
    bins = 0
    by_room: dict[int, list[Run]] = {}
    rooms: list[int] = []

    def put(run: Run) -> None:
        if run.count:
            if run.room not in by_room:
                bisect.insort(rooms, run.room)
                by_room[run.room] = []
            by_room[run.room].append(run)

    def take(length: int, n: int) -> int:
        rank = used[length]
        used[length] += n
        left[length] -= n
        return rank

    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b == a and left[a] == 1:
            b = large[at - 1] if at > 0 else None
        if b is None:
            n = left[a]
            put(Run(bins, n, [(a, take(a, n), 0)], capacity - a))
        else:
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(Run(bins, n, [(a, take(a, n), 0), (b, take(b, n), a)], capacity - a - b))
        bins += n
        large = [k for k in large if left[k]] if not left[a] or b is not None and not left[b] else large
    for s in sorted((k for k in left if left[k]), reverse=True):
        while left[s]:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                per = capacity // s
                n = -(-left[s] // per)
                put(Run(bins, n, [(s, take(s, n), 0)], capacity - s))
                bins += n
                continue
            room = rooms[at]
            run = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            n = min(left[s], run.count)
            run, rest = run.split(n)
            put(rest)
            put(Run(run.first, n, [*run.held, (s, take(s, n), capacity - room)], room - s))
    return [r for own in by_room.values() for r in own]


def segments(runs: list[Run]) -> list[tuple[int, int, int, int, int]]:
    """(length, rank_from, rank_to, sequence of rank_from, offset), by length and rank."""
    return sorted((length, rank, rank + r.count, r.first, offset) for r in runs for length, rank, offset in r.held)


def pack(docs: DataFrame, capacity: int = 1024, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece.

    A document is the ids of its text (null: empty) and ``end_id``; only a longer
    one than ``capacity`` is cut (see ``cut``).  Which lengths share a sequence is
    planned from the counts of the lengths, of which there are at most ``capacity``;
    a piece then finds its place by its rank among the pieces of its length.  Ranks
    come from block counts, so pieces of one length never meet in one task.

    Repeated rows are packed each.  Null doc_ids are packed like others.  An empty
    table gives an empty result; further columns are ignored.  The plan is held by
    the driver: at most a few segments per length, whatever the number of rows."""
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "pack")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long"
    salt = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    pieces = scratch.keep(fewer_tasks(src).mapInArrow(_pieces(vocabulary, capacity, end_id), kind).withColumn("salt", salt), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = segments(plan(counts, capacity))
    where = spark.createDataFrame(placed, "length long, rank_from long, rank_to long, first long, offset long")
    blocks = max(1, max(counts.values(), default=0) // ROWS_PER_BLOCK + 1)
    ranked = pieces.withColumn("block", F.pmod("salt", F.lit(blocks)))
    sizes = ranked.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("length", "block", (F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).alias("base"))
    ranked = ranked.withColumn("r", F.row_number().over(Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(starts, ["length", "block"]).withColumn("rank", F.col("r") + F.col("base"))
    # the segments' number is bounded by the capacity, not by the rows
    out = ranked.join(F.broadcast(where), (ranked["length"] == where["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return out.select("doc_id", "piece", "start", ranked["length"], "ids_crc32", (F.col("first") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
