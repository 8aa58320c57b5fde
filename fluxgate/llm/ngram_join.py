"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word n-grams.  A parity sketch gives each
n-gram one bit and flips it, so the Hamming distance of two sketches never exceeds
the symmetric difference of the sets.  At similarity t, the difference of a linked
pair is at most d = floor(min size * (1 - t) / t).  Cut a sketch, wide enough that
no two n-grams meet, into more than d parts: at least one part of a linked pair is
equal (pigeonhole).  A part is kept as the XOR of its n-grams' 64-bit hashes.  Size
bands fix the parts for both sides of a pair.  In any order of the parts that both
sides share, the first d + 1 that hold anything are enough, since at most d of them
can differ; parts that very many documents hold come last, and parts of many
n-grams, which chance seldom repeats, come first.  Candidates that share a part and
pass the size bound and the Hamming bound of their sketches, which have four bits
or more for each n-gram, are verified on the exact n-grams."""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Scratch, bounded_batches, fewer_tasks, filter_table, maybe_in
from .graph import components

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Upper end of each size band over its lower end; any ratio over 1 is right.
BAND_RATIO = 1.25
#: Parts of a sketch over the least number, d + 1; any ratio of 1 or more is right.
SPARE = 1.5
#: 64-bit words of the sketches that candidates are held against inside the join;
#: longer sets are held against all words of theirs when they have passed it.
INSIDE = 32
_ZERO, _TRUE = np.zeros(1, np.int64), np.ones(1, bool)
#: Set keys that a task remembers so as not to send a copy's parts again.
SEEN = 200_000
#: Parts whose holders a task counts at a time, holders that make a part hot, hot
#: parts at most, and what the holders of one are divided into.  They decide the
#: order of parts and how work is dealt out, not what is found.
COUNTED, HOT, MOST_HOT, SALTS = 200_000, 2_048, 4_096, 64
#: Holders of one signature that meet in one cell of the join's grid, on average.
CELL = 1_000


def band_edges(largest: int) -> list[int]:
    """Lower ends of the size bands, from 1 to beyond ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(max(edges[-1] + 1, int(edges[-1] * BAND_RATIO)))
    return edges


@functools.cache
def known_edges(largest: int) -> list[int]:
    return band_edges(largest)


def words_of(text: str | None) -> list[bytes]:
    # bytes.split() without argument splits at exactly \x20 and \x09-\x0D
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(text: str | None, n: int) -> frozenset[bytes]:
    w = words_of(text)
    if not w:
        return frozenset()
    return frozenset(b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def _mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all bits can be used."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shingle_hashes(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-grams; one hash if there are fewer words."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    out = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        old = out >> np.uint64(29)
        out ^= h[i : i + len(out)]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += old
    out = np.sort(_mix(out))
    return out[np.concatenate([_TRUE, out[1:] != out[:-1]])]


def set_key(h: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return xxhash.xxh3_128_digest(h.tobytes())


def short_key(key: bytes) -> int:
    """Half a set's key, for rows that are many; it is joined back to the whole."""
    return int.from_bytes(key[:8], "big", signed=True)


def parity_words(h: np.ndarray, words: int) -> np.ndarray:
    """The sketch: ``words`` (a power of two) of 64 bits, each hash flipping one bit.
    A sketch of half as many words is the XOR of the two halves."""
    word = (h >> np.uint64(6)) & np.uint64(words - 1)
    order = np.argsort(word, kind="stable")
    bit = np.uint64(1) << (h[order] & np.uint64(63))
    word = word[order]
    start = np.flatnonzero(np.concatenate([_TRUE, word[1:] != word[:-1]]))
    out = np.zeros(words, np.uint64)
    out[word[start].astype(np.int64)] = np.bitwise_xor.reduceat(bit, start)
    return out


def sketch_words(n: int) -> int:
    """Words of the sketch of a set of n: four bits or more for each n-gram."""
    return max(4, 1 << (-(-4 * n // 64) - 1).bit_length())


def allowed(n: int, percent: int) -> int:
    """Largest symmetric difference of a linked pair whose smaller set has n."""
    return n * (100 - percent) // percent


def signatures(h: np.ndarray, percent: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, those kept) of a set's sketch parts, for its size band and each
    band below where a linked partner may lie.  Two linked sets that differ keep a
    common signature.

    Equal parts have equal signatures, equally many n-grams and an equal place in
    the order: hot ones last, else by falling number of n-grams, then by hash.  Let
    a set fill more than d parts.  At most d of either set's parts differ, so a part
    that it fills is equal in the partner, and before the first such part either has
    at most d others: it is among the first d + 1 of both.  Two sets that fill d
    parts or fewer have nothing to count on; such sets therefore keep their first
    d + 1 n-grams as well, of which the same holds, as they have more than d."""
    n = len(h)
    edges = known_edges(1 << n.bit_length())
    k = bisect.bisect_right(edges, n) - 1
    every, kept = [], []
    for level in range(k, -1, -1):
        # the smaller set of a pair of this level is below the next edge
        if level < k and n * percent > 100 * (edges[level + 1] - 1):
            break
        d = allowed(edges[level + 1] - 1, percent)
        if d == 0:  # only equal sets can link
            continue
        # parts are cut by the hashes' upper half, so sorted hashes lie part by part
        part = ((h >> np.uint64(32)) * np.uint64(int(SPARE * (d + 1)) + 1)) >> np.uint64(32)
        start = np.flatnonzero(part[1:] != part[:-1])
        start += 1
        start = np.concatenate([_ZERO, start])
        held = np.diff(start, append=n)
        sig = _mix(np.bitwise_xor.reduceat(h, start) + np.uint64(level * 2 + 1))
        every.append(sig)
        if len(sig) > d + 1:
            rank = (sig >> np.uint64(8)) | (np.uint64(127) - np.minimum(held, 127).astype(np.uint64)) << np.uint64(56)
            if hot is not None and len(hot):
                rank |= np.isin(sig, hot).astype(np.uint64) << np.uint64(63)
            sig = sig[rank <= np.partition(rank, d)[d]]
        kept.append(sig)
        if len(start) <= d:
            kept.append(_mix(h[: d + 1] + np.uint64(level * 2)))
    none = np.zeros(0, np.uint64)
    return np.concatenate(every or [none]), np.concatenate(kept or [none])


class Holders:
    """Lower bounds of how many sets hold a signature, in bounded memory: the counts
    of all but the COUNTED most frequent are lowered together until they vanish."""

    def __init__(self):
        self.sig, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[np.ndarray] = []
        self.waiting = 0

    def add(self, sig: np.ndarray) -> None:
        self.new.append(sig)
        self.waiting += len(sig)
        if self.waiting > COUNTED:
            self.merge()

    def merge(self) -> None:
        sig, at, n = np.unique(np.concatenate([self.sig, *self.new]), return_inverse=True, return_counts=True)
        n = n.astype(np.int64)
        n[at[: len(self.n)]] += self.n - 1
        if len(sig) > COUNTED:
            n -= np.partition(n, len(n) - COUNTED - 1)[len(n) - COUNTED - 1]
            sig, n = sig[n > 0], n[n > 0]
        self.sig, self.n, self.new, self.waiting = sig, n, [], 0


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[int, np.ndarray, bytes, bool]]]]:
    """For each batch, (row, hashes, key, whether the task has met the key) of the
    rows that have words."""
    seen: set[bytes] = set()

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, bytes, bool]]:
        texts = batch.column(batch.schema.get_field_index("text"))
        for i, text in enumerate(texts):
            if w := words_of(text.as_py()):
                h = shingle_hashes(w, n)
                key = set_key(h)
                met = key in seen
                if not met:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                yield i, h, key, met

    for batch in batches:
        yield batch, rows(batch)


_FEATURES = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("id", pa.binary()), ("inside", pa.list_(pa.int64())), ("wide", pa.list_(pa.int64())), ("sig", pa.int64()), ("held", pa.int64())])


def _features(n: int, percent: int):
    """A row for each document, and then one for each signature that the task has met
    often, with the number of its holders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders = Holders()
        for batch, found in _sets(batches, n):
            size, key = [0] * batch.num_rows, [None] * batch.num_rows
            inside, wide = [None] * batch.num_rows, [None] * batch.num_rows
            for i, h, k, met in found:
                size[i], key[i] = len(h), k
                if not met:
                    holders.add(signatures(h, percent)[0])
                    words = sketch_words(len(h))
                    inside[i] = parity_words(h, min(words, INSIDE)).view(np.int64)
                    if words > INSIDE:
                        wide[i] = parity_words(h, words).view(np.int64)
            none = pa.nulls(batch.num_rows, pa.int64())
            own = [pa.array(x, t) for x, t in zip((size, key, inside, wide), _FEATURES.types[2:6], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own, none, none], schema=_FEATURES)
        holders.merge()
        often = holders.n >= 8
        sig, held = holders.sig[often].view(np.int64), holders.n[often]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(len(sig), t) for t in _FEATURES.types[:6]), pa.array(sig), pa.array(held)], schema=_FEATURES)

    return run


def _kept_signatures(n: int, percent: int, hot: np.ndarray):
    """(sig, salt, key) of each set: hot signatures' holders are divided by salts."""
    kind = pa.schema([("sig", pa.int64()), ("salt", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in _sets(batches, n):
            sigs, salts, keys, held = [], [], [], 0
            for _, h, k, met in found:
                if met:
                    continue
                s, key = signatures(h, percent, hot)[1], short_key(k)
                sigs.append(s.view(np.int64))
                keys.append(np.full(len(s), key))
                salts.append(np.where(np.isin(s, hot), 1 + key % SALTS, 0).astype(np.int32) if len(hot) else np.zeros(len(s), np.int32))
                held += len(s)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, salts, keys)], schema=kind)
                    sigs, salts, keys, held = [], [], [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (sigs, salts, keys)], schema=kind)

    return run


def _verify(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, frozenset[bytes]] = (None, frozenset())
        for batch in batches:
            a, b = [], []
            for row in range(batch.num_rows):
                ka, kb, text_a, text_b = (batch.column(c)[row].as_py() for c in ("a", "b", "text_a", "text_b"))
                if last[0] != ka:
                    last = (ka, shingles(text_a, n))
                x, y = last[1], shingles(text_b, n)
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a.append(ka)
                    b.append(kb)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return run


def flips(x: str, y: str) -> str:
    """SQL: the Hamming distance of two sketches, of which the wider is folded to the
    width of the other; sizes of candidates are too close for more than one fold."""
    fold = lambda s: f"zip_with(slice({s}, 1, cast(size({s}) div 2 as int)), slice({s}, cast(size({s}) div 2 as int) + 1, cast(size({s}) div 2 as int)), (p, q) -> p ^ q)"
    distance = lambda s, t: f"aggregate(zip_with({s}, {t}, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    return f"case when size({x}) = size({y}) then {distance(x, y)} when size({x}) > size({y}) then {distance(fold(x), y)} else {distance(x, fold(y))} end"


def ngram_jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id, text).

    Two documents link when 100 * |A & B| >= percent * |A | B| on their sets of
    distinct n-word shingles (words end at ASCII white space, A-Z lower-cased; a
    text of fewer words is one shingle).  component_id is the smallest doc_id
    that can be reached.  No link is lost and no partner count is capped:

    1. Equal sets share a key of 128 bits and are one node from here on, however
       many copies.
    2. Of signatures that the very same nodes hold, one stays.  Each node meets the
       most connected node of each of its signatures; what is verified there forms
       first components.
    3. Within each signature, every pair of nodes from different components that
       passes the size and Hamming bounds is verified as well, a hot signature's
       holders in a grid of cells.  A pair within one component would change nothing
       and is never built.

    Null and empty texts: n_shingles 0, own component.  A null doc_id never is a
    component's name unless all its members are null.  Repeated rows come out
    repeated.  Other columns are ignored; an empty table gives an empty result."""
    return near_copy_groups(docs, n, percent).drop("text_hash", "root")


def near_copy_groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``ngram_jaccard_components`` with, for each row, text_hash (xxhash64 of its text)
    and root, the key of its component whatever the doc_ids; null for a text without
    words, which is alone."""
    if not 70 <= percent <= 100:
        raise ValueError("percent: from 70 to 100; sketches of a pair may differ by one fold only")
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "ngram")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")

    feats = scratch.keep(fewer_tasks(src).mapInArrow(_features(n, percent), "doc_id long, th long, n long, id binary, inside array<long>, wide array<long>, sig long, held long"), "feats")
    often = feats.where("sig is not null").groupBy("sig").agg(F.sum("held").alias("held")).where(F.col("held") >= HOT)
    # at most MOST_HOT numbers, which only order parts and divide their holders
    hot = np.array([r["sig"] for r in often.orderBy(F.desc("held"), "sig").limit(MOST_HOT).collect()], np.int64).view(np.uint64)
    feats = feats.where("sig is null")
    nodes = feats.where("id is not null").groupBy("id").agg(F.min("doc_id").alias("doc"), F.min(F.struct("doc_id", "th")).alias("row"), F.first("n").alias("n"), *[F.first(c, ignorenulls=True).alias(c) for c in ("inside", "wide")])
    nodes = scratch.keep(nodes.withColumn("key", F.conv(F.hex(F.substring("id", 1, 8)), 16, -10).cast("long")), "nodes")

    held = Window.partitionBy("sig", "salt")
    sigs = fewer_tasks(src).mapInArrow(_kept_signatures(n, percent, hot), "sig long, salt int, key long")
    live = sigs.withColumns({"lo": F.min("key").over(held), "hi": F.max("key").over(held)}).where("lo < hi or salt > 0").select("sig", "key").distinct()
    live = scratch.keep(live, "live")
    # signatures of the same holders find the same pairs
    marks = live.groupBy("sig").agg(F.count(F.lit(1)).alias("holders"), F.bit_xor(F.xxhash64("key")).alias("m1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("m2"))
    only = scratch.keep(marks.where("holders > 1").groupBy("holders", "m1", "m2").agg(F.min("sig").alias("sig")).select("sig", "holders"), "only")
    at = scratch.keep(live.join(only, "sig").join(nodes.select("id", "key", "n", "inside"), "key").drop("key"), "at")
    scratch.drop("live")
    scratch.drop("only")
    degree = at.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    at = at.join(degree.hint("merge"), "id")

    bound = f"least(x.n, y.n) * {100 - percent} div {percent}"
    close_sizes = f"{percent} * greatest(x.n, y.n) <= 100 * least(x.n, y.n)"
    near = f"{close_sizes} and {flips('x.inside', 'y.inside')} <= {bound}"
    me = F.struct("degree", "id", "n", "inside")
    #: of a pair, a is the node of more signatures: its text is the one that repeats
    ends = [F.col("x.id").alias("b"), F.col("y.id").alias("a")]

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The linked ones of distinct pairs (a, b): first by their whole sketches, then
        by the texts of those that are left."""
        own = nodes.select("id", "n", "wide")
        close = pairs.join(own.alias("x"), F.expr("a = x.id")).join(own.alias("y"), F.expr("b = y.id"))
        close = close.where(F.expr(f"x.wide is null or y.wide is null or {flips('x.wide', 'y.wide')} <= {bound}")).select("a", "b")
        close = scratch.keep(close, f"{name}-close")
        # one row of each node gives its text: by doc_id and text, as a doc_id may be null or repeated
        wanted = close.select(F.col("a").alias("id")).union(close.select("b")).distinct().join(nodes.select("id", "row"), "id")
        wanted = wanted.select("id", F.coalesce("row.doc_id", F.lit(-1)).alias("d"), F.col("row.th").alias("th"))
        wanted = scratch.keep(wanted, f"{name}-wanted")
        some = maybe_in(src, F.col("th"), filter_table(wanted, "th")).select(F.coalesce("doc_id", F.lit(-1)).alias("d"), "th", "text")
        texts = some.join(wanted.hint("merge"), ["d", "th"]).dropDuplicates(["d", "th", "id"]).select("id", "text")
        texts = scratch.keep(texts, f"{name}-texts")
        ta, tb = (texts.select(F.col("id").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
        both = close.join(tb.hint("merge"), "b").join(ta.hint("merge"), "a").select("a", "b", "text_a", "text_b")
        out = scratch.keep(both.mapInArrow(_verify(n, percent), "a binary, b binary"), name)
        for what in ("close", "wanted", "texts"):
            scratch.drop(f"{name}-{what}")
        return out

    # written first, so that the join reads plain rows and a hot key's can be split
    hubs = scratch.keep(at.groupBy("sig").agg(F.max(me).alias("y")), "hubs")
    first = at.select("sig", me.alias("x")).join(hubs.hint("merge"), "sig").where("x.id <> y.id").where(F.expr(near))
    pairs = scratch.keep(first.select(*ends).distinct(), "pairs")
    links = verified(pairs, "links1")
    label = components(links, scratch, "cc1")

    at = at.join(label.select("id", "label").hint("merge"), "id", "left").withColumn("comp", F.coalesce("label", "id")).drop("label")
    mixed = at.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig")
    mixed = scratch.keep(mixed, "mixed-sigs")
    mixed = scratch.keep(at.join(mixed.hint("merge"), "sig").drop("degree"), "mixed")
    scratch.drop("at")
    rest = grid_pairs(mixed, "sig", F.ceil(F.col("holders") / CELL), f"x.comp <> y.comp and {near}")
    rest = rest.select(F.least("x.id", "y.id").alias("b"), F.greatest("x.id", "y.id").alias("a")).distinct()
    known = pairs.select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a"))
    more = verified(rest.join(known, ["a", "b"], "left_anti"), "links2")
    if not more.isEmpty():
        label = components(links.unionByName(more), scratch, "cc2")
    for name in ("mixed", "mixed-sigs", "hubs", "pairs"):
        scratch.drop(name)

    named = nodes.select("id", "doc").join(label, "id", "left").withColumn("root", F.coalesce("label", "id"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = scratch.keep(named.select("id", "root").join(least.hint("merge"), "root").select("id", "root", "component_id"), "named")
    rows = scratch.keep(feats.select("doc_id", F.col("th").alias("text_hash"), F.col("n").alias("n_shingles"), "id"), "rows")
    for name in ("feats", "nodes"):
        scratch.drop(name)
    out = rows.join(named, "id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "text_hash", "root")


def grid_pairs(rows: DataFrame, group: str, blocks: Column, condition: str) -> DataFrame:
    """Pairs (x, y) of rows (id, ...) of one group that fulfil a SQL condition, each
    once.  A group of several ``blocks`` is divided into them by a hash of id, and
    each two blocks, and each block with itself, meet in a cell of their own."""
    rows = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_own", F.pmod(F.xxhash64("id", F.lit(3)), F.col("_blocks")).cast("int"))
    x = rows.withColumn("_cell", F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1))).select(group, F.col("_own").alias("_lo"), F.col("_cell").alias("_hi"), F.struct(*rows.columns).alias("x"))
    y = rows.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_own")))).select(group, F.col("_cell").alias("_lo"), F.col("_own").alias("_hi"), F.struct(*rows.columns).alias("y"))
    meet = F.expr(f"p.{group} = q.{group} and p._lo = q._lo and p._hi = q._hi and (p._lo < p._hi or x.id < y.id) and {condition}")
    return x.alias("p").join(y.alias("q").hint("merge"), meet).select("x", "y")


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of ``ngram_jaccard_components``: that of
    the smallest doc_id, a null id last, and of several such texts that of the
    smallest hash.  Of texts without words, one row stays for each doc_id and text.

    Only rows that may have to go are shuffled with their texts.  All columns pass,
    whatever their names; an empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "nearcopies")
    names = docs.columns
    groups = scratch.keep(near_copy_groups(docs, n, percent), "groups")
    key = lambda d, h: [d.isNull().alias("_no"), F.coalesce(d, F.lit(0)).alias("_d"), h.alias("_h")]
    rows = groups.select(*key(F.col("doc_id"), F.col("text_hash")), "root").groupBy("_no", "_d", "_h", "root").agg(F.count(F.lit(1)).alias("times"))
    stay = rows.where("root is not null").groupBy("root").agg(F.min(F.struct("_no", "_d", "_h")).alias("_first"))
    rows = rows.join(stay.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root"), "left")
    stays = F.col("root").isNull() | (F.struct("_no", "_d", "_h") == F.col("_first"))
    doubtful = scratch.keep(rows.where((F.col("times") > 1) | ~stays).select("_no", "_d", "_h", stays.alias("_stays")), "doubtful")
    seen = filter_table(doubtful, "_h")
    packed = docs.select(F.struct(*names).alias("_row")).select("_row", *key(F.col("_row.doc_id").cast("long"), F.xxhash64(F.col("_row.text").cast("string"))))
    sure = maybe_in(packed, F.col("_h"), seen, outside=True)
    asked = maybe_in(packed, F.col("_h"), seen).join(doubtful.hint("merge"), ["_no", "_d", "_h"], "left")
    # rows that aren't doubtful after all are kept as they are, also if equal in part
    kept = asked.where("_stays").dropDuplicates(["_no", "_d", "_h"]).select("_row").unionAll(asked.where("_stays is null").select("_row"))
    return sure.select("_row").unionAll(kept).select("_row.*")
