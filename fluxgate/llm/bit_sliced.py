"""Exact top-k search by integer inner product over a bit-sliced index.

The index holds each block of rows as bitmaps: bit b of the quantised component d
of all rows is one bitmap (a slice).  With a query's coefficients in signed
digits, its score is a sum of shifted slices and complements of slices, which
carry-save adders form with bitwise operations for 64 rows at a time.  The top rows of the sum are selected
from its most significant slice downward; what quantising left out is bounded, so
all rows that might belong to the top are at or above a boundary, and these are
resolved by their exact scores."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SCALE = 1024.0
#: Rows of a block, and bits kept of a component.
BLOCK, BITS = 16384, 8
#: Queries and bytes of a group of queries at most, and groups that a pass over the
#: index takes: what a pass broadcasts is bounded by their product.
GROUP_QUERIES, GROUP_BYTES, PASS_GROUPS = 1024, 1 << 20, 16
#: Components from here on are wide: their rows are told exactly, not by slices.
WIDE = 1 << 31


def quantised(vectors: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(positions, vectors) of the rows that take part: floor(1024 * x) of vectors
    without null or non-finite components, as doubles that are whole numbers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    keep, out = [], []
    for i in np.flatnonzero(lengths):
        x = flat[ends[i] - lengths[i] : ends[i]]
        if np.isfinite(x).all():
            if np.abs(x).max() >= 2.0**1013:
                raise OverflowError("1024 times a component is beyond the range of a double")
            keep.append(i)
            out.append(np.floor(SCALE * x))
    return np.array(keep, np.int64), out


def bitmap(flags: np.ndarray) -> np.ndarray:
    """Rows x (last axis) to 64-bit words; the row count is a multiple of 64."""
    return np.packbits(flags, axis=-1, bitorder="little").view(np.uint64)


class Block:
    """A block of the index: exact rows, and the slices of their top bits."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.n = len(ids)
        self.most = int(np.abs(rows).max(initial=0))
        width = max(1, self.most).bit_length() + 1
        self.shift = max(0, width - BITS)
        top = (rows >> self.shift) + (1 << (BITS - 1))
        padded = np.zeros((rows.shape[1], -(-self.n // 64) * 64), np.uint8)
        padded[:, : self.n] = top.T
        bits = bitmap(np.stack([(padded >> b) & 1 for b in range(BITS)], axis=1))
        self.slices = bits.reshape(-1, bits.shape[-1])
        self.both = np.concatenate([self.slices, ~self.slices])
        real = np.zeros(padded.shape[1], np.uint8)
        real[: self.n] = 1
        self.real = bitmap(real)


def add_slices(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of bitmaps (k, words) of weight 2^c in columns[c], as one bitmap per bit."""
    columns, out, c = list(columns), [], 0
    while c < len(columns):
        x = columns[c]
        while len(x) > 1:
            k = len(x) // 3 * 3
            if k:
                a, b, d = x[0:k:3], x[1:k:3], x[2:k:3]
                ab = a ^ b
                total, carry = ab ^ d, (a & b) | (ab & d)
            else:  # two are left
                total, carry, k = x[:1] ^ x[1:2], x[:1] & x[1:2], 2
            x = np.concatenate([total, x[k:]])
            if c + 1 == len(columns):
                columns.append(carry)
            else:
                columns[c + 1] = np.concatenate([columns[c + 1], carry])
        out.append(x[0] if len(x) else None)
        c += 1
    return out


def kth_value(sums: list[np.ndarray], rows: np.ndarray, k: int) -> int:
    """The k-th largest sum among ``rows``, from the most significant slice downward."""
    above, equal, value = 0, rows, 0
    for b in range(len(sums) - 1, -1, -1):
        if sums[b] is None:
            continue
        ones = equal & sums[b]
        n = int(np.bitwise_count(ones).sum())
        if above + n >= k:
            equal, value = ones, value | (1 << b)
        else:
            above, equal = above + n, equal & ~sums[b]
    return value


def at_least(sums: list[np.ndarray], rows: np.ndarray, value: int) -> np.ndarray:
    """The rows whose sum is ``value`` or more, as positions."""
    if value >= 1 << len(sums):
        return np.zeros(0, np.int64)
    greater, equal = np.zeros_like(rows), rows
    for b in range(len(sums) - 1, -1, -1):
        s = sums[b] if sums[b] is not None else np.zeros_like(rows)
        if value >> b & 1:
            equal = equal & s
        else:
            greater |= equal & s
            equal = equal & ~s
    return np.flatnonzero(np.unpackbits((greater | equal).view(np.uint8), bitorder="little"))


def block_top(block: Block, query: np.ndarray, query_id: int, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, exact scores) of all rows of a block that may be among the k best;
    ``floor``: the k-th best score known so far.  May return more, never fewer."""
    unit = 1 << block.shift
    tail = query * (unit - 1)
    least, most = int(np.minimum(tail, 0).sum()), int(np.maximum(tail, 0).sum())
    # signed digits of the coefficients, at most half of them non-zero
    size = np.abs(query)
    plus, minus = (3 * size & ~size) >> 1, (size & ~(3 * size)) >> 1
    plus, minus = np.where(query < 0, minus, plus), np.where(query < 0, plus, minus)
    # score = unit * (sum - base) + something in [least, most]
    base = (1 << (BITS - 1)) * int(query.sum()) + ((1 << BITS) - 1) * int(minus.sum())
    digits = [np.concatenate([np.flatnonzero(plus >> j & 1) * BITS, np.flatnonzero(minus >> j & 1) * BITS + len(block.slices)]) for j in range(int(size.max()).bit_length() + 1)]
    picks: list[list[np.ndarray]] = [[] for _ in range(len(digits) + BITS - 1)]
    for j, own in enumerate(digits):
        for b in range(BITS):
            picks[j + b].append(own + b)
    sums = add_slices([block.both[np.concatenate(p)] for p in picks])
    own = int(np.count_nonzero(block.ids == query_id))
    cut = 0
    if block.n > k + own:
        cut = kth_value(sums, block.real, k + own) - -(-(most - least) // unit)
    if floor is not None:  # unit * (sum - base) + most >= floor
        cut = max(cut, -(-(floor - most) // unit) + base)
    at = at_least(sums, block.real, max(0, cut))
    at = at[block.ids[at] != query_id]
    return block.ids[at], block.rows[at] @ query


def whole(rows: np.ndarray) -> np.ndarray:
    """Doubles that are whole numbers, as Python's integers of any size."""
    return np.array([[int(x) for x in r] for r in rows], object).reshape(rows.shape)


def exact_top(ids: np.ndarray, rows: np.ndarray, query: np.ndarray, query_id: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``block_top`` for numbers of any size; a score beyond 64 bits is an error."""
    scored = sorted((-int(s), int(i)) for i, s in zip(ids, whole(rows) @ whole(query[None])[0], strict=True) if i != query_id)[:k]
    if any(not -(1 << 63) <= -s < 1 << 63 for s, _ in scored):
        raise OverflowError("a score is beyond 64 bits")
    return np.array([i for _, i in scored], np.int64), np.array([-s for s, _ in scored], np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, ~scores))[:k]  # ~ falls as a score rises, for all of 64 bits
    return ids[order], scores[order]


def _pack(size: int, most_bytes: int):
    """Rows (vec_id, embedding) to packed blocks of rows of one dimension, wide rows and
    others apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], list[tuple[int, np.ndarray]]] = {}

        def out(dim: int, wide: bool) -> pa.RecordBatch:
            rows = held.pop((dim, wide))
            ids = np.array([r[0] for r in rows], np.int64)
            data = np.stack([r[1] for r in rows]).astype(np.float64 if wide else np.int32)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "wide": [wide], "n": pa.array([len(ids)], pa.int64()), "ids": [ids.tobytes()], "data": [data.tobytes()]})

        for batch in batches:
            ids = batch.column("vec_id").to_pylist()
            keep, vectors = quantised(batch.column("embedding"))
            for i, v in zip(keep, vectors, strict=True):
                if ids[i] is not None:
                    key = (len(v), bool(np.abs(v).max() >= WIDE))
                    own = held.setdefault(key, [])
                    own.append((ids[i], v))
                    if len(own) >= size or len(own) * 8 * key[0] >= most_bytes:
                        yield out(*key)
        for key in list(held):
            yield out(*key)

    return run


def _search(k: int):
    """Rows (a block of the index beside a group of queries) to the best rows of all the
    task's blocks for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        last, block, ids, rows = None, None, None, None
        for batch in batches:
            for r in range(batch.num_rows):
                part, dim, wide, q_wide, data_ids, data, q_ids, q_data = (batch.column(c)[r].as_py() for c in ("part", "dim", "wide", "q_wide", "ids", "data", "q_ids", "q_data"))
                if part != last:
                    ids = np.frombuffer(data_ids, np.int64)
                    rows = np.frombuffer(data, np.float64 if wide else np.int32).reshape(-1, dim)
                    last, block = part, None if wide else Block(ids, rows.astype(np.int64))
                asked = np.frombuffer(q_data, np.float64 if q_wide else np.int32).reshape(-1, dim)
                for i, q in zip(np.frombuffer(q_ids, np.int64).tolist(), asked, strict=True):
                    got_ids, got = top.get((dim, i), (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                    # no sum of this block's products leaves 63 bits
                    if block is not None and not q_wide and block.most * int(np.abs(q.astype(np.int64)).sum()) < 1 << 62:
                        more_ids, more = block_top(block, q.astype(np.int64), i, k, int(got[-1]) if len(got) == k else None)
                    else:
                        more_ids, more = exact_top(ids, rows, q, i, k)
                    top[dim, i] = best(np.r_[got_ids, more_ids], np.r_[got, more], k)
        for (_, i), (got_ids, got) in top.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), i, np.int64)), pa.array(got_ids), pa.array(got)], names=["query_id", "vec_id", "score"])

    return run


def exact_top_k(rows: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) over ``rows`` (vec_id, embedding): for each
    row whose vec_id is divisible by ``every``, the k other rows of the largest
    inner product of floor(1024 * x), ties to the smaller vec_id.

    Vectors that are null or empty, or hold a null or non-finite component, take no
    part, nor do rows without vec_id; a vector meets vectors of its own length.
    Rows with the query's vec_id are the query's own.  Repeated rows count as
    candidates each; a repeated query is asked once, with the least of
    its vectors that take part.  Scores are exact: numbers that slices can't hold are
    worked out one by one, and a result beyond 64 bits, or a component that 1024 times
    leaves a double, raises.  An empty table gives an empty result.

    The index stays where it is.  Queries go to its blocks in passes of PASS_GROUPS
    groups, each of which is bounded in rows and bytes, and a task sends on k rows per
    query for all its blocks."""
    scratch = Scratch(rows.sparkSession, "bits")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = "dim int, wide boolean, n long, ids binary, data binary"
    index = scratch.keep(rows.mapInArrow(_pack(BLOCK, 64 << 20), kind).withColumn("part", F.monotonically_increasing_id()).drop("n"), "index")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    asked = rows.where((F.pmod("vec_id", F.lit(every)) == 0) & (F.size("embedding") > 0) & finite).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = scratch.keep(asked.mapInArrow(_pack(GROUP_QUERIES, GROUP_BYTES), kind).withColumn("group", F.monotonically_increasing_id()), "queries")
    # a pass takes the groups of one number; small groups of many tasks share a pass by their size
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    full = F.sum(F.greatest(F.octet_length("data") / F.lit(GROUP_BYTES), F.col("n") / F.lit(GROUP_QUERIES)))
    number = asked.withColumn("pass", F.floor(F.coalesce(full.over(before), F.lit(0.0)) / PASS_GROUPS))
    asked = scratch.keep(number.select(F.col("dim").alias("q_dim"), F.col("wide").alias("q_wide"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "pass"), "queries-at")
    found = None
    for p in range((asked.agg(F.max("pass")).first()[0] or 0) + 1):
        # bounded by PASS_GROUPS and a group more
        meet = index.join(F.broadcast(asked.where(F.col("pass") == p)), F.col("dim") == F.col("q_dim"))
        got = scratch.keep(meet.mapInArrow(_search(k), "query_id long, vec_id long, score long"), f"found{p}")
        found = got if found is None else found.unionAll(got)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
