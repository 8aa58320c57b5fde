"""Sharding by a k-d tree over metadata dimensions [native]."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Bins of one histogram pass per tree node.
BINS = 512
#: Rows of one slot block on average: no window task ranks more than a few times as many.
ROWS_PER_BLOCK = 20_000
#: A split may miss its share of a node's bytes by this part.
TOLERANCE = 0.0005


def dense_ranks(values: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(value, rank) of the distinct values of the column ``value`` in their order, from
    0.  Ranges of values are ranked apart, and their first ranks come from their counts,
    so no task sees all values."""
    parts = values.where("value is not null").distinct().repartitionByRange("value").withColumn("part", F.spark_partition_id())
    parts = scratch.keep(parts, f"{name}-parts")
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))
    ranks = parts.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1).join(starts, "part")
    return scratch.keep(ranks.select("value", (F.col("r") + F.col("start")).alias("rank")), f"{name}-ranks")


@dataclass
class Node:
    """A tree node: it holds the shards [first, first + shards)."""

    first: int
    shards: int
    dim: str = ""
    value: int = 0
    tie: int = 0
    low: Node | None = None
    high: Node | None = None

    def below(self) -> Column:
        """Whether a row goes to the low side; ties are told apart by their tie number."""
        return (F.col(self.dim) < F.lit(self.value)) | (F.col(self.dim) == F.lit(self.value)) & (F.col("tie") < F.lit(self.tie))

    def label(self) -> Column:
        """The first shard of the leaf that a row is in, as one CASE expression."""
        if self.low is None:
            return F.lit(self.first)
        return F.when(self.below(), self.low.label()).otherwise(self.high.label())


def _cuts(rows: DataFrame, nodes: list[Node], value: dict[int, Column], bounds: dict[int, tuple[int, int]], want: dict[int, float], slack: dict[int, float], base: dict[int, float]) -> dict[int, tuple[int, float]]:
    """For each node the largest v so that rows of a smaller value weigh at most the
    wanted bytes, and what they weigh.  ``base`` is what is below the bounds.
    Histograms of BINS bins are refined until a bin is one value wide, or light
    enough; each pass is one aggregation with map-side partials, of which the
    driver gets BINS numbers per node."""
    done: dict[int, tuple[int, float]] = {}
    lo_hi = dict(bounds)
    base = dict(base)
    while lo_hi:
        bin_, width = F.lit(None).cast("long"), {}
        for n in nodes:
            if n.first in lo_hi:
                lo, hi = lo_hi[n.first]
                width[n.first] = w = max(1, -(-(hi - lo + 1) // BINS))
                v = value[n.first]
                bin_ = F.when((F.col("leaf") == n.first) & v.between(lo, hi), F.floor((v - F.lit(lo)) / F.lit(w))).otherwise(bin_)
        got = rows.withColumn("bin", bin_).where("bin is not null").groupBy("leaf", "bin").agg(F.sum("size").alias("w")).collect()
        by: dict[int, dict[int, float]] = {}
        for r in got:
            by.setdefault(r["leaf"], {})[int(r["bin"])] = float(r["w"])
        for first in list(lo_hi):
            (lo, hi), w, below = lo_hi[first], width[first], base[first]
            end = (lo, hi + 1, 0.0)
            for b in sorted(by.get(first, {})):
                weight = by[first][b]
                if below + weight > want[first]:
                    end = (lo + b * w, min(hi, lo + (b + 1) * w - 1), weight)
                    break
                below += weight
            else:
                done[first] = (hi + 1, below)
                del lo_hi[first]
                continue
            base[first] = below
            if end[0] == end[1] or end[2] <= slack[first]:
                done[first] = (end[0], below)
                del lo_hi[first]
            else:
                lo_hi[first] = (end[0], end[1])
    return done


def kd_tree(rows: DataFrame, dims: tuple[str, ...], shards: int) -> Node:
    """Grow the tree over ``rows`` (size, tie, and the long columns ``dims``).

    A node of several shards is split along its dimension of the widest extent,
    relative to the whole table's, at the weighted median (or at the share of its
    low side, if the shards are not even), until a leaf is one shard, whose target
    is the table's bytes over ``shards``.  Rows of the median value itself, such as
    a hot source, are divided by ``tie``, a hash, at a median of its own."""
    root = Node(0, shards)
    level = [root]
    whole: dict[str, tuple[int, int]] = {}
    while level := [n for n in level if n.shards > 1]:
        rows_at = rows.withColumn("leaf", root.label())
        ends = [f(d).alias(f"{d}_{k}") for d in dims for k, f in (("lo", F.min), ("hi", F.max))]
        stats = {r["leaf"]: r for r in rows_at.groupBy("leaf").agg(F.sum("size").alias("w"), *ends).collect()}
        if not stats:
            break
        whole = whole or {d: (stats[0][f"{d}_lo"], stats[0][f"{d}_hi"]) for d in dims}
        for n in level:
            if n.first not in stats:  # no rows: any rule will do
                n.dim = dims[0]
            else:
                r = stats[n.first]
                n.dim = max(dims, key=lambda d: (r[f"{d}_hi"] - r[f"{d}_lo"]) / max(1, whole[d][1] - whole[d][0]))  # noqa: B023
        open_ = [n for n in level if n.first in stats]
        weight = {n.first: float(stats[n.first]["w"]) for n in open_}
        want = {n.first: weight[n.first] * (n.shards // 2) / n.shards for n in open_}
        slack = {k: w * TOLERANCE for k, w in weight.items()}
        bounds = {n.first: (stats[n.first][f"{n.dim}_lo"], stats[n.first][f"{n.dim}_hi"]) for n in open_}
        at = _cuts(rows_at, open_, {n.first: F.col(n.dim) for n in open_}, bounds, want, slack, dict.fromkeys(weight, 0.0))
        for n in open_:
            n.value = at[n.first][0]
        ties = [n for n in open_ if want[n.first] - at[n.first][1] > slack[n.first]]
        if ties:
            value = {n.first: F.when(F.col(n.dim) == n.value, F.col("tie")) for n in ties}
            for first, (v, _) in _cuts(rows_at, ties, value, {n.first: (0, (1 << 40) - 1) for n in ties}, want, slack, {n.first: at[n.first][1] for n in ties}).items():
                next(n for n in ties if n.first == first).tie = v
        nxt = []
        for n in level:
            k = n.shards // 2
            n.low, n.high = Node(n.first, k), Node(n.first + k, n.shards - k)
            nxt += [n.low, n.high]
        level = nxt
    return root


def kd_shards(docs: DataFrame, shards: int = 16, target_bytes: int | None = None) -> DataFrame:
    """``docs`` without its text: doc_id, size, text_crc32, shard, slot.

    size: UTF-8 bytes of the text (null: none) plus 1.  The shards are the leaves of
    a k-d tree over doc_id, size, source and lang (a null is least), so a shard
    holds rows of similar metadata and sizes are near equal; ``target_bytes`` gives
    the shards' size instead of their number.  slot counts a shard's rows from 0
    without gaps, in blocks: block counts are added up, and only rows of one block
    are ranked in one task, so no shard or group meets in one task.  Equal texts are
    no group here: they go where their metadata lies, apart as a rule.  Null doc_ids
    and repeated rows are rows like others.  The tie number is a hash of doc_id and
    text, and behind it one of the row's position, so that even equal rows can be
    divided if they are many; other rows lie in the same shard on every run.  An
    empty table gives an empty result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "kd")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
    )
    base = scratch.keep(base, "measured")
    for name in ("source", "lang"):
        ranks = dense_ranks(base.select(F.col(name).alias("value")), scratch, name)
        base = base.join(ranks, F.col(name) == F.col("value"), "left").drop(name, "value").withColumn(f"at_{name}", F.coalesce("rank", F.lit(-1))).drop("rank")
    low = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 10))
    base = base.withColumn("tie", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(1 << 30)) * F.lit(1 << 10) + low)
    base = scratch.keep(base.withColumn("at_doc", F.coalesce("doc_id", F.lit(-1))), "rows")
    if target_bytes:
        total = base.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    tree = kd_tree(base, ("at_doc", "size", "at_source", "at_lang"), shards)
    placed = scratch.keep(base.select("doc_id", "size", "text_crc32", "tie", tree.label().alias("shard")), "placed")
    # one row per shard, of which the caller gives the number
    blocks = placed.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ROWS_PER_BLOCK).alias("blocks"))
    placed = placed.join(F.broadcast(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("tie", F.lit(1)), F.col("blocks"))).drop("tie", "blocks")
    return with_slots(placed, "shard", "block", ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def with_slots(rows: DataFrame, group: str, block: str, order: list[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without gaps.  ``block`` divides a group
    evenly: only a block's rows are ranked in one task, and the blocks' first
    numbers come from their counts."""
    counts = rows.groupBy(group, block).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(group, block, (F.sum("n").over(Window.partitionBy(group).orderBy(block)) - F.col("n")).alias("start"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy(group, block).orderBy(*order)) - 1)
    return ranked.join(starts, [group, block]).withColumn(name, (F.col("r") + F.col("start")).cast("long")).drop("r", "start")
