"""Connected components over an edge table, by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(id, label) for every end of ``edges`` (a, b); equal labels mean connected.

    Each round, every node moves to the member of its closed neighbourhood with
    the least random rank (a new rank each round); edges are rewritten to the
    chosen members and self-loops vanish.  The expected number of nodes falls by
    a constant share per round whatever the shape of the graph, hubs and chains
    included, so the rounds are logarithmic.  All steps are aggregations with
    map-side partials and equi-joins; each round's tables go to shared storage.
    Null ends are ignored.  An empty edge table gives an empty result."""
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    e = scratch.keep(e, f"{tag}-e0")
    labels, k = None, 0
    while not e.isEmpty():
        rank = lambda c: F.xxhash64(F.col(c), F.lit(7919 * (k + 1)))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy(F.col("a").alias("id")).agg(F.min_by("b", rank("b")).alias("n"), F.min(rank("b")).alias("r"))
        move = scratch.keep(best.select("id", F.when(F.col("r") < rank("id"), F.col("n")).otherwise(F.col("id")).alias("to")), f"{tag}-m{k}")
        if labels is None:
            labels = scratch.keep(move.withColumnRenamed("to", "label"), f"{tag}-l{k}")
        else:
            moved = labels.join(move.withColumnRenamed("id", "label"), "label", "left")
            labels = scratch.keep(moved.select("id", F.coalesce("to", "label").alias("label")), f"{tag}-l{k}")
            scratch.drop(f"{tag}-l{k - 1}")
        to_a, to_b = move.select(F.col("id").alias("a"), F.col("to").alias("ta")), move.select(F.col("id").alias("b"), F.col("to").alias("tb"))
        e = e.join(to_a, "a").join(to_b, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct()
        e = scratch.keep(e, f"{tag}-e{k + 1}")
        scratch.drop(f"{tag}-e{k}")
        scratch.drop(f"{tag}-m{k}")
        k += 1
    if labels is None:
        return e.select(F.col("a").alias("id"), F.col("b").alias("label"))
    return labels
