"""Line deduplication over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, Scratch, aside, ascii_lower, filter_table, maybe_in

#: Runs of one level that are merged into one run of the next.
FANOUT = 2
HASH = ("h1", "h2")


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(WHITE)))


class LevelledRuns:
    """What is known of line hashes, as levels of sorted runs.

    A run is a table (h1, h2, n_docs, max_doc) in buckets by its 128-bit hash, each
    bucket one sorted file; each hash is in one run only.  All runs have the same
    buckets, so a merge join with a run needs neither an exchange nor a sort of it.
    A new batch is brought into that form once and anti-joined with the runs, one
    after the other: what none of them holds becomes its own run, on level 0, and
    what is known already becomes an update (the same columns).  Once a level holds
    ``fanout`` runs they become one run of the next level, and updates are added up,
    so a hash is rewritten once per level and there are at most fanout - 1 runs per
    level."""

    def __init__(self, scratch: Scratch, fanout: int = FANOUT, buckets: int | None = None):
        self.scratch, self.fanout, self.spark = scratch, fanout, scratch.spark
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.updates: list[str] = []

    @contextmanager
    def _planned(self):
        """Tables of one file per bucket are taken as sorted, and joins merge."""
        held = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}
        before = {k: self.spark.conf.get(k) for k in held}
        for k, v in held.items():
            self.spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def _write(self, df: DataFrame, dealt: bool = False) -> str:
        """``dealt``: all rows of a bucket lie in one partition, so its file is one."""
        name = f"fluxgate_run_{uuid.uuid4().hex}"
        with self._planned():
            df = df if dealt else df.repartition(self.buckets, *HASH)
            df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", f"{self.scratch.root}/{name}").saveAsTable(name)
        return name

    def table(self, name: str) -> DataFrame:
        """A run in its buckets, for joins."""
        return self.spark.table(name)

    def _union(self, names: list[str]) -> DataFrame:
        """Runs as plain files: what is added up or merged is dealt out anew."""
        out = None
        for n in names:
            rows = self.spark.read.schema(self.table(n).schema).parquet(f"{self.scratch.root}/{n}")
            out = rows if out is None else out.unionByName(rows)
        return out

    def _added_up(self, names: list[str]) -> DataFrame:
        return self._union(names).groupBy(*HASH).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def add(self, batch: DataFrame) -> str:
        """Add the lines (h1, h2, doc_id) of documents that no earlier batch held.
        Gives the name of the batch's run: its hashes that were not known before."""
        once = batch.select(*HASH, "doc_id").distinct()
        own = once.groupBy(*HASH).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))
        # the counts were shuffled by the same hash, hence into whole buckets
        name = self._write(own, dealt=self.buckets == int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        if self.runs():
            batch_name = name
            name = self._write(self.unseen(self.table(batch_name)), dealt=True)
            known = self._write(self._without(self.table(batch_name), name), dealt=True)
            self.updates.append(known)
            self._forget([batch_name])
        self._enter(name, 0)
        self._compact()
        return name

    def _enter(self, name: str, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            self._enter(self._write(self._union(old)), level + 1)
            self._forget(old)
            level += 1
        if len(self.updates) >= self.fanout:
            old = self.updates
            self.updates = [self._write(self._added_up(old))]
            self._forget(old)

    def _forget(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"drop table {name}")
            self.scratch.drop(name)

    def clear(self) -> None:
        """Remove all tables; nothing may read them any more."""
        for names in [*self.levels, self.updates]:
            self._forget(names)

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def _without(self, rows: DataFrame, run: str) -> DataFrame:
        return rows.join(self.table(run).select(*HASH).hint("merge"), list(HASH), "left_anti")

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows of a batch whose hash no run holds, by merge anti-joins."""
        for run in self.runs():
            batch = self._without(batch, run)
        return batch

    def merged(self) -> DataFrame:
        """One row per hash with its totals, over all runs and updates."""
        return self._added_up([*self.runs(), *self.updates])


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """``docs`` with n_lines, n_dropped (long) and kept_text added.

    Each text is split at \\n; a null or empty text is one empty line.  A line's
    key is the line without ASCII white space at its ends, A-Z lower-cased.  A key
    of at least ``min_chars`` code points that at least ``min_docs`` documents
    hold loses all its lines, except those in the largest doc_id that holds it.
    The other lines, joined by \\n, are the kept text.

    The lines' hashes enter ``LevelledRuns`` in ``batches`` by doc_id and text; the
    runs' totals decide.  A document is then told the places of the lines it loses,
    and only documents that may lose some are shuffled.

    Rows of one doc_id count as one document; rows without doc_id count together as
    one document, smaller than all others.  Repeated rows come out repeated.  All
    columns of ``docs`` pass, but for those that bear one of the new names, which are
    replaced.  An empty table gives an empty result."""
    scratch = Scratch(docs.sparkSession, "lines")
    rest, back = aside(docs, "doc_id", "text", new=("n_lines", "n_dropped", "kept_text"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc, th = F.col("doc_id").cast("long"), F.xxhash64(text)
    hashes = [F.xxhash64("k").alias("h1"), F.xxhash64(F.lit("second"), "k").alias("h2")]
    held = rest.select(doc.alias("doc_id"), th.alias("th"), F.posexplode(F.split(text, "\n")).alias("pos", "line")).select("doc_id", "th", "pos", line_key(F.col("line")).alias("k"))
    held = held.where(F.length("k") >= min_chars).select("doc_id", "th", "pos", *hashes)
    held = scratch.keep(held.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "held")

    runs = LevelledRuns(scratch)
    for b in range(batches):
        runs.add(held.where(F.col("batch") == b))
    common = scratch.keep(runs.merged().where(F.col("n_docs") >= min_docs), "common")
    runs.clear()
    lost = held.join(common.hint("merge"), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("max_doc")))
    # a text's own lines at most; rows equal in doc_id and text lose the same ones
    lost = lost.groupBy(F.coalesce("doc_id", F.lit(0)).alias("_d"), F.col("doc_id").isNull().alias("_no"), F.col("th").alias("_th")).agg(F.array_sort(F.collect_set("pos")).alias("_lost"))
    lost = scratch.keep(lost, "lost")
    for name in ("held", "common"):
        scratch.drop(name)

    n_lines = (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.lit(1)).cast("long")
    seen = filter_table(lost, "_th")
    sure = maybe_in(rest, th, seen, outside=True)
    asked = maybe_in(rest, th, seen).withColumns({"_d": F.coalesce(doc, F.lit(0)), "_no": doc.isNull(), "_th": th}).join(lost.hint("merge"), ["_d", "_no", "_th"], "left")
    dropped = F.when(F.col("_lost").isNull(), F.lit(0)).otherwise(F.size("_lost")).cast("long")
    kept = F.when(F.col("_lost").isNull(), text).otherwise(F.array_join(without_places(F.split(text, "\n"), F.col("_lost")), "\n"))
    out = sure.select(*back, n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), text.alias("kept_text"))
    return out.unionAll(asked.select(*back, n_lines.alias("n_lines"), dropped.alias("n_dropped"), kept.alias("kept_text")))


def without_places(a: Column, places: Column) -> Column:
    """An array without the elements at the places (from 0, sorted): the slices
    between them, so that each element is looked at once."""
    begins = F.concat(F.array(F.lit(0)), F.transform(places, lambda p: p + 1))
    ends = F.concat(places, F.array(F.size(a)))
    return F.flatten(F.zip_with(begins, ends, lambda b, e: F.slice(a, b + 1, e - b)))
