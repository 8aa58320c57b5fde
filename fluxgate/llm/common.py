"""Shared scratch tables and column helpers of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters, \x20 and \x09 to \x0D.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.
    Only where the session names none (local tests) is a temporary one made."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        own = tempfile.mkdtemp(prefix="fluxgate-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(own)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def bounded_batches(spark: SparkSession, rows: int = 512, mb: int = 16) -> None:
    """Let Arrow batches of texts hold few rows and bytes, unless the session says
    otherwise: a Python worker's memory then doesn't depend on the texts' lengths."""
    for key, usual, value in (("maxRecordsPerBatch", "10000", str(rows)), ("maxBytesPerBatch", None, str(mb << 20))):
        key = f"spark.sql.execution.arrow.{key}"
        if usual is None or spark.conf.get(key) == usual:
            spark.conf.set(key, value)


#: Input of a task that writes what it reads without a shuffle, where there are many.
TASK_MB = 256


def fewer_tasks(df: DataFrame) -> DataFrame:
    """``df`` in three partitions per core, or in more of about TASK_MB each: a pass
    over small splits would otherwise write a small file for each."""
    spark = df.sparkSession
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    # where the size isn't known, it is given as beyond measure, and nothing changes
    return df.coalesce(min(max(3 * spark.sparkContext.defaultParallelism, size // (TASK_MB << 20) + 1), (1 << 31) - 1))


#: Words of 64 bits of a filter table at most: its broadcast is bounded by them.
FILTER_WORDS = 1 << 18


def _filter_place(h: Column) -> tuple[Column, Column]:
    """(word, bit) of a 64-bit hash in a filter table."""
    bit = F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")
    return F.pmod(h, F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def filter_table(hashes: DataFrame, name: str) -> DataFrame:
    """A one-hash Bloom filter of the column ``name`` (64-bit hashes) as a table of
    at most FILTER_WORDS rows, whatever the number of hashes: safe to broadcast."""
    word, bit = _filter_place(F.col(name))
    return hashes.where(F.col(name).isNotNull()).groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def maybe_in(rows: DataFrame, h: Column, table: DataFrame, outside: bool = False) -> DataFrame:
    """The rows whose hash may be in a ``filter_table`` (or those that surely are
    not).  The more hashes it holds, the less it holds back; what follows decides."""
    word, bit = _filter_place(h)
    hit = rows.join(F.broadcast(table), word == F.col("_word"), "left").withColumn("_hit", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)))
    return hit.where(~F.col("_hit") if outside else F.col("_hit")).drop("_word", "_bits", "_hit")


class Scratch:
    """Intermediate tables, written as Parquet to the shared folder and read again.

    Cutting the lineage this way survives the loss of executors: a later stage
    re-reads files instead of recomputing, and nothing lives in one executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/fluxgate-{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Remove a table that no unevaluated DataFrame still reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def aside(df: DataFrame, *own: str, new: tuple[str, ...] = ()) -> tuple[DataFrame, list[Column]]:
    """``df`` with all columns but ``own`` under private names, so that they can't clash
    with an operator's, and the columns that give them back under their own names.
    Columns that bear one of the ``new`` names are left out of these."""
    names = df.columns
    private = [c if c in own else f"_aside{i}" for i, c in enumerate(names)]
    return df.toDF(*private), [F.col(p).alias(c) for p, c in zip(private, names, strict=True) if c.lower() not in new]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; lower() would change other letters too."""
    return F.translate(c, UPPER, LOWER)


def squash_white(c: Column) -> Column:
    """Each white-space character becomes one space."""
    return F.translate(c, WHITE[1:], " " * (len(WHITE) - 1))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-white characters; 0 for null."""
    padded = squash_white(F.coalesce(text, F.lit("")))
    return F.size(F.array_remove(F.split(padded, " "), "")).cast("long")


def unit_interval(*cols: Column) -> Column:
    """A uniform number in (0, 1) from md5: the same on every run and engine."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
