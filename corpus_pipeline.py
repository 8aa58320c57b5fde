"""The corpus pipeline over ``documents``.  Each stage calls one training-data
operator on all that its predecessor kept; a stage's result is written as Parquet
and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxgate.llm.common import Scratch, aside, table
from fluxgate.llm.line_dedup import dedup_lines
from fluxgate.llm.mixing import mix_sources
from fluxgate.llm.ngram_join import without_near_copies
from fluxgate.llm.packing import pack
from fluxgate.llm.quality_cnn import quality_scores

#: The columns that the stages use; all others pass under private names meanwhile.
OWN = ("doc_id", "text", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    rest, back = aside(docs, *OWN)
    return quality_scores(rest, table(spark, sf_dir, "labels")).where("predicted = 1").select(*back)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that at least three documents share, but for one of them."""
    rest, back = aside(docs, *OWN)
    out = dedup_lines(rest).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*back)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents (five words, 0.8), one stays: that of the
    smallest doc_id."""
    rest, back = aside(docs, *OWN)
    return without_near_copies(rest).select(*back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it, or not at all."""
    rest, back = aside(docs, *OWN)
    out = mix_sources(rest).where("copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).select(*back)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its place in a sequence."""
    return pack(docs)


STAGES = [
    ("quality", keep_good),
    ("line_dedup", drop_common_lines),
    ("near_copies", keep_one_of_near_copies),
    ("mix", mix),
    ("pack", pack_sequences),
]

#: The classifier and the packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
