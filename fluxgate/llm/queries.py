"""The contract queries of the training-data operators, and their DuckDB twins.

Each ``opN_<name>`` runs its operator on its whole table and derives the columns
of the query's contract from the operator's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .oracles import ORACLES  # noqa: F401


def op1_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).drop("component")


def op2_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kd_shards import kd_shards

    out = kd_shards(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bit_sliced import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op4_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii_crf import KINDS, find_pii

    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op5_large_item_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), capacity=1024, vocabulary="byte_bpe_50k.json", end_id=2)


def op6_levelled_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_cnn import fold, quality_scores

    out = quality_scores(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge_quality

    out = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_components

    return ngram_jaccard_components(table(spark, sf_dir, "documents"), n=3, percent=90)


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import apply_plan, measured, mix_plan

    scratch = Scratch(spark, "mix")
    small = scratch.keep(measured(table(spark, sf_dir, "documents")), "small")
    out = apply_plan(small, mix_plan(small, scratch))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_redirect_url_filter, op2_kd_tree_shards, op3_bit_sliced_top_k, op4_crf_pii, op5_large_item_packing, op6_levelled_line_dedup, op7_byte_cnn_quality, op8_quality_rules, op9_parity_sketch_join, op10_pareto_mix)}

