"""Reductions for display: decimation, strides, block maxima and ranges.

Inputs carry a record number from 0 without gaps, as CDF records do.  Masked
values are null, and only null: see ``masking.quality_mask``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.time import int_div

MAX_POINTS = 8000


def bucket_of(rec: Column, n: Column, columns: int) -> Column:
    """The bucket c whose range [floor(c * b), floor((c + 1) * b)), b = n / columns in
    doubles, holds a record: the integer candidate, corrected by one where the
    double product rounds across a record."""
    b = n.cast("double") / F.lit(float(columns))
    c = F.call_function("div", (rec + 1) * F.lit(columns) - 1, n)
    return c - (F.floor(c * b) > rec).cast("int") + (F.floor((c + 1) * b) <= rec).cast("int")


def decimate_minmax(df: DataFrame, columns: int, keys: Sequence[str] = (), rec: str = "rec", x: str = "x", y: str = "y") -> DataFrame:
    """(keys, rec, x, y): the first minimum and first maximum of each of ``columns``
    buckets, in record order, once if they are one record.  A bucket without values
    gives its first x and a null y.  A series of at most 2 * columns records passes.

    Two aggregations with map-side partials: the count per series, and the extremes
    per bucket.  The counts join as one small row per series."""
    keys = list(keys)
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    at = df.join(n, keys) if keys else df.crossJoin(n)  # without keys, n is one row
    passes = F.lit(columns <= 0) | (F.col("_n") <= 2 * columns)
    at = at.withColumn("_b", F.when(passes, F.col(rec)).otherwise(bucket_of(F.col(rec), F.col("_n"), max(1, columns))))
    point = F.struct(F.col(rec), F.col(x), F.col(y))
    value = F.col(y)
    ends = at.groupBy(*keys, "_b").agg(
        F.min_by(point, F.when(value.isNotNull(), F.struct(value, F.col(rec)))).alias("lo"),
        F.max_by(point, F.when(value.isNotNull(), F.struct(value, -F.col(rec)))).alias("hi"),
        F.min_by(point, F.col(rec)).alias("first"),
    )
    points = F.when(F.col("lo").isNull(), F.array("first")).otherwise(F.array_sort(F.array_distinct(F.array("lo", "hi"))))
    out = ends.select(*keys, F.explode(points).alias("p"))
    return out.select(*keys, F.col(f"p.{rec}").alias(rec), F.col(f"p.{x}").alias(x), F.col(f"p.{y}").alias(y))


def stride_of(n: int, most: int = MAX_POINTS) -> int:
    return max(1, -(-n // most))


def stride_sample(df: DataFrame, step: int, rec: str = "rec") -> DataFrame:
    """Every step-th record: a filter, pushed to the scan."""
    return df.where(F.col(rec) % F.lit(step) == 0)


def block_max(df: DataFrame, step: int, bin_: str = "bin", rec: str = "rec", value: str = "v") -> DataFrame:
    """(block, bin, value): the maximum over ``step`` records for each bin, null if all are."""
    return df.groupBy(int_div(F.col(rec), step).alias("block"), bin_).agg(F.max(value).alias(value))


def block_centers(df: DataFrame, step: int, rec: str = "rec", x: str = "x") -> DataFrame:
    """(block, center): midpoint of the first and last x of each block."""
    return df.groupBy(int_div(F.col(rec), step).alias("block")).agg(((F.min_by(x, rec) + F.max_by(x, rec)) / 2).alias("center"))


def color_range(df: DataFrame, value: str = "v", log: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, low, high) over all values, positive ones if ``log``; no row where
    there is nothing to show, that is no value or only one."""
    own = df.where(F.col(value).isNotNull())
    own = own.where(F.col(value) > 0) if log else own
    return own.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low is not null and low < high")


def preview(df: DataFrame, rec: str = "rec", n: int = 20) -> DataFrame:
    """The first ``n`` records in order, a top-k and no total sort."""
    return df.orderBy(rec).limit(n)
