"""Joins among variables, attributes, time axes, bin axes and labels.

Metadata tables hold one row per variable or attribute; Spark broadcasts them by
their statistics where they are small, and joins by sort and merge where not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import unix_seconds_to_ns

FILE_RECORD = ("file_id", "rec")


def join_attributes(variables: DataFrame, attributes: DataFrame, keys: Sequence[str] = ("file_id", "num")) -> DataFrame:
    """Variables with their attributes; variables without any stay.  Join on
    is_zvariable too where r- and z-variables share numbers."""
    return variables.join(attributes, list(keys), "left")


def align_records(data: DataFrame, axis: DataFrame, keys: Sequence[str] = FILE_RECORD) -> DataFrame:
    """Data beside its axis by record number: an equi-join by position, not by time."""
    return data.join(axis, list(keys), "left")


def align_constant(data: DataFrame, constant: DataFrame, key: str = "file_id") -> DataFrame:
    """Data beside a non-record-varying variable, which has one row per file."""
    return data.join(constant, key, "left")


def time_axis(data: DataFrame, depend0_ns: DataFrame | None = None, depend_time: DataFrame | None = None, depend0_number: DataFrame | None = None, keys: Sequence[str] = FILE_RECORD) -> DataFrame:
    """``data`` with x, is_time and axis_ns, from the first axis that there is:
    DEPEND_0 as a time (``ts_ns``), DEPEND_TIME in Unix seconds (``seconds``, exported
    in milliseconds), DEPEND_0 as a number (``number``), else the record number."""
    keys = list(keys)
    out = data
    for axis, name, kind in ((depend0_ns, "ts_ns", "bigint"), (depend_time, "seconds", "double"), (depend0_number, "number", "double")):
        out = out.join(axis.select(*keys, name), keys, "left") if axis is not None else out.withColumn(name, F.lit(None).cast(kind))
    ns = F.coalesce(F.col("ts_ns"), unix_seconds_to_ns(F.col("seconds")))
    x = F.coalesce(F.col("ts_ns") / F.lit(1e9), F.col("seconds"), F.col("number"), F.col(keys[-1]).cast("double"))
    return out.withColumns({"x": x, "axis_ns": ns, "is_time": ns.isNotNull()}).drop("ts_ns", "seconds", "number")


def strictly_monotonic(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """(keys, monotonic): whether a series strictly rises or falls; true below two values."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    steps = df.withColumn("_before", before).withColumn("_first", F.lag(F.lit(1)).over(Window.partitionBy(*keys).orderBy(order)).isNull())
    up, down = (F.bool_and(F.col("_first") | F.coalesce(t, F.lit(False))) for t in (F.col(value) > F.col("_before"), F.col(value) < F.col("_before")))
    return steps.groupBy(*keys).agg((up | down).alias("monotonic"))


def bin_axis(bins: DataFrame, rows: int, keys: Sequence[str], bin_: str = "bin", center: str = "center") -> DataFrame:
    """(keys, bin, center): the first ``rows`` values of DEPEND_1 where they are all
    there and strictly monotonic, else the bin number."""
    keys = list(keys)
    own = bins.where(F.col(bin_) < rows)
    good = strictly_monotonic(own, keys, bin_, center).join(own.groupBy(*keys).agg(F.count(center).alias("_n")), keys)
    out = own.join(good, keys)
    return out.select(*keys, bin_, F.when(F.col("monotonic") & (F.col("_n") == rows), F.col(center)).otherwise(F.col(bin_).cast("double")).alias(center))


def component_labels(components: DataFrame, pointer: DataFrame | None, depend1: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """``components`` (keys..., c) with label: from LABL_PTR_1 (``label``), else the
    value of DEPEND_1 (``center``), else ``comp c``."""
    keys = list(keys)
    out = components
    out = out.join(pointer.select(*keys, "label"), keys, "left") if pointer is not None else out.withColumn("label", F.lit(None).cast("string"))
    out = out.join(depend1.select(*keys, "center"), keys, "left") if depend1 is not None else out.withColumn("center", F.lit(None).cast("double"))
    return out.withColumn("label", F.coalesce("label", F.col("center").cast("string"), F.concat(F.lit("comp "), F.col(keys[-1]).cast("string")))).drop("center")


def clone_rows(into: DataFrame, rows: DataFrame, keys: Sequence[str] = ("file_id", "name")) -> DataFrame:
    """``into`` with ``rows`` of another file added; a name that exists is an error,
    raised when the result is read."""
    mark = into.select(*keys).distinct().withColumn("_there", F.lit(True))
    new = rows.join(mark, list(keys), "left")
    new = new.where(F.when(F.col("_there"), F.raise_error(F.lit("the name exists already")).cast("boolean")).otherwise(F.lit(True)))
    return into.unionByName(new.drop("_there"))
