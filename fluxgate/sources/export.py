"""Text exports: CSV, column-oriented JSON, and metadata skeletons."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import csv_line, to_yaml
from ..functions.time import iso


def export_columns(series: DataFrame, ns: str | None, values: str, labels: Sequence[str], rec: str = "rec") -> DataFrame:
    """(rec, time, one column per component): what a plot of a variable shows.  The
    time is ISO text; without one, the record number."""
    time = iso(F.col(ns)) if ns else F.col(rec).cast("string")
    return series.select(rec, time.alias("time"), *[F.get(F.col(values), i).alias(n) for i, n in enumerate(labels)])


def csv_lines(df: DataFrame, order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(order, line): the lines of a CSV text, without its header."""
    columns = columns or [c for c in df.columns if c != order]
    return df.select(order, csv_line([F.col(c) for c in columns]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a header, one per partition."""
    df.write.option("header", True).csv(path, lineSep="\n", quote='"', escape='"')


def columns_json(df: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """(json): one object with an array per column, in the order of ``order``.  All
    values meet in one row, so this is for what is small enough to show; larger
    results go through ``write_csv`` or JSON lines."""
    rows = F.array_sort(F.collect_list(F.struct(order, F.struct(*columns).alias("_r"))))
    one = df.agg(rows.alias("r"))
    lists = [F.col(f"r._r.{c}").alias(c) for c in columns]
    return one.select(F.to_json(F.struct(*lists), {"ignoreNullFields": "false"}).alias("json"))


def json_lines(df: DataFrame) -> Column:
    return F.to_json(F.struct(*df.columns))


def skeleton_yaml(skeleton: str) -> str:
    """A file's JSON skeleton, see ``catalog.skeleton``, as YAML."""
    return to_yaml(json.loads(skeleton))
