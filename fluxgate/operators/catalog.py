"""Catalog operators over the metadata tables.

cdf_variables(file_id, ord, name, num, cdf_type, shape, is_nrv, ...),
cdf_variable_attrs(file_id, variable, attr, cdf_type, v_str, v_long, v_double),
cdf_global_attrs(file_id, ord, attr, entry_index, cdf_type, v_str, v_long, v_double)."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import value_text

Criterion = Sequence[str] | str | re.Pattern | Callable[[Column], Column] | None


def matches(name: Column, criterion: Criterion) -> Column:
    """The predicate of a criterion on names: a list, a regular expression that must
    match at the start, or a function of the name's Column; None keeps nothing."""
    if criterion is None:
        return F.lit(False)
    if isinstance(criterion, (list, tuple)):
        return name.isin(*criterion) if criterion else F.lit(False)
    if isinstance(criterion, re.Pattern):
        flags = "".join(f for f, bit in (("i", re.I), ("m", re.M), ("s", re.S)) if criterion.flags & bit)
        return name.rlike((f"(?{flags})" if flags else "") + rf"\A(?:{criterion.pattern})")
    if isinstance(criterion, str):
        return name.rlike(rf"\A(?:{criterion})")
    if callable(criterion):
        return criterion(name)
    raise TypeError(f"unsupported criterion: {type(criterion)}")


def filter_variables(variables: DataFrame, criterion: Criterion, name: str = "name") -> DataFrame:
    return variables.where(matches(F.col(name), criterion))


def filter_attributes(attributes: DataFrame, criterion: Criterion, name: str = "attr") -> DataFrame:
    return attributes.where(matches(F.col(name), criterion))


def lookup(table: DataFrame, value: str, name: str = "name") -> DataFrame:
    """The rows of one name; a KeyError if there is none."""
    got = table.where(F.col(name) == value)
    if got.isEmpty():
        raise KeyError(value)
    return got


def remove(table: DataFrame, value: str, name: str = "name") -> DataFrame:
    """The table without one name; a KeyError if it has none."""
    lookup(table, value, name)
    return table.where(F.col(name) != value)


def search_variables(variables: DataFrame, attributes: DataFrame, query: str) -> DataFrame:
    """Variables whose name, attribute names or values hold the query as a substring,
    whatever the case; all for a blank query."""
    q = query.strip().lower()
    if not q:
        return variables
    text = F.concat_ws("\n", "attr", value_text(F.col("v_str"), F.col("v_long"), F.col("v_double")))
    found = attributes.where(F.lower(text).contains(q)).select("file_id", F.col("variable").alias("name")).distinct().withColumn("_hit", F.lit(True))
    return variables.join(found, ["file_id", "name"], "left").where(F.col("_hit") | F.lower("name").contains(q)).drop("_hit")


def search_globals(attributes: DataFrame, query: str) -> DataFrame:
    """Global attributes (all their entries) of which the name or an entry holds the query."""
    q = query.strip().lower()
    if not q:
        return attributes
    text = F.concat_ws("\n", "attr", value_text(F.col("v_str"), F.col("v_long"), F.col("v_double")))
    hits = attributes.where(F.lower(text).contains(q)).select("file_id", "attr").distinct()
    return attributes.join(hits, ["file_id", "attr"], "left_semi")


def contiguity(blocks: DataFrame, keys: Sequence[str] = ("file_id", "variable")) -> DataFrame:
    """(keys, n_blocks, is_contiguous) from a block index, one row per block."""
    n = F.count("offset")
    return blocks.groupBy(*keys).agg(n.alias("n_blocks"), (n <= 1).alias("is_contiguous"))


def _named(name: str, body: Column) -> Column:
    """A map from a group's names to bodies, by name; maps within can't be compared."""
    by_name = lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(name).alias("k"), body.alias("b"))), by_name))


def attribute_json(values: Column, types: Column) -> Column:
    return F.struct(values.alias("values"), types.alias("types"))


def skeleton(files: DataFrame, variables: DataFrame, variable_attrs: DataFrame, global_attrs: DataFrame) -> DataFrame:
    """(file_id, skeleton): a JSON text of each file's metadata, without values."""
    text = value_text(F.col("v_str"), F.col("v_long"), F.col("v_double"))
    ordered = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x["e"])
    g = global_attrs.groupBy("file_id", "attr").agg(ordered("entry_index", text.alias("e")).alias("v"), ordered("entry_index", F.col("cdf_type").alias("e")).alias("t"))
    g = g.groupBy("file_id").agg(_named("attr", attribute_json(F.col("v"), F.col("t"))).alias("attributes"))
    a = variable_attrs.groupBy("file_id", F.col("variable").alias("name")).agg(_named("attr", attribute_json(F.array(text), F.array("cdf_type"))).alias("attributes"))
    v = variables.join(a, ["file_id", "name"], "left").withColumn("body", F.struct("attributes", F.col("cdf_type").alias("type"), "shape", "compression", "is_nrv"))
    v = v.groupBy("file_id").agg(_named("name", F.col("body")).alias("variables"))
    out = files.join(g, "file_id", "left").join(v, "file_id", "left")
    return out.select("file_id", F.to_json(F.struct("compression", "attributes", "variables")).alias("skeleton"))
