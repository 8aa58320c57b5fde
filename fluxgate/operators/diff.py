"""Structural comparison of two files' metadata by full outer joins.

Models are (variables, attributes, globals): variables (name, shape, type_name,
is_nrv, grp), attributes (name, attr, text), globals (attr, entry_index, text)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATUSES = ("changed", "added", "removed", "same")
SECTIONS = ("global", "data", "support_data", "metadata")


class Model(NamedTuple):
    variables: DataFrame
    attributes: DataFrame
    globals: DataFrame


def _sides(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join with the columns of either side as structs a and b."""
    left, right = (d.select(*keys, F.struct(*[c for c in d.columns if c not in keys], F.lit(1).alias("_in")).alias(n)) for d, n in ((a, "a"), (b, "b")))
    return left.join(right, keys, "full")


def _presence(same: Column) -> Column:
    return F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(same, "same").otherwise("changed")


def field_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, field, status, a, b) for differing shape, type and isNrv."""
    both = _sides(a, b, ["name"]).where("a is not null and b is not null")
    text = lambda s: {"shape": F.array_join(F.transform(s["shape"], lambda x: x.cast("string")), ", "), "type": s["type_name"], "isNrv": F.coalesce(s["is_nrv"], F.lit(False)).cast("string")}
    one, two = text(F.col("a")), text(F.col("b"))
    rows = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f).alias("field"), one[f].alias("a"), two[f].alias("b")) for i, f in enumerate(one)])
    out = both.select("name", F.explode(rows).alias("r")).where(~F.col("r.a").eqNullSafe(F.col("r.b")))
    return out.select("name", F.col("r.ord").alias("ord"), F.col("r.field").alias("field"), F.lit("changed").alias("status"), F.col("r.a").alias("a"), F.col("r.b").alias("b"))


def attribute_diff(a: Model, b: Model) -> DataFrame:
    """(name, attr, status, a, b) for variables of both files; equal ones left out."""
    both = a.variables.select("name").join(b.variables.select("name"), "name")
    d = _sides(a.attributes, b.attributes, ["name", "attr"]).withColumn("status", _presence(F.col("a.text").eqNullSafe(F.col("b.text"))))
    d = d.where("status <> 'same'").join(both, "name", "left_semi")
    return d.select("name", "attr", "status", F.col("a.text").alias("a"), F.col("b.text").alias("b"))


def variable_diff(a: Model, b: Model) -> DataFrame:
    """(name, grp, status) for each variable: changed if a field or attribute is; the
    group is that of the second file, else of the first."""
    changed = field_diff(a.variables, b.variables).select("name").union(attribute_diff(a, b).select("name")).distinct().withColumn("_changed", F.lit(True))
    d = _sides(a.variables, b.variables, ["name"]).join(changed, "name", "left")
    return d.select("name", F.coalesce("b.grp", "a.grp").alias("grp"), _presence(F.col("_changed").isNull()).alias("status"))


def global_entry_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(attr, entry_index, status, a, b), aligned by index; equal ones left out."""
    d = _sides(a, b, ["attr", "entry_index"]).withColumn("status", _presence(F.col("a.text").eqNullSafe(F.col("b.text"))))
    return d.where("status <> 'same'").select("attr", "entry_index", "status", F.col("a.text").alias("a"), F.col("b.text").alias("b"))


def global_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(attr, status) for each global attribute."""
    names = lambda d: d.select("attr").distinct()
    changed = global_entry_diff(a, b).select("attr").distinct().withColumn("_changed", F.lit(True))
    d = _sides(names(a), names(b), ["attr"]).join(changed, "attr", "left")
    return d.select("attr", _presence(F.col("_changed").isNull()).alias("status"))


def rank(status: Column) -> Column:
    """Order of statuses: changed, added, removed, same."""
    return F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status)


def diff_summary(a: Model, b: Model) -> DataFrame:
    """(status, n) over variables and global attributes, but for equal ones."""
    every = variable_diff(a, b).select("status").unionAll(global_diff(a.globals, b.globals).select("status"))
    return every.where("status <> 'same'").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def diff_lines(a: Model, b: Model, include_same: bool = False) -> DataFrame:
    """(section, item, kind, detail, status, a, b) lines: for each section with items a
    section line, an item line for each variable or global attribute, and its details.
    ``ordered`` puts them in reading order."""
    null = lambda: F.lit(None).cast("string")
    keep = F.lit(True) if include_same else F.col("status") != "same"
    items = variable_diff(a, b).select(F.col("grp").alias("section"), F.col("name").alias("item"), "status").unionByName(global_diff(a.globals, b.globals).select(F.lit("global").alias("section"), F.col("attr").alias("item"), "status")).where(keep)
    sections = items.select("section").distinct().select("section", null().alias("item"), F.lit("section").alias("kind"), null().alias("detail"), null().alias("status"), null().alias("a"), null().alias("b"), F.lit(0).alias("ord"))
    heads = items.select("section", "item", F.lit("item").alias("kind"), null().alias("detail"), "status", null().alias("a"), null().alias("b"), F.lit(0).alias("ord"))
    where = variable_diff(a, b).select("name", F.col("grp").alias("section"))
    fields = field_diff(a.variables, b.variables).select("name", F.col("field").alias("detail"), "status", "a", "b", (F.col("ord") + 1).alias("ord"))
    attrs = attribute_diff(a, b).select("name", F.col("attr").alias("detail"), "status", "a", "b", F.lit(10).alias("ord"))
    own = fields.unionByName(attrs).join(where, "name").select("section", F.col("name").alias("item"), F.lit("detail").alias("kind"), "detail", "status", "a", "b", "ord")
    entries = global_entry_diff(a.globals, b.globals).select(F.lit("global").alias("section"), F.col("attr").alias("item"), F.lit("detail").alias("kind"), F.concat(F.lit("["), F.col("entry_index").cast("string"), F.lit("]")).alias("detail"), "status", "a", "b", (F.col("entry_index") + 1).cast("int").alias("ord"))
    return sections.unionByName(heads).unionByName(own).unionByName(entries)


def ordered(lines: DataFrame) -> DataFrame:
    """Diff lines in reading order: sections, then items by status and name."""
    return _ranked(lines).orderBy(*map(F.expr, _READING)).drop("_rank")


def numbered(lines: DataFrame) -> DataFrame:
    """Diff lines with their place in reading order, ``line``, from 0.  A diff of two
    files' metadata is small: the number is counted in one task."""
    out = _ranked(lines).withColumn("line", (F.row_number().over(Window.orderBy(*map(F.expr, _READING))) - 1).cast("bigint"))
    return out.drop("_rank")


def _ranked(lines: DataFrame) -> DataFrame:
    heads = lines.where("kind = 'item'").select("section", "item", rank(F.col("status")).alias("_rank"))
    return lines.join(heads, ["section", "item"], "left").withColumn("_rank", F.coalesce("_rank", F.lit(0)))


#: Columns of reading order: sections, statuses, names, an item before its details.
_READING = [f"array_position(array({', '.join(repr(s) for s in SECTIONS)}), section)", "_rank", "coalesce(item, '')", "kind <> 'item'", "ord", "detail"]
