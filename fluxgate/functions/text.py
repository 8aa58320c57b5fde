"""Text repair, padding, canonical texts and search as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .yaml import to_yaml as to_yaml

VAR_GROUPS = ("data", "support_data", "metadata")


def is_utf8(raw: Column) -> Column:
    return F.is_valid_utf8(raw)


def repair_latin1(raw: Column) -> Column:
    """Bytes to text: as UTF-8 if they are valid, else as Latin-1."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def unpad(s: Column) -> Column:
    """Without trailing NULs, then without trailing white space."""
    return F.regexp_replace(F.rtrim(s, F.lit("\0")), r"\s+$", "")


def pad(s: Column, width: int | Column) -> Column:
    """UTF-8 bytes, NUL-padded to ``width`` bytes; longer text is an error."""
    width = F.lit(width) if isinstance(width, int) else width
    raw = F.encode(s, "UTF-8")
    fits = F.when(F.octet_length(raw) > width, F.raise_error(F.lit("string longer than its variable"))).otherwise(F.lit(True))
    return F.when(fits, F.rpad(raw, width, F.lit(b"\0")))


def split_fixed(s: Column, width: int) -> Column:
    """Fixed-width slices of a text, each unpadded."""
    n = F.call_function("div", F.length(s), F.lit(width)).cast("int")
    return F.when(n <= 0, F.slice(F.array(s), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: unpad(F.substring(s, i * width + 1, F.lit(width)))))


def labels(s: Column, count: int) -> Column:
    """``count`` slices of equal length, without NULs and white space at their ends."""
    n = F.call_function("div", F.length(s), F.lit(count)).cast("int")
    one = lambda i: F.trim(F.rtrim(F.substring(s, i * n + 1, n), F.lit("\0")))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(count - 1)), one))


def value_text(v_str: Column, v_long: Column, v_double: Column) -> Column:
    """Canonical text of an attribute value: a string trimmed, numbers joined."""
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ", ")
    return F.coalesce(F.trim(v_str), join(v_long), join(v_double), F.lit(""))


def numeric_attribute(v_str: Column, v_long: Column, v_double: Column) -> Column:
    """First number of an attribute, or its text as a number; null if it is none."""
    number = F.coalesce(F.get(v_double, 0), F.get(v_long, 0).cast("double"), F.trim(v_str).try_cast("double"))
    return F.when(~F.isnan(number), number)


def var_group(var_type: Column) -> Column:
    """data, support_data or metadata; data for anything else."""
    v = F.lower(F.trim(var_type))
    return F.when(v.isin(*VAR_GROUPS), v).otherwise("data")


def scale_type(v: Column, fallback: str) -> Column:
    s = F.lower(F.trim(v))
    return F.when(s.isin("log", "linear"), s).otherwise(fallback)


def csv_cell(v: Column) -> Column:
    """One cell of a CSV line: quoted if it holds a quote, comma or line end."""
    s = F.coalesce(v.cast("string"), F.lit(""))
    return F.when(s.rlike("[\",\n\r]"), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def csv_line(columns: Sequence[Column]) -> Column:
    return F.concat_ws(",", *[csv_cell(c) for c in columns])
