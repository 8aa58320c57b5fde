"""Shapes and flat row-major arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total_elements(shape: Column) -> Column:
    """Product of all dimensions; 0 for an absent or empty shape."""
    return F.when(F.coalesce(F.size(shape), F.lit(0)) <= 0, F.lit(0).cast("bigint")).otherwise(F.aggregate(shape, F.lit(1).cast("bigint"), lambda a, b: a * b))


def record_length(shape: Column) -> Column:
    """Product of the dimensions behind the first; 1 where there are none."""
    return F.when(F.coalesce(F.size(shape), F.lit(0)) <= 1, F.lit(1).cast("bigint")).otherwise(F.aggregate(F.slice(shape, F.lit(2), F.size(shape) - 1), F.lit(1).cast("bigint"), lambda a, b: a * b))


def inverted_flat_index(index: Column, shape: Column) -> Column:
    """Position of an index with the last dimension fastest (row-major); 0 outside 2
    to 10 dimensions."""
    pairs = F.zip_with(index, shape, lambda i, n: F.struct(i.cast("bigint").alias("i"), n.cast("bigint").alias("n")))
    return F.when(F.size(shape).between(2, 10), F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, p: a * p["n"] + p["i"])).otherwise(F.lit(0).cast("bigint"))


def flat_index(index: Column, shape: Column) -> Column:
    """Position of an index with the first dimension fastest (column-major); 0
    outside 2 to 10 dimensions."""
    return inverted_flat_index(F.reverse(index), F.reverse(shape))


def to_row_major(values: Column, shape: tuple[int, ...]) -> Column:
    """One record, stored column-major in a flat array, in row-major order.  The
    record shape is known per variable, so the order is a constant of the plan."""
    if len(shape) < 2:
        return values
    strides, step = [], 1
    for n in shape:
        strides.append(step)
        step *= n
    pick = F.lit(0)
    rest = lambda k: F.call_function("div", k, F.lit(1))

    def source(k: Column) -> Column:
        out, left = pick, rest(k)
        for n, stride in zip(reversed(shape), reversed(strides), strict=True):
            out = out + F.pmod(left, F.lit(n)) * F.lit(stride)
            left = F.call_function("div", left, F.lit(n))
        return out

    return F.transform(F.sequence(F.lit(0), F.lit(step - 1)), lambda k: F.get(values, source(k).cast("int")))


def component(values: Column, c: int | Column) -> Column:
    """Component c, from 0, of a record; null beyond its end."""
    return F.get(values, c if isinstance(c, Column) else F.lit(c))


def chunk_records(values: Column, length: int) -> Column:
    """A flat array as an array of records; a ragged end stays, and all is one
    record for a length that is not positive."""
    if length <= 0:
        return F.array(values)
    n = F.call_function("div", F.size(values) + (length - 1), F.lit(length)).cast("int")
    return F.when(F.size(values) == 0, F.slice(F.array(values), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(values, i * length + 1, F.lit(length))))


def is_monotonic(values: Column) -> Column:
    """Whether an array strictly rises or strictly falls; true below two values."""
    rest = F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))
    steps = lambda up: F.forall(F.zip_with(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), rest, lambda a, b: F.coalesce(b > a if up else b < a, F.lit(False))), lambda x: x)
    return (F.size(values) < 2) | steps(True) | steps(False)


def cell_edges(centers: Column, log: bool = False) -> Column:
    """n centers to n + 1 edges: midpoints (geometric if ``log``), ends extrapolated.
    Beside a center of zero a geometric end is infinite or NaN, as in IEEE division,
    which Spark refuses."""
    n = F.size(centers)
    at = lambda i: F.get(centers, i)
    mid = (lambda a, b: F.sqrt(a * b)) if log else (lambda a, b: (a + b) / 2)
    inner = F.transform(F.sequence(F.lit(1), n - 1), lambda i: mid(at(i - 1), at(i)))
    root = F.lit(2.0**0.5)
    one = F.array(at(F.lit(0)) / root, at(F.lit(0)) * root) if log else F.array(at(F.lit(0)) - 0.5, at(F.lit(0)) + 0.5)
    first, last = mid(at(F.lit(0)), at(F.lit(1))), mid(at(n - 2), at(n - 1))
    ratio = lambda a, b: F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)
    beyond = (lambda c, e: ratio(c * c, e)) if log else (lambda c, e: 2 * c - e)
    many = F.concat(F.array(beyond(at(F.lit(0)), first)), inner, F.array(beyond(at(n - 1), last)))
    return F.when(n == 0, F.slice(one, 1, 0)).when(n == 1, one).otherwise(many)
