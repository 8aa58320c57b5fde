import math

import pytest
from pyspark.sql import functions as F

from fluxgate.functions import time as t


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_leap_tables():
    assert len(t.LEAPS) == 28
    assert t.LEAPS[0] == (63072000000000000, 10 * t.SECOND)
    assert t.LEAPS[-1] == (1483228800000000000, 37 * t.SECOND)
    assert t.TT2000_LEAPS[0][0] == -883655957816000000


def test_literal_vectors(spark):
    got = one(spark, t.tt2000_to_ns(t.big(0)), t.tt2000_to_ns(t.big(631108869184000000)), t.iso(t.big(1700000000123456789)), t.iso(t.big(-1000000000)), t.iso(t.big(-1)))
    assert got == (946727935816000000, 1577836800000000000, "2023-11-14T22:13:20.123456789Z", "1969-12-31T23:59:59.000000000Z", "1969-12-31T23:59:59.999999999Z")


def test_epoch16_of_ns(spark):
    (e,) = one(spark, t.ns_to_epoch16(t.big(1700000000123456789)))
    assert (e.seconds, e.picoseconds) == (1700000000 + 62167219200, 123456789000)


def test_2015_leap_second_is_not_injective(spark):
    start = t.tt2000_of_ns(1435708798123456789)
    rows = spark.range(6).select(t.tt2000_to_ns(F.lit(start) + F.col("id") * t.SECOND).alias("ns")).collect()
    assert [r.ns // t.SECOND - 1435708790 for r in rows] == [8, 9, 10, 10, 11, 12]


def test_bulk_and_exact_epoch_differ(spark):
    ms = F.lit(1577836800001.0 + t.EPOCH_MS)
    bulk, exact = one(spark, t.epoch_to_ns(ms), t.epoch_to_ns_exact(ms))
    assert (bulk, exact) == (1577836800000999936, 1577836800001000000)


@pytest.mark.parametrize(("fmt", "want"), [("%Y-%jT%H:%M:%SZ", "2020-075T08:30:00.000000000Z"), ("%d/%m %%", "15/03 %"), ("plain", "plain")])
def test_formats(spark, fmt, want):
    assert one(spark, t.to_time_string(t.big(1584261000000000000), fmt)) == (want,)


def test_unknown_specifier():
    with pytest.raises(ValueError):
        t.to_time_string(F.lit(0), "%q")


def test_sentinels(spark):
    least = -(1 << 63)
    got = one(spark, *[t.time_repr(t.big(least + i), "CDF_TIME_TT2000") for i in (0, 1, 3)], t.time_repr(F.lit(-1e31), "CDF_EPOCH"), t.time_repr(F.lit(0.0), "CDF_EPOCH"))
    assert got == ("9999-12-31T23:59:59.999999999", "0000-01-01T00:00:00.000000000", "9999-12-31T23:59:59.999999999", "9999-12-31T23:59:59.999", "0000-01-01T00:00:00.000")


def test_overflow_and_null_are_null(spark):
    got = one(spark, t.epoch_to_ns(F.lit(-1e31)), t.epoch_to_ns(F.lit(math.nan)), t.tt2000_to_ns(F.lit(None).cast("bigint")), t.epoch_to_ns_exact(F.lit(-1e31)))
    assert got == (None,) * 4


def test_round_trips(spark):
    ns = F.lit(10**18) + F.col("id") * F.lit(10**16)
    rows = spark.range(10).select(ns.alias("ns"), t.tt2000_to_ns(t.ns_to_tt2000(ns)).alias("a"), t.epoch16_to_ns_exact(t.ns_to_epoch16(ns)).alias("b"), t.epoch_to_ns_exact(t.ns_to_epoch(ns)).alias("c")).collect()
    assert all(r.ns == r.a == r.b == r.c for r in rows)


def test_python_twins(spark):
    ns = [63072000 * t.SECOND - 1, 63072000 * t.SECOND, 1483228799 * t.SECOND, 1483228800 * t.SECOND, 0, -(10**18)]
    got = spark.createDataFrame([(x,) for x in ns], "ns long").select("ns", t.ns_to_tt2000(F.col("ns")).alias("tt")).collect()
    assert all(r.tt == t.tt2000_of_ns(r.ns) for r in got)
    assert all(t.ns_of_tt2000(t.tt2000_of_ns(x)) == x for x in ns)


def test_floor_division(spark):
    rows = spark.createDataFrame([(x,) for x in (-1500, -1000, -1, 0, 999, 1000)], "x long").select("x", t.floor_div(F.col("x"), 1000).alias("f"), t.int_div(F.col("x"), 1000).alias("t")).collect()
    assert [(r.f, r.t) for r in rows] == [(-2, -1), (-1, -1), (-1, 0), (0, 0), (0, 0), (1, 1)]


def test_one_codegen_stage(spark, capsys):
    spark.range(5).select(t.ns_to_tt2000(F.col("id"))).explain()
    assert "*(1) Project" in capsys.readouterr().out


def test_ends_of_the_range(spark):
    most = (1 << 63) - 1
    last = most - t.TT2000_NS + 37 * t.SECOND
    got = one(spark, *[t.tt2000_to_ns(t.big(x)) for x in (last, last + 1, -most - 1)], *[t.ns_to_tt2000(t.big(x)) for x in (most, t.TT2000_NS - most - 1, t.TT2000_NS - most - 2)])
    assert got == (most, None, -most - 1 + t.TT2000_NS, most - t.TT2000_NS + 37 * t.SECOND, -most - 1, None)
