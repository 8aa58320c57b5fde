"""Queries on time encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import time as t
from ..types import TYPES
from .registry import query, table

_NS = "(epoch_us(ts) * 1000)"
_LEAP = "case " + " ".join(f"when {{x}} >= {b} then {o}" for b, o in reversed(t.LEAPS)) + " else 0 end"
_LEAP_TT = "case " + " ".join(f"when {{x}} >= {b} then {o}" for b, o in reversed(t.TT2000_LEAPS)) + " else 0 end"


def tt_sql(ns: str) -> str:
    return f"({ns} - {t.TT2000_NS} + {_LEAP.format(x=ns)})"


def ns_sql(tt: str) -> str:
    return f"({tt} - {_LEAP_TT.format(x=tt)} + {t.TT2000_NS})"


def ns_of(column: str) -> Column:
    return t.timestamp_to_ns(F.col(column))


_ORDER_NS = "(epoch_us(o_orderdate) * 1000)"
_SHIP_NS = "(epoch_us(l_shipdate) * 1000)"


@query(f"""select {_LEAP.format(x=_ORDER_NS)} // 1000000000 as leap_s, count(*) as n, min({tt_sql(_ORDER_NS)}) as first_tt2000, max({tt_sql(_ORDER_NS)}) as last_tt2000,
  count(*) filter ({ns_sql(tt_sql(_ORDER_NS))} <> {_ORDER_NS}) as mismatches from orders group by 1""")
def leap_offset_by_order(spark: SparkSession, d: str) -> DataFrame:
    ns = ns_of("o_orderdate")
    o = table(spark, d, "orders").select(t.leap_second(ns).alias("leap"), ns.alias("ns"), t.ns_to_tt2000(ns).alias("tt"))
    o = o.withColumn("back", t.tt2000_to_ns(F.col("tt")))
    return o.groupBy(t.int_div(F.col("leap"), t.SECOND).alias("leap_s")).agg(F.count(F.lit(1)).alias("n"), F.min("tt").alias("first_tt2000"), F.max("tt").alias("last_tt2000"), F.count_if(F.col("back") != F.col("ns")).alias("mismatches"))


@query(f"select o_orderkey, {tt_sql(_ORDER_NS)} as tt2000 from orders")
def tt2000_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", t.ns_to_tt2000(ns_of("o_orderdate")).alias("tt2000"))


@query(f"select event_id, {ns_sql('(round(value * 100)::BIGINT * 10000000000000)')} as ns from events")
def tt2000_decode(spark: SparkSession, d: str) -> DataFrame:
    # cents times 1e13 reach from 2000 to 2015
    tt = F.round(F.col("value") * F.lit(100.0)).cast("bigint") * t.big(10_000_000_000_000)
    return table(spark, d, "events").select("event_id", t.tt2000_to_ns(tt).alias("ns"))


@query(f"select count(*) as n, count(*) filter ({ns_sql(tt_sql(_SHIP_NS))} <> {_SHIP_NS}) as mismatches from lineitem")
def tt2000_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    ns = ns_of("l_shipdate")
    return table(spark, d, "lineitem").select(ns.alias("ns"), t.tt2000_to_ns(t.ns_to_tt2000(ns)).alias("back")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ns") != F.col("back")).alias("mismatches"))


@query(f"select event_id, ({_NS} // 1000000)::DOUBLE + 62167219200000.0 as epoch from events")
def epoch_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", t.ns_to_epoch(ns_of("ts")).alias("epoch"))


_MS = "(epoch_us(ts)::DOUBLE / 1000.0 + 62167219200000.0)"


def _epoch_with_fraction() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / F.lit(1000.0) + F.lit(t.EPOCH_MS)


@query(f"select event_id, trunc(({_MS} - 62167219200000.0) * 1e6)::BIGINT as ns from events")
def epoch_decode_bulk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", t.epoch_to_ns(_epoch_with_fraction()).alias("ns"))


@query(f"select event_id, trunc({_MS} - 62167219200000.0)::BIGINT * 1000000 + trunc((({_MS} - 62167219200000.0) - trunc({_MS} - 62167219200000.0)) * 1e6)::BIGINT as ns from events")
def epoch_decode_exact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", t.epoch_to_ns_exact(_epoch_with_fraction()).alias("ns"))


@query(f"select event_id, ({_NS} // 1000000000)::DOUBLE + 62167219200.0 as seconds, ({_NS} - ({_NS} // 1000000000) * 1000000000)::DOUBLE * 1000.0 as picoseconds from events")
def epoch16_encode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", t.ns_to_epoch16(ns_of("ts")).alias("e")).select("event_id", "e.seconds", "e.picoseconds")


@query(f"""select event_id, trunc((s - 62167219200.0) * 1e9 + ps / 1e3)::BIGINT as bulk_ns, trunc(s - 62167219200.0)::BIGINT * 1000000000 + trunc(ps / 1e3)::BIGINT as exact_ns
  from (select event_id, ({_NS} // 1000000000)::DOUBLE + 62167219200.0 as s, ({_NS} - ({_NS} // 1000000000) * 1000000000)::DOUBLE * 1000.0 as ps from events)""")
def epoch16_decode(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", t.ns_to_epoch16(ns_of("ts")).alias("e"))
    return e.select("event_id", t.epoch16_to_ns(F.col("e")).alias("bulk_ns"), t.epoch16_to_ns_exact(F.col("e")).alias("exact_ns"))


@query(f"select event_id, {tt_sql(f'trunc(({_MS} - 62167219200000.0) * 1e6)::BIGINT')} as tt2000 from events")
def cdf_time_convert(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", t.convert(_epoch_with_fraction(), "CDF_EPOCH", "CDF_TIME_TT2000").alias("tt2000"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' as iso from events")
def time_string_iso(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", t.iso(ns_of("ts")).alias("iso"))


@query("select o_orderkey, strftime(o_orderdate, '%Y-%jT%H:%M:%S.%f') || '000 100%' as doy from orders")
def time_string_doy(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", t.to_time_string(ns_of("o_orderdate"), "%Y-%jT%H:%M:%S 100%%").alias("doy"))


@query("select event_id, epoch_us(ts) as micros from events")
def ns_to_datetime(spark: SparkSession, d: str) -> DataFrame:
    # 999 ns more are floored away again
    return table(spark, d, "events").select("event_id", F.unix_micros(t.ns_to_timestamp(ns_of("ts") + 999)).alias("micros"))


@query("""select 'epoch' as kind, '9999-12-31T23:59:59.999' as fill, '0000-01-01T00:00:00.000' as pad, count(*) as n, min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000') as first from events
  union all select 'epoch16', '9999-12-31T23:59:59.999999999', '0000-01-01T00:00:00.000000000000', count(*), min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000') from events
  union all select 'tt2000', '9999-12-31T23:59:59.999999999', '0000-01-01T00:00:00.000000000', count(*), min(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000') from events""")
def sentinel_repr(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(ns_of("ts").alias("ns"))
    out = None
    pair = lambda v: F.struct(F.lit(v).alias("seconds"), F.lit(v).alias("picoseconds"))
    exact16 = t.ns_to_epoch16(F.col("ns"))
    for kind, name, fill, pad, x in (
        ("epoch", "CDF_EPOCH", F.lit(-1e31), F.lit(0.0), None),
        ("epoch16", "CDF_EPOCH16", pair(-1e31), pair(0.0), exact16),
        ("tt2000", "CDF_TIME_TT2000", t.big(-(1 << 63)), t.big(-(1 << 63) + 1), t.ns_to_tt2000(F.col("ns"))),
    ):
        # an EPOCH of whole milliseconds loses digits, so its first is taken from the exact time
        first = t.to_time_string(F.col("ns"), "%Y-%m-%dT%H:%M:%S") if x is None else t.time_repr(x, name)
        one = e.select(F.lit(kind).alias("kind"), t.time_repr(fill, name).alias("fill"), t.time_repr(pad, name).alias("pad"), first.alias("r"))
        one = one.groupBy("kind", "fill", "pad").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("first"))
        out = one if out is None else out.unionByName(one)
    return out


_PLAIN = [t for t in TYPES.values() if isinstance(t.fill, (int, float))]


@query("select * from (values " + ", ".join(f"('{x.name}', {x.code}, {x.size}, {float(x.pad)!r}::DOUBLE, {float(x.fill)!r}::DOUBLE)" for x in _PLAIN) + ") t(name, code, size, pad, fill)")
def fill_pad_constants(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x.name, x.code, x.size, float(x.pad), float(x.fill)) for x in _PLAIN], "name string, code int, size int, pad double, fill double")
