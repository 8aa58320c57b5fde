"""Queries on masks, reductions, grids, arrays and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, levels, text
from ..operators import joins, masking, reduce
from ..sources import codec
from ..types import compatible_column, smallest_int_type_column
from .registry import query, table

_MASKED = "case when event_id % 10 = 0 or event_id % 7 = 0 or value < 5.0 or value > 450.0 then null else value end"


def _masked(spark: SparkSession, d: str) -> DataFrame:
    """events as records: value with fills and NaNs put in, then masked."""
    e = table(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    raw = F.when(F.col("event_id") % 10 == 0, F.lit(-1e31)).when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.withColumn("v", masking.quality_mask(raw, -1e31, 5.0, 450.0))


@query(f"select event_id, {_MASKED} as v from events")
def quality_mask(spark: SparkSession, d: str) -> DataFrame:
    return _masked(spark, d).select("event_id", "v")


@query(f"""with e as (select event_id, epoch_us(ts) as x, {_MASKED} as y, count(*) over () as n from events),
  c as (select *, ((event_id + 1) * 300 - 1) // n as c0, n::DOUBLE / 300.0 as b from e),
  k as (select *, c0 - (floor(c0 * b) > event_id)::INT + (floor((c0 + 1) * b) <= event_id)::INT as c from c),
  g as (select c, min(event_id) as f, arg_min(event_id, (y, event_id)) filter (y is not null) as lo, arg_max(event_id, (y, -event_id)) filter (y is not null) as hi from k group by c),
  p as (select distinct unnest(case when lo is null then [f] else [lo, hi] end) as rec from g)
  select k.event_id as rec, k.x, k.y from p join k on k.event_id = p.rec""")
def decimate_minmax(spark: SparkSession, d: str) -> DataFrame:
    e = _masked(spark, d).select(F.col("event_id").alias("rec"), F.unix_micros(F.col("ts").cast("timestamp")).alias("x"), F.col("v").alias("y"))
    return reduce.decimate_minmax(e, 300)


@query("select event_id, value from events where event_id % 3 = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return reduce.stride_sample(table(spark, d, "events").select("event_id", "value"), 3, "event_id")


@query(f"select event_id // 100 as block, user_id % 8 as bin, max({_MASKED}) as v from events group by 1, 2")
def grid_blockmax(spark: SparkSession, d: str) -> DataFrame:
    e = _masked(spark, d).select(F.col("event_id").alias("rec"), (F.col("user_id") % 8).alias("bin"), "v")
    return reduce.block_max(e, 100)


@query("select event_id // 100 as block, (arg_min(x, event_id) + arg_max(x, event_id)) / 2 as center from (select event_id, epoch_us(ts)::DOUBLE as x from events) group by 1")
def grid_centers(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("rec"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("x"))
    return reduce.block_centers(e, 100)


@query(f"select event_type, min(v) as low, max(v) as high from (select event_type, {_MASKED} as v from events) where v > 0 group by 1 having min(v) < max(v)")
def color_range(spark: SparkSession, d: str) -> DataFrame:
    return reduce.color_range(_masked(spark, d), "v", log=True, keys=["event_type"])


@query("""select event_id, round((value - 5.0) / 445.0, 9) as linear, case when value > 0 then round((log10(value) - log10(5.0)) / (log10(450.0) - log10(5.0)), 9) end as log,
  case when value - 100 > 0 then round((log10(value - 100) - log10(5.0)) / (log10(450.0) - log10(5.0)), 9) end as log_guarded from events""")
def level_normalize(spark: SparkSession, d: str) -> DataFrame:
    low, high, v = F.lit(5.0), F.lit(450.0), F.col("value")
    level = lambda x, log: F.round(levels.normalize_level(x, low, high, log), 9)
    return table(spark, d, "events").select("event_id", level(v, False).alias("linear"), level(v, True).alias("log"), level(v - 100, True).alias("log_guarded"))


_ANCHORS = [[a[c] for a in levels.VIRIDIS] for c in range(3)]
_CHANNEL = "floor({a}[i + 1] + ({a}[least(i + 1, 9) + 1] - {a}[i + 1]) * (x - i) + 0.5)::INT"


@query("select event_id, " + ", ".join(_CHANNEL.format(a=str([float(x) for x in a])) + f" as {n}" for a, n in zip(_ANCHORS, "rgb", strict=True)) + " from (select *, floor(x)::INT as i from (select event_id, least(1.0, greatest(0.0, value / 480.0 - 0.01)) * 9.0 as x from events))")
def viridis_rgb(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", levels.viridis(F.col("value") / F.lit(480.0) - F.lit(0.01)).alias("c"))
    return e.select("event_id", "c.r", "c.g", "c.b")


def _edges(log: bool) -> str:
    mid = "sqrt(v[i] * v[i + 1])" if log else "(v[i] + v[i + 1]) / 2"
    end = "{c} * {c} / {e}" if log else "2 * {c} - {e}"
    m = lambda i: mid.replace("[i + 1]", f"[{i} + 1]").replace("[i]", f"[{i}]")
    return f"""select user_id, case when len(v) = 1 then {'[v[1] / sqrt(2.0::DOUBLE), v[1] * sqrt(2.0::DOUBLE)]' if log else '[v[1] - 0.5, v[1] + 0.5]'}
      else list_concat(list_concat([{end.format(c='v[1]', e=f'({m(1)})')}], list_transform(range(1, len(v)), lambda i: {mid})), [{end.format(c='v[len(v)]', e=f'({m("len(v) - 1")})')}]) end as edges
      from (select user_id, list(value order by event_id) as v from events group by 1)"""


def _series(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    return e.select("user_id", F.col("s.value").alias("v"))


@query("select user_id, [round(x, 9) for x in edges] as edges from (" + _edges(False) + ")")
def cell_edges_linear(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).select("user_id", F.transform(arrays.cell_edges(F.col("v")), lambda x: F.round(x, 9)).alias("edges"))


@query("select user_id, [round(x, 6) for x in edges] as edges from (" + _edges(True) + ")")
def cell_edges_log(spark: SparkSession, d: str) -> DataFrame:
    return _series(spark, d).select("user_id", F.transform(arrays.cell_edges(F.col("v"), log=True), lambda x: F.round(x, 6)).alias("edges"))


@query("""with s as (select o_custkey, o_totalprice as v, lag(o_totalprice) over (partition by o_custkey order by o_orderkey) as p from orders)
  select o_custkey, coalesce(bool_and(v > p) filter (p is not null), true) or coalesce(bool_and(v < p) filter (p is not null), true) as monotonic from s group by 1""")
def is_monotonic(spark: SparkSession, d: str) -> DataFrame:
    return joins.strictly_monotonic(table(spark, d, "orders"), ["o_custkey"], "o_orderkey", "o_totalprice")


@query("select vec_id, i - 1 as c, embedding[i]::DOUBLE as v from embeddings, range(1, 65) r(i)")
def component_deinterleave(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("c", "v"))
    return e.select("vec_id", F.col("c").cast("bigint").alias("c"), F.col("v").cast("double").alias("v"))


@query("select vec_id, i as rec, list_sum([x::DOUBLE for x in embedding[i * 24 + 1 : least(64, i * 24 + 24)]])::DOUBLE is not null as filled, len(embedding[i * 24 + 1 : least(64, i * 24 + 24)])::INT as n, embedding[i * 24 + 1]::DOUBLE as first from embeddings, range(0, 3) r(i)")
def record_chunk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(arrays.chunk_records(F.col("embedding"), 24)).alias("rec", "a"))
    return e.select("vec_id", F.col("rec").cast("bigint").alias("rec"), F.col("a").isNotNull().alias("filled"), F.size("a").alias("n"), F.get("a", 0).cast("double").alias("first"))


@query("select vec_id, [embedding[(k % 16) * 4 + k // 16 + 1]::DOUBLE for k in range(0, 64)] as v from embeddings")
def majority_swap(spark: SparkSession, d: str) -> DataFrame:
    # a column-major (4, 16) record
    return table(spark, d, "embeddings").select("vec_id", arrays.to_row_major(F.col("embedding"), (4, 16)).cast("array<double>").alias("v"))


@query("select vec_id, ((vec_id % 3) * 4 + vec_id % 4) * 5 + vec_id % 5 as row_major, ((vec_id % 5) * 4 + vec_id % 4) * 3 + vec_id % 3 as column_major from embeddings")
def flat_index(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("vec_id")
    index, shape = F.array(v % 3, v % 4, v % 5), F.array(F.lit(3), F.lit(4), F.lit(5))
    return table(spark, d, "embeddings").select("vec_id", arrays.inverted_flat_index(index, shape).alias("row_major"), arrays.flat_index(index, shape).alias("column_major"))


_SHAPED = "(select p_partkey, case p_partkey % 5 when 0 then [] when 1 then [p_size] when 2 then [p_size, 3] when 3 then [p_size * 1000, 4000] else [p_size, 2, 2] end as shape, case when p_partkey % 7 = 0 then 'CDF_CHAR' else 'CDF_DOUBLE' end as t, case when p_partkey % 11 = 0 then ' Spectrogram' when p_partkey % 13 = 0 then 'time_series' end as dt from part)"


def _shaped(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size")
    empty = F.slice(F.array(s), 1, 0)
    shape = F.when(k % 5 == 0, empty).when(k % 5 == 1, F.array(s)).when(k % 5 == 2, F.array(s, F.lit(3))).when(k % 5 == 3, F.array(s * 1000, F.lit(4000))).otherwise(F.array(s, F.lit(2), F.lit(2)))
    return table(spark, d, "part").select("p_partkey", shape.alias("shape"), F.when(k % 7 == 0, "CDF_CHAR").otherwise("CDF_DOUBLE").alias("t"), F.when(k % 11 == 0, " Spectrogram").when(k % 13 == 0, "time_series").alias("dt"))


@query(f"select p_partkey, case when len(shape) = 0 then 0 else list_product(shape)::BIGINT end as total, case when len(shape) <= 1 then 1 else list_product(shape[2:])::BIGINT end as record_length from {_SHAPED}")
def shape_product(spark: SparkSession, d: str) -> DataFrame:
    return _shaped(spark, d).select("p_partkey", arrays.total_elements(F.col("shape")).alias("total"), arrays.record_length(F.col("shape")).alias("record_length"))


@query(f"""select p_partkey, case when t = 'CDF_CHAR' then 'character data is not plottable' when len(shape) = 0 or shape[1] = 0 then 'no records to plot' when len(shape) > 2 then len(shape) || '-dimensional data is not plottable'
  when list_product(shape) > 10000000 then 'too large to plot' end as refusal from {_SHAPED}""")
def plot_gate(spark: SparkSession, d: str) -> DataFrame:
    return _shaped(spark, d).select("p_partkey", masking.plot_refusal(F.col("shape"), F.col("t")).alias("refusal"))


@query(f"select p_partkey, case when lower(trim(dt)) = 'time_series' then 'line' when lower(trim(dt)) = 'spectrogram' then 'spectrogram' when len(shape) <= 1 or list_product(shape[2:]) <= 8 then 'line' else 'spectrogram' end as kind from {_SHAPED}")
def display_kind(spark: SparkSession, d: str) -> DataFrame:
    return _shaped(spark, d).select("p_partkey", masking.display_kind(F.col("shape"), F.col("dt")).alias("kind"))


@query("""select p_brand, min(v) as low, max(v) as high, case when min(v) < 0 then case when min(v) >= -128 and max(v) < 128 then 'CDF_INT1' when min(v) >= -32768 and max(v) < 32768 then 'CDF_INT2' when min(v) >= -2147483648 and max(v) < 2147483648 then 'CDF_INT4' else 'CDF_INT8' end
  when max(v) < 256 then 'CDF_UINT1' when max(v) < 65536 then 'CDF_UINT2' when max(v) < 4294967296 then 'CDF_UINT4' else 'CDF_INT8' end as type from (select p_brand, case length(p_brand) % 2 when 0 then -1 else 1 end * p_partkey * p_size * p_size as v from part) group by 1""")
def int_type_infer(spark: SparkSession, d: str) -> DataFrame:
    v = F.when(F.length("p_brand") % 2 == 0, -1).otherwise(1) * F.col("p_partkey") * F.col("p_size") * F.col("p_size")
    g = table(spark, d, "part").groupBy("p_brand").agg(F.min(v).alias("low"), F.max(v).alias("high"))
    return g.select("p_brand", "low", "high", smallest_int_type_column(F.col("low"), F.col("high")).alias("type"))


@query("""with t as (select unnest(['CDF_INT1','CDF_INT2','CDF_INT4','CDF_INT8','CDF_UINT1','CDF_UINT2','CDF_UINT4']) as n, unnest([7, 15, 31, 63, 8, 16, 32]) as bits)
  select a.n as dest, b.n as source, case when a.n = b.n then true when a.n like 'CDF_U%' then b.n like 'CDF_U%' and b.bits < a.bits else b.bits <= a.bits end as compatible from t a, t b""")
def type_compat(spark: SparkSession, d: str) -> DataFrame:
    names = ["CDF_INT1", "CDF_INT2", "CDF_INT4", "CDF_INT8", "CDF_UINT1", "CDF_UINT2", "CDF_UINT4"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "dest string, source string")
    return pairs.select("dest", "source", compatible_column(F.col("dest"), F.col("source")).alias("compatible"))


@query("select doc_id, regexp_replace(text, '\\s+$', '') as text, strlen(text)::INT as bytes, strlen(text)::INT + 160 as padded from documents")
def string_pad_trim(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, each in a variable 160 bytes wider than itself."""
    size = F.octet_length("text")
    raw = text.pad(F.col("text"), size + 160)
    return table(spark, d, "documents").select("doc_id", text.unpad(F.decode(raw, "UTF-8")).alias("text"), size.alias("bytes"), F.octet_length(raw).alias("padded"))


@query("select doc_id, text as utf8, text as latin1 from documents")
def latin1_repair(spark: SparkSession, d: str) -> DataFrame:
    """Each whole text as UTF-8, and as Latin-1 where Latin-1 can hold it."""
    raw = F.encode("text", "UTF-8")
    latin1 = F.when(F.col("text").rlike(r"[^\x{0}-\x{FF}]"), raw).otherwise(F.encode("text", "ISO-8859-1"))
    return table(spark, d, "documents").select("doc_id", text.repair_latin1(raw).alias("utf8"), text.repair_latin1(latin1).alias("latin1"))


@query("select *, (select count(*) from orders) as total from (select o_orderkey, o_totalprice from orders order by o_orderkey limit 20)")
def preview_limit(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return reduce.preview(o, "o_orderkey").crossJoin(o.agg(F.count(F.lit(1)).alias("total")))  # one row


@query("select n_nationkey as ord, n_nationkey || ',\"' || n_name || ',\"\"' || n_regionkey || '\"\"\",' as line from nation")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    odd = F.concat("n_name", F.lit(',"'), F.col("n_regionkey").cast("string"), F.lit('"'))
    return n.select(F.col("n_nationkey").alias("ord"), text.csv_line([F.col("n_nationkey"), odd, F.lit(None).cast("string")]).alias("line"))


@query("""select '{"r_regionkey":[' || string_agg(r_regionkey::VARCHAR, ',' order by r_regionkey) || '],"r_name":[' || string_agg('"' || r_name || '"', ',' order by r_regionkey) || ']}' as json from region""")
def json_columns(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.export import columns_json

    return columns_json(table(spark, d, "region"), "r_regionkey", ["r_regionkey", "r_name"])


@query("select doc_id, strlen(text)::INT as bytes, text as back from documents")
def rle_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts through the codec, with runs of NULs for their spaces."""
    raw = F.encode(F.replace("text", F.lit(" "), F.lit("\0\0\0")), "UTF-8")
    packed = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"), codec.rle_deflate_column(raw).alias("packed"))
    back = F.replace(F.decode(codec.rle_inflate_column(F.col("packed")), "UTF-8"), F.lit("\0\0\0"), F.lit(" "))
    return packed.select("doc_id", "bytes", back.alias("back"))


@query("select event_id, rpad(event_type, 10, ' ') as label, [trim(substr(rpad(event_type, 10, ' '), 1, 5)), trim(substr(rpad(event_type, 10, ' '), 6, 5))] as halves from events")
def label_split(spark: SparkSession, d: str) -> DataFrame:
    label = F.rpad("event_type", 10, " ")
    return table(spark, d, "events").select("event_id", label.alias("label"), text.labels(label, 2).alias("halves"))
