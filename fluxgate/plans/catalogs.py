"""Queries on catalogs, joins, diffs and files, over the star schema's small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, time
from ..operators import catalog, diff, joins
from .registry import query, table


def _variables(spark: SparkSession, d: str) -> DataFrame:
    """nation as the variables of one file."""
    return table(spark, d, "nation").select(F.lit("f").alias("file_id"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("num"), "n_regionkey")


def _attributes(spark: SparkSession, d: str) -> DataFrame:
    """customer's segments as attributes of the variables, one for each pair."""
    c = table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.max("c_name").alias("top"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("variable"))
    null = lambda t: F.lit(None).cast(t)
    return c.join(n, "c_nationkey").select(F.lit("f").alias("file_id"), "variable", F.col("c_mktsegment").alias("attr"), F.col("top").alias("v_str"), null("array<bigint>").alias("v_long"), null("array<double>").alias("v_double"))


@query("select n_name as name from nation where n_name in ('NATION_1', 'NATION_12', 'absent')")
def var_filter_list(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filter_variables(_variables(spark, d), ["NATION_1", "NATION_12", "absent"]).select("name")


@query("select n_name as name from nation where regexp_matches(n_name, '^NATION_[12]')")
def var_filter_regex(spark: SparkSession, d: str) -> DataFrame:
    return catalog.filter_variables(_variables(spark, d), "NATION_[12]").select("name")


@query("""select n_name as name from nation where lower(n_name) like '%machin%' or n_nationkey in (select c_nationkey from (select c_nationkey, c_mktsegment, max(c_name) as top from customer group by 1, 2) where lower(c_mktsegment || chr(10) || top) like '%00014%')""")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    return catalog.search_variables(_variables(spark, d), _attributes(spark, d), "  00014 ").select("name")


@query("select p_partkey, case when lower(trim(t)) in ('data', 'support_data', 'metadata') then lower(trim(t)) else 'data' end as grp from (select p_partkey, case p_partkey % 4 when 0 then ' Support_Data ' when 1 then 'METADATA' when 2 then p_type end as t from part)")
def var_group(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    return table(spark, d, "part").select("p_partkey", text.var_group(F.when(k == 0, " Support_Data ").when(k == 1, "METADATA").when(k == 2, F.col("p_type"))).alias("grp"))


@query("""select l_orderkey as file_id, l_linenumber as rec, max(l_quantity) as quantity, max(epoch_us(o_orderdate) * 1000) as axis_ns from lineitem left join orders on o_orderkey = l_orderkey group by 1, 2""")
def depend0_align(spark: SparkSession, d: str) -> DataFrame:
    data = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("rec")).agg(F.max("l_quantity").alias("quantity"))
    axis = table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), time.timestamp_to_ns(F.col("o_orderdate")).alias("axis_ns"))
    return joins.align_constant(data, axis)


@query("""select event_id as rec, case when event_id % 3 = 0 then epoch_us(ts) * 1000 when event_id % 3 = 1 then floor(value * 1000 + 0.5)::BIGINT * 1000000 end as axis_ns, event_id % 3 <> 2 as is_time,
  case when event_id % 3 = 0 then (epoch_us(ts) * 1000)::DOUBLE / 1e9 when event_id % 3 = 1 then value when event_id % 2 = 0 then value * 2 else event_id::DOUBLE end as x from events""")
def time_axis(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.lit("f").alias("file_id"), F.col("event_id").alias("rec"), "ts", "value")
    r = F.col("rec")
    times = e.where(r % 3 == 0).select("file_id", "rec", time.timestamp_to_ns(F.col("ts")).alias("ts_ns"))
    seconds = e.where(r % 3 == 1).select("file_id", "rec", F.col("value").alias("seconds"))
    numbers = e.where(r % 2 == 0).select("file_id", "rec", (F.col("value") * 2).alias("number"))
    return joins.time_axis(e.select("file_id", "rec"), times, seconds, numbers).select("rec", "axis_ns", "is_time", "x")


@query("select n_nationkey as num, n_name as name, r_name as value from nation left join region on n_regionkey = r_regionkey and r_name <> 'ASIA'")
def attr_join(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "nation").select(F.lit("f").alias("file_id"), F.col("n_regionkey").alias("num"), F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    a = table(spark, d, "region").where("r_name <> 'ASIA'").select(F.lit("f").alias("file_id"), F.col("r_regionkey").alias("num"), F.col("r_name").alias("value"))
    return joins.join_attributes(v, a).select(F.col("id").alias("num"), "name", "value")


@query("""select n_regionkey as variable, n_nationkey as c, coalesce(case when n_nationkey % 3 = 0 then n_name end, case when n_nationkey % 3 = 1 then (n_nationkey::DOUBLE)::VARCHAR end, 'comp ' || n_nationkey) as label from nation""")
def label_join(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("variable"), F.col("n_nationkey").alias("c"), "n_name")
    pointer = n.where("c % 3 = 0").select("variable", "c", F.col("n_name").alias("label"))
    depend1 = n.where("c % 3 = 1").select("variable", "c", F.col("c").cast("double").alias("center"))
    return joins.component_labels(n.select("variable", "c"), pointer, depend1, ["variable", "c"])


@query("""with b as (select o_custkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as bin, o_totalprice as center from orders), f as (select *, lag(center) over (partition by o_custkey order by bin) as p from b where bin < 3),
  m as (select o_custkey, count(*) = 3 and (bool_and(p is null or center > p) or bool_and(p is null or center < p)) as good from f group by 1)
  select f.o_custkey, f.bin, case when good then center else bin::DOUBLE end as center from f join m using (o_custkey)""")
def bin_axis(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    b = table(spark, d, "orders").select("o_custkey", (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1).cast("bigint").alias("bin"), F.col("o_totalprice").alias("center"))
    return joins.bin_axis(b, 3, ["o_custkey"])


_A = "select n_name as name, [n_nationkey, 3] as shape, 'CDF_FLOAT' as t, n_nationkey % 2 = 0 as nrv, case n_regionkey % 3 when 0 then 'data' when 1 then 'support_data' else 'metadata' end as grp from nation where n_nationkey < 20"
_B = "select n_name as name, [n_nationkey + (n_nationkey % 4 = 0)::INT, 3] as shape, case when n_nationkey % 5 = 0 then 'CDF_DOUBLE' else 'CDF_FLOAT' end as t, n_nationkey % 2 = 0 and n_nationkey <> 6 as nrv, case n_regionkey % 3 when 0 then 'data' when 1 then 'support_data' else 'metadata' end as grp from nation where n_nationkey > 2"
_AA = "select n_name as name, unnest(['UNITS', 'FILLVAL']) as attr, unnest(['nT', '-1e31']) as text from nation where n_nationkey < 20"
_BA = "select n_name as name, unnest(['UNITS', 'SCALE']) as attr, unnest([case when n_nationkey % 3 = 0 then 'T' else 'nT' end, case when n_nationkey % 2 = 0 then 'lin' else 'log' end]) as text from nation where n_nationkey > 2 and n_nationkey % 7 <> 0"
_AG = "select r_name as attr, 0 as entry_index, 'v' as text from region where r_regionkey < 4 union all select r_name, 1, 'w' from region where r_regionkey < 2"
_BG = "select r_name as attr, 0 as entry_index, case when r_regionkey = 3 then 'x' else 'v' end as text from region where r_regionkey > 0 union all select r_name, 1, 'w' from region where r_regionkey in (1, 2)"
_CTE = f"with a as ({_A}), b as ({_B}), aa as ({_AA}), ba as ({_BA}), ag as ({_AG}), bg as ({_BG})"
_FIELDS = """fields as (select a.name, 0 as ord, 'shape' as field, 'changed' as status, array_to_string(a.shape, ', ') as a, array_to_string(b.shape, ', ') as b from a join b using (name) where a.shape <> b.shape
  union all select a.name, 1, 'type', 'changed', a.t, b.t from a join b using (name) where a.t <> b.t union all select a.name, 2, 'isNrv', 'changed', a.nrv::VARCHAR, b.nrv::VARCHAR from a join b using (name) where a.nrv <> b.nrv)"""
_ATTRS = """attrs as (select name, attr, case when ba.name is null then 'removed' when aa.name is null then 'added' else 'changed' end as status, aa.text as a, ba.text as b from aa full join ba using (name, attr)
  where name in (select a.name from a join b using (name)) and aa.text is distinct from ba.text)"""
_VARS = """vars as (select name, coalesce(b.grp, a.grp) as grp, case when b.name is null then 'removed' when a.name is null then 'added' when name in (select name from fields union select name from attrs) then 'changed' else 'same' end as status from a full join b using (name))"""
_ENTRIES = """entries as (select attr, entry_index, case when bg.attr is null then 'removed' when ag.attr is null then 'added' else 'changed' end as status, ag.text as a, bg.text as b from ag full join bg using (attr, entry_index) where ag.text is distinct from bg.text)"""
_GLOBALS = """globals as (select attr, case when attr not in (select attr from bg) then 'removed' when attr not in (select attr from ag) then 'added' when attr in (select attr from entries) then 'changed' else 'same' end as status from (select attr from ag union select attr from bg))"""


def _models(spark: SparkSession, d: str) -> tuple[diff.Model, diff.Model]:
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    grp = F.element_at(F.array(F.lit("data"), F.lit("support_data"), F.lit("metadata")), F.col("n_regionkey") % 3 + 1)
    va = n.where(k < 20).select(F.col("n_name").alias("name"), F.array(k, F.lit(3)).alias("shape"), F.lit("CDF_FLOAT").alias("type_name"), (k % 2 == 0).alias("is_nrv"), grp.alias("grp"))
    vb = n.where(k > 2).select(F.col("n_name").alias("name"), F.array(k + (k % 4 == 0).cast("int"), F.lit(3)).alias("shape"), F.when(k % 5 == 0, "CDF_DOUBLE").otherwise("CDF_FLOAT").alias("type_name"), ((k % 2 == 0) & (k != 6)).alias("is_nrv"), grp.alias("grp"))
    pair = lambda x, y: F.inline(F.array(*[F.struct(F.lit(a).alias("attr"), v.alias("text")) for a, v in (x, y)]))
    aa = n.where(k < 20).select(F.col("n_name").alias("name"), pair(("UNITS", F.lit("nT")), ("FILLVAL", F.lit("-1e31"))))
    ba = n.where((k > 2) & (k % 7 != 0)).select(F.col("n_name").alias("name"), pair(("UNITS", F.when(k % 3 == 0, "T").otherwise("nT")), ("SCALE", F.when(k % 2 == 0, "lin").otherwise("log"))))
    r, i = table(spark, d, "region"), F.col("r_regionkey")
    entry = lambda where, index, v: r.where(where).select(F.col("r_name").alias("attr"), F.lit(index).alias("entry_index"), v.alias("text"))
    ga = entry(i < 4, 0, F.lit("v")).unionByName(entry(i < 2, 1, F.lit("w")))
    gb = entry(i > 0, 0, F.when(i == 3, "x").otherwise("v")).unionByName(entry(i.isin(1, 2), 1, F.lit("w")))
    return diff.Model(va, aa, ga), diff.Model(vb, ba, gb)


@query(f"{_CTE}, {_FIELDS}, {_ATTRS}, {_VARS} select name, grp, status from vars")
def struct_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.variable_diff(*_models(spark, d))


@query(f"{_CTE}, {_FIELDS} select name, field, status, a, b from fields")
def field_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = _models(spark, d)
    return diff.field_diff(a.variables, b.variables).drop("ord")


@query(f"{_CTE}, {_ATTRS} select name, attr, status, a, b from attrs")
def attr_diff(spark: SparkSession, d: str) -> DataFrame:
    return diff.attribute_diff(*_models(spark, d))


@query(f"{_CTE}, {_ENTRIES} select attr, entry_index, status, a, b from entries")
def global_entry_diff(spark: SparkSession, d: str) -> DataFrame:
    a, b = _models(spark, d)
    return diff.global_entry_diff(a.globals, b.globals)


@query(f"{_CTE}, {_FIELDS}, {_ATTRS}, {_VARS}, {_ENTRIES}, {_GLOBALS} select status, count(*) as n from (select status from vars union all select status from globals) where status <> 'same' group by 1")
def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_summary(*_models(spark, d))


@query(f"""{_CTE}, {_FIELDS}, {_ATTRS}, {_VARS}, {_ENTRIES}, {_GLOBALS}, items as (select grp as section, name as item, status from vars where status <> 'same' union all select 'global', attr, status from globals where status <> 'same')
  select distinct section, null as item, 'section' as kind, null as detail, null as status, null as a, null as b from items union all select section, item, 'item', null, status, null, null from items
  union all select grp, fields.name, 'detail', field, fields.status, a, b from fields join vars using (name) union all select grp, attrs.name, 'detail', attr, attrs.status, a, b from attrs join vars using (name)
  union all select 'global', attr, 'detail', '[' || entry_index || ']', status, a, b from entries""")
def diff_lines(spark: SparkSession, d: str) -> DataFrame:
    return diff.diff_lines(*_models(spark, d)).drop("ord")


@query("""select r_name as file_id, '{"compression":"none","attributes":{"Region":{"values":["' || r_name || '"],"types":["CDF_CHAR"]}},"variables":{' || string_agg('"' || n_name || '":{"attributes":{"KEY":{"values":["' || n_nationkey || '"],"types":["CDF_INT4"]}},"type":"CDF_DOUBLE","shape":[' || n_nationkey || ',3],"compression":"gzip","is_nrv":false}', ',' order by n_name) || '}}' as skeleton
  from region join nation on n_regionkey = r_regionkey group by 1""")
def skeleton_json(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "region").withColumnRenamed("r_name", "file_id")
    n = table(spark, d, "nation").join(r.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey")
    null = lambda t: F.lit(None).cast(t)
    files = r.select("file_id", F.lit("none").alias("compression"))
    variables = n.select("file_id", F.col("n_name").alias("name"), F.lit("CDF_DOUBLE").alias("cdf_type"), F.array("n_nationkey", F.lit(3)).alias("shape"), F.lit("gzip").alias("compression"), F.lit(False).alias("is_nrv"))
    attrs = n.select("file_id", F.col("n_name").alias("variable"), F.lit("KEY").alias("attr"), F.lit("CDF_INT4").alias("cdf_type"), null("string").alias("v_str"), F.array(F.col("n_nationkey").cast("bigint")).alias("v_long"), null("array<double>").alias("v_double"))
    globals_ = r.select("file_id", F.lit("Region").alias("attr"), F.lit(0).alias("entry_index"), F.lit("CDF_CHAR").alias("cdf_type"), F.col("file_id").alias("v_str"), null("array<bigint>").alias("v_long"), null("array<double>").alias("v_double"))
    return catalog.skeleton(files, variables, attrs, globals_)


@query("select o_custkey as file_id, o_orderpriority as variable, count(*) as n_blocks, count(*) <= 1 as is_contiguous from orders group by 1, 2")
def contiguity(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderpriority").alias("variable"), F.col("o_orderkey").alias("offset"))
    return catalog.contiguity(o)


@query("select user_id, event_id as rec, epoch_us(ts) * 1000 as ns, value, event_type from events")
def cdf_write_read(spark: SparkSession, d: str) -> DataFrame:
    """events to one CDF file per user and back: TT2000, double and text variables."""
    from ..sources.reader import parse_content
    from ..sources.writer import to_cdf

    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("file_id"), F.col("event_id").alias("rec"), F.col("event_id").alias("id"), time.ns_to_tt2000(time.timestamp_to_ns(F.col("ts"))).alias("Epoch"), "value", "event_type")
    files = to_cdf(e, "file_id", {"Epoch": "CDF_TIME_TT2000", "id": "CDF_INT8"}, variable_compression="gzip")
    r = parse_content(files, "records")
    own = lambda n, c: F.first(F.when(F.col("variable") == n, F.get(c, 0)), ignorenulls=True)
    wide = r.groupBy("file_id", "rec").agg(own("id", "v_long").alias("id"), own("Epoch", "v_long").alias("tt"), own("value", "v_double").alias("value"), own("event_type", "v_str").alias("event_type"))
    return wide.select(F.col("file_id").cast("bigint").alias("user_id"), F.col("id").alias("rec"), time.tt2000_to_ns(F.col("tt")).alias("ns"), "value", "event_type")


_LINES = """items as (select grp as section, name as item, status from vars union all select 'global', attr, status from globals),
  lines as (select distinct section, null as item, 'section' as kind, null as detail, null as status, null as a, null as b, 0 as ord from items union all select section, item, 'item', null, status, null, null, 0 from items
  union all select grp, fields.name, 'detail', field, fields.status, a, b, ord + 1 from fields join vars using (name) union all select grp, attrs.name, 'detail', attr, attrs.status, a, b, 10 from attrs join vars using (name)
  union all select 'global', attr, 'detail', '[' || entry_index || ']', status, a, b, entry_index + 1 from entries)"""


@query(f"""{_CTE}, {_FIELDS}, {_ATTRS}, {_VARS}, {_ENTRIES}, {_GLOBALS}, {_LINES}
  select row_number() over (order by list_position(['global', 'data', 'support_data', 'metadata'], lines.section), coalesce(list_position(['changed', 'added', 'removed', 'same'], items.status), 0), coalesce(lines.item, ''), kind <> 'item', ord, detail nulls first) - 1 as line,
  lines.section, lines.item, kind, detail, lines.status, a, b from lines left join items on items.section = lines.section and items.item = lines.item""")
def diff_reading_order(spark: SparkSession, d: str) -> DataFrame:
    """All lines of a diff, equal items too, with their places."""
    return diff.numbered(diff.diff_lines(*_models(spark, d), include_same=True)).select("line", "section", "item", "kind", "detail", "status", "a", "b")


_VALUES = "select p_partkey, case when p_partkey % 4 = 0 then '  ' || p_type || ' ' when p_partkey % 4 = 1 then ' ' || p_size || '.5 ' end as s, case when p_partkey % 4 = 2 then [p_size, p_partkey] end as l from part"


@query(f"""select p_partkey, coalesce(trim(s), array_to_string(l, ', '), '') as text, coalesce(l[1]::DOUBLE, try_cast(trim(s) as DOUBLE)) as number,
  case when lower(trim(s)) in ('promo', 'economy') then 'log' else 'linear' end as plain_scale, p_partkey * 500 <= 2000000 as previewable from ({_VALUES})""")
def attribute_values(spark: SparkSession, d: str) -> DataFrame:
    """Canonical text, number and axis scale of attribute values, and whether a preview is made."""
    from ..operators import masking

    k = F.col("p_partkey")
    s = F.when(k % 4 == 0, F.concat(F.lit("  "), "p_type", F.lit(" "))).when(k % 4 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 ")))
    v = table(spark, d, "part").select("p_partkey", s.alias("s"), F.when(k % 4 == 2, F.array(F.col("p_size").cast("bigint"), k)).alias("l"), F.lit(None).cast("array<double>").alias("f"))
    parts = [F.col(c) for c in ("s", "l", "f")]
    scale = F.when(F.lower(F.trim("s")).isin("promo", "economy"), " LOG ").otherwise(F.col("s"))
    return v.select("p_partkey", text.value_text(*parts).alias("text"), text.numeric_attribute(*parts).alias("number"), text.scale_type(scale, "linear").alias("plain_scale"), masking.previewable(F.array(k, F.lit(500))).alias("previewable"))
