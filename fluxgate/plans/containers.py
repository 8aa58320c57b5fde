"""Queries that write CDF files of whole tables, in tasks, and read them back."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..files import CDF, load
from ..functions import scalars, time
from ..operators import catalog
from ..sources import codec, export, reader
from ..sources.build import Builder
from ..types import infer, shapes_compatible
from .registry import query, table
from .times import _NS, tt_sql

_FILES = "customer-"
_SQL = """with c as (select *, 'customer-' || (c_custkey // 100) as file_id, c_custkey // 100 as f, row_number() over (partition by c_custkey // 100 order by c_custkey) - 1 as rec from customer),
  f as (select file_id, f, count(*) as n, max(strlen(c_name)) as wname, max(strlen(c_mktsegment)) as wseg, max(c_acctbal) as top, ['none', 'gzip', 'rle'][f % 3 + 1] as outer_c, ['none', 'gzip', 'rle'][f // 3 % 3 + 1] as inner_c from c group by 1, 2),
  v as (select f.*, 0 as ord, 'key' as name, 'CDF_INT8' as cdf_type, [n] as shape, 8 as record_len, 8 as width from f union all select f.*, 1, 'acctbal', 'CDF_DOUBLE', [n], 8, 8 from f
    union all select f.*, 2, 'name', 'CDF_CHAR', [n, wname], wname, wname from f union all select f.*, 3, 'segment', 'CDF_CHAR', [n, wseg], wseg, wseg from f)"""


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: under spark.checkpoint.dir, or a
    temporary one where the session names none, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not named:
        named = tempfile.mkdtemp(prefix="fluxgate-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return f"{named.rstrip('/')}/cdf-{uuid.uuid4().hex}"


def _built(df: DataFrame, key: str, build: Callable[[pa.Table], Builder | CDF]) -> DataFrame:
    """(file_id, content): one file of the rows of each value of ``key``."""

    def run(rows: pa.Table) -> pa.Table:
        return pa.table({"file_id": rows.column(key).slice(0, 1), "content": pa.array([build(rows).to_bytes()], pa.binary())})

    return df.groupBy(key).applyInArrow(run, "file_id string, content binary")


def _customers(spark: SparkSession, d: str) -> DataFrame:
    """customer as files of a hundred: every codec within and around, either byte order, small blocks."""

    def build(rows: pa.Table) -> Builder:
        rows = rows.sort_by("c_custkey")
        get = lambda n: rows.column(n).to_pylist()
        f = get("c_custkey")[0] // 100
        names = ("none", "gzip", "rle")
        b = Builder(names[f % 3], 400, ("little", "big")[f % 2])
        add = lambda *a, **k: b.add_variable(*a, compression=names[f // 3 % 3], **k)
        add("key", np.array(get("c_custkey"), "i8"), attributes={"VAR_TYPE": " Support_Data"})
        add("acctbal", np.array(get("c_acctbal"), "f8"), attributes={"UNITS": "USD", "VALIDMAX": [max(get("c_acctbal"))]})
        add("name", get("c_name"), "CDF_CHAR", attributes={"VAR_TYPE": "metadata"})
        add("segment", get("c_mktsegment"), "CDF_CHAR")
        b.add_attribute("Title", [f"customers {f}", [f, f + 1]], [None, "CDF_INT4"])
        return b

    c = table(spark, d, "customer").withColumn("file_id", F.concat(F.lit(_FILES), F.expr("c_custkey div 100").cast("string")))
    return _built(c, "file_id", build)


def _objects(files: DataFrame, schema: str, rows: Callable[[str, CDF], Iterator[dict]]) -> DataFrame:
    """Rows of each file as a loaded object, one file at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in schema.split(", ")]
        for batch in batches:
            for name, raw in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                got = list(rows(name, load(raw)))
                if got:
                    yield pa.RecordBatch.from_pydict({n: [r[n] for r in got] for n in names})

    return files.mapInArrow(run, schema)


def _wide(records: DataFrame, **columns: str) -> DataFrame:
    own = lambda n, c: F.first(F.when(F.col("variable") == n, F.get(c, 0)), ignorenulls=True).alias(n)
    return records.groupBy("file_id", "rec").agg(*[own(n, c) for n, c in columns.items()])


@query(f"{_SQL} select file_id, rec, c_custkey as key, c_acctbal as acctbal, c_name as name, c_mktsegment as segment from c")
def file_records(spark: SparkSession, d: str) -> DataFrame:
    r = reader.parse_content(_customers(spark, d), "records")
    return _wide(r, key="v_long", acctbal="v_double", name="v_str", segment="v_str")


@query(f"{_SQL} select file_id, '3.8.0' as version, 'row' as majority, outer_c as compression, case f % 2 when 0 then 6 else 1 end as encoding, 4 as n_vars, 1 as n_attrs from f")
def file_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The files among all documents as they are, which are no CDF files."""
    others = table(spark, d, "documents").select(F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("file_id"), F.encode("text", "UTF-8").alias("content"))
    f = reader.parse_content(_customers(spark, d).unionByName(others), "files")
    return f.select("file_id", F.array_join(F.col("version").cast("array<string>"), ".").alias("version"), "majority", "compression", "encoding", "n_vars", "n_attrs")


@query(f"""{_SQL} select file_id, ord, name, cdf_type, array_to_string(shape, ',') as shape, record_len, false as is_nrv, inner_c as compression, case name when 'key' then 'support_data' when 'name' then 'metadata' else 'data' end as var_group, n <= greatest(1, 400 // width) as is_contiguous from
  (select * replace (case when name in ('key', 'acctbal') then 1 else record_len end as record_len) from v)""")
def variable_catalog(spark: SparkSession, d: str) -> DataFrame:
    v = reader.parse_content(_customers(spark, d), "variables")
    return v.select("file_id", "ord", "name", "cdf_type", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), "record_len", "is_nrv", "compression", "var_group", "is_contiguous")


@query(f"""{_SQL} select file_id, 'global' as scope, 'Title' as attr, 0 as entry_index, 'CDF_CHAR' as cdf_type, 'customers ' || f as text, null::DOUBLE as number from f
  union all select file_id, 'global', 'Title', 1, 'CDF_INT4', f || ', ' || f + 1, f::DOUBLE from f
  union all select file_id, 'key', 'VAR_TYPE', null, 'CDF_CHAR', 'Support_Data', null from f union all select file_id, 'name', 'VAR_TYPE', null, 'CDF_CHAR', 'metadata', null from f
  union all select file_id, 'acctbal', 'UNITS', null, 'CDF_CHAR', 'USD', null from f union all select file_id, 'acctbal', 'VALIDMAX', null, 'CDF_DOUBLE', null, top from f""")
def attribute_scan(spark: SparkSession, d: str) -> DataFrame:
    """Entries of either scope, with their canonical text (of texts and integers) and their first number."""
    from ..functions.text import numeric_attribute, value_text

    files = _customers(spark, d)
    g = reader.parse_content(files, "global_attrs").withColumn("scope", F.lit("global"))
    v = reader.parse_content(files, "variable_attrs").withColumnRenamed("variable", "scope").withColumn("entry_index", F.lit(None).cast("int"))
    both = g.drop("ord").unionByName(v)
    parts = [F.col(n) for n in ("v_str", "v_long", "v_double")]
    return both.select("file_id", "scope", "attr", "entry_index", "cdf_type", F.when(F.col("v_double").isNull(), value_text(*parts)).alias("text"), numeric_attribute(*parts).alias("number"))


@query(f"""{_SQL} select file_id, name as variable, block, block * per as first, least(n, (block + 1) * per) - 1 as last, inner_c <> 'none' as compressed
  from (select *, greatest(1, 400 // width) as per, unnest(range((n + greatest(1, 400 // width) - 1) // greatest(1, 400 // width))) as block from v)""")
def block_index(spark: SparkSession, d: str) -> DataFrame:
    b = reader.parse_content(_customers(spark, d), "blocks")
    return b.select("file_id", "variable", "block", "first", "last", "compressed")


@query("select o_orderkey as key, epoch_us(o_orderdate) * 1000 as ns, o_totalprice as price from orders")
def sink_source(spark: SparkSession, d: str) -> DataFrame:
    """orders through the sink to files, and back by the source, which reads three of five variables."""
    reader.register(spark)
    path = _folder(spark)
    o = table(spark, d, "orders").select("o_orderkey", time.ns_to_tt2000(time.timestamp_to_ns(F.col("o_orderdate"))).alias("Epoch"), "o_totalprice", "o_custkey", "o_orderpriority")
    o.write.format("cdf").mode("append").option("type.Epoch", "CDF_TIME_TT2000").option("variableCompression", "gzip").save(path)
    r = spark.read.format("cdf").option("variables", "o_orderkey,Epoch,o_totalprice").load(path)
    w = _wide(r, o_orderkey="v_long", Epoch="v_long", o_totalprice="v_double")
    return w.select(F.col("o_orderkey").alias("key"), time.tt2000_to_ns(F.col("Epoch")).alias("ns"), F.col("o_totalprice").alias("price"))


_CASES = "case when doc_id % 5 = 4 then 2 else [1, 5, 16, 1][doc_id % 5 + 1] end"


@query(f"""select doc_id, code, case when code <> 2 and doc_id % 7 <> 0 then text end as back, case when code = 2 then 'unsupported compression: huffman' when doc_id % 7 = 0 then 'corrupt block: ' || strlen(text) || ' bytes, not ' || strlen(text) + 1 end as error
  from (select doc_id, text, {_CASES} as code from documents where text is not null)""")
def codec_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as blocks of four codecs; every seventh lacks a byte, and one codec isn't supported."""

    @F.pandas_udf("binary")
    def pack(codes, raws):  # noqa: ANN001, ANN202
        import pandas as pd
        import zstandard

        one = lambda c, x: zstandard.ZstdCompressor().compress(x) if c == codec.ZSTD else x if c == 2 else codec.deflate(c, x)
        return pd.Series([one(int(c), bytes(x)) for c, x in zip(codes, raws, strict=True)])

    k = F.col("doc_id") % 5
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.when(k == 4, 2).otherwise(F.element_at(F.array(*map(F.lit, (1, 5, 16, 1))), (F.least(k, F.lit(3)) + 1).cast("int"))).alias("code"))
    size = F.octet_length("text") + F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    out = t.withColumn("r", codec.inflate_column(F.col("code"), pack("code", F.encode("text", "UTF-8")), size))
    return out.select("doc_id", "code", F.decode("r.content", "UTF-8").alias("back"), F.col("r.error").alias("error"))


@query(f"""{_SQL} select file_id, 'key,name' as listed, 'acctbal' as matched, 'name,segment' as texts, 0::BIGINT as none_kept, 4::BIGINT as left_whole, 'key,acctbal,name' as without, true as copies_equal, 'ValueError' as clone_again, 'KeyError' as absent from f""")
def file_objects(spark: SparkSession, d: str) -> DataFrame:
    """Filters by list, expression and function, removal, cloning, copies and lookup on each file."""
    import copy

    def outcome(f: Callable[[], object]) -> str:
        try:
            f()
        except (KeyError, ValueError) as e:
            return type(e).__name__
        return "done"

    def rows(name: str, c: CDF) -> Iterator[dict]:
        kept = lambda criterion: ",".join(c.filter(variables=criterion).keys())
        less = copy.deepcopy(c)
        less.remove_variable("segment")
        twin = CDF()
        for _, v in c.items():
            twin.clone_variable(v)
        same = copy.deepcopy(c) == c and all(twin[k] == v for k, v in c.items()) and less != c
        yield {"file_id": name, "listed": kept(["name", "key", "absent"]), "matched": kept("acc"), "texts": kept(lambda v: v.type == "CDF_CHAR"), "none_kept": len(c.filter()), "left_whole": len(c), "without": ",".join(less), "copies_equal": same, "clone_again": outcome(lambda: twin.clone_variable(c["key"])), "absent": outcome(lambda: c["nothing"])}

    return _objects(_customers(spark, d), "file_id string, listed string, matched string, texts string, none_kept bigint, left_whole bigint, without string, copies_equal boolean, clone_again string, absent string", rows)


@query(f"{_SQL} select file_id, count(*) as n, sum(c_custkey)::BIGINT as key_sum, string_agg(c_name, ',' order by c_custkey) as names, '<i8' as dtype, 8 * count(*) as bytes, true as lazy from c group by 1")
def values_view(spark: SparkSession, d: str) -> DataFrame:
    """Values as arrays, buffers and decoded texts; nothing is read before it is asked for."""

    def rows(name: str, c: CDF) -> Iterator[dict]:
        lazy = not c["key"].values_loaded
        v = c["key"].values
        yield {"file_id": name, "n": len(v), "key_sum": int(v.sum()), "names": ",".join(c["name"].values_encoded.tolist()), "dtype": v.dtype.newbyteorder("=").str, "bytes": memoryview(np.ascontiguousarray(v)).nbytes, "lazy": lazy and c["key"].values_loaded and not c["acctbal"].values_loaded}

    return _objects(_customers(spark, d), "file_id string, n bigint, key_sum bigint, names string, dtype string, bytes bigint, lazy boolean", rows)


@query(f"""{_SQL} select file_id, 'CDF version 3.8.0, majority: row, compression: ' || outer_c || chr(10) || 'Attributes:' || chr(10) || '  Title: ["customers ' || f || '", [' || f || ', ' || f + 1 || ']]' || chr(10) || 'Variables:' || chr(10)
  || '  key: [' || n || '] CDF_INT8, compression: ' || inner_c || ', attributes: VAR_TYPE' || chr(10) || '  acctbal: [' || n || '] CDF_DOUBLE, compression: ' || inner_c || ', attributes: UNITS, VALIDMAX' || chr(10)
  || '  name: [' || n || ', ' || wname || '] CDF_CHAR, compression: ' || inner_c || ', attributes: VAR_TYPE' || chr(10) || '  segment: [' || n || ', ' || wseg || '] CDF_CHAR, compression: ' || inner_c || ', attributes: none' as text from f""")
def file_repr(spark: SparkSession, d: str) -> DataFrame:
    return _objects(_customers(spark, d), "file_id string, text string", lambda name, c: iter([{"file_id": name, "text": repr(c)}]))


@query("""select r_name as file_id, 'compression: none' || chr(10) || 'attributes:' || chr(10) || '  Region:' || chr(10) || '    values: [' || r_name || ']' || chr(10) || '    types: [CDF_CHAR]' || chr(10) || 'variables:' || chr(10)
  || string_agg('  ' || n_name || ':' || chr(10) || '    attributes:' || chr(10) || '      KEY:' || chr(10) || '        values: ["' || n_nationkey || '"]' || chr(10) || '        types: [CDF_INT4]' || chr(10) || '    type: CDF_DOUBLE' || chr(10) || '    shape: [' || n_nationkey || ', 3]' || chr(10) || '    compression: gzip' || chr(10) || '    is_nrv: false' || chr(10), '' order by n_name) as yaml
  from region join nation on n_regionkey = r_regionkey group by 1""")
def yaml_skeleton(spark: SparkSession, d: str) -> DataFrame:
    from .catalogs import skeleton_json

    as_yaml = F.udf(export.skeleton_yaml, "string")  # one short text per file
    return skeleton_json(spark, d).select("file_id", as_yaml("skeleton").alias("yaml"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z' as time, value as low, value * 2 as high from events")
def plot_columns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", time.timestamp_to_ns(F.col("ts")).alias("ns"), F.array("value", F.col("value") * 2).alias("v"))
    return export.export_columns(e, "ns", "v", ["low", "high"], "event_id")


@query("""select 'orders-' || (o_orderkey // 1000) as file_id, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S.%f') || '000' as start, count(*) as n, min(epoch_us(o_orderdate)) * 1000 as first_ns, max(epoch_us(o_orderdate)) * 1000 as last_ns from orders group by o_orderkey // 1000""")
def time_buffers(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of time types as ISO text, variables of them as nanoseconds, from files."""

    def build(rows: pa.Table) -> Builder:
        ns = rows.column("ns").to_numpy()
        b = Builder()
        b.add_variable("Epoch", scalars.to_tt2000(ns.view("datetime64[ns]")), "CDF_TIME_TT2000")
        b.add_attribute("start", [[int(scalars.to_tt2000(ns.min().view("datetime64[ns]")))]], ["CDF_TIME_TT2000"])
        return b

    def rows(name: str, c: CDF) -> Iterator[dict]:
        ns = c["Epoch"].to_datetime64().astype("i8")
        yield {"file_id": name, "start": c.skeleton()["attributes"]["start"]["values"][0][0], "n": len(ns), "first_ns": int(ns.min()), "last_ns": int(ns.max())}

    o = table(spark, d, "orders").select(F.concat(F.lit("orders-"), F.expr("o_orderkey div 1000").cast("string")).alias("file_id"), time.timestamp_to_ns(F.col("o_orderdate")).alias("ns"))
    return _objects(_built(o, "file_id", build), "file_id string, start string, n bigint, first_ns bigint, last_ns bigint", rows)


@query(f"""select event_id, {tt_sql(_NS)} as tt2000, ({_NS} // 1000000)::DOUBLE + 62167219200000.0 as epoch, ({_NS} // 1000000000)::DOUBLE + 62167219200.0 as seconds, ({_NS} - ({_NS} // 1000000000) * 1000000000)::DOUBLE * 1000.0 as picoseconds, trunc((({_NS} // 1000000000)::DOUBLE) * 1e9 + ({_NS} - ({_NS} // 1000000000) * 1000000000)::DOUBLE * 1000.0 / 1e3)::BIGINT as bulk_ns,
  case when event_id % 5 = 4 then trunc((({_NS} // 1000000)::DOUBLE) * 1e6)::BIGINT else {_NS} end as back from events""")
def time_inputs(spark: SparkSession, d: str) -> DataFrame:
    """datetimes, datetime64 of two units, and time scalars, mixed in one list, to each CDF time and back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ns = batch.column("event_id").to_numpy(), batch.column("ns").to_numpy()
            tt, e, e16 = (f(ns.view("datetime64[ns]")) for f in (scalars.to_tt2000, scalars.to_epoch, scalars.to_epoch16))
            stamps = scalars.to_datetime(tt, "CDF_TIME_TT2000")
            kinds = (lambda i: stamps[i], lambda i: np.datetime64(int(ns[i]) // 1000, "us"), lambda i: np.datetime64(int(ns[i]), "ns"), lambda i: scalars.TT2000(int(tt[i])), lambda i: scalars.Epoch(float(e[i])))
            mixed = [kinds[int(k) % 5](i) for i, k in enumerate(ids)]
            # an EPOCH holds whole milliseconds here, and is converted in doubles
            back = scalars.to_ns(scalars.to_tt2000(mixed), "CDF_TIME_TT2000")
            yield pa.RecordBatch.from_pydict({"event_id": ids, "tt2000": tt, "bulk_ns": scalars.ns_of([scalars.Epoch16(*map(float, x)) for x in e16]), "epoch": e, "seconds": e16[:, 0], "picoseconds": e16[:, 1], "back": back})

    e = table(spark, d, "events").select("event_id", time.timestamp_to_ns(F.col("ts")).alias("ns"))
    return e.mapInArrow(run, "event_id bigint, tt2000 bigint, bulk_ns bigint, epoch double, seconds double, picoseconds double, back bigint")


@query("""select p_partkey // 100 as bucket, case when max(p_size * 300) < 256 then 'CDF_UINT1' when max(p_size * 300) < 65536 then 'CDF_UINT2' else 'CDF_UINT4' end as ints, case when max(p_size * 300) < 128 then 'CDF_INT1' when max(p_size * 300) < 32768 then 'CDF_INT2' else 'CDF_INT4' end as signed,
  'CDF_DOUBLE' as floats, 'CDF_UCHAR[' || count(*) || ', ' || max(strlen(p_name)) || ']' as texts, 'CDF_UINT1[' || count(*) || ', 2, 1]' as nested, 'CDF_INT4' as numpy_ints, 'CDF_FLOAT' as numpy_floats, 'CDF_TIME_TT2000' as times, 'IndexError' as ragged, 'ValueError' as mixed, 'CDF_CHAR' as attr_text, 'CDF_UINT1' as attr_int, 'CDF_INT2' as attr_numpy
  from part group by 1""")
def value_inference(spark: SparkSession, d: str) -> DataFrame:
    """Types and shapes inferred from lists, nested lists, numpy arrays and attribute values."""

    def refused(v: object) -> str:
        try:
            return infer(v)[0]
        except (IndexError, ValueError) as e:
            return type(e).__name__

    def run(rows: pa.Table) -> pa.Table:
        get = lambda n: rows.column(n).to_pylist()
        size = [x * 300 for x in get("p_size")]
        shaped = lambda v: "{0}{1}".format(infer(v)[0], list(infer(v)[1]))
        out = {
            "bucket": get("bucket")[0], "ints": infer(size)[0], "signed": infer([-1, *size])[0], "floats": infer([1, *get("p_retailprice")])[0], "texts": shaped(get("p_name")),
            "nested": shaped([[[x], [x]] for x in get("p_size")]), "numpy_ints": infer(np.array(size, "i4"))[0], "numpy_floats": infer(np.array(size, "f4"))[0], "times": infer(np.array(size, "datetime64[s]"))[0],
            "ragged": refused([[1], size + [2]]), "mixed": refused(["a", *size]), "attr_text": Builder._entry("x", None)[0], "attr_int": Builder._entry(7, None)[0], "attr_numpy": Builder._entry(np.array([7], "i2"), None)[0],
        }
        return pa.Table.from_pylist([out])

    p = table(spark, d, "part").withColumn("bucket", F.expr("p_partkey div 100"))
    names = "ints signed floats texts nested numpy_ints numpy_floats times ragged mixed attr_text attr_int attr_numpy".split()
    return p.groupBy("bucket").applyInArrow(run, "bucket bigint, " + ", ".join(f"{n} string" for n in names))


@query("""select p_partkey, case when nrv then case when len(new) = len(cur) then new[1] <= 1 and new[2:] = cur[2:] else cur[2:] = new end else len(new) = len(cur) and new[2:] = cur[2:] end as fits
  from (select p_partkey, p_partkey % 2 = 0 as nrv, [1, p_size, 3] as cur, case p_partkey % 5 when 0 then [1, p_size, 3] when 1 then [p_size, 3] when 2 then [2, p_size, 3] when 3 then [1, p_size + p_partkey % 3, 3] else [p_size] end as new from part)""")
def shape_rules(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("boolean")
    def fits(keys, sizes):  # noqa: ANN001, ANN202
        import pandas as pd

        def one(k: int, s: int) -> bool:
            new = ([1, s, 3], [s, 3], [2, s, 3], [1, s + k % 3, 3], [s])[k % 5]
            return shapes_compatible([1, s, 3], new, k % 2 == 0)

        return pd.Series([one(int(k), int(s)) for k, s in zip(keys, sizes, strict=True)])

    return table(spark, d, "part").select("p_partkey", fits("p_partkey", "p_size").alias("fits"))


@query("select n_nationkey as k, case n_nationkey % 8 when 7 then 'CDF_DOUBLE [3] none' when 6 then 'CDF_UINT1 [1] gzip' when 5 then 'CDF_UINT2 [2] none' else 'ValueError' end as outcome from nation")
def build_rules(spark: SparkSession, d: str) -> DataFrame:
    """What adding and setting refuses: a taken name, no name, an unknown codec, a wider type, another shape; and what it takes."""

    def one(k: int, name: str) -> str:
        b = Builder()
        b.add_variable(name, [300, 400])
        steps = (
            lambda: b.add_variable(name, [1]), lambda: b.add_variable("", [1]), lambda: b.add_variable("x", [1], compression="zstd"), lambda: b.set_values(name, [1.5, 2.5]),
            lambda: b.set_values(name, [[1, 2]]), lambda: b.set_values(name, [5, 6]), lambda: b.add_variable("x", [1], compression="gzip"), lambda: b.set_values(name, [1.5, 2.5, 3], force=True),
        )
        try:
            steps[k % 8]()
        except ValueError as e:
            return type(e).__name__
        v = list(b.variables.values())[-1]
        return f"{v.type} {list(v.shape)} {v.compression}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("n_nationkey").to_pylist()
            yield pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int32()), "outcome": [one(k, n) for k, n in zip(keys, batch.column("n_name").to_pylist(), strict=True)]})

    return table(spark, d, "nation").select("n_nationkey", "n_name").mapInArrow(run, "k int, outcome string")


@query("""select 'function' as how, n_name as name from nation where length(n_name) > 8 union all select 'left', n_name from nation where n_name <> 'NATION_7' union all select 'found', n_name from nation where n_name = 'NATION_7'
  union all select 'cloned', n_name from nation union all select 'global list', r_name from region where r_name in ('ASIA') union all select 'global start', r_name from region where regexp_matches(r_name, '^A') union all select 'global search', r_name from region where contains(lower(r_name), 'a')""")
def catalog_changes(spark: SparkSession, d: str) -> DataFrame:
    """Filters by function, lookup, removal and cloning of variables; filters and search of global attributes."""
    n = table(spark, d, "nation").select(F.lit("f").alias("file_id"), F.col("n_name").alias("name"), "n_regionkey")
    null = lambda t: F.lit(None).cast(t)
    r = table(spark, d, "region").select(F.lit("f").alias("file_id"), F.col("r_name").alias("attr"), F.lit("-").alias("v_str"), null("array<bigint>").alias("v_long"), null("array<double>").alias("v_double"))
    parts = {
        "function": catalog.filter_variables(n, lambda c: F.length(c) > 8), "left": catalog.remove(n, "NATION_7"), "found": catalog.lookup(n, "NATION_7"), "cloned": _clone(n),
        "global list": catalog.filter_attributes(r, ["ASIA"]), "global start": catalog.filter_attributes(r, "A"), "global search": catalog.search_globals(r, " a "),
    }
    rows = [p.select(F.lit(how).alias("how"), F.col("attr" if how.startswith("global") else "name").alias("name")) for how, p in parts.items()]
    out = rows[0]
    for x in rows[1:]:
        out = out.unionByName(x)
    return out


def _clone(n: DataFrame) -> DataFrame:
    from ..operators.joins import clone_rows

    return clone_rows(n.where("n_regionkey < 2"), n.where("n_regionkey >= 2"))
