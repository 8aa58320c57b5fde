from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluxgate.functions import time as t
from fluxgate.operators import catalog, diff
from fluxgate.sources import codec, export, reader, writer
from fluxgate.sources.build import Builder
from fluxgate.sources.layout import Memory, Parser, decode_text


def golden(file_compression="none", compression="none", block_bytes=1 << 30):
    b = Builder(file_compression, block_bytes)
    add = lambda n, v, k=None, **kw: b.add_variable(n, v, k, compression=compression, **kw)
    ms = 62167219200000.0 + np.arange(101) * 15552000000.0
    ns = np.arange(101) * 15552000 * t.SECOND
    add("epoch", ms, "CDF_EPOCH", attributes={"epoch_attr": "a variable attribute"})
    add("epoch16", np.stack([ms / 1000, np.zeros(101)], 1), "CDF_EPOCH16")
    add("tt2000", np.array([t.tt2000_of_ns(int(x)) for x in ns]), "CDF_TIME_TT2000")
    add("var", np.cos(np.arange(101) * 2 * np.pi / 100), attributes={"var_attr": "a variable attribute", "DEPEND0": "epoch"})
    add("zeros", np.zeros(2048))
    add("bytes", np.ones(10, "i1"), "CDF_BYTE")
    add("var2d_counter", np.arange(100.0).reshape(10, 10))
    add("var3d_counter", np.arange(150.0).reshape(10, 3, 5), attributes={"attr1": "x", "attr2": [10, 11]})
    add("var5d_counter", np.arange(720.0).reshape(6, 5, 4, 3, 2))
    add("var_string", ["This is a string"], "CDF_CHAR", is_nrv=True)
    add("var3d_string", [[["value[00]", "value[01]"], ["value[10]", "value[11]"]]], "CDF_CHAR", is_nrv=True)
    add("var_recvary_string", ["001", "002", "003"], "CDF_CHAR")
    b.add_attribute("attr", ["a cdf text attribute"])
    b.add_attribute("attr_float", [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], ["CDF_FLOAT", "CDF_FLOAT"])
    b.add_attribute("attr_multi", [[1, 2], [2.0, 3.0], "hello"])
    b.add_attribute("empty", [])
    return b.to_bytes()


@pytest.mark.parametrize("file_compression", ["none", "gzip", "rle"])
@pytest.mark.parametrize("compression", ["none", "gzip", "rle"])
def test_golden(file_compression, compression):
    p = Parser(Memory(golden(file_compression, compression, 700)))
    v = {x.name: x for x in p.file.variables}
    assert len(v) == 12 and v["var5d_counter"].shape == (6, 5, 4, 3, 2) and v["var3d_string"].shape == (1, 2, 2, 9)
    assert np.array_equal(p.values(v["var5d_counter"])[1], np.arange(720.0).reshape(6, 5, 4, 3, 2))
    assert p.values(v["var_recvary_string"])[1].tolist() == [b"001", b"002", b"003"]
    assert p.values(v["epoch16"])[1][100].tolist() == [62167219200.0 + 100 * 15552000, 0.0]
    assert not p.values(v["zeros"])[1].any() and len(list(p.blocks(v["zeros"]))) > 1
    a = {x.name: [e.value if isinstance(e.value, str) else e.value.tolist() for e in x.listed] for x in p.file.attributes if x.is_global}
    assert a == {"attr": ["a cdf text attribute"], "attr_float": [[1, 2, 3], [4, 5, 6]], "attr_multi": [[1, 2], [2, 3], "hello"], "empty": []}


def test_column_major_is_swapped():
    raw = bytearray(golden())
    p = Parser(Memory(bytes(raw)))
    # clear the row-major flag of the descriptor behind its version, release and encoding
    raw[8 + 12 + 8 + 12 + 3] &= 0xFE
    q = Parser(Memory(bytes(raw)))
    assert q.file.majority == "column"
    var = next(x for x in p.file.variables if x.name == "var3d_counter")
    want = np.arange(150.0).reshape(10, 15).reshape(10, 5, 3).transpose(0, 2, 1)
    assert np.array_equal(q.values(var)[1], want)


@pytest.mark.parametrize("compression", ["none", "gzip", "rle"])
def test_byte_orders_agree(compression):
    def tables(order):
        b = Builder(compression, 100, order)
        b.add_variable("d", np.arange(50.0) / 7, compression=compression, attributes={"top": [2.5]})
        b.add_variable("e", np.arange(20.0).reshape(10, 2), "CDF_EPOCH16")
        b.add_variable("s", ["ab", "c"], "CDF_CHAR")
        b.add_variable("i", np.arange(9, dtype="i2"))
        p = Parser(Memory(b.to_bytes()))
        return p.file.encoding, [(p.values(v)[1].tolist(), [e.value if isinstance(e.value, str) else e.value.tolist() for _, e in p.attributes_of(v)]) for v in p.file.variables]

    (little, a), (big, b) = tables("little"), tables("big")
    assert (little, big) == (6, 1) and a == b


def test_inflate_column(spark):
    rows = [(1, b"a\0\4", 6), (1, b"a\0\4", 7), (5, b"no gzip", 3), (16, b"no zstd", 3), (2, b"x", 1), (1, None, 1), (1, b"", 0)]
    df = spark.createDataFrame(rows, "c int, p binary, n int").repartition(1)
    got = [r[0] for r in df.select(codec.inflate_column(F.col("c"), F.col("p"), F.col("n"))).collect()]
    by = {(r["content"] and bytes(r["content"]), (r["error"] or "")[:7]) for r in got}
    assert (b"a\0\0\0\0\0", "") in by and (None, "corrupt") in by and (None, "unsuppo") in by and (None, "") in by and (b"", "") in by
    assert sum(r["error"] is not None for r in got) == 4


def test_not_a_cdf():
    with pytest.raises(ValueError):
        Parser(Memory(b"hello world"))


def test_latin1():
    assert decode_text("©æ".encode("latin-1")) == "©æ" and decode_text("社安".encode()) == "社安"


def test_builder_rules():
    b = Builder()
    b.add_variable("x", [1, 2, 3])
    with pytest.raises(ValueError):
        b.add_variable("x", [1])
    with pytest.raises(ValueError):
        b.add_variable("", [1])
    with pytest.raises(ValueError):
        b.set_values("x", [100000])
    with pytest.raises(ValueError):
        b.set_values("x", [[1, 2]])
    b.set_values("x", [1.5, 2.5], force=True)
    assert b.variables["x"].type == "CDF_DOUBLE"
    with pytest.raises(ValueError):
        b.add_variable("z", [1], compression="zstd")
    b.add_variable("t", [datetime(2020, 1, 1)], attributes={"empty": ""})
    p = Parser(Memory(b.to_bytes()))
    assert [e.value for v in p.file.variables for _, e in p.attributes_of(v)] == [""]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("cdf")
    (d / "a.cdf").write_bytes(golden("none", "gzip", 500))
    (d / "b.cdf").write_bytes(golden("gzip"))
    (d / "not_a_cdf.cdf").write_bytes(b"nothing here")
    return str(d)


@pytest.mark.parametrize("table", list(reader.SCHEMAS))
def test_both_readers_agree(spark, folder, table):
    reader.register(spark)
    a = reader.read_cdf(spark, folder, table)
    b = spark.read.format("cdf").option("table", table).option("partitionBytes", "1000").load(folder)
    key = lambda r: str([v for k, v in r.asDict().items() if k != "file_id"])
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
    assert a.count() > 0


def test_variables_option(spark, folder):
    reader.register(spark)
    r = spark.read.format("cdf").option("variables", "var,bytes").load(folder)
    assert {x.variable: x.n for x in r.groupBy("variable").agg(F.count("*").alias("n")).collect()} == {"var": 202, "bytes": 20}
    assert r.rdd.getNumPartitions() >= 4


def test_record_range_skips_blocks(spark, folder):
    reader.register(spark)
    opened = lambda **o: spark.read.format("cdf").option("variables", "zeros,var_string").option("partitionBytes", "1").options(**o).load(folder + "/a.cdf")
    few = opened(firstRecord="100", lastRecord="130")
    assert few.rdd.getNumPartitions() < opened().rdd.getNumPartitions() / 5
    assert sorted(r.rec for r in few.where("variable = 'zeros'").collect()) == list(range(100, 131))
    assert few.where("variable = 'var_string'").count() == 1


def test_time_series(spark, folder):
    records, variables = (reader.read_cdf(spark, folder, n, pattern="a.cdf") for n in ("records", "variables"))
    w = reader.time_series(records, variables, ["tt2000", "var", "epoch16"]).orderBy("rec").collect()
    assert len(w) == 101 and w[0]["var"] == 1.0 and w[1]["epoch16"].seconds == 62167219200.0 + 15552000
    with pytest.raises(ValueError):
        reader.time_series(records, variables, ["absent"])


def test_sink(spark, tmp_path):
    reader.register(spark)
    path = str(tmp_path / "out")
    df = spark.range(50).select(F.col("id").alias("rec"), (F.col("id") * 2).alias("n"), F.array(F.col("id") * 1.0, F.lit(1.0)).alias("pair"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("s"))
    df.repartition(3).write.format("cdf").option("variableCompression", "gzip").option("type.n", "CDF_INT4").mode("append").save(path)
    back = spark.read.format("cdf").load(path)
    assert {r.cdf_type for r in reader.read_cdf(spark, path, "variables").where("name = 'n'").collect()} == {"CDF_INT4"}
    assert {r.compression for r in reader.read_cdf(spark, path, "variables").collect()} == {"gzip"}
    own = lambda n, c, i=0: F.first(F.when(F.col("variable") == n, F.get(c, i)), ignorenulls=True)
    got = back.groupBy("file_id", "rec").agg(own("n", "v_long").alias("n"), own("pair", "v_double").alias("p"), own("s", "v_str").alias("s")).collect()
    assert sorted((r.n, r.p, r.s) for r in got) == sorted((2 * i, float(i), f"s{i}") for i in range(50))


def test_to_cdf_fills_nulls(spark):
    df = spark.createDataFrame([("f", 0, 1.5), ("f", 1, None)], "k string, rec int, v double")
    raw = bytes(writer.to_cdf(df, "k").first().content)
    p = Parser(Memory(raw))
    assert p.values(p.file.variables[0])[1].tolist() == [1.5, -1e31]


def test_catalog(spark, folder):
    v, a, g, f = (reader.read_cdf(spark, folder, n, pattern="a.cdf") for n in ("variables", "variable_attrs", "global_attrs", "files"))
    names = lambda d, c="name": sorted(r[c] for r in d.collect())
    assert names(catalog.filter_variables(v, "var[25]d")) == ["var2d_counter", "var5d_counter"]
    assert names(catalog.filter_variables(v, None)) == [] and names(catalog.filter_variables(v, lambda n: n.startswith("ep"))) == ["epoch", "epoch16"]
    assert names(catalog.search_variables(v, a, "DEPEND0")) == ["var"]
    assert names(catalog.search_globals(g, "HELLO"), "attr") == ["attr_multi"] * 3
    with pytest.raises(KeyError):
        catalog.lookup(v, "absent")
    assert "var" not in names(catalog.remove(v, "var"))
    with pytest.raises(TypeError):
        catalog.matches(F.lit("x"), 3)
    text = catalog.skeleton(f, v, a, g).first().skeleton
    assert "compression: none" in export.skeleton_yaml(text) and '"attr1"' in text


def test_diff_order(spark):
    var = "name string, shape array<int>, type_name string, is_nrv boolean, grp string"
    a = spark.createDataFrame([("B", [3], "CDF_FLOAT", False, "data"), ("gone", [1], "CDF_INT4", False, "data"), ("same", [1], "CDF_INT4", False, "data")], var)
    b = spark.createDataFrame([("B", [4], "CDF_DOUBLE", True, "data"), ("new", [1], "CDF_INT4", False, "data"), ("same", [1], "CDF_INT4", False, "data")], var)
    at, gt = "name string, attr string, text string", "attr string, entry_index int, text string"
    aa = spark.createDataFrame([("B", "UNITS", "nT"), ("B", "FILLVAL", "x")], at)
    ba = spark.createDataFrame([("B", "UNITS", "T"), ("B", "SCALE", "y")], at)
    ga = spark.createDataFrame([("TimeRes", 0, "1s"), ("TimeRes", 1, "3s")], gt)
    gb = spark.createDataFrame([("TimeRes", 0, "1s"), ("TimeRes", 1, "5s"), ("TimeRes", 2, "10s")], gt)
    m, n = diff.Model(a, aa, ga), diff.Model(b, ba, gb)
    assert {r.status: r.n for r in diff.diff_summary(m, n).collect()} == {"changed": 2, "added": 1, "removed": 1}
    lines = [(r.kind, r.item, r.detail) for r in diff.ordered(diff.diff_lines(m, n)).collect()]
    assert lines == [
        ("section", None, None), ("item", "TimeRes", None), ("detail", "TimeRes", "[1]"), ("detail", "TimeRes", "[2]"),
        ("section", None, None), ("item", "B", None), ("detail", "B", "shape"), ("detail", "B", "type"), ("detail", "B", "isNrv"),
        ("detail", "B", "FILLVAL"), ("detail", "B", "SCALE"), ("detail", "B", "UNITS"), ("item", "new", None), ("item", "gone", None),
    ]
    assert diff.diff_summary(m, m).count() == 0
