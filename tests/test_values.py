import math

import duckdb
import pytest
from pyspark.sql import functions as F

from fluxgate.functions import arrays, levels, text
from fluxgate.operators import joins, masking, reduce
from fluxgate.plans import values
from fluxgate.plans.registry import ORACLES
from fluxgate.sources import codec


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def arr(*x):
    return F.array(*[F.lit(v) for v in x])


def test_mask(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, -1e31, 5.0, 200.0, -200.0, math.nan, math.inf])], "i int, v double")
    got = [r.m for r in df.select("i", masking.quality_mask(F.col("v"), -1e31, -100, 100).alias("m")).orderBy("i").collect()]
    assert got == [1.0, None, 5.0, None, None, None, None]


def test_decimation_keeps_spikes(spark):
    y = [((i % 10) - 5.0) for i in range(1000)]
    df = spark.createDataFrame([(i, float(i), v) for i, v in enumerate(y)], "rec long, x double, y double")
    got = {r.y for r in reduce.decimate_minmax(df, 50).collect()}
    assert {-5.0, 4.0} <= got
    assert reduce.decimate_minmax(df.limit(3), 50).count() == 3


def test_buckets_match_double_floors(spark):
    for n, cols in ((4853, 97), (1000, 37), (99991, 333)):
        rows = spark.range(n).select(F.col("id"), reduce.bucket_of(F.col("id"), F.lit(n).cast("bigint"), cols).alias("c")).collect()
        b = n / cols
        assert all(math.floor(r.c * b) <= r.id < math.floor((r.c + 1) * b) for r in rows)


def test_empty_bucket_gives_a_gap(spark):
    df = spark.range(100).select(F.col("id").alias("rec"), F.col("id").cast("double").alias("x"), F.when(F.col("id") >= 50, 1.0).alias("y"))
    got = sorted(tuple(r) for r in reduce.decimate_minmax(df, 4).collect())
    assert got == [(0, 0.0, None), (25, 25.0, None), (50, 50.0, 1.0), (75, 75.0, 1.0)]


def test_edges(spark):
    got = one(spark, arrays.cell_edges(arr(1.0, 2.0, 3.0)), arrays.cell_edges(arr(1.0, 10.0, 100.0), True), arrays.cell_edges(arr(5.0)))
    assert got[0] == [0.5, 1.5, 2.5, 3.5] and got[2] == [4.5, 5.5]
    assert got[1][1:3] == pytest.approx([10**0.5, 1000**0.5])


def test_log_edges_beside_zero(spark):
    got = one(spark, *[arrays.cell_edges(arr(*x), True) for x in ([0.0, 4.0, 9.0, 0.0], [4.0, 0.0], [0.0, 0.0], [4.0, -0.0], [4.0, 0.0, 9.0], [0.0])])
    assert str(got) == str(([math.nan, 0.0, 6.0, 0.0, math.nan], [math.inf, 0.0, math.nan], [math.nan, 0.0, math.nan], [-math.inf, -0.0, math.nan], [math.inf, 0.0, 0.0, math.inf], [0.0, 0.0]))


def test_log_edges_beside_zero_equal_sql(spark, tmp_path):
    series = [[0.0, 4.0, 9.0], [9.0, 4.0, 0.0], [4.0, 0.0], [0.0, 0.0], [4.0, 0.0, 9.0], [0.0], [-4.0, 4.0], [4.0, None, 0.0], [math.inf, 0.0], [math.nan, 0.0], [1e-200, 1e-200], [1e200, 0.0]]
    rows = [(10 * u + i, u, v) for u, s in enumerate(series) for i, v in enumerate(s)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = values.cell_edges_log(spark, str(tmp_path)).select("user_id", "edges").collect()
    duck = duckdb.connect()
    duck.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = duck.execute(ORACLES["cell_edges_log"]).fetchall()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want)) and len(got) == len(series)


def test_monotonic(spark):
    got = one(spark, *[arrays.is_monotonic(arr(*x)) for x in ([1, 2, 3], [3, 2, 1], [1, 1, 2], [1, 3, 2], [1])])
    assert got == (True, True, False, False, True)


def test_indices(spark):
    got = one(spark, arrays.flat_index(arr(1, 2), arr(3, 4)), arrays.inverted_flat_index(arr(1, 2), arr(3, 4)), arrays.flat_index(arr(1, 1, 1, 1), arr(2, 3, 4, 5)), arrays.inverted_flat_index(arr(1, 1, 1, 1), arr(2, 3, 4, 5)))
    assert got == (7, 6, 33, 86)


def test_row_major(spark):
    assert one(spark, arrays.to_row_major(arr(1, 2, 3, 4, 5, 6), (2, 3))) == ([1, 3, 5, 2, 4, 6],)


def test_chunks(spark):
    assert one(spark, arrays.chunk_records(arr(1, 2, 3, 4, 5, 6, 7), 3), arrays.chunk_records(arr(1, 2), 0)) == ([[1, 2, 3], [4, 5, 6], [7]], [[1, 2]])


def test_levels(spark):
    v = lambda *x, log=False: levels.normalize_level(*[F.lit(float(i)) for i in x], log)
    assert one(spark, v(50, 0, 100), v(10, 1, 100, log=True), v(0, 1, 100, log=True)) == (0.5, 0.5, None)
    low, high, out = one(spark, *[levels.viridis(F.lit(x)) for x in (0.0, 1.0, 2.0)])
    assert (tuple(low), tuple(high), tuple(out)) == ((68, 1, 84), (253, 231, 37), (253, 231, 37))


def test_text(spark):
    got = one(spark, text.split_fixed(F.lit("He\0\0\0W\0\0\0\0"), 5), text.repair_latin1(F.lit("é".encode("latin-1"))), text.repair_latin1(F.lit("é".encode())), text.csv_line([F.lit("a,b"), F.lit('q"'), F.lit(None)]), text.var_group(F.lit(" Support_DATA")))
    assert got == (["He", "W"], "é", "é", '"a,b","q""",', "support_data")


def test_oversize_text_raises(spark):
    with pytest.raises(Exception, match="longer"):
        spark.range(1).select(text.pad(F.lit("abc"), 2)).collect()


def test_yaml():
    got = text.to_yaml({"a": "123", "b": "x: y", "c": math.nan, "d": [1, 2.5], "e": {}, "f": {"g": None}, "h": [{"i": 1, "j": []}], "k": True, "l": "plain"})
    assert got == 'a: "123"\nb: "x: y"\nc: .nan\nd: [1, 2.5]\ne: {}\nf:\n  g: null\nh:\n  - i: 1\n    j: []\nk: true\nl: plain\n'


@pytest.mark.parametrize(("raw", "packed"), [([0, 1, 2, 3, 4, 5], [0, 0, 1, 2, 3, 4, 5]), ([0, 0, 0, 0, 1], [0, 3, 1]), ([1, 2, 0, 0, 0, 0, 3], [1, 2, 0, 3, 3]), ([0] * 256, [0, 255])])
def test_rle(raw, packed):
    assert list(codec.rle_deflate(bytes(raw))) == packed
    assert list(codec.rle_inflate(bytes(packed))) == raw


def test_rle_limits():
    for n in (257, 300):
        assert codec.rle_inflate(codec.rle_deflate(bytes(n))) == bytes(n)
    assert codec.rle_inflate(bytes([1, 2, 0])) == bytes([1, 2])
    assert len(codec.rle_inflate(bytes([0, 255]), 6)) == 6


def test_corrupt_block_raises():
    with pytest.raises(Exception):
        codec.inflate(codec.GZIP, b"not gzip", 10)
    with pytest.raises(ValueError):
        codec.inflate(codec.RLE, b"\1\2", 10)


def test_clone_guards_names(spark):
    a = spark.createDataFrame([("f", "x")], "file_id string, name string")
    assert joins.clone_rows(a, spark.createDataFrame([("f", "y")], a.schema)).count() == 2
    with pytest.raises(Exception, match="exists"):
        joins.clone_rows(a, a).collect()


def test_preview_is_top_k(spark, capsys):
    reduce.preview(spark.range(100).withColumnRenamed("id", "rec")).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_gates(spark):
    shape = lambda *x: F.array(*[F.lit(i) for i in x])
    got = one(spark, masking.plot_refusal(shape(3), F.lit("CDF_CHAR")), masking.plot_refusal(shape(0, 2), F.lit("CDF_DOUBLE")), masking.plot_refusal(shape(5, 2), F.lit("CDF_DOUBLE")), masking.display_kind(shape(5, 9), F.lit(None).cast("string")), masking.display_kind(shape(5, 9), F.lit(None).cast("string"), "line"))
    assert got[0].startswith("character") and got[1].startswith("no records") and got[2:] == (None, "spectrogram", "line")


def test_yaml_is_read_back():
    """Any text comes back from a YAML reader as itself, in a block and in a flow list."""
    import random

    import yaml

    r = random.Random(7)
    odd = ["", " ", "~", "null", "Null", "yes", "NO", "on", "1", "-1.5e3", "0x1F", "0o17", ".inf", "-.INF", ".nan", "1:30", "1_000", "2001-01-01", "---", "--- a", "...", "-", "- a", "-a", "? b", "?b", ":", "a:", "a: b", "a:b", "a #b", "a#b", "#", "[a", "a]", "{", "a,b", "&x", "*x", "!x", "|", ">", "'", "\"", "%", "@", "`", "a\tb", "a\nb", "\r", "\x07", "\x85", "\u2028", "\ufeff", "é", "\U0001f600", "=", "<<", "back\\slash", " lead", "trail ", "a'b", "a b  c"]
    odd += ["".join(r.choice("ab1 :#-?,[]{}'\"\\\t.~=é") for _ in range(r.randrange(1, 7))) for _ in range(3000)]
    value = {"list": odd, "map": {f"k{i}": x for i, x in enumerate(odd)}, "nested": [{"a": [1, 2.5, None, True], "b": {"c": []}}, [["x"], []]], "e": {}}
    assert yaml.safe_load(text.to_yaml(value)) == value
    keys = {x: i for i, x in enumerate(odd)}
    assert yaml.safe_load(text.to_yaml(keys)) == keys


def test_rle_against_a_loop():
    import random

    from fluxgate.sources.codec import rle_deflate, rle_inflate

    def packed(raw):
        out, i = bytearray(), 0
        while i < len(raw):
            n = 0
            while n < 256 and i + n < len(raw) and raw[i + n] == 0:
                n += 1
            out += bytes((0, n - 1)) if n else raw[i : i + 1]
            i += n or 1
        return bytes(out)

    r = random.Random(1)
    cases = [b"", b"\0", b"\0\0", b"a", b"\0" * 256, b"\0" * 257, b"\0" * 512, b"a" + b"\0" * 1000 + b"b"]
    cases += [bytes(r.choice([0, 0, 1, 255]) for _ in range(r.randrange(40))) for _ in range(500)]
    cases += [b"".join(bytes(r.choice([0, 1, 2, 255, 256, 257, 600])) + bytes([r.randrange(1, 256)]) * r.randrange(3) for _ in range(8)) for _ in range(100)]
    for raw in cases:
        assert rle_deflate(raw) == packed(raw) and rle_inflate(packed(raw)) == raw
        assert rle_inflate(packed(raw), len(raw) // 2) == raw[: len(raw) // 2]
    assert rle_inflate(b"a\0") == b"a" and rle_inflate(b"\0\0\0") == b"\0"
