from fluxgate.sources.build import Builder
from fluxgate.streaming.arrivals import stream_cdf


def test_arrivals(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()

    def drop(name, values):
        b = Builder()
        b.add_variable("x", values)
        (folder / f"{name}.cdf").write_bytes(b.to_bytes())

    drop("a", [1, 2, 3])
    q = stream_cdf(spark, str(folder), files_per_batch=1).writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    assert spark.table("arrived").count() == 3
    drop("b", [4, 5])
    drop("c", [6])
    q.processAllAvailable()
    q.stop()
    assert sorted(v for r in spark.table("arrived").collect() for v in r.v_long) == [1, 2, 3, 4, 5, 6]
