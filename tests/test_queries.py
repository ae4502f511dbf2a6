"""The entry point, and that the registry is whole."""

import __spark_entry__ as e


def test_entry(spark):
    df = e.entry(spark)
    assert df.count() == 21 and "robust_std" in df.columns


def test_registry():
    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 100
    assert all(callable(f) for f in q.values())


def test_streaming_matches_batch(spark, sf, tmp_path):
    from voxlattice.sources.views import table
    from voxlattice.streaming.statistics import running

    t = table(spark, sf, "events").select("ts", "value", "event_type")
    t.write.parquet(f"{tmp_path}/in")
    s = running(spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in"), "ts", "value", "event_type", "1 day")
    s.writeStream.outputMode("complete").format("memory").queryName("seen").trigger(availableNow=True).start().awaitTermination(60)
    batch = running(t, "ts", "value", "event_type", "1 day")
    assert sorted((r["start"], r["event_type"], r["n"]) for r in spark.table("seen").collect()) == sorted((r["start"], r["event_type"], r["n"]) for r in batch.collect())
