"""Cumulative frames from pairs that come in any batches: tables and keyed state against the whole batch."""

import random

import pytest
from pyspark.sql import functions as F

from voxlattice.streaming import frames

SCHEMA = "frame long, node_id long, u double"
REF = {1: 0, 2: 1, 3: 1, 4: 3}


@pytest.fixture(scope="module")
def schedule(spark):
    return spark.createDataFrame(list(REF.items()), "frame long, ref long")


def whole(pairs):
    u, out = {(f, n): v for f, n, v in pairs}, {}
    for f, n in u:
        chain = [f]
        while REF[chain[-1]]:
            chain.append(REF[chain[-1]])
        if all((g, n) in u for g in chain):
            out[f, n] = sum(u[g, n] for g in chain)
    return out


def stored(spark, folder):
    rows = spark.read.schema("node_id long, u_total double, frame long").parquet(f"{folder}/total").collect()
    out = {(r["frame"], r["node_id"]): r["u_total"] for r in rows}
    assert len(out) == len(rows)
    return out


def test_a_frame_in_two_batches_loses_nothing(spark, schedule, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    frames.advance(make([(1, 10, 1.0), (2, 10, 2.0)]), schedule, f"{tmp_path}/a")
    frames.advance(make([(2, 11, 5.0)]), schedule, f"{tmp_path}/a")
    assert stored(spark, f"{tmp_path}/a") == {(1, 10): 1.0, (2, 10): 3.0}
    assert [tuple(r) for r in frames.waiting(spark, f"{tmp_path}/a").collect()] == [(2, 11, 5.0)]
    frames.advance(make([(1, 11, 4.0), (1, 10, 9.0)]), schedule, f"{tmp_path}/a")  # a stored pair stays
    got = stored(spark, f"{tmp_path}/a")
    assert got == {(1, 10): 1.0, (2, 10): 3.0, (1, 11): 4.0, (2, 11): 9.0} and frames.waiting(spark, f"{tmp_path}/a").count() == 0
    expected = spark.createDataFrame([(1, 2), (2, 2), (3, 1)], "frame long, nodes long")
    total = spark.createDataFrame([(f, n) for f, n in got], "frame long, node_id long")
    assert sorted(map(tuple, frames.complete(total, expected).collect())) == [(1, 2, True), (2, 2, True), (3, 0, False)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_any_split_equals_the_batch(spark, schedule, tmp_path, seed):
    rng = random.Random(seed)
    pairs = [(f, n, float(rng.randint(1, 9))) for f in REF for n in range(5) if rng.random() > 0.15]
    rng.shuffle(pairs)
    cuts = sorted(rng.sample(range(1, len(pairs)), 2))
    for a, b in zip([0, *cuts], [*cuts, len(pairs)]):
        frames.advance(spark.createDataFrame(pairs[a:b] + pairs[:1], SCHEMA), schedule, f"{tmp_path}/a")
    assert stored(spark, f"{tmp_path}/a") == whole(pairs)
    left = {(r["frame"], r["node_id"]) for r in frames.waiting(spark, f"{tmp_path}/a").collect()}
    assert left == {(f, n) for f, n, _ in pairs} - set(whole(pairs))


def test_a_frame_outside_the_schedule_waits(spark, schedule, tmp_path):
    frames.advance(spark.createDataFrame([(9, 1, 1.0), (1, 1, 1.0)], SCHEMA), schedule, f"{tmp_path}/a")
    assert [tuple(r) for r in frames.waiting(spark, f"{tmp_path}/a").collect()] == [(9, 1, 1.0)]


def test_state_by_node_and_a_restart(spark, schedule, tmp_path):
    rng = random.Random(8)
    pairs = [(f, n, float(rng.randint(1, 9))) for f in REF for n in range(6) if rng.random() > 0.15]
    rng.shuffle(pairs)
    half = len(pairs) // 2
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (pairs[:half], pairs[half:]):
            spark.createDataFrame(part, SCHEMA).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            frames.totals(stream, schedule).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.read.parquet(f"{tmp_path}/out").groupBy("frame", "node_id").agg(F.count("*").alias("k"), F.max("u_total").alias("t")).collect()
    assert all(r["k"] == 1 for r in rows) and {(r["frame"], r["node_id"]): r["t"] for r in rows} == whole(pairs)
