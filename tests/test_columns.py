"""Streams over columns: rows travel packed, and the sticky query's joins broadcast nothing."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbside.plans import streams
from kerbside.streaming import monitors, ordered

SF = "/root/testdata/sf0.001"


def test_rows_go_packed_to_stateful_processors(spark):
    df = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).cast("int").alias("k"), "id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("h"), "id")).alias("h"), (F.col("id") % 2 == 0).alias("even"))
    found = ordered.packed(df.coalesce(2), "k").collect()
    assert len(found) == 6 and {r.k for r in found} == {None, 1, 2}
    back = [(r.k, *row.values()) for r in found for row in pa.ipc.open_stream(bytes(r.data)).read_all().to_pylist()]
    assert sorted(back, key=lambda r: r[1]) == [tuple(r) for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("make", [
    lambda s: monitors.sticky_stream(s.selectExpr("camera_id", "ts_ms frame_id", "cast(null as string) hazards")),
    lambda s: monitors.gap_stream(s),
    lambda s: monitors.rate_stream(s),
    lambda s: monitors.radar_stream(s.withColumn("frame_id", F.col("ts_ms")), s.withColumn("sweep_id", F.col("ts_ms"))),
    lambda s: monitors.track_stream(s.selectExpr("camera_id", "ts_ms frame_id", "1 label", "0.5D confidence", "1 xmin", "1 ymin", "9 xmax", "9 ymax")),
])
def test_stateful_streams_take_packed_rows(spark, tmp_path, make):
    stream = make(spark.readStream.schema("camera_id int, ts_ms long").parquet(str(tmp_path)))
    assert "data#" in stream._jdf.queryExecution().logical().toString().split("TransformWithStateInPySpark")[-1]


def test_the_sticky_query_broadcasts_no_frames(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    plans = []

    def kept(df, *_, **__):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        raise InterruptedError

    monkeypatch.setattr(streams, "as_stream", kept)
    try:
        with pytest.raises(InterruptedError):
            streams.hazards_sticky_stream(spark, SF)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [line for line in plans[0].splitlines() if "BroadcastHashJoin" in line and "frame_id" in line]


@pytest.mark.parametrize("kinds", [None, ("skew",), ("missing",)])
def test_radar_rows_of_other_kinds_are_left_out(spark, tmp_path, kinds):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitors.STATE_STORE)
    schema = "camera_id int, side int, ts_ms long, id long, mark string"
    rows = [(0, 1, 40 * k, k, None) for k in range(1, 200)] + [(0, 0, 50 * k, k, None) for k in (*range(1, 40), *range(90, 160))] + [(0, 1, 9000, None, "end")]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    made = monitors.radar_stream(s.filter("side = 1").withColumnRenamed("id", "frame_id"), s.filter("side = 0").withColumnRenamed("id", "sweep_id").drop("mark"), 400, 100, 1000, 10, 300, kinds)
    found = []
    made.writeStream.foreachBatch(lambda df, n: found.extend(df.collect())).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    counts = {k: len([r for r in found if r.kind == k]) for k in ("frame", "skew", "missing")}
    want = {"frame": 199, "skew": 3, "missing": 5}  # stretches 2 to 4 without sweeps; 56 frames there and the first one lack a sweep of the last 300 ms
    assert counts == {k: n if kinds is None or k in kinds else 0 for k, n in want.items()}, counts


def test_rows_are_in_order_with_nulls_first():
    rng = random.Random(1)
    for nulls in (0, 0.3):
        rows = [(rng.randint(0, 9), *(None if rng.random() < nulls else rng.randint(0, 3) for _ in range(3))) for _ in range(500)]
        assert ordered.in_order(rows) == sorted(rows, key=lambda row: [(x is not None, x) for x in row])
