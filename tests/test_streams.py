"""Streams against one pass in order: late rows, any cut into micro-batches, a restart from state of an older schema."""

import pickle
import random
import time
import uuid
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from kerbside.operators import tracker
from kerbside.sources.scratch import folder
from kerbside.streaming import monitors
from tests.test_operators import busy, single_pass


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitors.STATE_STORE)


def through(spark, make, batches, schema, log=None):
    """The rows that the stream make(source) puts out for these batches of rows, one micro-batch each."""
    base = f"{folder(spark)}/stream-{uuid.uuid4().hex}"
    source = log or f"{base}/in"
    out = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        query = stream.writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).outputMode("append").option("checkpointLocation", f"{source}-log").trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def dealt(rows, rng, delay, order, parts=4):
    """rows in batches such that none is delay or more behind: sorted by order plus a random lag below delay."""
    lagged = sorted(rows, key=lambda r: r[order] + rng.random() * 0.4 * delay)
    size = -(-len(lagged) // parts)
    return [lagged[k : k + size] for k in range(0, len(lagged), size)]


def test_sticky_rows_do_not_depend_on_micro_batches(spark):
    rng = random.Random(3)
    rows = [(c, f, f"h{f}" if f % 6 == 5 else None, None) for c in range(2) for f in range(1, 120)]
    want = Counter((c, f, f"h{f - (f + 1) % 6}" if f >= 5 else "") for c, f, _, _ in rows)
    schema = "camera_id int, frame_id long, hazards string, mark string"
    ends = [(c, 119, None, "end") for c in range(2)]
    for seed in (1, 2):
        found = through(spark, lambda s: monitors.sticky_stream(s, 30), [*dealt(rows, random.Random(seed), 30, 1), ends], schema)
        assert Counter((r.camera_id, r.frame_id, r.hazards) for r in found if r.kind == "frame") == want
        assert not [r for r in found if r.kind == "late"]
    late = [(0, 3, "h3", None), (0, 118, None, None)]
    found = through(spark, lambda s: monitors.sticky_stream(s, 30), [[r for r in rows if r[0] == 0], late, ends], schema)
    assert [(r.frame_id, r.hazards) for r in found if r.kind == "late"] == [(3, None)]  # 118 still waits and comes twice
    assert Counter((r.frame_id, r.hazards) for r in found if r.kind == "frame") == Counter((f, h) for c, f, h in want if c == 0) + Counter([(118, "h113")])


def test_radar_stream_with_late_sweeps(spark):
    frames = [(0, 1, 40 * k, k, None) for k in range(1, 200)]
    sweeps = [(0, 0, 50 * k + 3, k, None) for k in range(1, 160) if not 40 <= k < 60]
    schema = "camera_id int, side int, ts_ms long, id long, mark string"
    make = lambda s: monitors.radar_stream(s.filter("side = 1").withColumnRenamed("id", "frame_id"), s.filter("side = 0").withColumnRenamed("id", "sweep_id").filter("mark is null"), 400, 100, 1000, 10, 300)
    newest = lambda ts: max(((t, k) for _, _, t, k, _ in sweeps if t <= ts), default=(None, None))
    want, stretch, lost, alerts = [], None, 0, []
    for _, _, ts, f, _ in frames:
        at, k = newest(ts)
        skew = None if at is None else ts - at
        want.append((f, k, skew))
        if skew is not None and skew > 100 and ts // 1000 != stretch:
            stretch = ts // 1000
            alerts.append(("skew", f, None, 324))
        if skew is None or skew > 300:
            lost += 1
            if lost % 10 == 0:
                alerts.append(("missing", f, lost, 323))
    assert alerts
    for seed in (5, 6):
        batches = [*dealt(frames + sweeps, random.Random(seed), 400, 2), [(0, 1, 40 * 200, None, "end")]]
        found = through(spark, make, batches, schema)
        assert sorted((r.frame_id, r.sweep_id, r.skew_ms) for r in found if r.kind == "frame") == want
        assert sorted((r.kind, r.frame_id, r.lost, r.code) for r in found if r.kind in ("skew", "missing")) == sorted(alerts)
    found = through(spark, make, [[r for r in frames + sweeps if r[2] < 6000], [(0, 0, 1003, 77, None), (0, 1, 1004, 25, None)], [r for r in frames + sweeps if r[2] >= 6000], [(0, 1, 8000, None, "end")]], schema)
    assert sorted((r.frame_id or 0, r.sweep_id or 0, r.ts_ms) for r in found if r.kind == "late") == [(0, 77, 1003), (25, 0, 1004)]
    assert sorted((r.frame_id, r.sweep_id, r.skew_ms) for r in found if r.kind == "frame") == want


def test_rate_stream_closes_empty_windows_by_a_clock(spark):
    schema = "camera_id int, ts_ms long, mark string"
    first = [(0, 1000 * k, None) for k in range(1, 9)]
    found = through(spark, lambda s: monitors.rate_stream(s, 5, 2000), [first, [(0, 23_000, "clock")], [(0, 2500, None)], [(0, 23_000, None), (0, 30_000, "end")]], schema)
    assert sorted((r.window_start, r.fps) for r in found if r.kind == "rate") == [(0, 0.8), (5000, 0.8), (10_000, 0.0), (15_000, 0.0), (20_000, 0.2), (25_000, 0.0), (30_000, 0.0)]
    assert sorted(r.window_start for r in found if r.kind == "none") == [10_000, 15_000, 25_000, 30_000]
    assert [r.window_start for r in found if r.kind == "late"] == [2500]


class PickledTracker(monitors.TrackProcessor):
    """State of version 1."""

    def init(self, handle):
        self.old = handle.getValueState("tracker", StructType([StructField("data", BinaryType())]))

    def handleInputRows(self, key, rows, timerValues):
        found = pd.concat(list(rows)).sort_values(["frame_id", "xmin", "ymin", "label"])
        one = tracker.CameraTracker(self.params)
        for frame, d in found.groupby("frame_id", sort=True):
            one.skip_to(int(frame))
            one.step(int(frame), np.column_stack([d.xmin, d.ymin, d.xmax - d.xmin, d.ymax - d.ymin]).astype(float), d.confidence.to_numpy(float), d.label.to_numpy(int))
        self.old.update((pickle.dumps(one),))
        yield pd.DataFrame({"camera_id": [0], "frame_id": [0], "track_id": pd.array([None], "Int64"), "det_x": [0.0], "det_y": [0.0], "has_point": [False], "kind": ["old"]})


@pytest.mark.parametrize("old", [False, True])
def test_track_stream_goes_on_after_a_restart(spark, old):
    """From its own state, and from state of the schema before it."""
    rows = busy(2, 240, (1, 200))
    parts = [[r for r in rows if a <= r[1] < b] for a, b in ((0, 100), (100, 170), (170, 241))]
    schema = "camera_id int, frame_id long, label int, confidence double, xmin int, ymin int, xmax int, ymax int"
    log = f"{folder(spark)}/tracks-{uuid.uuid4().hex}"
    kinds = "camera_id int, frame_id long, track_id long, det_x double, det_y double, has_point boolean, kind string"
    before = lambda s: s.groupBy("camera_id").transformWithStateInPandas(PickledTracker(tracker.TrackParams()), kinds, "Append", "None")
    first = through(spark, before if old else monitors.track_stream, parts[:1], schema, log)
    found = first + through(spark, monitors.track_stream, parts[1:], schema, log)
    want = [(kind, f, key, p) for kind, f, key, _, _, p, _ in single_pass(rows, 240) if f >= 100 or not old]
    last = max(f for _, f, *_ in rows)
    assert sorted((r.kind, r.frame_id, r.track_id, r.has_point) for r in found if r.kind != "old") == sorted(x for x in want if x[1] <= last)


def test_rates_of_a_camera_that_falls_silent(spark):
    """Its waiting frames and windows of rate 0 are put out by the clock, with no row to move time on."""
    base = f"{folder(spark)}/rates-{uuid.uuid4().hex}"
    schema = "camera_id int, ts_ms long"
    spark.createDataFrame([(1, 100), (1, 2000)], schema).write.parquet(f"{base}/in")
    stream = monitors.rate_stream(spark.readStream.schema(schema).parquet(f"{base}/in"), 1, 5000, silent_ms=1000)
    query = stream.writeStream.format("memory").queryName("silent_rates").option("checkpointLocation", f"{base}/log").trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(240):
            found = {(r.window_start, r.fps) for r in spark.table("silent_rates").filter("kind = 'rate'").collect()}
            if len(found) >= 5:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert {(0, 1.0), (1000, 0.0), (2000, 1.0), (3000, 0.0), (4000, 0.0)} <= found
