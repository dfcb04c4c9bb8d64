"""What keeps queries within bounds on large tables: work is dealt out before rows become many, and no join broadcasts a side as large as its input."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import assignment, boxes, detections, images, ranges, tracker
from kerbside.plans import fixtures, geometry, scenes, tracks
from kerbside.sources import frames as frame_files
from kerbside.streaming import drain, monitors

SF = "/root/testdata/sf0.001"


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fx_frames", "fx_radar", "fx_detections", "fx_raw_outputs", "fx_pixels", "fx_detections_busy"])
def test_rows_are_dealt_out_before_they_become_many(spark, name):
    sizes = [r["count"] for r in fixtures.fixture(spark, SF, name).groupBy(F.spark_partition_id().alias("part")).count().collect()]
    assert len(sizes) > 1 and max(sizes) < sum(sizes)


@pytest.mark.parametrize("name", ["fx_frames", "fx_radar"])
def test_blocks_of_numbers_give_the_rows_of_the_sql(spark, monkeypatch, name):
    def rows():
        return sorted(tuple(r) for r in fixtures.fixture(spark, SF, name).collect())

    found = rows()
    monkeypatch.delitem(fixtures.IN_BLOCKS, name)
    assert found == rows()


@pytest.mark.parametrize("query", [geometry.keyed_union, geometry.keyed_subtract, geometry.iou_pairs, geometry.dedupe_overlaps, scenes.hazards_filtered, scenes.class_majority])
def test_large_sides_are_not_broadcast(spark, query):
    assert "BroadcastHashJoin" not in planned(query(spark, SF))


def test_detections_are_not_broadcast_by_the_tracker(spark):
    found = planned(tracker.track_segments(fixtures.fixture(spark, SF, "fx_detections"), 45))
    assert "BroadcastHashJoin" not in found or "BuildLeft" not in found


def test_ranges_broadcast_no_rows(spark):
    frames = fixtures.fixture(spark, SF, "fx_frames")
    for found in (ranges.previous(frames, "camera_id", "frame_id", 100, "p"), ranges.numbered(frames, "camera_id", "frame_id", 100, "k")):
        assert "BuildLeft" not in planned(found)
    assert ranges.numbered(frames, "camera_id", "frame_id", 100, "k").filter("k <> frame_id").count() == 0


def test_small_clusters_are_settled_together_as_by_trying_all():
    rng, alike = np.random.default_rng(1), lambda x: len(set(x.tolist())) == len(x)
    for _ in range(100):
        shape = [(f, a, b) for f in range(3) for a in range(rng.integers(1, 5)) for b in range(4)]
        rows = [(*r, rng.random() + 0.01) for r in shape if rng.random() < 0.4]
        if not rows:
            continue
        frame, a, b, gain = (np.array(x) for x in zip(*rows))
        taken = assignment.settled(frame, a, b, gain)
        for f in set(frame.tolist()):
            own = np.flatnonzero(frame == f)
            most = 0.0
            for k in range(1, 5):
                for some in map(list, itertools.combinations(own.tolist(), k)):
                    if alike(a[some]) and alike(b[some]):
                        most = max(most, gain[some].sum())
            got = own[taken[own]]
            assert alike(a[got]) and alike(b[got]) and abs(gain[got].sum() - most) < 1e-9


def test_pixels_of_an_image_move_as_runs(spark):
    pixels = fixtures.fixture(spark, SF, "fx_pixels")
    plan = planned(images.packed(pixels))
    assert plan.index("MapInArrow", plan.index("Exchange hashpartitioning")) > 0  # the inner one is below the shuffle
    mixed = images.packed(pixels.repartition(7, "r", "c")).select("img_id", "image.height", "image.width", F.md5("image.data").alias("data"))
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, images.packed(pixels).select("img_id", "image.height", "image.width", F.md5("image.data").alias("data")).collect()))


def test_only_sampled_frames_meet_their_image(spark):
    plan = planned(scenes.image_health(spark, SF))
    assert "img_id" in plan and all("image" not in line for line in plan.splitlines() if "Window" in line)


def test_micro_batches_do_not_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(drain.cuts_of, "__defaults__", (3, 500))
    frames = fixtures.fixture(spark, SF, "fx_frames").select("camera_id", "frame_id")
    sizes = []
    stream = drain.as_stream(frames, "sizes", "frame_id")
    stream.writeStream.foreachBatch(lambda batch, k: sizes.append(batch.agg(F.count("*"), F.min("frame_id"), F.max("frame_id")).first())).trigger(availableNow=True).start().awaitTermination()
    assert sum(s[0] for s in sizes) == frames.count() and max(s[0] for s in sizes) < 700
    assert all(a[2] < b[1] for a, b in zip(sizes, sizes[1:]))


def test_parts_without_rows_keep_their_turn(spark):
    rows = spark.range(100).select(F.col("id").alias("k"))
    turns = []
    stream = drain.as_stream(rows, "turns", "k", cuts=[9, 200, 300])
    stream.writeStream.foreachBatch(lambda batch, k: turns.append(batch.count())).trigger(availableNow=True).start().awaitTermination()
    assert turns == [10, 90, 0, 0]


def test_rates_read_and_keep_their_window_once_for_all_rows():
    class Kept:
        def __init__(self, value=None):
            self.value, self.calls = value, 0

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    rates = monitors.RateProcessor(0, 5, None)
    rates.open, rates.time = Kept(), Kept((20_000, 20_000))
    out = rates.released([(ts,) for ts in range(0, 20_001, 40)])
    assert [r[:2] for r in out] == [(k * 5000, 25.0) for k in range(4)] and rates.open.value == (20_000, 1)
    assert rates.open.calls < 5


@pytest.fixture
def eager(spark):
    """Spark broadcasts what it may: its estimates of compressed files and of rows out of arrays are as low as this limit is high."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def broadcast_joins(df):
    return [line for line in planned(df).splitlines() if "BroadcastHashJoin" in line]


@pytest.mark.parametrize("name", ["track_points", "track_colors", "track_messages"])
def test_track_rows_are_not_broadcast(eager, monkeypatch, name):
    monkeypatch.setattr(tracks, "written", lambda df, _: df)  # with the tracker's last step in the plan
    monkeypatch.setattr(tracks, "_TRACKED", {})
    joins = broadcast_joins(tracks.QUERIES[name](eager, SF))
    assert all(c not in line for line in joins for c in ("track_id", "start_frame", "frame_id")), joins


def test_slices_broadcast_no_rows_of_a_camera(eager):
    frames = fixtures.fixture(eager, SF, "fx_frames").groupBy("camera_id").agg(F.max("frame_id").alias("last_frame"))
    joins = broadcast_joins(tracker._sliced(fixtures.fixture(eager, SF, "fx_detections").drop("vehicle_id"), frames, tracker.TrackParams(), tracker.SliceParams()))
    assert joins and all("segment" not in line and "BuildLeft" not in line for line in joins), joins


def test_image_files_share_bundles(spark, tmp_path):
    rng = np.random.default_rng(2)
    whole = {k: rng.integers(0, 256, (k + 1, 3, 3), np.uint8) for k in (0, 1, 3, 4)}
    made = [(k, ("", k + 1, 3, 3, 16, p.tobytes())) for k, p in whole.items()] + [(2, ("", 2, 2, 3, 16, b"abc")), (5, ("", 2, 2, 3, 16, None))]
    path = f"file://{tmp_path}/frames"
    index = frame_files.write_frame_bundles(spark.createDataFrame(made, "img_id long, " + frame_files.IMAGE).coalesce(1), path, images_a_file=4)
    assert len(list((tmp_path / "frames" / "bundles").iterdir())) == 2 and index.count() == 6
    good, bad = frame_files.read_frame_bundles(index, path)
    assert {r.id: (r.image.height, r.image.width, bytes(r.image.data)) for r in good.collect()} == {k: (k + 1, 3, p.tobytes()) for k, p in whole.items()}
    assert sorted((r.id, r.code) for r in bad.collect()) == [(2, 331), (5, 331)]


def test_pngs_that_are_broken_have_no_pixels():
    file = frame_files.png(np.arange(36, dtype=np.uint8).reshape(3, 4, 3))
    assert frame_files.unpng(file) == (3, 4, bytes(range(36)))
    broken = [file[:k] for k in range(len(file) - 8)] + [file[:50] + bytes([file[50] ^ 1]) + file[51:], b""]
    assert {frame_files.unpng(x) for x in broken} == {(-1, -1, b"")}


def test_decoding_is_compiled(spark):
    plan = planned(detections.decode_multilabel(fixtures.fixture(spark, SF, "fx_raw_outputs")))
    assert "lambda" not in plan and "posexplode" in plan


@pytest.mark.parametrize("query", [geometry.dequantize, geometry.decode_bestclass])
def test_decoding_is_compiled_and_writes_no_decimals(spark, query):
    found = planned(query(spark, SF))
    assert "lambdafunction" not in found and "transform(" not in found and "round(" not in found


def test_dequantized_values_are_those_of_the_array(spark):
    df = spark.createDataFrame([(1, [10, -20, 30]), (2, [5]), (3, None)], "k int, q array<tinyint>")
    array = {r.k: r.q for r in detections.dequantize(df, "q", 0.01).collect()}
    found = {r.k: list(r[1:]) for r in detections.dequantize(df, "q", 0.01, ("a", "b", "c")).collect()}
    assert found == {1: array[1], 2: [*array[2], None, None], 3: [None] * 3}


def test_rounded_goes_by_sql_rules(spark):
    values = [0.5, 1.5, 2.5, -0.5, -2.5, 0.49999999999999994, -0.49999999999999994, 2.0**52 - 0.5, 2.0**53 + 2, -1e300, math.inf, -math.inf, None]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").coalesce(1).select(boxes.rounded("v", 0)).collect()]
    assert found == [1.0, 2.0, 3.0, -1.0, -3.0, 0.0, 0.0, 2.0**52, 2.0**53 + 2, -1e300, math.inf, -math.inf, None]
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(float(v),) for v in np.concatenate([rng.normal(0, 300, 2000), rng.integers(-900, 900, 500) / 6])] + [(math.nan,)], "v double")
    assert df.filter(~F.round("v", 6).eqNullSafe(boxes.rounded("v", 6))).count() == 0


def test_pixels_are_put_together_before_they_go_to_python(spark):
    plan = planned(images.packed(fixtures.fixture(spark, SF, "fx_pixels")))
    assert "HashAggregate" in plan[plan.rindex("MapInArrow") :]


def test_odd_pixels_show_in_the_image(spark):
    image = lambda k, h, w: [(k, r, c, r, c, k or 0) for r in range(h) for c in range(w)]
    rows = image(1, 3, 37) + image(2, 2, 2) + image(2, 1, 1) + image(3, 2, 2)[:-1] + [(3, 1, 1, None, 0, 0)] + image(None, 1, 2)
    df = spark.createDataFrame(rows, "img_id long, r int, c int, b int, g int, rr int").repartition(3, "c")
    found = {r.img_id: r.image for r in images.packed(df).collect()}
    assert {k: (x.height, x.width, len(x.data)) for k, x in found.items()} == {1: (3, 37, 333), 2: (2, 2, 15), 3: (2, 2, 9), None: (1, 2, 6)}
    assert bytes(found[1].data) == bytes(v for r in range(3) for c in range(37) for v in (r, c, 1))


def test_images_scored_together_score_as_alone(spark):
    rng = np.random.default_rng(5)
    shapes = [(12, 16), (5, 9), (12, 16), (2, 2)] * 5
    pictures = [rng.integers(0, 256, (h, w, 3), dtype=np.uint8) // (1 + k % 7) for k, (h, w) in enumerate(shapes)]
    rows = [(k, ("", h, w, 3, 16, bytearray(pictures[k].tobytes()))) for k, (h, w) in enumerate(shapes)]
    df = spark.createDataFrame(rows, "img_id long, image struct<origin string, height int, width int, nChannels int, mode int, data binary>").coalesce(1)
    for r in images.score_images(df).collect():
        assert r.score == pytest.approx(float(images.METRICS[r.metric](pictures[r.img_id])), abs=1e-12)
    with pytest.raises(Exception, match="has 11 bytes"):
        images.score_images(spark.createDataFrame([(1, ("", 2, 2, 3, 16, bytearray(11)))], df.schema)).collect()
