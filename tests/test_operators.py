import itertools
import os
import random
import time
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbside.operators import assignment, boxes, detections, pairs, registry, tracker, trajectories, votes
from kerbside.sources.bundles import read_bundles
from kerbside.sources.frames import IMAGE, read_frames, split_decoded, write_frames
from kerbside.sources.scratch import folder
from kerbside.streaming import monitors
from kerbside.streaming.drain import as_stream, drained


def test_assignment_equals_brute_force():
    rng = random.Random(5)
    for _ in range(200):
        n, m = rng.randint(1, 5), rng.randint(1, 5)
        gain = np.array([[rng.randint(-3, 9) for _ in range(m)] for _ in range(n)], float)
        best = 0
        for k in range(min(n, m) + 1):
            for rows in itertools.combinations(range(n), k):
                for cols in itertools.permutations(range(m), k):
                    best = max(best, sum(gain[r, c] for r, c in zip(rows, cols)))
        pairs = assignment.solve(gain)
        assert len({r for r, _ in pairs}) == len({c for _, c in pairs}) == len(pairs)
        assert sum(gain[r, c] for r, c in pairs) == pytest.approx(best)


def test_assign_boxes_ambiguous(spark):
    schema = "camera_id int, frame_id long, id long, xmin int, ymin int, xmax int, ymax int"
    a = spark.createDataFrame([(0, 1, 1, 0, 0, 100, 100), (0, 1, 2, 20, 0, 120, 100)], schema)
    b = spark.createDataFrame([(0, 1, 7, 20, 0, 120, 100), (0, 1, 8, 40, 0, 140, 100)], schema)
    matches, rest_a, rest_b = assignment.assign_boxes(a, b, "id", 0.9)
    assert {(r.a_id, r.b_id) for r in matches.collect()} == {(1, 8), (2, 7)}  # 0.9 + 0.33 of gain against twice 0.57
    assert rest_a.count() == rest_b.count() == 0


def candidates(spark, rows):
    return spark.createDataFrame([(0, 1, *r) for r in rows], "camera_id int, frame_id long, class_id int, score double, x1 double, y1 double, x2 double, y2 double")


def test_nms_edges(spark):
    rows = [(1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, 0.8, 0.0, 0.0, 10.0, 9.0), (2, 0.8, 0.0, 0.0, 10.0, 10.0), (1, 0.7, 100.0, 0.0, 110.0, 10.0)]
    kept = {(r.class_id, r.score) for r in detections.nms(candidates(spark, rows)).collect()}
    assert kept == {(1, 0.9), (2, 0.8), (1, 0.7)}
    agnostic = {(r.class_id, r.score) for r in detections.nms(candidates(spark, rows), per_class=False).collect()}
    assert agnostic == {(1, 0.9), (1, 0.7)}
    assert detections.nms(candidates(spark, rows), most=1).count() == 1


def test_round_half_away(spark):
    got = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (-1.4,)], "x double").select(boxes.round_half_away(F.col("x")).alias("r"))
    assert [r.r for r in got.collect()] == [1.0, 2.0, -1.0, -1.0]


def test_colour_lock_at_five(spark):
    cast = [(1, k, 2, 0.5) for k in range(5)] + [(1, 9, 3, 0.99)] * 3
    r = votes.color_majority(spark.createDataFrame(cast, "track_id long, vote_seq long, color int, confidence double")).first()
    assert (r.color, r.hits, r.locked) == (2, 5, True)


def test_class_needs_a_lead_of_two(spark):
    rows = [(1, 1, 4, 0.5, 0), (1, 2, 5, 0.5, 1), (1, 3, 5, 0.5, 2), (1, 4, 5, 0.5, 3)]
    for n, cls in ((3, 4), (4, 5)):
        r = votes.class_majority(spark.createDataFrame(rows[:n], "track_id long, frame_id long, label int, confidence double, age long")).first()
        assert r.class_id == cls


def test_registry_defaults(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text('{"mec_name": "m", "poles": [{"pole_index": "x", "cameras": [{"port": "none", "direction": 3}], "radars": [{}]}]}\n')
    cameras, radars = registry.flatten_registry(registry.read_registry(spark, str(p)))
    c, r = cameras.first(), radars.first()
    assert (c.mec_index, c.pole_name, c.pole_index, c.port, c.direction) == (9999, "unknown", 9999, 554, "3")
    assert (r.port, r.height, r.ip) == (8089, -1.0, "unknown")


def test_bad_images_go_to_rejects(spark):
    image = "struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    rows = [(1, ("", 1, 2, 3, 16, b"123456")), (2, ("", 1, 2, 3, 16, b"123")), (3, ("", -1, -1, -1, -1, b"")), (4, None)]
    good, bad = split_decoded(spark.createDataFrame(rows, f"img_id long, image {image}"))
    assert [r.img_id for r in good.collect()] == [1] and {r.img_id for r in bad.collect()} == {2, 3, 4}


BOX = np.array([[100.0, 100.0, 50.0, 50.0]])


def feed(t, frame, present=True, score=0.9):
    n = 1 if present else 0
    return t.step(frame, BOX[:n], np.full(n, score), np.full(n, 3))


def test_first_frame_confirms_at_once_and_later_ones_need_two():
    t = tracker.CameraTracker()
    assert feed(t, 1)[0][0].confirmed
    late = tracker.CameraTracker(frame=4)
    assert not feed(late, 5)[0][0].confirmed
    assert feed(late, 6)[0][0].confirmed
    lone = tracker.CameraTracker(frame=4)
    feed(lone, 5)
    assert feed(lone, 6, False) == [] and len(lone.removed) == 1


@pytest.mark.parametrize("missed, same", [(44, True), (45, True), (46, False)])
def test_age_limit(missed, same):
    """A track lost for 46 frames is still matched; at the next it is gone."""
    t = tracker.CameraTracker()
    feed(t, 1)
    feed(t, 2)
    for f in range(3, 3 + missed):
        feed(t, f, False)
    assert (feed(t, 3 + missed)[0][0].id == 0) == same


def test_refound_track_keeps_stale_box_and_has_no_point():
    t = tracker.CameraTracker()
    feed(t, 1)
    ((track, pointed),) = feed(t, 2)
    assert pointed and track.points == 1
    feed(t, 3, False)
    ((track, pointed),) = t.step(4, BOX + 2, np.array([0.9]), np.array([3]))
    assert not pointed and track.points == 1 and track.det_box == tuple(BOX[0])


def test_ids_wrap():
    t = tracker.CameraTracker(next_id=65535)
    boxes_ = np.array([[0.0, 0, 10, 10], [500.0, 0, 10, 10]])
    ids = {x.id for x, _ in t.step(1, boxes_, np.array([0.9, 0.9]), np.array([1, 1]))}
    assert ids == {65535, 0}


def test_low_scores_keep_a_track_alive():
    t = tracker.CameraTracker(tracker.TrackParams(track_thresh=0.5))
    feed(t, 1)
    feed(t, 2)
    ((track, pointed),) = feed(t, 3, score=0.4)
    assert pointed and track.id == 0 and track.points == 2


def test_segments_equal_a_single_pass(spark):
    rng = random.Random(3)
    rows, frames = [], [f for start in (1, 90, 200) for f in range(start, start + 30) if rng.random() < 0.8]
    for f in frames:
        for lane in range(3):
            if rng.random() < 0.9:
                rows.append((0, f, 1 + lane, 0.9, 10 + 4 * f % 400, 100 + 200 * lane, 130 + 4 * f % 400, 180 + 200 * lane))
    schema = "camera_id int, frame_id long, label int, confidence double, xmin int, ymin int, xmax int, ymax int"
    last = spark.createDataFrame([(0, 300)], "camera_id int, last_frame long")
    found = tracker.track(spark.createDataFrame(rows, schema), last).filter("kind = 'out'")
    assert found.select("segment").distinct().count() == 3
    ours = sorted((r.frame_id, r.track_id, round(r.x, 2), r.has_point) for r in found.collect())
    single, by_frame = tracker.CameraTracker(), {}
    for r in rows:
        by_frame.setdefault(r[1], []).append(r)
    theirs = []
    for f in range(1, 301):
        d = sorted(by_frame.get(f, []), key=lambda r: (r[4], r[5], r[2]))
        tlwh = np.array([[r[4], r[5], r[6] - r[4], r[7] - r[5]] for r in d], float).reshape(-1, 4)
        theirs += [(f, t.id, round(float(t.tlwh[0]), 2), p) for t, p in single.step(f, tlwh, np.array([r[3] for r in d]), np.array([r[2] for r in d], int))]
    assert ours == sorted(theirs)


def single_pass(rows, last):
    """(kind, frame, id, start, x, point, n_points) of one tracker over one camera's frames."""
    one, by_frame, out = tracker.CameraTracker(), {}, []
    for r in rows:
        by_frame.setdefault(r[1], []).append(r)
    for f in range(1, last + 1):
        d = sorted(by_frame.get(f, []), key=lambda r: (r[4], r[5], r[6], r[2]))
        tlwh = np.array([[r[4], r[5], r[6] - r[4], r[7] - r[5]] for r in d], float).reshape(-1, 4)
        shown = one.step(f, tlwh, np.array([r[3] for r in d]), np.array([r[2] for r in d], int))
        out += [("out", f, t.id, t.start, float(t.tlwh[0]), p, t.points) for t, p in shown]
        out += [("removed", f, t.id, t.start, float(t.tlwh[0]), False, t.points) for t in one.removed]
    return sorted(out)


def busy(seed, frames, parked):
    """A road that is never empty: a vehicle enters a lane every few frames, some detections are missing or weak."""
    rng, rows = random.Random(seed), []
    for lane in range(3):
        start = 1
        while start < frames:
            for k in range(rng.randint(20, 40)):
                if start + k <= frames and rng.random() < 0.9:
                    rows.append((0, start + k, 1 + rng.randint(0, 3), rng.choice([0.9, 0.6, 0.36, 0.3]), 10 + 9 * k, 100 + 200 * lane, 130 + 9 * k, 180 + 200 * lane))
            start += rng.randint(15, 30)
    rows += [(0, f, 2, 0.9, 1500, 900, 1600, 980) for f in range(*parked)]
    return rows


@pytest.mark.parametrize("parked, rounds, agree", [((1, 1), 3, True), ((1, 900), 3, False), ((1, 900), 0, False), ((100, 420), 1, False)])
def test_slices_of_a_busy_camera_equal_a_single_pass(spark, parked, rounds, agree):
    """Without idle gaps a camera still runs in many slices; a parked car, which a warm-up cannot know, has slices run again from their predecessor's state."""
    rows = busy(7, 900, parked)
    d = spark.createDataFrame(rows, "camera_id int, frame_id long, label int, confidence double, xmin int, ymin int, xmax int, ymax int")
    last = spark.createDataFrame([(0, 1000)], "camera_id int, last_frame long")
    cut = tracker.SliceParams(frames=180, warmup=150, rounds=rounds)
    assert tracker.track_segments(d, 45).select("segment").distinct().count() == 1
    sliced = tracker._sliced(d, last, tracker.TrackParams(), cut)
    states = {r.slice: (r.starts_as, r.ends_as) for r in tracker._parallel(sliced, tracker.TrackParams(), cut).filter("kind = 'state'").collect()}
    assert len(states) == 6 and all(states[k][1] == states[k + 1][0] for k in range(5)) == agree
    found = tracker.track(d, last, cut=cut)
    ours = sorted((r.kind, r.frame_id, r.track_id, r.start_frame, r.x, r.has_point, r.n_points) for r in found.collect())
    assert ours == single_pass(rows, 1000)


def test_tracker_state_comes_back_typed():
    one = tracker.CameraTracker()
    for f in range(1, 40):
        n = f % 7 != 0
        one.step(f, np.array([[10.0 + f, 10, 50, 60], [400, 10 + f, 60, 50]][: 1 + n]), np.array([0.9, 0.5][: 1 + n]), np.array([2, 3][: 1 + n]))
    two = tracker.CameraTracker.resumed(tracker.TrackParams(), one.frame, one.state(), one.next_id)
    assert two.agrees_by() == one.agrees_by() and two.state() == one.state()
    for f in range(40, 60):
        a, b = (t.step(f, np.array([[10.0 + f, 10, 50, 60]]), np.array([0.9]), np.array([2])) for t in (one, two))
        assert [(x.id, p, x.tlwh.tolist()) for x, p in a] == [(x.id, p, x.tlwh.tolist()) for x, p in b]


def test_trajectory_keeps_the_last_points(spark):
    rows = [(0, 1, f, 2, 3, 0.9, 0, 100 + f, 100, 130 + f, 180) for f in range(1, 61)]
    d = spark.createDataFrame([(r[0], r[2], r[4], r[5], r[7], r[8], r[9], r[10]) for r in rows], "camera_id int, frame_id long, label int, confidence double, xmin int, ymin int, xmax int, ymax int")
    found = trajectories.trajectories(tracker.track(d, spark.createDataFrame([(0, 200)], "camera_id int, last_frame long")), 10, 20).first()
    assert (found.start_frame, found.end_frame, found.n_points, len(found.points)) == (1, 60, 20, 20)
    assert found.points[0].frame_id == 41


def many_trajectories(spark, n):
    point = "array(named_struct('frame_id', 5L, 'x', 1D, 'y', 2D, 'w', 4D, 'h', 6D, 'class_id', 3))"
    return spark.range(n).selectExpr("1 camera_id", "0L segment", "id track_id", "1L start_frame", "7L end_frame", "6L duration", "3 class_id", "0.5D score", "1D x", "2D y", "4D w", "6D h", "1 n_points", f"{point} points")


def test_trajectory_files_name_each_track_with_its_colour(spark, tmp_path):
    colored = trajectories.with_colors(many_trajectories(spark, 3), spark.createDataFrame([(1, 0, 6), (1, 9, 2)], "camera_id int, track_id long, color int"))
    index = trajectories.write_trajectories(colored, str(tmp_path / "t"), text=True)
    rows = {r.name: r.text.split("\n") for r in read_bundles(index, str(tmp_path / "t")).collect()}
    assert {name: lines[0].split("color: ")[1].strip() for name, lines in rows.items()} == {f"1970-01-01/tracks/19700101000000-3-{k}.txt": "6" if k == 0 else "0" for k in range(3)}
    assert all(len(lines) == 3 and lines[1] == "track_points: " and lines[2].startswith("frame_5: x: 3.0, y: 5.0") for lines in rows.values())


def test_a_hundred_thousand_tracks_in_few_files(spark, tmp_path):
    path = str(tmp_path / "t")
    index = trajectories.write_trajectories(many_trajectories(spark, 100_000).withColumn("end_frame", F.col("track_id") % 3 * 2_160_000), path, text=True)
    files = [f for _, _, names in os.walk(path) for f in names if f.startswith("tracks-") and not f.endswith(".crc")]
    assert 3 <= len(files) <= 20 and not [f for f in files if ".part" in f]
    read = read_bundles(index, path)
    assert read.count() == read.select("name").distinct().count() == 100_000
    assert read.filter("text not like concat('id: ', regexp_extract(name, '-([0-9]+)[.]txt', 1), ' class: 3 %frame_5: x: 3.0, y: 5.0, class: 3')").count() == 0
    trajectories.write_trajectories(many_trajectories(spark, 0), str(tmp_path / "none"), text=True)


def test_radar_gaps_count_over_buckets(spark):
    from kerbside.operators import health

    frames = spark.createDataFrame([(c, f, None if (f * 7 + c) % 3 else f, 500 if f % 5 == 0 else 10) for c in (1, 2) for f in range(1, 200)] + [(1, None, None, None)], "camera_id int, frame_id long, sweep_id long, skew_ms long")
    for age in (None, 400):
        expected = set()
        for c in (1, 2):
            lost = [f for f in range(1, 200) if (f * 7 + c) % 3 or (age and f % 5 == 0)]
            expected |= {(c, lost[k - 1], k) for k in range(20, len(lost) + 1, 20)}
        found = health.radar_gaps(frames, 20, age, bucket=16)
        assert {(r.camera_id, r.frame_id, r.lost) for r in found.collect()} == expected


def test_late_frames_of_the_gap_stream_are_put_out(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitors.STATE_STORE)
    made = [(1, 0, 0), (1, 3000, 0), (2, 100, 0), (1, 1000, 1), (1, 3000, 1), (1, 5000, 1), (2, 200, 1)]
    # the third column deals frames out to micro-batches
    stream = as_stream(spark.createDataFrame(made, "camera_id int, ts_ms long, batch int"), "late", "batch", 3)
    found = drained(monitors.gap_stream(stream), "late").collect()
    assert sorted((r.camera_id, r.kind, r.from_ms or 0, r.to_ms) for r in found) == [(1, "gap", 0, 3000), (1, "gap", 3000, 5000), (1, "late", 0, 1000)]


def test_a_silent_camera_is_reported_while_it_is_silent(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitors.STATE_STORE)
    stream = as_stream(spark.createDataFrame([(1, 0), (1, 40), (2, 100)], "camera_id int, ts_ms long"), "silent")
    found = []
    writer = monitors.gap_stream(stream, 1200, 500).writeStream.foreachBatch(lambda batch, _: found.extend(batch.collect())).trigger(processingTime="1 second")
    query = writer.option("checkpointLocation", f"{folder(spark)}/kerbside/silent-log-{uuid.uuid4().hex}").start()
    try:
        until = time.monotonic() + 90
        while len(found) < 2 and time.monotonic() < until and query.isActive:
            time.sleep(0.5)
        time.sleep(3)  # nothing is reported twice
    finally:
        query.stop()
    assert sorted((r.camera_id, r.kind, r.from_ms, r.to_ms) for r in found) == [(1, "silent", 40, None), (2, "silent", 100, None)]


def greedy(rows, threshold, per_class):
    """rows: (frame, class, score, x1, y1, x2, y2)."""
    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        inter = max(w, 0) * max(h, 0)
        return inter / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - inter) if inter else 0

    kept = []
    for r in sorted(rows, key=lambda r: (-r[2], *r[3:], r[1])):
        if not any(k[0] == r[0] and (k[1] == r[1] or not per_class) and iou(k, r) > threshold for k in kept):
            kept.append(r)
    return kept


@pytest.mark.parametrize("per_class", [True, False])
def test_nms_equals_greedy_suppression(spark, per_class):
    rng, rows = random.Random(12), []
    for frame in range(12):
        for _ in range(rng.choice([1, 2, 40])):
            x, y = rng.randint(0, 60), rng.randint(0, 30)
            rows.append((frame, rng.randint(1, 3), rng.randint(1, 20) / 20, float(x), float(y), float(x + rng.randint(0, 25)), float(y + rng.randint(1, 25))))
    rows += rows[:5] + [(3, 1, 0.5, 10.0, 10.0, 10.0, 10.0)]
    made = spark.createDataFrame([(7, *r) for r in rows], "camera_id int, frame_id long, class_id int, score double, x1 double, y1 double, x2 double, y2 double")
    for most in (None, 4):
        kept = greedy(rows, 0.3, per_class)
        if most:
            kept = [r for f in range(12) for r in sorted((k for k in kept if k[0] == f), key=lambda r: (-r[2], r[1], *r[3:]))[:most]]
        found = detections.nms(made, 0.3, per_class=per_class, most=most)
        assert sorted((r.frame_id, r.class_id, r.score, r.x1, r.y1, r.x2, r.y2) for r in found.collect()) == sorted(kept)
    assert detections.nms(made.limit(0)).count() == 0


def test_iou_pairs_of_a_crowded_frame(spark):
    """5,000 boxes in one frame: as many pairs as brute force, and a join that makes few more rows than boxes and overlaps."""
    rng = random.Random(6)
    made = {s: [(0, 1, k, (x := rng.randint(0, 9000)), (y := rng.randint(0, 9000)), x + rng.randint(10, 60), y + rng.randint(10, 60)) for k in range(5000)] + [(0, 2, 1, 0, 0, 500, 500)] for s in "ab"}
    schema = "camera_id int, frame_id long, id long, xmin int, ymin int, xmax int, ymax int"
    a, b = (spark.createDataFrame(made[s], schema) for s in "ab")
    found = pairs.iou_pairs(a, b, "id")
    got = {(r.frame_id, r.a_id, r.b_id): r.iou for r in found.collect()}
    x, y = (np.array([r[3:] for r in made[s] if r[1] == 1]) for s in "ab")
    meets = (x[:, None, 0] <= y[None, :, 2]) & (y[None, :, 0] <= x[:, None, 2]) & (x[:, None, 1] <= y[None, :, 3]) & (y[None, :, 1] <= x[:, None, 3])
    assert set(got) == {(1, i, j) for i, j in np.argwhere(meets).tolist()} | {(2, 1, 1)}
    plain = {(r.frame_id, r.a_id, r.b_id): r.iou for r in pairs.iou_pairs(a, b, "id", crowd=None).collect()}
    assert got == plain
    wide = pairs._cells(a.filter("frame_id = 1"), spark.createDataFrame([(0, 1, 70.0, 70.0)], "camera_id int, frame_id long, cell_w double, cell_h double"), ("camera_id", "frame_id"), 1)
    assert wide.count() < 4 * 5000


def test_assignment_of_clusters_equals_the_whole_frame(spark):
    rng = random.Random(17)
    schema = "camera_id int, frame_id long, id long, xmin int, ymin int, xmax int, ymax int"

    def made():
        return [(0, f, k, (x := rng.randint(0, 400)), 0, x + 40, 40) for f in range(6) for k in range(25)]

    rows_a, rows_b = made(), made()
    matches, rest_a, rest_b = assignment.assign_boxes(spark.createDataFrame(rows_a, schema), spark.createDataFrame(rows_b, schema), "id", 0.8)
    got = matches.collect()
    assert len({(r.frame_id, r.a_id) for r in got}) == len({(r.frame_id, r.b_id) for r in got}) == len(got)
    total = 0.0
    for f in range(6):
        a, b = (np.array([[r[3], r[4], r[5] - r[3], r[6] - r[4]] for r in rows if r[1] == f], float) for rows in (rows_a, rows_b))
        gain = 0.8 - tracker.distances(a, b)
        total += sum(gain[i, j] for i, j in assignment.solve(gain))
    assert sum(r.iou - 0.2 for r in got) == pytest.approx(total)
    assert rest_a.count() == rest_b.count() == 150 - len(got)


def test_class_votes_of_a_long_track(spark):
    """A hundred thousand votes of one track are folded with a few numbers of state, across Arrow batches."""
    made = spark.range(100_000).select(F.lit(1).alias("track_id"), F.col("id").alias("frame_id"), F.when(F.col("id") % 3 == 0, 2).otherwise(5).alias("label"), F.lit(0.6).alias("confidence"), F.col("id").alias("age"))
    few = spark.createDataFrame([(2, 1, 3, 0.75, 0), (2, 2, None, 0.9, 1), (3, 5, 1, 0.9, 9)], "track_id int, frame_id long, label int, confidence double, age long")
    found = {r.track_id: (r.class_id, r.locked) for r in votes.class_majority(made.unionByName(few)).collect()}
    one = votes.ClassState(2)
    for k in range(100_000):
        one.vote(2 if k % 3 == 0 else 5, 0.6, k, votes.ClassRules())
    assert found == {1: (one.cls, one.locked), 2: (3, False), 3: (1, False)}


def test_frame_files_as_a_stream(spark, tmp_path):
    """Files that come into a folder, whole ones and rejects."""
    pixels = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    made = [(k, ("", 4, 5, 3, 16, pixels.tobytes() if k != 2 else b"no image")) for k in range(4)]
    folder_ = str(tmp_path / "in")
    assert write_frames(spark.createDataFrame(made, "img_id long, " + IMAGE), folder_).count() == 4
    for stream in (False, True):
        frames, rejects = read_frames(spark, folder_, stream)
        if stream:
            frames, rejects = (drained(x, n) for x, n in ((frames, "frames"), (rejects, "rejects")))
        assert {(os.path.basename(r.image.origin), bytes(r.image.data)) for r in frames.collect()} == {(f"{k}.png", pixels.tobytes()) for k in (0, 1, 3)}
        assert [(os.path.basename(r.image.origin), r.code) for r in rejects.collect()] == [("2.png", 331)]


def test_matches_without_a_choice_are_those_of_the_solver():
    rng = np.random.default_rng(4)
    for _ in range(300):
        dist = rng.choice([0.2, 0.5, 0.95, 1.0], (rng.integers(0, 5), rng.integers(0, 5)), p=[0.1, 0.1, 0.4, 0.4]).astype(np.float32)
        pairs, rows, columns = tracker.matched(dist, 0.9)
        assert pairs == (assignment.solve(0.9 - dist.astype(float)) if dist.size else [])
        assert sorted([i for i, _ in pairs] + rows) == list(range(dist.shape[0])) and sorted([j for _, j in pairs] + columns) == list(range(dist.shape[1]))
