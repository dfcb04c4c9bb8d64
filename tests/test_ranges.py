"""Windows in ranges against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from kerbside.operators import boxes, hazards, health, radar, ranges, timing, tracker


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = [(c, t, t * 3 % 7 if rng.random() < 0.2 else None) for c in (1, 2, None) for t in sorted(rng.sample(range(500), 60))]
    return made + [(3, None, 4), (3, 9, None), (3, 250, 2), (3, 251, None)]


def per_camera(rows):
    return {c: sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0)) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("width", [1, 16, 1000])
def test_windows_in_ranges_equal_whole_windows(spark, rows, width):
    df = spark.createDataFrame(rows, "cam int, t long, v long")
    expected = set()
    for c, own in per_camera(rows).items():
        newest, before, total = None, None, 0
        for k, (_, t, v) in enumerate(own):
            newest, total = v if v is not None else newest, total + (t or 0)
            expected.add((c, t, v, newest, before, total, k + 1))
            before = t
    found = ranges.carried(df, "cam", "t", "v", width, "newest")
    found = ranges.previous(found, "cam", "t", width, "before")
    found = ranges.running_sum(found, "cam", "t", F.coalesce("t", F.lit(0)), width, "total")
    found = ranges.numbered(found, "cam", "t", width, "k")
    assert {tuple(r) for r in found.collect()} == expected
    assert found.columns == ["cam", "t", "v", "newest", "before", "total", "k"]
    assert ranges.carried(df.limit(0), "cam", "t", "v", width, "newest").count() == 0


def test_operators_do_not_depend_on_the_width(spark):
    rng = random.Random(6)
    frames = spark.createDataFrame([(c, f, f * 40 + rng.randrange(20)) for c in (1, 2) for f in range(1, 400) if f % 90 > 8 and f % 200 < 120], "camera_id int, frame_id long, ts_ms long")
    sweeps = spark.createDataFrame([(c, n, n * 100) for c in (1, 2) for n in range(3, 160) if n % 40 < 30], "camera_id int, sweep_id long, ts_ms long")
    marked = frames.filter("frame_id % 6 = 5")
    found = marked.filter("frame_id % 5 < 2").select("camera_id", "frame_id", F.explode(F.array("frame_id", F.col("frame_id") + 1)).alias("cand_id"))

    def same(narrow, wide):
        narrow, wide = (sorted(map(str, df.collect())) for df in (narrow, wide))
        assert narrow == wide and narrow

    same(*[hazards.carry_hazards(frames, found, marked, width=w) for w in (7, 10**6)])
    same(*[radar.radar_asof(frames, sweeps, width=w) for w in (130, 10**9)])
    same(*[boxes.cadence_sample(frames, 6, width=w) for w in (7, 10**6)])
    same(*[health.camera_gaps(frames, 200, width=w) for w in (130, 10**9)])
    same(*[tracker.track_segments(frames.withColumn("box", F.lit(1)), 7, width=w) for w in (5, 10**6)])


def test_newest_rows_in_parts_are_the_newest_of_all(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 3).alias("stage"), "id")
    whole = {tuple(r) for r in timing.last_n(df, 200, ["stage"], "id").collect()}
    monkeypatch.setattr(timing, "RANKED_EARLY", 10)
    assert {tuple(r) for r in timing.last_n(df, 200, ["stage"], "id").collect()} == whole and len(whole) == 600
