"""Queries: streaming twins over what their source has now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators import boxes, hazards, health
from kerbside.operators.pairs import SHUFFLED
from kerbside.plans.fixtures import fixture
from kerbside.plans import tracks
from kerbside.plans.scenes import ORACLE_SQL as BATCH
from kerbside.plans.tracks import ORACLE_SQL as TRACKS
from kerbside.streaming import monitors
from kerbside.streaming.drain import COLUMN_ROWS, as_stream, cuts_of, drained


def _rocks(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", monitors.STATE_STORE)


def fps_stream(spark, sf_dir):
    frames = fixture(spark, sf_dir, "fx_frames_gappy").withColumn("ts", F.timestamp_millis("ts_ms"))
    found = drained(monitors.fps_stream(as_stream(frames, "fps")), "fps", "complete")
    return health.with_empty_windows(found).withColumn("fps", F.round("fps", 6))


def camera_gaps_stream(spark, sf_dir):
    _rocks(spark)
    frames = fixture(spark, sf_dir, "fx_frames_gappy").select("camera_id", "ts_ms")
    return drained(monitors.gap_stream(as_stream(frames, "gaps", "ts_ms", rows=COLUMN_ROWS)), "gaps").filter("kind = 'gap'").drop("kind")


def _with_ends(df: DataFrame, order: str, beyond: int = 0, of: DataFrame | None = None) -> DataFrame:
    """df and for each camera a row with mark end at its last place (or ``beyond`` after it), as a source gives that closes. of: a table with the same last places that costs less to make."""
    ends = (df if of is None else of).groupBy("camera_id").agg((F.max(order) + beyond).alias(order))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in ("camera_id", order)]
    return df.withColumn("mark", F.lit(None).cast("string")).unionByName(ends.select("camera_id", order, *none, F.lit("end").alias("mark")))


def _radar(spark, sf_dir, **params):
    _rocks(spark)
    frames = fixture(spark, sf_dir, "fx_frames").select("camera_id", "frame_id", "ts_ms")
    sweeps = fixture(spark, sf_dir, "fx_radar").select("camera_id", "sweep_id", "ts_ms").distinct()
    beyond = fixture(spark, sf_dir, "fx_radar").agg(F.max("ts_ms")).first()[0] or 0
    last = frames.groupBy("camera_id").agg(F.greatest(F.max("ts_ms"), F.lit(beyond)).alias("ts_ms")).select("camera_id", F.lit(None).cast("long").alias("frame_id"), "ts_ms", F.lit("end").alias("mark"))
    marked = frames.withColumn("mark", F.lit(None).cast("string")).unionByName(last)
    cuts = cuts_of(frames, "ts_ms", rows=COLUMN_ROWS)
    return drained(monitors.radar_stream(as_stream(marked, "radar-frames", "ts_ms", cuts=cuts), as_stream(sweeps, "radar-sweeps", "ts_ms", cuts=cuts), **params), "radar")


def radar_asof_stream(spark, sf_dir):
    found = _radar(spark, sf_dir, kinds=("frame",)).filter("kind = 'frame'")
    return found.select("camera_id", "frame_id", "sweep_id", "skew_ms", F.coalesce(F.abs("skew_ms") > 400, F.lit(False)).alias("skewed"))


def skew_alerts_stream(spark, sf_dir):
    return _radar(spark, sf_dir, kinds=("skew",)).filter("kind = 'skew'").select("camera_id", "frame_id", "ts_ms", "skew_ms", "code")


def radar_gaps_stream(spark, sf_dir):
    found = _radar(spark, sf_dir, max_age_ms=200, kinds=("missing",)).filter("kind = 'missing'")
    return found.select("camera_id", "frame_id", "lost", F.lit("WARN").alias("level"), "code")


def _rates(spark, frames):
    _rocks(spark)
    return drained(monitors.rate_stream(as_stream(_with_ends(frames.select("camera_id", "ts_ms"), "ts_ms"), "rates", "ts_ms", rows=COLUMN_ROWS)), "rates")


def fps_windows_stream(spark, sf_dir):
    """Rates with the windows of rate 0, put out by the stream itself."""
    found = _rates(spark, fixture(spark, sf_dir, "fx_frames_gappy")).filter("kind = 'rate'")
    return found.select("camera_id", "window_start", F.round("fps", 6).alias("fps"))


def infer_gaps_stream(spark, sf_dir):
    found = _rates(spark, fixture(spark, sf_dir, "fx_frames_gappy").filter("frame_id % 500 not between 100 and 350")).filter("kind = 'none'")
    return found.select("camera_id", "window_start", F.lit("WARN").alias("level"), "code")


def track_colors_stream(spark, sf_dir):
    """Tracks of 30 points and more with the colour that votes on them while they lived end with."""
    _rocks(spark)
    rows = tracks._rows(spark, sf_dir)
    cast = tracks._color_votes(rows).select("track.*", "vote_seq", "color", "confidence")
    cuts = cuts_of(rows, "frame_id")
    named = _with_ends(rows.filter("kind in ('out', 'removed')").select("camera_id", "segment", "track_id", "frame_id", "start_frame", "last_frame", "n_points", "kind"), "frame_id")
    found = drained(monitors.color_stream(as_stream(named, "color-tracks", "frame_id", cuts=cuts), as_stream(cast, "color-votes", "vote_seq", cuts=cuts)), "colors")
    return found.filter("kind = 'ended' and n_points >= 30").select("camera_id", "start_frame", "end_frame", "color")


def track_messages_stream(spark, sf_dir):
    """Messages as their frames, objects and hazards come."""
    _rocks(spark)
    objects, found = tracks.message_parts(spark, sf_dir)
    frames = _with_ends(fixture(spark, sf_dir, "fx_frames").select("camera_id", "frame_id"), "frame_id")
    cuts = cuts_of(frames, "frame_id")
    sources = (as_stream(df, f"messages-{n}", "frame_id", cuts=cuts) for n, df in (("frames", frames), ("objects", objects), ("hazards", found)))
    made = drained(monitors.message_stream(*sources), "messages")
    return tracks.message_digest(made.filter("kind = 'message'"))


def hazards_sticky_stream(spark, sf_dir):
    _rocks(spark)
    frames = fixture(spark, sf_dir, "fx_frames").select("camera_id", "frame_id")
    good = hazards.filter_hazards(hazards.within(fixture(spark, sf_dir, "fx_hazards"), 1920, 1080), fixture(spark, sf_dir, "fx_detections"))
    sets = good.groupBy("camera_id", "frame_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("cand_id")), lambda c: c.cast("string")), ",").alias("ids"))
    sampled = boxes.sampled_dense(frames, 6).join(sets.hint(SHUFFLED), ["camera_id", "frame_id"], "left").select("camera_id", "frame_id", F.coalesce("ids", F.lit("")).alias("hazards"))
    rows = _with_ends(frames.join(sampled.hint(SHUFFLED), ["camera_id", "frame_id"], "left"), "frame_id", of=frames)
    cuts = cuts_of(frames, "frame_id", rows=COLUMN_ROWS)
    return drained(monitors.sticky_stream(as_stream(rows, "sticky", "frame_id", cuts=cuts)), "sticky").filter("kind = 'frame'").drop("kind")


def track_points_stream(spark, sf_dir):
    _rocks(spark)
    detections = fixture(spark, sf_dir, "fx_detections").drop("vehicle_id")
    rows = drained(monitors.track_stream(as_stream(detections, "tracks", "frame_id")), "tracks").filter("kind = 'out' and has_point")
    return rows.select("camera_id", "frame_id", F.col("det_x").cast("int").alias("xmin"), F.col("det_y").cast("int").alias("ymin"), F.lit(True).alias("near"))


QUERIES = {f.__name__: f for f in (fps_stream, camera_gaps_stream, radar_asof_stream, skew_alerts_stream, radar_gaps_stream, fps_windows_stream, infer_gaps_stream, track_colors_stream, track_messages_stream, hazards_sticky_stream, track_points_stream)}
ORACLE_SQL = {
    "fps_stream": BATCH["fps_windows"],
    "camera_gaps_stream": BATCH["camera_gaps"],
    "radar_asof_stream": BATCH["radar_asof"],
    "skew_alerts_stream": BATCH["skew_alerts"],
    "radar_gaps_stream": BATCH["radar_gaps"],
    "fps_windows_stream": BATCH["fps_windows"],
    "infer_gaps_stream": BATCH["infer_gaps"],
    "track_colors_stream": TRACKS["track_colors"],
    "track_messages_stream": TRACKS["track_messages"],
    "hazards_sticky_stream": BATCH["hazards_sticky"],
    "track_points_stream": TRACKS["track_points"],
}
