"""Health: rates, gaps, codes, image alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators import ranges

#: Keys within module 300 (fixed values).
MODULE = 300
KEYS = {"ok": 0, "model_load_failed": 21, "no_camera_data": 22, "no_radar_data": 23, "camera_radar_skew": 24, "no_infer_data": 25, "occluded": 26, "black": 27, "snow": 28, "too_bright": 29, "blurred": 30, "undecodable": 31}
#: Image metric -> key name.
METRIC_KEYS = {"brightness": "too_bright", "snow": "snow", "sharpness": "blurred", "occlusion": "occluded", "black": "black"}


def code_of(name: str) -> int:
    return 0 if name == "ok" else MODULE + KEYS[name]


def health_codes(events: DataFrame, key_col: str = "key") -> DataFrame:
    """Adds code: module plus key, 0 for ok, null for unknown names."""
    code = F.lit(None).cast("int")
    for name in KEYS:
        code = F.when(F.col(key_col) == name, code_of(name)).otherwise(code)
    return events.withColumn("code", code)


def fps_windows(frames: DataFrame, seconds: int = 5, by: str = "camera_id", ts: str = "ts_ms") -> DataFrame:
    """(camera, window_start ms, fps) for every whole window from a camera's first to its last frame, empty ones included."""
    size = seconds * 1000
    counts = frames.groupBy(by, (F.floor(F.col(ts) / size) * size).alias("window_start")).agg((F.count("*") / seconds).alias("fps"))
    return with_empty_windows(counts, seconds, by)


def with_empty_windows(counts: DataFrame, seconds: int = 5, by: str = "camera_id") -> DataFrame:
    """counts (by, window_start ms, fps) with a row of rate 0 for every window without frames between a camera's first and last."""
    size = seconds * 1000
    span = counts.groupBy(by).agg(F.explode(F.sequence(F.min("window_start"), F.max("window_start"), F.lit(size))).alias("window_start"))
    return span.join(counts, [by, "window_start"], "left").select(by, "window_start", F.coalesce("fps", F.lit(0.0)).alias("fps"))


def infer_gaps(windows: DataFrame, by: str = "camera_id") -> DataFrame:
    """An alert for every window (by, window_start, fps) without a result."""
    return windows.filter("fps = 0").select(by, "window_start", F.lit("WARN").alias("level"), F.lit(code_of("no_infer_data")).alias("code"))


def radar_gaps(joined: DataFrame, limit: int = 1000, max_age_ms: int | None = None, by: str = "camera_id", order: str = "frame_id", bucket: int = ranges.FRAMES) -> DataFrame:
    """An alert at every limit-th frame of a camera that has no radar data; joined: frames with their newest sweep (sweep_id, skew_ms).

    A frame misses its radar if there is no sweep before it or, with max_age_ms, only older ones. Frames are counted in ranges of ``bucket`` frame
    numbers. Frames without a number don't count.
    """
    missing = F.col("sweep_id").isNull() if max_age_ms is None else F.col("sweep_id").isNull() | (F.col("skew_ms") > max_age_ms)
    counted = ranges.numbered(joined.filter(missing & F.col(order).isNotNull()).select(by, order), by, order, bucket, "lost")
    return counted.filter(F.col("lost") % limit == 0).select(by, order, "lost", F.lit("WARN").alias("level"), F.lit(code_of("no_radar_data")).alias("code"))


def camera_gaps(frames: DataFrame, limit_ms: int = 1200, by: str = "camera_id", ts: str = "ts_ms", width: int = ranges.MILLISECONDS) -> DataFrame:
    """Gaps of at least limit_ms between a camera's frames: from, to, gap."""
    found = ranges.previous(frames, by, ts, width, "from_ms").withColumn("gap_ms", F.col(ts) - F.col("from_ms"))
    return found.filter(F.col("gap_ms") >= limit_ms).select(by, "from_ms", F.col(ts).alias("to_ms"), "gap_ms", F.lit(code_of("no_camera_data")).alias("code"))


def health_events(scores: DataFrame, threshold: float = 0.8, id_col: str = "img_id") -> DataFrame:
    """A warning for each metric over the threshold: id, metric, score, level, code. scores: (id, metric, score)."""
    code = F.lit(None).cast("int")
    for metric, name in METRIC_KEYS.items():
        code = F.when(F.col("metric") == metric, code_of(name)).otherwise(code)
    return scores.withColumn("code", code).filter((F.col("score") > threshold) & F.col("code").isNotNull()).select(id_col, "metric", "score", F.lit("WARN").alias("level"), "code")


def image_checks(frames: DataFrame, every: int = 840, threshold: float = 0.8, pictures: DataFrame | None = None, on: str = "img_id") -> DataFrame:
    """Image health at a cadence: of every ``every``-th frame of a camera (frames: camera_id, frame_id, image) a row for each metric (metric, score, level, code),
    a warning over the threshold, and one that says by score 1 or 0 whether it is day or night. With pictures (on, image) frames have the number of theirs instead of the image, so
    that none but the sampled frames meet an image."""
    from kerbside.operators import images
    from kerbside.operators.boxes import cadence_sample

    place = F.struct("camera_id", "frame_id")
    sampled = cadence_sample(frames, every)
    if pictures is not None:
        sampled = sampled.join(pictures.select(on, "image").hint("merge"), on)
    sampled = sampled.select(F.xxhash64(place).alias("img_id"), "camera_id", "frame_id", "image")
    scored = images.score_images(sampled, carry=["camera_id", "frame_id"])
    code = F.lit(None).cast("int")
    for metric, name in METRIC_KEYS.items():
        code = F.when(F.col("metric") == metric, code_of(name)).otherwise(code)
    over = F.col("score") > threshold
    warned = over & code.isNotNull()
    return scored.select("camera_id", "frame_id", "metric", "score", F.when(warned, "WARN").otherwise("INFO").alias("level"), F.when(warned, code).otherwise(0).alias("code"))
