"""Radar sweeps beside frames: projection, as-of join, skew alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators import ranges

SKEW_CODE = 324


def radar_points(sweeps: DataFrame, cameras: DataFrame, width: int, height: int) -> DataFrame:
    """Points in pixels by the camera's focal type; only points right of and below the image's corner."""
    joined = sweeps.join(cameras.select("camera_id", "focal_type"), "camera_id")
    long = F.col("focal_type") == "long"
    x = F.when(long, F.col("x_norm_long")).otherwise(F.col("x_norm_short")) * width
    y = F.when(long, F.col("y_norm_long")).otherwise(F.col("y_norm_short")) * height
    return joined.select("camera_id", "sweep_id", "obj_idx", x.cast("int").alias("x_px"), y.cast("int").alias("y_px")).filter("x_px > 0 and y_px > 0")


def radar_asof(frames: DataFrame, sweeps: DataFrame, by: str = "camera_id", ts: str = "ts_ms", sweep_id: str = "sweep_id", width: int = ranges.MILLISECONDS) -> DataFrame:
    """frames with the newest sweep not after them (sweep_id, sweep_ts, skew_ms); null before the first sweep.

    Both sides in one stream by time, sweeps first on ties, in ranges of width milliseconds: no join of frames with sweeps.
    """
    left = frames.withColumns({"side_": F.lit(1), "sweep_": F.lit(None).cast("struct<sweep_ts:bigint,sweep_id:bigint>"), "row_": F.struct(*frames.columns)})
    right = sweeps.select(by, ts, F.lit(0).alias("side_"), F.struct(F.col(ts).cast("long").alias("sweep_ts"), F.col(sweep_id).cast("long").alias("sweep_id")).alias("sweep_"), F.lit(None).cast(left.schema["row_"].dataType).alias("row_"))
    both = left.select(by, ts, "side_", "sweep_", "row_").unionByName(right)
    found = ranges.carried(both, by, ts, "sweep_", width, "newest_", ("side_", "sweep_")).filter("side_ = 1")
    return found.select("row_.*", "newest_.sweep_id", "newest_.sweep_ts").withColumn("skew_ms", F.col(ts) - F.col("sweep_ts"))


def skew_alerts(joined: DataFrame, limit_ms: int = 400, every_ms: int = 20_000) -> DataFrame:
    """At most one alert a camera and stretch of time: the first frame whose skew is over the limit."""
    late = joined.filter(F.abs("skew_ms") > limit_ms).withColumn("stretch", F.floor(F.col("ts_ms") / every_ms))
    first = late.groupBy("camera_id", "stretch").agg(F.min(F.struct("ts_ms", "frame_id", "skew_ms")).alias("a"))
    return first.select("camera_id", "a.frame_id", "a.ts_ms", "a.skew_ms", F.lit(SKEW_CODE).alias("code"))
