"""Hazard candidates: bounds, overlap with detections, labels, carrying the newest result forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators import ranges
from kerbside.operators.detections import FRAME
from kerbside.operators.pairs import SHUFFLED

#: label -> (target type, id) (fixed values): cone, barrier, box.
HAZARD_TYPES = {1: (33, 65536), 2: (35, 65537), 3: (21, 65538)}


def within(candidates: DataFrame, width: int, height: int) -> DataFrame:
    """Strictly inside the frame."""
    return candidates.filter((F.col("xmin") > 0) & (F.col("ymin") > 0) & (F.col("xmax") < width) & (F.col("ymax") < height))


def filter_hazards(candidates: DataFrame, detections: DataFrame, keys: tuple[str, ...] = FRAME, max_overlap: float = 0.1) -> DataFrame:
    """Candidates that no detection of the same frame covers by more than max_overlap of their own area (pixels count whole)."""
    c, d = candidates.alias("c"), detections.alias("d")
    side = lambda lo, hi: F.greatest(F.lit(0), F.least(f"c.{hi}", f"d.{hi}") - F.greatest(f"c.{lo}", f"d.{lo}") + 1)
    area = (F.col("c.xmax") - F.col("c.xmin") + 1) * (F.col("c.ymax") - F.col("c.ymin") + 1)
    covered = side("xmin", "xmax") * side("ymin", "ymax") / area > max_overlap
    return c.join(d.hint(SHUFFLED), [*[F.col(f"c.{k}") == F.col(f"d.{k}") for k in keys], covered], "left_anti")


def map_hazards(hazards: DataFrame) -> DataFrame:
    """Adds target_type and target_id; unknown labels have none."""
    kind, number = F.lit(None).cast("int"), F.lit(None).cast("int")
    for label, (t, n) in HAZARD_TYPES.items():
        kind, number = F.when(F.col("label") == label, t).otherwise(kind), F.when(F.col("label") == label, n).otherwise(number)
    return hazards.withColumns({"target_type": kind, "target_id": number})


def carry_hazards(frames: DataFrame, hazards: DataFrame, sampled: DataFrame, by: str = "camera_id", order: str = "frame_id", id_col: str = "cand_id", width: int = ranges.FRAMES) -> DataFrame:
    """frames with ``hazards``: the ids of the newest sampled frame so far; a sampled frame without any replaces as well. A camera is done in ranges of width frames."""
    sets = hazards.groupBy(by, order).agg(F.sort_array(F.collect_list(id_col)).alias("ids"))
    none = F.array().cast("array<bigint>")
    at = sampled.select(by, order, F.lit(True).alias("sampled")).join(sets.hint(SHUFFLED), [by, order], "left")
    newest = at.select(by, order, F.coalesce("ids", none).alias("ids"))
    known = frames.join(newest.hint(SHUFFLED), [by, order], "left")
    return ranges.carried(known, by, order, "ids", width, "newest_").withColumn("hazards", F.coalesce("newest_", none)).drop("ids", "newest_")
