"""Per-frame messages: objects and hazards of a frame as one nested row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.pairs import SHUFFLED

OBJECT = "struct<id:bigint,target_type:int,x_norm:double,y_norm:double,w_norm:double,h_norm:double,color:int,plate_number:string>"


def frame_messages(frames: DataFrame, objects: DataFrame, hazards: DataFrame, keys: tuple[str, ...] = ("camera_id", "frame_id")) -> DataFrame:
    """A row for each frame: objects_number (all objects and hazards), published_number (those shown), objects, sorted by id.

    objects: keys, id, target_type, x_norm..h_norm, color, published; hazards: keys, id, target_type, x_norm..h_norm.
    """
    common = [*keys, F.col("id").cast("long").alias("id"), F.col("target_type").cast("int").alias("target_type"), "x_norm", "y_norm", "w_norm", "h_norm"]
    both = objects.select(*common, F.col("color").cast("int").alias("color"), "published").unionByName(hazards.select(*common, F.lit(0).alias("color"), F.lit(True).alias("published")))
    one = F.struct("id", "target_type", "x_norm", "y_norm", "w_norm", "h_norm", "color", F.lit("").alias("plate_number"))
    gathered = both.groupBy(*keys).agg(F.count("*").alias("objects_number"), F.count_if("published").alias("published_number"), F.sort_array(F.collect_list(F.when(F.col("published"), one))).alias("objects"))
    joined = frames.join(gathered.hint(SHUFFLED), [*keys], "left")
    none = F.array().cast(f"array<{OBJECT}>")
    return joined.withColumns({"objects_number": F.coalesce("objects_number", F.lit(0)), "published_number": F.coalesce("published_number", F.lit(0)), "objects": F.coalesce(F.col("objects").cast(f"array<{OBJECT}>"), none), "frame_seq": F.col("frame_id")})
