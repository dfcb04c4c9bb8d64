"""Device registry: nested records to flat cameras and radars, topic names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Defaults of missing or mistyped fields (fixed values).
CAMERA_PORT, RADAR_PORT, MEC_INDEX, NUMBER, NAME = 554, 8089, 9999, -1.0, "unknown"

#: Values are read as strings, so that one of a wrong type becomes the default, not an error.
SCHEMA = """mec_name string, mec_index string, poles array<struct<pole_name string, pole_index string,
 cameras array<struct<camera_index string, direction string, focal_type string, ip string, port string>>,
 radars array<struct<direction string, ip string, port string, height string>>>>"""


def read_registry(spark, path: str) -> DataFrame:
    """JSON records of the nested registry."""
    return spark.read.schema(SCHEMA).json(path)


def _or(column: str, kind: str, default) -> F.Column:
    return F.coalesce(F.col(column).try_cast(kind), F.lit(default).cast(kind)).alias(column.rsplit(".", 1)[-1])


def flatten_registry(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cameras, radars), a row each with its mec and pole."""
    poles = registry.select(_or("mec_name", "string", NAME), _or("mec_index", "int", MEC_INDEX), F.explode("poles").alias("p"))
    pole = ["mec_name", "mec_index", _or("p.pole_name", "string", NAME), _or("p.pole_index", "int", MEC_INDEX)]
    cameras = poles.select(*pole, F.explode("p.cameras").alias("c"))
    radars = poles.select(*pole, F.explode("p.radars").alias("r"))
    flat = ["mec_name", "mec_index", "pole_name", "pole_index"]
    return (
        cameras.select(*flat, _or("c.camera_index", "int", -1), _or("c.direction", "string", NAME), _or("c.focal_type", "string", NAME), _or("c.ip", "string", NAME), _or("c.port", "int", CAMERA_PORT)),
        radars.select(*flat, _or("r.direction", "string", NAME), _or("r.ip", "string", NAME), _or("r.port", "int", RADAR_PORT), _or("r.height", "double", NUMBER)),
    )


def camera_topics(cameras: DataFrame, radars: DataFrame) -> DataFrame:
    """Cameras with image_topic, detection_topic and their pole's radar of the same direction (null without one)."""
    keys = ["mec_name", "pole_name", "direction"]
    own = radars.select(*keys, F.col("ip").alias("radar_ip"), F.concat(F.lit("/"), "pole_name", F.lit("/"), "direction", F.lit("/radar")).alias("radar_topic"))
    base = F.concat(F.lit("/"), F.col("pole_name"), F.lit("/"), F.col("direction"), F.lit("/"), F.col("focal_type"), F.lit("_camera"))
    return cameras.join(own, keys, "left").withColumns({"image_topic": F.concat(base, F.lit("/image_raw")), "detection_topic": F.concat(base, F.lit("/detections"))})
