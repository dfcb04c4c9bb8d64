"""Trajectories of ended tracks, as rows with nested points and as text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.operators.pairs import SHUFFLED


def trajectories(track_rows: DataFrame, min_points: int = 30, last_n: int = 500) -> DataFrame:
    """A row for each removed track with at least min_points points: its start, end and duration in frames, final class and box, its last points."""
    ended = track_rows.filter("kind = 'removed'").filter(F.least("n_points", F.lit(last_n)) >= min_points)
    key = ["camera_id", "segment", "track_id"]
    newest = F.row_number().over(Window.partitionBy(*key, "start_frame").orderBy(F.desc("frame_id")))
    points = track_rows.filter("kind = 'out' and has_point").withColumn("rank_", newest).filter(F.col("rank_") <= last_n)
    one = F.struct("frame_id", "x", "y", "w", "h", "class_id")
    gathered = points.groupBy(*key, "start_frame").agg(F.sort_array(F.collect_list(one)).alias("points"))
    own = ended.select(*key, "start_frame", F.col("last_frame").alias("end_frame"), (F.col("last_frame") - F.col("start_frame")).alias("duration"), "class_id", "score", "x", "y", "w", "h", F.least("n_points", F.lit(last_n)).alias("n_points"))
    return own.join(gathered.hint(SHUFFLED), [*key, "start_frame"])


def with_colors(found: DataFrame, colors: DataFrame, key: tuple[str, ...] = ("camera_id", "track_id")) -> DataFrame:
    """found (tracks or trajectories) with their colour of the vote (key, color); 0 where none was voted. Votes of no track are dropped."""
    voted = colors.select(*key, "color").dropDuplicates([*key])
    return found.drop("color").join(voted.hint(SHUFFLED), [*key], "left").withColumn("color", F.coalesce("color", F.lit(0)).cast("int"))


def with_colors_so_far(track_rows: DataFrame, leading: DataFrame, key: tuple[str, ...] = ("camera_id", "segment", "track_id")) -> DataFrame:
    """track_rows with the colour that led when their frame was put out; 0 before the first vote. leading: key, vote_seq (the vote's frame), color."""
    voted = leading.select(*key, F.col("vote_seq").alias("frame_id"), F.col("color").alias("voted_")).dropDuplicates([*key, "frame_id"])
    newest = F.last("voted_", ignorenulls=True).over(Window.partitionBy(*key).orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0))
    return track_rows.drop("color").join(voted.hint(SHUFFLED), [*key, "frame_id"], "left").withColumn("color", F.coalesce(newest, F.lit(0)).cast("int")).drop("voted_")


def with_lines(found: DataFrame, frame_ms: int = 40, epoch_ms: int = 0) -> DataFrame:
    """Adds day, path and lines: a header, a title and a line for each point; time is that of the track's last frame."""
    at = F.timestamp_millis(F.col("end_frame") * frame_ms + epoch_ms)
    s = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    # the text form's labels (fixed format); t and l hold x and y
    named_values = (("id", "track_id"), ("class", "class_id"), ("score", "score"), ("t", "x"), ("l", "y"), ("w", "w"), ("h", "h"), ("duration_frame", "duration"))
    header = F.concat(*[x for label, c in named_values for x in (F.lit(f"{label}: "), s(c), F.lit(" "))], F.lit("color: "), s(F.coalesce("color", F.lit(0))) if "color" in found.columns else F.lit("0"), F.lit(" "))
    lines = F.transform("points", lambda p: F.concat(F.lit("frame_"), s(p["frame_id"]), F.lit(": x: "), s(p["x"] + p["w"] / 2), F.lit(", y: "), s(p["y"] + p["h"] / 2), F.lit(", class: "), s(p["class_id"])))
    named = found.withColumn("day", F.date_format(at, "yyyy-MM-dd"))
    path = F.concat(F.col("day"), F.lit("/tracks/"), F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), F.col("class_id").cast("string"), F.lit("-"), F.col("track_id").cast("string"), F.lit(".txt"))
    return named.withColumns({"path": path, "lines": F.concat(F.array(header, F.lit("track_points: ")), lines)})


def write_trajectories(found: DataFrame, path: str, text: bool = False, tracks_a_file: int = 10_000) -> DataFrame | None:
    """By day: Parquet with nested points, or text: a track's lines joined by line feeds, under its ``<day>/tracks/<name>`` in the index that is returned, with
    its camera as the key; many tracks share a file."""
    from kerbside.sources.bundles import write_bundles

    named = with_lines(found)
    if not text:
        named.drop("lines").write.mode("append").partitionBy("day").parquet(path)
        return None
    texts = named.select("day", F.col("camera_id").cast("string").alias("key"), F.col("path").alias("name"), F.array_join("lines", "\n").alias("text"))
    return write_bundles(texts, path, tracks_a_file, "tracks")
