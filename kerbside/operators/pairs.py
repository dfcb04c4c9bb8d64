"""Joins of box sets within a frame: overlap pairs, duplicates, keyed set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.operators.detections import FRAME, iou
from kerbside.sources.scratch import written

#: Both sides of these joins are as large as the boxes, and Spark's estimate of rows that came out of arrays is far too low: it must not broadcast them.
SHUFFLED = "merge"


def _box(side: str):
    return F.struct(*[F.col(f"{side}.{c}").cast("double").alias(n) for c, n in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))])


#: Boxes of a frame from which on it is cut into cells.
CROWD = 256


def _cells(df: DataFrame, crowded: DataFrame, keys: tuple[str, ...], one: int) -> DataFrame:
    """df with a row for each cell that a box reaches (cell_x, cell_y), first_x and first_y being its first; frames that are not crowded are one cell."""
    joined = df.join(crowded, [*keys], "left")
    at = lambda c, size: F.coalesce(F.floor(c / F.col(size)), F.lit(0)).cast("int")
    first = joined.withColumns({"first_x": at(F.col("xmin"), "cell_w"), "first_y": at(F.col("ymin"), "cell_h")})
    across = first.withColumn("cell_x", F.explode(F.sequence("first_x", F.greatest("first_x", at(F.col("xmax") + one, "cell_w")))))
    return across.withColumn("cell_y", F.explode(F.sequence("first_y", F.greatest("first_y", at(F.col("ymax") + one, "cell_h"))))).drop("cell_w", "cell_h")


def iou_pairs(a: DataFrame, b: DataFrame, id_col: str, keys: tuple[str, ...] = FRAME, min_iou: float = 0.0, plus_one: bool = True, crowd: int | None = CROWD, broadcast_rows: int = 100_000) -> DataFrame:
    """Overlapping boxes of the same frame: keys, a_id, b_id, iou; an equi-join on the keys with the overlap as its condition.

    A frame in which a has more than ``crowd`` boxes is cut into cells twice as large as its boxes are on average: boxes meet by cell, and a pair is kept in
    the first cell that both reach, so the work of a wide frame grows with its boxes and their overlaps, not with their square. With crowd None no frame is.
    """
    one = 1 if plus_one else 0
    same = [*keys]
    if crowd is not None:
        size = lambda lo, hi: F.greatest(2 * F.avg(F.col(hi) - F.col(lo) + 1), F.lit(1.0))
        wide = a.groupBy(*keys).agg(F.count("*").alias("n"), size("xmin", "xmax").alias("cell_w"), size("ymin", "ymax").alias("cell_h")).filter(F.col("n") > crowd).drop("n")
        wide = written(wide, "crowded-frames")
        many = wide.count()
        if many:
            wide = F.broadcast(wide) if many <= broadcast_rows else wide
            a, b = _cells(a, wide, keys, one), _cells(b, wide, keys, one)
            same += ["cell_x", "cell_y"]
    a, b = a.alias("a"), b.alias("b")
    equal = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in same]
    if len(same) > len(keys):
        equal += [F.col(f"a.{c}") == F.greatest(f"a.{f}", f"b.{f}") for c, f in (("cell_x", "first_x"), ("cell_y", "first_y"))]
    meets = (F.col("a.xmin") < F.col("b.xmax") + one) & (F.col("b.xmin") < F.col("a.xmax") + one) & (F.col("a.ymin") < F.col("b.ymax") + one) & (F.col("b.ymin") < F.col("a.ymax") + one)
    joined = a.join(b.hint(SHUFFLED), [*equal, meets], "inner")
    found = joined.select(*[F.col(f"a.{k}") for k in keys], F.col(f"a.{id_col}").alias("a_id"), F.col(f"b.{id_col}").alias("b_id"), iou(_box("a"), _box("b"), plus_one).alias("iou"))
    return found.filter(F.col("iou") > min_iou)


def dedupe_overlaps(a: DataFrame, b: DataFrame, id_col: str, age_col: str, keys: tuple[str, ...] = FRAME, max_dist: float = 0.15) -> DataFrame:
    """Both sets (side, keys, id) without the shorter-lived box of each pair nearer than max_dist; of equal lives a's goes."""
    close = iou_pairs(a, b, id_col, keys).filter(1 - F.col("iou") < max_dist)
    life = lambda df, side: df.select(*keys, F.col(id_col).alias(f"{side}_id"), F.col(age_col).alias(f"{side}_age"))
    aged = close.join(life(a, "a").hint(SHUFFLED), [*keys, "a_id"]).join(life(b, "b").hint(SHUFFLED), [*keys, "b_id"])
    lose_b, lose_a = aged.filter("a_age > b_age"), aged.filter("a_age <= b_age")
    left = lambda df, lost, side: df.select(F.lit(side).alias("side"), *keys, F.col(id_col).alias("id")).join(lost.select(*keys, F.col(f"{side}_id").alias("id")).hint(SHUFFLED), [*keys, "id"], "left_anti")
    return left(a, lose_a, "a").unionByName(left(b, lose_b, "b")).select("side", *keys, "id")


def keyed_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """All of a, and of b what has a key that a has not."""
    return a.unionByName(b.join(a.select(*keys).hint(SHUFFLED), keys, "left_anti"))


def keyed_subtract(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a without the keys of b, each key once."""
    return a.join(b.select(*keys).hint(SHUFFLED), keys, "left_anti").dropDuplicates(keys)
