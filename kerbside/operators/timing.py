"""Timing logs: pairs of begin and end marks, durations, summaries, timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks kept of each stage.
RING = 2000
#: Above this n Spark's limit of ranked rows does not work before the shuffle; keys are then ranked in so many parts first.
RANKED_EARLY, PARTS = 1000, 64


def last_n(df: DataFrame, n: int, by: list[str], order: str) -> DataFrame:
    """The newest n rows of each key. No task holds more than n rows of each of a key's parts, or PARTS * n of a key."""

    def newest(rows: DataFrame, *keys) -> DataFrame:
        return rows.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter(F.col("rank_") <= n).drop("rank_")

    if n > RANKED_EARLY:
        part = F.pmod(F.xxhash64(order), F.lit(PARTS))
        df = newest(df.withColumn("part_", part), *by, "part_").drop("part_")
    return newest(df, *by)


def _paired(log: DataFrame, ring: int) -> DataFrame:
    """Marks (0, 1), (2, 3), ... of each stage's kept marks."""
    kept = last_n(log, ring, ["stage"], "seq")
    w = Window.partitionBy("stage").orderBy("seq")
    numbered = kept.withColumns({"k": F.row_number().over(w) - 1, "end_us": F.lead("t_us").over(w), "end_batch": F.lead("batch_size").over(w)})
    return numbered.filter("k % 2 = 0").withColumn("iteration", F.expr("k div 2"))


def stage_durations(log: DataFrame, ring: int = RING) -> DataFrame:
    """stage, iteration, duration_us, batch_size; a begin without an end has none."""
    found = _paired(log, ring).filter("end_us is not null")
    return found.select("stage", "iteration", (F.col("end_us") - F.col("t_us")).alias("duration_us"), "batch_size")


def stage_summary(log: DataFrame, ring: int = RING) -> DataFrame:
    """stage, loops, avg_us (of whole microseconds a batch item), valid: whether marks pair up and agree on their batch."""
    found = _paired(log, ring)
    good = found.groupBy("stage").agg(
        F.count("end_us").alias("loops"),
        F.expr("sum((end_us - t_us) div batch_size) div greatest(count(end_us), 1)").alias("avg_us"),
        (F.count_if(F.col("end_us").isNull()) == 0).alias("even"),
        (F.count_if(F.col("end_batch") != F.col("batch_size")) == 0).alias("same_batch"),
    )
    return good.select("stage", "loops", "avg_us", (F.col("even") & F.col("same_batch")).alias("valid"))


def stage_timeline(log: DataFrame, base_us: int = 0, ring: int = RING) -> DataFrame:
    """All begin and end marks as rows, since base_us: stage, iteration, mark, offset_us; sort by offset_us to read it."""
    found = _paired(log, ring).filter("end_us is not null")
    marks = F.array(F.struct(F.lit("begin").alias("mark"), F.col("t_us").alias("t")), F.struct(F.lit("end").alias("mark"), F.col("end_us").alias("t")))
    return found.select("stage", "iteration", F.explode(marks).alias("m")).select("stage", "iteration", "m.mark", (F.col("m.t") - base_us).alias("offset_us"))
