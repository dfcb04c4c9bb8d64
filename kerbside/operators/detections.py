"""From raw network outputs to detections: dequantise, decode, non-maximum suppression."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from kerbside.operators.arrow import ranges_of, whole_runs

FRAME = ("camera_id", "frame_id")


def dequantize(df: DataFrame, column: str, scale: float, names: tuple[str, ...] | None = None) -> DataFrame:
    """An array of quantised values becomes floats. With names each value becomes a column in the array's place, null beyond the array's end: compiled, as lambdas over
    arrays are not."""
    if names is None:
        return df.withColumn(column, F.transform(column, lambda v: v.cast("double") * scale))
    return df.withColumns({n: F.get(column, F.lit(i)).cast("double") * scale for i, n in enumerate(names)}).drop(column)


def corners(df: DataFrame) -> DataFrame:
    """Adds x1, y1, x2, y2 to boxes given by centre and size."""
    x1, y1 = F.col("cx") - F.col("w") / 2, F.col("cy") - F.col("h") / 2
    return df.withColumns({"x1": x1, "y1": y1, "x2": x1 + F.col("w"), "y2": y1 + F.col("h")})


def decode_multilabel(raw: DataFrame, threshold: float = 0.35) -> DataFrame:
    """A row for each box and class whose confidence is over the threshold; classes count from 1."""
    every = raw.select(*FRAME, "box_idx", "cx", "cy", "w", "h", F.posexplode("cls_conf").alias("class_id", "score"))  # compiled, as lambdas over arrays are not
    return corners(every.filter(F.col("score") > threshold).withColumn("class_id", F.col("class_id") + 1)).drop("cx", "cy", "w", "h")


def decode_best_class(raw: DataFrame, threshold: float = 0.35) -> DataFrame:
    """The best class of each box, the first of equals, if it is over the threshold; classes count from 0."""
    best = F.greatest(F.lit(0.0), F.array_max("cls_conf"))
    at = F.coalesce(F.nullif(F.array_position("cls_conf", best), F.lit(0)), F.lit(1)) - 1
    found = raw.withColumns({"score": best, "class_id": at.cast("int")}).filter(F.col("score") > threshold)
    return corners(found).drop("cx", "cy", "w", "h", "cls_conf")


def iou(a: Column, b: Column, plus_one: bool) -> Column:
    """Of structs with x1, y1, x2, y2; with plus_one pixels count as wide as they are."""
    one = 1 if plus_one else 0
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]) + one)
    area = lambda x: (x["x2"] - x["x1"] + one) * (x["y2"] - x["y1"] + one)
    inter = side("x1", "x2") * side("y1", "y2")
    return inter / (area(a) + area(b) - inter)


def top_detections(df: DataFrame, n: int = 300, keys: tuple[str, ...] = FRAME) -> DataFrame:
    """The n best of each frame; ties by box."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "class_id", "x1", "y1", "x2", "y2")
    return df.withColumn("rank_", F.row_number().over(order)).filter(F.col("rank_") <= n).drop("rank_")


#: Pairs of boxes of a batch that are compared at once.
PAIRS = 1 << 20


def _iou(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    side = lambda lo, hi: np.maximum(0.0, np.minimum(a[hi], b[hi]) - np.maximum(a[lo], b[lo]))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    inter = side(0, 2) * side(1, 3)
    return inter / np.maximum(area(a) + area(b) - inter, np.finfo(float).tiny)


def conflicts(group: np.ndarray, box: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (better, worse) of the pairs of one group whose overlap is over the threshold; group: ascending numbers, rows of a group best first. Within a group boxes are
    swept by their left edges, so only boxes that meet in x are compared."""
    by = np.lexsort((box[0], group))
    low = box[0].min()
    far = np.maximum(box[2], box[0])
    place = group[by] * (far.max() - low + 1.0)  # groups one beside the other
    left, right = place + box[0][by] - low, place + far[by] - low
    after = np.arange(1, len(by) + 1)
    many = np.maximum(np.searchsorted(left, right, "right") - after, 0)
    cuts = np.searchsorted(np.cumsum(many), np.arange(PAIRS, many.sum() + PAIRS, PAIRS), "left") + 1
    better, worse, start = [], [], 0
    for end in np.minimum(np.unique(cuts), len(by)).tolist():
        of, other = ranges_of(after[start:end], many[start:end])
        a, b = by[of + start], by[other]
        found = _iou([c[a] for c in box], [c[b] for c in box]) > threshold
        a, b = a[found], b[found]
        better.append(np.minimum(a, b))
        worse.append(np.maximum(a, b))
        start = end
    return np.concatenate([np.zeros(0, int), *better]), np.concatenate([np.zeros(0, int), *worse])


def kept_of(n: int, better: np.ndarray, worse: np.ndarray) -> np.ndarray:
    """Which of n rows greedy suppression keeps: those that no kept better one conflicts with. Rows whose better ones are all settled are settled together."""
    kept, gone = np.zeros(n, bool), np.zeros(n, bool)
    while len(better):
        waits = np.zeros(n, bool)
        waits[worse] = True
        settled = ~waits[better]  # nothing better than the better one is open
        gone[worse[settled]] = True
        left = ~settled & ~gone[worse] & ~gone[better]
        better, worse = better[left], worse[left]
    kept[~gone] = True
    return kept


def nms(candidates: DataFrame, threshold: float = 0.45, keys: tuple[str, ...] = FRAME, per_class: bool = True, most: int | None = 300) -> DataFrame:
    """Greedy suppression: best first, what overlaps a kept box by more than the threshold goes; of each frame the ``most`` best stay. Ties go by box position.

    Frames come sorted in Arrow batches, many at a time; within a frame (of one class with per_class) only boxes that meet are compared, and what no open better box
    conflicts with is settled in one step for all frames of a batch.
    """
    columns = ["class_id", "score", "x1", "y1", "x2", "y2"]
    rows = candidates.select(*keys, F.col("class_id").cast("int").alias("class_id"), *[F.col(c).cast("double").alias(c) for c in columns[1:]])
    n_keys = len(keys)

    def run(batches):
        for table, edges in whole_runs(batches, n_keys):
            cls, score, *box = table[n_keys:]
            frame = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            group = frame * (int(cls.max()) - int(cls.min()) + 1) + cls - cls.min() if per_class else frame
            by = np.lexsort((cls, *box[::-1], -score, group))
            stays = by[kept_of(len(by), *conflicts(group[by], [c[by] for c in box], threshold))]
            if most is not None:
                stays = stays[np.lexsort((*[c[stays] for c in box[::-1]], cls[stays], -score[stays], frame[stays]))]
                first = np.searchsorted(frame[stays], frame[stays])
                stays = stays[np.arange(len(stays)) - first < most]
            stays = np.sort(stays)
            yield pa.RecordBatch.from_arrays([pa.array(c[stays], f.type) for c, f in zip(table, schema)], schema=schema)

    schema = to_arrow_schema(rows.schema)
    found = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, rows.schema)
    return found if per_class else found.select(*keys, *columns[1:], "class_id")
