"""Box geometry as column expressions: formats, letterbox, rescaling, filters, normalising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.operators import ranges


def tlbr_to_tlwh(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    return x0, y0, x1 - x0, y1 - y0


def tlwh_to_tlbr(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    return x, y, x + w, y + h


def tlwh_to_xyah(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, ...]:
    """Centre, aspect ratio, height."""
    return x + w / 2, y + h / 2, w / h, h


def xyah_to_tlwh(cx: Column, cy: Column, a: Column, h: Column) -> tuple[Column, ...]:
    w = a * h
    return cx - w / 2, cy - h / 2, w, h


def with_formats(boxes: DataFrame) -> DataFrame:
    """Adds w, h, cx, cy, aspect to boxes with xmin..ymax."""
    c = [F.col(n).cast("double") for n in ("xmin", "ymin", "xmax", "ymax")]
    x, y, w, h = tlbr_to_tlwh(*c)
    cx, cy, a, _ = tlwh_to_xyah(x, y, w, h)
    return boxes.withColumns({"w": w, "h": h, "cx": cx, "cy": cy, "aspect": a})


def letterbox_geometry(frames: DataFrame, net_w: int = 640, net_h: int = 640, src_w: str = "width", src_h: str = "height") -> DataFrame:
    """Adds ratio, tx, ty: the smaller of both ratios (height's on a tie), and the padding on the other axis, cut to whole pixels."""
    rw, rh = F.lit(float(net_w)) / F.col(src_w), F.lit(float(net_h)) / F.col(src_h)
    by_width = rw < rh
    ratio = F.when(by_width, rw).otherwise(rh)
    pad = lambda net, src: ((F.lit(net) - (F.col(src) * ratio).cast("int")) / 2).cast("int")
    return frames.withColumns({"ratio": ratio, "tx": F.when(by_width, F.lit(0)).otherwise(pad(net_w, src_w)), "ty": F.when(by_width, pad(net_h, src_h)).otherwise(F.lit(0))})


def round_half_away(x: Column) -> Column:
    return F.floor(F.abs(x) + 0.5) * F.signum(x)


def rounded(x: Column | str, digits: int) -> Column:
    """A double at so many decimals, halves away from zero as SQL rounds, in doubles: F.round writes and reads each as a decimal, which takes most of a projection's time.
    What is too large to have such decimals stays as it is, as do infinities and NaN."""
    x = F.col(x) if isinstance(x, str) else x
    t = x * 10.0**digits
    half = 0.49999999999999994  # the double below a half: with it each half still goes up, and what is just below one does not
    whole = F.when(t < 0, t - half).otherwise(t + half).cast("long")
    return F.when(F.abs(t) < 2.0**52, whole / F.lit(10.0**digits)).otherwise(x)


def to_source_pixels(boxes: DataFrame, ratio: Column, tx: Column, ty: Column, width: Column, height: Column) -> DataFrame:
    """Boxes x1, y1, x2, y2 in network space become whole source pixels, clipped to the image."""
    undo = lambda c, t, most: F.greatest(F.lit(0), F.least(round_half_away((F.col(c) - t) / ratio).cast("int"), most.cast("int")))
    return boxes.withColumns({"xmin": undo("x1", tx, width), "ymin": undo("y1", ty, height), "xmax": undo("x2", tx, width), "ymax": undo("y2", ty, height)})


def valid_detections(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes within the frame, edges included."""
    return boxes.filter((F.col("xmin") >= 0) & (F.col("ymin") >= 0) & (F.col("xmax") <= width) & (F.col("ymax") <= height))


def inside(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Whether a published box is wholly inside its frame: strictly off the left and top edge."""
    return (x > 0) & (y > 0) & (w > 0) & (h > 0) & (x + w <= width) & (y + h <= height)


def normalize_boxes(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Adds x_norm, y_norm, w_norm, h_norm in [0, 1]."""
    unit = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))
    return boxes.withColumns(
        {
            "x_norm": unit(F.col("xmin") / width),
            "y_norm": unit(F.col("ymin") / height),
            "w_norm": unit((F.col("xmax") - F.col("xmin")) / width),
            "h_norm": unit((F.col("ymax") - F.col("ymin")) / height),
        }
    )


def score_split(detections: DataFrame, threshold: float) -> DataFrame:
    """Adds is_high: the first association round takes scores from the threshold on."""
    return detections.withColumn("is_high", F.col("confidence") >= threshold)


def cadence_sample(frames: DataFrame, rate: int, by: str = "camera_id", order: str = "frame_id", width: int = ranges.FRAMES) -> DataFrame:
    """Of a camera's k-th frame (from 1) those with (k + 1) % rate = 0; frames are counted in ranges of width numbers."""
    if rate <= 1:
        return frames
    return ranges.numbered(frames, by, order, width, "k_").filter((F.col("k_") + 1) % rate == 0).drop("k_")


def sampled_dense(frames: DataFrame, rate: int, frame: str = "frame_id") -> DataFrame:
    """The same for dense frame numbers from 1: a plain filter, pushed down to the scan."""
    return frames if rate <= 1 else frames.filter((F.col(frame) + 1) % rate == 0)
