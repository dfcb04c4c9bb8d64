"""Image quality scores; pixels stay in binary rows and numpy sees images of one size together, a large one alone.

Scores rise with the named property, but for snow and sharpness, which rise with quality, as in systems that report them so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StringType, StructField, StructType

#: 15-bit weights of blue, green and red in luma, and of linear blue, green and red in CIE Y (fixed values).
LUMA = (3735, 19235, 9798)
CIE_Y = (0.072169, 0.715160, 0.212671)
BRIGHT, EDGE, DARK = 60, 15, 16
#: Pixels of small images that are scored at once.
PIXELS = 1 << 16


def luma(bgr: np.ndarray) -> np.ndarray:
    b, g, r = (bgr[..., k].astype(np.int32) for k in range(3))
    return (b * LUMA[0] + g * LUMA[1] + r * LUMA[2] + (1 << 14)) >> 15


def smooth(gray: np.ndarray) -> np.ndarray:
    """[1 2 1] both ways over 16, rounded; borders mirror without the edge pixel."""
    p = np.pad(gray, [(0, 0)] * (gray.ndim - 2) + [(1, 1), (1, 1)], mode="reflect")
    rows = p[..., :-2, :] + 2 * p[..., 1:-1, :] + p[..., 2:, :]
    return (rows[..., :-2] + 2 * rows[..., 1:-1] + rows[..., 2:] + 8) >> 4


def _sum(x: np.ndarray) -> np.ndarray:
    return x.sum(axis=(-2, -1), dtype=np.int64)


# Scores of images (..., height, width, 3).


def brightness(bgr: np.ndarray) -> np.ndarray:
    level = np.arange(256) / 255.0
    linear = np.where(level <= 0.04045, level / 12.92, ((level + 0.055) / 1.055) ** 2.4)
    y = linear[bgr] @ np.array(CIE_Y)
    return np.where(y > 0.008856, 116 * np.cbrt(y) - 16, 903.3 * y).mean(axis=(-2, -1)) / 100


def daynight(bgr: np.ndarray) -> np.ndarray:
    high = _sum(bgr.max(axis=-1) > BRIGHT)
    return (high > bgr.shape[-3] * bgr.shape[-2] - high).astype(float)


def snow(bgr: np.ndarray) -> np.ndarray:
    gray = luma(bgr)
    signal = np.maximum(1.0, _sum(gray**2) / 255**2)
    noise = np.maximum(1.0, _sum((gray - smooth(gray)) ** 2) / 255**2)
    return 20 * np.log10(signal / noise) / 100


def sharpness(bgr: np.ndarray) -> np.ndarray:
    gray = luma(bgr)
    soft = smooth(gray)
    shares = []
    for axis in (-2, -1):
        f, b = np.abs(np.diff(gray, axis=axis)), np.abs(np.diff(soft, axis=axis))
        shares.append((_sum(f) - _sum(np.maximum(0, f - b))) / (_sum(f) + 1.0))
    return 1 - np.maximum(*shares)


def occlusion(bgr: np.ndarray) -> np.ndarray:
    """One less the share of edge pixels (right plus lower difference of smoothed luma) that are strong."""
    soft = smooth(luma(bgr))
    edge = np.zeros(soft.shape, np.int32)
    edge[..., :-1] += np.abs(np.diff(soft, axis=-1))
    edge[..., :-1, :] += np.abs(np.diff(soft, axis=-2))
    return 1 - _sum(edge > EDGE) / np.maximum(1, _sum(edge > 0))


def black(bgr: np.ndarray) -> np.ndarray:
    return (luma(bgr) <= DARK).mean(axis=(-2, -1))


METRICS = {"brightness": brightness, "daynight": daynight, "snow": snow, "sharpness": sharpness, "occlusion": occlusion, "black": black}


def _alike(height: list, width: list, data: list):
    """(row numbers, pixels): images of one size together, some PIXELS at a time."""
    sizes: dict[tuple, list[int]] = {}
    for k, size in enumerate(zip(height, width)):
        if len(data[k]) != size[0] * size[1] * 3:
            raise ValueError(f"an image of {size[0]} x {size[1]} pixels has {len(data[k])} bytes")
        sizes.setdefault(size, []).append(k)
    for (h, w), rows in sizes.items():
        step = max(1, PIXELS // max(1, h * w))
        for at in range(0, len(rows), step):
            few = rows[at : at + step]
            yield few, np.frombuffer(b"".join(data[k] for k in few), np.uint8).reshape(len(few), h, w, 3)


def score_images(images: DataFrame, id_col: str = "img_id", metrics: tuple[str, ...] = tuple(METRICS), carry: list[str] | None = None) -> DataFrame:
    """(id, metric, score) of images (id, image: Spark's struct of 3-channel BGR pixels), and the columns of carry."""
    flat = images.select(F.col(id_col).cast("long").alias("id"), "image.height", "image.width", "image.data", *(carry or []))
    kept = [flat.schema.fields[0], *flat.schema.fields[4:]]
    out = StructType([*kept, StructField("metric", StringType()), StructField("score", DoubleType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                height, width, data = (c.to_pylist() for c in part.columns[1:4])
                scores = np.empty((part.num_rows, len(metrics)))
                for few, bgr in _alike(height, width, data):
                    scores[few] = np.stack([METRICS[m](bgr) for m in metrics], axis=-1)
                named = pa.array(np.repeat(np.arange(part.num_rows), len(metrics)))
                columns = [c.take(named) for c in (part.column(0), *part.columns[4:])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(metrics) * part.num_rows, pa.string()), pa.array(scores.ravel())], schema=arrow)

    return flat.mapInArrow(run, out).withColumnRenamed("id", id_col)


#: Pixels of an image's row, side by side, that one aggregate puts together; a power of two.
SLOTS = 16


def _gathered(batches, keyed):
    """Batches (img_id, row, block, many, a colour for each of SLOTS columns) as batches with a row for each image's run of them: img_id, and the pixels' places and colours as bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        row, block, many = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, 4))
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        null = ids.is_null().to_numpy(zero_copy_only=False)
        edges = np.concatenate(([0], np.flatnonzero((number[1:] != number[:-1]) | (null[1:] != null[:-1])) + 1, [len(number)]))
        there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[4:]], axis=1)
        colour = np.stack([c.fill_null(-1).to_numpy(zero_copy_only=False) for c in batch.columns[4:]], axis=1)
        place = (row.astype(np.int64)[:, None] << 32) + block.astype(np.int64)[:, None] * SLOTS + np.arange(SLOTS)
        times = there.astype(np.int64)
        times[np.arange(len(row)), np.argmax(colour, axis=1)] += np.maximum(many - (colour >= 0).sum(axis=1), 0)  # a pixel given twice is there twice, so that the image shows as broken
        ends = np.concatenate(([0], np.cumsum(times.sum(axis=1))))[edges]
        blobs = [_bytes_at(np.repeat(x.ravel(), times.ravel()), ends) for x in (place, colour)]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(edges[:-1])), *blobs], schema=keyed)


def _bytes_at(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Runs of values as binary rows."""
    offsets = (edges * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _bytes_of(column: pa.Array, start: int, end: int, kind) -> np.ndarray:
    """The values of binary rows, one after the other; the reverse of _bytes_at."""
    _, offsets, data = column.buffers()
    a, b = np.frombuffer(offsets, np.int32)[[column.offset + start, column.offset + end]].tolist()
    return np.frombuffer(data.slice(a, b - a) if b > a else b"", kind)


def _in_order(image: np.ndarray, places: np.ndarray, colours: np.ndarray) -> np.ndarray:
    """Row numbers by image, place and colour; one key is much faster to sort than three."""
    r, c = (places >> 32) + 1, places.astype(np.int32).astype(np.int64) + 1
    height, width = int(r.max()) + 1, int(c.max()) + 1
    if int(min(r.min(), c.min())) >= 0 and (int(image[-1]) + 1) * height * width < 1 << 62:
        key = (image * height + r) * width + c
        by = np.argsort(key)
        if not (np.diff(key[by]) == 0).any():
            return by
    return np.lexsort((colours, places, image))


def _some_images(batch):
    """(ids, places, colours, edges) of the images of a batch (img_id, runs), some PIXELS of small images at a time; edges are where an image's pixels begin, and the end."""
    runs = batch.column(1)
    lists = runs.offsets.to_numpy()  # a list's begin among all runs of the batch
    flat = runs.values
    size = pa.compute.binary_length(flat.field("colours")).to_numpy(zero_copy_only=False) // 4
    begins = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))[lists]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + PIXELS, "right")) - 1)
        places, colours = (_bytes_of(flat.field(name), lists[at], lists[to], kind) for name, kind in (("places", np.int64), ("colours", np.int32)))
        yield batch.column(0).slice(at, to - at), places, colours, begins[at : to + 1] - begins[at]
        at = to


def packed(pixels: DataFrame) -> DataFrame:
    """Long-form pixels (img_id, r, c, b, g, rr) to (img_id, image). Pixels that stand side by side are put together by a compiled aggregate, so that runs of pixels, not pixels, are
    shuffled and go to Python."""
    c = F.col
    column = F.coalesce("c", F.lit(-1)).cast("int")
    colour = F.coalesce(F.shiftleft(c("b").cast("int"), 16) + F.shiftleft(c("g").cast("int"), 8) + c("rr"), F.lit(-1)).cast("int")
    each = pixels.select("img_id", F.coalesce("r", F.lit(-1)).cast("int").alias("row"), column.alias("column"), colour.alias("colour"))
    block = F.shiftright("column", SLOTS.bit_length() - 1)
    slots = [F.max(F.when(c("column").bitwiseAND(SLOTS - 1) == k, c("colour"))).alias(f"s{k}") for k in range(SLOTS)]
    rows = each.groupBy("img_id", "row", block.alias("block")).agg(F.count(F.when(c("colour") >= 0, 1)).alias("many"), *slots)
    runs_schema = StructType([rows.schema["img_id"], StructField("places", BinaryType()), StructField("colours", BinaryType())])
    keyed = to_arrow_schema(runs_schema)
    pieces = rows.mapInArrow(lambda batches: _gathered(batches, keyed), runs_schema)
    whole = pieces.groupBy("img_id").agg(F.collect_list(F.struct("places", "colours")).alias("runs"))
    out = StructType([rows.schema["img_id"], StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("data", BinaryType())])
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part, places, colours, edges in _some_images(batch):
                image = np.repeat(np.arange(len(part)), np.diff(edges))
                by = _in_order(image, places, colours)
                colours, kept = colours[by], colours[by] >= 0
                sizes = [np.maximum.reduceat(x, edges[:-1]).astype(np.int32) + 1 for x in (places >> 32, places.astype(np.int32))]
                ends = np.concatenate(([0], np.cumsum(kept)))[edges] * 3
                pixels = colours[kept].astype(">i4").view(np.uint8).reshape(-1, 4)[:, 1:].ravel()
                yield pa.RecordBatch.from_arrays([part, *map(pa.array, sizes), _bytes_at(pixels, ends)], schema=arrow)

    image = F.struct(F.lit("").alias("origin"), "height", "width", F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), "data")
    return whole.mapInArrow(run, out).select("img_id", image.alias("image"))
