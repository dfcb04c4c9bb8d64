"""Frame sources: images from files or tables, in batch or as a stream, what can't be decoded set apart."""

from __future__ import annotations

import struct
import uuid
import zlib
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.operators.health import code_of
from kerbside.sources.bundles import filesystem

#: Of Spark's image source.
IMAGE = "image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"


def split_decoded(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, rejects): rejects have no pixels, or not as many as their size says; they carry a health code."""
    data = F.col("image.data")
    whole = F.coalesce((F.octet_length(data) > 0) & (F.octet_length(data) == F.col("image.height") * F.col("image.width") * F.col("image.nChannels")), F.lit(False))
    return images.filter(whole), images.filter(~whole).withColumn("code", F.lit(code_of("undecodable")))


def read_frames(spark: SparkSession, path: str, stream: bool = False) -> tuple[DataFrame, DataFrame]:
    """Image files of a folder, or the stream of those that come into it."""
    if stream:
        return split_decoded(spark.readStream.format("image").schema(IMAGE).option("dropInvalid", False).load(path))
    return split_decoded(spark.read.format("image").option("dropInvalid", False).load(path))


def read_table(spark: SparkSession, path: str, stream: bool = False, schema: str = IMAGE) -> tuple[DataFrame, DataFrame]:
    """Parquet rows with an image struct; a stream takes its rows' schema and reads nothing before it starts."""
    return split_decoded(spark.readStream.schema(schema).parquet(path) if stream else spark.read.parquet(path))


def png(bgr: np.ndarray) -> bytes:
    """A 3-channel image as a PNG file."""
    h, w, _ = bgr.shape
    lines = np.concatenate([np.zeros((h, 1), np.uint8), bgr[:, :, ::-1].reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_frames(images: DataFrame, path: str, id_col: str = "img_id") -> DataFrame:
    """Images (id, image) as files ``<id>.png`` of a folder; those without whole pixels as files that hold what there is. (id, bytes), as it is written."""

    def run(batches):
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(path) if urlsplit(path).scheme else (fs.LocalFileSystem(), path)
        files.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for key, h, w, data in zip(*(c.to_pylist() for c in batch.columns)):
                whole = data is not None and len(data) == h * w * 3
                file = png(np.frombuffer(data, np.uint8).reshape(h, w, 3)) if whole else data or b""
                with files.open_output_stream(f"{root}/{key}.png") as out:
                    out.write(file)
                sizes.append(len(file))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["id", "bytes"])

    flat = images.select(F.col(id_col).cast("long").alias("id"), "image.height", "image.width", "image.data")
    return flat.mapInArrow(run, "id long, bytes long")


def unpng(file: bytes) -> tuple[int, int, bytes]:
    """Height, width and pixels (BGR) of a PNG file as png makes it; of anything else -1, -1 and none."""
    at, size, lines = 8, None, b""
    try:
        if file[:8] != b"\x89PNG\r\n\x1a\n":
            raise ValueError("no PNG file")
        while (kind := file[at + 4 : at + 8]) != b"IEND":
            (n,) = struct.unpack_from(">I", file, at)
            data = file[at + 8 : at + 8 + n]
            if struct.unpack_from(">I", file, at + 8 + n)[0] != zlib.crc32(kind + data):
                raise ValueError("a broken part")
            if kind == b"IHDR":
                *size, depth, colours, _, _, turns = struct.unpack(">IIBBBBB", data)
                if (depth, colours, turns) != (8, 2, 0):
                    raise ValueError("not of 3 plain channels")
            elif kind == b"IDAT":
                lines += data
            at += 12 + n
        w, h = size
        rows = np.frombuffer(zlib.decompress(lines), np.uint8).reshape(h, 1 + 3 * w)
        if rows[:, 0].any():
            raise ValueError("lines are filtered")
    except (ValueError, TypeError, struct.error, zlib.error):
        return -1, -1, b""
    return h, w, rows[:, 1:].reshape(h, w, 3)[:, :, ::-1].tobytes()


#: The index of bundles of image files.
FRAMES_INDEX = "id long, file string, offset long, length long"


def write_frame_bundles(images: DataFrame, path: str, id_col: str = "img_id", images_a_file: int = 10_000) -> DataFrame:
    """Images (id, image) as PNG files, many in a bundle one after the other; those without whole pixels as what there is. Returns the index (FRAMES_INDEX), written to
    ``<path>/index``: what is listed are bundles, not images. A task that runs again writes bundles of its own, and the index names those of the run that counts."""

    def run(batches):
        files, root = filesystem(path)
        files.create_dir(f"{root}/bundles", recursive=True)
        out, name, at, held = None, "", 0, 0
        for batch in batches:
            rows = []
            for key, h, w, data in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or held >= images_a_file:
                    if out is not None:
                        out.close()
                    name, at, held = f"bundles/{uuid.uuid4().hex}.bin", 0, 0
                    out = files.open_output_stream(f"{root}/{name}")
                whole = data is not None and len(data) == h * w * 3
                file = png(np.frombuffer(data, np.uint8).reshape(h, w, 3)) if whole else data or b""
                out.write(file)
                rows.append((key, name, at, len(file)))
                at, held = at + len(file), held + 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["id", "file", "offset", "length"])
        if out is not None:
            out.close()

    flat = images.select(F.col(id_col).cast("long").alias("id"), "image.height", "image.width", "image.data")
    flat.mapInArrow(run, FRAMES_INDEX).write.parquet(f"{path}/index")
    return images.sparkSession.read.schema(FRAMES_INDEX).parquet(f"{path}/index")


def read_frame_bundles(index: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(frames, rejects) of an index: id and image as of Spark's image source, each read by its place alone; origin is ``<file>#<offset>``."""

    def run(batches):
        files, root = filesystem(path)
        now, stream = None, None
        for batch in batches:
            found = []
            for key, file, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                if file != now:
                    if stream is not None:
                        stream.close()
                    now, stream = file, files.open_input_file(f"{root}/{file}")
                h, w, data = unpng(stream.read_at(n, at))
                found.append((key, f"{file}#{at}", h, w, 3 if h > 0 else -1, 16 if h > 0 else -1, data))
            if found:
                types = (pa.int64(), pa.string(), *[pa.int32()] * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=["id", "origin", "height", "width", "nChannels", "mode", "data"])
        if stream is not None:
            stream.close()

    dealt = index.select("id", "file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    read = dealt.mapInArrow(run, "id long, origin string, height int, width int, nChannels int, mode int, data binary")
    return split_decoded(read.select("id", F.struct("origin", "height", "width", "nChannels", "mode", "data").alias("image")))
