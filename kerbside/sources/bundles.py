"""Many small named texts in few files: a task writes the texts of its part of the names, one after the other, into a bundle of each day, and says where each stands.

Bundles are plain text in which each text ends with an empty line; the index (name, file, offset, length) is Parquet beside them. A task that runs again writes the same
bytes under a name of its own attempt and moves them to the same name. Names are as given, such as ``<day>/tracks/<file>.txt``.
"""

from __future__ import annotations

from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INDEX = "day string, key string, name string, file string, offset long, length long"


def filesystem(folder: str):
    """The file system of a folder or its URI, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if urlsplit(folder).scheme else (fs.LocalFileSystem(), folder)


def write_bundles(texts: DataFrame, folder: str, texts_a_file: int = 10_000, label: str = "texts") -> DataFrame:
    """texts: day, key, name, text. Written below folder, ``<day>/<label>-<part>.txt``; returns the index, which is written to ``<folder>/index``."""
    parts = max(1, -(-texts.count() // texts_a_file))
    dealt = texts.select("day", "key", "name", "text").repartitionByRange(parts, "day", "name", "key").sortWithinPartitions("day", "name", "key")

    def run(batches):
        files, root = filesystem(folder)
        context = TaskContext.get()
        day, out, at, name = None, None, 0, ""

        def close():
            out.close()
            try:
                files.move(f"{root}/{name}.part-{context.taskAttemptId()}", f"{root}/{name}")
            except OSError:  # another attempt was first; it wrote the same bytes
                files.delete_file(f"{root}/{name}.part-{context.taskAttemptId()}")

        for batch in batches:
            rows: list[tuple] = []
            for of, key, path, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if of != day or out is None:
                    if out is not None:
                        close()
                    day, at, name = of, 0, f"{of}/{label}-{context.partitionId():06d}.txt"
                    files.create_dir(f"{root}/{of}", recursive=True)
                    out = files.open_output_stream(f"{root}/{name}.part-{context.taskAttemptId()}")
                data = (text or "").encode()
                out.write(data + b"\n\n")
                rows.append((of, key, path, name, at, len(data)))
                at += len(data) + 2
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.string()] * 4 + [pa.int64()] * 2)], names=["day", "key", "name", "file", "offset", "length"])
        if out is not None:
            close()

    dealt.mapInArrow(run, INDEX).write.mode("append").parquet(f"{folder}/index")
    return texts.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """The texts of an index: day, key, name, text; each read by its place alone."""

    def run(batches):
        files, root = filesystem(folder)
        now, stream = None, None
        for batch in batches:
            day, key, name, file, offset, length = (batch.column(k).to_pylist() for k in range(6))
            found = []
            for f, at, n in zip(file, offset, length):
                if f != now:
                    if stream is not None:
                        stream.close()
                    now, stream = f, files.open_input_file(f"{root}/{f}")
                found.append(stream.read_at(n, at).decode())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (day, key, name, found)], names=["day", "key", "name", "text"])
        if stream is not None:
            stream.close()

    dealt = index.select("day", "key", "name", "file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "day string, key string, name string, text string")
