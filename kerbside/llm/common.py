"""Helpers that the training-data operators share: the shared folder, written intermediate tables, word cutting."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that a task takes out of an Arrow batch at a time; bounds the Python objects alive at once.
SLICE_ROWS = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where the session has none, one is made for a local master, as in tests; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kerbside-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that this driver has handed out, in order.
_made: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    _made.append(f"{shared_dir(spark)}/kerbside/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def _delete(spark: SparkSession, folders) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for folder in folders:
        path = hadoop.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialised_alone(spark: SparkSession, make, name: str) -> DataFrame:
    """What make() gives, written and read back; the tables that it wrote on the way are deleted then."""
    begun = len(_made)
    kept = materialise(make(), name)
    _delete(spark, _made[begun:-1])
    del _made[begun:]
    return kept


def release(spark: SparkSession) -> None:
    """Have Spark's cleaner delete the shuffle files of finished steps now: it goes by the driver's garbage collection, which a driver with little to do
    hardly ever needs, so the files of all steps would add up on the executors' disks."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    release(df.sparkSession)
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_spent(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete written tables that nothing will read again."""
    _delete(spark, {file.rsplit("/", 1)[0] for t in tables for file in t.inputFiles()})


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for broadcast only if it has no more than so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> pa.Array:
    """A string column as its UTF-8 bytes, without decoding."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS):
    """A batch in short pieces."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def default_env(name: str, value: str) -> None:
    os.environ.setdefault(name, value)


def check_name(name: str) -> str:
    """Column names that are put in SQL text: plain words only."""
    if not re.fullmatch(r"\w+", name):
        raise ValueError(f"not a plain column name: {name!r}")
    return name
