"""Run a streaming query over what its source has and read the result."""

from __future__ import annotations

import time
import uuid

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from kerbside.sources.scratch import folder


#: Rows of a micro-batch: what a task holds of its keys grows with them, so a larger table has more micro-batches, not larger ones.
ROWS = 2_000_000

#: The same for processors that work on columns, whose rows are small.
COLUMN_ROWS = 4_000_000


def cuts_of(df: DataFrame, order: str, parts: int = 3, rows: int = ROWS) -> list:
    """Where a table is cut into about equal ranges of a column: so many, or as many as leave about ``rows`` rows in each."""
    parts = max(parts, -(-df.count() // rows))
    return sorted(set(df.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)], 100 * max(parts, 100))).first()[0] or []))


def _in_turn(spark, path: str, parts: int, empty: DataFrame) -> None:
    """Gives the files of ``path/part_=<k>`` ages in their order, as a source takes files by age; a part without rows gets a file without rows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    start = (int(time.time()) - parts - 1) * 1000
    for k in range(parts):
        place = at(f"{path}/part_={k}")
        if not files.exists(place):
            empty.coalesce(1).write.parquet(place.toString())
        data = [f.getPath() for f in files.listStatus(place) if f.getPath().getName().startswith("part-")]
        for file in data:
            files.setTimes(file, start + k * 1000, -1)
        if len(data) != 1 or files.getFileStatus(data[0]).getModificationTime() != start + k * 1000:
            raise RuntimeError(f"{place.toString()} must hold one file, and its file system must keep the time it is given")


def as_stream(df: DataFrame, name: str, order: str | None = None, parts: int = 3, cuts: list | None = None, rows: int | None = None) -> DataFrame:
    """df as a stream of Parquet files; with order (whole numbers), in micro-batches by ascending ranges of that column, so many or as cuts_of says. All are written in one job, each by a
    task of its own. Sources that are read together get the same cuts, so that they go on side by side. Rows without an order are left out."""
    spark = df.sparkSession
    path = f"{folder(spark)}/kerbside/{name}-in-{uuid.uuid4().hex}"
    if order is None:
        df.write.parquet(path)
        return spark.readStream.schema(df.schema).parquet(path)
    if cuts is None:
        cuts = cuts_of(df, order, parts) if rows is None else cuts_of(df, order, parts, rows)
    n = len(cuts) + 1
    dealt = df.withColumn("order_", F.col(order).cast("double")).filter("order_ is not null").withColumn("part_", F.lit(0))
    if cuts:
        splits = [float("-inf"), *[float(c) + 1 for c in cuts], float("inf")]
        dealt = Bucketizer(splits=splits, inputCol="order_", outputCol="found_").transform(dealt).withColumn("part_", F.col("found_").cast("int")).drop("found_")
    dealt.drop("order_").repartition(n, "part_").write.partitionBy("part_").parquet(path)
    _in_turn(spark, path, n, spark.createDataFrame([], df.schema))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path).select(*df.columns)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything available now, as a table; mode complete keeps the last result of an aggregate."""
    spark = stream.sparkSession
    base = f"{folder(spark)}/kerbside/{name}-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else number}")

    writer: DataStreamWriter = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/log").trigger(availableNow=True)
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out").select(*stream.columns)
