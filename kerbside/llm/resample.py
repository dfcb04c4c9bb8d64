"""Importance resampling towards a target distribution over hashed word n-grams.

Features of a text are its runs of one to ``order`` words; a feature's bucket is its CRC-32 modulo ``buckets``. A byte table lower-cases and blanks
separators in the UTF-8 text, ``split`` gives the words, and a run's CRC-32 seeds that of the run with one word more, so no n-gram is ever put together. Each task counts
in a Counter and puts out a row for each bucket, which Spark adds up. A bucket's gain is the logarithm of how much likelier the target makes it, a text's weight the sum over its
features. Gumbel noise from a hash of the id makes the highest scores a weighted sample without replacement.

What is collected and broadcast are the gains, ``buckets`` numbers. Texts are read twice, once to count and once to weigh, and moved never. Ranks come from ranges of
scores: their sizes are collected, one number a range, and only ranges that hold drawn rows are sorted, each in a task of its own.

Null and empty texts have no features and weight 0. A null id hashes as an empty one and loses ties; repeated rows are drawn each on their own. Very long texts are read whole, in
pieces of ``PIECE`` bytes with the words before them. Without target texts, or without documents, all counts are 0 and the formulas hold. An empty table gives an empty result.
Columns that are carried come back in ``row``, whatever their names; others are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import materialise, shuffle_partitions, slices, small_or_shuffled, utf8
from kerbside.llm.decontaminate import FOLD

#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20


@dataclass(frozen=True)
class ResampleParams:
    order: int = 3
    buckets: int = 10_000
    least_words: int = 20  # of a row that can be drawn
    percent: int = 5
    seed: int = 42
    broadcast_rows: int = 200_000


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, in pieces of a bounded number of bytes (a longer word is one piece)."""
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        end = len(folded) if at + PIECE >= len(folded) else folded.find(b" ", at + PIECE)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def features(text: bytes | None, order: int) -> Iterator[tuple[int, list[list[int]]]]:
    """Of each piece of a text its number of words and the CRC-32s of the runs that end in it, by length."""
    before: list[bytes] = []
    for new in word_pieces(text) if text else ():
        words = before + new
        spaced = [b" " + w for w in words]
        sums = list(map(crc32, words))
        found = [sums[len(before) :]]
        for k in range(1, order):
            sums = list(map(crc32, spaced[k:], sums))
            found.append(sums[max(len(before) - k, 0) :])
        yield len(new), found
        before = words[len(words) - min(len(words), order - 1) :]


def bucket_counts(texts: DataFrame, text_col: str, params: ResampleParams) -> DataFrame:
    """(bucket, n) over all features of all texts."""

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in utf8(part.column(0)).to_pylist():
                    for _, runs in features(text, params.order):
                        for sums in runs:
                            total.update((np.array(sums, np.uint32) % params.buckets).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], names=["bucket", "n"])

    return texts.select(texts[f"`{text_col}`"].alias("text")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_text: str, params: ResampleParams) -> list[int]:
    """For each bucket a thousand times the logarithm of its share in the target over its share in docs, both smoothed by one, rounded down."""
    counts = bucket_counts(docs, text_col, params).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    counts = counts.unionByName(bucket_counts(target, target_text, params).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = materialise(counts.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "resample-buckets")
    total = every.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    d = lambda x: x.cast("double")
    share = d(F.col("t") + 1) * d(F.lit(total.s + params.buckets)) / (d(F.col("s") + 1) * d(F.lit(total.t + params.buckets)))
    full = docs.sparkSession.range(params.buckets).select(F.col("id").cast("int").alias("bucket")).join(every, "bucket", "left").fillna(0, ["s", "t"])
    found = full.select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain")).collect()  # one for each bucket
    return [r.gain for r in sorted(found)]


def weighed(docs: DataFrame, gain: list[int], id_col: str, text_col: str, carry: list[str], params: ResampleParams) -> DataFrame:
    """(n, id, row, n_words, n_features, weight, score) of each row, written; n tells rows apart."""
    held = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))
    row = F.struct(*[docs[f"`{c}`"] for c in carry]) if carry else F.lit(None).cast("int")
    plain = docs.select(F.monotonically_increasing_id().alias("n"), docs[f"`{id_col}`"].cast("long").alias("id"), row.alias("row"), docs[f"`{text_col}`"].alias("text"))
    out = T.StructType([*plain.schema.fields[:3], *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])

    def run(batches):
        gain_of = held.value
        for batch in batches:
            for part in slices(batch):
                found = []
                for text in utf8(part.column(3)).to_pylist():
                    n_words = n_features = weight = 0
                    for n, runs in features(text, params.order):
                        n_words += n
                        for sums in runs:
                            n_features += len(sums)
                            weight += int(gain_of[np.array(sums, np.uint32) % params.buckets].sum())
                    found.append((n_words, n_features, weight))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *[pa.array(x, pa.int64()) for x in zip(*found)]], names=out.names)

    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    return materialise(plain.mapInArrow(run, out).withColumn("score", F.col("weight") + noise), "resample-weighed")


def ranks(scored: DataFrame, params: ResampleParams) -> DataFrame:
    """(n, rank) of the rows drawn."""
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n")]
    able = scored.filter(F.col("n_words") >= params.least_words).select("n", "id", "score")
    ranged = able.repartitionByRange(shuffle_partitions(scored.sparkSession), *order).withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "resample-ranges")
    sizes = sorted((r.part, r.n) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one for each range
    many, before, at = params.percent * sum(n for _, n in sizes) // 100, [], 0
    for part, n in sizes:
        if at < many:
            before.append((part, at))
        at += n
    starts = F.from_json(F.lit(str([n for _, n in before])), "array<bigint>")
    places = F.from_json(F.lit(str([p for p, _ in before])), "array<int>")
    start = F.get(starts, F.array_position(places, F.col("part")).cast("int") - 1)
    last = before[-1][0] if before else -1
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + start
    return ranged.filter(F.col("part") <= last).select("n", rank.cast("long").alias("rank")).filter(F.col("rank") <= many)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", carry: list[str] | None = None, params: ResampleParams = ResampleParams()) -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_features, weight, score, rank (null if it isn't drawn), ``row`` with the columns of carry."""
    carry = carry or []
    gain = gains(docs, target, text_col, target_text, params)
    scored = weighed(docs, gain, id_col, text_col, carry, params)
    drawn = small_or_shuffled(materialise(ranks(scored, params), "resample-drawn"), params.broadcast_rows)
    found = scored.join(drawn, "n", "left").select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank", "row")
    return found if carry else found.drop("row")


def draw(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of docs that are drawn, columns as they were."""
    return resampled(docs, target, id_col, text_col, carry=docs.columns, **params).filter(F.col("rank").isNotNull()).select("row.*")
