"""Keys gathered over the whole corpus and answered back to where they came from.

Documents are dealt into blocks by ranges of their id. A block emits its distinct 64-bit (or wider) keys, sorted, as one compact blob for each
bucket of the key space; a bucket's task merges the blobs of all blocks and sends each block one answer for each of its keys, in the same order. Blobs, not rows, are shuffled: about six bytes a key instead of some forty. A key that
stands in many documents costs one entry a block, so hot keys are aggregated before the shuffle.

Blobs for blocks times buckets would grow with the square of the corpus. From ``GROUP_BLOCKS`` blocks on there are two levels: blocks form groups by ranges of their
ids, and the key space is cut into coarse buckets, each of them again into fine ones. A group's coarse bucket merges the blobs of the group's blocks and then asks the fine buckets as
a block does; its answers are spread over the blocks. Blobs then grow with the blocks, ``GROUP_BLOCKS`` / 2 for each, and with groups times fine buckets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm.common import materialise, shuffle_partitions

#: Blocks for each shuffle partition; there is one bucket for each.
BLOCKS_EACH = 2
#: Text bytes of a block, about; larger tables are dealt into more blocks than the setting asks for.
BLOCK_BYTES = 24 << 20
#: Blocks of a group. Tables of no more blocks have one level of buckets.
GROUP_BLOCKS = 4096


def even_labels(spark: SparkSession, partitions: int, each: int) -> list[int]:
    """Numbers that Spark's hash partitioning deals out evenly: ``each`` for every one of ``partitions``."""
    found: list[list[int]] = [[] for _ in range(partitions)]
    spare: list[int] = []
    tried = spark.range(int(partitions * each * (8 + math.log(partitions + 1)))).select(F.col("id").cast("int").alias("label"))
    for label, part in tried.select("label", F.pmod(F.hash("label"), F.lit(partitions))).collect():
        (found[part] if len(found[part]) < each else spare).append(label)
    missing = partitions * each - sum(map(len, found))
    return sorted([x for part in found for x in part] + spare[:missing])


class Deal:
    """How documents are dealt into blocks and keys into buckets.

    In one group, labels[k] stands for the k-th block or bucket in the columns Spark hashes, so that few of them spread evenly. With several groups there are thousands of each, their numbers spread by
    themselves, and a bucket's label holds its group, too."""

    def __init__(self, docs: DataFrame, text_col: str) -> None:
        spark = docs.sparkSession
        size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
        self.partitions = n = max(shuffle_partitions(spark), -(-size // (BLOCKS_EACH * BLOCK_BYTES)))
        self.groups = -(-n * BLOCKS_EACH // GROUP_BLOCKS)
        self.per_group = -(-n * BLOCKS_EACH // self.groups)
        if self.groups == 1:
            self.coarse, self.fine = n, 1
            self.blocks, self.buckets = even_labels(spark, n, BLOCKS_EACH), even_labels(spark, n, 1)
            self.block_at = {label: k for k, label in enumerate(self.blocks)}
            self.bucket_at = {label: k for k, label in enumerate(self.buckets)}
        else:
            self.coarse = min(n, max(1, GROUP_BLOCKS // BLOCKS_EACH))
            self.fine = -(-n // self.coarse)

    def block_label(self, block: Column) -> Column:
        return F.get(F.from_json(F.lit(str(self.blocks)), "array<int>"), block) if self.groups == 1 else block

    def block_index(self, label: int) -> int:
        return self.block_at[label] if self.groups == 1 else label

    def bucket_label(self, block: int, coarse: int) -> int:
        """The label of a coarse bucket as a block (its label) sees it."""
        return self.buckets[coarse] if self.groups == 1 else block // self.per_group * self.coarse + coarse

    def bucket_index(self, label: int) -> int:
        """The coarse bucket of a label."""
        return self.bucket_at[label] if self.groups == 1 else label % self.coarse

    def fine_labels(self, fine: np.ndarray) -> np.ndarray:
        """Labels of the buckets that settle keys; in one group they are the coarse ones."""
        return (np.array(self.buckets) if self.groups == 1 else np.arange(self.coarse * self.fine))[fine].astype(np.int32)

    def fine_index(self, label: int) -> int:
        return self.bucket_at[label] if self.groups == 1 else label


def _bisected(cuts: Column, key: Column, most: int, right: bool = False) -> Column:
    """Position of the key in a sorted array of at most so many values, before those equal to it or (right) behind them."""

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        there = F.get(cuts, mid)
        up = (s["lo"] < s["hi"]) & ((there <= key) if right else (there < key))
        down = (s["lo"] < s["hi"]) & ~up
        return F.struct(F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(down, mid).otherwise(s["hi"]).alias("hi"))

    begin = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max(1, most.bit_length()))), begin, halve)["lo"]


def _range_of(cuts: Column, key: Column, most: int, share: Column | None) -> Column:
    """The range a key falls into; a range ends with its cut, so a key that several cuts name has as many ranges and is dealt over them by its share of 2**31."""
    first = _bisected(cuts, key, most)
    return first if share is None else first + F.floor(share * (_bisected(cuts, key, most, True) - first) / (1 << 31)).cast("int")


def _percentiles(key: Column, parts: int) -> Column:
    return F.percentile_approx(key, [k / parts for k in range(1, parts)], 100 * parts)


def _literal_ranges(docs: DataFrame, key: Column, parts: int, share: Column) -> Column:
    """Number of each row's range of keys; fewer than ``parts`` cuts are collected. Texts are looked at only if a key needs several ranges."""
    cuts = docs.agg(_percentiles(key, parts)).first()[0] if parts > 1 else None
    if not cuts:
        return F.lit(0)
    return _range_of(F.from_json(F.lit(str(cuts)), "array<bigint>"), key, len(cuts), share if len(set(cuts)) < len(cuts) else None)


def dealt(docs: DataFrame, deal: Deal, id_col: str, text_col: str) -> DataFrame:
    """(block, id, text) partitioned by block. Blocks are ascending ranges of ids, rows without an id first; an id that more rows have than a block
    should hold is dealt over several by the hash of the text. One exchange, used again by all that read it.

    With several groups, the cuts of a group's blocks are a row of a written table, joined to the documents: eight bytes for each block's 24 MB of text, 34 MB in all at 100 TB."""
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    key, hashed = F.coalesce(F.col("id"), F.lit(-(1 << 63))), F.xxhash64("text")
    high, low = F.shiftrightunsigned(hashed, 33), hashed.bitwiseAND((1 << 31) - 1)
    if deal.groups == 1:
        block = _literal_ranges(keyed, key, deal.per_group, high)
    else:
        keyed = keyed.withColumn("group", _literal_ranges(keyed, key, deal.groups, high))
        cuts = materialise(keyed.groupBy("group").agg(_percentiles(key, deal.per_group).alias("cuts")), "block-cuts")
        keyed = keyed.join(F.broadcast(cuts), "group")
        block = F.col("group") * deal.per_group + _range_of(F.col("cuts"), key, deal.per_group, low)
    return keyed.withColumn("at", block).select(deal.block_label(F.col("at")).alias("block"), "id", "text").repartition(deal.partitions, "block")


def answered(sent: DataFrame, deal: Deal, settle, merge, spread, answer_schema: str) -> DataFrame:
    """Answers (block, bucket, ...) to what blocks sent (bucket, block, ...).

    settle takes a table like ``sent`` to its answers. With several groups, merge makes one asker of a coarse bucket's rows (what it returns looks like ``sent``: the fine bucket, the coarse
    bucket's label as block, blobs), and spread takes (its rows, their answers with the fine bucket in ``fine``) to the answers for its blocks."""
    if deal.groups == 1:
        return settle(sent)
    found = settle(sent.groupBy("bucket").applyInArrow(merge, sent.schema))
    found = found.select(F.col("block").alias("bucket"), F.col("bucket").alias("fine"), *[c for c in found.columns if c not in ("block", "bucket")])
    return sent.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(spread, answer_schema)


def packed(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys: differences, byte plane by byte plane, so that the shuffle's compression removes what is zero."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def plane_bytes(values: np.ndarray) -> bytes:
    """Any fixed-width array, byte plane by byte plane."""
    return np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T).tobytes()


def plane_array(blob: bytes, dtype) -> np.ndarray:
    dtype = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Positions at which sorted keys pass from bucket to bucket: ``buckets + 1`` of them."""
    width = (1 << 64) // buckets
    return np.concatenate(([0], np.searchsorted(keys, np.array([k * width for k in range(1, buckets)], np.uint64)), [len(keys)]))


def fine_edges(keys: np.ndarray, deal: Deal, coarse: int) -> np.ndarray:
    """Positions at which a coarse bucket's sorted keys pass from fine bucket to fine bucket."""
    width = (1 << 64) // deal.coarse
    borders = [coarse * width + k * (width // deal.fine) for k in range(1, deal.fine)]
    return np.concatenate(([0], np.searchsorted(keys, np.array(borders, np.uint64)), [len(keys)]))


def sorted_block(table: pa.Table, id_at: int = 1, text_at: int = 2) -> list[tuple[int | None, bytes | None]]:
    """(id, text as bytes) of a block in a fixed order: null ids first, then by id and text (rows of an id that has several blocks are ordered by those first)."""
    rows = zip(table.column(id_at).to_pylist(), table.column(text_at).cast(pa.large_binary()).to_pylist())
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or b""))


#: Distinct words whose hash a worker keeps; when full, the store starts anew.
KEPT_WORDS = 500_000


class WordHashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


word_hashes = WordHashes()


def hashed_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(word_hashes.__getitem__, words), np.uint64, len(words))
