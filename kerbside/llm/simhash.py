"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified Hamming links, components.

A fingerprint has 64 bits. Two fingerprints at most ``max_bits`` apart agree on all but ``max_bits`` of
``blocks`` bit ranges, so they share at least one combination of ``blocks - max_bits`` whole ranges. Each
distinct fingerprint is dealt out once for each combination; fingerprints that meet are compared exactly.

Copies are one fingerprint from the start. Within a key only a spanning forest of the links is emitted,
never all pairs, so a group of near copies costs as many rows as it has members. A key that more than ``HOT`` fingerprints share is dealt out again
by the ranges it leaves open, by the same pigeonhole: what still meets agrees on 48 bits of 64, so no task holds more than 65,536 fingerprints of a key.

Null and empty texts have fingerprint zero and link like any other. Rows with a null id are fingerprinted
and get the component of the others with their fingerprint (null if there is none with an id). Texts are taken whole, their shingles counted in
bounded pieces. Repeated rows each get a row. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import drop_spent, materialise, shuffle_partitions, slices, small_or_shuffled, utf8

SEED = 42
#: Shingles whose bits are counted at once; bounds memory for very long texts.
COUNTED_AT_ONCE = 1 << 15
#: Fingerprints of a key from which on it is dealt out again.
HOT = 4096


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of a text: bit i is set if it is set in over half the shingles' XXH64."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and exactly \x20 \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    counts = np.zeros(64, np.int64)
    a, b = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, n, COUNTED_AT_ONCE):
        to = min(n, at + COUNTED_AT_ONCE)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(a[at:to], b[at:to])), np.uint64, to - at)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp, h): fp is the fingerprint as a signed long, h a hash of the text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                found = np.fromiter((fingerprint(t, shingle) for t in utf8(part.column(1)).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.view(np.int64)), part.column(2)], names=["id", "fp", "h"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h")).mapInArrow(run, "id long, fp long, h long")


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """The bit masks of all combinations of ``blocks - max_bits`` ranges."""
    if not 0 <= max_bits < blocks <= 64:
        raise ValueError("0 <= max_bits < blocks <= 64")
    edges = [64 * k // blocks for k in range(blocks + 1)]
    ranges = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(ranges, blocks - max_bits)]


def finer_masks(mask: int, max_bits: int, blocks: int) -> list[int]:
    """Masks that hold ``mask`` and all combinations of ``blocks - max_bits`` of ``blocks`` ranges of the bits it leaves open."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [len(free) * k // blocks for k in range(blocks + 1)]
    ranges = [sum(1 << b for b in free[a:b]) for a, b in zip(edges, edges[1:])]
    return [mask | sum(c) for c in combinations(ranges, blocks - max_bits)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Components (index arrays, two members at least) of the graph on fps that links those at most max_bits apart."""
    rest, out = np.arange(len(fps)), []
    while len(rest):
        todo, members, rest = [rest[0]], [rest[:1]], rest[1:]
        while todo and len(rest):
            near = np.bitwise_count(fps[rest] ^ fps[todo.pop()]) <= max_bits
            if near.any():
                members.append(rest[near])
                todo.extend(rest[near])
                rest = rest[~near]
        if len(members) > 1:
            out.append(np.concatenate(members))
    return out


def links(distinct: DataFrame, max_bits: int = 3, blocks: int = 6, hot: int = HOT) -> DataFrame:
    """Edges (a, b), b < a, whose components are those of all links; distinct: (node, fp), one row a fingerprint."""
    spark, masks = distinct.sparkSession, block_masks(blocks, max_bits)
    def under(some: DataFrame, combos: list[tuple[int, int]]) -> DataFrame:
        """some, dealt out once for each (number, mask)."""
        keys = F.array(*[F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in combos])
        return some.select("node", "fp", F.explode(keys).alias("k")).select("k.combo", "k.key", "node", "fp")

    dealt = under(distinct, list(enumerate(masks)))
    crowded = materialise(dealt.groupBy("combo", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("combo", "key"), "simhash-hot")
    found = sorted(r.combo for r in crowded.select("combo").distinct().collect())  # by the number of masks
    if found:
        few = small_or_shuffled(crowded, 100_000)
        held_apart = dealt.join(few, ["combo", "key"], "left_semi")
        dealt = dealt.join(few, ["combo", "key"], "left_anti")
        for k in found:
            finer = finer_masks(masks[k], max_bits, blocks)
            dealt = dealt.unionByName(under(held_apart.filter(F.col("combo") == k), [((k + 1) * len(masks) + i, m) for i, m in enumerate(finer)]))
    dealt = dealt.repartition(shuffle_partitions(spark), "combo", "key").sortWithinPartitions("combo", "key")

    def run(batches):
        held: list[np.ndarray] = []

        def edges(combo, key, node, fp):
            cut = np.flatnonzero((combo[1:] != combo[:-1]) | (key[1:] != key[:-1])) + 1
            starts, ends = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            many = ends - starts > 1
            for s, e in zip(starts[many].tolist(), ends[many].tolist()):
                for members in forest(fp[s:e].view(np.uint64), max_bits):
                    ids = node[s:e][members]
                    low = ids.min()
                    yield ids[ids != low], low

        def table(found):
            found = list(found)
            if found:
                a = np.concatenate([x for x, _ in found])
                b = np.concatenate([np.full(len(x), low) for x, low in found])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now = [np.concatenate(x) for x in zip(held, now)] if held else now
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last key may go on in the next batch
            held = [x[cut:] for x in now]
            if cut:
                yield from table(edges(*[x[:cut] for x in now]))
        if held and len(held[0]):
            yield from table(edges(*held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is one node of the component, the same for all.

    Alternating large and small stars; each round is written to the shared folder. A round keeps the number
    of edges, and the rounds needed grow with the logarithm of the longest chain.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), name)
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("low").alias("b")), F.struct("a", F.col("low").alias("b")))).alias("e"))
        spent, now = now, materialise(small.select("e.a", "e.b").filter("a <> b").distinct(), name)
        drop_spent(edges.sparkSession, spent)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def hex64(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 3, blocks: int = 6) -> DataFrame:
    """One row for each row of docs: id, fingerprint (hex), component_id (smallest id reachable over links), text_hash.

    Equal ids stay separate rows. An empty table gives an empty result.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    distinct = materialise(fps.groupBy("fp").agg(F.min("id").alias("low")), "simhash-distinct")
    roots = components(links(distinct.select(F.col("fp").alias("node"), "fp"), max_bits, blocks), "simhash-stars")
    members = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = members.groupBy("root").agg(F.min("low").alias("component_id"))
    known = members.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return fps.join(known, "fp", "left").select(F.col("id").alias(id_col), hex64(F.col("fp")).alias("fingerprint"), "component_id", F.col("h").alias("text_hash"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000, **params) -> DataFrame:
    """docs without the rows whose component has a smaller id; rows without an id stay. Columns pass through, whatever their names."""
    return without_later(docs, near_duplicates(docs, id_col, text_col, **params), id_col, text_col, broadcast_rows)


def without_later(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, broadcast_rows: int) -> DataFrame:
    """docs without the rows for which found (id, component_id, text_hash) has a smaller component_id."""
    later = found.filter(F.col("component_id") < F.col(id_col)).select(F.col(id_col).alias("__later"), F.col("text_hash").alias("__hash")).distinct()
    later = small_or_shuffled(materialise(later, "simhash-later"), broadcast_rows)
    same = (docs[f"`{id_col}`"] == later["__later"]) & (F.xxhash64(docs[f"`{text_col}`"]) == later["__hash"])
    return docs.join(later, same, "left_anti")
