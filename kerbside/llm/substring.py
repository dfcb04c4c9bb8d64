"""Exact removal of repeated word windows, by Rabin-Karp hashes of every fixed-length window.

Each block of documents hashes all its windows (a polynomial over the words' 64-bit hashes, rolled by prefix sums, in two lanes: 96 bits
together) and sends its distinct hashes to the bucket that owns them. A bucket counts every hash over all blocks and tells all blocks but the
first in id order that the window starts earlier elsewhere; of many blocks, groups of them do so first (``blocks``). Within a block all but the first start are known to be repeats. Covered words merge
into maximal intervals.

Windows are told apart by 96 bits. With N windows the chance that any two different ones meet is about N*N / 2**97: below 1e-12 for
1e8 windows, about 0.4 % for the 2.4e13 windows of 100 TB.

Null and empty texts have no words. Rows without an id count as earlier than all others; rows of equal id are ordered by
text (where so many have one id that they fill several blocks, by ranges of the text's hash first), and equal rows repeat each other. Texts are taken whole; a text is in one block.
An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kerbside.llm import blocks

#: Odd multipliers of the two lanes, and the constants that finish a hash (fixed values of a well-known 64-bit mixer).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(31))


def rolled(words: np.ndarray, starts: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of the ``width`` words from each start: differences of prefix sums, brought to the same power."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.full(len(words), base, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power, dtype=np.uint64)))
    back = np.full(len(words), pow(base, -1, 1 << 64), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return _mixed((sums[starts + width] - sums[starts]) * back[starts])


class Block:
    """A block's documents cut into words, with the distinct hashes of its windows."""

    def __init__(self, rows: list, width: int) -> None:
        self.rows, self.width = rows, width
        self.words = [text.split() if text else [] for _, text in rows]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(rows))
        hashes = np.concatenate([np.zeros(0, np.uint64), *[blocks.hashed_words(w) for w in self.words]])
        ends = np.cumsum(self.sizes)
        self.begins = ends - self.sizes
        allowed = np.ones(len(hashes) + 1, np.int64)
        for k in range(1, width):  # the last width - 1 words of each document start no window
            allowed[np.maximum(ends - k, self.begins)] = 0
        allowed[-1] = 0
        short = self.sizes < width
        for b, e in zip(self.begins[short].tolist(), ends[short].tolist()):
            allowed[b:e] = 0
        self.starts = np.flatnonzero(allowed[: len(hashes)])
        lane1, lane2 = (rolled(hashes, self.starts, width, b) for b in BASES)
        lane2 = (lane2 >> np.uint64(32)).astype(np.uint32)
        order = np.argsort(lane1)
        a, b = lane1[order], lane2[order]
        same = a[1:] == a[:-1]
        if (b[1:] != b[:-1])[same].any():  # lanes disagree somewhere: sort by both
            order = np.lexsort((lane2, lane1))
            a, b = lane1[order], lane2[order]
        new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(a) else np.zeros(0, np.int64)
        #: of each distinct hash: its first start here; all other starts are repeats whatever other blocks hold
        self.first = np.minimum.reduceat(order, new) if len(new) else np.zeros(0, np.int64)
        self.lane1, self.lane2 = a[new], b[new]

    def intervals(self, earlier: np.ndarray) -> list[list[list[int]]]:
        """Word intervals to remove from each document; earlier: whether each distinct hash is in a block before."""
        repeat = np.ones(len(self.starts), bool)
        repeat[self.first[~earlier]] = False
        change = np.zeros(int(self.sizes.sum()) + 1, np.int64)
        at = self.starts[repeat]
        np.add.at(change, at, 1)
        np.add.at(change, at + self.width, -1)
        covered = np.cumsum(change)[:-1] > 0
        out = []
        for b, n in zip(self.begins.tolist(), self.sizes.tolist()):
            edge = np.flatnonzero(np.diff(np.concatenate(([False], covered[b : b + n], [False]))))
            out.append(edge.reshape(-1, 2).tolist())
        return out


class Gathered:
    """The hashes that several blocks, or groups of them, sent, in id order: which of them are repeats, and the distinct ones."""

    def __init__(self, table: pa.Table, deal: blocks.Deal) -> None:
        self.table = table = table.take(np.argsort([deal.block_index(x) for x in table.column("block").to_pylist()]))
        one = [blocks.unpacked(x) for x in table.column("lane1").to_pylist()]
        two = np.concatenate([blocks.plane_array(x, np.uint32) for x in table.column("lane2").to_pylist()])
        self.ends, one = np.cumsum(list(map(len, one))), np.concatenate(one)
        self.order = np.lexsort((two, one))  # stable: of equal hashes the one from the first block comes first
        self.lane1, self.lane2 = one[self.order], two[self.order]
        self.later = np.concatenate(([False], (self.lane1[1:] == self.lane1[:-1]) & (self.lane2[1:] == self.lane2[:-1])))

    def answers(self, later: np.ndarray, buckets: pa.ChunkedArray) -> pa.Table:
        """What to tell each sender of its hashes; later: in the order of the sorted hashes."""
        earlier = np.empty(len(later), bool)
        earlier[self.order] = later
        told = [np.packbits(x).tobytes() if x.any() else None for x in np.split(earlier, self.ends[:-1])]
        return pa.table([self.table.column("block"), buckets, pa.array(told, pa.binary())], names=["block", "bucket", "earlier"]).filter(pa.array([x is not None for x in told]))


def told(bits: bytes | None, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)


def sendings(buckets: list[int], block: int, lane1: np.ndarray, lane2: np.ndarray, edges: np.ndarray, full: np.ndarray) -> pa.Table:
    """A row for each bucket that gets hashes."""
    spans = [(edges[k], edges[k + 1]) for k in full]
    return pa.table([pa.array(buckets, pa.int32()), pa.array([block] * len(full), pa.int32()), pa.array([blocks.packed(lane1[a:b]) for a, b in spans], pa.binary()), pa.array([blocks.plane_bytes(lane2[a:b]) for a, b in spans], pa.binary())], names=["bucket", "block", "lane1", "lane2"])


def removed(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """A row for each row of docs: id, n_words, n_removed, intervals (maximal, [from, to) in words), kept_sha256 and, with_text, kept_text (kept words joined
    by one space)."""
    deal = blocks.Deal(docs, text_col)
    dealt = blocks.dealt(docs, deal, id_col, text_col)

    def emit(table: pa.Table) -> pa.Table:
        block = Block(blocks.sorted_block(table), width)
        edges = blocks.bucket_edges(block.lane1, deal.coarse)
        full = np.flatnonzero(np.diff(edges))
        number = table.column(0)[0].as_py()
        return sendings([deal.bucket_label(number, int(k)) for k in full], number, block.lane1, block.lane2, edges, full)

    def decide(table: pa.Table) -> pa.Table:
        held = Gathered(table, deal)
        return held.answers(held.later, held.table.column("bucket"))

    def merge(table: pa.Table) -> pa.Table:
        label, held = table.column("bucket")[0].as_py(), Gathered(table, deal)
        lane1, lane2, coarse = held.lane1[~held.later], held.lane2[~held.later], deal.bucket_index(label)
        edges = blocks.fine_edges(lane1, deal, coarse)
        full = np.flatnonzero(np.diff(edges))
        return sendings((coarse * deal.fine + full).tolist(), label, lane1, lane2, edges, full)

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        held, coarse = Gathered(left, deal), deal.bucket_index(left.column("bucket")[0].as_py())
        edges = blocks.fine_edges(held.lane1[~held.later], deal, coarse)
        elsewhere = np.zeros(edges[-1], bool)
        for k, bits in zip(right.column("fine").to_pylist(), right.column("earlier").to_pylist()):
            a, b = edges[k - coarse * deal.fine], edges[k - coarse * deal.fine + 1]
            elsewhere[a:b] = told(bits, b - a)
        return held.answers(held.later | elsewhere[np.cumsum(~held.later) - 1], held.table.column("bucket"))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k in ("id", "n_words", "n_removed", "intervals", "kept_sha256", "kept_text")}
        block = Block(blocks.sorted_block(left), width) if left.num_rows else None
        if block:
            edges = blocks.bucket_edges(block.lane1, deal.coarse)
            earlier = np.zeros(len(block.lane1), bool)
            for k, bits in zip(map(deal.bucket_index, right.column("bucket").to_pylist()), right.column("earlier").to_pylist()):
                earlier[edges[k] : edges[k + 1]] = told(bits, edges[k + 1] - edges[k])
            for (key, _), words, gone in zip(block.rows, block.words, block.intervals(earlier)):
                n = len(words)
                if gone:
                    at, kept = 0, []
                    for a, b in gone:
                        kept += words[at:a]
                        at = b
                    words = kept + words[at:]
                text = b" ".join(words)
                for k, v in zip(out, (key, n, n - len(words), gone, hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace") if with_text else None)):
                    out[k].append(v)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.string(), pa.string())
        return pa.table([pa.array(v, t) for v, t in zip(out.values(), types)], names=list(out))

    sent = dealt.groupBy("block").applyInArrow(emit, "bucket int, block int, lane1 binary, lane2 binary")
    schema = "block int, bucket int, earlier binary"
    answers = blocks.answered(sent, deal, lambda asked: asked.groupBy("bucket").applyInArrow(decide, schema), merge, spread, schema)
    found = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(apply, "id long, n_words long, n_removed long, intervals array<array<long>>, kept_sha256 string, kept_text string")
    return found.withColumnRenamed("id", id_col) if with_text else found.drop("kept_text").withColumnRenamed("id", id_col)
