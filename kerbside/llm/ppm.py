"""Language-model scoring: prediction by partial matching over bytes, and an add-one word model beside it.

Training documents are those whose crc32(id as text) mod ``folds`` is not ``held_out_fold``. Gram counts of the highest order are pre-aggregated in each
task and summed by Spark; lower orders are sums of them. All grams count, and the model is neither collected nor broadcast: each bucket owns a range
of contexts, ordered from their last byte back, and each block of documents asks the buckets that own its grams for their probabilities. What a bucket
needs of contexts that go on in other buckets is summed apart. Texts are lower-cased (A-Z) before both models.

Word counts travel likewise: each block asks the buckets that own its words for their counts.

Null text: an empty document (its end is scored). A null id counts as training. Equal ids stay separate rows; an
empty table gives an empty result. Very long texts are scored whole, their grams cut ``BYTES_AT_ONCE`` at a time; a block holds whole texts, so one longer than a block is a block.
Only the id and the text are read, so other columns may have any names. Probabilities travel as float32, so each byte's log10 probability is off by 3e-8 at most and ``score`` by that
times the text's bytes. Invalid UTF-8 isn't possible in a string column; byte 0xFF is free for the frame.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm import blocks
from kerbside.llm.common import materialise, slices, utf8
from kerbside.llm.ppm_model import Model, counted, text_grams


@dataclass(frozen=True)
class PpmParams:
    order: int = 5
    folds: int = 7
    held_out_fold: int = 2

    def held_out(self, key: int | None) -> bool:
        return key is not None and zlib.crc32(str(key).encode()) % self.folds == self.held_out_fold


#: Gram counts a task holds before it merges them, and text bytes it cuts at once.
HELD_GRAMS, BYTES_AT_ONCE = 3_000_000, 4 << 20


def gram_counts(docs: DataFrame, id_col: str, text_col: str, params: PpmParams) -> DataFrame:
    """(gram, n) of the highest order over all training documents."""
    order = params.order

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merge():
            held[:] = [counted(np.concatenate([g for g, _ in held]), np.concatenate([n for _, n in held]))]

        def take(texts):
            held.append(counted(text_grams(texts, order)[0]))
            if sum(len(g) for g, _ in held) > HELD_GRAMS:
                merge()

        texts, size = [], 0
        for batch in batches:
            for part in slices(batch):
                for key, text in zip(part.column(0).to_pylist(), utf8(part.column(1)).to_pylist()):
                    if params.held_out(key):
                        continue
                    texts.append((text or b"").lower())
                    size += len(texts[-1])
                    if size > BYTES_AT_ONCE:
                        take(texts)
                        texts, size = [], 0
        if texts:
            take(texts)
        if held:
            merge()
            codes, n = held.pop()
            for at in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[at : at + 100_000]), pa.array(n[at : at + 100_000])], names=["gram", "n"])

    parts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "gram long, n long")
    return parts.groupBy("gram").agg(F.sum("n").alias("n"))


def turned(grams: np.ndarray, order: int) -> np.ndarray:
    """Grams of the highest order with their context bytes last to first: those with a common suffix of the context stand together when sorted."""
    if not order:
        return grams & 255
    back = (grams >> 8).view(np.uint64).byteswap() >> np.uint64(64 - 8 * order)
    return back.view(np.int64) << 8 | grams & 255


def distinct_grams(texts: list[bytes], order: int) -> np.ndarray:
    """The texts' distinct turned grams, sorted; grams are cut in pieces of BYTES_AT_ONCE."""
    found, held, size = [np.zeros(0, np.int64)], [], 0
    for at, t in enumerate(texts):
        held.append(t)
        size += len(t)
        if size > BYTES_AT_ONCE or at + 1 == len(texts):
            found.append(counted(turned(counted(text_grams(held, order)[0])[0], order))[0])
            held, size = [], 0
    return counted(np.concatenate(found))[0]


def places_in(distinct: np.ndarray, codes: np.ndarray, order: int) -> np.ndarray:
    """The place of each code (a turned gram) in the sorted distinct ones. Short runs are sorted with their position in the low bits, as looking up sorted codes is
    several times faster than looking them up as they come."""
    bits = 64 - 8 * (order + 1)
    if bits < 12:
        return np.searchsorted(distinct, codes)
    out, run = np.empty(len(codes), np.int64), 1 << min(bits, 16)
    low, up = np.uint64(run - 1), np.uint64(min(bits, 16))
    for at in range(0, len(codes), run):
        part = codes[at : at + run].view(np.uint64) << up
        part |= np.arange(len(part), dtype=np.uint64)
        part.sort()
        out[at + (part & low).astype(np.int64)] = np.searchsorted(distinct, (part >> up).view(np.int64))
    return out


def _turned(gram: Column, order: int) -> Column:
    """The context of ``turned``."""
    return sum((F.shiftleft(F.shiftright(gram, 8 * (k + 1)).bitwiseAND(255), 8 * (order - 1 - k)) for k in range(order)), F.lit(0).cast("long"))


def cut_contexts(top: DataFrame, deal: blocks.Deal, order: int) -> np.ndarray:
    """Turned contexts at which the grams pass from bucket to bucket, ascending: fewer than there are buckets. They are the cuts of equal parts, which are cut again where there are fine
    buckets; eight bytes a bucket come to the driver."""
    if not order or deal.coarse * deal.fine < 2:
        return np.zeros(0, np.int64)

    def even(parts: int):
        return F.percentile_approx("context", [k / parts for k in range(1, parts)], 100 * parts)

    contexts = top.select(_turned(F.col("gram"), order).alias("context"))
    cuts = set((contexts.agg(even(deal.coarse)).first()[0] or []) if deal.coarse > 1 else [])
    if deal.fine > 1:
        found = np.array(sorted(cuts), np.int64)

        def placed(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(found, batch.column(0).to_numpy(), "right").astype(np.int32)), batch.column(0)], names=["part", "context"])

        for row in contexts.mapInArrow(placed, "part int, context long").groupBy("part").agg(even(deal.fine).alias("cuts")).toLocalIterator():
            cuts.update(row.cuts)
    return np.array(sorted(cuts - {0}), np.int64)


def edge_contexts(cuts: np.ndarray, bucket: int, order: int) -> list[set[int]]:
    """For each order below the highest the contexts that other buckets may hold grams of, too.

    A bucket is a range of turned contexts, so only a context that begins as the range's lower or upper cut does can go on outside."""
    at = [int(cuts[k]) for k in (bucket - 1, bucket) if 0 <= k < len(cuts)]
    return [{int.from_bytes(c.to_bytes(order, "big")[:k][::-1], "big") for c in at} for k in range(order)]


def model_rows(top: DataFrame, deal: blocks.Deal, cuts: np.ndarray, order: int) -> DataFrame:
    """(bucket, k, gram, n): each bucket's grams of the highest order, and of its edge contexts all grams of the lower orders."""
    labels = deal.fine_labels(np.arange(len(cuts) + 1))

    def owned(batches):
        for batch in batches:
            gram = batch.column(0).to_numpy()
            at = np.searchsorted(cuts, turned(gram, order) >> 8, "right")
            yield pa.RecordBatch.from_arrays([pa.array(labels[at]), pa.array(np.full(len(gram), order, np.int32)), batch.column(0), batch.column(1)], names=["bucket", "k", "gram", "n"])

    def at_edges(batches):
        for batch in batches:
            rows = [(int(labels[b]), k, c) for b in batch.column(0).to_pylist() for k, found in enumerate(edge_contexts(cuts, b, order)) for c in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64()))], names=["bucket", "k", "context"])

    rows = top.select("gram", "n").mapInArrow(owned, "bucket int, k int, gram long, n long")
    if not len(cuts):
        return rows
    spark, schema = top.sparkSession, "bucket int, k int, context long"
    few = deal.groups == 1  # at most two contexts an order for each of GROUP_BLOCKS / 2 buckets
    if few:
        wanted = spark.createDataFrame([(int(labels[b]), k, c) for b in range(len(labels)) for k, found in enumerate(edge_contexts(cuts, b, order)) for c in sorted(found)], schema)
    else:
        wanted = materialise(spark.range(len(labels)).mapInArrow(at_edges, schema), "ppm-edges")
    for k in range(order):
        mine = wanted.filter(F.col("k") == k)
        lower = top.select(F.col("gram").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("gram"), "n").withColumn("context", F.shiftright("gram", 8))
        if few:
            mine = F.broadcast(mine)
            lower = lower.join(F.broadcast(mine.select("context").distinct()), "context")
        known = lower.groupBy("context", "gram").agg(F.sum("n").alias("n"))
        if not few and k < 2:  # every bucket asks for the same few contexts; they have at most 65,536 grams
            known = F.broadcast(known)
        rows = rows.unionByName(known.join(mine, "context").select("bucket", "k", "gram", "n"))
    return rows


def bucket_model(k: np.ndarray, gram: np.ndarray, n: np.ndarray, edges: list[set[int]], order: int) -> Model:
    """The model of one bucket's range, from its model_rows: exact for every gram that the range owns."""
    top, weights = gram[k == order], n[k == order]
    counts = []
    for at in range(order):
        codes, sums = counted(top & ((1 << 8 * (at + 1)) - 1), weights)
        inside = ~np.isin(codes >> 8, np.fromiter(edges[at], np.int64, len(edges[at])))
        codes, sums = np.concatenate([codes[inside], gram[k == at]]), np.concatenate([sums[inside], n[k == at]])
        rank = np.argsort(codes)
        counts.append((codes[rank], sums[rank]))
    rank = np.argsort(top)
    return Model([*counts, (top[rank], weights[rank])])


def gram_answers(dealt: DataFrame, top: DataFrame, deal: blocks.Deal, cuts: np.ndarray, order: int) -> DataFrame:
    """(block, bucket, n): the log10 probabilities of a block's distinct grams that the bucket owns, in the order of ``block_grams``."""
    names, schema = ["block", "bucket", "n"], "block int, bucket int, n binary"

    def sendings(buckets: list[int], block: int, keys: np.ndarray, edges: np.ndarray, full: np.ndarray) -> pa.Table:
        blobs = [blocks.packed(keys[edges[k] : edges[k + 1]].view(np.uint64)) for k in full]
        return pa.table([pa.array(buckets, pa.int32()), pa.array([block] * len(full), pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "block", "keys"])

    def gathered(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
        keys = [blocks.unpacked(x).view(np.int64) for x in table.column("keys").to_pylist()]
        distinct = np.zeros(0, np.int64)
        for at in range(0, len(keys), 16):
            distinct = np.union1d(distinct, np.concatenate(keys[at : at + 16]))
        return keys, distinct

    def told(table: pa.Table, keys: list[np.ndarray], distinct: np.ndarray, values: np.ndarray) -> pa.Table:
        return pa.table([table.column("block"), table.column("bucket"), pa.array([blocks.plane_bytes(values[np.searchsorted(distinct, x)]) for x in keys], pa.binary())], names=names)

    def fine_cuts(coarse: int) -> np.ndarray:
        return cuts[coarse * deal.fine :][: deal.fine - 1]

    def emit(table: pa.Table) -> pa.Table:
        keys = distinct_grams([(t or b"").lower() for t in table.column(2).cast(pa.large_binary()).to_pylist()], order)
        edges = gram_edges(keys, coarse_cuts(cuts, deal))
        full, number = np.flatnonzero(np.diff(edges)), table.column(0)[0].as_py()
        return sendings([deal.bucket_label(number, int(k)) for k in full], number, keys, edges, full)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int32(), pa.int32(), pa.binary())], names=names)
        keys, distinct = gathered(left)
        bucket = deal.fine_index(left.column("bucket")[0].as_py())
        model = bucket_model(*(right.column(c).to_numpy() for c in ("k", "gram", "n")), edge_contexts(cuts, bucket, order), order)
        grams = turned(distinct, order)  # turned twice: as they were
        rank = np.argsort(grams)
        values = np.empty(len(grams), "<f4")
        values[rank] = model.log10(grams[rank])
        return told(left, keys, distinct, values)

    def merge(table: pa.Table) -> pa.Table:
        label = table.column("bucket")[0].as_py()
        coarse, distinct = deal.bucket_index(label), gathered(table)[1]
        edges = gram_edges(distinct, fine_cuts(coarse))
        full = np.flatnonzero(np.diff(edges))
        return sendings((coarse * deal.fine + full).tolist(), label, distinct, edges, full)

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        coarse, (keys, distinct) = deal.bucket_index(left.column("bucket")[0].as_py()), gathered(left)
        edges, values = gram_edges(distinct, fine_cuts(coarse)), np.empty(len(distinct), "<f4")
        for k, blob in zip(right.column("fine").to_pylist(), right.column("n").to_pylist()):
            values[edges[k - coarse * deal.fine] : edges[k - coarse * deal.fine + 1]] = blocks.plane_array(blob, "<f4")
        return told(left, keys, distinct, values)

    def settle(asked: DataFrame) -> DataFrame:
        return asked.groupBy("bucket").cogroup(model_rows(top, deal, cuts, order).groupBy("bucket")).applyInArrow(answer, schema)

    sent = dealt.groupBy("block").applyInArrow(emit, "bucket int, block int, keys binary")
    return blocks.answered(sent, deal, settle, merge, spread, schema)


def coarse_cuts(cuts: np.ndarray, deal: blocks.Deal) -> np.ndarray:
    """The cuts between coarse buckets: each of those holds ``deal.fine`` ranges."""
    return cuts[deal.fine - 1 :: deal.fine]


def gram_edges(keys: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Positions at which sorted turned grams pass from bucket to bucket."""
    return np.concatenate(([0], np.searchsorted(keys, cuts << 8), [len(keys)]))


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PpmParams = PpmParams()) -> DataFrame:
    """A row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    order, deal = params.order, blocks.Deal(docs, text_col)
    top = materialise(gram_counts(docs, id_col, text_col, params), "ppm-grams")
    dealt = blocks.dealt(docs, deal, id_col, text_col)

    class Words:
        def __init__(self, table: pa.Table) -> None:
            self.rows = blocks.sorted_block(table)
            hashes = [blocks.hashed_words(text.lower().split()) if text else np.zeros(0, np.uint64) for _, text in self.rows]
            self.sizes = np.fromiter(map(len, hashes), np.int64, len(hashes))
            self.held = np.fromiter((params.held_out(key) for key, _ in self.rows), bool, len(hashes))
            self.keys, self.at = np.unique(np.concatenate(hashes), return_inverse=True)

    def sendings(buckets: list[int], block: int, keys: np.ndarray, n: np.ndarray, edges: np.ndarray, full: np.ndarray) -> pa.Table:
        spans = [(edges[k], edges[k + 1]) for k in full]
        return pa.table([pa.array(buckets, pa.int32()), pa.array([block] * len(full), pa.int32()), pa.array([blocks.packed(keys[a:b]) for a, b in spans], pa.binary()), pa.array([blocks.plane_bytes(n[a:b]) for a, b in spans], pa.binary())], names=["bucket", "block", "keys", "n"])

    def gathered(table: pa.Table):
        """The distinct words' hashes of all senders, their sums, each sent one's place among them and where a sender's end."""
        keys = [blocks.unpacked(x) for x in table.column("keys").to_pylist()]
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(distinct), np.int64)
        np.add.at(sums, at, np.concatenate([blocks.plane_array(x, "<i8") for x in table.column("n").to_pylist()]))
        return distinct, sums, at, np.cumsum(list(map(len, keys)))

    def told(table: pa.Table, sums: np.ndarray, at: np.ndarray, ends: np.ndarray, tokens: int, kinds: int) -> pa.Table:
        answers = [blocks.plane_bytes(x) for x in np.split(sums[at], ends[:-1])]
        once = [1] + [0] * (len(ends) - 1)  # the bucket's own totals stand in one of its rows
        return pa.table([table.column("block"), table.column("bucket"), pa.array(answers, pa.binary()), pa.array([x * tokens for x in once], pa.int64()), pa.array([x * kinds for x in once], pa.int64())], names=["block", "bucket", "n", "tokens", "kinds"])

    def emit(table: pa.Table) -> pa.Table:
        words = Words(table)
        n = np.bincount(words.at[np.repeat(~words.held, words.sizes)], minlength=len(words.keys)).astype("<i8")
        edges = blocks.bucket_edges(words.keys, deal.coarse)
        full, number = np.flatnonzero(np.diff(edges)), table.column(0)[0].as_py()
        return sendings([deal.bucket_label(number, int(k)) for k in full], number, words.keys, n, edges, full)

    def total(table: pa.Table) -> pa.Table:
        _, sums, at, ends = gathered(table)
        return told(table, sums, at, ends, int(sums.sum()), int((sums > 0).sum()))

    def merge(table: pa.Table) -> pa.Table:
        label = table.column("bucket")[0].as_py()
        coarse, (keys, sums, _, _) = deal.bucket_index(label), gathered(table)
        edges = blocks.fine_edges(keys, deal, coarse)
        full = np.flatnonzero(np.diff(edges))
        return sendings((coarse * deal.fine + full).tolist(), label, keys, sums.astype("<i8"), edges, full)

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        coarse, (keys, sums, at, ends) = deal.bucket_index(left.column("bucket")[0].as_py()), gathered(left)
        edges = blocks.fine_edges(keys, deal, coarse)
        for k, blob in zip(right.column("fine").to_pylist(), right.column("n").to_pylist()):
            sums[edges[k - coarse * deal.fine] : edges[k - coarse * deal.fine + 1]] = blocks.plane_array(blob, "<i8")
        return told(left, sums, at, ends, sum(right.column("tokens").to_pylist()), sum(right.column("kinds").to_pylist()))

    schema = "block int, bucket int, n binary, tokens long, kinds long"
    sent = dealt.groupBy("block").applyInArrow(emit, "bucket int, block int, keys binary, n binary")
    answers = materialise(blocks.answered(sent, deal, lambda asked: asked.groupBy("bucket").applyInArrow(total, schema), merge, spread, schema), "ppm-words")
    cuts = cut_contexts(top, deal, order)
    values = materialise(gram_answers(dealt, top, deal, cuts, order), "ppm-values")
    fold = F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % params.folds, F.lit(-1))
    ends = docs.filter(fold != params.held_out_fold).count()
    sums = answers.agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    train_tokens = (sums.tokens or 0) + ends
    log_all = float(np.log10(train_tokens + (sums.kinds or 0) + (ends > 0) + 1))

    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in types], names=names)
        words = Words(left)
        edges = blocks.bucket_edges(words.keys, deal.coarse)
        n = np.zeros(len(words.keys), np.int64)
        texts = [(t or b"").lower() for _, t in words.rows]
        codes, lengths = text_grams(texts, order)
        grams = distinct_grams(texts, order)
        gram_at = places_in(grams, turned(codes, order), order)
        gram_bounds = gram_edges(grams, coarse_cuts(cuts, deal))
        logs = np.zeros(len(grams), "<f4")
        for label, of_words, blob in zip(right.column("bucket").to_pylist(), right.column("of_words").to_pylist(), right.column("n").to_pylist()):
            k = deal.bucket_index(label)
            if of_words:
                n[edges[k] : edges[k + 1]] = blocks.plane_array(blob, np.int64)
            else:
                logs[gram_bounds[k] : gram_bounds[k + 1]] = blocks.plane_array(blob, "<f4")
        scores = np.add.reduceat(logs[gram_at].astype(np.float64), np.concatenate(([0], np.cumsum(lengths)[:-1])))
        each = n[words.at]
        bounds = np.concatenate(([0], np.cumsum(words.sizes)))
        logs = np.log10(each + 1.0)
        base = np.array([logs[a:b].sum() for a, b in zip(bounds, bounds[1:])]) + np.log10(ends + 1) - (words.sizes + 1) * log_all
        known = np.array([np.count_nonzero(each[a:b]) for a, b in zip(bounds, bounds[1:])]) + (ends > 0)
        columns = ([k for k, _ in words.rows], words.held, words.sizes + 1, known, np.full(len(texts), train_tokens), base, scores, [len(t) for t in texts])
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    both = answers.select("block", "bucket", "n", F.lit(True).alias("of_words")).unionByName(values.withColumn("of_words", F.lit(False)))
    found = dealt.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(apply, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")
    return found.withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / (F.col("n_bytes") + 1)).withColumnRenamed("id", id_col)
