"""Source divergence audit: how far the sources of a language are from each other and from the language as a whole, and by which terms.

Terms are counted by sorting pointers, not strings. A task takes its texts in shards of ``SHARD_BYTES``; in a shard's bytes (the Arrow buffer, folded) each word start is a pointer,
and a multikey quicksort orders the pointers by the words they stand at, eight bytes as one character: slices are parted in three by a pivot, the equal part goes on
eight bytes deeper, slices of ``LEAF`` pointers are finished at once. Words that are equal stand in one run; a run's documents and groups give the term's document frequency and
its count in each source. Spark adds up what the shards say.

A shard puts out one row for each term and group, a text longer than a shard is sorted in pieces, so no key is gathered and memory is bound by the shard. Sums of a term over a
language's sources are a window whose partitions have as many rows as there are sources. Two sources are compared on the terms that at least one of them has: where only one has a
term the other's share is the one of count 0, so those terms enter by how many of each count there are; only terms of both meet in a join. The result has a row for each two sources, as
asked; no more is made of them.

Null texts, languages and sources are empty ones. Repeated rows and ids count as often as they come; ids are not read. A language without kept terms has value 0 for each
pair, and no term rows. Very long texts count whole, as one document. An empty table gives an empty result. Columns beside text, lang and source are not read.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import materialise, slices, small_or_shuffled, utf8

#: Lower-cases A-Z; what is neither a letter of these nor beyond ASCII becomes zero.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0 for b in range(256))
SHARD_BYTES = 8 << 20
#: Pointers of a slice that is sorted at once.
LEAF = 1 << 16


@dataclass(frozen=True)
class AuditParams:
    min_docs: int = 10  # of its language's, that a term is kept for
    top_terms: int = 10
    scale: int = 1_000_000_000
    broadcast_rows: int = 200_000


class Words:
    """The words of a folded buffer: where they start and how long they are. edges: where texts start, and the buffer's end."""

    def __init__(self, folded: bytes, edges: np.ndarray) -> None:
        raw = np.frombuffer(folded + bytes(8), np.uint8)
        word = raw[: len(folded) + 1] != 0
        cut = np.zeros(len(folded) + 1, bool)
        cut[edges] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | cut[1:]
        self.starts = np.flatnonzero(begins)
        last = word[:-1] & (~word[1:] | cut[1:])
        self.lengths = np.flatnonzero(last) + 1 - self.starts
        self.raw = raw
        self.windows = np.ndarray((len(folded) + 1,), ">u8", raw.data, strides=(1,))

    def character(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Eight bytes of the words, from depth on; zeros past their ends."""
        left = self.lengths[at] - depth
        found = self.windows[np.where(left > 0, self.starts[at] + depth, 0)].astype(np.uint64)
        drop = np.clip(8 - left, 0, 7).astype(np.uint64) * np.uint64(8)
        return np.where(left > 0, (found >> drop) << drop, np.uint64(0))

    def ordered(self) -> tuple[np.ndarray, np.ndarray]:
        """Pointer numbers in the order of their words, and whether a run of equal words begins there."""
        n = len(self.starts)
        order, begins = np.arange(n), np.zeros(n, bool)
        todo = [(0, n, 0)]
        while todo:
            low, high, depth = todo.pop()
            if low == high:
                continue
            at = order[low:high]
            keys = self.character(at, depth)
            if high - low <= LEAF:
                order[low:high], begins[low:high] = self._leaf(at, keys, depth)
                continue
            some = np.sort(keys[:: max(1, len(keys) // 255)])
            pivot = some[len(some) // 2]
            less, same, more = at[keys < pivot], at[keys == pivot], at[keys > pivot]
            order[low:high] = np.concatenate([less, same, more])
            a, b = low + len(less), high - len(more)
            if int(pivot) & 0xFF:
                todo.append((a, b, depth + 8))
            else:  # the words end here
                begins[a] = True
            todo += [(low, a, depth), (b, high, depth)]
        return order, begins

    def _leaf(self, at: np.ndarray, keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        by = np.argsort(keys)
        at, keys = at[by], keys[by]
        begins = np.concatenate(([True], keys[1:] != keys[:-1]))
        on = np.flatnonzero(keys & np.uint64(0xFF))
        while len(on):  # whole runs: all of one have the same character
            depth += 8
            run, keys = np.cumsum(begins)[on], self.character(at[on], depth)
            by = np.lexsort((keys, run))
            at[on], keys = at[on][by], keys[by]
            begins[on[1:]] |= keys[1:] != keys[:-1]
            on = on[(keys & np.uint64(0xFF)) != 0]
        return at, begins

    def terms(self, at: np.ndarray) -> pa.Array:
        """The words at these pointers as strings."""
        lengths = self.lengths[at]
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        where = np.repeat(self.starts[at] - offsets[:-1], lengths) + np.arange(offsets[-1])
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(self.raw[where])])


def counted(texts: list[bytes], groups: list[int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard, a row for each term and group: the term, the group, its occurrences and its documents."""
    order = sorted(range(len(texts)), key=groups.__getitem__)
    texts, of_text = [texts[k] for k in order], np.array([groups[k] for k in order], np.int64)
    edges = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    words = Words(b"".join(texts).translate(FOLD), edges)
    if not len(words.starts):
        none = np.zeros(0, np.int64)
        return pa.array([], pa.string()), none, none, none
    order, begins = words.ordered()
    text_of = np.searchsorted(edges, words.starts, "right") - 1
    pairs = np.sort((np.cumsum(begins) - 1) * len(texts) + text_of[order])  # (run, text); texts of a group stand together
    one = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
    times, run = np.diff(np.append(one, len(pairs))), pairs[one] // len(texts)
    group = of_text[pairs[one] % len(texts)]
    row = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (group[1:] != group[:-1]))))
    terms = words.terms(order[np.flatnonzero(begins)])
    return terms.take(pa.array(run[row])), group[row], np.add.reduceat(times, row), np.diff(np.append(row, len(one)))


def in_pieces(text: bytes, size: int):
    """A long text in pieces that end between words."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and FOLD[text[end]]:
            end += 1
        yield text[at:end]
        at = end


def term_counts(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group."""

    def run(batches):
        known: dict[tuple, int] = {}
        texts, groups, held = [], [], 0

        def rows(terms, group, n, of_docs):
            names = list(known)
            pick = lambda k: pa.array([names[g][k] for g in group.tolist()], pa.string())
            return pa.RecordBatch.from_arrays([pick(0), pick(1), terms, pa.array(n, pa.int64()), pa.array(of_docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part.column(2)).to_pylist()):
                    group = known.setdefault((lang, source), len(known))
                    if len(text) > SHARD_BYTES:
                        total = Counter()
                        for piece in in_pieces(text, SHARD_BYTES):
                            terms, _, n, _ = counted([piece], [0])
                            total.update(dict(zip(terms.to_pylist(), n.tolist())))
                        yield rows(pa.array(list(total), pa.string()), np.full(len(total), group), list(total.values()), np.ones(len(total), np.int64))
                        continue
                    texts.append(text)
                    groups.append(group)
                    held += len(text)
                    if held >= SHARD_BYTES:
                        yield rows(*counted(texts, groups))
                        texts, groups, held = [], [], 0
        if texts:
            yield rows(*counted(texts, groups))

    plain = docs.select(*[F.coalesce(docs[f"`{c}`"], F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    shards = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return shards.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n, total: str, v: str, scale: int) -> Column:
    """1 + floor(scale * (n + 2) / (total + 2 * v)), exactly; null without kept terms."""
    n = F.lit(n) if isinstance(n, int) else F.col(n)
    wide = lambda c: c.cast("decimal(19,0)")
    above = F.lit(scale).cast("decimal(10,0)") * wide(n + 2)
    return F.when(F.col(v) > 0, F.call_function("div", above, wide(F.greatest(F.col(total) + 2 * F.col(v), F.lit(1)))) + 1)


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audited(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", params: AuditParams = AuditParams()) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair, each other source of the language with the distance between the two; part term, the terms
    that a source has more of than its language, those of greatest distance."""
    c = F.col
    whole = Window.partitionBy("lang", "term")
    counts = term_counts(docs, text_col, lang_col, source_col)
    summed = counts.withColumns({"df": F.sum("docs").over(whole), "of_lang": F.sum("n").over(whole), "leads": F.min("source").over(whole) == c("source")})
    kept = materialise(summed.filter(c("df") >= params.min_docs).select("lang", "source", "term", "n", "of_lang", "leads"), "audit-kept")
    langs = kept.groupBy("lang").agg(F.count_if("leads").alias("v"), F.sum("n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    every = docs.select(*[F.coalesce(docs[f"`{x}`"], F.lit("")).alias(a) for x, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    joined = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "v", "lang_total"])
    groups = small_or_shuffled(materialise(joined.withColumn("p0", _share(0, "total", "v", params.scale)), "audit-groups"), params.broadcast_rows)
    shared = kept.join(groups, ["lang", "source"]).withColumns({"p": _share("n", "total", "v", params.scale), "q": _share("of_lang", "lang_total", "v", params.scale)})
    shared = materialise(shared.select("lang", "source", "term", "p", "q", "p0"), "audit-shares")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = shared.filter("p > q").select("lang", "source", F.lit("term").alias("part"), c("term").alias("item"), _apart(c("p"), c("q")).alias("value"))
    top = over.withColumn("rank", F.row_number().over(best)).filter(c("rank") <= params.top_terms)

    def pair(low: str, high: str, value: Column) -> list[Column]:
        return [c("lang"), c(low).alias("a"), c(high).alias("b"), value.alias("value")]

    # as if all terms had count 0 in both; then what changes where one of them has the term; then where both have it
    side = lambda df, t, *columns: df.select("lang", *[c(x).alias(f"{t}_{x}") for x in columns])
    x, y = (side(groups, t, "source", "v", "p0") for t in "xy")
    none = x.join(y, "lang").filter("x_source < y_source").select(*pair("x_source", "y_source", F.coalesce(c("x_v") * _apart(c("x_p0"), c("y_p0")), F.lit(0))))
    alike = shared.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("times"))
    one = alike.join(y, "lang").filter("source <> y_source").withColumn("value", c("times") * (_apart(c("p"), c("y_p0")) - _apart(c("p0"), c("y_p0"))))
    one = one.select("lang", F.least("source", "y_source").alias("a"), F.greatest("source", "y_source").alias("b"), "value")
    x, y = (side(shared, t, "source", "p", "p0", "term") for t in "xy")
    more = _apart(c("x_p"), c("y_p")) - _apart(c("x_p"), c("y_p0")) - _apart(c("x_p0"), c("y_p")) + _apart(c("x_p0"), c("y_p0"))
    both = x.join(y, (x["lang"] == y["lang"]) & (c("x_term") == c("y_term")) & (c("x_source") < c("y_source"))).drop(y["lang"]).select(*pair("x_source", "y_source", more))
    pairs = none.unionByName(one.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))).unionByName(both.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    pairs = pairs.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(c("a").alias("source"), c("b").alias("item")), F.struct(c("b").alias("source"), c("a").alias("item"))))
    ranked = pairs.select("lang", ways.alias("w"), "value").select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(best))
    return ranked.unionByName(top)
