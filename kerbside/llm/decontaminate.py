"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised test items make one automaton; every text is streamed through it while the longest suffix that
still occurs in an item is tracked. A window (``window`` consecutive item words, or a whole shorter item) ends at a word
if the tracked match is that long. Words inside a window are hit; a document is contaminated if its share of hit
words reaches one in ``one_in``. With ``span_words`` set, a run of hit words that long goes from a text (``cut_text``) whatever its coverage, so that
a benchmark passage inside a very long document is removed too; shorter runs go only from contaminated documents.

The automaton is built in the tasks from broadcast items of at most ``max_words`` words. A larger benchmark is dealt
into shards of that size. Then the texts are written once, and each shard is a job of its own over them, so that no worker holds more than one automaton; a job
leaves the rows it hits, and these are united.
Items over a sixteenth of ``max_words`` words are cut into pieces that overlap by ``window - 1`` words, which loses no window; the longest match
told is one within a piece.

Null texts have no words. Items that are null or have no words have no window. Repeated item ids count once; items without an id
mark words but are in no list of ids. Repeated documents are judged each on their own. Very long texts are streamed whole through the automaton by one
task. Columns pass through, whatever their names. An empty table gives an empty result; without items nothing is hit.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import materialise, slices, small_or_shuffled, utf8

#: Lower-cases A-Z and blanks what isn't a word byte; keeps lengths, so offsets hold in the text itself.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences, with the windows that end in each state."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int) -> None:
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        cut = [(key, words) for key, text in items if (words := [self.vocab.setdefault(w, len(self.vocab)) for w in words_of(text)])]
        for _, words in cut:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.shortest = min((min(window, len(words)) for _, words in cut), default=0)
        #: state -> items whose window of full length ends there; state -> [(length, item)] of shorter items
        self.full: dict[int, set] = {}
        self.short: dict[int, list] = {}
        for key, words in cut:
            state = 0
            for i, w in enumerate(words):
                state = self.next[state][w]
                if i + 1 >= window:
                    self.full.setdefault(self._of_window(state), set()).add(key)
            if len(words) < window:
                self.short.setdefault(state, []).append((len(words), key))
        self.above = self._short_above() if self.short else None

    def _extend(self, last: int, w: int) -> int:
        following, link, length = self.next, self.link, self.length
        if w in following[last]:
            q = following[last][w]
            return q if length[q] == length[last] + 1 else self._split(last, q, w)
        new = len(length)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        while last >= 0 and w not in following[last]:
            following[last][w] = new
            last = link[last]
        if last >= 0:
            q = following[last][w]
            link[new] = q if length[q] == length[last] + 1 else self._split(last, q, w)
        return new

    def _split(self, p: int, q: int, w: int) -> int:
        copy = len(self.length)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _of_window(self, state: int) -> int:
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def _short_above(self) -> list[int]:
        """For each state the nearest one on its suffix path, itself included, at which a shorter item ends; -1: none."""
        out = [-1] * len(self.length)
        for s in sorted(range(1, len(out)), key=self.length.__getitem__):
            out[s] = s if s in self.short else out[self.link[s]]
        return out

    def matches(self, words: list[bytes]) -> tuple[list[list[int]], set, int]:
        """Disjoint hit intervals [from, to), the items found, and the longest match seen where windows are possible."""
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate(([False], ids >= 0, [False]))))
        spans: list[list[int]] = []
        found: set = set()
        longest, following, link, length = 0, self.next, self.link, self.length
        for start, end in zip(known[::2].tolist(), known[1::2].tolist()):
            if end - start < self.shortest:  # no window fits between two unknown words
                continue
            state = matched = 0
            for i, w in enumerate(ids[start:end].tolist(), start):
                while state and w not in following[state]:
                    state = link[state]
                    matched = length[state]
                state = following[state].get(w, 0)
                matched = matched + 1 if state else 0
                longest = max(longest, matched)
                reach = 0
                if matched >= self.window:
                    reach = self.window
                    found |= self.full[self._of_window(state)]
                if self.above:
                    s = self.above[state]
                    while s > 0:
                        for n, key in self.short[s]:
                            if n <= matched:
                                found.add(key)
                                reach = max(reach, n)
                        s = self.above[link[s]] if link[s] > 0 else -1
                if reach:
                    a = i + 1 - reach
                    while spans and spans[-1][1] >= a:
                        a = min(a, spans.pop()[0])
                    spans.append([a, i + 1])
        return spans, found, longest


def united(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def without(text: bytes, spans: list[list[int]]) -> bytes:
    """The text without the words in spans and what stands between them."""
    folded, ends, at = text.translate(FOLD), [], 0
    starts = []
    for w in folded.split():
        at = folded.index(w, at)
        starts.append(at)
        at += len(w)
        ends.append(at)
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : starts[a]])
        at = ends[b - 1]
    return b"".join([*out, text[at:]])


@dataclass(frozen=True)
class Limits:
    window: int = 13
    one_in: int = 20  # contaminated from one hit word in so many
    max_words: int = 200_000
    broadcast_rows: int = 200_000  # hit rows joined by broadcast, where there are several shards; more are shuffled
    span_words: int | None = None  # hit runs of so many words are cut from any document; None: coverage alone decides


_built: dict = {}


def _automaton(key: str, items: list, window: int) -> Automaton:
    """One automaton at a time in each Python worker."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(items, window)
    return _built[key]


def _shards(items: DataFrame, id_col: str, text_col: str, limits: Limits):
    """Functions that collect a list of (id, text) each, of about max_words words at most. Items are cut into pieces that overlap by window - 1 words before they are dealt, so a long
    item is spread like any other; shards that get none are left out."""
    size = max(limits.max_words // 16, 2 * limits.window)  # of a piece: sixteen in a shard even out
    step = size - limits.window + 1
    words = F.filter(F.split(F.regexp_replace(F.col(text_col), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "), " "), lambda w: w != "")
    cut = items.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("whole"), words.alias("w")).filter(F.size("w") > 0)
    at = F.sequence(F.lit(1), F.greatest(F.size("w") - limits.window + 1, F.lit(1)), F.lit(step))
    # a short item goes as it is; both name the same words, as words_of cuts pieces again
    piece = F.when(F.size("w") <= size, F.col("whole")).otherwise(F.array_join(F.slice("w", F.col("at"), size), " "))
    pieces = cut.select("id", "whole", "w", F.explode(F.when(F.size("w") <= size, F.array(F.lit(1))).otherwise(at)).alias("at")).select("id", "at", piece.alias("text"), F.least(F.size("w"), F.lit(size)).alias("n"))
    pieces = materialise(pieces, "decontaminate-pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    n = -(-total // limits.max_words) or 1
    of = F.pmod(F.xxhash64("id", "at", "text"), F.lit(n))
    used = sorted(r.k for r in pieces.select(of.alias("k")).distinct().collect()) or [0]  # a number for each shard
    for k in used:
        yield lambda k=k: [(r.id, r.text.encode()) for r in pieces.filter(of == k).select("id", "text").collect()]


_FOUND = [("n_words", T.LongType()), ("longest", T.LongType()), ("spans", T.ArrayType(T.ArrayType(T.LongType()))), ("found", T.ArrayType(T.StringType()))]


def _scan(spark, shard: list, limits: Limits, carried: list[T.StructField], before: bool = False):
    """(function, its output): a pass that finds a shard's windows. Columns in: those carried, the last of which is the text, and with before what earlier
    passes found (longest, spans, found; may be null), with which it is united."""
    held = spark.sparkContext.broadcast(shard)
    key, many = hashlib.sha256(repr((shard, limits.window)).encode()).hexdigest(), len(carried)
    out = T.StructType([*carried, *[T.StructField(c, t) for c, t in _FOUND]])

    def run(batches):
        automaton = _automaton(key, held.value, limits.window)
        for batch in batches:
            for part in slices(batch):
                n_words, longest, spans, found = [], [], [], []
                earlier = zip(*[part.column(many + i).to_pylist() for i in range(3)]) if before else [(0, None, None)] * part.num_rows
                for text, (far, old, ids) in zip(utf8(part.column(many - 1)).to_pylist(), earlier):
                    words = words_of(text)
                    s, f, most = automaton.matches(words)
                    n_words.append(len(words))
                    longest.append(max(far or 0, most))
                    spans.append(united((old or []) + s))
                    found.append(sorted({*(ids or []), *(x for x in f if x is not None)}))
                new = [pa.array(n_words, pa.int64()), pa.array(longest, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:many], *new], names=out.names)

    return run, out


def _shard_by_shard(kept: DataFrame, text_col: str, shards: list, limits: Limits) -> DataFrame:
    """A job for each shard over the texts, which are written once with a number a row; a job's workers hold its automaton alone. Of a job only the rows
    that it matches are kept; the last one carries the rows and takes up what the others found."""
    spark = kept.sparkSession
    base = materialise(kept.select(F.monotonically_increasing_id().alias("n"), "row"), "decontaminate-rows")
    numbered = base.select("n", F.col("row").getField(text_col).alias("text"))
    hits = None
    for shard in shards[:-1]:
        run, out = _scan(spark, shard(), limits, numbered.schema.fields)
        seen = numbered.mapInArrow(run, out).select("n", "longest", "spans", "found").filter("longest > 0")
        seen = materialise(seen, "decontaminate-shard")
        hits = seen if hits is None else hits.unionByName(seen)
    one = hits.groupBy("n").agg(F.max("longest").alias("longest"), F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("found")).alias("found"))  # an entry a shard
    one = small_or_shuffled(materialise(one, "decontaminate-hits"), limits.broadcast_rows)
    joined = base.join(one, "n", "left").select("row", F.col("row").getField(text_col).alias("text"), "longest", "spans", "found")
    run, out = _scan(spark, shards[-1](), limits, joined.schema.fields[:2], before=True)
    return joined.mapInArrow(run, out)


def matched(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", limits: Limits = Limits(), cut_text: bool = False) -> DataFrame:
    """A row for each row of docs: ``row`` (a struct of its columns), n_words, n_hit, longest, spans (hit word ranges), item_ids (sorted as strings),
    contaminated and, with cut_text, ``cut``: the text without its hit spans if it is contaminated, else without those of span_words words or more."""
    if "row" in docs.columns and len(docs.columns) == 1:
        raise ValueError("docs may not be a single column named row")
    spark = docs.sparkSession
    kept = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    shards = list(_shards(items, item_id, item_text, limits))
    if len(shards) == 1:
        run, out = _scan(spark, shards[0](), limits, kept.schema.fields)
        now = kept.mapInArrow(run, out)
    else:
        now = _shard_by_shard(kept, text_col, shards, limits)
    n_hit = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s[1] - s[0]), F.lit(0))
    now = now.withColumn("n_hit", n_hit)
    now = now.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * limits.one_in >= F.col("n_words")))
    result = now.select("row", "n_words", "n_hit", "longest", "spans", F.col("found").alias("item_ids"), "contaminated", *(["text"] if cut_text else []))
    if not cut_text:
        return result

    def chosen(spans, contaminated):
        long = limits.span_words
        return spans if contaminated else [x for x in spans if long is not None and x[1] - x[0] >= long]

    def cutting(batches):
        for batch in batches:
            for part in slices(batch):
                texts = [without(t, chosen(s, c)) if t else t for t, s, c in zip(utf8(part.column(7)).to_pylist(), part.column(4).to_pylist(), part.column(6).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:7], pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts], pa.string())], names=[*part.schema.names[:7], "cut"])

    return result.mapInArrow(cutting, T.StructType([*result.schema.fields[:7], T.StructField("cut", T.StringType())]))


def clean_documents(docs: DataFrame, items: DataFrame, **params) -> DataFrame:
    """docs without the contaminated rows, columns as they were."""
    found = matched(docs, items, **params)
    return found.filter(~F.col("contaminated")).select("row.*")
