"""Best-fit packing of token sequences by the linear grouping scheme.

Lengths are whole numbers up to the capacity, so the whole problem is its histogram: at most ``capacity`` counts,
whatever the corpus. The driver solves on the histogram; bins stay in runs of equal bins, so the plan's size depends
on the capacity alone. Documents are numbered within their length in Spark and look their places up in the plan.

1. Large lengths (over ``small``) are cut into groups of equal cardinality; within a group each counts as the largest.
2. Configurations of few group sizes are chosen by column generation on the covering problem, rounded down; what is left over is
   placed by best fit.
3. The actual lengths take the places of their group, then small ones go, longest first, where they fit best.

Null text: an empty document, one piece of one (end) token. An empty table packs to nothing. Repeated rows are packed each on its
own; null ids stay null. A very long text is encoded whole by one task and cut afterwards. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbside.llm.common import default_env, materialise, shuffle_partitions, slices, utf8

#: Words, and words without what stands after them, whose ids a worker keeps; when full, a store starts anew.
KEPT_WORDS, KEPT_STEMS = 400_000, 1_200_000
#: ASCII characters that end a word's last letters for the vocabulary's splitter.
TAIL = b".,;:!?)]}\"*#%$&|<>-"
#: Stems encoded in one call.
AT_ONCE = 500
END_ID = 1

_encoders: dict = {}

#: A capital before a combining mark may compose otherwise than its small letter (H and a line below do not, h and a line below do).
CAPITAL_AND_MARK = re.compile(rb"[A-Z][\x80-\xff]*[\xcc\xcd]")


def encoded_whole(text: bytes) -> bool:
    """Texts whose case counts: perhaps with a special token, or with capitals before marks."""
    return b"<|" in text or (not text.isascii() and CAPITAL_AND_MARK.search(text) is not None)


class _Encoder:
    """words: word (split at ASCII white space, A-Z lower-cased) -> its ids as little-endian unsigned 32-bit bytes.

    The vocabulary lower-cases, and its normaliser and splitter never join across white space, so ids of a text are those of its words. Punctuation is
    cut off a word where the splitter does not join it to what the word's last character is once normalised (a letter may become a letter and a mark, and marks
    join). Words of letters only are encoded many in a call: each ends at an id that ends a word.
    """

    def __init__(self, path: str) -> None:
        default_env("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        self.apart: dict[str, bool] = {}
        known = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(known.values()) + 1, bool)
        self.ends_word[[k for word, k in known.items() if word.endswith("</w>")]] = True

    def plain(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()

    def stands_apart(self, stem: bytes) -> bool:
        """Whether punctuation after the stem is split from it."""
        if stem[-1:].isalnum():  # ASCII
            return True
        last = self.tokenizer.normalizer.normalize_str(stem.decode("utf-8", "replace"))[-1:]
        if last not in self.apart:
            self.apart[last] = len(self.tokenizer.pre_tokenizer.pre_tokenize_str(last + ".")) == 2 if last.strip() else False
        return self.apart[last]

    def learn_stems(self, stems: list[bytes]) -> None:
        letters = []
        for stem in stems:
            if stem.isalpha() or unicodedata.normalize("NFC", stem.decode("utf-8", "replace")).lower().isalpha():
                letters.append(stem)
            else:
                self.stems[stem] = self.plain(stem)
        for at in range(0, len(letters), AT_ONCE):
            some = letters[at : at + AT_ONCE]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode("utf-8", "replace")], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                raw = ids.tobytes()
                for stem, a, b in zip(some, [0, *cuts[:-1].tolist()], cuts.tolist()):
                    self.stems[stem] = raw[4 * a : 4 * b]
            else:
                for stem in some:
                    self.stems[stem] = self.plain(stem)

    def learn(self, words: set[bytes]) -> None:
        cut = []
        for word in words:
            stem = word.rstrip(TAIL)
            if len(stem) < len(word) and stem and not self.stands_apart(stem):
                stem = word
            cut.append((word, stem))
        tails = {w[len(s) :] for w, s in cut}
        if len(self.stems) > KEPT_STEMS:
            self.stems.clear()
        self.learn_stems([x for x in {s for _, s in cut} | tails if x and x not in self.stems])
        self.stems[b""] = b""
        for word, stem in cut:
            self.words[word] = self.stems[stem] + self.stems[word[len(stem) :]]

    def ids(self, text: bytes) -> bytes:
        if encoded_whole(text):
            return self.plain(text)
        words = text.lower().split()
        try:
            return b"".join(map(self.words.__getitem__, words))
        except KeyError:
            pass
        missing = set(words).difference(self.words)
        if len(self.words) + len(missing) > KEPT_WORDS:
            self.words.clear()
            missing = set(words)
        self.learn(missing)
        return b"".join(map(self.words.__getitem__, words))

    def prepare(self, texts: list[bytes]) -> None:
        """Learn the words of many texts at once."""
        missing = {w for t in texts if t and not encoded_whole(t) for w in t.lower().split()}.difference(self.words)
        if missing and len(self.words) + len(missing) > KEPT_WORDS and len(missing) <= KEPT_WORDS // 4:
            self.words.clear()
        if missing and len(self.words) + len(missing) <= KEPT_WORDS:
            self.learn(missing)


def _encoder(path: str) -> _Encoder:
    """One for each path and Python worker; called by name, so that it outlives a task."""
    if path not in _encoders:
        _encoders[path] = _Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the end id closes each document; only longer ones are cut."""

    def run(batches):
        encoder, end = _encoder(tokenizer_path), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch):
                out: tuple[list, ...] = ([], [], [], [], [])
                texts = utf8(part.column(1)).to_pylist()
                encoder.prepare(texts)
                for key, text in zip(part.column(0).to_pylist(), texts):
                    ids = encoder.ids(text or b"") + end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        for to, x in zip(out, (key, k, at // 4, len(own) // 4, zlib.crc32(own))):
                            to.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the plan, on the histogram -------------------------------------------------------------------------------------


def grouped(counts: dict[int, int], groups: int) -> list[list[list[int]]]:
    """Lists of [length, count], longest first, of equal cardinality but for the last."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out, room = [], 0
    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append([length, take])
            n -= take
            room -= take
    return out


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: how often to take each size for the greatest value."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for j, (size, value) in enumerate(zip(sizes, values)):
        if value <= 1e-9:
            continue
        for a in range(size, capacity + 1, size):  # sums up to a come from the stretch of one size before it
            now = best[a - size : min(a, capacity + 1 - size)] + value
            part = slice(a, a + len(now))
            better = now > best[part] + 1e-12
            best[part] = np.where(better, now, best[part])
            taken[part] = np.where(better, j, taken[part])
    room, counts = capacity, np.zeros(len(sizes))
    room = int(np.argmax(best))
    while room > 0 and taken[room] >= 0:
        counts[taken[room]] += 1
        room -= sizes[taken[room]]
    return float(best.max()), counts


def configurations(sizes: list[int], demand: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """(how often each size, how many bins), by column generation with a basis kept as columns; bins are rounded down."""
    m = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        amounts, prices = inverse @ demand, inverse.T @ np.ones(m)
        value, column = best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        change = inverse @ column
        able = change > 1e-9
        ratio = np.where(able, amounts / np.where(able, change, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    amounts = np.linalg.inv(basis) @ demand
    return [(basis[:, k].astype(int), int(np.floor(x + 1e-9))) for k, x in enumerate(amounts) if x >= 1 - 1e-9]


class Bins:
    """Runs of equal bins: (first bin, number, room left), found by the room they have left."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.by_room: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.rooms: list[int] = []
        #: (length, rank of the first, number, first bin, offset)
        self.places: list[tuple[int, int, int, int, int]] = []
        self.rank: dict[int, int] = defaultdict(int)

    def add(self, first: int, n: int, room: int) -> None:
        if not self.by_room[room]:
            insort(self.rooms, room)
        self.by_room[room].append((first, n))

    def new(self, n: int) -> int:
        self.made += n
        return self.made - n

    def put(self, length: int, n: int, first: int, offset: int) -> None:
        self.places.append((length, self.rank[length], n, first, offset))
        self.rank[length] += n

    def best_fit(self, length: int, n: int) -> None:
        while n:
            k = bisect_left(self.rooms, length)
            if k == len(self.rooms):
                per = self.capacity // length
                if n >= per:  # as many as fit in each new bin
                    bins = n // per
                    first = self.new(bins)
                    for i in range(per):
                        self.put(length, bins, first, i * length)
                    self.add(first, bins, self.capacity - per * length)
                    n -= bins * per
                else:
                    first = self.new(1)
                    for i in range(n):
                        self.put(length, 1, first, i * length)
                    self.add(first, 1, self.capacity - n * length)
                    n = 0
                continue
            room = self.rooms[k]
            first, have = self.by_room[room].pop()
            if not self.by_room[room]:
                self.rooms.pop(k)
            use = min(n, have)
            if use < have:
                self.add(first + use, have - use, room)
            self.put(length, use, first, self.capacity - room)
            self.add(first, use, room - length)
            n -= use


def plan(counts: dict[int, int], capacity: int = 4096, groups: int = 64, small: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """Places for a histogram of lengths: (length, rank, number, first bin, offset); rank r + i goes to bin first + i."""
    small = capacity // 4 if small is None else small
    bins = Bins(capacity)
    rest = dict(counts)
    if full := rest.pop(capacity, 0):
        bins.put(capacity, full, bins.new(full), 0)
    large = {s: n for s, n in rest.items() if s > small}
    left = {s: n for s, n in rest.items() if s <= small}
    if large:
        parts = grouped(large, groups)
        sizes = [p[0][0] for p in parts]
        demand = np.array([sum(n for _, n in p) for p in parts], float)
        for column, n in configurations(sizes, demand, capacity):
            slots = [g for g in range(len(parts)) for _ in range(column[g])]
            while n:
                # actual lengths in the places of their group, as many bins at once as all slots have runs for
                slots = [g for g in slots if parts[g]]
                if not slots:
                    break
                need = {g: slots.count(g) for g in slots}
                use = n
                for g, k in need.items():
                    use = min(use, max(1, parts[g][0][1] // k))
                first, offset = bins.new(use), 0
                for g in list(slots):
                    if not parts[g]:
                        continue
                    length = parts[g][0][0]
                    bins.put(length, use, first, offset)
                    offset += length
                    parts[g][0][1] -= use
                    if not parts[g][0][1]:
                        parts[g].pop(0)
                bins.add(first, use, capacity - offset)
                n -= use
        for part in parts:
            for length, n in part:
                left[length] = left.get(length, 0) + n
    for length in sorted(left, reverse=True):
        bins.best_fit(length, left[length])
    return bins.places


# --- ranks and places in Spark --------------------------------------------------------------------------------------


def numbered(found: DataFrame) -> DataFrame:
    """found with ``rank``: from 0 within each length. Hot lengths are split by salt; only counts meet in one place."""
    salt = F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(4 * shuffle_partitions(found.sparkSession)))
    salted = found.withColumn("salt", salt.cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    return salted.withColumn("own", own).join(before, ["length", "salt"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before", "salt")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, groups: int = 64, small: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    found = materialise(pieces(docs, tokenizer_path, capacity, id_col, text_col), "pack-pieces")
    counts = {r.length: r.n for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    places = np.array(sorted(plan(counts, capacity, groups, small)), np.int64).reshape(-1, 5)
    held = spark.sparkContext.broadcast(places)  # size bound by the capacity, see above

    def run(batches):
        at = held.value
        keys = (at[:, 0].astype(object) * (1 << 48) + at[:, 1]).astype(np.int64)
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            row = np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(at[row, 3] + rank - at[row, 1]), pa.array(at[row, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = numbered(found).select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
