"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

A line's tokens are its distinct words. Lines of equal token sets form one class from the start; its first line in (document, line) order
speaks for it. Tokens are ordered by rarity, and a class is dealt out by its prefix tokens only:

* prefix filter: with a Jaccard of at least num/den, a pair shares a token among the first ``n - ceil(num*n/den) + 1`` of the longer and the first
  ``n - ceil(2*num*n/(num+den)) + 1`` of the shorter line;
* length and positional filters, and a bound on the difference of 64-bit parity signatures, stand in the join condition;
* what is left is verified on the words themselves.

A line goes if an earlier line has at least that Jaccard with it, be it of one word or of thousands. Lines without words stay.

Rarity is counted over all words of all documents, in ``BUCKETS`` buckets of the words' hashes: a fixed-size table, whatever the corpus, in which a frequent
word lifts its own bucket only. A token's order is its bucket's level (the octave of its count), then its hash, the same everywhere, which is all that the filters need.

Equal sets are told by 64 bits of a hash of all tokens, their number and the parity signature: with N distinct lines two different ones meet with a chance
below N*N / 2**100, one in a million for the 1e12 lines of 100 TB.

Null and empty texts have no words. Documents are told apart by id and 31 bits of their text's hash: equal rows are one document, whose lines go or stay in all of
them; rows of one id with different texts are different documents in the order of that hash. Rows without an id come
first. Very long texts and lines are taken whole, a text in one task. An empty table gives an empty result. Columns pass through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import drop_spent, materialise, small_or_shuffled

#: A level has four bits, so PACKED of them share a long.
BUCKETS, LEVELS, PACKED = 1 << 21, 16, 16
BLANK = r"[\x20\x09-\x0D]+"
#: Where levels stand in a token, above 59 bits of the word's hash.
LEVEL_AT = 59
#: Lines of so many tokens have signatures of 128 bits, others of 64.
LONG = 80


@dataclass(frozen=True)
class LineParams:
    num: int = 4  # the Jaccard threshold, num / den
    den: int = 5
    broadcast_rows: int = 200_000  # joins of the texts with smaller tables than this broadcast those; larger ones are shuffled
    crowd: int = 256  # tokens that more classes share are taken apart
    anchors: int = 16  # earliest classes of such a token that all others are compared with first

    @property
    def least(self) -> int:
        """The fewest tokens of a line that another set can be so similar to."""
        longer = -(-self.den // (self.den - self.num)) if self.num < self.den else 1 << 30
        return -(-longer * self.num // self.den)


def _up(a: Column, b: int) -> Column:
    """a / b rounded up, for whole numbers."""
    return F.floor((a + (b - 1)) / b).cast("int")


def rarity(texts: DataFrame) -> list[int]:
    """For each token bucket its level: the octave of the number of words in it, the highest octave being LEVELS - 1; PACKED levels a number, the first lowest."""
    words = texts.select(F.explode(F.split(F.regexp_replace("text", r"[\x09-\x0D]", " "), " ")).alias("word"))
    counts = materialise(words.groupBy(F.xxhash64("word").bitwiseAND(BUCKETS - 1).cast("int").alias("bucket")).agg(F.count("*").alias("n")), "lines-rarity")
    top = (counts.agg(F.max("n")).first()[0] or 0).bit_length()
    level = F.greatest(F.length(F.bin("n")) - top + LEVELS - 1, F.lit(0)).cast("long")
    parts = counts.select(F.shiftright("bucket", 4).alias("at"), F.call_function("shiftleft", level, F.col("bucket").bitwiseAND(PACKED - 1) * 4).alias("part"))
    packed = {r.at: r.levels for r in parts.groupBy("at").agg(F.bit_or("part").alias("levels")).collect()}  # BUCKETS / PACKED rows at most
    return [packed.get(k, 0) for k in range(BUCKETS // PACKED)]


def line_sets(texts: DataFrame, levels: list[int], params: LineParams) -> DataFrame:
    """(id, place, key, n, sig, high, probe): of each line with a word where it is, its set's key, size, parity signature (in a long line the tokens are
    dealt to two halves) and probe prefix."""
    num, den = params.num, params.den
    table = F.from_json(F.lit(str(levels)), "array<bigint>")  # folded to a constant

    def token(h: Column) -> Column:
        four = F.get(table, F.shiftright(h, 4).bitwiseAND(BUCKETS // PACKED - 1).cast("int"))
        level = F.call_function("shiftrightunsigned", four, h.bitwiseAND(PACKED - 1).cast("int") * 4).bitwiseAND(LEVELS - 1)
        return F.coalesce(F.shiftleft(level, LEVEL_AT), F.lit(0)).bitwiseOR(F.shiftrightunsigned(h, 64 - LEVEL_AT))

    # one pass for the rare blanks, so that lines and words are cut at single characters
    plain = texts.select("id", "h", F.regexp_replace("text", r"[\x09\x0B-\x0D]", " ").alias("text"))
    lines = plain.select("id", "h", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    hashes = lines.select("id", "h", "line", F.transform(F.split("text", " "), lambda w: F.xxhash64(w)).alias("hashes"))
    tokens = F.array_remove(F.array_distinct(F.sort_array(F.transform("hashes", token))), token(F.xxhash64(F.lit(""))))
    # the partition's number keeps Catalyst from moving the filter down, where it would make every set a second time
    sets = hashes.select("id", "h", "line", tokens.alias("set"), F.spark_partition_id().alias("part"))
    sets = sets.filter((F.size("set") > 0) & (F.col("part") >= 0))
    n = F.size("set")

    def parity(bit) -> Column:
        return F.aggregate("set", F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(bit(t)))

    one = lambda t: F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))
    upper = F.when(n >= LONG, parity(lambda t: F.when(t.bitwiseAND(64) != 0, one(t)).otherwise(0))).otherwise(0)
    marked = sets.select("id", "h", "line", "set", parity(one).alias("all"), upper.alias("high"))
    return marked.select(
        "id",
        F.shiftleft(F.col("h").bitwiseAND((1 << 31) - 1), 32).bitwiseOR(F.col("line").cast("long")).alias("place"),
        F.xxhash64("set").alias("key"),
        n.alias("n"),
        F.col("all").bitwiseXOR(F.col("high")).alias("sig"),
        "high",
        # short tokens: a clash only adds candidates; none where no other set can be similar
        F.transform(F.slice("set", F.lit(1), F.when(n >= params.least, n - _up(n * num, den) + 1).otherwise(0)), lambda t: F.hash(t)).alias("probe"),
    )


def dealt(classes: DataFrame) -> DataFrame:
    """A row for each prefix token of each class (id, place, n, sig, high, probe)."""
    return classes.select("id", "place", "n", "sig", "high", F.posexplode("probe").alias("pos", "token"))


def candidates(later: DataFrame, every: DataFrame, params: LineParams) -> DataFrame:
    """(x_id, x_place, y_id, y_place, bits): first lines of classes that may match, y from later and x from every, x the earlier one, and how many bits of their
    signatures differ; a pair may come more than once. later, every: rows of dealt."""
    num, den = params.num, params.den
    c = F.col
    at = lambda t: F.struct(c(f"{t}.id").alias("id"), c(f"{t}.place").alias("place"))
    overlap = _up((c("x.n") + c("y.n")) * num, num + den)
    low, high = c("x.sig").bitwiseXOR(c("y.sig")), c("x.high").bitwiseXOR(c("y.high"))
    # of two long lines both halves of the signature, else the halves folded
    bits = F.when(F.least("x.n", "y.n") >= LONG, F.bit_count(low) + F.bit_count(high)).otherwise(F.bit_count(low.bitwiseXOR(high)))
    # the longer line probes, the shorter is indexed by its shorter prefix; said with columns of both sides, so that both can read one exchange
    shorter, place = F.least("x.n", "y.n"), F.when(c("x.n") <= c("y.n"), c("x.pos")).otherwise(c("y.pos"))
    condition = (
        (c("x.token") == c("y.token"))
        & (bits * (num + den) <= (c("x.n") + c("y.n")) * (den - num))  # the bound below without its rounding: nearly all pairs fail here, in whole numbers
        & (c("x.n") * den >= c("y.n") * num)
        & (c("y.n") * den >= c("x.n") * num)
        & (bits <= c("x.n") + c("y.n") - 2 * overlap)
        & (place < shorter - _up(shorter * (2 * num), num + den) + 1)
        & (F.least("x.pos", "y.pos") + F.least(c("x.n") - c("x.pos"), c("y.n") - c("y.pos")) >= overlap)
        & (at("y") > at("x"))
    )
    return later.alias("y").join(every.alias("x"), condition).select(c("x.id").alias("x_id"), c("x.place").alias("x_place"), c("y.id").alias("y_id"), c("y.place").alias("y_place"), bits.cast("int").alias("bits"))


def nearest(found: DataFrame) -> DataFrame:
    """Of each y's candidates one with the fewest differing bits, and whether there are more than that one; a pair that shares several tokens counts once."""
    known = F.coalesce("x_id", F.lit(-(1 << 63)))
    more = (F.min("x_place") < F.max("x_place")) | (F.min(known) < F.max(known))
    # plain numbers, so that Spark hashes and need not sort; both parts of x come from the same row, and were it not so, verification would show
    return materialise(found.groupBy("y_id", "y_place").agg(F.min_by("x_id", "bits").alias("x_id"), F.min_by("x_place", "bits").alias("x_place"), more.alias("more")), "lines-nearest")


def of_lines(rows: DataFrame, lines: DataFrame, how: str) -> DataFrame:
    """The rows (id, place, ...) that are among lines (id, place), or are not."""
    return rows.join(lines, rows["id"].eqNullSafe(lines["id"]) & (rows["place"] == lines["place"]), how)


def paired(found: DataFrame) -> DataFrame:
    """(x, y) as structs."""
    return found.select(*[F.struct(F.col(f"{t}_id").alias("id"), F.col(f"{t}_place").alias("place")).alias(t) for t in "xy"])


def verified(pairs: DataFrame, texts: DataFrame, params: LineParams) -> DataFrame:
    """The pairs (x, y) whose words have the Jaccard asked for, judged on the words themselves."""
    h = F.col("place").bitwiseAND(F.lit(((1 << 31) - 1) << 32))
    ends = pairs.select("x.*").distinct().unionByName(pairs.select("y.*").distinct()).distinct()
    needed = materialise(ends.groupBy(F.col("id").alias("needed"), h.alias("needed_h")).agg(F.collect_list(F.col("place").bitwiseAND((1 << 32) - 1).cast("int")).alias("lines")), "lines-needed")
    mine = texts.withColumn("own", F.shiftleft(F.col("h").bitwiseAND((1 << 31) - 1), 32))
    held = mine.join(small_or_shuffled(needed, params.broadcast_rows), F.col("id").eqNullSafe(F.col("needed")) & (F.col("own") == F.col("needed_h")))
    # a text is cut once (the outer transform holds its lines), and only the lines asked for pass the generator
    picked = F.transform(F.array(F.split("text", "\n")), lambda cut: F.transform("lines", lambda i: F.struct(i.alias("line"), F.get(cut, i).alias("text"))))
    cut = held.select("id", "own", F.explode(F.get(picked, F.lit(0))).alias("x")).select("id", "own", "x.line", "x.text")
    words = F.array_distinct(F.filter(F.split("text", BLANK), lambda w: w != ""))
    lines = cut.select(F.struct("id", F.col("own").bitwiseOR(F.col("line").cast("long")).alias("place")).alias("at"), words.alias("words"))
    both = pairs.join(lines.select(F.col("at").alias("x"), F.col("words").alias("a")), "x").join(lines.select(F.col("at").alias("y"), F.col("words").alias("b")), "y")
    return both.filter(F.size(F.array_intersect("a", "b")) * (params.den + params.num) >= (F.size("a") + F.size("b")) * params.num).select("x", "y")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row: all columns, text, id, h: a hash of the text)."""
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    return docs.select(row, text.alias("text"), docs[f"`{id_col}`"].cast("long").alias("id"), F.xxhash64(text).alias("h"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LineParams = LineParams()) -> DataFrame:
    """(known, known_h, gone): for each document that loses lines its id, a hash of its text and the lines' numbers.

    A line needs one earlier match to go. So of each line's candidates the one with the nearest signature is verified first, which settles nearly all of
    them; only for those it does not settle are all candidates verified. Lines under a token that many share are compared with a few of the earliest of
    them first, and only those that this leaves open with all: a group of near copies costs as many rows as it has members, and those of the few left.
    """
    texts = keyed(docs, id_col, text_col).select("id", "h", "text")
    lines = materialise(line_sets(texts, rarity(texts), params), "lines-sets")
    first = F.min(F.struct("id", "place")).alias("at")
    found = lines.groupBy("key", "n", "sig", "high").agg(first, F.count("*").alias("times"), F.any_value("probe").alias("probe"))
    classes = materialise(found.select("at.id", "at.place", "key", "n", "sig", "high", "times", "probe"), "lines-classes")
    rows, limit = dealt(classes), params.broadcast_rows
    # tokens that many classes share are taken apart: there most lines are settled by the earliest ones, before all are compared
    crowded = small_or_shuffled(materialise(rows.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") > params.crowd).select("token"), "lines-crowded"), limit)
    rare, crowd = rows.join(crowded, "token", "left_anti"), materialise(rows.join(crowded, "token", "left_semi"), "lines-crowd")
    salt = F.pmod(F.xxhash64("id", "place"), F.lit(params.anchors))
    anchors = crowd.groupBy("token", salt.alias("salt")).agg(F.min(F.struct("id", "place", "n", "sig", "high", "pos")).alias("first")).select("first.*", "token")
    one = nearest(candidates(rare, rare, params).unionByName(candidates(crowd, materialise(anchors, "lines-anchors"), params)))
    settled = materialise(verified(paired(one), texts, params).select("y").distinct(), "lines-settled")
    tried = one.filter("more")
    if crowd.count():
        known = small_or_shuffled(settled.select("y.*"), limit)
        two = nearest(candidates(of_lines(crowd, known, "left_anti"), crowd, params))
        settled = settled.unionByName(materialise(verified(paired(two), texts, params).select("y").distinct(), "lines-settled"))
        tried = tried.unionByName(two.filter("more"))
    left = materialise(paired(tried).select("y").distinct().join(settled, "y", "left_anti").select("y.*"), "lines-open")
    if left.count():
        few = small_or_shuffled(left, limit)
        others = [candidates(small_or_shuffled(materialise(of_lines(x, few, "left_semi"), "lines-later"), limit), x, params) for x in (rare, crowd)]
        others = materialise(paired(others[0].unionByName(others[1])).distinct(), "lines-others")
        settled = settled.unionByName(materialise(verified(others, texts, params).select("y").distinct(), "lines-settled"))
    # all lines of a class but its first; the classes of one line are most and stay out
    same = ["key", "n", "sig", "high"]
    repeats = materialise(classes.filter("times > 1").select(*same, F.struct("id", "place").alias("at")), "lines-repeats")
    later = lines.join(small_or_shuffled(repeats, params.broadcast_rows), same).select(F.struct("id", "place").alias("place"), "at").filter("place <> at").select("place")
    gone = later.unionByName(settled.select(F.col("y").alias("place"))).select("place.*")
    gone = gone.groupBy("id", F.col("place").bitwiseAND(F.lit(((1 << 31) - 1) << 32)).alias("own")).agg(F.sort_array(F.collect_set(F.col("place").bitwiseAND((1 << 32) - 1).cast("int"))).alias("gone"))
    kept = materialise(gone.select(F.col("id").alias("known"), F.col("own").alias("known_h"), "gone"), "lines-gone")
    drop_spent(docs.sparkSession, lines, classes)
    return kept


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LineParams = LineParams()) -> DataFrame:
    """A row for each row of docs: ``row``, n_lines, n_removed, kept_text (null if the text is null)."""
    gone = removals(docs, id_col, text_col, params)
    every = keyed(docs, id_col, text_col).withColumn("own", F.shiftleft(F.col("h").bitwiseAND((1 << 31) - 1), 32))
    joined = every.join(small_or_shuffled(gone, params.broadcast_rows), F.col("id").eqNullSafe(F.col("known")) & (F.col("own") == F.col("known_h")), "left")
    lines = F.split("text", "\n")
    # the stretches between lines that go; the outer transforms hold the lines and the stretches' ends, so that each is made once
    ends = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size(lines)))

    def between(cut: Column, at: Column) -> Column:
        stretches = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice(cut, F.get(at, k) + 2, F.get(at, k + 1) - F.get(at, k) - 1))
        return F.array_join(F.flatten(stretches), "\n")

    kept = F.get(F.transform(F.array(F.struct(lines.alias("cut"), ends.alias("at"))), lambda x: between(x["cut"], x["at"])), F.lit(0))
    return joined.select(
        "row",
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col(f"row.`{text_col}`").isNotNull(), F.when(F.size("gone") > 0, kept).otherwise(F.col("text"))).alias("kept_text"),
    )
