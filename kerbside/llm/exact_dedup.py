"""Exact duplicates by content-defined chunk recipes, with DataFrame functions only.

A text is cut where its own bytes say so: a chunk ends at the first place, ``least`` bytes or more after its start, where three bytes in a row belong to
three fixed classes, or after ``most`` bytes. A text's recipe is the ordered list of its chunks' identifiers, eight bytes for each kilobyte or so:

* recipes are grouped first; texts whose recipe no other text has differ from all others, and their bytes are not moved at all;
* of the texts in shared recipes each distinct chunk is moved once to verify its identifier: an identifier that stands for two contents is found there;
* such an identifier is replaced by the chunk itself in every recipe, so what is then compared holds verified identifiers only and groups are exact. At 100 TB
  some hundred of the 64-bit identifiers clash by chance; more than ``clash_rows`` make all chunks stand for themselves.

Of a group of equal texts the row with the largest id stays; of repeated rows of that id one. A null text is an empty one. Rows without an id come before all others:
one of them stays only where no row of the group has an id, and keep_id is null then. Very long texts are cut whole by one task. An empty table gives an empty result.
Columns that are carried come back in ``row``, whatever their names; others are not read.

Groups may be of any size: a group is one row a task before it is shuffled, and where verdicts go back to their rows the groups of more than one row in
``HOT_SHARE`` (of which there are no more than that) are dealt out under ``SALTS`` numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialise

#: A group of more than one in so many rows is hot; there are fewer such groups than this.
HOT_SHARE, SALTS = 4096, 64


@dataclass(frozen=True)
class ChunkParams:
    least: int = 512  # bytes of a chunk
    most: int = 8192
    id_bits: int = 64  # of an identifier; fewer are for tests
    clash_rows: int = 10_000  # clashing identifiers that recipes are mended for one by one
    broadcast_rows: int = 200_000  # tables of more rows are shuffled


def _class(modulus: int, rests: tuple[int, ...]) -> str:
    """The bytes with these rests, as a class of a regular expression over one character a byte."""
    return "[" + "".join(f"\\x{b:02x}" for b in range(256) if b % modulus in rests) + "]"


def boundary_pattern(least: int, most: int) -> str:
    """A chunk: up to the first boundary that is far enough, else as much as is allowed."""
    ends = _class(8, (1, 4)) + _class(8, (0, 5)) + _class(4, (2,))  # about one place in sixty-four
    return f"(?s).{{{least},{most}}}?{ends}|.{{1,{most}}}"


def chunks_of(text: Column, params: ChunkParams) -> Column:
    """A text's chunks in order, a character for each byte; none of an empty text."""
    by_bytes = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.regexp_extract_all(by_bytes, F.lit(boundary_pattern(params.least, params.most)), F.lit(0))


def _identifier(chunk: Column, params: ChunkParams) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - params.id_bits) if params.id_bits < 64 else F.xxhash64(chunk)


def recipes(docs: DataFrame, id_col: str, text_col: str, carry: list[str], params: ChunkParams, clashing: list[int] | None = ()) -> DataFrame:
    """(n, id, row, recipe, key, text_sha256) of each row, written: n tells rows apart, key is a hash of the recipe. An identifier of clashing has its chunk
    beside it; all have with clashing None."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    row = F.struct(*[docs[f"`{c}`"] for c in carry]) if carry else F.lit(None).cast("int")
    cut = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), row.alias("row"), chunks_of(text, params).alias("chunks"), F.sha2(text, 256).alias("text_sha256"))
    if clashing is None or clashing:
        known = F.lit(True) if clashing is None else _identifier_in(clashing)
        entry = lambda c: F.struct(_identifier(c, params).alias("id"), F.when(known if clashing is None else known(_identifier(c, params)), c).alias("chunk"))
    else:
        entry = lambda c: _identifier(c, params)
    listed = cut.select(F.monotonically_increasing_id().alias("n"), "id", "row", F.transform("chunks", entry).alias("recipe"), "text_sha256")
    return materialise(listed.withColumn("key", F.xxhash64("recipe")), "exact-recipes")


def _identifier_in(clashing: list[int]):
    table = F.from_json(F.lit(str(sorted(clashing))), "array<bigint>")  # folded to a constant
    return lambda h: F.array_contains(table, h)


def shared_recipes(rows: DataFrame) -> DataFrame:
    """(key, recipe, group_size, last: the row that stays) of each recipe that several rows have, written."""
    found = rows.groupBy("key", "recipe").agg(F.count("*").alias("group_size"), F.max(F.struct("id", "n")).alias("last"))
    return materialise(found.filter("group_size > 1"), "exact-groups")


def clashes(docs: DataFrame, text_col: str, groups: DataFrame, params: ChunkParams) -> list[int] | None:
    """Identifiers that stand for different chunks within texts of shared recipes; None if there are more than clash_rows."""
    keys = groups.select("key").distinct()
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    cut = docs.select(chunks_of(text, params).alias("chunks"))
    cut = cut.select("chunks", F.xxhash64(F.transform("chunks", lambda c: _identifier(c, params))).alias("key"))
    if keys.count() <= params.broadcast_rows:
        mine = cut.join(F.broadcast(keys), "key", "left_semi").select(F.explode("chunks").alias("chunk")).distinct()
    else:  # a hot recipe's chunks are one row a task before its key is looked up
        mine = cut.select("key", F.explode("chunks").alias("chunk")).distinct().join(keys, "key", "left_semi").select("chunk").distinct()
    found = mine.groupBy(_identifier(F.col("chunk"), params).alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id")
    rows = found.limit(params.clash_rows + 1).collect()  # the bound decides between two exact ways
    return None if len(rows) > params.clash_rows else [r.id for r in rows]


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, params: ChunkParams = ChunkParams()) -> DataFrame:
    """A row for each row of docs: id_col, keep_id, group_size, kept, text_sha256, ``row`` with the columns of carry."""
    carry = carry or []
    rows = recipes(docs, id_col, text_col, carry, params)
    groups = shared_recipes(rows)
    wrong = clashes(docs, text_col, groups, params)
    if wrong is None or wrong:
        rows = recipes(docs, id_col, text_col, carry, params, wrong)
        groups = shared_recipes(rows)
    judged = with_groups(rows, groups, params)
    found = judged.select(
        F.col("id").alias(id_col),
        F.when(F.col("last").isNull(), F.col("id")).otherwise(F.col("last.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("last").isNull() | (F.col("last.n") == F.col("n"))).alias("kept"),
        "text_sha256",
        "row",
    )
    return found if carry else found.drop("row")


def with_groups(rows: DataFrame, groups: DataFrame, params: ChunkParams) -> DataFrame:
    """rows with group_size and last of their recipe, null where no other row has it."""
    size = groups.agg(F.count("*").alias("n"), F.sum(F.size("recipe")).alias("entries")).first()
    if size.n <= params.broadcast_rows and (size.entries or 0) <= 10 * params.broadcast_rows:
        return rows.join(F.broadcast(groups), ["key", "recipe"], "left")
    hot = groups.filter(F.col("group_size") > rows.count() // HOT_SHARE)
    keys = F.broadcast(hot.select("key", F.lit(True).alias("hot")).distinct())  # HOT_SHARE rows at most
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    many = groups.join(keys, "key", "left").select("key", "recipe", "group_size", "last", salts)
    dealt = rows.join(keys, "key", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("n", F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    return dealt.join(many, ["key", "recipe", "salt"], "left")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: ChunkParams = ChunkParams()) -> DataFrame:
    """The rows of docs that stay, columns as they were."""
    return duplicates(docs, id_col, text_col, docs.columns, params).filter("kept").select("row.*")
