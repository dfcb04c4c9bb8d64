"""Chat formatting with Spark expressions only.

A conversation's rows are gathered as structs and sorted by turn (ties: role, then text); adjacent turns of one role are merged into one block by array
functions, its turns set apart by a mark. No array is copied for each turn, so the work does not grow with the square of a conversation. User blocks stand between ``[INST] `` and `` [/INST]``, assistant blocks between ``<s> `` and `` </s>``, all others between
``[SYS] `` (with the role on the first line) and `` [/SYS]``.

A mark inside a text gets a backslash after its first character, and so does one that already has backslashes there; taking one
away undoes that, so every text can be read back. In a role, a line feed is written ``%0A`` and ``%`` as ``%25``. The loss mask is a list of spans (start, length, in code points of the formatted text) of the
assistant texts.

Null texts and roles are empty; rows without a conversation id are one conversation. A conversation is one output row, so its turns must fit
one task, as the formatted text must. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of the template (fixed values): before and after a block by role, and between turns of a block.
USER, ASSISTANT, OTHER, BETWEEN = ("[INST] ", " [/INST]"), ("<s> ", " </s>"), ("[SYS] ", " [/SYS]"), "[TURN]"
MARK = r"(/?(?:s>|INST\]|SYS\]|TURN\]))"
BLOCK = r"(?s)\[INST\] .*? \[/INST\]|<s> .*? </s>|\[SYS\] .*? \[/SYS\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + MARK, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + MARK, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role on one line: its line feeds and per cents by number."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _opening(role: Column) -> Column:
    return F.when(role == "user", USER[0]).when(role == "assistant", ASSISTANT[0]).otherwise(F.concat(F.lit(OTHER[0]), escape_role(role), F.lit("\n")))


def _closing(role: Column) -> Column:
    return F.when(role == "user", USER[1]).when(role == "assistant", ASSISTANT[1]).otherwise(OTHER[1])


def sums_before(column: str, piece: int = 256) -> Column:
    """For each element of an array of ints the sum of those before it. Sums grow within pieces and over the pieces' totals, so that a long array is not
    copied for each of its elements."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.size(column) - 1, F.lit(0)), F.lit(piece)), lambda k: F.slice(column, k + 1, piece))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))

    def running(numbers: Column) -> Column:
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all"))
        return F.aggregate(numbers, start, step)["all"]

    bases = running(F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda acc, x: acc + x)))
    return F.flatten(F.zip_with(pieces, bases, lambda p, base: F.transform(running(p), lambda x: x + base)))


def formatted(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each conversation: id, formatted, loss_spans."""
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    gathered = turns.select(F.col(id_col).alias("id"), one.alias("t")).groupBy("id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    opens = F.transform("turns", lambda t, k: (k == 0) | (F.get("turns", k - 1)["role"] != t["role"]))
    texts = F.transform("turns", lambda t: escape(t["text"]))
    marked = gathered.select("id", "turns", opens.alias("opens"), texts.alias("texts"))
    # what stands before a turn's text: neighbours of one role are set apart within their block, other turns close one block and open the next
    ended = lambda k: F.when(k > 0, _closing(F.get("turns", k - 1)["role"])).otherwise("")
    before = F.transform("turns", lambda t, k: F.when(F.get("opens", k), F.concat(ended(k), _opening(t["role"]))).otherwise(BETWEEN))
    parts = marked.select("id", "turns", "texts", before.alias("before"))
    lengths = F.zip_with("before", "texts", lambda b, t: F.length(b) + F.length(t))
    written = parts.select("id", "turns", "texts", "before", lengths.alias("lengths"))
    at = written.select("id", "turns", "texts", "before", sums_before("lengths").alias("at"))
    spans = F.transform("turns", lambda t, k: F.when(t["role"] == "assistant", F.struct((F.get("at", k) + F.length(F.get("before", k)) + 1).alias("start"), F.length(F.get("texts", k)).alias("length"))))
    joined = F.concat(F.array_join(F.zip_with("before", "texts", lambda b, t: F.concat(b, t)), ""), _closing(F.element_at("turns", -1)["role"]))
    return at.select(F.col("id").alias(id_col), joined.alias("formatted"), F.filter(spans, lambda x: x.isNotNull()).alias("loss_spans"))


def read_back(done: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """From formatted and loss_spans: id, turns (role, text) and loss_text, both unescaped."""
    found = F.regexp_extract_all("formatted", F.lit(BLOCK), F.lit(0))

    def role(b: Column) -> Column:
        named = unescape_role(F.substring_index(F.substr(b, F.lit(len(OTHER[0]) + 1)), "\n", 1))
        return F.when(F.startswith(b, F.lit(USER[0])), "user").when(F.startswith(b, F.lit(ASSISTANT[0])), "assistant").otherwise(named)

    def body(b: Column) -> Column:
        inner = lambda m: F.substr(b, F.lit(len(m[0]) + 1), F.length(b) - (len(m[0]) + len(m[1])))
        other = inner(OTHER)
        return F.when(F.startswith(b, F.lit(USER[0])), inner(USER)).when(F.startswith(b, F.lit(ASSISTANT[0])), inner(ASSISTANT)).otherwise(F.substr(other, F.locate("\n", other) + 1))

    blocks = F.transform(found, lambda b: F.struct(role(b).alias("role"), F.split(body(b), r"\[TURN\]").alias("texts")))
    turns = F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), unescape(t).alias("text")))))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", s["start"], s["length"]))), "")
    return done.select(F.col(id_col), turns.alias("turns"), loss.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


#: What op2 computes, in DuckDB; the formatted length from the lengths of its parts.
ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) v(conv_id, turn, r, t)
), n as (
  select *, row_number() over w k, coalesce(lag(r) over w <> r, true) opens from c window w as (partition by conv_id order by turn nulls first, r, t)
), p as (
  select *, length(regexp_replace(t, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|TURN\]))', '\1\\\2\3', 'g')) chars,
    length(regexp_replace(r, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|TURN\]))', '\1\\\2\3', 'g')) role_chars from n
)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by k)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by k) filter (r = 'assistant'), '')) loss_sha256,
  cast(sum(chars + case when not opens then 6 when r = 'user' then 15 when r = 'assistant' then 9 else 14 + role_chars end) as bigint) formatted_chars
from p group by conv_id
"""
