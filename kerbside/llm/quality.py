"""Quality rules at host level, with DataFrame functions only.

Each document is measured and judged by the base rules. Failures are counted for each host (``source``), the hosts' rates are
shrunk by a beta prior fitted to all hosts (method of moments), and documents of a host whose shrunk rate passes ``max_rate``
go with it. Base failures always go.

A host's counts are pre-aggregated in every task, so a host with a third of all rows costs one row a task. The host
table is written and read again, so Spark knows its size: a small one is broadcast, a large one is joined by shuffle, where
adaptive execution splits a hot host.

Null and empty texts have no words and fail. Rows without a host are a host of their own (null). Repeated rows and ids are judged
each on their own. An empty table gives an empty result. Very long texts are measured whole. Columns pass through, whatever their names. Word windows are compared by XXH64; within one text of a million windows two different ones
meet with a chance below 1e-7.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialise, small_or_shuffled

BLANK = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20
    window: int = 8
    max_repeat_percent: int = 30
    max_rate: float = 0.6
    symbols: str = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != F.lit(""))


def window_hashes(hashes: Column, window: int) -> Column:
    """A hash of each window of ``window`` words, null if there are too few; hashes: one for each word."""
    n = F.size(hashes)
    return F.when(n >= window, F.transform(F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(hashes, i, window))))


def measured(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (a struct of the columns in carry, or all), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    row = F.struct(*[docs[f"`{c}`"] for c in carry or docs.columns]).alias("row")
    w = rules.window
    one = docs.select(row, text.alias("t"), words_of(text).alias("words"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    two = one.select(
        "row",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(rules.symbols)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda x: F.xxhash64(x)).alias("hashes"),
    )
    three = two.select("row", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), window_hashes(F.col("hashes"), w).alias("windows"))
    # most texts repeat no window: only the others are sorted
    sorted_windows = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    four = three.withColumn("placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), sorted_windows)).drop("windows")
    twice = F.transform("placed", lambda x, k: F.when((F.get("placed", k - 1)["h"] == x["h"]) | (F.get("placed", k + 1)["h"] == x["h"]), x["i"]))
    five = four.withColumn("at", F.sort_array(F.filter(twice, lambda i: i.isNotNull()))).drop("placed")
    # a repeated window adds its words up to the next one's start
    step = F.transform("at", lambda i, k: F.least(F.lit(w), F.coalesce(F.get("at", k + 1) - i, F.lit(w))))
    total = F.coalesce(F.aggregate(step, F.lit(0).cast("long"), lambda acc, x: acc + x), F.lit(0).cast("long"))
    six = five.withColumn("n_repeat_words", total).drop("at")
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return six.withColumn("base_failed", failed)


def host_rates(judged: DataFrame) -> DataFrame:
    """(host, n, fails, rate): rate is shrunk towards the mean of all hosts by an empirical beta prior."""
    counts = judged.groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails"))
    hosts = materialise(counts, "quality-hosts")  # read twice; without this the texts would be measured twice
    share = F.col("fails") / F.col("n")
    all_hosts = hosts.agg((F.sum("fails") / F.sum("n")).alias("mean"), F.var_samp(share).alias("spread"), F.avg(1 / F.col("n")).alias("noise")).first()
    mean = all_hosts.mean or 0.0
    most = mean * (1 - mean)
    # variance between hosts, without what chance adds at their sizes; strength = a + b of the beta prior
    between = (all_hosts.spread or 0.0) - most * (all_hosts.noise or 0.0)
    strength = min(max(most / between - 1, 1.0), 1e6) if between > 0 and most > 0 else 1e6 if most > 0 else 1.0
    return hosts.withColumn("rate", (F.col("fails") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength)))


def judged(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text", host_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """A row for each row of docs: ``row`` (its columns, or those in carry with host_col among them), the measures, base_failed, host_rate and kept."""
    found = measured(docs, rules, text_col, carry).withColumn("host", F.col(f"row.`{host_col}`").cast("string"))
    found = materialise(found, "quality-measures")
    hosts = materialise(host_rates(found.select("host", "base_failed")).select(F.col("host").alias("h"), F.col("rate").alias("host_rate")), "quality-hosts")
    joined = found.join(hosts, found["host"].eqNullSafe(hosts["h"]), "left").drop("h", "host")
    return joined.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") <= rules.max_rate))


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules(), text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows of docs that are kept, columns as they were.

    Texts are measured twice, for the hosts and for the documents, so that no copy of them is written in between.
    """
    host = docs[f"`{host_col}`"].cast("string").alias("host")
    few = docs.select(host, docs[f"`{text_col}`"].alias("text"))
    seen = measured(few, rules, "text", ["host"]).select("row.host", "base_failed")
    bad = host_rates(seen).filter(F.col("rate") > rules.max_rate).select(F.col("host").alias("h"))
    bad = small_or_shuffled(materialise(bad, "quality-bad-hosts"), 100_000)
    # the partition's number keeps Catalyst from moving the filter down, where every measure would be made again for each use
    found = measured(docs, rules, text_col).withColumn("part", F.spark_partition_id()).filter(~F.col("base_failed") & (F.col("part") >= 0))
    kept = found.join(bad, F.col(f"row.`{host_col}`").cast("string").eqNullSafe(F.col("h")), "left_anti")
    return kept.select("row.*")
