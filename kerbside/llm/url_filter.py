"""URL filter: allow and block rules, then gradient-boosted trees on lexical features.

Features are Spark expressions over host, path and query: lengths, depth, digit ratio, entropy, parameter counts, and how often the host's suffix was bad among
the labelled URLs (shrunk to the mean). The trees are Spark's own (``pyspark.ml``), trained on at most ``max_train_rows``
labelled URLs, those with the smallest hash; all URLs are counted for the suffix statistics and all are judged.

Null URLs and URLs without ``://`` have an empty host and path; no rule fits them and the trees judge them. Rows of equal id or URL
are judged each. Very long URLs are cut and measured whole, by expressions that pass over them a few times. An empty table of URLs gives an empty result, whatever the labels. Only the
id and the URL are read, so other columns may have any names. If there are no labels, or all are the same, everything gets that label's verdict (allow without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, rule): the rule's host, a slash, and the start of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


@dataclass(frozen=True)
class UrlParams:
    rules: tuple[tuple[str, str], ...] = RULES
    max_train_rows: int = 100_000
    trees: int = 12
    depth: int = 4
    step: float = 0.2
    seed: int = 7
    block_above: float = 0.5
    shrink: float = 20.0  # labelled URLs that the mean counts as, in a suffix's rate


def parts(urls: DataFrame, url_col: str) -> DataFrame:
    """urls with host, path and query."""
    at = F.locate("://", url_col)
    rest = F.when(at > 0, F.substr(url_col, at + 3)).otherwise("")
    host = F.regexp_extract("rest", "^[^/?#]*", 0)
    known = urls.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumn("raw_host", host)
    tail = F.substr("rest", F.length("raw_host") + 1)
    known = known.withColumn("host", F.translate("raw_host", UPPER, LOWER)).withColumn("path", F.regexp_extract(tail, "^[^?#]*", 0))
    return known.withColumn("query", F.regexp_extract(F.substr("rest", F.length("raw_host") + F.length("path") + 1), "^\\?([^#]*)", 1)).drop("rest", "raw_host")


def ruled(rules: tuple[tuple[str, str], ...]) -> Column:
    """The longest rule that fits host and path as a struct (chars, rule, verdict); null if none does."""
    fits = []
    for verdict, rule in rules:
        name, _, path = rule.partition("/")
        fit = ((F.col("host") == name) | F.endswith("host", F.lit("." + name))) & F.startswith("path", F.lit("/" + path))
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("chars"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits))


def _share(text: Column, kind: str) -> Column:
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(kind)), F.length(text)), F.lit(0.0))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars, n = F.split(text, ""), F.length(text)
    each = F.transform(F.array_distinct(chars), lambda c: F.try_divide(F.size(F.filter(chars, lambda d: d == c)), n))
    return F.coalesce(F.when(n > 0, F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))), F.lit(0.0))


FEATURES = ("host_chars", "host_labels", "host_digits", "host_hyphens", "host_entropy", "path_chars", "path_depth", "path_digits", "path_entropy", "params", "query_chars", "secure", "suffix_rate", "suffix_share")


def featured(known: DataFrame, url_col: str) -> DataFrame:
    suffix = F.substring_index("host", ".", -2)
    return known.withColumns(
        {
            "suffix": suffix,
            "host_chars": F.length("host").cast("double"),
            "host_labels": F.size(F.split("host", "\\.")).cast("double"),
            "host_digits": _share(F.col("host"), "[0-9]"),
            "host_hyphens": F.regexp_count("host", F.lit("-")).cast("double"),
            "host_entropy": _entropy(F.col("host")),
            "path_chars": F.length("path").cast("double"),
            "path_depth": F.regexp_count("path", F.lit("/[^/]")).cast("double"),
            "path_digits": _share(F.col("path"), "[0-9]"),
            "path_entropy": _entropy(F.col("path")),
            "params": F.when(F.col("query") == "", 0).otherwise(F.regexp_count("query", F.lit("&")) + 1).cast("double"),
            "query_chars": F.length("query").cast("double"),
            "secure": F.coalesce(F.startswith(url_col, F.lit("https")), F.lit(False)).cast("double"),
        }
    )


def judged(urls: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", params: UrlParams = UrlParams()) -> DataFrame:
    """A row for each row of urls: id, host, path, rule, verdict, p_bad (null where a rule decides or there's nothing to learn).

    labelled: (url, bad: 0 or 1).
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    known = featured(parts(labelled.select(F.col("url"), F.col("bad").cast("double").alias("label")).filter("label is not null"), "url"), "url")
    known = materialise(known, "urls-labelled")
    every = featured(parts(urls.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")), "url"), "url")
    totals, pages = known.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).first(), every.count()
    mean = totals["mean"] or 0.0
    rates = known.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("bad"))
    shares = every.groupBy("suffix").agg(F.count("*").alias("seen"))
    rate = (F.coalesce("bad", F.lit(0.0)) + mean * params.shrink) / (F.coalesce("n", F.lit(0)) + params.shrink)
    # written, so that Spark knows its size: small, it is broadcast; large, it is joined by shuffle, hot suffixes split
    stats = materialise(shares.join(rates, "suffix", "full").select("suffix", rate.alias("suffix_rate"), (F.coalesce("seen", F.lit(0)) / max(pages, 1)).alias("suffix_share")), "urls-suffixes")
    judged_by_rule = every.withColumn("fit", ruled(params.rules))
    verdict = F.coalesce("fit.verdict", F.when(F.col("p_bad") > params.block_above, "block").otherwise("allow"))
    out = [F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), F.when(F.col("fit").isNull(), F.col("p_bad")).alias("p_bad")]
    if not 0 < mean < 1:
        return judged_by_rule.withColumn("p_bad", F.lit(mean)).select(*out)
    vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    sample = known.orderBy(F.xxhash64("url", F.lit(params.seed)), "url").limit(params.max_train_rows)
    train = materialise(sample.join(stats, "suffix", "left").fillna(mean, ["suffix_rate"]).fillna(0.0, ["suffix_share"]).select("label", *FEATURES), "urls-train")
    model = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, stepSize=params.step, seed=params.seed).fit(vector.transform(train.coalesce(8)).select("label", "features"))
    placed = judged_by_rule.join(stats, "suffix", "left").fillna(mean, ["suffix_rate"]).fillna(0.0, ["suffix_share"])
    scored = model.transform(vector.transform(placed)).withColumn("p_bad", vector_to_array("probability")[1])
    return scored.select(*out)
