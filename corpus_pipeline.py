"""A corpus pipeline: quality rules, line dedup, near-duplicate removal, benchmark decontamination, packing.

Each stage is a function of (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs. All but the last return the
columns of documents. Stages keep clean documents as they are:

* quality: documents that the rules or their host's verdict reject go;
* line_dedup: lines that nearly repeat an earlier line go, and documents that have no words left by that;
* near_dedup: of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles the one with the smallest id stays;
* decontaminate: documents with one hit word in twenty or more go; others keep their text whole;
* packing: the rest is packed into sequences of 4096 tokens.

Each stage takes odd rows. Null and empty texts have no words: quality rejects them, line_dedup and decontaminate keep them as they are, in
near_dedup all texts without words are one group, and packing writes their end token alone. Rows with a null or repeated id are judged each on their own, but near_dedup keeps every
row without an id and keeps or drops the rows of one id and text together; a null id comes first where the earliest row stays. A null source is a host of its own. Of repeated
rows line_dedup empties and drops all but one. Very long texts are read whole. Columns beside those of documents pass through to the last stage, whatever their
names. An empty table gives an empty one at each stage; without benchmark items nothing is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.llm import decontaminate, line_dedup, minhash, packing, quality
from kerbside.llm.common import materialised_alone
from kerbside.llm.queries import public_tokenizer

#: The stages are not expressible in SQL (MinHash, a tokenizer's ids, bin packing); tests/llm compares them with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(docs)
    left = (F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]")
    row = F.col("row").withField("text", F.col("kept_text")).withField("n_chars", F.length("kept_text").cast("long"))
    changed = F.when(F.col("n_removed") > 0, row).otherwise(F.col("row")).alias("row")
    return found.filter(left).select(changed).select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_similar(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialised_alone(spark, lambda: stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
