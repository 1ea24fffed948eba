"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
run() writes each stage's rows as Parquet in the shared folder and reads them back, so a lost
executor costs at most a stage, and drops them when the next stage has been written.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.scratch import drop, saved
from lodestone.llm import decontaminate, langid, linededup, minhash, packing

#: A document whose best language has less than this is rejected; four languages at random have 0.25.
LEAST_LANGUAGE_SCORE = 0.3
#: Percent of shared shingles from which documents are near duplicates.
NEAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null and empty texts, texts without a letter, and those whose best
    language is not likely enough. Very long texts count by all of their windows. Of languages with equal
    probability the first counts, which changes no decision. Repeated rows are decided alike, each for
    itself. Without a document to learn from, or an empty table, nothing is left."""
    return langid.keep_languages(docs, langid.train(docs), LEAST_LANGUAGE_SCORE)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go from its documents; n_chars follows the text. Near copies, as
    the next stage finds them, count as one page, so that a large group keeps its own text until one
    of it is chosen. A document of boilerplate only keeps its text, for the next stage to compare.

    A null text stays null with a null n_chars; an empty one stays; both are pages of their host. A line
    exactly at the ratio stays. Rows that repeat a doc_id count each. An empty table stays empty."""
    kept = linededup.strip_lines(docs, groups=linededup.near_groups(docs, NEAR_PERCENT), whole=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest doc_id; rows that
    repeat that doc_id all stay. Null and empty texts and those without words are in no group and stay, as do
    rows without a doc_id. Very long texts are compared whole. A pair exactly at the threshold
    is linked. An empty table stays empty."""
    return minhash.deduplicate(docs, NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go: ten words in a row of an item, or the whole of a
    shorter one. Null and empty texts have none and stay. Very long texts are searched whole. Repeated rows are
    decided alike. An item without words, or an empty benchmark, takes no document."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens. Null and empty texts are one token, the end of a
    document. Long texts are cut into as many pieces as they need; repeated rows are packed each.
    An empty table has no pieces."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Language identification and tokenisation have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for name, stage in STAGES:
        paths: list[str] = []
        docs = saved(stage(spark, docs, sf_dir), name, paths)
        drop(spark, *before)
        before = paths
    return docs
