"""Hard negatives and training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POSITIVES, NEGATIVES = 10, 20


def negatives(retrieved: DataFrame, positives: DataFrame, item: str, content: str = "content") -> DataFrame:
    """What the queries of an item found, once, without its positives."""
    return retrieved.select(item, content).distinct().join(positives.select(item, content), [item, content], "left_anti")


def top_positives(scored: DataFrame, item: str, tie: str, n: int = POSITIVES) -> DataFrame:
    w = Window.partitionBy(item).orderBy(F.desc("score"), tie)
    return scored.withColumn("pos_rank", F.row_number().over(w).cast("long")).where(F.col("pos_rank") <= n)


def sampled(positives: DataFrame, pool: DataFrame, item: str, m: int = NEGATIVES, seed: int = 0, content: str = "content", ordinal: str = "ord", shuffled: bool = False) -> DataFrame:
    """item, pos_rank, neg_rank, negative: for each positive, m rows of its item's pool without
    replacement, in the order of a hash of seed, item, position and content (repeats told
    apart by their ordinal). Positives of an item without a pool have no rows."""
    pairs = positives.select(item, "pos_rank").join(pool.select(item, F.col(content).alias("negative"), ordinal), item)
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(item).cast("string"), F.col("pos_rank").cast("string"), "negative"))
    w = Window.partitionBy(item, "pos_rank").orderBy(draw, ordinal)
    return pairs.withColumn("neg_rank", F.row_number().over(w).cast("long")).where(F.col("neg_rank") <= m).select(item, "pos_rank", "neg_rank", "negative")


def training_rows(items: DataFrame, positives: DataFrame, drawn: DataFrame, item: str, query: str = "query", content: str = "content") -> DataFrame:
    """messages, positive_messages, negative_messages: one row for each positive with negatives."""
    said = lambda c: F.array(F.struct(F.lit("user").alias("role"), c.alias("content")))
    grouped = drawn.groupBy(item, "pos_rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("neg_rank", "negative"))), lambda x: said(x["negative"])).alias("negative_messages"))
    rows = positives.select(item, "pos_rank", F.col(content).alias("positive")).join(grouped, [item, "pos_rank"]).join(items.select(item, query), item)
    return rows.select(item, "pos_rank", said(F.col(query)).alias("messages"), F.array(said(F.col("positive"))).alias("positive_messages"), "negative_messages")


def stage(number: int, items: DataFrame, positives: DataFrame, all_chunks: DataFrame, matched_large: DataFrame, matched_small: DataFrame, item: str, m: int = NEGATIVES, seed: int = 0, ordinal: str = "ord") -> DataFrame:
    """Rows of curriculum stage 1 (any chunk of the item but its positives), 2 or 3 (matched
    chunks of the large or small subgraph)."""
    pool = {1: all_chunks, 2: matched_large, 3: matched_small}[number]
    pool = pool.join(positives.select(item, "content"), [item, "content"], "left_anti")
    return training_rows(items, positives, sampled(positives, pool, item, m, seed, ordinal=ordinal), item)


def concat(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
