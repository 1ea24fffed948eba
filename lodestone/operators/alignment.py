"""Alignment scores of an item's chunks: normalising, weighting, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clean_content

WEIGHTS = {"forward": 1.0, "backward": 0.3, "parameter": 1.0}
SHORT_TOKENS = 10


def min_max(c: str, by: list[str]) -> Column:
    """c scaled to [0, 1] within ``by``; null stays null, a constant becomes 0.5, and -inf (a
    failed score) counts as null."""
    w = Window.partitionBy(*by)
    x = F.when(F.col(c) != F.lit(float("-inf")), F.col(c))
    low, high = F.min(x).over(w), F.max(x).over(w)
    flat = F.abs(high - low) <= 1e-9 * F.greatest(F.abs(high), F.abs(low))
    return F.when(x.isNull(), F.lit(None).cast("double")).when(flat, F.lit(0.5)).otherwise((x - low) / (high - low))


def scores(rows: DataFrame, by: list[str], tokens: str = "tokens", weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """rows with forward, backward and parameter normalised and their weighted sum as score,
    which chunks of fewer than ten tokens get only in part. Missing scores count 0."""
    out = rows.select(*[c for c in rows.columns if c not in weights], *[min_max(k, by).alias(k) for k in weights])
    total = sum((F.coalesce(k, F.lit(0.0)) * v for k, v in weights.items()), F.lit(0.0))
    part = F.when(F.col(tokens) < SHORT_TOKENS, F.col(tokens) / F.lit(float(SHORT_TOKENS))).otherwise(F.lit(1.0))
    return out.withColumn("score", total * part)


def ranks(scored: DataFrame, by: list[str], tie: str, names=("score", "forward", "backward", "parameter")) -> DataFrame:
    """name_rank for each score, best first, ties to the smaller ``tie``; nulls last."""
    for c in names:
        w = Window.partitionBy(*by).orderBy(F.desc_nulls_last(c), tie)
        scored = scored.withColumn(f"{c}_rank", F.row_number().over(w).cast("long"))
    return scored


def top(ranked: DataFrame, name: str, k: int = 10) -> DataFrame:
    """The k best by one score, with the cleaned text."""
    return ranked.where(F.col(f"{name}_rank") <= k).withColumn("cleaned_content", clean_content(F.col("content")))


def rank_lists(ranked: DataFrame, by: list[str], tie: str, k: int | None = None, names=("forward", "backward", "parameter")) -> DataFrame:
    """For each score, the positions (``tie``) of an item's chunks, best first."""
    def listed(c: str) -> Column:
        entry = F.struct(F.col(f"{c}_rank").alias("r"), F.col(tie).alias("t"))
        kept = entry if k is None else F.when(F.col(f"{c}_rank") <= k, entry)
        return F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["t"]).alias(f"{c}_rank")

    return ranked.groupBy(*by).agg(*[listed(c) for c in names])
