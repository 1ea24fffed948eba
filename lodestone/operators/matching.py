"""Entities of an item against the nodes of a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import match_key, upper, words


def exact(entities: DataFrame, nodes: DataFrame, item: str = "item_id", graph: str | None = None) -> DataFrame:
    """item, ent_ord, entity_name: the node of the same key, the largest name of equals. With ``graph``,
    a column of both, an item's entities meet the nodes of its own graph only."""
    g = [graph] if graph else []
    keyed = nodes.select(*g, match_key(F.col("entity_name")).alias("k"), "entity_name").groupBy(*g, "k").agg(F.max("entity_name").alias("entity_name"))
    return entities.select(item, *g, "ent_ord", match_key(F.col("entity")).alias("k")).join(keyed, [*g, "k"]).select(item, *g, "ent_ord", "entity_name")


def by_tokens(entities: DataFrame, nodes: DataFrame, matched: DataFrame, k: int = 5, item: str = "item_id", graph: str | None = None) -> DataFrame:
    """item, entity_name: for items without an exact match, the nodes of their k best pairs
    of entity and node by token Jaccard. Only pairs that share a token are looked at: each different
    text of an entity meets each different name once, shared tokens are counted by a partial aggregate,
    and k names of each text are left before items come in."""
    g = [graph] if graph else []
    left = entities.join(matched.select(item).distinct(), item, "left_anti").select(item, *g, "ent_ord", "entity").distinct()

    def tokens(df: DataFrame, c: str, n: str) -> DataFrame:
        rows = df.select(*g, c).distinct().select(*g, c, F.array_distinct(words(upper(F.col(c)))).alias("ts"))
        return rows.select(*g, c, F.size("ts").alias(n), F.explode("ts").alias("t"))

    pairs = tokens(left, "entity", "n").join(tokens(nodes, "entity_name", "m"), [*g, "t"]).groupBy(*g, "entity", "n", "entity_name", "m").agg(F.count("*").alias("same"))
    pairs = pairs.withColumn("sim", F.col("same") / (F.col("n") + F.col("m") - F.col("same")))
    top = lambda df, by, *order: df.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("sim"), *order))).where(F.col("r") <= k).drop("r")
    best = top(pairs, [*g, "entity"], "entity_name").select(*g, "entity", "entity_name", "sim")
    return top(left.join(best, [*g, "entity"]), [item], "ent_ord", "entity_name").select(item, *g, "entity_name").distinct()


def by_vectors(hits: DataFrame, item: str = "item_id", node: str = "vec_id") -> DataFrame:
    """item, node, score: scores of the top-k hits of an item's entities, added."""
    return hits.groupBy(item, node).agg(F.sum("score").alias("score"))


def dispatch(algorithm: str, **found: DataFrame) -> DataFrame:
    if algorithm not in ("exact", "emb"):
        raise ValueError(f"unknown algorithm {algorithm}")
    return found[algorithm]


def fill_missing(cached: DataFrame, items: DataFrame, extract, key: str) -> DataFrame:
    """Cached rows, and what ``extract`` makes of the items that have none."""
    return cached.unionByName(extract(items.join(cached.select(key).distinct(), key, "left_anti")))
