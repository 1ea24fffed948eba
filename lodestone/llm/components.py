"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scratch import drop, saved


def local_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index that each of n items reaches by the links (a, b)."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            return root
        root = new


def components(links: DataFrame, paths: list[str], most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b) that is not the smallest of its
    component; root is the smallest node it reaches.

    Alternates the large-star and small-star steps: every step is a join with the
    smallest neighbour (a partial aggregate), so a node with very many links costs no
    task more than its share: the join has a second key that follows from the first, so that
    both of its sides are shuffled for it alone and adaptive execution can split them. Each round is written to the shared folder. Raises if
    ``most_rounds`` do not suffice; the rounds needed grow with the logarithm of the
    longest chain.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    own: list[str] = []
    edges = saved(edges, "links", own)
    key = F.pmod("a", F.lit(2))
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.withColumn("k", key).join(least.withColumn("k", key), ["a", "k"]).where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.withColumn("k", key).join(least.withColumn("k", key), ["a", "k"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = saved(small.unionByName(least.withColumnRenamed("m", "b")).distinct(), "links", own)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            paths.append(own.pop())
            drop(spark, *own)
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        if len(own) > 2:
            drop(spark, own.pop(0))
    raise RuntimeError(f"components: not done after {most_rounds} rounds")
