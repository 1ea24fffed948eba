"""Keyed undirected graphs: nodes(graph_id, entity_name, ...), edges(graph_id, a <= b, ...).

All graphs are processed in the same job, keyed by ``graph_id``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.arrow import unescape_html
from lodestone.functions.scratch import drop, saved
from lodestone.functions.text import strip, upper

UNKNOWN = '"UNKNOWN"'


def merge_nodes(mentions: DataFrame, order: list[str], graph: str = "graph_id") -> DataFrame:
    """A node for each (graph, entity_name): the most frequent type (the first seen of equals, by
    ``order``), and its distinct descriptions and source ids, sorted."""
    by = [graph, "entity_name"]
    types = mentions.groupBy(*by, "entity_type").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    best = types.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "entity_type")).alias("x")).select(*by, F.col("x.entity_type").alias("entity_type"))
    rest = mentions.groupBy(*by).agg(
        F.array_sort(F.collect_set("description")).alias("descriptions"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))
    return best.join(rest, by)


def merge_edges(relations: DataFrame, graph: str = "graph_id") -> DataFrame:
    """An edge for each unordered pair: weights added, the smallest order (1 if none is given),
    distinct descriptions and source ids, sorted."""
    rows = relations.select(
        graph, F.least("src_id", "tgt_id").alias("a"), F.greatest("src_id", "tgt_id").alias("b"), "weight", "description", "source_id",
        (F.col("order") if "order" in relations.columns else F.lit(1)).alias("order"))
    return rows.groupBy(graph, "a", "b").agg(
        F.sum("weight").alias("weight"), F.min("order").alias("order"),
        F.array_sort(F.collect_set("description")).alias("descriptions"), F.array_sort(F.collect_set("source_id")).alias("source_ids"))


def summarised(rows: DataFrame, summarise: Callable[[Column], Column] | None = None) -> DataFrame:
    """rows with their descriptions put through ``summarise``, a function of the array column (a
    model's, say); as they are without one."""
    return rows if summarise is None else rows.withColumn("descriptions", summarise(F.col("descriptions")))


def endpoints(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    return edges.select(graph, "a", "b", "descriptions", "source_ids", F.explode(F.array("a", "b")).alias("entity_name"))


def placeholders(nodes: DataFrame, edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """Nodes for the ends of edges that have none: of unknown type, with the description and
    sources of the first edge (by a, b) that touches them."""
    missing = endpoints(edges, graph).join(nodes.select(graph, "entity_name"), [graph, "entity_name"], "left_anti")
    first = missing.groupBy(graph, "entity_name").agg(F.min_by(F.struct("descriptions", "source_ids"), F.struct("a", "b")).alias("x"))
    return first.select(graph, "entity_name", F.lit(UNKNOWN).alias("entity_type"), "x.descriptions", "x.source_ids")


def build(mentions: DataFrame, relations: DataFrame, order: list[str], graph: str = "graph_id") -> tuple[DataFrame, DataFrame]:
    """nodes and edges of all graphs; a graph without an entity has neither."""
    nodes = merge_nodes(mentions, order, graph)
    edges = merge_edges(relations, graph).join(nodes.select(graph).distinct(), graph, "left_semi")
    return nodes.unionByName(placeholders(nodes, edges, graph)), edges


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key; where both have one, each attribute of ``new`` that isn't null wins."""
    other = [c for c in old.columns if c not in keys]
    renamed = new.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in other if c in new.columns])
    return old.join(renamed, keys, "full_outer").select(
        *keys, *[F.coalesce(F.col(f"__new_{c}"), F.col(c)).alias(c) if c in new.columns else F.col(c) for c in other])


def degrees(nodes: DataFrame, edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """graph, entity_name, degree for every node; a self-loop adds 2, a lone node has 0."""
    ends = edges.select(graph, F.explode(F.array("a", "b")).alias("entity_name")).groupBy(graph, "entity_name").agg(F.count("*").alias("degree"))
    return nodes.select(graph, "entity_name").join(ends, [graph, "entity_name"], "left").select(
        graph, "entity_name", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def edge_degrees(edges: DataFrame, degree: DataFrame, graph: str = "graph_id") -> DataFrame:
    """The sum of the degrees of an edge's ends."""
    one = degree.select(graph, F.col("entity_name").alias("a"), F.col("degree").alias("da"))
    two = degree.select(graph, F.col("entity_name").alias("b"), F.col("degree").alias("db"))
    return edges.join(one, [graph, "a"], "left").join(two, [graph, "b"], "left").select(
        graph, "a", "b", (F.coalesce("da", F.lit(0)) + F.coalesce("db", F.lit(0))).alias("edge_degree"))


#: Edges that a task holds until it reduces them to a forest.
FOREST = 1 << 19


def _forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """For each (g, a, b) component one edge from its first node to every other: as few as join the same nodes."""
    code = pd.MultiIndex.from_frame(pd.concat([pairs[["g", "a"]], pairs[["g", "b"]].rename(columns={"b": "a"})], ignore_index=True))
    place, known = pd.factorize(code)
    u, v = place[: len(pairs)], place[len(pairs) :]
    root = np.arange(len(known))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new[root] == root).all():
            break
        root = new[root]
    on = np.flatnonzero(root != np.arange(len(root)))
    g, name = known.get_level_values(0), known.get_level_values(1)
    return pd.DataFrame({"g": g[root[on]], "a": name[root[on]], "b": name[on]})


def spanning(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """Edges (graph, a, b) that join what ``edges`` join, at most one for each node that a task met: a dense graph
    leaves few, without a shuffle. A task holds twice FOREST edges."""
    kind = dict(edges.dtypes)
    rows = edges.where("a <> b").select(F.col(graph).alias("g"), "a", "b").where("g IS NOT NULL")

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= FOREST:
                held = [_forest(pd.concat(held, ignore_index=True))]
                n = len(held[0])
                if n > FOREST // 2:
                    yield held.pop()
                    n = 0
        if n:
            yield _forest(pd.concat(held, ignore_index=True))

    return rows.mapInPandas(thin, f"g {kind[graph]}, a {kind['a']}, b {kind['b']}").withColumnRenamed("g", graph)


def component_labels(nodes: DataFrame, edges: DataFrame, graph: str = "graph_id", most_rounds: int = 60) -> DataFrame:
    """graph, entity_name, component: the smallest name that a node reaches. Smallest labels
    spread along edges and jump along labels; rounds go with the logarithm of the longest
    chain, and each is a written table."""
    spark = nodes.sparkSession
    edges = spanning(edges, graph)
    both = edges.select(graph, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(graph, F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct()
    own: list[str] = []
    both = saved(both, "sides", own)
    labels = saved(nodes.select(graph, "entity_name", F.col("entity_name").alias("component")), "labels", own)
    before = None
    for _ in range(most_rounds):
        near = both.join(labels.select(graph, F.col("entity_name").alias("v"), "component"), [graph, "v"]).groupBy(graph, "u").agg(F.min("component").alias("m"))
        step = labels.join(near.withColumnRenamed("u", "entity_name"), [graph, "entity_name"], "left").select(
            graph, "entity_name", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = step.select(graph, F.col("entity_name").alias("component"), F.col("component").alias("further"))
        step = step.join(jump, [graph, "component"], "left").select(graph, "entity_name", F.least("component", F.coalesce("further", "component")).alias("component"))
        labels = saved(step, "labels", own)
        state = labels.agg(F.sum(F.xxhash64(graph, "entity_name", "component").cast("decimal(38,0)"))).first()
        if len(own) > 2:
            drop(spark, own.pop(1))
        if state == before:
            return labels
        before = state
    raise RuntimeError(f"component_labels: not done after {most_rounds} rounds")


def largest_component(nodes: DataFrame, edges: DataFrame, graph: str = "graph_id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each graph's largest component (the smallest label of equals)."""
    labels = component_labels(nodes, edges, graph)
    sizes = labels.groupBy(graph, "component").agg(F.count("*").alias("n"))
    best = sizes.groupBy(graph).agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("x")).select(graph, F.col("x.component").alias("component"))
    kept = labels.join(best, [graph, "component"], "left_semi").select(graph, "entity_name")
    return kept, edges.join(kept.withColumnRenamed("entity_name", "a"), [graph, "a"], "left_semi")


def stable_largest(nodes: DataFrame, edges: DataFrame, graph: str = "graph_id") -> tuple[DataFrame, DataFrame]:
    """The largest component of each graph with names in upper case, stripped, their character
    references decoded; ends of edges in order. Nodes that get one name become one, the first of
    them. Sorted by graph and name, edges by "a -> b"."""
    kept, among = largest_component(nodes, edges, graph)
    clean = lambda c: unescape_html(strip(upper(F.col(c))))
    n = kept.select(graph, F.col("entity_name").alias("was"), clean("entity_name").alias("entity_name")).groupBy(graph, "entity_name").agg(F.min("was").alias("was"))
    e = among.withColumn("x", clean("a")).withColumn("y", clean("b")).withColumn("a", F.least("x", "y")).withColumn("b", F.greatest("x", "y")).drop("x", "y")
    rest = [c for c in e.columns if c not in (graph, "a", "b")]
    first = F.min(F.struct(*rest)).alias("r") if rest else F.count("*").alias("r")
    e = e.groupBy(graph, "a", "b").agg(first).select(graph, "a", "b", *([F.col("r")[c].alias(c) for c in rest]))
    return n.orderBy(graph, "entity_name"), e.orderBy(graph, F.concat_ws(" -> ", "a", "b"))
