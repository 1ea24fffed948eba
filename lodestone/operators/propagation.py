"""Personalised PageRank over keyed graphs, cut-offs, and subgraphs around seeds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scratch import drop, saved

ALPHA, TOLERANCE, MOST_ROUNDS = 0.85, 1e-4, 100
#: Edges of a graph that one task holds; larger ones are ranked by joins.
MOST_EDGES = 1 << 22
#: (name, least, most) of the two sizes of subgraphs.
SIZES = (("large", 20, 50), ("small", 3, 10))


def adjacency(edges: DataFrame, graph: str = "graph_id") -> DataFrame:
    """(graph, u, v) both ways, once each; a self-loop is one entry."""
    return edges.select(graph, F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(graph, F.col("b").alias("u"), F.col("a").alias("v"))).distinct()


def pagerank_steps(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, rounds: int, alpha: float = ALPHA, graph: str = "graph_id", tolerance: float | None = None, every: int = 3) -> DataFrame:
    """graph, node, score after ``rounds`` steps as joins and sums, for graphs of any size. With
    ``tolerance``, a graph stays as it is once its change is under its nodes times the tolerance, and
    it is an error if one is not done after ``rounds``. Lineage is cut by a written table every few
    steps, or at every step that is tested."""
    spark = nodes.sparkSession
    own: list[str] = []
    nodes = nodes.select(graph, "node").distinct()
    seeds = seeds.select(graph, "node").distinct().join(nodes, [graph, "node"], "left_semi")
    side = adjacency(edges, graph)
    degree = side.groupBy(graph, "u").agg(F.count("*").alias("deg"))
    total = nodes.groupBy(graph).agg(F.count("*").alias("n"))
    seeded = seeds.groupBy(graph).agg(F.count("*").alias("m"))
    start = nodes.join(total, graph).join(seeded, graph).join(seeds.withColumn("s", F.lit(1)), [graph, "node"], "left").join(
        degree.withColumnRenamed("u", "node"), [graph, "node"], "left")
    start = start.select(graph, "node", "n", (F.coalesce("s", F.lit(0)) / F.col("m")).alias("p"), F.col("deg"), (F.lit(1.0) / F.col("n")).alias("x"), F.lit(False).alias("done"))
    state = saved(start, "ranks", own)
    side = saved(side, "sides")
    for i in range(rounds):
        out = side.join(state.where("deg IS NOT NULL").select(graph, F.col("node").alias("u"), (F.col("x") / F.col("deg")).alias("share")), [graph, "u"])
        gain = out.groupBy(graph, F.col("v").alias("node")).agg(F.sum("share").alias("gain"))
        lost = state.groupBy(graph).agg(F.sum(F.when(F.col("deg").isNull(), F.col("x")).otherwise(0.0)).alias("lost"))
        new = F.lit(alpha) * (F.coalesce("gain", F.lit(0.0)) + F.col("lost") * F.col("p")) + F.lit(1 - alpha) * F.col("p")
        state = state.join(gain, [graph, "node"], "left").join(lost, graph).select(graph, "node", "n", "p", "deg", "x", "done", F.when(F.col("done"), F.col("x")).otherwise(new).alias("y"))
        if tolerance is None:
            state = state.select(graph, "node", "n", "p", "deg", F.col("y").alias("x"), "done")
        else:
            state = saved(state, "ranks", own)
            moved = state.groupBy(graph).agg((F.sum(F.abs(F.col("y") - F.col("x"))) < F.max("n") * F.lit(tolerance)).alias("still"))
            state = state.join(moved, graph).select(graph, "node", "n", "p", "deg", F.col("y").alias("x"), (F.col("done") | F.col("still")).alias("done"))
        if tolerance is not None or i % every == every - 1 or i == rounds - 1:
            state = saved(state, "ranks", own)
            drop(spark, *own[:-1])
            del own[:-1]
        if tolerance is not None and state.where("NOT done").isEmpty():
            break
    else:
        if tolerance is not None:
            raise RuntimeError(f"no convergence in {rounds} rounds")
    return state.select(graph, "node", F.col("x").alias("score"))


def power_iteration(n: int, u: np.ndarray, v: np.ndarray, p: np.ndarray, w: np.ndarray | None = None, alpha: float = ALPHA, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> np.ndarray:
    """Scores of n nodes; (u, v) both ways; p sums to 1. Stops when the change is under
    n times the tolerance; raises after ``most`` rounds."""
    w = np.ones(len(u)) if w is None else w
    out = np.bincount(u, weights=w, minlength=n)
    lone = out == 0
    x = np.full(n, 1.0 / n)
    share = w / np.where(lone, 1.0, out)[u]
    for _ in range(most):
        new = alpha * (np.bincount(v, weights=x[u] * share, minlength=n) + x[lone].sum() * p) + (1 - alpha) * p
        if np.abs(new - x).sum() < n * tolerance:
            return new
        x = new
    raise RuntimeError(f"no convergence in {most} rounds")


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, graph: str = "graph_id", alpha: float = ALPHA, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS, weighted: bool = False, item: str | None = None, most_edges: int = MOST_EDGES) -> DataFrame:
    """graph, node, score to convergence. With ``item``, a column of ``seeds``, each item has ranks
    of its own from its own seeds, several on one graph, and the item comes along. Seeds that are no
    nodes are left out; graphs and items without a seed have no rows.

    A graph of up to ``most_edges`` edges is one group, which holds it once however many items it
    has; those over it take pagerank_steps(), which has no bound (unweighted ones only)."""
    one = [item] if item else []
    if not weighted:
        big = edges.groupBy(graph).agg(F.count("*").alias("e")).where(F.col("e") > most_edges).select(graph)
        if not big.isEmpty():
            big = saved(big, "large")
            part = lambda df, how: df.join(big, graph, how)
            small = _pagerank_groups(part(nodes, "left_anti"), part(edges, "left_anti"), part(seeds, "left_anti"), graph, alpha, tolerance, most, weighted, item)
            keyed = part(seeds, "left_semi").select(graph, *one).distinct()
            of = F.struct(graph, *one).alias("_key")
            large = pagerank_steps(
                part(nodes, "left_semi").join(keyed, graph).select(of, "node"), part(edges, "left_semi").join(keyed, graph).select(of, "a", "b"), part(seeds, "left_semi").select(of, "node"), most, alpha, "_key", tolerance)
            return small.unionByName(large.select("_key.*", "node", "score"))
    return _pagerank_groups(nodes, edges, seeds, graph, alpha, tolerance, most, weighted, item)


def _pagerank_groups(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, graph: str, alpha: float, tolerance: float, most: int, weighted: bool, item: str | None) -> DataFrame:
    kind = dict(nodes.dtypes)
    schema = ", ".join([f"{graph} {kind[graph]}", *([f"{item} {dict(seeds.dtypes)[item]}"] if item else []), f"node {kind['node']}, score double"])
    started = seeds.groupBy(graph, "node").agg(F.collect_set(item if item else F.lit(0)).alias("seed"))
    marked = nodes.select(graph, "node").distinct().join(started, [graph, "node"], "left")
    weight = F.col("weight").cast("double") if weighted else F.lit(1.0)
    sides = edges.select(F.col(graph).alias("side_graph"), F.col("a").alias("u"), F.col("b").alias("v"), weight.alias("w"))

    def solve(n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        by: dict = {}
        for i, items in enumerate(n.seed):
            for x in items if items is not None else ():
                by.setdefault(x, []).append(i)
        columns = [graph, *([item] if item else []), "node", "score"]
        if not by:
            return n[[graph, "node"]].iloc[:0].assign(score=0.0, **({item: None} if item else {}))[columns]
        place = pd.Index(n.node)
        a, b = place.get_indexer(e.u), place.get_indexer(e.v)
        ok = (a >= 0) & (b >= 0)
        a, b, w = a[ok], b[ok], e.w.to_numpy()[ok]
        loop = a == b
        u, v, w = np.concatenate([a, b[~loop]]), np.concatenate([b, a[~loop]]), np.concatenate([w, w[~loop]])
        out = []
        for x in sorted(by):
            p = np.zeros(len(n))
            p[by[x]] = 1.0 / len(by[x])
            out.append(pd.DataFrame({graph: n[graph], "node": n.node, "score": power_iteration(len(n), u, v, p, w, alpha, tolerance, most), **({item: x} if item else {})}))
        return pd.concat(out)[columns]

    return marked.groupBy(graph).cogroup(sides.groupBy("side_graph")).applyInPandas(solve, schema)


def cutoff(scores: DataFrame, least: int, most: int, by: list[str], node: str = "node") -> DataFrame:
    """by, node, score (-ln of the score), rank: the nodes before the largest gap of -ln(score)
    whose position lies in [least, most]; all if there are no more than ``least``."""
    w = Window.partitionBy(*by).orderBy("y", node)
    rows = scores.where("score > 0").withColumn("y", -F.ln("score"))
    rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("gap", F.col("y") - F.lag("y").over(w))
    pos = F.col("rank") - 1
    cut = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.min(F.when(pos.between(max(least, 1), most), F.struct((-F.col("gap")).alias("g"), pos.alias("i")))).alias("best"))
    keep = cut.select(*by, F.when(F.col("n") <= min(least, most), F.col("n")).otherwise(F.coalesce("best.i", F.lit(most))).alias("keep"))
    return rows.join(keep, by).where("rank <= keep").select(*by, node, F.col("y").alias("score"), "rank")


def fixed_top(scores: DataFrame, k: int, by: list[str], node: str = "node") -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), node)
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def two_sizes(scores: DataFrame, by: list[str], sizes=SIZES) -> DataFrame:
    """Cut-offs of both sizes over the same scores."""
    out = None
    for name, least, most in sizes:
        part = cutoff(scores, least, most, by).withColumn("size", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def subgraph_edges(selected: DataFrame, edges: DataFrame, by: list[str], full: bool, graph: list[str] | None = None) -> DataFrame:
    """by, node, target, weight: edges at a selected node; all of them, or those whose other end
    is selected too. ``graph``: the columns of ``by`` that edges have too, if not all: several items
    may have selected from one graph."""
    g = graph or by
    sides = edges.select(*g, F.col("a").alias("node"), F.col("b").alias("target"), "weight").unionByName(
        edges.where("a <> b").select(*g, F.col("b").alias("node"), F.col("a").alias("target"), "weight"))
    out = sides.join(selected.select(*by, "node").distinct(), [*g, "node"]).select(*by, "node", "target", "weight")
    return out if full else out.join(selected.select(*by, F.col("node").alias("target")), [*by, "target"], "left_semi").select(*out.columns)


def nested_edges(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, node and its edges as an array sorted by target."""
    return rows.groupBy(*by, "node").agg(F.array_sort(F.collect_list(F.struct("target", "weight"))).alias("edges"))


def prefer(augmented: DataFrame, base: DataFrame, graph: str = "graph_id") -> DataFrame:
    """The augmented version of a graph where there is one, else the base version."""
    return augmented.unionByName(base.join(augmented.select(graph).distinct(), graph, "left_anti"))
