import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.operators import alignment, chunking, graph, matching, propagation, records, stats, training, vectors


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


@pytest.mark.parametrize("text,size,overlap,expected", [
    ("w1 w2 w3 w4 w5 w6 w7", 4, 1, ["w1 w2 w3 w4", "w4 w5 w6 w7", "w7"]),
    ("a  b", 1, 0, ["a", "b"]),
    ("", 4, 1, []),
])
def test_word_windows(spark, text, size, overlap, expected):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [r.content for r in chunking.word_windows(df, size, overlap).orderBy("chunk_ord").collect()] == expected


def test_token_windows(spark):
    df = spark.createDataFrame([(1, "x " * 510), (2, "x " * 1100), (3, " ")], "doc_id long, text string")
    assert rows(chunking.token_windows(df), "doc_id", "start", "tokens") == [(1, 0, 510), (1, 500, 10), (2, 0, 512), (2, 500, 512), (2, 1000, 100)]
    with pytest.raises(ValueError):
        chunking.token_windows(df, 4, 4)


def test_sentences(spark):
    df = spark.createDataFrame([(1, "One. Two! Three? Four.")], "doc_id long, text string")
    assert [r.content for r in chunking.sentence_windows(df, 2, 1).orderBy("chunk_ord").collect()] == ["One. Two!", "Two! Three?", "Three? Four.", "Four."]


def test_context(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "doc_id long, text string")
    assert rows(chunking.context_map(df), "doc_index", "rep_index") == [(1, 1), (2, 2), (3, 1)]
    assert rows(chunking.representatives(df), "doc_id") == [(1,), (2,)]


def test_records_and_graph(spark):
    text = '("entity"<|>"Ann"<|>"person"<|>"d1")##("entity"<|>"Ann"<|>"place"<|>"d2")##("relationship"<|>"Bob"<|>"Ann"<|>"r"<|>"k"<|>9)##("relationship"<|>"Ann"<|>"Bob"<|>"s"<|>"k"<|>"9")<|COMPLETE|>(bad'
    df = spark.createDataFrame([(7, 0, text)], "graph_id long, chunk_ord long, records string")
    parsed = records.records(df, ["graph_id", "chunk_ord"])
    m, r = records.mentions(parsed, ["graph_id", "chunk_ord"], "chunk_ord"), records.relations(parsed, ["graph_id", "chunk_ord"], "chunk_ord")
    assert rows(m, "entity_name", "entity_type") == [('"ANN"', '"PERSON"'), ('"ANN"', '"PLACE"')]
    assert rows(r, "src_id", "tgt_id", "weight") == [('"ANN"', '"BOB"', 1.0), ('"BOB"', '"ANN"', 9.0)]
    nodes, edges = graph.build(m, r, ["chunk_ord", "rec_ord"])
    assert rows(nodes, "entity_name", "entity_type") == [('"ANN"', '"PERSON"'), ('"BOB"', '"UNKNOWN"')]
    assert rows(edges, "a", "b", "weight") == [('"ANN"', '"BOB"', 10.0)]
    empty = graph.build(m.limit(0), r, ["chunk_ord", "rec_ord"])
    assert empty[0].count() == empty[1].count() == 0
    mixed = graph.merge_nodes(m.orderBy(F.rand(1)), ["chunk_ord", "rec_ord"])
    assert rows(mixed, "entity_name", "entity_type") == [('"ANN"', '"PERSON"')]


def _graph(spark, edges, nodes):
    e = spark.createDataFrame([(1, min(a, b), max(a, b), 1.0) for a, b in edges], "graph_id long, a string, b string, weight double")
    return spark.createDataFrame([(1, n) for n in nodes], "graph_id long, node string"), e


@pytest.mark.parametrize("edges,nodes,expected", [
    (["AB", "BC", "AC"], "ABC", {"A": 0.403541, "B": 0.298230, "C": 0.298230}),
    (["AB", "BC"], "ABCD", {"A": 0.345228, "B": 0.459544, "C": 0.195228, "D": 0.0}),
])
def test_pagerank(spark, edges, nodes, expected):
    n, e = _graph(spark, edges, nodes)
    seeds = spark.createDataFrame([(1, "A"), (1, "nobody"), (2, "A")], "graph_id long, node string")
    got = {r.node: r.score for r in propagation.pagerank(n, e, seeds).collect()}
    assert got.keys() == expected.keys() and abs(sum(got.values()) - 1) < 1e-9
    for k, v in expected.items():
        assert got[k] == pytest.approx(v, abs=1e-6)


def test_pagerank_steps_match_the_solver(spark):
    n, e = _graph(spark, ["AB", "BC", "AC", "CD"], "ABCDE")
    seeds = spark.createDataFrame([(1, "A")], "graph_id long, node string")
    got = {r.node: r.score for r in propagation.pagerank_steps(n, e, seeds, 60).collect()}
    want = {r.node: r.score for r in propagation.pagerank(n, e, seeds, tolerance=1e-12, most=1000).collect()}
    assert got == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("least,most,expected", [(3, 10000, "abcd"), (3, 3, "abc"), (1, 2, "a"), (5, 50, "abcde")])
def test_cutoff(spark, least, most, expected):
    df = spark.createDataFrame([(1, n, s) for n, s in zip("abcdefz", [0.40, 0.20, 0.18, 0.17, 0.03, 0.02, 0.0])], "g long, node string, score double")
    out = propagation.cutoff(df, least, most, ["g"]).orderBy("rank").collect()
    assert "".join(r.node for r in out) == expected
    assert out[0].score == pytest.approx(-math.log(0.4))


def test_alignment(spark):
    data = [(1, i, f, -2.0, p, n, "c") for i, (f, p, n) in enumerate([(-1.0, 0.9, 12), (-2.0, 0.5, 5), (-3.0, 0.1, 10)])] + [(2, 0, float("-inf"), None, 1.0, 20, "c"), (2, 1, -1.0, None, 3.0, 20, "c")]
    df = spark.createDataFrame(data, "item long, ord long, forward double, backward double, parameter double, tokens long, content string")
    out = {(r.item, r.ord): r for r in alignment.scores(df, ["item"]).collect()}
    assert [out[1, i].score for i in range(3)] == pytest.approx([2.15, 0.575, 0.15])
    assert out[2, 0].forward is None and out[2, 0].backward is None and out[2, 0].parameter == 0.0
    ranked = alignment.ranks(alignment.scores(df, ["item"]), ["item"], "ord")
    lists = {r.item: r for r in alignment.rank_lists(ranked, ["item"], "ord", 2).collect()}
    assert lists[1].forward_rank == [0, 1]


def test_negatives(spark):
    pool = spark.createDataFrame([(1, i, f"c{i % 7}") for i in range(20)], "item long, ord long, content string")
    pos = spark.createDataFrame([(1, 1, "c0"), (1, 2, "c1")], "item long, pos_rank long, content string")
    items = spark.createDataFrame([(1, "q"), (2, "none")], "item long, query string")
    made = training.stage(1, items, pos, pool, pool, pool, "item", 5).collect()
    assert len(made) == 2
    for r in made:
        negatives = [n[0].content for n in r.negative_messages]
        assert len(negatives) == 5 and not set(negatives) & {"c0", "c1"}
    again = training.stage(1, items, pos, pool.orderBy(F.rand(3)), pool, pool, "item", 5).collect()
    assert sorted(map(str, made)) == sorted(map(str, again))


def test_vectors(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    pairs = {(r.a, r.b): r.weight for r in vectors.similar_pairs(df, 0.4, block=7).collect()}
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.4}
    assert set(pairs) == want and all(abs(pairs[k] - s[k]) < 1e-12 for k in want)
    q = df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r.query_id, r["rank"]): r.vec_id for r in vectors.top_k(df, q, 3, block=2).collect()}
    for i in range(5):
        assert [got[i, k] for k in (1, 2, 3)] == np.argsort(-s[i], kind="stable")[:3].tolist()
    assert vectors.top_k(df, q.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        vectors.checked_threshold(1.5, 0.8)
    assert vectors.checked_threshold(0.0, 0.8) == 0.8


def test_components_and_statistics(spark):
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y")]
    n, e = _graph(spark, edges, "abcxyz")
    nodes = n.withColumnRenamed("node", "entity_name")
    labels = {r.entity_name: r.component for r in graph.component_labels(nodes, e).collect()}
    assert labels == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "z"}
    s = stats.component_stats(graph.component_labels(nodes, e)).first()
    assert (s["count"], s.largest, s.smallest, s.top_sizes) == (3, 3, 1, "3,2,1")
    assert rows(graph.largest_component(nodes, e)[0], "entity_name") == [("a",), ("b",), ("c",)]
    c = stats.clustering(nodes, e).first()
    assert (c.nodes, c.edges, c.density, c.avg_clustering) == (6, 4, round(8 / 30, 6), 0.5)
    chain = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)]
    n2, e2 = _graph(spark, chain, [f"n{i:03d}" for i in range(41)])
    assert graph.component_labels(n2.withColumnRenamed("node", "entity_name"), e2).select("component").distinct().count() == 1
    n3, e3 = _graph(spark, chain[:6], [f"n{i:03d}" for i in range(7)])
    p = stats.paths(n3.withColumnRenamed("node", "entity_name"), e3).first()
    assert p.diameter == 6 and p.avg_path == pytest.approx(8 / 3, abs=1e-6)


def test_matching(spark):
    ents = spark.createDataFrame([(1, 0, '"ann lee"'), (2, 0, "lee corp"), (3, 0, "zzz")], "item_id long, ent_ord long, entity string")
    nodes = spark.createDataFrame([('"ANN LEE"',), ('"LEE INC"',), ("OTHER",)], "entity_name string")
    exact = matching.exact(ents, nodes)
    assert rows(exact, "item_id", "entity_name") == [(1, '"ANN LEE"')]
    assert rows(matching.by_tokens(ents, nodes.withColumn("entity_name", F.btrim("entity_name", F.lit('"'))), exact)) == [(2, "ANN LEE"), (2, "LEE INC")]
    with pytest.raises(ValueError):
        matching.dispatch("other")


def test_coverage_and_usage(spark):
    items = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "item_id long, entity string")
    cov = stats.coverage(items, spark.createDataFrame([("a",)], "entity_name string"))
    assert rows(cov, "item_id", "num_entities", "num_matched", "coverage", "has_match") == [(1, 3, 2, 0.666667, True), (2, 1, 0, 0.0, False)]
    s = stats.coverage_summary(cov).first()
    assert s.hit_rate == 0.5 and s.zero_match_count == 1
    calls = spark.createDataFrame([(1, "x", "m", 10, 1), (1, "y", "other", 20, 2)], "doc_id long, operation string, model string, input_tokens long, output_tokens long")
    use = stats.usage(calls)
    assert use.where("doc_id IS NULL").first().total_tokens == 33
    prices = spark.sql("SELECT 'm' AS model, 0.5BD AS input_price, 1.0BD AS output_price")
    assert float(stats.cost(calls, prices, "m").agg(F.sum("cost")).first()[0]) == 10 * 0.5 + 1 + 20 * 0.5 + 2
    more = stats.usage(calls.unionByName(calls))
    assert stats.usage_between(more, use, ["doc_id", "operation"]).where("doc_id IS NULL").first().calls == 2


def _walked(edges):
    """Diameter and mean path length by walks from every node."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = []
    for s in near:
        seen, ring = {s: 0}, [s]
        while ring:
            ring = [v for u in ring for v in near[u] if v not in seen and not seen.update({v: seen[u] + 1})]
        found += [d for v, d in seen.items() if v != s]
    return max(found), sum(found) / len(found)


def test_paths_of_trees_and_cycles_with_tails(spark):
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)]
    tails = [("r0", "t1"), ("t1", "t2"), ("t2", "t3"), ("r3", "u1"), ("u1", "u2"), ("u1", "u3"), ("r3", "w1")]
    tree = [(f"n{i:02d}", f"n{(i - 1) // 2:02d}") for i in range(1, 20)]
    graphs = [ring + tails, tree, [("a", "b")], [("a", "b"), ("b", "c"), ("c", "c")]]
    e = spark.createDataFrame([(i, *x) for i, edges in enumerate(graphs) for x in edges], "graph_id long, a string, b string")
    nodes = e.select("graph_id", F.explode(F.array("a", "b")).alias("entity_name")).distinct()
    got = {p.graph_id: p for p in stats.paths(nodes, e).collect()}
    for i, edges in enumerate(graphs):
        far, mean = _walked([x for x in edges if x[0] != x[1]])
        assert got[i].diameter == far and got[i].avg_path == pytest.approx(mean, abs=1e-6)


def test_paths_of_a_graph_of_over_5000_nodes(spark):
    e = spark.range(6000).select(F.lit(1).alias("graph_id"), F.lit("hub").alias("a"), F.concat(F.lit("leaf"), "id").alias("b"))
    nodes = e.select("graph_id", F.explode(F.array("a", "b")).alias("entity_name")).distinct()
    p = stats.paths(nodes, e).first()
    assert p is not None and p.diameter == 2 and p.avg_path == pytest.approx((6000 * 5999 * 2 + 12000) / (6001 * 6000), abs=1e-6)


def test_paths_have_no_bound_on_rounds(spark, monkeypatch):
    """Were walks and folding counted by a range, it would end after three rounds here: a path through 21 nodes
    takes 10 to fold, a ring of 10 five to walk."""
    monkeypatch.setattr(stats, "range", lambda *a: range(a[0], min(a[1], 4)) if len(a) > 1 else range(min(a[0], 3)), raising=False)
    line, ring = [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)], [(f"r{i}", f"r{(i + 1) % 10}") for i in range(10)]
    e = spark.createDataFrame([(i, *x) for i, edges in enumerate((line, ring)) for x in edges], "graph_id long, a string, b string")
    nodes = e.select("graph_id", F.explode(F.array("a", "b")).alias("entity_name")).distinct()
    got = {p.graph_id: (p.diameter, p.avg_path) for p in stats.paths(nodes, e).collect()}
    assert got == {0: (20, pytest.approx(_walked(line)[1], abs=1e-6)), 1: (5, pytest.approx(_walked(ring)[1], abs=1e-6))}


def _two_graphs(spark, n=150):
    m = np.random.default_rng(4).normal(size=(n, 6))
    m[:20] = m[0] + 0.05 * m[:20]
    return spark.createDataFrame([(i, i % 2, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, label int, embedding array<double>")


def test_augment_makes_similar_pairs_once_and_joins_none(spark, tmp_path):
    from lodestone.plans import catalogue

    m = np.random.default_rng(9).normal(size=(60, 5))
    m[30:35] = m[:5]
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, 0, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, label int, embedding array<double>")
    ends = [(i, j) for i in range(70) for j in range(i, 70, 3)] + [(9, 3), (3, 900)]
    e = spark.createDataFrame([(a, b, 2.0, 1, "explicit", "s") for a, b in ends], "a long, b long, weight double, order long, description string, source_id string")
    # 0.3, and cosines that vectors have to the last bit or nearly
    for theta in (0.3, float(u[3] @ u[24]), float((u[3] * u[24]).sum()), float(u[2] @ u[32]), 1.0):
        got = [(r.a, r.b, r.order) for r in vectors.augment(e, df, theta).collect()]
        pairs = {(r.a, r.b) for r in vectors.similar_pairs(df, theta).collect()}
        assert len(got) == len(set(got)) and {x[:2] for x in got if x[2] == 0} == pairs
        assert {x[:2] for x in got if x[2] == 1} == set(ends) - pairs and set(ends) & pairs
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(a, b, 1.0) for a, b in ends], "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    for name in ("augment_overwrite", "augment_stats"):
        plan = catalogue.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("FlatMapGroupsInArrow") == 1, plan


def test_clustering_of_similar_vectors_without_their_edges(spark):
    from lodestone.operators import similarity

    df = _two_graphs(spark)
    nodes = df.select("label", F.col("vec_id").alias("entity_name"))
    want = stats.clustering(nodes, vectors.similar_pairs(df, 0.5, graph="label"), "label")
    assert rows(similarity.clustering(df, 0.5, "label"), *want.columns) == rows(want, *want.columns)
    got = similarity.local_counts(df, 0.5, "label", block=13)
    assert rows(got, "vec_id", "degree", "triangles") == rows(similarity.local_counts(df, 0.5, "label"), "vec_id", "degree", "triangles")


@pytest.mark.parametrize("tolerance", [1e-4, None])
def test_ranks_of_similar_vectors_without_their_edges(spark, tolerance):
    from lodestone.operators import similarity

    df = _two_graphs(spark)
    seeds = spark.createDataFrame([(0, 0), (0, 30), (1, 1)], "label int, node long")
    edges, nodes = vectors.similar_pairs(df, 0.5, graph="label"), df.select("label", F.col("vec_id").alias("node"))
    want = propagation.pagerank(nodes, edges, seeds, "label") if tolerance else propagation.pagerank_steps(nodes, edges, seeds, 4, graph="label")
    want = {(r.label, r.node): r.score for r in want.collect()}
    for block in (17, 1000):
        got = {(r.label, r.node): r.score for r in similarity.pagerank(df, seeds, 0.5, "label", tolerance=tolerance, rounds=4 if tolerance is None else 100, block=block).collect()}
        assert got == pytest.approx(want, abs=1e-12)
    assert similarity.pagerank(df, seeds.where("node < 0"), 0.5, "label").isEmpty()


def test_spanning_edges_join_the_same_nodes(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = [(g, *sorted(f"n{x:03d}" for x in rng.integers(0, 80, 2) // 4 * 4 + g)) for g in (0, 1) for _ in range(900)] + [(0, "x", "x"), (1, "y", "z")]
    e = spark.createDataFrame(pairs, "graph_id long, a string, b string").coalesce(1)
    few = [(r.graph_id, r.a, r.b) for r in graph.spanning(e).collect()]
    assert len(few) == 2 * 19 + 1 and ("x" not in {x for r in few for x in r[1:]})
    chain = graph._forest(pd.DataFrame({"g": 1, "a": range(1, 200), "b": range(0, 199)}).sample(frac=1, random_state=1))
    assert len(chain) == 199 and chain.a.nunique() == 1
