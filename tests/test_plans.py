import pytest
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.models import Failing, HashedWords, OverlapProxy, RuleExtractor, complete, encode, log_prob, with_retries
from lodestone.plans import inference
from lodestone.plans.corpus_graph import CorpusGraph
from lodestone.streaming import usage


def test_corpus_graph(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ann met Bob. Bob met Cleo."), (2, "Ann met Bob. Bob met Cleo."), (3, "Dora knows Ann")], "doc_id long, text string")
    g = CorpusGraph.from_documents(docs, RuleExtractor(), config.load({"chunking": {"size": 64, "overlap": "8"}}))
    assert {r.graph_id for r in g.nodes.collect()} == {1, 3}
    names = {r.entity_name for r in g.nodes.where("graph_id = 1").collect()}
    assert {'"ANN"', '"BOB"', '"CLEO"'} <= names
    g = g.embed(HashedWords(16))
    augmented, counts = g.augment(0.05)
    assert counts.where("edges_added > 0").count() >= 1
    assert g.augment(enabled=False)[1] is None
    seeds = g.match(spark.createDataFrame([(1, 0, "ann"), (3, 0, "dora x")], "graph_id long, ent_ord long, entity string"))
    assert {(r.graph_id, r.entity_name) for r in seeds.collect()} == {(1, '"ANN"')} or seeds.count() == 2
    sub = g.subgraph(seeds, adaptive=False, top_k=2)
    assert sub.where("graph_id = 1").count() == 2
    augmented.save(str(tmp_path / "g"))
    back = CorpusGraph.load(spark, str(tmp_path / "g"))
    assert back.stats().where("graph_id = 1").first().has_index
    assert back.edges.count() == augmented.edges.count()


def test_models(spark):
    df = spark.createDataFrame([("Ann met Bob", "met bob")], "prompt string, target string")
    assert '"entity"' in complete(df, "prompt", "out", RuleExtractor()).first().out
    assert len(encode(df, "prompt", "v", HashedWords(8)).first().v) == 8
    assert log_prob(df, "prompt", "target", "p", OverlapProxy()).first().p == 0.0
    seen = []

    def flaky(items):
        seen.append(1)
        if len(seen) < 2:
            raise OSError("busy")
        return items

    assert with_retries(flaky, wait=0)(["a"]) == ["a"]
    with pytest.raises(Failing):
        with_retries(lambda items: 1 / 0, tries=2, wait=0)(["a"])


def test_inference(spark):
    items = spark.createDataFrame([(1, "where is ann", ["paris"])], "doc_index long, question string, truths array<string>")
    chunks = spark.createDataFrame([(1, 0, "ann is in paris"), (1, 1, "bob sleeps"), (2, 0, "other")], "doc_index long, chunk_ord long, content string")
    for kind in ("dense", "hybrid"):
        hits = inference.retrieve(items, chunks, kind, HashedWords(64), 1)
        assert [r.content for r in hits.collect()] == ["ann is in paris"]
    assert inference.retrieve(items, chunks, "none").count() == 2
    with pytest.raises(ValueError):
        inference.retrieve(items, chunks, "other")

    class Echo:
        def complete(self, prompts):
            return ["paris" if "paris" in p else "no" for p in prompts]

    got = inference.answer(items, hits, Echo()).first()
    assert got.f1 == 1.0 and got.num_chunks_used == 1


def test_config():
    c = config.load("pagerank:\n  tolerance: 1e-4\n  large: ['20', 50]\n", {"training": {"negatives": 5}})
    assert c.pagerank.tolerance == 1e-4 and c.pagerank.large == (20, 50) and c.training.negatives == 5
    with pytest.raises(KeyError):
        config.load({"other": 1})


def test_streaming_usage(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", i % 3, "op", 10, 1) for i in range(120)]
    static = spark.createDataFrame(rows, "id long, t string, doc_id long, operation string, input_tokens long, output_tokens long").withColumn("ts", F.to_timestamp("t")).drop("t")
    static.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "in"))
    out = usage.windowed_usage(usage.new_calls(stream, "id"), width="30 minutes", late=None)
    q = out.writeStream.format("memory").queryName("usage").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = sorted(tuple(r) for r in spark.table("usage").collect())
    finally:
        q.stop()
    want = sorted(tuple(r) for r in usage.windowed_usage(static, width="30 minutes").collect())
    assert got == want and sum(r[2] for r in want) == 120
    assert usage.sessions(static, gap="2 minutes").agg(F.sum("calls")).first()[0] == 120
