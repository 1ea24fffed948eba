import json

from lodestone.__main__ import main


def test_commands(spark, tmp_path):
    shared = "Ann met Bob. Bob met Cleo. Dora saw Ann and Bob. Cleo sings. Dora sleeps."
    rows = [{"input": "who met Bob", "answers": ["Ann"], "context": shared}, {"question": "where is Eve", "answer": "Rome", "context": "Eve is in Rome. Rome is old."}, {"input": "who sings", "answers": ["Cleo"], "context": shared}]
    (tmp_path / "in.jsonl").write_text("\n".join(json.dumps(r) for r in rows))
    (tmp_path / "c.yaml").write_text("chunking: {method: sentence, size: 1, overlap: 0}\nalignment: {top_k: 1}\ntraining: {positives: 1, negatives: 2}\n")
    go = lambda *a: main([str(x) for x in a], spark)
    go("graph", "--input", tmp_path / "in.jsonl", "--output", tmp_path / "g", "--threshold", 0.1)
    assert spark.read.parquet(str(tmp_path / "g" / "augmented" / "edges")).count() > 0
    assert spark.read.parquet(str(tmp_path / "g" / "usage")).where("graph_id IS NULL").first().calls == 2
    spark.createDataFrame([(0, "Ann"), (1, "Rome"), (2, "Cleo"), (2, "Eve")], "doc_index long, entity string").write.parquet(str(tmp_path / "ents"))
    go("community", "--graph", tmp_path / "g", "--entities", tmp_path / "ents", "--output", tmp_path / "c")
    small = spark.read.parquet(str(tmp_path / "c" / "subgraph_small"))
    assert {(r.doc_index, r.graph_id) for r in small.collect()} == {(0, 0), (1, 1), (2, 0)}
    # items that share a context have seeds of their own
    assert {r.doc_index: r.node for r in small.where("rank = 1").collect()}[0] != {r.doc_index: r.node for r in small.where("rank = 1").collect()}[2]
    go("community", "--graph", tmp_path / "g", "--input", tmp_path / "in.jsonl", "--output", tmp_path / "c2")
    assert spark.read.parquet(str(tmp_path / "c2" / "full_large")).select("doc_index").distinct().count() == 3
    go("positives", "--input", tmp_path / "in.jsonl", "--output", tmp_path / "p", "--config", tmp_path / "c.yaml")
    assert spark.read.parquet(str(tmp_path / "p" / "full")).count() == 12
    go("queries", "--input", tmp_path / "in.jsonl", "--subgraphs", tmp_path / "c", "--output", tmp_path / "q", "--number", 3)
    asked = spark.read.parquet(str(tmp_path / "q"))
    assert {(r.doc_index, r.size) for r in asked.collect()} == {(i, s) for i in range(3) for s in ("large", "small")} and asked.where("query_ord > 2").count() == 0
    go("matching", "--ranked", tmp_path / "p", "--queries", tmp_path / "q", "--output", tmp_path / "m", "--top_k", 2)
    found, top = spark.read.parquet(str(tmp_path / "m")), spark.read.parquet(str(tmp_path / "p" / "top"))
    assert found.count() and found.join(top, ["doc_index", "content"]).count() == 0
    for stage in (1, 2, 3):
        go("negatives", "--input", tmp_path / "in.jsonl", "--ranked", tmp_path / "p", "--matched", tmp_path / "m", "--stage", stage, "--output", tmp_path / f"n{stage}", "--config", tmp_path / "c.yaml")
        made = spark.read.json(str(tmp_path / f"n{stage}")).collect()
        assert made and all(r.negative_messages and len(r.negative_messages) <= 2 for r in made)
    for kind in ("hybrid", "dense"):
        go("infer", "--input", tmp_path / "in.jsonl", "--retriever", kind, "--output", tmp_path / kind)
        assert spark.read.json(str(tmp_path / kind / "raw" / "full")).count() == 3
    run = lambda k: tmp_path / k / "raw" / "full" / "dataset=data" / f"model={k}"
    go("pairwise", "--model1", run("hybrid"), "--model2", run("dense"), "--output", tmp_path / "w")
    assert spark.read.json(str(tmp_path / "w" / "summary")).first().total_samples == spark.read.json(str(tmp_path / "w" / "details")).count() > 0
    go("stats", "--graph", tmp_path / "g" / "base", "--output", tmp_path / "s")
    all_ = spark.read.parquet(str(tmp_path / "s" / "all")).first()
    assert all_.graphs == 2 and all_.power_law_total_tested == 0
    go("coverage", "--graph", tmp_path / "g", "--entities", tmp_path / "ents", "--output", tmp_path / "v")
    per = {r.doc_index: r.coverage for r in spark.read.parquet(str(tmp_path / "v" / "items")).collect()}
    assert per == {0: 1.0, 1: 1.0, 2: 0.5}  # Eve is a node of another item's graph
    (tmp_path / "j.jsonl").write_text('{"verdict": "Answer 1"}\n{"verdict": "Answer 2"}\n{"verdict": "no"}')
    go("pairwise", "--input", tmp_path / "j.jsonl", "--output", tmp_path / "w2")
    assert spark.read.json(str(tmp_path / "w2")).first().ties == 1
