"""Tokens, model calls, mining, loaders and hooks on small inputs."""

import json
import os
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.functions import arrow, models, tokens
from lodestone.functions import text as t
from lodestone.operators import chunking, evaluation, graph, matching, propagation
from lodestone.plans import mining
from lodestone.sources import readers, writers

BPE = "/opt/tokenizers/byte_bpe_50k.json"


@pytest.mark.skipif(not os.path.isfile(BPE), reason="no tokenizer file")
def test_byte_pair_windows(spark):
    texts = ["", None, "short", " ".join(f"word{i} é漢字" for i in range(300)), "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.chunk_ord, r.start, r.tokens, r.content) for r in chunking.token_windows(df, 64, 8, tokenizer=BPE).collect())
    made, want = tokens.load(BPE), []
    for i, text in enumerate(texts):
        ids = made.encode(text or "", add_special_tokens=False).ids
        want += [(i, n, s, min(64, len(ids) - s), made.decode(ids[s : s + 64], skip_special_tokens=False).strip()) for n, s in enumerate(range(0, len(ids), 56))]
    assert got == want and len(want) > 20
    n = {r.doc_id: r.n for r in df.select("doc_id", tokens.token_count(BPE)(F.col("text")).alias("n")).collect()}
    assert n[0] == 0 and n[1] is None and n[3] == len(made.encode(texts[3]).ids)
    assert df.select(tokens.message_tokens(BPE)(F.array(F.lit("short"), F.lit("word"))).alias("n")).first().n == 2 + 8 + sum(len(made.encode(x).ids) for x in ("short", "word"))
    with pytest.raises(ValueError):
        tokens.windows(BPE, 8, 8)
    pieces = arrow.split_long("\n\n".join(["a b c d e f g h"] * 40), 64, 30, tokens.counter(BPE))
    assert "".join(pieces) == "\n\n".join(["a b c d e f g h"] * 40) and len(pieces) > 3


def test_split_long_by_its_rule():
    part = lambda n: " ".join(["w"] * n)
    text = part(100) + "\n\n" + part(150) + "\n------------\n" + part(300) + "\n\n\n" + part(10) + "\n\n" + part(5)
    pieces = arrow.split_long(text, 256, 30)
    assert "".join(pieces) == text
    assert [len(p.split()) for p in pieces] == [251, 300, 15]  # the rule counts as a word; a stretch without a cut stays whole


def test_one_read_gives_the_f1_of_counts(spark):
    r = np.random.default_rng(1)
    rows = [(i, [f"t{x}" for x in r.integers(0, 9, r.integers(0, 12))], [f"t{x}" for x in r.integers(0, 9, r.integers(0, 12))]) for i in range(200)]
    df = spark.createDataFrame(rows, "i long, p array<string>, g array<string>")
    for x in df.select("i", "p", "g", t.token_f1(F.col("p"), F.col("g")).alias("f1")).collect():
        same = sum(min(x.p.count(w), x.g.count(w)) for w in set(x.p))
        assert x.f1 == pytest.approx(2 * same / (len(x.p) + len(x.g)) if same else 0.0)


def test_full_width_text(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(t.normalize_zh(F.lit("你好，世界！（x）　『Ａ』。a.b…"))) == "你好世界xａab"
    assert one(t.normalize_zh(F.lit("ａ．ｂ ‘c’"))) == "ａ．ｂ‘c’"  # neither is in the fixed list
    assert one(t.qa_f1_zh(F.lit("在罗马！"), F.lit("罗马。"))) == pytest.approx(0.8)
    assert one(t.qa_f1_zh(F.lit("in rome"), F.lit("Rome ！"), t.words)) == pytest.approx(2 / 3)


def test_model_calls(spark):
    class Slow:
        tries = 0

        def complete(self, prompts):
            Slow.tries += 1
            if Slow.tries == 1:
                time.sleep(1.0)
            return prompts

    assert models.with_retries(Slow().complete, wait=0, timeout=0.3)(["a", "b"]) == ["a", "b"]
    df = spark.createDataFrame([("one two three",), ("four",)], "prompt string")
    used = {r.prompt: r.u for r in models.complete(df, "prompt", "a", models.CapitalNames(), usage="u").collect()}
    assert (used["four"].model, used["four"].input_tokens, used["one two three"].input_tokens) == ("CapitalNames", 1, 4)

    class Picky:
        def score(self, prompts, targets):
            if any("bad" in p for p in prompts):
                raise ValueError
            return [float(len(p.split())) for p in prompts]

    rows = spark.createDataFrame([("a b c d", "x"), ("bad", "x"), ("a", "x y")], "p string, t string")
    assert [r.s for r in models.log_prob(rows, "p", "t", "s", Picky(), 3).collect()] == [2.0, float("-inf"), 1.0]


def test_mining(spark):
    items = spark.createDataFrame([(1, "who is Ann", "Ann"), (2, "where is Bob", "Rome")], "doc_index long, question string, answer string")
    chunks = spark.createDataFrame([(1, 0, "Ann is who"), (1, 1, "nothing of it"), (2, 0, "Bob is in Rome"), (9, 0, "no item")], "doc_index long, chunk_ord long, content string")
    got = mining.item_scores(items, chunks, models.OverlapProxy(), models.HashedWords()).collect()
    best = {r.doc_index: r.chunk_ord for r in got if r.score == max(x.score for x in got if x.doc_index == r.doc_index)}
    assert len(got) == 3 and best == {1: 0, 2: 0}
    names = mining.named_entities(items.withColumn("text", F.concat_ws(" ", "question", "answer")), models.CapitalNames())
    assert {(r.doc_index, r.entity) for r in names.collect()} == {(1, "ANN"), (2, "BOB"), (2, "ROME")}
    own = mining.named_entities(items, None, text="question", extract=lambda c: F.slice(t.words(c), -1, 1))
    assert {(r.doc_index, r.entity) for r in own.collect()} == {(1, "Ann"), (2, "Bob")}
    sub = spark.createDataFrame([(1, "large", '"ANN"', 1, '"NAME"', ["d"]), (1, "large", '"EVE"', 2, '"NAME"', ["d", "e"]), (2, "small", '"BOB"', 1, '"NAME"', ["d"])],
                                "doc_index long, size string, node string, rank long, entity_type string, descriptions array<string>")
    asked = mining.confusing_queries(items, sub, models.Paraphrases(), 1)
    assert {(r.doc_index, r.size, r.query) for r in asked.collect()} == {(1, "large", "who is Ann ANN"), (2, "small", "where is Bob BOB")}

    class Mute:
        def complete(self, prompts):
            return ["no JSON"] * len(prompts)

    assert mining.confusing_queries(items, sub, Mute(), 1).count() == 0
    found = mining.matched_chunks(asked, chunks, chunks.where("doc_index = 1 AND chunk_ord = 0"), models.HashedWords(), 2)
    assert {(r.doc_index, r.content) for r in found.collect()} == {(1, "nothing of it"), (2, "Bob is in Rome")}
    runs = [spark.createDataFrame([(i, "q", "Rome", p) for i, p in enumerate(ps)], "doc_index long, question string, answer string, prediction string") for ps in (["Rome", "x", "ab", "z"], ["no idea", "Rome", "cd"])]
    won = mining.judged(*runs, models.LengthJudge()).orderBy("doc_index").collect()
    assert [r.winner for r in won] == ["Answer 1", "Answer 2", "Tie"]
    assert evaluation.pairwise_summary(evaluation.winners(mining.judged(*runs, Mute()), "winner").withColumn("k", F.lit(1)), ["k"]).first().ties == 3


def test_items_of_one_graph(spark):
    nodes = spark.createDataFrame([(0, x) for x in "ABCDE"] + [(1, "A")], "graph_id long, entity_name string")
    seeds = [(10, 0, 0, "a"), (11, 0, 0, "e"), (12, 1, 0, "b x"), (13, 0, 0, "b x")]
    ents = spark.createDataFrame(seeds, "doc_index long, graph_id long, ent_ord long, entity string")
    exact = matching.exact(ents, nodes, "doc_index", "graph_id")
    near = matching.by_tokens(ents, nodes, exact, 5, "doc_index", "graph_id")
    assert {(r.doc_index, r.entity_name) for r in exact.collect()} == {(10, "A"), (11, "E")}
    assert {(r.doc_index, r.graph_id, r.entity_name) for r in near.collect()} == {(13, 0, "B")}
    edges = spark.createDataFrame([(0, "A", "B", 1.0), (0, "B", "C", 1.0), (0, "C", "D", 1.0), (0, "D", "E", 1.0)], "graph_id long, a string, b string, weight double")
    rows = nodes.withColumnRenamed("entity_name", "node")
    start = exact.select("doc_index", "graph_id", F.col("entity_name").alias("node"))
    got = {(r.doc_index, r.node): r.score for r in propagation.pagerank(rows, edges, start, item="doc_index").collect()}
    by_joins = {(r.doc_index, r.node): r.score for r in propagation.pagerank(rows, edges, start, item="doc_index", most_edges=1).collect()}
    assert len(got) == 10 and got[10, "A"] > got[11, "A"] and by_joins == pytest.approx(got)
    alone = {r.node: r.score for r in propagation.pagerank(rows, edges, start.where("doc_index = 10").drop("doc_index")).collect()}
    assert alone == pytest.approx({k[1]: v for k, v in got.items() if k[0] == 10})
    with pytest.raises(Exception, match="no convergence"):
        propagation.pagerank_steps(rows, edges, start.drop("doc_index"), 2, tolerance=1e-9)


def test_running_mean_over_a_run(spark):
    rows = [(i * 3, None if i % 7 == 0 else i / 2) for i in range(95)]
    got = evaluation.running_mean_of_all(spark.createDataFrame(rows, "i long, v double"), "v", "i", ranges=5).orderBy("i").collect()
    want = [(rows[n - 1][0], n, round(sum(v or 0 for _, v in rows[:n]) / n, 4)) for n in [*range(10, 95, 10), 95]]
    assert [(r.i, r.position, r.running) for r in got] == want


def test_loaders_and_stores(spark, tmp_path):
    for i in (3, 4):
        (tmp_path / f"c_{i}.json").write_text(json.dumps({"chunk_list": [f"a{i}", "b"]}))
        (tmp_path / f"q_{i}.json").write_text(json.dumps([f"q{i}", "r"]))
    (tmp_path / "q_5.json").write_text("[]")
    assert {(r.doc_index, r.chunk_ord, r.content) for r in readers.read_chunks(spark, str(tmp_path / "c_*.json")).collect()} == {(3, 0, "a3"), (3, 1, "b"), (4, 0, "a4"), (4, 1, "b")}
    assert {(r.doc_index, r.query) for r in readers.read_queries(spark, str(tmp_path / "q_*.json")).collect()} == {(3, "q3"), (3, "r"), (4, "q4"), (4, "r")}
    assert readers.read_matched(spark, str(tmp_path / "q_*.json")).columns == ["doc_index", "chunk_ord", "content"]
    v = spark.createDataFrame([("x", "X", [1.0, 2.0]), ("y", None, [3.0, 4.0]), ("z", "Z", [5.0, 6.0])], "id string, entity_name string, embedding array<float>")
    writers.write_vector_store(v, str(tmp_path / "store"), stores=2)
    assert sorted(readers.read_vector_store(spark, str(tmp_path / "store")).collect()) == sorted(v.collect())
    writers.write_vector_store(v.drop("id").withColumn("id", F.lit(None).cast("string")), str(tmp_path / "bare"))
    ids = {tuple(r.embedding): r.id for r in readers.read_vector_store(spark, str(tmp_path / "bare")).collect()}
    assert ids == {tuple(r.embedding): r.id for r in v.select("embedding", arrow.vector_id("embedding").alias("id")).collect()}
    calls = spark.createDataFrame([], "graph_id long, operation string, input_tokens long, output_tokens long")
    assert not writers.write_usage(calls, str(tmp_path / "none")) and not os.path.exists(tmp_path / "none")


def test_hooks_and_stable_component(spark):
    nodes = spark.createDataFrame([(1, " a&amp;b "), (1, "c"), (1, "d")], "graph_id long, entity_name string")
    edges = spark.createDataFrame([(1, " a&amp;b ", "c", 2.0)], "graph_id long, a string, b string, weight double")
    n, e = graph.stable_largest(nodes, edges)
    assert [r.entity_name for r in n.collect()] == ["A&B", "C"] and [(r.a, r.b, r.weight) for r in e.collect()] == [("A&B", "C", 2.0)]
    rows = spark.createDataFrame([(["x", "y"],)], "descriptions array<string>")
    assert graph.summarised(rows) is rows
    assert graph.summarised(rows, lambda c: F.array(F.array_join(c, " and "))).first().descriptions == ["x and y"]


def test_tokenizer_gets_bounded_parts():
    sizes = [[len(t) for t in p] for p in tokens.parts(["a" * 60, "b" * 50, "", "c" * 500, "d"], 100)]
    assert sizes == [[60], [50, 0], [500], [1]] and list(tokens.parts([], 100)) == []


def test_pieces_of_a_batch_are_bounded():
    pdf = pd.DataFrame({"n": range(7), "text": ["x" * 40, None, "x" * 90, "x" * 300, "", "x", "x" * 99]}, index=range(3, 10))
    found = list(models.pieces(iter([pdf]), ["text"], most=100, rows=3))
    assert pd.concat(found).equals(pdf) and [len(p) for p in found] == [2, 1, 1, 3]
    assert len(list(models.pieces(iter([pdf.iloc[:0]]), ["text"]))) == 1
