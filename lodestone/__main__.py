"""Command line: python -m lodestone COMMAND ... Each command reads and writes tables or JSON lines.

graph       documents (JSON lines with a context) to graphs, with vectors, similarity edges and usage
community   items' entities, given or found by a model, to each item's subgraphs of both sizes
positives   chunks against questions and answers to ranked outputs
queries     subgraphs to confusing questions
matching    chunks that the questions of an item find, without its positives
negatives   all or matched chunks to the training rows of a stage
infer       questions to answers and scores
pairwise    two folders of results to a judge's win rates, or a column of verdicts
stats       graphs to statistics
coverage    items' entities against the nodes of their own graphs

Models are named as module:object; the stand-ins serve where none is given.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions import tokens as bpe
from lodestone.functions.models import CapitalNames, HashedWords, LengthJudge, OverlapProxy, Paraphrases, RuleExtractor
from lodestone.functions.scratch import saved
from lodestone.functions.text import unquote_once
from lodestone.operators import chunking, evaluation, graph, propagation, stats, training
from lodestone.plans import inference, mining
from lodestone.plans.corpus_graph import CorpusGraph
from lodestone.sources import readers, writers


def _model(name: str | None, fallback):
    if not name:
        return fallback
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _config(path: str | None) -> config.Config:
    if not path:
        return config.load()
    with open(path, encoding="utf-8") as f:
        return config.load(f.read())


def _items(spark: SparkSession, args) -> DataFrame:
    return readers.normalized_items(readers.read_jsonl(spark, args.input, start=args.start, end=args.end))


def run_graph(spark, args) -> None:
    c = _config(args.config)
    docs = _items(spark, args).where("context IS NOT NULL").select(F.col("doc_index").alias("doc_id"), F.col("context").alias("text"))
    g = CorpusGraph.from_documents(docs, _model(args.llm, RuleExtractor()), c).embed(_model(args.encoder, HashedWords()))
    g.save(f"{args.output}/base")
    writers.write_usage(g.usage, f"{args.output}/usage")
    writers.write_table(chunking.context_map(docs), f"{args.output}/context_map")
    if not args.skip_augment:
        CorpusGraph.load(spark, f"{args.output}/base").augment(args.threshold, c.augmentation.threshold)[0].save(f"{args.output}/augmented")


def _entities(spark, args) -> DataFrame:
    """doc_index, graph_id (of the item's representative), ent_ord, entity."""
    if args.entities:
        found = spark.read.parquet(args.entities).withColumn("ent_ord", F.lit(0))
    else:
        items = readers.normalized_items(readers.read_jsonl(spark, args.input))
        found = mining.named_entities(items.withColumn("text", F.concat_ws(" ", "question", "answer")), _model(args.llm, CapitalNames()))
        found = saved(found, "entities")
    return found.join(spark.read.parquet(f"{args.graph}/context_map"), "doc_index").select("doc_index", F.col("rep_index").alias("graph_id"), "ent_ord", "entity")


def run_community(spark, args) -> None:
    """Each item has seeds, ranks and subgraphs of its own, within its context's graph."""
    by = ["doc_index", "graph_id"]
    version = readers.first_path(spark, f"{args.graph}/{args.version}", f"{args.graph}/base")
    g = CorpusGraph.load(spark, version, False)
    seeds = g.match(_entities(spark, args), "doc_index")
    best = g.attributes(propagation.two_sizes(g.ranks(seeds, _config(args.config), "doc_index"), by))
    best = saved(best, "best")
    for size in ("large", "small"):
        part = best.where(F.col("size") == size)
        for name in ("full", "subgraph"):
            nested = propagation.nested_edges(propagation.subgraph_edges(part, g.edges, by, name == "full", ["graph_id"]), by)
            writers.write_table(part.join(nested, [*by, "node"], "left"), f"{args.output}/{name}_{size}")


def _chunks(items: DataFrame, c: config.Config) -> DataFrame:
    make = {"sentence": chunking.sentence_windows, "token": chunking.token_windows, "word": chunking.word_windows}[c.chunking.method]
    more = {"tokenizer": c.chunking.tokenizer} if c.chunking.tokenizer and c.chunking.method != "word" else {}
    return make(items, c.chunking.size, c.chunking.overlap, "doc_index", "context", **more).select("doc_index", "chunk_ord", "content")


def run_positives(spark, args) -> None:
    c = _config(args.config)
    items = _items(spark, args)
    count = bpe.token_count(c.chunking.tokenizer) if c.chunking.tokenizer else None
    scored = mining.item_scores(items, _chunks(items, c), _model(args.log_prob, OverlapProxy()), _model(args.encoder, HashedWords()), c, most_tokens=c.alignment.most_tokens or None, tokens=count)
    writers.write_ranked(saved(scored, "scored"), args.output, ["doc_index"], "chunk_ord", c.alignment.top_k)


def run_queries(spark, args) -> None:
    """subgraphs: the folder of community."""
    c = _config(args.config).queries
    part = lambda size: spark.read.parquet(f"{args.subgraphs}/subgraph_{size}").select("doc_index", "size", "node", "rank", "entity_type", "descriptions")
    made = mining.confusing_queries(_items(spark, args), part("large").unionByName(part("small")), _model(args.llm, Paraphrases()), args.number or c.number)
    writers.write_table(made, args.output, ["size"])


def run_matching(spark, args) -> None:
    """ranked: the folder of positives; queries: that of queries."""
    c = _config(args.config)
    found = mining.matched_chunks(
        spark.read.parquet(args.queries), spark.read.parquet(f"{args.ranked}/full"), spark.read.parquet(f"{args.ranked}/top"), _model(args.encoder, HashedWords()), args.top_k or c.queries.top_k)
    writers.write_table(found, args.output, ["size"])


def run_negatives(spark, args) -> None:
    """ranked: the folder of positives; matched: that of matching, for stages 2 and 3."""
    c = _config(args.config).training
    ranked = spark.read.parquet(f"{args.ranked}/full")
    if args.stage > 1 and not args.matched:
        raise SystemExit("stages 2 and 3 need --matched")
    matched = {s: spark.read.parquet(args.matched).where(F.col("size") == s) if args.matched else ranked for s in ("large", "small")}
    positives = training.top_positives(ranked, "doc_index", "chunk_ord", c.positives)
    rows = training.stage(args.stage, _items(spark, args).select("doc_index", F.col("question").alias("query")), positives, ranked, matched["large"], matched["small"], "doc_index", c.negatives, c.seed, "chunk_ord")
    writers.write_jsonl(rows.select("messages", "positive_messages", "negative_messages"), args.output)


def run_infer(spark, args) -> None:
    c = _config(args.config)
    items = _items(spark, args)
    chunks = chunking.word_windows(items, c.chunking.size, c.chunking.overlap, "doc_index", "context")
    hits = inference.retrieve(items, chunks, args.retriever, _model(args.encoder, HashedWords()), c.retrieval.top_k, weights=c.retrieval.weights)
    results = inference.answer(items, hits, _model(args.llm, RuleExtractor())).withColumn("dataset", F.lit(args.dataset)).withColumn("model", F.lit(args.retriever))
    writers.write_results(results, evaluation.run_scores(results), args.output, args.end)


def run_pairwise(spark, args) -> None:
    """Two results of infer, judged by a model; or with --input, rows that have a verdict."""
    if args.input:
        won = evaluation.winners(spark.read.json(args.input), args.verdict)
    else:
        fields = "question string, answer string, truth string, prediction string"

        def read(path: str) -> DataFrame:
            """Results by their items; files without them by the places of their lines."""
            rows = spark.read.schema(f"doc_index long, {fields}").json(path)
            rows = readers.read_jsonl(spark, path, fields) if rows.where("doc_index IS NOT NULL").isEmpty() else rows
            return rows.withColumn("answer", F.coalesce("answer", "truth"))

        found = saved(mining.judged(read(args.model1), read(args.model2), _model(args.llm, LengthJudge())), "judged")
        writers.write_jsonl(found, f"{args.output}/details")
        won = evaluation.winners(found, "winner")
    name = lambda p: (p or "").rstrip("/").rpartition("/")[2]
    summary = evaluation.pairwise_summary(won.select(F.lit(name(args.model1)).alias("model1"), F.lit(name(args.model2)).alias("model2"), "winner"), ["model1", "model2"])
    writers.write_jsonl(summary, args.output if args.input else f"{args.output}/summary")


def run_stats(spark, args) -> None:
    g = CorpusGraph.load(spark, args.graph, False)
    nodes = g.nodes.select("graph_id", "entity_name")
    per = stats.clustering(nodes, g.edges)
    labels, degree = graph.component_labels(nodes, g.edges), graph.degrees(nodes, g.edges)
    whole = per.join(stats.degree_stats(degree), "graph_id").join(stats.component_stats(labels), "graph_id").join(stats.power_law(degree), "graph_id")
    whole = whole.join(stats.paths(nodes, g.edges), "graph_id", "left")
    writers.write_table(whole, f"{args.output}/graphs")
    writers.write_table(stats.aggregate(whole), f"{args.output}/all")


def run_coverage(spark, args) -> None:
    """An item's entities meet the nodes of its own graph."""
    nodes = CorpusGraph.load(spark, readers.first_path(spark, f"{args.graph}/{args.version}", f"{args.graph}/base"), False).nodes
    items = _entities(spark, args).select("doc_index", "graph_id", F.upper(F.btrim("entity")).alias("entity"))
    per = stats.coverage(items, nodes.select("graph_id", unquote_once(F.col("entity_name")).alias("entity_name")), "doc_index", graph="graph_id")
    writers.write_table(per, f"{args.output}/items")
    writers.write_table(stats.coverage_summary(per), f"{args.output}/all")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = p.add_subparsers(dest="command", required=True)

    def add(name: str, function, *options: str):
        c = commands.add_parser(name)
        c.set_defaults(run=function)
        c.add_argument("--output", required=True)
        c.add_argument("--config")
        for o in options:
            required = not o.endswith("?")
            c.add_argument(f"--{o.rstrip('?')}", required=required)
        if "input" in options:
            c.add_argument("--start", type=int, default=0)
            c.add_argument("--end", type=int)
        return c

    g = add("graph", run_graph, "input", "llm?", "encoder?")
    g.add_argument("--threshold", type=float)
    g.add_argument("--skip-augment", action="store_true")
    add("community", run_community, "graph", "entities?", "input?", "llm?").add_argument("--version", default="augmented")
    add("positives", run_positives, "input", "encoder?", "log_prob?")
    add("queries", run_queries, "input", "subgraphs", "llm?").add_argument("--number", type=int)
    add("matching", run_matching, "ranked", "queries", "encoder?").add_argument("--top_k", type=int)
    add("negatives", run_negatives, "input", "ranked", "matched?").add_argument("--stage", type=int, choices=(1, 2, 3), default=1)
    i = add("infer", run_infer, "input", "llm?", "encoder?")
    i.add_argument("--retriever", choices=("dense", "hybrid", "none"), default="dense")
    i.add_argument("--dataset", default="data")
    add("pairwise", run_pairwise, "input?", "model1?", "model2?", "llm?").add_argument("--verdict", default="verdict")
    add("stats", run_stats, "graph")
    add("coverage", run_coverage, "graph", "entities?", "input?", "llm?").add_argument("--version", default="augmented")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(spark or SparkSession.builder.appName("lodestone").getOrCreate(), args)


if __name__ == "__main__":
    main()
