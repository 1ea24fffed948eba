"""The corpus graph: documents to chunks, records, graphs, vectors, and subgraphs from them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.functions.models import LLM, Encoder, complete, encode
from lodestone.functions.scratch import saved
from lodestone.functions.text import hash_id
from lodestone.operators import chunking, graph, matching, propagation, records, vectors
from lodestone.sources.writers import write_table

#: Our own instruction; a model's answer must follow the record format.
PROMPT = (
    "List what the text names and how it is related, as records between round brackets, their fields divided by <|> and the records by ##. "
    'A name: ("entity"<|>name<|>type<|>description). A relation: ("relationship"<|>name<|>name<|>description<|>keywords<|>weight). End with <|COMPLETE|>.\nText: {text}')


@dataclass
class CorpusGraph:
    """Tables of all graphs at once, keyed by graph_id (the representative document's index)."""

    chunks: DataFrame
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame | None = None
    #: What the model calls used: graph_id, operation, model, input_tokens, output_tokens.
    usage: DataFrame | None = None

    @classmethod
    def from_chunks(cls, chunks: DataFrame, llm: LLM, **retry) -> "CorpusGraph":
        """chunks: graph_id, chunk_ord, content."""
        asked = chunks.withColumn("prompt", F.replace(F.lit(PROMPT), F.lit("{text}"), F.col("content")))
        # written once: nodes, edges and usage are all made from it, and each call costs
        answered = saved(complete(asked, "prompt", "records", llm, usage="used", **retry).withColumn("chunk_id", hash_id(F.col("content"), "chunk-")), "answers")
        used = answered.select("graph_id", F.lit("entity_extraction").alias("operation"), "used.*")
        parsed = records.records(answered, ["graph_id", "chunk_ord", "chunk_id"])
        keys = ["graph_id", "chunk_ord", "chunk_id"]
        nodes, edges = graph.build(records.mentions(parsed, keys, "chunk_id"), records.relations(parsed, keys, "chunk_id"), ["chunk_ord", "rec_ord"])
        return cls(chunks, nodes, edges, usage=used)

    @classmethod
    def from_documents(cls, docs: DataFrame, llm: LLM, config: Config | None = None, index: str = "doc_id", text: str = "text") -> "CorpusGraph":
        """A graph for each different text; documents that share a text share its graph."""
        c = (config or Config()).chunking
        make = {"token": chunking.token_windows, "word": chunking.word_windows, "sentence": chunking.sentence_windows}[c.method]
        more = {"tokenizer": c.tokenizer} if c.tokenizer and c.method != "word" else {}
        chunks = make(chunking.representatives(docs, index, text), c.size, c.overlap, index, text, **more)
        return cls.from_chunks(chunks.select(F.col(index).alias("graph_id"), "chunk_ord", "content"), llm)

    def embed(self, encoder: Encoder) -> "CorpusGraph":
        """Vectors of the extracted entities (placeholders have none), from name and description."""
        rows = self.nodes.where(F.col("entity_type") != graph.UNKNOWN).select(
            "graph_id", hash_id(F.col("entity_name"), "ent-").alias("id"), "entity_name", F.concat_ws(" ", "entity_name", F.array_join("descriptions", records.SET)).alias("content"))
        return CorpusGraph(self.chunks, self.nodes, self.edges, encode(rows, "content", "embedding", encoder).drop("content"), self.usage)

    def augment(self, threshold: float | None = None, default: float = 0.8, enabled: bool = True) -> tuple["CorpusGraph", DataFrame | None]:
        """With edges between similar entities put over the explicit ones, and the counts."""
        if not enabled:
            return self, None
        theta = vectors.checked_threshold(threshold, default)
        similar = vectors.similar_pairs(self.vectors, theta, "entity_name", "embedding", "graph_id")
        made = similar.select(
            "graph_id", "a", "b", "weight", F.lit(0).alias("order"), F.array(F.lit(f"similarity at least {theta}")).alias("descriptions"), F.array("a", "b").alias("source_ids"))
        edges = self.edges.join(vectors.replaced(self.edges, self.vectors, theta, "entity_name", "embedding", "graph_id"), ["graph_id", "a", "b"], "left_anti").select(*made.columns).unionByName(made)
        stats = edges.groupBy("graph_id").agg(F.count_if(F.col("order") == 0).alias("edges_added"), F.count("*").alias("total_edges"), F.lit(theta).alias("threshold"))
        return CorpusGraph(self.chunks, self.nodes, edges, self.vectors, self.usage), stats

    def match(self, entities: DataFrame, item: str = "graph_id") -> DataFrame:
        """item, graph_id, entity_name for entities (item, graph_id, ent_ord, entity): exact, else by tokens.
        An item is matched within its graph's nodes and by itself: several may have one graph."""
        rows = entities if item != "graph_id" else entities.withColumn("_item", F.col("graph_id"))
        key = item if item != "graph_id" else "_item"
        exact = matching.exact(rows, self.nodes, key, "graph_id")
        near = matching.by_tokens(rows, self.nodes, exact, 5, key, "graph_id")
        found = exact.select(key, "graph_id", "entity_name").distinct().unionByName(near.select(key, "graph_id", "entity_name"))
        return found if item != "graph_id" else found.drop("_item")

    def ranks(self, seeds: DataFrame, config: Config | None = None, item: str | None = None) -> DataFrame:
        """(item,) graph_id, node, score around seeds ((item,) graph_id, entity_name)."""
        c = (config or Config()).pagerank
        return propagation.pagerank(
            self.nodes.select("graph_id", F.col("entity_name").alias("node")), self.edges, seeds.withColumnRenamed("entity_name", "node"), alpha=c.alpha, tolerance=c.tolerance, most=c.most_rounds, item=item)

    def attributes(self, ranked: DataFrame) -> DataFrame:
        return ranked.join(self.nodes.withColumnRenamed("entity_name", "node"), ["graph_id", "node"])

    def subgraph(self, seeds: DataFrame, config: Config | None = None, adaptive: bool = True, top_k: int = 10, size: str = "large", item: str | None = None) -> DataFrame:
        """(item,) graph_id, node, score, rank and attributes around seeds ((item,) graph_id, entity_name)."""
        by = [*([item] if item else []), "graph_id"]
        ranks = self.ranks(seeds, config, item)
        least, most = getattr((config or Config()).pagerank, size)
        return self.attributes(propagation.cutoff(ranks, least, most, by) if adaptive else propagation.fixed_top(ranks, top_k, by))

    def stats(self) -> DataFrame:
        n = self.nodes.groupBy("graph_id").agg(F.count("*").alias("nodes"))
        return n.join(self.edges.groupBy("graph_id").agg(F.count("*").alias("edges")), "graph_id", "left").select(
            "graph_id", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.lit(self.vectors is not None).alias("has_index"))

    def save(self, path: str) -> None:
        for name in ("chunks", "nodes", "edges", "vectors", "usage"):
            if getattr(self, name) is not None:
                write_table(getattr(self, name), f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, with_vectors: bool = True) -> "CorpusGraph":
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        return cls(read("chunks"), read("nodes"), read("edges"), read("vectors") if with_vectors else None)
