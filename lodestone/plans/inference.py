"""Questions to answers: retrieve chunks of an item, ask a model, score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as t
from lodestone.functions.models import LLM, Encoder, complete, encode, hybrid_scores
from lodestone.operators import vectors

PROMPT = "Answer from the passages.\n{context}\nQuestion: {input}\nAnswer:"


def retrieve(questions: DataFrame, chunks: DataFrame, kind: str, encoder: Encoder | None = None, k: int = 5, item: str = "doc_index", weights=(1.0, 0.3, 1.0)) -> DataFrame:
    """item, chunk_ord, content, score, rank of each item's best chunks among its own.

    kind: ``dense`` (cosine), ``hybrid`` (cosine, token weights and token vectors, by a MultiEncoder) or
    ``none`` (every chunk with score 1)."""
    if kind == "none":
        return vectors.ranked(chunks.join(questions.select(item), item, "left_semi").withColumn("score", F.lit(1.0)), [item], "score", "chunk_ord")
    if kind not in ("dense", "hybrid"):
        raise ValueError(f"unknown retriever {kind}")
    if kind == "hybrid":
        pairs = chunks.select(item, "chunk_ord", "content").join(questions.select(item, "question"), item)
        scored = hybrid_scores(pairs, "question", "content", "score", encoder, weights)
        return vectors.ranked(scored.select(item, "chunk_ord", "content", "score"), [item], "score", "chunk_ord", k)
    q = encode(questions.select(item, "question"), "question", "q", encoder)
    c = encode(chunks.select(item, "chunk_ord", "content"), "content", "v", encoder)
    scored = c.join(q, item).withColumn("score", vectors.dot(F.col("q"), F.col("v")))
    return vectors.ranked(scored.select(item, "chunk_ord", "content", "score"), [item], "score", "chunk_ord", k)


def answer(items: DataFrame, hits: DataFrame, llm: LLM, item: str = "doc_index", template: str = PROMPT, most_words: int | None = None) -> DataFrame:
    """item, question, prediction, truth, num_chunks_used, f1 of items (item, question, truths)."""
    context = hits.groupBy(item).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("context"), F.count("*").alias("num_chunks_used"))
    rows = items.select(item, "question", "truths").join(context, item)
    text = F.col("context") if most_words is None else t.truncate_words(F.col("context"), most_words)
    rows = rows.withColumn("prompt", t.fill(F.lit(template), context=text, input=F.col("question"))).drop("context")
    done = complete(rows, "prompt", "prediction", llm)
    first = F.coalesce(F.get("truths", F.lit(0)), F.lit(""))
    return done.select(item, "question", "prediction", first.alias("truth"), "num_chunks_used", t.qa_f1(F.col("prediction"), first).alias("f1"))
