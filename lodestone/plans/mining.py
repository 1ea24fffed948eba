"""Positives and negatives end to end: alignment scores of chunks, confusing questions about a
subgraph, the chunks that they find, and a judge of two runs. Instructions are our own; they
are parameters, as a model may want others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.config import Config
from lodestone.functions import salvage
from lodestone.functions import text as t
from lodestone.functions.models import LLM, Encoder, LogProb, complete, encode, log_prob
from lodestone.operators import alignment, evaluation, vectors

FORWARD = 'From the passage, give the shortest answer to the question; "unanswerable" if the passage has none.\n\nPassage: {chunk}\n\nQuestion: {question}\n\nAnswer:'
BACKWARD = "From the passage, give the one question that the answer below belongs to.\n\nPassage: {chunk}\n\nAnswer: {answer}\n\nQuestion:"
CONFUSING = (
    'Below are a question, its answer and entities that are near to it, as JSON. Write {n} questions about these entities that look like the question but have other answers. '
    'Reply with JSON alone: {"confusing_questions": ["...", "..."]}\n{input}')
NAMES = 'List the names of people, places and things in the text, as a JSON array of strings and nothing else.\nText: {text}'
JUDGE = (
    "Two answers to a question are compared with the true one. Say for faithfulness, for conciseness and over all which is better: Answer 1, Answer 2 or Tie. Reply with JSON alone: "
    '{"Faithfulness": {"Winner": "..."}, "Conciseness": {"Winner": "..."}, "Overall": {"Winner": "..."}}\nQuestion: {question}\nTruth: {truth}\nAnswer 1: {one}\nAnswer 2: {two}')
_VERDICT = "Faithfulness struct<Winner: string>, Conciseness struct<Winner: string>, Overall struct<Winner: string>"


def item_scores(items: DataFrame, chunks: DataFrame, model: LogProb, encoder: Encoder, config: Config | None = None, item: str = "doc_index", most_tokens: int | None = None, tokens=None) -> DataFrame:
    """item, chunk_ord, content, tokens, forward, backward, parameter, score of each chunk of an item:
    the answer's mean log-probability after chunk and question, the question's after chunk and answer,
    and their cosine, weighted. Items without a chunk have no rows. items: item, question, answer."""
    c = (config or Config()).alignment
    rows = chunks.select(item, "chunk_ord", "content").join(items.select(item, "question", "answer"), item)
    rows = rows.withColumn("ahead", t.fill(F.lit(FORWARD), chunk=F.col("content"), question=F.col("question"))).withColumn("back", t.fill(F.lit(BACKWARD), chunk=F.col("content"), answer=F.col("answer")))
    rows = log_prob(log_prob(rows, "ahead", "answer", "forward", model, most_tokens), "back", "question", "backward", model, most_tokens)
    rows = encode(encode(rows, "question", "q", encoder), "content", "v", encoder)
    rows = rows.withColumn("parameter", vectors.dot(F.col("q"), F.col("v"))).withColumn("tokens", (tokens or t.token_count)(F.col("content")))
    w = {"forward": c.forward, "backward": c.backward, "parameter": c.parameter}
    return alignment.scores(rows.select(item, "chunk_ord", "content", "tokens", *w), [item], weights=w)


def named_entities(texts: DataFrame, llm: LLM, item: str = "doc_index", text: str = "text", extract=None) -> DataFrame:
    """item, ent_ord, entity: the names in an item's text, by ``extract`` (a function from a text column to
    an array of names) or by a model's answer, in upper case."""
    if extract is not None:
        found = texts.select(item, extract(F.col(text)).alias("found"))
    else:
        asked = texts.withColumn("prompt", F.replace(F.lit(NAMES), F.lit("{text}"), F.coalesce(F.col(text), F.lit("")))).select(item, "prompt")
        found = complete(asked, "prompt", "answer", llm).select(item, salvage.json_strings(F.col("answer")).alias("found"))
    return found.select(item, F.posexplode("found").alias("ent_ord", "entity"))


def confusing_queries(items: DataFrame, subgraph: DataFrame, llm: LLM, n: int = 5, by: list[str] | None = None, item: str = "doc_index", **retry) -> DataFrame:
    """by, query_ord, query: at most ``n`` questions for each item and size, from its entities in order of
    rank. Answers that don't parse have none. subgraph: by, node, rank, entity_type, descriptions."""
    by = by or [item, "size"]
    view = t.entity_view(F.col("node"), F.col("entity_type"), F.array_join("descriptions", "<SEP>"))
    seen = subgraph.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", view.alias("v")))), lambda x: x["v"]).alias("entities"))
    rows = seen.join(items.select(item, "question", "answer"), item)
    told = F.to_json(F.struct(F.coalesce("question", F.lit("")).alias("original_question"), F.coalesce("answer", F.lit("")).alias("answer"), "entities"))
    rows = rows.select(*by, F.replace(F.replace(F.lit(CONFUSING), F.lit("{n}"), F.lit(str(n))), F.lit("{input}"), told).alias("prompt"))
    done = complete(rows, "prompt", "reply", llm, **retry)
    return done.select(*by, F.posexplode(salvage.confusing_questions(t.strip(F.col("reply")), n)).alias("query_ord", "query"))


def matched_chunks(queries: DataFrame, chunks: DataFrame, positives: DataFrame, encoder: Encoder, k: int = 10, by: list[str] | None = None, item: str = "doc_index") -> DataFrame:
    """by, content, chunk_ord: what the queries of an item and size find among the item's own chunks (the k
    nearest of each), once, without its positives. queries: by, query_ord, query."""
    by = by or [item, "size"]
    q = encode(queries.select(*by, "query_ord", "query"), "query", "q", encoder)
    c = encode(chunks.select(item, "chunk_ord", "content"), "content", "v", encoder)
    scored = q.join(c, item).select(*by, "query_ord", "chunk_ord", "content", vectors.dot(F.col("q"), F.col("v")).alias("score"))
    found = vectors.ranked(scored, [*by, "query_ord"], "score", "chunk_ord", k)
    once = found.groupBy(*by, "content").agg(F.min("chunk_ord").alias("chunk_ord"))
    return once.join(positives.select(item, "content").distinct(), [item, "content"], "left_anti").select(*by, "content", "chunk_ord")


def judged(left: DataFrame, right: DataFrame, llm: LLM, ordinal: str = "doc_index", **retry) -> DataFrame:
    """ordinal, question, ground_truth, answer1, answer2 and the winners over all, in faithfulness and in
    conciseness, of two runs' results (ordinal, question, answer, prediction) at the same places."""
    columns = [ordinal, "question", "answer", "prediction"]
    rows = evaluation.positional_pairs(left.select(*columns), right.select(*columns), ordinal)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = rows.withColumn("prompt", t.fill(F.lit(JUDGE), question=text("question1"), truth=text("answer1"), one=text("prediction1"), two=text("prediction2")))
    done = complete(rows, "prompt", "reply", llm, **retry).withColumn("v", t.verdict(F.col("reply"), _VERDICT))
    return done.select(
        ordinal, F.col("question1").alias("question"), F.col("answer1").alias("ground_truth"), F.col("prediction1").alias("answer1"), F.col("prediction2").alias("answer2"),
        *[F.coalesce(F.col(f"v.{c}.Winner"), F.lit("Tie")).alias(n) for c, n in (("Overall", "winner"), ("Faithfulness", "faithfulness_winner"), ("Conciseness", "conciseness_winner"))])
