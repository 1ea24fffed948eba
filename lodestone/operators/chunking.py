"""Document identity, chunking and chunk identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import tokens as bpe
from lodestone.functions.arrow import split_long_sentences
from lodestone.functions.text import hash_id, strip, words


def context_map(docs: DataFrame, index: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_index, ctx_hash, rep_index: the smallest index with the same text. A partial
    aggregate and a join, so a text that very many documents have meets in no task whole."""
    rows = docs.select(F.col(index).alias("doc_index"), F.md5(text).alias("ctx_hash"))
    first = rows.groupBy("ctx_hash").agg(F.min("doc_index").alias("rep_index"))
    return rows.join(first, "ctx_hash").select("doc_index", "ctx_hash", "rep_index")


def representatives(docs: DataFrame, index: str = "doc_id", text: str = "text") -> DataFrame:
    """One document for each text, the one with the smallest index."""
    first = docs.groupBy(F.md5(text).alias("h")).agg(F.min(index).alias(index)).drop("h")
    return docs.join(first, index, "left_semi")


def documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_key, content: stripped texts by their hash, equal ones once."""
    return docs.select(strip(F.col(text)).alias("content")).select(hash_id(F.col("content"), "doc-").alias("doc_key"), "content").dropDuplicates(["doc_key"])


def _windows(docs: DataFrame, tokens: Column, size: int, step: int, index: str) -> DataFrame:
    """index, chunk_ord, start, n, content of the windows of each document. The tokens are a column
    of their own below the generator of the starts, so they are made once a document."""
    rows = docs.select(index, tokens.alias("_tokens"))
    starts = F.when(F.size("_tokens") > 0, F.sequence(F.lit(0), F.size("_tokens") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    rows = rows.select(index, "_tokens", F.posexplode(starts).alias("chunk_ord", "start"))
    return rows.select(
        index, F.col("chunk_ord").cast("long").alias("chunk_ord"), F.col("start").cast("long").alias("start"), F.least(F.lit(size), F.size("_tokens") - F.col("start")).cast("long").alias("n"),
        F.array_join(F.slice("_tokens", F.col("start") + 1, F.lit(size)), " ").alias("content"))


def _step(size: int, overlap: int) -> int:
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    return size - overlap


def word_windows(docs: DataFrame, size: int = 512, overlap: int = 12, index: str = "doc_id", text: str = "text") -> DataFrame:
    """index, chunk_ord, n_words, content: windows over the pieces between single spaces."""
    rows = _windows(docs, F.split(text, " ", -1), size, _step(size, overlap), index)
    return rows.select(index, "chunk_ord", F.col("n").alias("n_words"), strip(F.col("content")).alias("content")).where("content <> ''")


def token_windows(docs: DataFrame, size: int = 512, overlap: int = 12, index: str = "doc_id", text: str = "text", tokens=words, tokenizer: str | None = None) -> DataFrame:
    """index, chunk_ord, start, tokens, content over the tokens of each document: those of a
    ``tokenizer`` file, whose windows are decoded, or what ``tokens`` makes of the text column
    (blank-separated words unless given). The last windows may lie inside the one before."""
    if tokenizer:
        return bpe.window_rows(docs, index, text, tokenizer, size, overlap)
    rows = _windows(docs, tokens(F.col(text)), size, _step(size, overlap), index)
    return rows.select(index, "chunk_ord", "start", F.col("n").alias("tokens"), strip(F.col("content")).alias("content"))


def sentences(c: Column) -> Column:
    """Sentences: what ends in one of . ! ? and white space, and the rest."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])[ \t\n\r]+", -1), strip), lambda x: x != "")


def sentence_windows(docs: DataFrame, size: int = 5, overlap: int = 1, index: str = "doc_id", text: str = "text", split_long: bool = False, tokenizer: str | None = None) -> DataFrame:
    """index, chunk_ord, content: windows of sentences, joined by one space. split_long: sentences of
    more than 256 tokens (of the tokenizer file, or words) are cut first."""
    parts = sentences(F.col(text))
    if split_long:
        parts = F.filter(F.transform(split_long_sentences(tokenizer)(parts), strip), lambda x: x != "")
    return _windows(docs, parts, size, max(size - overlap, 1), index).select(index, "chunk_ord", "content")


def chunk_ids(chunks: DataFrame, index: str = "doc_id") -> DataFrame:
    """chunk_id, content and the place of the last chunk with each content."""
    rows = chunks.select(hash_id(F.col("content"), "chunk-").alias("chunk_id"), "content", F.struct(index, "chunk_ord").alias("at"))
    rows = rows.groupBy("chunk_id").agg(F.max_by("content", "at").alias("content"), F.max("at").alias("at"))
    return rows.select("chunk_id", "content", F.col("at")[index].alias(index), F.col("at.chunk_ord").alias("chunk_ord"))


def sweep(docs: DataFrame, configs: list[tuple[str, int, int]], index: str = "doc_id", tokenizer: str | None = None) -> DataFrame:
    """Chunks under several (method, size, overlap): one pass over the documents for each."""
    make = {"sentence": sentence_windows, "token": token_windows, "word": word_windows}
    out = None
    for method, size, overlap in configs:
        if method not in make:
            raise ValueError(f"no chunk method {method}")
        more = {"tokenizer": tokenizer} if tokenizer and method != "word" else {}
        part = make[method](docs, size, overlap, index, **more).select(
            F.lit(f"{method}_{size}_{overlap}").alias("config"), index, "chunk_ord", "content")
        out = part if out is None else out.unionByName(part)
    return out
