"""Readers: JSON lines with raw-line ordinals, concatenated JSON, vector stores, GraphML, tables."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from xml.parsers import expat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW = "input string, question string, answers array<string>, answer string, output string, context string"
#: Bytes of a GraphML file that are shuffled as one, and elements that leave the decoder at once.
PACK, ELEMENTS = 512, 4096


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return bool(found)


def first_path(spark: SparkSession, *paths: str) -> str:
    """The first of the paths that exists."""
    for p in paths:
        if exists(spark, p):
            return p
    raise FileNotFoundError(", ".join(paths))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, ordinal (of the raw line in its file, from 0), value.

    A split of a file is read in order, so a line's ordinal is its place in the split and
    the lines of the splits before it: a count for each split, no sort of lines."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), "value")
    splits = rows.groupBy("file", "at").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "at", (before - F.col("first")).alias("shift"))
    return rows.join(splits, ["file", "at"]).select("file", (F.col("id") + F.col("shift")).alias("ordinal"), "value")


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW, start: int = 0, end: int | None = None, strict: bool = False) -> DataFrame:
    """file, doc_index (raw-line ordinal), and the fields, of lines in [start, end). Blank lines
    are skipped. Malformed lines are skipped too, leaving a gap in the ordinals, or raise if
    ``strict``. A missing path has no rows unless ``strict``."""
    if not exists(spark, path) and not strict:
        empty = spark.createDataFrame([], f"file string, doc_index long, {schema}")
        return empty
    rows = lines(spark, path).withColumn("value", F.btrim("value", F.lit(" \t\r\n"))).where("value <> ''")
    rows = rows.where(F.col("ordinal") >= start)
    if end is not None:
        rows = rows.where(F.col("ordinal") < end)
    ok = F.try_parse_json("value").isNotNull()
    if strict:
        ok = F.when(ok, True).otherwise(F.raise_error(F.concat(F.lit("malformed line "), F.col("ordinal").cast("string"))))
    rows = rows.where(ok).select("file", F.col("ordinal").alias("doc_index"), F.from_json("value", schema).alias("r"))
    return rows.select("file", "doc_index", "r.*")


def point_read(spark: SparkSession, path: str, index: int, schema: str = RAW) -> DataFrame:
    """The one record at a raw-line ordinal; IndexError if there is none."""
    row = read_jsonl(spark, path, schema, index, index + 1)
    if row.isEmpty():
        raise IndexError(index)
    return row


def normalized_items(raw: DataFrame) -> DataFrame:
    """doc_index, question, truths, answer, context: the fallbacks of the record's field names."""
    return raw.select(
        "doc_index", F.coalesce("input", "question").alias("question"),
        F.coalesce("answers", F.when(F.col("answer").isNotNull(), F.array("answer"))).alias("truths"),
        F.coalesce("answer", F.get("answers", F.lit(0)), "output").alias("answer"), "context")


def read_json_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects that follow one another in files without a separator, pretty-printed or not."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = json.JSONDecoder().raw_decode
        for pdf in batches:
            for text in pdf.value:
                found, at = [], 0
                while True:
                    while at < len(text) and text[at].isspace():
                        at += 1
                    if at >= len(text):
                        break
                    value, at = read(text, at)
                    found.append(json.dumps(value, ensure_ascii=False))
                yield pd.DataFrame({"value": found})

    rows = spark.read.text(path, wholetext=True).mapInPandas(decode, "value string")
    return rows.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_vector_store(spark: SparkSession, path: str) -> DataFrame:
    """id, entity_name, embedding of stores with JSON rows and a base64 float32 matrix. A row without
    an id has the MD5 of its vector's bytes."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for text in pdf.value:
                store = json.loads(text)
                rows = store["data"]
                matrix = np.frombuffer(base64.b64decode(store["matrix"]), dtype=np.float32).reshape(-1, int(store["embedding_dim"]))
                if len(matrix) != len(rows):
                    raise ValueError(f"{len(rows)} rows and {len(matrix)} vectors")
                yield pd.DataFrame({"id": [r.get("__id__") or hashlib.md5(v.tobytes()).hexdigest() for r, v in zip(rows, matrix)], "entity_name": [r.get("entity_name") for r in rows], "embedding": [v.tolist() for v in matrix]})

    return spark.read.text(path, wholetext=True).mapInPandas(decode, "id string, entity_name string, embedding array<float>")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Neighbouring pieces (file, at, id, value) of a split as one of about PACK bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, at, value = (batch.column(c) for c in ("file", "at", "value"))
        part, start = np.cumsum(pc.binary_length(value).to_numpy().astype(np.int64) + 1) // PACK, at.to_numpy()
        new = np.ones(len(value), dtype=bool)
        new[1:] = (part[1:] != part[:-1]) | (start[1:] != start[:-1])
        new[pc.run_end_encode(file).run_ends.to_numpy()[:-1]] = True
        first = np.flatnonzero(new)
        runs = pa.ListArray.from_arrays(pa.array(np.append(first, len(value)), pa.int32()), value)
        yield pa.RecordBatch.from_arrays([file.take(first), at.take(first), batch.column("id").take(first), pc.binary_join(runs, b">")], names=["file", "at", "id", "value"])


def _graphml(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """file, kind, a, b, attrs of nodes and edges, from files in pieces (file, value) in their order, cut at ">".
    What is held is a batch, a few thousand elements that ended and those that are open."""
    file, parser, last, out = None, None, b"", []
    names: dict = {}
    used: dict = {}
    path: list[dict] = []

    def begin(name: str, attrs: dict) -> None:
        kind = name.rpartition("}")[2]
        if path:
            path[-1]["plain"] = False
        path.append({"kind": kind, "attrs": attrs, "data": {}, "text": [], "plain": kind == "data"})
        if kind == "key":
            names[attrs.get("id")] = attrs.get("attr.name")
            if used.get(attrs.get("id"), attrs.get("attr.name")) != attrs.get("attr.name"):
                raise ValueError(f"{file}: key {attrs.get('id')} is declared behind its use")

    def text(piece: str) -> None:
        if path[-1]["plain"]:
            path[-1]["text"].append(piece)

    def end(_: str) -> None:
        e = path.pop()
        get = e["attrs"].get
        if e["kind"] == "data" and path:
            used[get("key")] = names.get(get("key"), get("key"))
            path[-1]["data"][used[get("key")]] = "".join(e["text"])
        elif e["kind"] == "node":
            out.append((file, "node", get("id"), None, json.dumps(e["data"], ensure_ascii=False)))
        elif e["kind"] == "edge":
            out.append((file, "edge", min(get("source"), get("target")), max(get("source"), get("target")), json.dumps(e["data"], ensure_ascii=False)))

    def made() -> Iterator[pa.RecordBatch]:
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], names=["file", "kind", "a", "b", "attrs"])
            out.clear()

    def close() -> None:
        # a ">" that ends a file has no piece behind it; behind the root there may be blanks
        if parser is not None:
            if last.rpartition(b">")[2].strip():
                parser.Parse(b">", False)
            parser.Parse(b"", True)

    for batch in batches:
        values, runs, start = batch.column("value").to_pylist(), pc.run_end_encode(batch.column("file")), 0
        for name, stop in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            if name != file:
                close()
                file, parser = name, expat.ParserCreate("utf-8", "}")
                names.clear(), used.clear(), path.clear()
                parser.buffer_text = True
                parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, text
                last = None
            for value in values[start:stop]:
                if last is not None:
                    parser.Parse(b">", False)
                parser.Parse(value, False)
                last = value
                if len(out) >= ELEMENTS:
                    yield from made()
            start = stop
        yield from made()
    close()
    yield from made()


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes(file, entity_name, attrs) and edges(file, a, b, attrs) of GraphML files. Keys are declared before
    they are used, as the format wants; a file where one comes later raises.

    Files are read in splits, cut at ">", and shuffled once, so that a file's pieces meet in order in one
    task, which never holds the file."""
    rows = spark.read.option("lineSep", ">").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"), F.col("value").cast("binary").alias("value"))
    rows = rows.mapInArrow(_packed, rows.schema)
    rows = rows.repartition("file").sortWithinPartitions("file", "at", "id").select("file", "value").mapInArrow(_graphml, "file string, kind string, a string, b string, attrs string")
    attrs = F.from_json("attrs", "map<string,string>").alias("attrs")
    return rows.where("kind = 'node'").select("file", F.col("a").alias("entity_name"), attrs), rows.where("kind = 'edge'").select("file", "a", "b", attrs)


def read_alignment(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """doc_index, chunk_ord, content, score of ranked outputs, whose chunks are texts or objects
    with a content; items are numbered by their file names. Files that don't parse are skipped."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    rows = rows.select(
        F.regexp_extract("file", r"([0-9]+)\.[a-z]+$", 1).cast("long").alias("doc_index"),
        F.expr("try_variant_get(v, '$.chunk_list', 'array<variant>')").alias("chunks"), F.expr("try_variant_get(v, '$.score_list', 'array<double>')").alias("scores"))
    if limit is not None:
        rows = rows.where(F.col("doc_index") < limit)
    rows = rows.select("doc_index", "scores", F.posexplode("chunks").alias("chunk_ord", "c"))
    content = F.coalesce(F.expr("try_variant_get(c, '$.content', 'string')"), F.expr("try_variant_get(c, '$', 'string')"))
    return rows.select("doc_index", F.col("chunk_ord").cast("long").alias("chunk_ord"), content.alias("content"), F.get("scores", F.col("chunk_ord")).alias("score"))


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """doc_index (the number that ends a file's name), v (its JSON); files that don't parse are skipped."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v")).where("v IS NOT NULL")
    return rows.select(F.regexp_extract("file", r"([0-9]+)\.[a-z]+$", 1).cast("long").alias("doc_index"), "v")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """doc_index, chunk_ord, content of chunk files: objects with a chunk_list of texts."""
    rows = _numbered(spark, path).select("doc_index", F.posexplode(F.expr("try_variant_get(v, '$.chunk_list', 'array<string>')")).alias("chunk_ord", "content"))
    return rows.withColumn("chunk_ord", F.col("chunk_ord").cast("long"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """doc_index, query_ord, query of query files: arrays of texts."""
    return _numbered(spark, path).select("doc_index", F.posexplode(F.expr("try_variant_get(v, '$', 'array<string>')")).alias("query_ord", "query"))


def read_matched(spark: SparkSession, path: str) -> DataFrame:
    """doc_index, chunk_ord, content of files of matched chunks: arrays of texts."""
    return read_queries(spark, path).withColumnsRenamed({"query_ord": "chunk_ord", "query": "content"})
