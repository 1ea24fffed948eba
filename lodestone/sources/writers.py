"""Writers: partitioned tables, JSON lines, ranked outputs, GraphML."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import alignment, stats


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A Parquet table; the caches of stages are such tables, keyed by dataset."""
    (df.write.mode(mode).partitionBy(*by) if by else df.write.mode(mode)).parquet(path)


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One JSON object a line, columns as fields."""
    keys = by or []
    rows = df.select(*keys, F.to_json(F.struct(*[c for c in df.columns if c not in keys])).alias("value"))
    (rows.write.partitionBy(*keys) if keys else rows.write).text(path)


def ranked_outputs(scored: DataFrame, by: list[str], tie: str, k: int = 10) -> dict[str, DataFrame]:
    """The five outputs of a ranking: in full and cut to k for each score, and rank lists."""
    ranked = alignment.ranks(scored, by, tie)
    return {
        "full": ranked,
        "top": alignment.top(ranked, "score", k),
        **{f"top_{c}": alignment.top(ranked, c, k) for c in ("forward", "backward", "parameter")},
        "rank_lists": alignment.rank_lists(ranked, by, tie),
        "rank_lists_top": alignment.rank_lists(ranked, by, tie, k),
    }


def write_ranked(scored: DataFrame, path: str, by: list[str], tie: str, k: int = 10) -> None:
    """The ranking is written in full once; what is cut from it reads that table, rank lists that of whole lists."""
    names = ("forward", "backward", "parameter")
    read = lambda name: scored.sparkSession.read.parquet(f"{path}/{name}")
    write_table(alignment.ranks(scored, by, tie), f"{path}/full")
    for c in ("score", *names):
        write_table(alignment.top(read("full"), c, k), f"{path}/{'top' if c == 'score' else f'top_{c}'}")
    write_table(alignment.rank_lists(read("full"), by, tie), f"{path}/rank_lists")
    write_table(read("rank_lists").select(*by, *[F.slice(f"{c}_rank", 1, k).alias(f"{c}_rank") for c in names]), f"{path}/rank_lists_top")


def write_results(results: DataFrame, scores: DataFrame, path: str, limit: int | None = None) -> None:
    """Raw results and scores of runs, by dataset and model."""
    scope = "full" if limit is None else f"sample_{limit}"
    write_jsonl(results, f"{path}/raw/{scope}", ["dataset", "model"])
    write_jsonl(scores, f"{path}/score/{scope}", ["dataset", "model"])


def _xml(c: Column) -> Column:
    out = c.cast("string")
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """graph_id, part (0 head, 1 nodes, 2 edges, 3 end), name, line: GraphML of each graph, in this order."""
    data = lambda c: F.concat(F.lit(f'<data key="{c}">'), _xml(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</data>"))
    skip = {"graph_id", "entity_name", "a", "b"}
    plain = lambda df: [c for c, k in df.dtypes if c not in skip and not k.startswith(("array", "struct", "map"))]
    keys = "".join(f'<key id="{c}" for="{kind}" attr.name="{c}" attr.type="string"/>' for kind, df in (("node", nodes), ("edge", edges)) for c in plain(df))
    head = f'<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">'
    ids = nodes.select("graph_id").distinct()
    n = nodes.select("graph_id", F.lit(1).alias("part"), F.col("entity_name").alias("name"),
                     F.concat(F.lit('<node id="'), _xml(F.col("entity_name")), F.lit('">'), *[data(c) for c in plain(nodes)], F.lit("</node>")).alias("line"))
    e = edges.select("graph_id", F.lit(2).alias("part"), F.concat_ws(" -> ", "a", "b").alias("name"),
                     F.concat(F.lit('<edge source="'), _xml(F.col("a")), F.lit('" target="'), _xml(F.col("b")), F.lit('">'), *[data(c) for c in plain(edges)], F.lit("</edge>")).alias("line"))
    frame = lambda part, line: ids.select("graph_id", F.lit(part).alias("part"), F.lit("").alias("name"), F.lit(line).alias("line"))
    return frame(0, head).unionByName(n).unionByName(e).unionByName(frame(3, "</graph></graphml>"))


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """A file for each graph, in a folder of its own; a graph is one task's, as the format wants."""
    rows = graphml(nodes, edges).repartition("graph_id").sortWithinPartitions("graph_id", "part", "name")
    rows.select("graph_id", F.col("line").alias("value")).write.partitionBy("graph_id").text(path)


def write_vector_store(vectors: DataFrame, path: str, key: str = "id", vector: str = "embedding", stores: int = 1) -> None:
    """Stores of JSON rows and a base64 float32 matrix, as read_vector_store() reads them: each a file by
    one task, as the format wants, so that a table that no worker holds needs several. Rows are in order of their
    key within a store."""
    other = [c for c in vectors.columns if c not in (key, vector)]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts)
        matrix = np.stack([np.asarray(v, dtype=np.float32) for v in rows[vector]])
        data = [{"__id__": r[key], **{c: r[c] for c in other}} for r in rows.drop(columns=vector).to_dict("records")]
        yield pd.DataFrame({"value": [json.dumps({"embedding_dim": matrix.shape[1], "data": data, "matrix": base64.b64encode(matrix.tobytes()).decode()}, ensure_ascii=False)]})

    vectors.repartition(stores, key).sortWithinPartitions(key).mapInPandas(pack, "value string").write.text(path)


def write_usage(usage: DataFrame, path: str, document: str = "graph_id") -> bool:
    """Calls and tokens of each document and operation, with totals, as a table; nothing without a call."""
    if usage.isEmpty():
        return False
    write_table(stats.usage(usage, document), path)
    return True
