"""Vector tables: normalising, upserts, cosine top-k, all-pairs similarity, retrieval.

Scores are computed in double precision by matrix products over blocks. A query set is
a block structure of its own: its rows are dealt to blocks of bounded size, and every block
meets the vectors of its own graph or item, with a top-k before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.arrow import unit_batch, unit_rows
from lodestone.functions.models import lexical, pieces

BLOCK = 1024
#: Vectors of a block of all-pairs similarity, at most; a block of 64 dimensions is 8 MB.
PAIR_BLOCK = 16384
#: Cosines that a task holds at once (8 MB).
STRIP = 1 << 20
#: Cosines this near to a threshold are summed anew, as cosines() sums them, so that every plan decides alike.
SLACK = 1e-9


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """Unit vector; components of a zero vector become NaN."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x.cast("double") / n))


def upsert_vectors(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both tables; of those with one key, the last of ``new`` by ``version``."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in new.columns if c != key]), version).alias("x")).select(key, "x.*").select(*new.columns)
    return old.select(*new.columns).join(last, key, "left_anti").unionByName(last)


def get_by_id(vectors: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return vectors.join(ids, key, "left_semi")


def delete_by_id(vectors: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return vectors.join(ids, key, "left_anti")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = None, key: str = "vec_id", query: str = "query_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """query, key, score, rank: each query's k nearest by cosine, ties to the smaller key;
    nothing below ``threshold``.

    The queries' table goes through the driver in blocks of ``block`` rows; each block is
    broadcast and makes one pass over the vectors that keeps k rows for each query and Arrow
    batch, so what is shuffled is k rows a query and batch."""
    spark = vectors.sparkSession
    out = None
    held: list = []
    rows = queries.select(F.col(query).alias("q"), F.col(vector).alias("v")).orderBy("q").toLocalIterator()
    schema = f"{query} {dict(queries.dtypes)[query]}, {key} {dict(vectors.dtypes)[key]}, score double"

    def scan(block_rows: list) -> DataFrame:
        shared = spark.sparkContext.broadcast(([r.q for r in block_rows], unit_rows([r.v for r in block_rows])))

        def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            for pdf in batches:
                if len(pdf):
                    s = unit_rows(pdf[vector]) @ matrix.T
                    ids = pdf[key].to_numpy()
                    for j, name in enumerate(names):
                        order = np.lexsort((ids, -s[:, j]))[:k]
                        yield pd.DataFrame({query: name, key: ids[order], "score": s[order, j]})

        return vectors.select(key, vector).mapInPandas(nearest, schema)

    for row in rows:
        held.append(row)
        if len(held) == block:
            out = scan(held) if out is None else out.unionByName(scan(held))
            held = []
    if held or out is None:
        part = scan(held) if held else spark.createDataFrame([], schema)
        out = part if out is None else out.unionByName(part)
    if threshold is not None:
        out = out.where(F.col("score") >= threshold)
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def cosines(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row, for unit vectors; a row's value doesn't depend on the other rows."""
    return (u * v).sum(axis=1)


def blocks_of(n: int, most: int = PAIR_BLOCK) -> int:
    """Blocks that n vectors are dealt to: enough pairs of blocks for many tasks, none of over ``most``."""
    return max(-(-n // most), min(8, n // 256), 1)


def _dealt(vectors: DataFrame, key: str, vector: str, by: list[str], block: int) -> DataFrame:
    """by, id, v and the vector's own of ``nb`` blocks, by a hash; nb follows the measured size."""
    rows = vectors.select(*by, F.col(key).alias("id"), F.col(vector).alias("v"))
    if by:
        n = F.count("*")
        sizes = vectors.groupBy(*by).agg(F.greatest(F.ceil(n / block), F.least(F.lit(8), F.floor(n / 256)), F.lit(1)).cast("int").alias("nb"))
        rows = rows.join(sizes, by)
    else:
        rows = rows.withColumn("nb", F.lit(blocks_of(vectors.count(), block)))
    return rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))


def similar_pairs(vectors: DataFrame, theta: float, key: str = "vec_id", vector: str = "embedding", graph: str | None = None, block: int = PAIR_BLOCK) -> DataFrame:
    """a < b and weight for all pairs (within ``graph``, if given) with a cosine of theta or more.

    Exact: vectors are dealt to blocks of about ``block`` by a hash, each pair of blocks is
    a matrix product, strip by strip, and only pairs over theta leave it, a strip at a time. The number of blocks of a
    graph follows its measured size; a vector is sent once for each block of its graph, so large
    blocks move less. All pairs is what the result asks for: the work grows with the square of a graph."""
    by = [graph] if graph else []
    rows = _dealt(vectors, key, vector, by, block).withColumn("other", F.explode(F.expr("sequence(0, nb - 1)")))
    rows = rows.select(*by, "id", "v", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    kind = dict(vectors.dtypes)
    schema = ", ".join([*[f"{g} {kind[g]}" for g in by], f"a {kind[key]}", f"b {kind[key]}", "weight double"])
    names = [g for g in by] + ["a", "b", "weight"]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        label = None
        for batch in batches:
            if not batch.num_rows:
                continue
            first = {c: batch.column(c)[0] for c in (*by, "bi", "bj")}
            label, i, j = [first[g] for g in by], first["bi"].as_py(), first["bj"].as_py()
            own = batch.column("own").to_numpy(zero_copy_only=False)
            unit = unit_batch(batch.column("v"))
            for o in {i, j}:
                on = own == o
                parts.setdefault(o, []).append((batch.column("id").filter(pa.array(on)), unit[on]))
        if label is None or i not in parts or j not in parts:
            return
        joined = {o: (pa.concat_arrays([x[0] for x in p]), np.concatenate([x[1] for x in p])) for o, p in parts.items()}
        parts.clear()
        (ids, u), (other, v) = joined[i], joined[j]
        step = max(1, STRIP // max(len(v), 1))
        for lo in range(0, len(u), step):
            s = u[lo : lo + step] @ v.T
            x, y = np.nonzero(s >= theta - SLACK)
            weight = s[x, y]
            close = np.flatnonzero(weight <= theta + SLACK)
            if len(close):
                weight[close] = cosines(u[lo + x[close]], v[y[close]])
                on = weight >= theta
                x, y, weight = x[on], y[on], weight[on]
            a, b = ids.take(pa.array(lo + x)), other.take(pa.array(y))
            less = pc.less(a, b).to_numpy(zero_copy_only=False)
            if i == j:
                a, b, weight = a.filter(pa.array(less)), b.filter(pa.array(less)), weight[less]
            else:
                a, b = pc.if_else(pa.array(less), a, b), pc.if_else(pa.array(less), b, a)
                if len(a):
                    ok = pc.not_equal(a, b)
                    a, b, weight = a.filter(ok), b.filter(ok), weight[ok.to_numpy(zero_copy_only=False)]
            if len(a):
                yield pa.RecordBatch.from_arrays([*[pa.repeat(g, len(a)) for g in label], a, b, pa.array(weight)], names=names)

    return rows.groupBy(*by, "bi", "bj").applyInArrow(product, schema)


def replaced(edges: DataFrame, vectors: DataFrame, theta: float, key: str = "vec_id", vector: str = "embedding", graph: str | None = None) -> DataFrame:
    """(graph,) a, b of the edges that similar_pairs() lists too. No pair is listed for that: the vectors of an edge's
    ends are looked up, so what is shuffled grows with edges and vectors."""
    by = [graph] if graph else []
    of = lambda c: vectors.select(*by, F.col(key).alias(c), F.col(vector).alias(f"v{c}"))
    rows = edges.where("a < b").select(*by, "a", "b").join(of("b"), [*by, "b"]).join(of("a"), [*by, "a"]).select(*by, "a", "b", "va", "vb")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                on = cosines(unit_batch(batch.column("va")), unit_batch(batch.column("vb"))) >= theta
                yield batch.select([*by, "a", "b"]).filter(pa.array(on))

    return rows.mapInArrow(near, rows.select(*by, "a", "b").schema)


def augment(edges: DataFrame, vectors: DataFrame, theta: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Edges with those by similarity put over them: where both have a pair, the similarity edge
    replaces the explicit one. Columns a, b, weight, order, description, source_id. Similar pairs
    are made once and not shuffled."""
    made = similar_pairs(vectors, theta, key, vector).select(
        "a", "b", "weight", F.lit(0).cast("long").alias("order"), F.lit(f"similarity at least {theta}").alias("description"),
        F.concat_ws("<SEP>", F.col("a").cast("string"), F.col("b").cast("string")).alias("source_id"))
    return edges.join(replaced(edges, vectors, theta, key, vector), ["a", "b"], "left_anti").select(*made.columns).unionByName(made)


def checked_threshold(value: float | None, default: float) -> float:
    """The threshold to use: 0 and None fall back to the default; must be in [0, 1]."""
    value = value or default
    if not 0 <= value <= 1:
        raise ValueError("threshold must be between 0 and 1")
    return value


def hybrid(dense: Column, sparse: Column, multi: Column, weights: tuple[float, float, float] = (1.0, 0.3, 1.0)) -> Column:
    return dense * weights[0] + sparse * weights[1] + multi * weights[2]


def ranked(scored: DataFrame, by: list[str], score: str, tie: str, k: int | None = None) -> DataFrame:
    """rank by score, ties to the smaller ``tie``; the first k."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), tie)).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def retrieve_union(hits: DataFrame, item: str, content: str) -> DataFrame:
    """What any query of an item found, once."""
    return hits.select(item, content).distinct()


def hybrid_top(vectors: DataFrame, queries: DataFrame, k: int = 5, weights: tuple[float, float, float] = (1.0, 0.3, 1.0), parts: int = 2, block: int = BLOCK) -> DataFrame:
    """query_id, vec_id, score, rank: each query's k best of all rows by the weighted sum of three
    scores. Rows of both: id, unit vector and lower-cased text (vec_id, u, text; query_id, q, text).
    dense is the dot product; sparse the sum over shared words of both weights (lexical()); multi
    the mean, over the query's ``parts`` sub-vectors, of the best dot product with one of the row's.

    Queries go in broadcast blocks of ``block``; a pass computes the three scores a batch at a time
    and keeps k rows for each query and batch, so neither words nor pairs are shuffled. Scores are ranked
    by nine decimals, ties by the smaller vec_id."""
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"

    def scan(rows: list) -> DataFrame:
        words: dict[str, tuple[list[int], list[float]]] = {}
        for j, r in enumerate(rows):
            for w, x in lexical(r.text).items():
                at, value = words.setdefault(w, ([], []))
                at.append(j)
                value.append(x)
        shared = spark.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.q for r in rows], dtype=np.float64), {w: (np.array(a), np.array(x)) for w, (a, x) in words.items()}))

        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, q, words = shared.value
            qs = np.array_split(q, parts, axis=1)
            # about 2 million scores at once; a part has k rows for each query
            for pdf in pieces(batches, [], rows=max(1, 2 * STRIP // max(len(names), 1))):
                if not len(pdf):
                    continue
                u = np.stack(pdf.u.to_numpy()).astype(np.float64)
                us = np.array_split(u, parts, axis=1)
                score = weights[0] * (u @ q.T) + weights[2] * sum(np.max([x @ y.T for x in us], axis=0) for y in qs) / parts
                for i, text in enumerate(pdf.text):
                    for w, x in lexical(text).items():
                        if w in words:
                            at, value = words[w]
                            score[i, at] += weights[1] * x * value
                key, ids = np.round(score, 9), pdf.vec_id.to_numpy()
                for j, name in enumerate(names):
                    low = np.partition(key[:, j], -k)[-k] if len(ids) > k else -np.inf
                    on = np.flatnonzero(key[:, j] >= low)
                    on = on[np.lexsort((ids[on], -key[on, j]))[:k]]
                    yield pd.DataFrame({"query_id": name, "vec_id": ids[on], "score": score[on, j]})

        return vectors.select("vec_id", "u", "text").mapInPandas(best, schema)

    out, held = None, []
    for row in queries.select("query_id", "q", "text").orderBy("query_id").toLocalIterator():
        held.append(row)
        if len(held) == block:
            out = scan(held) if out is None else out.unionByName(scan(held))
            held = []
    if held or out is None:
        part = scan(held) if held else spark.createDataFrame([], schema)
        out = part if out is None else out.unionByName(part)
    return ranked(out.withColumn("key", F.round("score", 9)), ["query_id"], "key", "vec_id", k).drop("key")
