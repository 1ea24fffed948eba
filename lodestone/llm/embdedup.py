"""Operator 5: near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Iterative quantisation: from a bounded sample of unit vectors, rotations are learned
that bring the rotated vectors near to their signs (alternating the signs and the orthogonal
Procrustes solution). They are learned from centred vectors, but a vector's code is the signs
of its rotated coordinates as they are: seen from the mean, near vectors lie at wider angles than
their cosine says.

Multi-index Hamming tables: each rotation, learned from another start, gives 64 bits, which are cut
into two parts of 32; each part is a table, and two vectors meet where a whole part agrees. Two
whose codes differ in fewer bits than there are tables meet for certain (pigeonhole); how many
of those that differ in more do is a matter of chance, and of the number of tables.
That number follows from ``cosine`` and ``recall`` alone: rotations() has as many as find a pair
at the threshold with a chance of ``recall`` by the distribution of its differing bits, and enough()
measures it on pairs made at the threshold from the sample, in any direction and in the directions
in which the vectors differ, and adds rotations, ``MOST`` at most, until it holds. Closer pairs are found with a
greater chance. Neither depends on how many vectors there are. A key has 32 bits for each label, so
buckets begin to fill by chance beyond some 10^9 vectors of one label, which costs time and loses nothing; so
does a large common mean, by which vectors share bits. Candidates of a bucket are reranked with the
original vectors in double precision; a pair that meets in several tables counts in the first.

Buckets (within one label) are compared in bounded blocks, so a hot group is spread over
tasks; what leaves a task are sums of links for each vector and links that span what is
connected, never the pairs. Equal vectors of a label are one class with their number, compared
once and counted for all. Rows whose bucket holds nobody within reach are dropped before
their vectors are sent.

Cases: null, empty and zero vectors, vectors with null or non-finite components, and rows with
a null label or vec_id link with nothing: n_links 0, component_id their own vec_id, kept true.
Vectors of different lengths don't link. Rows that repeat a vec_id and vector are counted
as one vector each. Other columns are ignored. An empty table has an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scratch import drop, saved
from lodestone.llm.buckets import block_pairs, grouped, run_pairs, runs, shared_keys
from lodestone.llm.components import components, local_roots
from lodestone.llm.textops import U64, mix

BITS, RECALL, SAMPLE, BLOCK = 64, 0.99, 20_000, 1024
#: Bits of a table's part; the most rotations: a key has 8 bits for its table.
PART, MOST, PAIRS = 32, 40, 4000
_TABLE = 8


def rotations(cosine: float, recall: float = RECALL) -> int:
    """Rotations whose tables find ``recall`` of the pairs at the threshold, by chance."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    found = (1 - p) ** PART
    tables = 1 if found >= recall else math.ceil(math.log(1 - recall) / math.log(1 - found))
    return min(MOST, math.ceil(tables * PART / BITS))


class Rotation:
    """The learned rotation: ``codes`` gives unsigned 64-bit codes of unit vectors."""

    def __init__(self, dim: int, bits: int = BITS, rounds: int = 12, seed: int = 3):
        self.dim, self.bits, self.rounds = dim, bits, rounds
        rng = np.random.default_rng(seed)
        # longer codes than dimensions need several rotations side by side
        self.parts = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-bits // dim))]

    def fit(self, x: np.ndarray) -> "Rotation":
        if len(x) < self.dim:
            return self
        x = (x - x.mean(axis=0)).astype(np.float32)
        for i, r in enumerate(self.parts):
            for _ in range(self.rounds):
                u, _, v = np.linalg.svd(x.T @ np.where(x @ r.astype(np.float32) >= 0, np.float32(1), np.float32(-1)))
                r = u @ v
            self.parts[i] = r
        return self

    def codes(self, x: np.ndarray) -> np.ndarray:
        signs = x @ np.concatenate(self.parts, axis=1)[:, : self.bits] >= 0
        out = np.zeros(len(x), dtype=U64)
        for i in range(self.bits):
            out |= signs[:, i].astype(U64) << U64(i)
        return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow of squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _code(shared):
    """(label, node, dim, code): the codes of all rotations, end to end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotations: dict[int, list[Rotation]] = shared.value
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            dims = np.array([len(x) // 8 for x in raw], dtype=np.int32)
            out: list[bytes] = [b""] * len(raw)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                vector = np.frombuffer(b"".join(raw[i] for i in at), "<f8").reshape(len(at), -1)
                for i, c in zip(at, np.stack([r.codes(vector) for r in rotations[int(dim)]], axis=1)):
                    out[i] = c.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("node"), pa.array(dims), pa.array(out, pa.binary())], ["label", "node", "dim", "code"])

    return run


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node): a row for each table, the number of the table in the key's low bits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts, node = _codes(batch.column("code")).view(np.uint32).astype(U64), batch.column("node").to_numpy()
        salt = mix(batch.column("label").to_numpy().astype(np.int64).astype(U64) * U64(0x9E3779B97F4A7C15) + batch.column("dim").to_numpy().astype(U64))
        table = np.arange(parts.shape[1], dtype=U64)
        for lo in range(0, len(parts), 2048):
            s = slice(lo, lo + 2048)
            keys = (mix(parts[s] ^ mix(salt[s, None] + table + U64(1))) << U64(_TABLE)) | table
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().astype(np.int64)), pa.array(np.repeat(node[s], len(table)))], ["key", "node"])


def _codes(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), dtype=U64).reshape(len(raw), -1)


def _counts_here(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether pairs with code differences x (a column for each rotation) agree in this table's
    part and in no earlier one."""
    same = np.ascontiguousarray(x).view(np.uint32) == 0
    return same[np.arange(len(x)), table] & (same.argmax(axis=1) == table)


def _candidates(at, code, table, own, same) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for a, b in run_pairs(at):
        use = same[a] | (own[a] != own[b])
        a, b = a[use], b[use]
        for i in range(0, len(a), 1 << 15):
            p, q = a[i : i + (1 << 15)], b[i : i + (1 << 15)]
            use = _counts_here(code[p] ^ code[q], table[p])
            yield p[use], q[use]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block that meet somebody for the first time: (key, node, code)."""
    for t, at in runs(batches, ["key", "bi", "bj"]):
        own, key, node = (t.column(c).to_numpy() for c in ("own", "key", "node"))
        same = t.column("bi").to_numpy() == t.column("bj").to_numpy()
        met = np.zeros(len(node), dtype=bool)
        for a, b in _candidates(at, _codes(t.column("code")), key & ((1 << _TABLE) - 1), own, same):
            met[a] = met[b] = True
        on = np.flatnonzero(met)
        code = t.column("code").take(pa.array(on)).combine_chunks()
        yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(node[on]), code], ["key", "node", "code"])


def _rerank(cosine: float):
    """For each node of a block: links found in it, and a link that spans (to: the smallest node
    connected in this block, or the node itself)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["key", "bi", "bj"]):
            own, node, many = (t.column(c).to_numpy() for c in ("own", "node", "many"))
            table = t.column("key").to_numpy() & ((1 << _TABLE) - 1)
            same = t.column("bi").to_numpy() == t.column("bj").to_numpy()
            raw = t.column("vector").to_pylist()
            width = np.array([len(x) for x in raw])
            vector = np.zeros((len(raw), width.max() // 8))
            for w in np.unique(width):  # a bucket has vectors of one length, a table of buckets may have more
                on = np.flatnonzero(width == w)
                vector[on, : w // 8] = np.frombuffer(b"".join(raw[i] for i in on), "<f8").reshape(len(on), -1)
            links = np.zeros(len(node), dtype=np.int64)
            left, right = [], []
            for a, b in _candidates(at, _codes(t.column("code")), table, own, same):
                near = np.empty(len(a), dtype=bool)
                for i in range(0, len(a), 8192):
                    s = slice(i, i + 8192)
                    near[s] = np.einsum("ij,ij->i", vector[a[s]], vector[b[s]]) >= cosine
                a, b = a[near], b[near]
                np.add.at(links, a, many[b])
                np.add.at(links, b, many[a])
                left.append(a)
                right.append(b)
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            order = np.argsort(node, kind="stable")  # so that the smallest index is the smallest node
            place = np.empty(len(node), dtype=np.int64)
            place[order] = np.arange(len(node))
            root = order[local_roots(place[a], place[b], len(node))[place]]
            on = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(links[on]), pa.array(node[root[on]])], ["node", "links", "to"])

    return run


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, vector (unit, as bytes of doubles; null if it links with nothing)."""
    for batch in batches:
        out: list[bytes | None] = []
        for v, lab, i in zip(batch.column("embedding"), batch.column("label"), batch.column("vec_id")):
            x = v.values if v.is_valid else None
            if x is None or not len(x) or x.null_count or not lab.is_valid or not i.is_valid:
                out.append(None)
                continue
            x = x.to_numpy(zero_copy_only=False).astype(np.float64)
            out.append(_unit(x[None, :])[0].astype("<f8").tobytes() if np.isfinite(x).all() and x.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])


def threshold_pairs(x: np.ndarray, cosine: float, n: int = PAIRS, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Two sets of n pairs (unit vectors of x, others at just that cosine): apart in any direction, and in
    the directions in which vectors of x differ."""
    rng, found = np.random.default_rng(seed), []
    a = x[rng.integers(0, len(x), n)]
    for away in (rng.normal(size=a.shape), x[rng.integers(0, len(x), n)] - x[rng.integers(0, len(x), n)]):
        away = away - (away * a).sum(axis=1, keepdims=True) * a
        size = np.linalg.norm(away, axis=1, keepdims=True)
        on = size[:, 0] > 1e-9
        if on.any():
            found.append((a[on], cosine * a[on] + math.sqrt(max(0.0, 1 - cosine**2)) * away[on] / size[on]))
    return found


def enough(samples: dict[int, np.ndarray], cosine: float, recall: float = RECALL) -> dict[int, list[Rotation]]:
    """rotations() for each length or as many more, alike for all, as find ``recall`` of threshold_pairs()."""
    made: dict[int, list[Rotation]] = {d: [] for d in samples}
    tests = [(d, a, b, np.zeros(len(a), dtype=bool)) for d, x in samples.items() if len(x) for a, b in threshold_pairs(x, cosine)]
    least = rotations(cosine, recall)
    for i in range(MOST):
        if i >= least and all(met.mean() >= recall for *_, met in tests):
            break
        for d, x in samples.items():
            made[d].append(Rotation(d, seed=3 + i).fit(x))
        for d, a, b, met in tests:
            differ = made[d][-1].codes(a) ^ made[d][-1].codes(b)
            met |= (differ.view(np.uint32).reshape(-1, 2) == 0).any(axis=1)
    return made


def learn(unit: DataFrame, cosine: float, sample: int = SAMPLE, recall: float = RECALL) -> dict[int, list[Rotation]]:
    """Rotations for each vector length, from about ``sample`` vectors at most, chosen by a hash of
    vec_id; lengths that the sample lacks get rotations that nothing was learned for."""
    dims = [r.d for r in unit.where("vector IS NOT NULL").select((F.octet_length("vector") / 8).cast("int").alias("d")).distinct().collect()]
    total = unit.where("vector IS NOT NULL").count()
    share = min(1.0, sample / total) if total else 0.0
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = unit.where(F.col("vector").isNotNull() & (draw < share)).select("vec_id", "vector").collect()
    by: dict[int, list] = {d: [] for d in dims}
    for r in sorted(rows, key=lambda r: (r.vec_id, bytes(r.vector))):
        by[len(r.vector) // 8].append(np.frombuffer(r.vector, "<f8"))
    return enough({d: np.stack(v) if v else np.zeros((0, d)) for d, v in by.items()}, cosine, recall)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    paths: list[str] = []
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    unit = saved(rows.mapInArrow(_prepare, "vec_id long, label long, vector binary"), "unit", paths)
    # equal vectors of a label are one class; its node is its smallest vec_id
    hashed = unit.withColumn("same", F.when(F.col("vector").isNotNull(), F.sha1("vector")))
    classes = hashed.where("vector IS NOT NULL").groupBy("label", "same").agg(F.min(F.struct("vec_id", "vector")).alias("x"), F.count("*").alias("many"))
    classes = saved(classes.select("label", "same", F.col("x.vec_id").alias("node"), F.col("x.vector").alias("vector"), "many"), "classes", paths)
    shared = spark.sparkContext.broadcast(learn(unit, cosine, sample, recall))
    coded = saved(classes.select("label", "node", "vector").mapInArrow(_code(shared), "label long, node long, dim int, code binary"), "coded", paths)
    filed = coded.mapInArrow(_file, "key long, node long")
    blocks = F.ceil(F.col("n") / BLOCK)
    rows = filed.join(shared_keys(filed, ["key"]).hint("merge"), "key").join(coded.select("node", "code"), "node")
    rows = grouped(block_pairs(rows.select("key", "node", "code", "n"), ["key"], "node", blocks), ["key", "bi", "bj"])
    # a node of a large bucket can meet somebody in several pairs of blocks
    met = rows.mapInArrow(_meet, "key long, node long, code binary").dropDuplicates(["key", "node"])
    met = saved(met, "met", paths)
    full = block_pairs(met.join(shared_keys(met, ["key"]), "key"), ["key"], "node", blocks).join(classes.select("node", "vector", "many"), "node")
    found = grouped(full.select("key", "bi", "bj", "node", "own", "code", "vector", "many"), ["key", "bi", "bj"])
    found = saved(found.mapInArrow(_rerank(cosine), "node long, links long, to long"), "found", paths)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")).distinct(), paths)
    per_class = classes.select("label", "same", "node", "many").join(counts, "node", "left").join(roots, "node", "left")
    per_class = per_class.select("label", "same", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    out = hashed.select("vec_id", "label", "same").join(per_class, ["label", "same"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    out = saved(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "near")
    drop(spark, *paths)
    return out
