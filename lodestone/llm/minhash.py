"""Operator 8: near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures.

A document is the set of its distinct shingles of ``words`` words. Its signature has
``size`` components, each the low ``bits`` bits of a minimum over one hash order. Documents
with equal sets are one class from the start, so copies cost one row each and no pairs.

Multi-index Hamming join: two signatures that differ in at most r components agree, by
pigeonhole, in one of m chunks but for at most e = 1 component when m * (e + 1) > r. So each
signature is filed once for each chunk and each component of it that may differ (left
out of the key): ``size`` keys a class, and every pair within r meets in a bucket. r lies
``slack`` standard deviations over the mean distance of a pair that just reaches the
similarity, so about one such pair in 30,000 is beyond it; pairs that are more alike are safer.

Buckets are compared in bounded blocks, giving the components of the graph of pairs
within r (only spanning links leave a task). Within such a cluster the texts themselves
meet, again in bounded blocks, and a link is confirmed on the full sets; pairs that are
linked already through others need no test, which changes no component.

Hot groups: a bucket or cluster of more than a block gets a pivot, one of a few candidates, the one that
most of it is near to. Each of its rows meets the pivot first; rows that are linked to it are
connected, and only pairs with a row that isn't are compared. So a large group of near copies
costs as many comparisons as it has rows, and a text is sent twice, not once for every block.

Cases: null and empty texts, and texts of blanks, have no words: n_shingles 0, linked with
nothing. A text of 1 to 4 words has one shingle, its whole sequence. Rows that repeat a doc_id
count as one document. A null doc_id is linked with nothing (component_id null, kept
true). Other columns are kept by deduplicate() and ignored by near_duplicates().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scratch import drop, saved
from lodestone.llm.buckets import block_pairs, grouped, open_pairs, run_pairs, runs, shared_keys
from lodestone.llm.components import components, local_roots
from lodestone.llm.textops import BLANK, U64, Words, blocks, constants, mix, shingles

SIZE, BITS = 64, 8
BLOCK_ROWS, BLOCK_TEXTS, BLOCK_TEXT_BYTES, CANDIDATES = 2048, 512, 8 << 20, 8


def reach(similarity: float, size: int = SIZE, slack: float = 4.0) -> int:
    """r: the largest signature distance that is searched."""
    p = 1 - similarity
    return min(size - 1, math.ceil(size * p + slack * math.sqrt(size * p * (1 - p))))


def sets_of(g: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    return [np.unique(g[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def _sign(size: int, bits: int, words: int):
    factor, shift = constants(size, 11) | U64(1), constants(size, 12)
    kind = np.uint8 if bits == 8 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text"):
            g, at = shingles(Words(batch.column("text"), BLANK), words)
            n = batch.num_rows
            count, high, low = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, s in enumerate(sets_of(g, at)):
                count[i] = len(s)
                high[i] = mix(s + U64(1)).sum().astype(np.int64) if len(s) else 0
                low[i] = mix(s ^ U64(0x5DEECE66D)).sum().astype(np.int64) if len(s) else 0
            some = np.flatnonzero(np.diff(at))
            sig = np.zeros((n, size), dtype=kind)
            if len(some):
                for j in range(size):
                    least = np.minimum.reduceat(g * factor[j] + shift[j], at[:-1][some])
                    sig[some, j] = (mix(least) & U64((1 << bits) - 1)).astype(kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(count), pa.array(high), pa.array(low), pa.array([r.tobytes() for r in sig], pa.binary())],
                ["doc_id", "n_shingles", "high", "low", "sig"],
            )

    return run


def _keys(size: int, bits: int, chunks: int):
    kind = np.uint8 if bits == 8 else np.uint16
    salt = constants(size, 13)
    chunk_of = np.arange(size) * chunks // size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([np.frombuffer(x, kind) for x in batch.column("sig").to_pylist()]).astype(U64)
            each = mix(sig * U64(0x9E3779B1) + salt)
            total = np.zeros((len(sig), chunks), dtype=U64)
            for c in range(chunks):
                total[:, c] = each[:, chunk_of == c].sum(axis=1)
            key = mix(total[:, chunk_of] - each + salt * U64(3)).astype(np.int64)
            node = np.repeat(batch.column("node").to_numpy(), size)
            for i in range(0, key.size, 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()[i : i + (1 << 16)]), pa.array(node[i : i + (1 << 16)])], ["key", "node"])

    return run


def _within(reach_: int, bits: int):
    """Spanning links of the pairs in a bucket whose signatures differ in reach_ components at most."""
    kind = np.uint8 if bits == 8 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["key", "bi", "bj"]):
            node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
            same = t.column("bi").to_numpy() == t.column("bj").to_numpy()
            sig = np.stack([np.frombuffer(x, kind) for x in t.column("sig").to_pylist()])
            left, right = [], []
            for a, b in run_pairs(at):
                use = (same[a] | (own[a] != own[b])) & (node[a] != node[b])
                a, b = a[use], b[use]
                near = (sig[a] != sig[b]).sum(axis=1) <= reach_
                left.append(a[near])
                right.append(b[near])
            a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
            if len(a):
                # by node, so that every bucket of a group links it to the same smallest node
                order = np.argsort(node, kind="stable")
                place = np.empty(len(node), dtype=np.int64)
                place[order] = np.arange(len(node))
                root = order[local_roots(place[a], place[b], len(node))[place]]
                away = np.flatnonzero(node[root] != node)
                pair = np.unique(np.stack([node[away], node[root[away]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    return run


def _near_candidates(reach_: int, bits: int):
    """key, node, mask: the candidates (bits of the mask) whose signatures are within reach of a row's."""
    kind = np.uint8 if bits == 8 else np.uint16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.stack([np.frombuffer(x, kind) for x in batch.column("sig").to_pylist()])
            mask = np.zeros(batch.num_rows, dtype=np.int64)
            for i in range(CANDIDATES):
                other = np.stack([np.frombuffer(x, kind) for x in batch.column(f"sig{i}").to_pylist()])
                mask |= ((sig != other).sum(axis=1) <= reach_).astype(np.int64) << i
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), pa.array(mask)], ["key", "node", "mask"])

    return run


def voted(rows: DataFrame, reach_: int, bits: int, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """key, node, near (to the pivot) for rows (key, node, sig), and key, pivot: the candidate that
    most rows of the key are near to. Candidates follow from hashes; counts are partial aggregates."""
    least = lambda i: F.min(F.struct(F.xxhash64("node", F.lit(i)).alias("h"), "node", "sig"))
    candidates = rows.groupBy("key").agg(*[least(i).alias(f"c{i}") for i in range(CANDIDATES)])
    candidates = candidates.select("key", *[F.col(f"c{i}.node").alias(f"node{i}") for i in range(CANDIDATES)], *[F.col(f"c{i}.sig").alias(f"sig{i}") for i in range(CANDIDATES)])
    candidates = saved(candidates, "candidates", paths)
    tested = rows.select("key", "node", "sig").join(candidates.select("key", *[f"sig{i}" for i in range(CANDIDATES)]), "key")
    tested = saved(tested.mapInArrow(_near_candidates(reach_, bits), "key long, node long, mask long"), "tested", paths)
    bit = lambda i: F.getbit("mask", F.lit(i)).cast("long")
    votes = tested.groupBy("key").agg(F.greatest(*[F.struct(F.sum(bit(i)).alias("n"), F.lit(i).alias("i")) for i in range(CANDIDATES)]).alias("x"))
    best = votes.join(candidates, "key").select("key", F.col("x.i").alias("i"), F.get(F.array(*[f"node{i}" for i in range(CANDIDATES)]), F.col("x.i")).alias("pivot"))
    best = saved(best, "pivots", paths)
    near = tested.join(best.select("key", "i"), "key").select("key", "node", (F.getbit("mask", F.col("i")) == 1).alias("near"))
    return near, best.select("key", "pivot")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted arrays without repeats."""
    n, m = len(x), len(y)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (n + m - common)


def _confirm(reach_: int, percent: int, words: int, size: int, bits: int):
    """Spanning links between the texts of a group, confirmed on their full sets."""
    factor, shift = constants(size, 11) | U64(1), constants(size, 12)
    low = U64((1 << bits) - 1)

    def signature(s: np.ndarray) -> np.ndarray:
        if len(s) < 4096:
            return mix((s[None, :] * factor[:, None] + shift[:, None]).min(axis=1)) & low
        return mix(np.array([(s * f + g).min() for f, g in zip(factor, shift)], dtype=U64)) & low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in runs(batches, ["cluster", "bi", "bj"]):
            for lo, hi in zip(at[:-1], at[1:]):
                part = t.slice(lo, hi - lo).combine_chunks()
                node, own = part.column("node").to_numpy(), part.column("own").to_numpy()
                same = bool(part.column("bi")[0].as_py() == part.column("bj")[0].as_py())
                sets: list[np.ndarray] = []
                for b in blocks(iter(part.select(["text"]).to_batches()), "text"):
                    sets += sets_of(*shingles(Words(b.column("text"), BLANK), words))
                sig = np.stack([signature(s) for s in sets])
                parent = list(range(len(sets)))

                def find(i: int) -> int:
                    while parent[i] != i:
                        parent[i] = parent[parent[i]]
                        i = parent[i]
                    return i

                n_of = np.array([len(s) for s in sets])
                for i in range(len(sets)):
                    rest = np.arange(i + 1, len(sets))
                    if not same:
                        rest = rest[own[rest] != own[i]]
                    if not len(rest):
                        continue
                    far = (sig[rest] != sig[i]).sum(axis=1)
                    ok = (far <= reach_) & (100 * np.minimum(n_of[rest], n_of[i]) >= percent * np.maximum(n_of[rest], n_of[i])) & (node[rest] != node[i])
                    rest = rest[ok][np.argsort(far[ok], kind="stable")]
                    for j in rest.tolist():
                        p, q = find(i), find(j)
                        if p != q and linked(sets[i], sets[j], percent):
                            parent[max(p, q)] = min(p, q)
                pair = sorted({(int(node[i]), int(node[find(i)])) for i in range(len(sets)) if find(i) != i})
                if pair:
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pair], pa.int64()), pa.array([p[1] for p in pair], pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = 5, size: int = SIZE, bits: int = BITS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    paths: list[str] = []
    r = reach(percent / 100, size)
    chunks = r // 2 + 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = saved(texts.mapInArrow(_sign(size, bits, words), "doc_id long, n_shingles long, high long, low long, sig binary"), "signed", paths)
    known = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("high", "low", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("x")).select(
        "high", "low", "n_shingles", F.col("x.doc_id").alias("node"), F.col("x.sig").alias("sig"))
    classes = saved(classes, "classes", paths)
    keys = classes.select("node", "sig").mapInArrow(_keys(size, bits, chunks), "key long, node long")
    buckets = saved(shared_keys(keys, ["key"]), "buckets", paths)
    # a sort-merge join at every size: adaptive execution splits it where a key is hot
    rows = keys.join(buckets.hint("merge"), "key").join(classes.select("node", "sig"), "node").select("key", "node", "sig", "n")
    met = ["key", "node", "sig"]
    pairs = block_pairs(rows.where(F.col("n") <= BLOCK_ROWS).select(*met), ["key"], "node", F.lit(1))
    hot = buckets.where(F.col("n") > BLOCK_ROWS)
    stars = None
    if not hot.isEmpty():
        rows = saved(keys.join(hot.hint("merge"), "key").join(classes.select("node", "sig"), "node").select(*met), "hot", paths)
        near, pivots = voted(rows, r, bits, paths)
        near = saved(near, "near_pivot", paths)
        stars = near.where("near").join(pivots, "key").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        left = rows.join(near.select("key", "node", (~F.col("near")).alias("rest")), ["key", "node"])
        pairs = pairs.unionByName(open_pairs(left, ["key"], "node", "rest", F.lit(BLOCK_ROWS)).drop("rest"))
    near = grouped(pairs.select("key", "bi", "bj", "node", "own", "sig"), ["key", "bi", "bj"]).mapInArrow(_within(r, bits), "a long, b long")
    clusters = components(near if stars is None else near.unionByName(stars), paths)
    members = clusters.select("node", F.col("root").alias("cluster")).unionByName(
        clusters.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    members = saved(members, "members", paths)
    sizes = members.join(classes.select("node", "n_shingles"), "node").groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("volume"))
    nb = F.greatest(F.ceil(F.col("n") / BLOCK_TEXTS), F.ceil(F.col("volume") * 8 / BLOCK_TEXT_BYTES)).cast("int")
    sized = saved(members.join(sizes, "cluster").select("node", "cluster", nb.alias("nb"), F.ceil(F.col("n") / nb).alias("per")), "sized", paths)
    # classes of one doc_id can differ in text; each text of a class's first document comes along.
    # The one shuffle of all texts, by merge at every size; what follows moves texts of members only
    found = texts.where("doc_id IS NOT NULL AND text IS NOT NULL").join(sized.hint("merge"), texts.doc_id == F.col("node")).select("node", "cluster", "nb", "per", "text")
    schema, by = "a long, b long", ["cluster", "bi", "bj"]
    confirm = lambda df: grouped(df.select(*by, "node", "own", "text"), by).mapInArrow(_confirm(r, percent, words, size, bits), schema)
    many = sized.where("nb > 1")
    if many.isEmpty():
        links = confirm(block_pairs(found.drop("nb", "per"), ["cluster"], "node", F.lit(1)))
    else:
        found = saved(found, "members_texts", paths)
        few = confirm(block_pairs(found.where("nb = 1").drop("nb", "per"), ["cluster"], "node", F.lit(1)))
        large = found.where("nb > 1")
        signed_members = many.select(F.col("cluster").alias("key"), "node").join(classes.select("node", "sig"), "node")
        # near enough that most of the cluster will be linked to the pivot
        _, pivots = voted(saved(signed_members, "signed_members", paths), round(size * (1 - percent / 100)), bits, paths)
        large = large.join(pivots.withColumnRenamed("key", "cluster"), "cluster")
        at = F.when(F.col("node") == F.col("pivot"), F.expr("sequence(0, nb - 1)")).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")))
        star = large.withColumn("bi", F.explode(at)).withColumn("bj", F.col("nb")).withColumn("own", F.when(F.col("node") == F.col("pivot"), F.col("nb")).otherwise(F.col("bi")))
        star = saved(confirm(star), "stars", paths)
        done = star.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("rest", F.lit(False))
        left = large.drop("nb").join(done, "node", "left").withColumn("rest", F.coalesce("rest", F.col("node") != F.col("pivot")))
        links = few.unionByName(star).unionByName(confirm(open_pairs(left.drop("pivot"), ["cluster"], "node", "rest", F.col("per"))))
    # documents of one set are linked through the class, and classes through one doc_id
    roots = components(links, paths)
    roots = classes.select("high", "low", "n_shingles", "node").join(roots, "node", "left").select(
        "high", "low", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    out = signed.drop("sig").join(roots, ["high", "low", "n_shingles"], "left")
    out = out.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = saved(out, "near")  # a few numbers a row; all other tables go
    drop(spark, *paths)
    return out


def deduplicate(docs: DataFrame, percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, all columns kept."""
    gone = near_duplicates(docs, percent, words).where("NOT kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs.doc_id.cast("long") == gone._gone, "left_anti")
