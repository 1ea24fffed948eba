"""Operator 6: benchmark passages in documents, by winnowed fingerprints.

Winnowing: of each ``window`` - k + 1 k-gram hashes in a row, the smallest is a fingerprint
(the rightmost of equals). Any span of ``window`` words or more that a document shares with
an item then holds a fingerprint that both have. Documents are read once: fingerprints that
an item has too are found by a join with the items' fingerprints, and each hit is extended
to the windows around it, which are compared by two independent 64-bit hashes. An item of
fewer words than ``window`` is one window of its own length and is looked for at every place.

The items come to the documents in blocks of about ``block_words`` words, cut between rows or, in
a row that is longer, between words: pieces of a text overlap by ``window`` - 1 words, so that they
have its windows and no others. So what the driver holds and broadcasts is bounded whatever the
benchmark's size and whatever rows share an item_id; a benchmark of one block needs one pass
without a shuffle, a larger one a pass for each block and a merge of the hits.

Cases: null text has no words; a text without words is clean (n_words 0, items_sha256 of
the empty string). Items without words never occur. Items that repeat a passage each count.
Rows that repeat an item_id count once, with all their windows; a null item_id counts as
an item named ''. Repeated documents each get a row. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scratch import drop, saved
from lodestone.llm.textops import NOT_WORD, U64, Words, blocks, grams

WINDOW, GRAM, BLOCK_WORDS = 10, 5, 1 << 20
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def fingerprints(g: np.ndarray, left: np.ndarray, k: int, window: int) -> np.ndarray:
    """Places of the winnowed k-grams. g: hash of the k-gram at each word; left: words
    that its text has from there."""
    w = window - k + 1
    places = np.flatnonzero(left >= window)
    if not len(places):
        return places
    best, value = places.copy(), g[places]
    for j in range(1, w):
        here = g[places + j]
        take = here <= value
        best[take] = places[take] + j
        value = np.where(take, here, value)
    return np.unique(best)


class Items:
    """A block of items: fingerprints, windows by length, and which items have each window."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int, k: int):
        words = Words(pa.array(texts, pa.string()), NOT_WORD)
        one, two = words.hashes(1), words.hashes(2)
        left, text_of = words.left(), np.repeat(np.arange(len(texts)), words.n_words)
        names = sorted(set(ids))
        number = {x: i for i, x in enumerate(names)}
        item_of = np.array([number[x] for x in ids], dtype=np.int64)[text_of] if len(text_of) else np.zeros(0, np.int64)
        self.names, self.window, self.k = names, window, k
        self.prints = np.unique(grams(one, k)[fingerprints(grams(one, k), left, k, window)])
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in sorted({min(int(n), window) for n in words.n_words if n}):
            whole = words.n_words[text_of] if len(text_of) else np.zeros(0, np.int64)
            at = np.flatnonzero((left >= size) & ((whole >= window) if size == window else (whole == size)))
            a, b = grams(one, size)[at], grams(two, size)[at]
            rows = np.unique(np.stack([a, b, item_of[at].astype(U64)], axis=1), axis=0)
            new = np.ones(len(rows), dtype=bool)
            new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
            start = np.flatnonzero(new)
            self.windows[size] = (rows[start, 0], rows[start, 1], np.append(start, len(rows)), rows[:, 2].astype(np.int64))

    def find(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows that occur: their first word, their length, and (place in these, item) pairs."""
        one, left = words.hashes(1), words.left()
        two: np.ndarray | None = None
        starts, sizes, owners, items, n = [], [], [], [], 0
        for size, (first, second, at, item) in self.windows.items():
            if size == self.window:
                g = grams(one, self.k)
                hit = fingerprints(g, left, self.k, self.window)
                hit = hit[np.isin(g[hit], self.prints)]
                around = np.unique((hit[:, None] - np.arange(self.window - self.k + 1)[None, :]).ravel())
                around = around[around >= 0]
            else:
                around = np.arange(len(one))
            around = around[left[around] >= size]
            a = grams(one, size)[around]
            low, high = np.searchsorted(first, a, "left"), np.searchsorted(first, a, "right")
            on = np.flatnonzero(high > low)
            if not len(on):
                continue
            if two is None:
                two = words.hashes(2)
            b = grams(two, size)[around[on]]
            for step in range(int((high[on] - low[on]).max())):
                slot = low[on] + step
                ok = (slot < high[on]) & (second[np.minimum(slot, len(second) - 1)] == b)
                place, slot = around[on[ok]], slot[ok]
                starts.append(place)
                sizes.append(np.full(len(place), size))
                many = at[slot + 1] - at[slot]
                owners.append(np.repeat(n + np.arange(len(place)), many))
                items.append(item[np.repeat(at[slot] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())] if len(place) else np.zeros(0, np.int64))
                n += len(place)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(starts), join(sizes), join(owners), join(items)


def _covered(n: int, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + sizes, -1)
    return np.cumsum(change[:-1]) > 0


def _digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


def _scan(shared, full: bool):
    """full: a result row for each document; else (key, hit words, items) of those with hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in blocks(batches, "text"):
            words = Words(batch.column("text"), NOT_WORD)
            starts, sizes, owners, item = items.find(words)
            hit = _covered(len(words.start), starts, sizes)
            n_hit = np.add.reduceat(np.append(hit, False).astype(np.int64), words.word_at[:-1]) * (words.n_words > 0)
            doc = np.searchsorted(words.word_at, starts[owners], side="right") - 1 if len(owners) else np.zeros(0, np.int64)
            pair = np.unique(np.stack([doc, item], axis=1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
            cut = np.searchsorted(pair[:, 0], np.arange(batch.num_rows + 1))
            found = [[items.names[x] for x in pair[a:b, 1]] for a, b in zip(cut[:-1], cut[1:])]
            if full:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(words.n_words.astype(np.int64)), pa.array(n_hit), pa.array([len(x) for x in found], pa.int64()),
                     pa.array([_digest(x) for x in found]), pa.array(n_hit > 0)],
                    ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])
            else:
                on = np.flatnonzero(n_hit)
                at = [np.flatnonzero(hit[words.word_at[i] : words.word_at[i + 1]]).tolist() for i in on]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(on)), pa.array(at, pa.list_(pa.int64())), pa.array([found[i] for i in on], pa.list_(pa.string()))],
                    ["key", "hits", "items"])

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        n = Words(batch.column("text"), NOT_WORD).n_words
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(n.astype(np.int64))], ["doc_id", "key", "n_words"])


def pieces(text: str | None, block_words: int, window: int) -> list[str | None]:
    """The text, or parts of about ``block_words`` words that have all of its windows. A text is cut
    only where both parts have ``window`` words."""
    if text is None or len(text) <= 2 * block_words:
        return [text]
    w = _WORD.findall(text.translate(_LOWER))
    step = max(block_words, window)
    return [" ".join(w[i : i + step + window - 1]) for i in range(0, max(1, len(w) - window + 1), step)]


def item_blocks(benchmark: DataFrame, block_words: int, window: int = WINDOW) -> Iterator[tuple[list[str], list[str | None]]]:
    """Items in blocks; only the block at hand is on the driver."""
    ids: list[str] = []
    texts: list[str | None] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").distinct().orderBy("i")
    for row in rows.toLocalIterator():
        for text in pieces(row.text, block_words, window):
            n = len(text or "") // 2 + 1
            if size and size + n > block_words:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(row.i)
            texts.append(text)
            size += n
    yield ids, texts


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """RESULT for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = item_blocks(benchmark, block_words, window)
    first, more = next(parts), next(parts, None)
    if more is None:
        shared = spark.sparkContext.broadcast(Items(*first, window, k))
        return texts.mapInArrow(_scan(shared, True), RESULT)
    keyed = texts.withColumn("key", F.md5(F.to_json(F.struct("doc_id", "text"))))
    hits = None
    while first is not None:
        shared = spark.sparkContext.broadcast(Items(*first, window, k))
        part = keyed.mapInArrow(_scan(shared, False), "key string, hits array<long>, items array<string>")
        hits = part if hits is None else hits.unionByName(part)
        first, more = more, next(parts, None)
    merged = hits.groupBy("key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("hits")))).cast("long").alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    counted = keyed.mapInArrow(_count, "doc_id long, key string, n_words long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(merged, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _clean(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for batch in blocks(batches, "text"):
            words = Words(batch.column("text"), NOT_WORD)
            starts = items.find(words)[0]
            keep = np.ones(batch.num_rows, dtype=bool)
            keep[np.searchsorted(words.word_at, starts, side="right") - 1] = False
            yield batch.filter(pa.array(keep))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, all columns kept: one pass without
    a shuffle for each block of items."""
    spark = docs.sparkSession
    paths: list[str] = []
    for i, block in enumerate(item_blocks(benchmark, block_words, window)):
        if i:
            docs = saved(docs, "clean", paths)
            drop(spark, *paths[:-1])
            del paths[:-1]
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(Items(*block, window, k))), docs.schema)
    return docs
