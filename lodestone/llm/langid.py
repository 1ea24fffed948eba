"""Operator 10: language identification by a byte convolutional network.

Bytes are embedded; filters of several widths slide over fixed-length windows, each filter
is max-pooled over its window, and a softmax layer gives the languages' probabilities. The
network is trained in numpy on the driver from a bounded sample of labelled documents and
broadcast (some 100 kB). A text is cut into windows of ``window`` bytes, all of them are
scored, and the mean of their probabilities, weighted by their letters, is the document's.

The sample: about ``sample_docs`` documents, dealt evenly to all values of ``lang`` but with
``least_docs`` for each (or all that it has), chosen by a hash of doc_id, and ``sample_windows``
windows of each at places that follow from the same hash. Every language with documents to learn
from can be predicted; the sample is bounded by max(sample_docs, least_docs * languages) on average. Only rows whose crc32 of the doc_id isn't
0 modulo 5 are learned from; the others are held out. Nothing but the text is an input.

For scoring, embedding and filters are folded into tables of byte pairs, which gives the
same numbers as the convolution with three look-ups a byte.

Cases: a null text, or one without a letter, is ``und`` with score 0. If no document can be
learned from, every text is ``und`` with score 0. Ties of probability go to the language that
sorts first. Null doc_ids have a null held_out and are never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textops import blocks, text_bytes

WINDOW, SAMPLE_DOCS, SAMPLE_WINDOWS, LEAST_DOCS, STEPS = 256, 2400, 4, 16, 360
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"

#: Letters of either case are one; what is neither an ASCII letter nor part of a longer character is a blank.
FOLD = np.full(256, 32, dtype=np.uint8)
FOLD[97:123] = FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


@dataclass
class ByteNet:
    languages: list[str]
    widths: tuple[int, ...] = (2, 3, 4)
    depth: int = 12
    filters: int = 16
    window: int = WINDOW
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    pair: np.ndarray | None = None
    single: np.ndarray | None = None

    def _start(self, rng: np.random.Generator) -> None:
        w = self.weights
        w["embed"] = rng.normal(0, 0.3, (256, self.depth))
        for k in self.widths:
            w[f"filter{k}"] = rng.normal(0, (k * self.depth) ** -0.5, (k, self.depth, self.filters))
            w[f"shift{k}"] = np.zeros(self.filters)
        n = self.filters * len(self.widths)
        w["out"] = rng.normal(0, n**-0.5, (n, len(self.languages)))
        w["bias"] = np.zeros(len(self.languages))
        for k in w:
            w[k] = w[k].astype(np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = 64, rate: float = 0.004, seed: int = 7) -> "ByteNet":
        """x: windows of folded bytes; y: numbers of languages. Adam on the cross-entropy."""
        rng = np.random.default_rng(seed)
        self._start(rng)
        w = self.weights
        first = {k: np.zeros_like(v) for k, v in w.items()}
        second = {k: np.zeros_like(v) for k, v in w.items()}
        order = np.zeros(0, dtype=np.int64)
        for step in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(x))])
            at, order = order[:batch], order[batch:]
            grad = self._gradient(x[at], y[at])
            pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grad.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                w[k] -= (pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self.folded()

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(x)
        e = w["embed"][x]
        rows = np.arange(n)[:, None]
        pooled, places = [], []
        for k in self.widths:
            t = x.shape[1] - k + 1
            z = sum(e[:, j : j + t].reshape(n * t, -1) @ w[f"filter{k}"][j] for j in range(k)).reshape(n, t, -1)
            place = z.argmax(axis=1)
            places.append(place)
            pooled.append(z[rows, place, np.arange(self.filters)[None, :]] + w[f"shift{k}"])
        h = np.concatenate(pooled, axis=1)
        a = np.maximum(h, 0)
        p = _softmax(a @ w["out"] + w["bias"])
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ w["out"].T) * (h > 0)
        grad = {"out": a.T @ p, "bias": p.sum(axis=0), "embed": np.zeros_like(w["embed"])}
        for i, k in enumerate(self.widths):
            g = back[:, i * self.filters : (i + 1) * self.filters]
            grad[f"shift{k}"] = g.sum(axis=0)
            grad[f"filter{k}"] = np.empty_like(w[f"filter{k}"])
            for j in range(k):
                near = e[rows, places[i] + j]
                grad[f"filter{k}"][j] = np.einsum("nf,nfd->df", g, near)
                np.add.at(grad["embed"], x[rows, places[i] + j].ravel(), (g[:, :, None] * w[f"filter{k}"][j].T[None]).reshape(-1, self.depth))
        return grad

    def folded(self) -> "ByteNet":
        """Tables of byte pairs and bytes in place of embedding and filters."""
        w = self.weights
        part = lambda k, j: w["embed"] @ w[f"filter{k}"][j]
        two = lambda k, j: (part(k, j)[:, None] + part(k, j + 1)[None, :]).reshape(65536, -1)
        self.pair = np.stack([two(2, 0), two(3, 0), two(4, 0), two(4, 2)]).astype(np.float32)
        self.single = part(3, 2).astype(np.float32)
        return self

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """For each window (row of folded bytes), the probability of each language."""
        out, w = [], self.weights
        look = lambda table, at: np.take(table, at, axis=0, mode="clip")
        for i in range(0, len(x), 64):
            # places first: the maximum over them runs along whole rows, and a part stays in the cache
            part = np.ascontiguousarray(x[i : i + 64].T)
            index = part[:-1].astype(np.intp) * 256 + part[1:]
            h2 = look(self.pair[0], index).max(axis=0)
            z = look(self.pair[1], index[:-1])
            z += look(self.single, part[2:])
            h3 = z.max(axis=0)
            z = look(self.pair[2], index[:-2])
            z += look(self.pair[3], index[2:])
            h = np.concatenate([h2 + w["shift2"], h3 + w["shift3"], z.max(axis=0) + w["shift4"]], axis=1)
            out.append(_softmax(np.maximum(h, 0) @ w["out"] + w["bias"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def windows(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of folded bytes, the last of a text filled up with blanks; the text of each."""
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    text = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text] + nth * size
    at = start[:, None] + np.arange(size)[None, :]
    out = FOLD[raw[np.minimum(at, max(0, len(raw) - 1))]] if len(raw) else np.zeros(at.shape, np.uint8)
    out[at >= offsets[1:][text][:, None]] = 32
    return out, text


def sample(docs: DataFrame, sample_docs: int, sample_windows: int, window: int, least_docs: int) -> list[tuple[str, int, str]]:
    """(language, doc_id, window of text), sorted: the bounded training sample."""
    learnable = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").where(
        F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    counts = learnable.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return []
    each = max(least_docs, sample_docs // len(counts))
    share = docs.sparkSession.createDataFrame([(r.lang, min(1.0, each / r.n)) for r in counts], "of string, share double")
    draw = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    room = F.greatest(F.length("text") - F.lit(window) + 1, F.lit(1))
    place = lambda i: F.substring("text", F.pmod(F.xxhash64("doc_id", F.lit("window"), i), room).cast("int") + 1, F.lit(window))
    # a row of ``share`` for each language: as small as the counts that the driver has
    chosen = learnable.select("lang", F.col("doc_id").cast("long").alias("doc_id"), "text", draw.alias("draw")).join(F.broadcast(share), (F.col("lang") == F.col("of")) & (F.col("draw") < F.col("share")))
    rows = chosen.select("lang", "doc_id", F.array_distinct(F.array(*[place(F.lit(i)) for i in range(sample_windows)])).alias("w"))
    return sorted((r.lang, r.doc_id, w) for r in rows.collect() for w in r.w)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS, window: int = WINDOW, least_docs: int = LEAST_DOCS) -> ByteNet | None:
    """The network, or None where nothing can be learned from."""
    rows = sample(docs, sample_docs, sample_windows, window, least_docs)
    parts = [(lang, *text_bytes(pa.array([w]))) for lang, _, w in rows]
    parts = [(lang, raw[:window], np.array([0, min(window, len(raw))])) for lang, raw, _ in parts if len(raw)]
    if not parts:
        return None
    languages = sorted({p[0] for p in parts})
    number = {x: i for i, x in enumerate(languages)}
    x = np.concatenate([windows(raw, off, window)[0] for _, raw, off in parts])
    y = np.array([number[p[0]] for p in parts])
    return ByteNet(languages, window=window).fit(x, y, steps=max(STEPS, 8 * len(languages)))


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: ByteNet | None = shared.value
        if net is not None and net.pair is None:
            net.folded()
        for batch in blocks(batches, "text", 1 << 20):
            n = batch.num_rows
            column = batch.column("text")
            raw, offsets = text_bytes(column)
            best, score = np.array(["und"] * n, dtype=object), np.zeros(n)
            if net is not None and len(raw):
                total, mass = np.zeros((n, len(net.languages))), np.zeros(n)
                step = 1 << 12
                starts = np.concatenate([[0], np.cumsum(-(-np.diff(offsets) // net.window))])
                lo = 0
                while lo < n:
                    hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + step, "right")) - 1)
                    base = offsets[lo]
                    x, text = windows(raw[base : offsets[hi]], offsets[lo : hi + 1] - base, net.window)
                    letters = (x != 32).sum(axis=1)
                    x, text, letters = x[letters > 0], text[letters > 0] + lo, letters[letters > 0]
                    np.add.at(total, text, net.probabilities(x) * letters[:, None])
                    np.add.at(mass, text, letters)
                    lo = hi
                plain = np.zeros(len(raw) + 1, dtype=np.int64)
                np.cumsum((FOLD[raw] != 32) & (raw < 128), out=plain[1:])
                some = plain[offsets[1:]] > plain[offsets[:-1]]
                for i in np.flatnonzero(~some & (mass > 0)):
                    some[i] = any(c.isalpha() for c in column[int(i)].as_py())
                on = np.flatnonzero(some & (mass > 0))
                best[on] = np.array(net.languages, dtype=object)[total[on].argmax(axis=1)]
                score[on] = np.clip(total[on].max(axis=1) / mass[on], 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def _share(docs: DataFrame, net: ByteNet | None):
    """The weights alone (some 100 kB); each worker folds its tables."""
    return docs.sparkSession.sparkContext.broadcast(net and replace(net, pair=None, single=None))


def identify(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """RESULT for each row of ``docs`` (doc_id, text)."""
    shared = _share(docs, net)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).alias("held_out"), "text")
    return rows.mapInArrow(_predict(shared), RESULT)


def _filter(shared, least_score: float, languages: list[str] | None):
    predict = _predict(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", 1 << 20):
            slim = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.bool_()), batch.column("text")], ["doc_id", "held_out", "text"])
            found = pa.Table.from_batches(list(predict(iter([slim]))))
            keep = [lang != "und" and s >= least_score and (languages is None or lang in languages) for lang, s in zip(found.column("lang_pred").to_pylist(), found.column("score").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_languages(docs: DataFrame, net: ByteNet | None, least_score: float = 0.0, languages: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` with a language that is known (and listed, if any are), all columns kept."""
    return docs.mapInArrow(_filter(_share(docs, net), least_score, languages), docs.schema)
