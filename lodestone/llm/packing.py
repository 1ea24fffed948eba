"""Operator 7: pack tokenised documents into windows by non-negative least squares.

A document is its token ids and one end id; pieces of a whole window are cut off its front,
and what remains (1 to window - 1 ids) is packed. Lengths are rounded up to a multiple of
``quantum``. The shallow combinations that fill a window are enumerated: two or three
lengths, or copies of one length and at most one more. The repeat counts x >= 0 that come
nearest to the histogram of lengths (least squares, by the active-set method) are rounded,
largest first and within what is there. Residual pieces go greedily, longest first, to the
fullest sequence with room, and the sequences that stay under ``full`` are joined end to end
and cut at the window, so only one sequence of a block is short; it is cut into powers
of two, which need no padding.

The work is done in blocks of ``block_tokens`` ids as the rows of a partition come by: a
block's histogram is solved and its sequences are written before the next begins. So memory
is bounded however large a partition is, there is no shuffle, and a task that is lost is run
again alone. Sequence ids are partition number * 2 ** 40 + a running number.

Cases: null and empty texts have the end id alone; very long texts are tokenised a megabyte
at a time, cut at blanks; repeated rows are packed each, and a null doc_id stays null. Other
columns are ignored. An empty table has no pieces.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, QUANTUM, BLOCK_TOKENS, END_ID = 4096, 32, 6_000_000, 2
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CACHE_WORDS, _SLICE = 250_000, 1 << 20
#: A run of letters, and the run of signs after it, are tokens of their own (but for apostrophes).
_TAILED = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:;?@\[-`{-~]+)")
_LATIN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: Words of these letters in lower case are one token run that no rule but the merges changes.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _byte_names() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE = _byte_names()


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Bytes of a word without blanks -> its ids as little-endian 32-bit numbers. The tokenizer
    drops white space, and no token spans it, so the ids of a text are those of its words."""

    def __init__(self, tokenizer_json: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.older: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_str(tokenizer_json)

    def __missing__(self, w: bytes) -> bytes:
        """Two generations of words are held: when the newer is full it becomes the older, from
        which words that are still in use come back."""
        ids = self.older.get(w)
        if ids is None:
            ids = self._made(w)
        if len(self) >= _CACHE_WORDS:
            self.older = dict(self)
            self.clear()
        self[w] = ids
        return ids

    def _made(self, w: bytes) -> bytes:
        if _LETTERS.fullmatch(w):
            return _packed([t.id for t in self.tokenizer.model.tokenize(w.decode() if w.isascii() else "".join(map(_BYTE.__getitem__, w)))])
        found = _TAILED.fullmatch(w)
        if found:
            return self[found[1]] + self[found[2]]
        if _LATIN.fullmatch(w):
            return self[w.decode().lower().encode()]
        return _packed(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids)

    def ids(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            to = len(text)
            if to - at > _SLICE:
                found = re.compile(rb"[ \n\t\r]").search(text, at + _SLICE)
                to = found.end() if found else to
            words = text[at:to].split()
            out.append(b"".join(map(self.__getitem__, words)))
            at = to
        return b"".join(out)


def combinations(units: int) -> np.ndarray:
    """Columns: how many pieces of each length (in quanta, row = length) fill a window of ``units``."""
    columns = []

    def add(*parts: int) -> None:
        column = np.zeros(units + 1)
        for p in parts:
            column[p] += 1
        columns.append(column)

    for i in range(1, units // 2 + 1):
        add(i, units - i)
    for i in range(1, units // 3 + 1):
        for j in range(i, (units - i) // 2 + 1):
            add(i, j, units - i - j)
    for i in range(1, units // 4 + 1):
        rest = units % i
        add(*[i] * (units // i), *([rest] if rest else []))
    return np.stack(columns, axis=1)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int | None = None) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    gram, goal = a.T @ a, a.T @ b
    x, passive = np.zeros(n), np.zeros(n, dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds or 3 * a.shape[0]):
        on = np.flatnonzero(passive)
        gain = goal - gram[:, on] @ x[on]
        gain[passive] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tol:
            break
        passive[best] = True
        while True:
            on = np.flatnonzero(passive)
            try:
                s = np.linalg.solve(gram[np.ix_(on, on)], goal[on])
            except np.linalg.LinAlgError:
                s = np.linalg.lstsq(gram[np.ix_(on, on)], goal[on], rcond=None)[0]
            if (s > tol).all():
                x[:] = 0
                x[on] = s
                break
            low = s <= tol
            step = min(1.0, float((x[on][low] / np.maximum(x[on][low] - s[low], 1e-300)).min()))
            x[on] += step * (s - x[on])
            passive[on[(x[on] <= tol) & low]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


class Packer:
    """Places pieces of at most a window; pieces are numbers into ``lengths``."""

    def __init__(self, window: int = WINDOW, quantum: int = QUANTUM, full: float = 0.97):
        self.window, self.quantum, self.full = window, quantum, full
        self.table = combinations(window // quantum)

    def sequences(self, lengths: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Sequences as lists of (piece, start in it, length); a sequence of less than the
        window has a power of two of ids or needs padding."""
        bins = -(-lengths // self.quantum)
        order = np.argsort(bins, kind="stable")
        cut = np.searchsorted(bins[order], np.arange(self.table.shape[0] + 1))
        pool = [order[a:b].tolist() for a, b in zip(cut[:-1], cut[1:])]
        left = np.array([len(x) for x in pool])
        out: list[list[int]] = [[p] for p in pool[-1]]
        pool[-1], left[-1] = [], 0
        # lengths that nothing has make no combination worth solving for
        usable = np.flatnonzero(~((self.table > 0) & (left == 0)[:, None]).any(axis=0))
        if len(usable):
            rows = np.flatnonzero(left)
            x = np.zeros(self.table.shape[1])
            x[usable] = nnls(self.table[np.ix_(rows, usable)], left[rows].astype(float))
            for c in np.argsort(-x, kind="stable")[: int((x > 0).sum())]:
                need = self.table[:, c].astype(int)
                on = np.flatnonzero(need)
                times = min(max(1, round(x[c])), int((left[on] // need[on]).min()))
                for _ in range(times):
                    out.append([pool[k].pop() for k in on for _ in range(need[k])])
                left[on] -= times * need[on]
        room = sorted((self.window - int(lengths[s].sum()), i) for i, s in enumerate(out))
        rest = sorted((p for x in pool for p in x), key=lambda p: (-int(lengths[p]), p))
        for p in rest:
            n = int(lengths[p])
            at = bisect.bisect_left(room, (n, -1))
            if at < len(room):
                free, i = room.pop(at)
                out[i].append(p)
            else:
                free, i = self.window, len(out)
                out.append([p])
            bisect.insort(room, (free - n, i))
        done, loose = [], []
        for s in out:
            if lengths[s].sum() >= self.full * self.window:
                done.append([(p, 0, int(lengths[p])) for p in s])
            else:
                loose += s
        stream: list[tuple[int, int, int]] = []
        free = self.window
        for p in loose:
            start, n = 0, int(lengths[p])
            while n:
                take = min(n, free)
                stream.append((p, start, take))
                start, n, free = start + take, n - take, free - take
                if not free:
                    done.append(stream)
                    stream, free = [], self.window
        return done + (self._tail(stream) if stream else [])

    @staticmethod
    def _tail(stream: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        total, done, now = sum(x[2] for x in stream), [], []
        free = 1 << (total.bit_length() - 1)
        for p, start, n in stream:
            while n:
                take = min(n, free)
                now.append((p, start, take))
                start, n, free, total = start + take, n - take, free - take, total - take
                if not free:
                    done.append(now)
                    now, free = [], 1 << max(0, total.bit_length() - 1)
        return done


_words: dict[int, WordIds] = {}
_packers: dict[tuple[int, int], Packer] = {}


def _pack(shared, window: int, quantum: int, block_tokens: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = shared.value
        words = _words.get(hash(source))
        if words is None:
            words = _words[hash(source)] = WordIds(source)
        packer = _packers.setdefault((window, quantum), Packer(window, quantum))
        end = np.array([end_id], dtype="<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        docs: list[tuple[int | None, bytes]] = []
        held = 0

        def place(docs: list[tuple[int | None, bytes]], number: int) -> tuple[list[pa.RecordBatch], int]:
            rows: list[tuple] = []
            tails, own = [], []
            for d, (doc, ids) in enumerate(docs):
                n = len(ids) // 4
                for start in range(0, n - window + 1, window):
                    rows.append((doc, start, window, zlib.crc32(ids[4 * start : 4 * (start + window)]), n, number, 0))
                    number += 1
                if n % window:
                    tails.append(n % window)
                    own.append(d)
            for s in packer.sequences(np.array(tails, dtype=np.int64)) if tails else []:
                offset = 0
                for p, start, length in s:
                    doc, ids = docs[own[p]]
                    n = len(ids) // 4
                    start += n - n % window
                    rows.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, number, offset))
                    offset += length
                number += 1
            names = [x.split()[0] for x in PIECES.split(", ")]
            parts = [rows[i : i + 65536] for i in range(0, len(rows), 65536)]
            return [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], names) for part in parts], number

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids = words.ids(raw) + end
                docs.append((doc, ids))
                held += len(ids) // 4
                if held >= block_tokens:
                    out, number = place(docs, number)
                    yield from out
                    docs, held = [], 0
        if docs:
            yield from place(docs, number)[0]

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, quantum: int = QUANTUM, block_tokens: int = BLOCK_TOKENS, end_id: int = END_ID) -> DataFrame:
    """PIECES of all rows of ``docs`` (doc_id, text). tokenizer_path: a tokenizers JSON file that
    drops white space; read on the driver (a few MB) and broadcast."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pack(shared, window, quantum, block_tokens, end_id), PIECES)
