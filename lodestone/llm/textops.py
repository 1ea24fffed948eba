"""Vectorised text work on the bytes of Arrow string columns.

Everything here takes a whole block of texts as one byte array and the offsets
of its texts, so that hashing costs a few array passes and no Python object per
word. Blocks are cut by bytes: the memory of a task does not depend on how many
rows or how long rows an Arrow batch happens to have (one text is the least).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20
#: Odd multipliers of the rolling hashes; any odd numbers do.
_P = 0x9E3779B97F4A7C15
_Q = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Separators of words [^\x20\x09-\x0D]+
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Separators of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing)
NOT_WORD = np.ones(256, dtype=bool)
NOT_WORD[48:58] = NOT_WORD[97:123] = NOT_WORD[128:] = False


def _splitmix(x: int) -> int:
    x = (x + _P) & _MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


def constants(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit numbers, the same in every process."""
    return np.array([_splitmix(seed * 1_000_003 + i) for i in range(n)], dtype=U64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.ones(1, dtype=U64)
        while len(out) < size:
            out = np.concatenate([out, out * U64(pow(base, len(out), 1 << 64))])
        have = out[:size]
        if n <= BLOCK_BYTES * 2:
            _powers[base] = have
    return have[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, end to end, and the n + 1 offsets. Null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into slices whose texts have about ``size`` bytes at most."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths.astype(np.int64))
        at = 0
        while at < n:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """The words of a block of texts: spans, their texts, and 64-bit hashes on demand."""

    def __init__(self, column: pa.Array, separators: np.ndarray):
        raw, self.offsets = text_bytes(column)
        self.bytes = LOWER[raw]
        inside = ~separators[self.bytes]
        n = len(inside)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0] = after[-1] = False
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        #: word_at[d] .. word_at[d + 1] are the words of text d
        self.word_at = np.searchsorted(self.start, self.offsets)
        self.n_words = np.diff(self.word_at)

    def hashes(self, seed: int = 1) -> np.ndarray:
        n = len(self.bytes)
        total = np.zeros(n + 1, dtype=U64)
        np.cumsum(constants(256, seed)[self.bytes] * _power(_P, n), out=total[1:])
        h = (total[self.end] - total[self.start]) * _power(pow(_P, -1, 1 << 64), n + 1)[self.start]
        return mix(h + (self.end - self.start).astype(U64) * U64(_Q))

    def left(self) -> np.ndarray:
        """For each word, how many words its text has from there on."""
        return np.repeat(self.word_at[1:], self.n_words) - np.arange(len(self.start))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row; the last k - 1 of the block have no meaning."""
    n = len(hashes)
    out = np.full(n, U64(k * 0x51ED2701 + 1), dtype=U64)
    for j in range(min(k, n)):
        out[: n - j] += hashes[j:] * U64(pow(_Q, j + 1, 1 << 64))
    return mix(out)


def shingles(words: Words, k: int = 5, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts and the n + 1 offsets; a text of fewer than k words but
    some has one, of all its words; repeats stay."""
    h = words.hashes(seed)
    g = grams(h, k)
    keep = words.left() >= k
    short = np.flatnonzero((words.n_words > 0) & (words.n_words < k))
    for size in np.unique(words.n_words[short]):
        at = words.word_at[short[words.n_words[short] == size]]
        keep[at] = True
        # only these few places are needed, so the sum is taken there
        total = np.full(len(at), U64(int(size) * 0x51ED2701 + 1), dtype=U64)
        for j in range(int(size)):
            total += h[at + j] * U64(pow(_Q, j + 1, 1 << 64))
        g[at] = mix(total)
    places = np.flatnonzero(keep)
    return g[places], np.searchsorted(places, words.word_at)
