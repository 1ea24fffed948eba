"""Functions that columns can't express, as Arrow-batched pandas UDFs."""

from __future__ import annotations

import hashlib
import html
import html.entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import tokens


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence: bit-parallel, a word operation for each of b."""
    place: dict = {}
    for i, x in enumerate(a):
        place[x] = place.get(x, 0) | (1 << i)
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b:
        u = row & place.get(x, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - bin(row).count("1")


def rouge_l_score(prediction: str, truth: str) -> float:
    """F of the longest common subsequence of blank-separated tokens; 0 where it has no meaning."""
    p, t = (prediction or "").split(), (truth or "").split()
    n = _lcs(p, t) if p and t else 0
    return 2 * n / (len(p) + len(t)) if n else 0.0


def indel_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|) of characters, rounded to whole percents, as a share."""
    total = len(a) + len(b)
    return round(100 * 2 * _lcs(list(a), list(b)) / total) / 100 if total else 0.0


@F.pandas_udf(T.DoubleType())
def rouge_l(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([rouge_l_score(p, t) for p, t in zip(prediction, truth)], dtype=float)


@F.pandas_udf(T.DoubleType())
def code_similarity(prediction: pd.Series, truth: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(p or "", t or "") for p, t in zip(prediction, truth)], dtype=float)


_REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def decode_references(text: str, names: frozenset[str] | None = None) -> str:
    """Complete character references decoded, once; only those of ``names``, if given. One without its
    semicolon is cut or part of an address, and stays, as does an unknown name."""

    def one(m: re.Match) -> str:
        if names is not None and m[1] not in names:
            return m[0]
        return html.unescape(m[0]) if m[1][0] == "#" else html.entities.html5.get(m[1] + ";", m[0])

    return _REFERENCE.sub(one, text)


def clean_html(text, names: tuple[str, ...] | None = None):
    """Strip blanks, decode HTML's complete character references (all, or those of ``names``), delete
    control characters of a text column."""
    control = re.compile(r"[\x00-\x1f\x7f-\x9f]")
    known = None if names is None else frozenset(names)

    @F.pandas_udf(T.StringType())
    def clean(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else control.sub("", decode_references(t.strip(" \t\n\r\f\x0b"), known)))

    return clean(text)


def by_words(text: str) -> int:
    return len(text.split())


#: A dashed rule on a line of its own, or empty lines: a long sentence may be cut behind one.
_CUT = re.compile(r"\n\s*-{10,}\s*\n|\n\n+")


def split_long(text: str, most: int = 256, least: int = 30, count=by_words) -> list[str]:
    """A text of more than ``most`` tokens in pieces: each ends at the last place to cut before
    which it has no more than ``most``, or at the next one if a stretch alone has more. A piece
    of under ``least`` tokens joins the one before it if both have no more than ``most`` together."""
    if count(text) <= most:
        return [text]
    ends = sorted({*(m.end() for m in _CUT.finditer(text)), len(text)} - {0})
    total = np.cumsum([count(text[a:b]) for a, b in zip([0, *ends], ends)])
    at, start, pieces = 0, 0, []
    while at < len(ends):
        before = total[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(total, before + most, side="right")))
        piece = text[start : ends[at - 1]]
        start = ends[at - 1]
        if pieces and count(piece) < least and count(pieces[-1] + piece) <= most:
            pieces[-1] += piece
        else:
            pieces.append(piece)
    return pieces


def split_long_sentences(path: str | None = None, most: int = 256, least: int = 30):
    """split_long() of each sentence in an array, by the tokens of a tokenizer file or by words."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(sentences: pd.Series) -> pd.Series:
        count = tokens.counter(path) if path else by_words
        return sentences.map(lambda xs: [] if xs is None else [p for x in xs for p in split_long(x, most, least, count)])

    return split


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    """All HTML character references decoded."""
    return text.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(T.StringType())
def vector_id(vector: pd.Series) -> pd.Series:
    """The MD5 of a vector's bytes, as floats of 32 bits: the identity of one that has none."""
    return vector.map(lambda v: None if v is None else hashlib.md5(np.asarray(v, dtype=np.float32).tobytes()).hexdigest())


def unit_rows(rows) -> np.ndarray:
    """Rows as unit vectors in double precision; zero vectors become NaN."""
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def unit_batch(column: pa.Array) -> np.ndarray:
    """An Arrow column of equally long vectors as unit_rows(), without a Python object for each."""
    if column.null_count or column.values.null_count:
        return unit_rows(column.to_pylist())
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)
