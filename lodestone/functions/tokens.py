"""Byte-pair tokens: counts and windows by a tokenizer file, as Arrow batches.

A tokenizer is a file of the ``tokenizers`` library; its path is a parameter and must be readable
where the workers run. Each worker loads it once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

WINDOWS = "array<struct<start:long,tokens:long,content:string>>"
_LOADED: dict[str, object] = {}


def load(path: str):
    if path not in _LOADED:
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        _LOADED[path] = made
    return _LOADED[path]


#: Code points that go to the tokenizer at once: its answers take about 100 bytes a token until they are read.
PART = 1 << 18


def parts(texts: Iterable[str], most: int = PART) -> Iterator[list[str]]:
    """texts in lists of about ``most`` code points, one text at least."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text) > most:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def encoded(path: str, texts: Iterable[str]) -> Iterator[list[int]]:
    """The ids of each text, a part at a time."""
    for part in parts(texts):
        for e in load(path).encode_batch_fast(part, add_special_tokens=False):
            yield e.ids


def encode(path: str, texts: list[str]) -> list[list[int]]:
    return list(encoded(path, texts))


def counter(path: str) -> Callable[[str], int]:
    """The number of tokens of one text, for functions that run in a worker."""
    return lambda text: len(encode(path, [text])[0])


def token_count(path: str) -> Callable[[Column], Column]:
    """Tokens of a text column; null for null."""

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        n = [len(ids) for ids in encoded(path, text.fillna(""))]
        return pd.Series(n, index=text.index, dtype="Int64").where(text.notna())

    return count


def message_tokens(path: str) -> Callable[[Column], Column]:
    """Tokens of a list of messages: four and its values for each, and two."""

    @F.pandas_udf("long")
    def count(values: pd.Series) -> pd.Series:
        return values.map(lambda xs: 2 + sum(4 + len(ids) for ids in encode(path, [x or "" for x in xs])))

    return count


def windows(path: str, size: int, overlap: int) -> Callable[[Column], Column]:
    """Windows of ``size`` tokens that share ``overlap``: start, tokens (before the text is stripped)
    and the decoded text, stripped. The last ones may lie inside the one before; no text, no window."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")

    @F.pandas_udf(WINDOWS)
    def cut(text: pd.Series) -> pd.Series:
        out, made = [], load(path)
        for ids in encoded(path, text.fillna("")):
            starts = range(0, len(ids), size - overlap)
            parts = made.decode_batch([ids[s : s + size] for s in starts], skip_special_tokens=False) if ids else []
            out.append([{"start": s, "tokens": min(size, len(ids) - s), "content": p.strip()} for s, p in zip(starts, parts)])
        return pd.Series(out, index=text.index)

    return cut


def window_rows(docs: DataFrame, index: str, text: str, path: str, size: int, overlap: int) -> DataFrame:
    """index, chunk_ord, start, tokens, content: windows() of a table. They leave a worker as they are made, a few hundred thousand characters at a time."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    kind = dict(docs.dtypes)[index]
    schema = to_arrow_schema(docs.select(index).schema)
    names = [index, "chunk_ord", "start", "tokens", "content"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = load(path)
        for batch in batches:
            column = batch.column("text")
            at, held, n = [], [], 0

            def out() -> pa.RecordBatch:
                data = list(zip(*held))
                return pa.RecordBatch.from_arrays([batch.column(index).take(pa.array(at, pa.int64())).cast(schema.field(0).type), *[pa.array(x, pa.int64()) for x in data[:3]], pa.array(data[3], pa.string())], names=names)

            for i, ids in enumerate(encoded(path, (x.as_py() or "" for x in column))):
                for k, s in enumerate(range(0, len(ids), size - overlap)):
                    content = made.decode(ids[s : s + size], skip_special_tokens=False).strip()
                    at.append(i)
                    held.append((k, s, min(size, len(ids) - s), content))
                    n += len(content)
                    if n > PART:
                        yield out()
                        at, held, n = [], [], 0
            if held:
                yield out()

    return docs.select(index, F.col(text).alias("text")).mapInArrow(cut, f"`{index}` {kind}, chunk_ord long, start long, tokens long, content string")
