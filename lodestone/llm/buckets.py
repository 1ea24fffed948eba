"""Compare the rows of a bucket in bounded blocks.

A bucket (rows that share a key) can hold any part of all rows. Rows of a bucket of n
rows are dealt to ceil(n / block) blocks, and each pair of blocks is a group of its own,
so no task sees more than two blocks of a bucket at once and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared_keys(keys: DataFrame, key: list[str], minimum: int = 2) -> DataFrame:
    """The keys that ``minimum`` rows or more have, with their number of rows n."""
    return keys.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= minimum)


def block_pairs(rows: DataFrame, by: list[str], item: str, blocks) -> DataFrame:
    """Add own (the row's block), bi and bj (the pair of blocks it is sent for)."""
    dealt = rows.withColumn("nb", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64(item), F.col("nb")).cast("int"))
    return dealt.withColumn("other", F.explode(F.expr("sequence(0, nb - 1)"))).select(
        *[c for c in rows.columns], "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj")
    )


def open_pairs(rows: DataFrame, by: list[str], item: str, rest: str, block) -> DataFrame:
    """block_pairs(), in blocks of ``block`` rows (a column, alike within a group), for groups of which some rows are connected already: those where ``rest`` is false.
    Pairs of blocks of connected rows are left out, so that a group takes as many rows as
    it has blocks of open ones, and none if it has no open one."""
    sizes = rows.groupBy(*by).agg(F.count_if(~F.col(rest)).alias("_done"), F.count_if(rest).alias("_open"), F.max(block).alias("_b")).where("_open > 0")
    dealt = rows.join(sizes, by).withColumn("_mb", F.ceil(F.col("_done") / F.col("_b")).cast("int")).withColumn("_rb", F.ceil(F.col("_open") / F.col("_b")).cast("int"))
    at = F.when(F.col(rest), F.col("_mb") + F.pmod(F.xxhash64(item), F.col("_rb"))).otherwise(F.pmod(F.xxhash64(item), F.col("_mb")))
    dealt = dealt.withColumn("own", at.cast("int")).withColumn("other", F.explode(F.expr(f"sequence(IF({rest}, 0, _mb), _mb + _rb - 1)")))
    return dealt.select(*rows.columns, "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))


def grouped(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a group next to each other, for runs()."""
    return rows.repartition(*by).sortWithinPartitions(*by)


def runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups and the offsets of their groups; a group is never cut."""
    rest: pa.Table | None = None

    def edges(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = False
        for c in by:
            v = t.column(c).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        at = edges(t)
        rest = t.slice(at[-1])
        if len(at) > 1:
            yield t.slice(0, at[-1]), at
    if rest is not None and rest.num_rows:
        rest = rest.combine_chunks()
        yield rest, np.array([0, rest.num_rows])


def run_pairs(at: np.ndarray, wide: int = 48) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs i < j within each run, as arrays of bounded length; runs of up to
    ``wide`` rows are done together, a lag at a time, larger ones row block by row block."""
    size = np.diff(at)
    small = np.flatnonzero((size > 1) & (size <= wide))
    if len(small):
        start, left = at[:-1][small], size[small]
        for lag in range(1, int(left.max())):
            on = left > lag
            start, left = start[on], left[on]
            n = left - lag
            first = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            for k in range(0, len(first), 1 << 18):
                yield first[k : k + (1 << 18)], first[k : k + (1 << 18)] + lag
    for r in np.flatnonzero(size > wide):
        lo, hi = int(at[r]), int(at[r + 1])
        step = max(1, (1 << 18) // (hi - lo))
        for i in range(lo, hi, step):
            rows = np.arange(i, min(i + step, hi))
            a = np.repeat(rows, hi - 1 - rows)
            if len(a):
                yield a, np.concatenate([np.arange(x + 1, hi) for x in rows])
