"""Operator 1: drop the lines that a site repeats on many of its pages.

Site-relative frequency: the host is the ``source``. For each host and line, the pages (rows)
that contain the line are divided by the host's pages; a line over ``ratio`` is boilerplate of that
host and is dropped from all its documents. ``least_pages`` is 2: what only one page has isn't
repeated, however few pages its host has.

With ``groups`` (doc_id and the group of near copies it is in) the pages of a group on one host
count as one page, so that a page copied very often doesn't make boilerplate of its own text
before one of it is chosen; the pipeline does that, op1_line_dedup counts every row.

Lines are compared without the spaces, tabs and carriage returns at their ends; blank lines
are never dropped. The counts work on 16-byte digests of lines, with partial
aggregation, so that neither a host with a third of all rows nor a line on every page meets
in one task. A host has fewer boilerplate lines than lines on its mean page divided by
``ratio``; they reach the documents by a join on the host, which is a broadcast if their
measured size is below ``broadcast_bytes`` and else a join that can be split where it is hot.

Cases: a null text stays null (0 lines) and counts as a page without lines; an empty text
has one blank line. A null source counts as a host of its own, apart from ''. A document of
boilerplate only gets an empty text, or with ``whole`` keeps its text as it is. Other columns
stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.scratch import saved
from lodestone.llm import minhash

RATIO, LEAST_PAGES, BROADCAST_BYTES = 0.05, 2, 16 << 20


def _digest(c):
    return F.unhex(F.md5(c))


def _host(c="source"):
    """A null host is one of its own: other hosts begin with a mark."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def _strip(line):
    return F.btrim(line, F.lit(" \t\r"))


def near_groups(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, near: the documents that have near copies (by minhash), and the smallest of the group."""
    gone = minhash.near_duplicates(docs, percent).where("NOT kept").select("doc_id", F.col("component_id").alias("near"))
    return gone.unionByName(gone.select(F.col("near").alias("doc_id"), "near")).groupBy("doc_id").agg(F.min("near").alias("near"))


def boilerplate(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, groups: DataFrame | None = None) -> DataFrame:
    """host, line_md5 (binary), pages, host_pages: the lines over the ratio. groups: as of near_groups()."""
    stripped = F.filter(F.transform(F.split("text", "\n", -1), _strip), lambda x: x != "")
    ids = [] if groups is None else [F.col("doc_id").cast("long").alias("doc_id")]
    pages = docs.select(*ids, _host().alias("host"))
    lines = docs.select(*ids, _host().alias("host"), F.explode(F.array_distinct(stripped)).alias("line"))
    lines = lines.select(*ids, "host", _digest(F.col("line")).alias("line_md5"))

    def count(rows: DataFrame, *by: str) -> DataFrame:
        """Pages by these columns: rows, but those of one group count once."""
        if groups is None:
            return rows.groupBy(*by).agg(F.count("*").alias("pages"))
        rows = rows.join(groups.hint("merge"), "doc_id", "left").groupBy(*by, "near").agg(F.count("*").alias("n"))
        return rows.groupBy(*by).agg(F.sum(F.when(F.col("near").isNull(), F.col("n")).otherwise(1)).alias("pages"))

    if groups is not None:
        groups = saved(groups, "groups")  # digests are joined, not texts
    totals = count(pages, "host").withColumnRenamed("pages", "host_pages")
    counts = count(lines, "host", "line_md5").where(F.col("pages") >= least_pages)
    return counts.join(totals, "host").where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def strip_lines(docs: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES, broadcast_bytes: int = BROADCAST_BYTES, counts: tuple[str, str] | None = None, groups: DataFrame | None = None, whole: bool = False) -> DataFrame:
    """All columns of ``docs``, the text without boilerplate lines. counts: names for two more
    columns (long), the lines of the text and those dropped; names that are taken raise. groups: near
    copies that count as one page. whole: a text that would have no line but blank ones stays as it is."""
    if counts and set(counts) & set(docs.columns):
        raise ValueError(f"docs has columns named {sorted(set(counts) & set(docs.columns))}")
    mark = "_ld"  # begins no column of docs
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark += "_"
    of, drop, kept_lines = f"{mark}host", f"{mark}drop", f"{mark}kept"
    found = boilerplate(docs, ratio, least_pages, groups).groupBy(F.col("host").alias(of)).agg(F.collect_set("line_md5").alias(drop))
    found = saved(found, "boilerplate")
    size = found.agg(F.sum(F.length(of) + 24 * F.size(drop))).first()[0] or 0
    joined = docs.join(F.broadcast(found) if size <= broadcast_bytes else found, _host() == F.col(of), "left")
    lines = F.split("text", "\n", -1)
    is_kept = lambda x: ~F.array_contains(F.col(drop), _digest(_strip(x))) | (_strip(x) == "")
    joined = joined.withColumn(kept_lines, F.when(F.col(drop).isNull(), lines).otherwise(F.filter(lines, is_kept)))
    if whole:
        joined = joined.withColumn(kept_lines, F.when(F.exists(kept_lines, lambda x: _strip(x) != ""), F.col(kept_lines)).otherwise(lines))
    out = [F.array_join(kept_lines, "\n").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
        kept = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(kept_lines)).cast("long")
        out += [n.alias(counts[0]), (n - kept).alias(counts[1])]
    return joined.select(*out)
