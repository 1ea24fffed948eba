"""Token usage of a stream of model calls, in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(calls: DataFrame, time: str = "ts", width: str = "1 hour", slide: str | None = None, late: str | None = "2 hours", operation: str = "operation") -> DataFrame:
    """window_start, operation, calls, tokens of a streaming or static table of calls (time,
    operation, input_tokens, output_tokens). Windows close, and late calls are dropped, once the
    watermark has passed. late: None if the stream has a watermark already."""
    rows = calls.withWatermark(time, late) if calls.isStreaming and late else calls
    out = rows.groupBy(F.window(time, width, slide), operation).agg(F.count("*").alias("calls"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"))
    return out.select(F.col("window.start").alias("window_start"), operation, "calls", "tokens")


def sessions(calls: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "2 hours", user: str = "doc_id") -> DataFrame:
    """session_start, session_end, user, calls: calls of a user with no longer pause than ``gap``."""
    rows = calls.withWatermark(time, late) if calls.isStreaming else calls
    out = rows.groupBy(F.session_window(time, gap), user).agg(F.count("*").alias("calls"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), user, "calls")


def new_calls(calls: DataFrame, key: str, time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Each call once, however often it arrives within the watermark."""
    return calls.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if calls.isStreaming else calls.dropDuplicates([key])
