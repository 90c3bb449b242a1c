"""Query metrics by hour, sliding window and session, and content-hash dedupe across batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_metrics(logs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Count and times of each hour of (ts, total_time); rows later than the watermark are left out."""
    hours = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", "1 hour"))
    return hours.agg(F.count("*").alias("n"), F.avg("total_time").alias("avg_time"), F.max("total_time").alias("max_time")).select(F.col("window.start").alias("hour"), "n", "avg_time", "max_time")


def new_contents(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """(text, indexed_at) with a hash, without repeats of a hash inside the watermark."""
    return docs.withColumn("content_hash", F.sha2("text", 256)).withWatermark("indexed_at", late).dropDuplicatesWithinWatermark(["content_hash"])


def sliding_metrics(logs: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """(start, end, n, avg_time, max_time) of the windows of ``size`` that begin every ``step``, over (ts, total_time), of a stream or a table.

    A row is in each window that holds its time. On a stream a window is put out once the watermark, ``late`` behind the greatest time seen, is past its end;
    rows of such windows that come later are left out and counted (``late_rows``)."""
    rows = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", size, step))
    found = rows.agg(F.count("*").alias("n"), F.avg("total_time").alias("avg_time"), F.max("total_time").alias("max_time"))
    return found.select("window.start", "window.end", "n", "avg_time", "max_time")


def sessions(logs: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, end, n, total_time) of each user's queries with less than ``gap`` between them, over (user_id, ts, total_time), of a stream or a table.

    end is the last query's time and the gap. Out-of-order rows join the sessions that they fall between, as long as the watermark isn't past them."""
    rows = logs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("session"))
    found = rows.agg(F.count("*").alias("n"), F.sum("total_time").alias("total_time"))
    return found.select("user_id", "session.start", "session.end", "n", "total_time")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a query's stateful operators left out as behind the watermark, of the progress reports that it still has."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
