"""Traces, logs and numeric series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenlake.operators.lastn import last_n


def _optional(ops: DataFrame, name: str) -> DataFrame:
    return ops if name in ops.columns else ops.withColumn(name, F.lit(None).cast("string"))


def traces(ops: DataFrame, agent_id: int | None = None, status: str | None = None, limit: int | None = None) -> DataFrame:
    """(seq, trace_id, agent_id, operation, status, end_seq, events, metadata, result): every started trace of a log (seq, kind, trace_id, agent_id, operation, status, description).

    The log may have ``metadata``, which a start keeps, and ``result``, which the last end gives. Ends and events belong to the first trace of their id, the last end counts, and only those after the start do; others are dropped.
    """
    ops = _optional(_optional(ops, "metadata"), "result")
    starts = ops.filter("kind = 'start'")
    first = starts.groupBy("trace_id").agg(F.min("seq").alias("_first"))
    later = ops.filter("kind IN ('end', 'event')").join(first, "trace_id").filter("seq > _first")
    of_first = later.groupBy("trace_id").agg(
        F.max_by(F.struct("seq", F.coalesce("status", F.lit("completed")).alias("status"), "result"), F.when(F.col("kind") == "end", F.col("seq"))).alias("_end"),
        F.count_if(F.col("kind") == "event").alias("_events"),
    )
    rows = starts.join(first, "trace_id").join(of_first, "trace_id", "left").withColumn("_is", F.col("seq") == F.col("_first"))
    ended = F.col("_is") & F.col("_end").isNotNull()
    out = rows.select(
        "seq", "trace_id", "agent_id", "operation",
        F.when(ended, F.col("_end.status")).otherwise(F.lit("active")).alias("status"),
        F.when(ended, F.col("_end.seq")).alias("end_seq"),
        F.when(F.col("_is"), F.coalesce("_events", F.lit(0))).otherwise(F.lit(0)).alias("events"),
        "metadata", F.when(ended, F.col("_end.result")).alias("result"),
    )
    return last_n(out, limit, agent_id=agent_id, status=status)


def trace_events(ops: DataFrame) -> DataFrame:
    """(trace_id, seq, operation, description, metadata): the events of each trace, one row each, however many."""
    ops = _optional(ops, "metadata")
    first = ops.filter("kind = 'start'").groupBy("trace_id").agg(F.min("seq").alias("_first"))
    return ops.filter("kind = 'event'").join(first, "trace_id").filter("seq > _first").select("trace_id", "seq", "operation", "description", "metadata")


def logs(rows: DataFrame, level: str | None = None, agent_id: int | None = None, limit: int | None = None) -> DataFrame:
    return last_n(rows, limit, level=level, agent_id=agent_id)


def metric_stats(points: DataFrame, name: str | None = None) -> DataFrame:
    """(metric_name, n, min, max, avg) of series (metric_name, value)."""
    rows = points if name is None else points.filter(F.col("metric_name") == name)
    return rows.groupBy("metric_name").agg(F.count("value").alias("n"), F.min("value").alias("min_value"), F.max("value").alias("max_value"), F.avg("value").alias("avg_value"))
