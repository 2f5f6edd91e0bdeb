"""Performance telemetry of agents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenlake.operators.scan import running_sums

SLOW_SECONDS, MANY_TOKENS = 5.0, 1000
# The suggestions.
SLOW = "Consider caching frequently accessed data or using faster models"
EXPENSIVE = "High token usage detected. Consider prompt optimization"


def running_stats(perf: DataFrame) -> DataFrame:
    """(seq, agent_id, total_executions, avg_execution_time, success_rate) up to and including each row.

    NULL, NaN and infinite times are left out of the average; a NULL success counts as none. Times are added as decimals of nine places, so that
    the sums don't depend on where stretches of the log begin.
    """
    time = F.nanvl(F.col("execution_time"), F.lit(None).cast("double")).try_cast("decimal(38,9)")
    sums = running_sums(
        perf.select("seq", "agent_id", "execution_time", "success"),
        ["agent_id"],
        "seq",
        {"n": F.lit(1), "_timed": time.isNotNull().cast("int"), "_time": time, "_ok": F.coalesce("success", F.lit(False)).cast("int")},
    )
    return sums.select("seq", "agent_id", F.col("n").alias("total_executions"), F.when(F.col("_timed") > 0, F.col("_time").cast("double") / F.col("_timed")).alias("avg_execution_time"), (F.col("_ok") / F.col("n")).alias("success_rate"))


def statistics(perf: DataFrame) -> DataFrame:
    """(agent_id, total_executions, avg_execution_time, success_rate)."""
    time = F.nanvl(F.col("execution_time"), F.lit(None).cast("double"))
    return perf.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("total_executions"),
        F.avg(time).alias("avg_execution_time"),
        F.avg(F.coalesce("success", F.lit(False)).cast("double")).alias("success_rate"),
    )


def suggestions(perf: DataFrame) -> DataFrame:
    """(agent_id, type, severity, suggestion, metric, value): slow agents, then expensive ones.

    Tokens are only looked at where the agent's first row has some; later NULLs count as 0.
    """
    time = F.nanvl(F.col("execution_time"), F.lit(None).cast("double"))
    by_agent = perf.groupBy("agent_id").agg(F.avg(time).alias("_time"), F.min_by("token_usage", "seq").alias("_first"), F.avg(F.coalesce("token_usage", F.lit(0))).alias("_tokens"))

    def one(kind: str, severity: str, text: str, metric: str, value: str):
        return F.struct(F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(text).alias("suggestion"), F.lit(metric).alias("metric"), F.col(value).alias("value"))

    slow = F.when(F.col("_time") > SLOW_SECONDS, one("performance", "medium", SLOW, "execution_time", "_time"))
    dear = F.when((F.coalesce("_first", F.lit(0)) != 0) & (F.col("_tokens") > MANY_TOKENS), one("efficiency", "low", EXPENSIVE, "token_usage", "_tokens"))
    return by_agent.select("agent_id", F.inline(F.array_compact(F.array(slow, dear))))
