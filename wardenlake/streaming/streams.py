"""Screening, counting and scoring streams of messages, performance rows and trust operations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, StructField, StructType

from wardenlake.operators import attacks, performance, trust
from wardenlake.operators.screen import Firewall


def screened(messages: DataFrame, firewall: Firewall, content: str = "content") -> DataFrame:
    """Each message with its verdict and threats: row functions, so the batch transform itself."""
    return attacks.analyze(firewall.check(messages, content), content)


def blocked_by_window(messages: DataFrame, firewall: Firewall, ts: str = "ts", delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """(start, severity, n) of blocked messages in tumbling windows; rows later than ``delay`` are dropped by the watermark."""
    rows = messages.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", delay)
    blocked = firewall.check(rows).filter(~F.col("allowed"))
    return blocked.groupBy(F.window("_ts", window), "severity").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "severity", "n")


def performance_statistics(perf: DataFrame) -> DataFrame:
    """Statistics of each agent so far, for the update output mode."""
    return performance.statistics(perf)


class TrustProcessor(StatefulProcessor):
    """Keeps one score for each agent; the operations of a micro-batch are applied in the order of seq."""

    def __init__(self, initial: float = trust.INITIAL, low: float = trust.LOWEST, high: float = trust.HIGHEST) -> None:
        self.initial, self.low, self.high = initial, low, high

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.score = handle.getValueState("score", StructType([StructField("score", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        score = self.score.get()[0] if self.score.exists() else self.initial
        got = pd.concat(list(rows)).sort_values("seq")
        for delta in got["delta"]:
            score = max(self.low, min(self.high, score + delta))
        self.score.update((score,))
        yield pd.DataFrame({"agent_id": [key[0]], "score": [score], "seq": [got["seq"].iloc[-1]]})

    def close(self) -> None:
        pass


def trust_scores(ops: DataFrame, initial: float = trust.INITIAL, low: float = trust.LOWEST, high: float = trust.HIGHEST) -> DataFrame:
    """(agent_id, score, seq) of each agent that a micro-batch touches, for the update output mode; needs the RocksDB state store."""
    return ops.groupBy("agent_id").transformWithStateInPandas(
        statefulProcessor=TrustProcessor(initial, low, high), outputStructType="agent_id bigint, score double, seq bigint", outputMode="Update", timeMode="None"
    )
