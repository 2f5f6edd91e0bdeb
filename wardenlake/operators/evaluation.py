"""Evaluation of responses by registered metrics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.operators.lastn import last_n

Metric = Callable[[Column, Column], Column]


def python_metric(f: Callable[[str, str | None], float]) -> Metric:
    """A Python metric as a column; NULL where it raises."""

    def guarded(output: str, expected: str | None) -> float | None:
        try:
            return float(f(output, expected))
        except Exception:  # noqa: BLE001
            return None

    @F.pandas_udf("double")
    def run(outputs: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([guarded(o, e) for o, e in zip(outputs, expected, strict=True)], dtype="float64")

    return lambda o, e: run(o, e)


class Evaluator:
    def __init__(self) -> None:
        self.metrics: dict[str, Metric] = {}

    def register_metric(self, name: str, metric: Metric) -> None:
        self.metrics[name] = metric

    def evaluate(self, df: DataFrame, output: str = "output", expected: str = "expected") -> DataFrame:
        """``df`` with the map of all metrics' scores; a score that can't be had is NULL."""
        pairs = [x for name, m in self.metrics.items() for x in (F.lit(name), m(F.col(output), F.col(expected)).cast("double"))]
        return df.withColumn("metrics", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,double>"))


def aggregate(evaluated: DataFrame, agent_id: int | None = None) -> DataFrame:
    """(metric, score, n): the mean of each metric over the rows that have it; a metric without any has no row."""
    rows = evaluated if agent_id is None else evaluated.filter(F.col("agent_id") == agent_id)
    long = rows.select(F.explode("metrics").alias("metric", "score")).filter("score IS NOT NULL AND NOT isnan(score)")
    return long.groupBy("metric").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n"))


def results(evaluated: DataFrame, agent_id: int | None = None, limit: int | None = None) -> DataFrame:
    return last_n(evaluated, limit, agent_id=agent_id)
