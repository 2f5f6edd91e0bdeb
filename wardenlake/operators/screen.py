"""Screening and redacting content by ordered rules."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.functions.dialect import java_pattern, java_replacement
from wardenlake.operators.lastn import last_n

SNIPPET = 100


def fail_open(predicate: Callable[[str], bool]) -> Callable[[Column], Column]:
    """A Python predicate as a column; a row on which it raises isn't blocked."""

    def guarded(value: str) -> bool:
        try:
            return value is not None and bool(predicate(value))
        except Exception:  # noqa: BLE001
            return False

    @F.pandas_udf("boolean")
    def run(values: pd.Series) -> pd.Series:
        return values.map(guarded, na_action=None).astype(bool)

    return lambda c: run(c)


class Firewall:
    """Ordered allow, block and custom rules, compiled into one CASE expression."""

    def __init__(self) -> None:
        self.allowed: list[tuple[str, str]] = []
        self.blocked: list[tuple[str, str]] = []
        self.filters: list[Callable[[Column], Column]] = []

    def add_blocked_pattern(self, pattern: str, flags: int = 0) -> None:
        self.blocked.append((pattern, java_pattern(pattern, flags)))

    def add_allowed_pattern(self, pattern: str, flags: int = 0) -> None:
        self.allowed.append((pattern, java_pattern(pattern, flags)))

    def add_custom_filter(self, blocks: Callable[[Column], Column]) -> None:
        """``blocks`` makes a boolean column of the content; true blocks. Wrap Python predicates in ``fail_open``."""
        self.filters.append(blocks)

    def verdict(self, content: Column) -> Column:
        """A struct (allowed, severity, description, rule_index) of the first rule that decides; NULL content is allowed."""

        def of(allowed: bool, severity: str | None, description: str | None, index: int | None) -> Column:
            return F.struct(
                F.lit(allowed).alias("allowed"),
                F.lit(severity).cast("string").alias("severity"),
                F.lit(description).cast("string").alias("description"),
                F.lit(index).cast("int").alias("rule_index"),
            )

        free = of(True, None, None, None)
        out = F.when(content.isNull(), free)
        for _, rx in self.allowed:
            out = out.when(content.rlike(rx), free)
        for i, (pattern, rx) in enumerate(self.blocked):
            out = out.when(content.rlike(rx), of(False, "high", f"Input matched blocked pattern: {pattern}", i))
        for i, blocks in enumerate(self.filters):
            out = out.when(F.coalesce(blocks(content), F.lit(False)), of(False, "medium", "Input blocked by custom filter", len(self.blocked) + i))
        return out.otherwise(free)

    def check(self, df: DataFrame, content: str = "content") -> DataFrame:
        """``df`` with allowed, severity, description and rule_index. One pass, no shuffle; inputs, outputs and messages alike."""
        kept = [c for c in df.columns if c not in ("allowed", "severity", "description", "rule_index", "_verdict")]
        return df.withColumn("_verdict", self.verdict(F.col(content))).select(*kept, "_verdict.*")

    def sanitize(self, content: Column, replacement: str = "[REDACTED]") -> Column:
        """Every match of each blocked pattern in turn replaced; allow rules and filters don't matter."""
        to = java_replacement(replacement)
        return reduce(lambda c, rule: F.regexp_replace(c, F.lit(rule[1]), F.lit(to)), self.blocked, content)

    def events(self, df: DataFrame, content: str = "content", order: str = "seq", severity: str | None = None, limit: int | None = None) -> DataFrame:
        """The security events of blocked rows, in order."""
        blocked = self.check(df, content).filter(~F.col("allowed"))
        rows = blocked.select(order, F.lit("blocked_input").alias("event_type"), "severity", "description", F.substring(content, 1, SNIPPET).alias("content_snippet"))
        return last_n(rows, limit, order, severity=severity)

    def stats(self, df: DataFrame, content: str = "content") -> DataFrame:
        """One row of counts."""
        blocked = F.count_if(~F.col("allowed"))
        return self.check(df, content).agg(
            blocked.alias("total_blocked"),
            blocked.alias("security_events"),
            F.lit(len(self.blocked)).alias("blocked_patterns"),
            F.lit(len(self.allowed)).alias("allowed_patterns"),
            F.lit(len(self.filters)).alias("custom_filters"),
        )
