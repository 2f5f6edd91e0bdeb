"""Policy rules over messages and states.

Faithful mode evaluates every condition to false. With ``sql_conditions`` (an extension) a condition is a boolean Spark
SQL expression over the row's columns, parsed when the rule is added; NULL is no violation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.operators.lastn import last_n


@dataclass(frozen=True)
class Rule:
    name: str
    description: str
    condition: str
    action: str = "warn"
    severity: str = "medium"


class PolicyEnforcer:
    def __init__(self, sql_conditions: bool = False) -> None:
        self.sql_conditions = sql_conditions
        self.rules: dict[str, Rule] = {}
        self.handlers: dict[str, Callable[[Rule], None]] = {}

    def add_rule(self, name: str, description: str, condition: str, action: str = "warn", severity: str = "medium") -> None:
        """A rule of the same name is replaced in its place."""
        if self.sql_conditions:
            F.expr(condition)
        self.rules[name] = Rule(name, description, condition, action, severity)

    def remove_rule(self, name: str) -> bool:
        return self.rules.pop(name, None) is not None

    def get_rule(self, name: str) -> Rule | None:
        return self.rules.get(name)

    def list_rules(self) -> list[Rule]:
        return list(self.rules.values())

    def register_handler(self, action: str, handler: Callable[[Rule], None]) -> None:
        self.handlers[action] = handler

    def _violated(self, rule: Rule) -> Column:
        return F.coalesce(F.expr(rule.condition).cast("boolean"), F.lit(False)) if self.sql_conditions else F.lit(False)

    def check(self, df: DataFrame) -> DataFrame:
        """``df`` with the names of all violated rules, in rule order."""
        names = [F.when(self._violated(r), F.lit(r.name)) for r in self.rules.values()]
        return df.withColumn("violated_rules", F.array_compact(F.array(*names)) if names else F.array().cast("array<string>"))

    def violations(self, df: DataFrame, violation_type: str = "message", order: str = "seq", severity: str | None = None, limit: int | None = None, data: Column | None = None) -> DataFrame:
        """(order, rule_name, violation_type, severity, action, data): one row for each violated rule of each row.

        ``data`` is what violated it, by default the whole row as JSON.
        """
        kept = F.to_json(F.struct(*df.columns)) if data is None else data.cast("string")
        one = [
            F.when(self._violated(r), F.struct(F.lit(i).alias("_rule"), F.lit(r.name).alias("rule_name"), F.lit(violation_type).alias("violation_type"), F.lit(r.severity).alias("severity"), F.lit(r.action).alias("action")))
            for i, r in enumerate(self.rules.values())
        ]
        none = F.array().cast("array<struct<_rule:int,rule_name:string,violation_type:string,severity:string,action:string>>")
        rows = df.select(order, kept.alias("data"), F.inline(F.array_compact(F.array(*one)) if one else none))
        out = [order, "rule_name", "violation_type", "severity", "action", "data"]
        if not limit:
            return last_n(rows, None, order, severity=severity).select(*out)
        rows = rows.withColumn("_at", F.col(order) * max(len(one), 1) + F.col("_rule"))
        return last_n(rows, limit, "_at", severity=severity).select(*out)

    def check_state(self, states: DataFrame, order: str = "agent_id", severity: str | None = None, limit: int | None = None, data: Column | None = None) -> DataFrame:
        """The violations of states, of the type ``state``."""
        return self.violations(states, "state", order, severity, limit, data)

    def handle(self, violations: DataFrame, order: str = "seq") -> None:
        """Call the handler of the rule's action for each violation, in the order of the rows and, within a row, of the rules. Exceptions propagate.

        Handlers are functions of the driver, so the violations that have one come here, by their order and rule only and one partition at a time.
        """
        handled = [r.name for r in self.rules.values() if r.action in self.handlers]
        if not handled:
            return
        rows = violations.filter(F.col("rule_name").isin(handled)).select(order, "rule_name")
        place = F.array_position(F.array(*[F.lit(n) for n in self.rules]), F.col("rule_name"))
        for r in rows.orderBy(order, place).toLocalIterator():
            rule = self.rules[r["rule_name"]]
            self.handlers[rule.action](rule)
