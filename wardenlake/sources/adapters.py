"""Adapters that bring foreign conversation tables into the schemas of this engine."""

from __future__ import annotations

from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardenlake.plans.pipeline import Middleware

MESSAGE_COLUMNS = ("seq", "conv_id", "turn", "role", "content")


class BaseAdapter(ABC):
    def __init__(self, config: dict[str, Any] | None = None) -> None:
        self.config = config or {}

    @abstractmethod
    def wrap_agent(self, source: DataFrame) -> DataFrame:
        """The source as messages (seq, conv_id, turn, role, content)."""

    @abstractmethod
    def extract_state(self, source: DataFrame) -> DataFrame:
        """The source as states, one row for each conversation."""

    @abstractmethod
    def inject_middleware(self, source: DataFrame, middleware: Middleware) -> DataFrame:
        """The source's messages behind the middleware."""

    def validate_agent(self, source: DataFrame) -> bool:
        """Whether the source has what the adapter needs."""
        return True

    def get_framework_name(self) -> str:
        return type(self).__name__.replace("Adapter", "")


class ConversationsAdapter(BaseAdapter):
    """Tables of turns, with the columns named in the config (conv_id, turn, role, content and, if there is one, seq)."""

    def _named(self, name: str) -> str:
        return self.config.get(name, name)

    def validate_agent(self, source: DataFrame) -> bool:
        return all(self._named(c) in source.columns for c in MESSAGE_COLUMNS[1:])

    def wrap_agent(self, source: DataFrame) -> DataFrame:
        names = {c: F.col(self._named(c)) for c in MESSAGE_COLUMNS[1:]}
        seq = F.col(self._named("seq")) if self._named("seq") in source.columns else names["conv_id"] * 1_000_000 + names["turn"]
        return source.select(seq.cast("bigint").alias("seq"), *[c.alias(n) for n, c in names.items()])

    def extract_state(self, source: DataFrame) -> DataFrame:
        return self.wrap_agent(source).groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.max_by("role", "seq").alias("last_role"), F.max("seq").alias("last_seq"))

    def inject_middleware(self, source: DataFrame, middleware: Middleware) -> DataFrame:
        return middleware.process_input(self.wrap_agent(source))
