"""Stages before and after a step, each from DataFrame to DataFrame."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import wraps

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

Stage = Callable[[DataFrame], DataFrame]
log = logging.getLogger(__name__)


class Middleware:
    """Stages in the order of priority, higher first, and of registration. A name is used once; a second use replaces the first stage."""

    def __init__(self) -> None:
        self._stages: dict[str, list[tuple[int, int, str | None, Stage]]] = {"pre": [], "post": []}
        self._count = 0

    def _add(self, side: str, stage: Stage, name: str | None, priority: int) -> None:
        if name is not None:
            self.remove_middleware(name)
        self._count += 1
        self._stages[side].append((-priority, self._count, name, stage))
        self._stages[side].sort(key=lambda s: s[:2])

    def add_pre_middleware(self, stage: Stage, name: str | None = None, priority: int = 0) -> None:
        self._add("pre", stage, name, priority)

    def add_post_middleware(self, stage: Stage, name: str | None = None, priority: int = 0) -> None:
        self._add("post", stage, name, priority)

    def remove_middleware(self, name: str) -> bool:
        before = sum(map(len, self._stages.values()))
        for side, stages in self._stages.items():
            self._stages[side] = [s for s in stages if s[2] != name or name is None]
        return sum(map(len, self._stages.values())) < before

    def list_middleware(self) -> list[str]:
        return [s[2] for s in sorted((s for stages in self._stages.values() for s in stages), key=lambda s: s[1]) if s[2] is not None]

    def _run(self, side: str, df: DataFrame) -> DataFrame:
        for _, _, name, stage in self._stages[side]:
            try:
                df = df.transform(stage)
            except AnalysisException as e:
                log.warning("stage %s left out: %s", name or stage, e)
        return df

    def process_input(self, df: DataFrame) -> DataFrame:
        """All stages before; one that can't be planned is left out. All become one plan."""
        return self._run("pre", df)

    def process_output(self, df: DataFrame) -> DataFrame:
        return self._run("post", df)

    def wrap_function(self, step: Stage) -> Stage:
        @wraps(step)
        def wrapped(df: DataFrame) -> DataFrame:
            return self.process_output(step(self.process_input(df)))

        return wrapped
