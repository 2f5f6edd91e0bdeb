"""Patches: registered, and applied once."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Patch:
    """A registered change of a target. ``applied`` outlives a new registration under the same id."""

    framework: str
    description: str
    change: Callable[[Any], Any]
    version_requirement: str | None = None
    applied: bool = False

    def put_on(self, target: Any) -> bool:
        """Whether it is applied now. It never runs twice; one that raises may be tried again."""
        if not self.applied:
            with contextlib.suppress(Exception):
                self.change(target)
                self.applied = True
        return self.applied


class PatchManager(dict[str, Patch]):
    """The patches of this process by their id."""

    def register_patch(self, patch_id: str, framework: str, description: str, patch: Callable[[Any], Any], version_requirement: str | None = None) -> None:
        self[patch_id] = Patch(framework, description, patch, version_requirement, self.is_applied(patch_id))

    def apply_patch(self, patch_id: str, target: Any) -> bool:
        return patch_id in self and self[patch_id].put_on(target)

    def is_applied(self, patch_id: str) -> bool:
        return patch_id in self and self[patch_id].applied

    def list_patches(self, framework: str | None = None) -> list[dict[str, Any]]:
        wanted = {i: p for i, p in self.items() if framework in (None, "", p.framework)}
        return [{"patch_id": i, **{f: getattr(p, f) for f in ("framework", "description", "applied")}} for i, p in wanted.items()]


def status(ops: DataFrame, framework: str | None = None) -> DataFrame:
    """(patch_id, framework, applied, applied_seq) of a log (seq, kind in register and apply, patch_id, framework, succeeded).

    The last registration counts; a patch is applied by the first success after it was first registered.
    """
    known = ops.filter("kind = 'register'").groupBy("patch_id").agg(F.max_by("framework", "seq").alias("framework"), F.min("seq").alias("_from"))
    tried = ops.filter("kind = 'apply' AND succeeded").select("patch_id", F.col("seq").alias("_seq"))
    done = tried.join(known.select("patch_id", "_from"), "patch_id").filter("_seq > _from").groupBy("patch_id").agg(F.min("_seq").alias("applied_seq"))
    out = known.drop("_from").join(done, "patch_id", "left").withColumn("applied", F.col("applied_seq").isNotNull())
    return out.filter(F.col("framework") == framework) if framework else out
