"""Running values along an order, without putting a whole group into one task.

A group may hold a third of all rows. Its rows are cut into stretches of the order (``seq div chunk``); each stretch is reduced to one row
by an ordinary partial aggregation, the few stretches of a group are accumulated, and the rows of a stretch start from what came before it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the order in a stretch.
CHUNK = 100_000


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def _with_stretches(df: DataFrame, keys: Sequence[str], order: str, chunk: int, reduced: list[Column], carried: Mapping[str, Column]) -> DataFrame:
    rows = df.withColumn("_chunk", F.floor(F.col(order) / chunk).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    stretches = rows.groupBy(*keys, "_chunk").agg(*reduced).select(*keys, "_chunk", *[c.over(before).alias(n) for n, c in carried.items()])
    joined = rows.alias("r").join(stretches.alias("s"), _same("r", "s", [*keys, "_chunk"]))
    return joined.select(*[f"r.`{c}`" for c in rows.columns], *[f"s.{n}" for n in carried])


def running_sums(df: DataFrame, keys: Sequence[str], order: str, values: Mapping[str, Column], chunk: int = CHUNK) -> DataFrame:
    """``df`` with a running sum up to and including the row for each of ``values``; NULLs count as nothing."""
    df = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    reduced = [F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values]
    out = _with_stretches(df, keys, order, chunk, reduced, {f"_b_{n}": F.sum(f"_t_{n}") for n in values})
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumns({n: F.coalesce(F.sum(f"_v_{n}").over(within), F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0)) for n in values})
    return out.drop("_chunk", *[f"_{p}_{n}" for p in "vb" for n in values])


def running_last(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str, chunk: int = CHUNK) -> DataFrame:
    """``df`` with the last ``value`` that isn't NULL up to and including the row: an as-of join of the log with itself."""
    df = df.withColumn("_v", value)
    reduced = [F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_t")]
    out = _with_stretches(df, keys, order, chunk, reduced, {"_b": F.last("_t", ignorenulls=True)})
    within = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(within), F.col("_b"))).drop("_chunk", "_v", "_b")
