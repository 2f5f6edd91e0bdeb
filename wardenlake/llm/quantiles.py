"""Percentiles with a guaranteed relative error, from mergeable logarithmic buckets.

A positive value x falls into bucket ``i = ceil(ln x / ln g)`` with ``g = (1 + a) / (1 - a)``, so the
bucket's representative ``2 g^i / (g + 1)`` is within the relative error ``a`` of every value in it.
Negative values use the mirrored buckets, zero and the infinities have their own. A sketch is a plain
DataFrame of counts, one row for each group and bucket: merging sketches of partitions, days or
clusters is adding counts, in any order, without loss. All of it is built-in expressions; counting is a partial aggregation on the map side,
so a group that holds a third of all rows shuffles at most one row for each bucket and task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added to |bucket|, so that the sign of the stored number is the sign of the value; 0 is the value 0.
OFFSET = 1 << 20
#: The bucket of infinity.
INFINITE = 1 << 30
MIN_ERROR = 1e-3


def _log_gamma(rel_err: float) -> float:
    if not MIN_ERROR <= rel_err < 1:
        raise ValueError(f"rel_err must be in [{MIN_ERROR}, 1)")
    return math.log((1 + rel_err) / (1 - rel_err))


def bucket_of(value: Column, rel_err: float) -> Column:
    """The signed bucket of a value; NULL for NULL and NaN."""
    v = value.cast("double")
    index = F.ceil(F.log(F.abs(v)) / F.lit(_log_gamma(rel_err))) + F.lit(OFFSET)
    size = F.when(F.abs(v) == F.lit(float("inf")), F.lit(INFINITE)).otherwise(index)
    return (
        F.when(v.isNull() | F.isnan(v), F.lit(None))
        .when(v == 0, F.lit(0))
        .when(v > 0, size)
        .otherwise(-size)
        .cast("int")
    )


def value_of(bucket: Column, rel_err: float) -> Column:
    """The representative of a bucket."""
    lg = _log_gamma(rel_err)
    log_mid = math.log(2 / (math.exp(lg) + 1))
    size = F.exp((F.abs(bucket) - F.lit(OFFSET)) * F.lit(lg) + F.lit(log_mid))
    size = F.when(F.abs(bucket) == INFINITE, F.lit(float("inf"))).otherwise(size)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket) * size)


def sketch(df: DataFrame, keys: Sequence[str], values: Sequence[str], rel_err: float = 0.01) -> DataFrame:
    """Count the buckets of several numeric columns: (keys..., metric, bucket, n).

    NULL keys are a group like any other. NULL and NaN values are counted in the row with bucket NULL.
    Repeated rows count each time. Columns not named are ignored, whatever they are called; a key may
    not be called metric, bucket or n. An empty table gives an empty sketch.
    """
    if taken := {"metric", "bucket", "n"} & set(keys):
        raise ValueError(f"keys may not be called {sorted(taken)}")
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), bucket_of(F.col(c), rel_err).alias("bucket")) for c in values])
    long = df.select(*keys, F.inline(pairs))
    return long.groupBy(*keys, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add sketches, or reduce one to fewer keys (days to weeks, agents to all)."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, keys: Sequence[str], probs: dict[str, float], rel_err: float = 0.01) -> DataFrame:
    """Percentiles of merged sketches: (keys..., metric, n, n_missing, one column for each of ``probs``, rel_err).

    The p-percentile is the value of rank ``max(1, ceil(p n))`` in ascending order, returned within
    the relative error. ``sketches`` must hold one row for each group and bucket (see ``merge``). A group
    without a number has n = 0 and NULL percentiles. The window orders the buckets of one group, of which there
    are at most some ten thousand however many values were counted.
    """
    group = [*keys, "metric"]
    ordered = Window.partitionBy(*group).orderBy(F.col("bucket").asc_nulls_first())
    known = F.when(F.col("bucket").isNotNull(), F.col("n")).otherwise(F.lit(0))
    ranked = sketches.withColumns(
        {"_upto": F.sum(known).over(ordered), "_all": F.sum(known).over(Window.partitionBy(*group))}
    )
    out = [
        value_of(F.min(F.when((F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("_all")))) & F.col("bucket").isNotNull(), F.col("bucket"))), rel_err).alias(name)
        for name, p in probs.items()
    ]
    return ranked.groupBy(*group).agg(
        F.sum(known).alias("n"),
        F.sum(F.when(F.col("bucket").isNull(), F.col("n")).otherwise(F.lit(0))).alias("n_missing"),
        *out,
        F.lit(rel_err).alias("rel_err"),
    )
