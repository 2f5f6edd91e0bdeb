"""The filtered last-N read that all logs share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_n(df: DataFrame, limit: int | None = None, order: str = "seq", **filters) -> DataFrame:
    """The last ``limit`` rows by ``order`` that meet all filters, oldest first.

    A filter that is None or "" is none; so is a limit of None or 0. A negative limit -k leaves out the first k rows. ``order`` must be unique. A positive limit is
    planned as a top-k; a negative one as a filter beyond the k-th value, so that the rest of the log is neither sorted in one place nor counted.
    """
    for name, value in filters.items():
        if value is not None and value != "":
            df = df.filter(F.col(name) == F.lit(value))
    if not limit:
        return df
    if limit > 0:
        return df.orderBy(F.desc(order)).limit(limit).orderBy(order)
    first = df.select(order).orderBy(order).limit(-limit).agg(F.max(order).alias("_skip"), F.count(F.lit(1)).alias("_had"))
    return df.join(F.broadcast(first), (F.col(order) > F.col("_skip")) & (F.col("_had") == -limit)).drop("_skip", "_had").orderBy(order)
