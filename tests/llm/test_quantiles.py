import math
import random

import pytest
from pyspark.sql import functions as F

from wardenlake.llm import quantiles as Q

PROBS = {"p1": 0.01, "p50": 0.5, "p99": 0.99}
SCHEMA = "k bigint, day bigint, v double, w int"


def exact(values, p):
    values = sorted(v for v in values if v is not None and not math.isnan(v))
    return values[max(1, math.ceil(p * len(values))) - 1] if values else None


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_error_bound_and_merging(spark, seed):
    r = random.Random(seed)
    make = [lambda: r.lognormvariate(0, 4), lambda: -r.random() * 1e-6, lambda: 0.0, lambda: None, lambda: float("nan"), lambda: r.choice([5.0, 5.0, 7.25]), lambda: -1.0]
    rows = [(r.choice([1, 2, None]), r.randrange(4), r.choice(make)(), r.randrange(9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    daily = Q.sketch(df, ["k", "day"], ["v"], 0.01)
    merged = Q.merge(daily.filter("day < 2").unionByName(daily.filter("day >= 2")), ["k"])
    got = {x.k: x for x in Q.percentiles(merged, ["k"], PROBS, 0.01).collect()}
    once = {x.k: x for x in Q.percentiles(Q.sketch(df, ["k"], ["v"], 0.01), ["k"], PROBS, 0.01).collect()}
    assert got == once
    for k in (1, 2, None):
        values = [x[2] for x in rows if x[0] == k]
        assert got[k].n + got[k].n_missing == len(values)
        for name, p in PROBS.items():
            want = exact(values, p)
            assert got[k][name] == pytest.approx(want, rel=0.01 * (1 + 1e-9), abs=0)


def test_cases(spark):
    df = spark.createDataFrame([(1, 1, None, None), (2, 1, math.inf, 3), (2, 1, -math.inf, 3)], SCHEMA).withColumns({"metric": F.lit(1), "bucket": F.lit(2), "n": F.lit(3), "_upto": F.lit(4)})
    got = {(x.k, x.metric): x for x in Q.percentiles(Q.sketch(df, ["k"], ["v", "w"]), ["k"], PROBS).collect()}
    assert got[1, "v"].n == 0 and got[1, "v"].p50 is None and got[1, "v"].n_missing == 1
    assert got[2, "v"].p1 == -math.inf and got[2, "v"].p99 == math.inf and got[2, "w"].p50 == pytest.approx(3, rel=0.01)
    assert Q.percentiles(Q.sketch(df.limit(0), ["k"], ["v"]), ["k"], PROBS).count() == 0
    with pytest.raises(ValueError):
        Q.sketch(df, ["metric"], ["v"])
    with pytest.raises(ValueError):
        Q.sketch(df, ["k"], ["v"], 1e-9)
