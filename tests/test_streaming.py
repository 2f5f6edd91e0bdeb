"""Streams give what the batch gives."""

import pytest
from pyspark.sql import functions as F

from wardenlake.operators import performance, trust
from wardenlake.plans.queries import firewall, trust_ops
from wardenlake.sources.tables import table
from wardenlake.streaming import streams

SF = "/root/testdata/sf0.001"


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return stream.sparkSession.table(name)


@pytest.fixture
def source(spark, tmp_path):
    def make(df, parts=3):
        path = str(tmp_path / "in")
        df.repartition(parts).write.parquet(path)
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)

    return make


def test_screened(spark, source):
    messages = table(spark, SF, "messages").select("seq", "content", "ts")
    batch = streams.screened(messages, firewall()).select("seq", "allowed", "is_safe")
    got = run(streams.screened(source(messages), firewall()).select("seq", "allowed", "is_safe"), "screened", "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))


def test_windows(spark, source):
    messages = table(spark, SF, "messages").select("seq", "content", "ts").orderBy("ts")
    got = run(streams.blocked_by_window(source(messages, 1), firewall()), "windows", "complete")
    blocked = firewall().check(messages).filter("NOT allowed").count()
    assert got.agg(F.sum("n")).first()[0] == blocked


def test_statistics(spark, source):
    perf = table(spark, SF, "perf").select("seq", "agent_id", "execution_time", "success")
    got = run(streams.performance_statistics(source(perf)), "perf", "complete")
    want = {r.agent_id: r.total_executions for r in performance.statistics(perf).collect()}
    assert {r.agent_id: r.total_executions for r in got.collect()} == want


def test_trust(spark, source):
    ops = trust_ops(spark, SF)
    got = run(streams.trust_scores(source(ops, 1)), "trust", "update")
    want = {r.agent_id: r.score for r in trust.current(ops).collect()}
    assert {r.agent_id: r.score for r in got.collect()} == pytest.approx(want)
