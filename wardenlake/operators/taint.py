"""Taint lineage replayed from a log of mark, propagate and sanitize operations.

A data id lives in epochs: each sanitizing begins the next. A fact says that a source taints an id in an epoch from some point of the log on.
Marks are the first facts; a propagation passes on the facts that its origin has at that point, in that epoch. Rounds of joins find what the facts of the
round before pass on; each round writes what is new and nothing else. Chains of copies that outlast the rounds are followed to their end, whatever their length, by
one ordered pass over each namespace (ids that copies connect) that is still in motion.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.operators.scan import running_sums
from wardenlake.plans.lineage import cut, drop
from wardenlake.schemas import TAINT_LEVELS

#: Rounds of joins before what is still spreading goes on in ordered passes; only the plan depends on it.
ROUNDS = 16
#: Facts that an ordered pass gives at once.
BATCH = 10_000


class Replay(NamedTuple):
    """What a log has led to.

    facts: (data_id, epoch, source_id, since); propagations: (seq, data_id, to_data_id, operation) that passed something on;
    epochs: (data_id, epoch), the current one of each id; entries: (data_id), those that have an entry now, be it empty.
    """

    facts: DataFrame
    propagations: DataFrame
    epochs: DataFrame
    entries: DataFrame


def rank_of(level: Column) -> Column:
    return F.coalesce(*[F.when(level == name, F.lit(i)) for i, name in enumerate(TAINT_LEVELS)], F.lit(0))


def level_of(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in TAINT_LEVELS]), rank + 1)


def register_sources(sources: DataFrame) -> DataFrame:
    """(source_id, source_type, level): the last registration of each source (seq, source_id, source_type, level); no level is medium."""
    last = sources.groupBy("source_id").agg(F.max_by(F.struct("source_type", "level"), "seq").alias("s"))
    return last.select("source_id", "s.source_type", F.coalesce("s.level", F.lit("medium")).alias("level"))


NODE = ["data_id", "epoch"]
FACT = [*NODE, "source_id"]


def namespaces(edges: DataFrame) -> DataFrame:
    """(data_id, namespace): ids that edges (data_id, to_id) connect have one namespace, the smallest id among them.

    Every id points to a smaller one. In each round an edge hangs its end, and what its end points to, below the grandparent of its other end, and
    every id goes on to its own grandparent; so the rounds grow with the logarithm of a namespace's size, also for long chains.
    """
    both = edges.select(F.col("data_id").alias("u"), F.col("to_id").alias("v")).filter("u <> v").distinct()
    both = cut(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    ids = edges.select("data_id").unionByName(edges.select(F.col("to_id").alias("data_id"))).distinct()
    above = cut(ids.select("data_id", F.col("data_id").alias("parent")))
    while True:
        grand = above.join(above.select(F.col("data_id").alias("parent"), F.col("parent").alias("grand")), "parent").select("data_id", "parent", "grand")
        of_u = grand.select(F.col("data_id").alias("u"), F.col("parent").alias("pu"))
        of_v = grand.select(F.col("data_id").alias("v"), F.col("grand").alias("gv"))
        hung = both.join(of_u, "u").join(of_v, "v").select("gv", F.explode(F.array("u", "pu")).alias("data_id")).groupBy("data_id").agg(F.min("gv").alias("_near"))
        moved = grand.join(hung, "data_id", "left").select("data_id", F.least("parent", "grand", "_near").alias("parent"), F.col("parent").alias("_was"))
        before, moved = above, cut(moved)
        drop(before)
        above = moved.select("data_id", "parent")
        if moved.filter("parent <> _was").isEmpty():
            return above.withColumnRenamed("parent", "namespace")


_PASSED = "data_id string, epoch bigint, source_id string, since bigint"


def _followed(fresh: DataFrame, edges: DataFrame) -> DataFrame:
    """Every fact that the fresh ones lead to, by passing each namespace's edges in the order of the log.

    A task streams through its namespaces and keeps one set of sources for each id that the fresh facts have reached.
    """
    spaces = namespaces(edges)
    moving = spaces.join(fresh.select("data_id").distinct(), "data_id", "left_semi").select("namespace").distinct()
    spaces = cut(spaces.join(moving, "namespace", "left_semi"))
    none = F.lit(None)
    steps = edges.join(spaces, "data_id").select("namespace", "seq", F.lit(0).alias("kind"), *NODE, "to_id", "to_epoch", none.cast("string").alias("source_id"))
    begun = fresh.join(spaces, "data_id").select("namespace", F.col("since").alias("seq"), F.lit(1).alias("kind"), *NODE, none.cast("string").alias("to_id"), none.cast("bigint").alias("to_epoch"), "source_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held, out = None, {}, []
        for batch in batches:
            for space, seq, kind, data_id, epoch, to_id, to_epoch, source in batch.itertuples(index=False, name=None):
                if space != at:
                    at, held = space, {}
                if kind:
                    held.setdefault((data_id, epoch), set()).add(source)
                    continue
                known = held.setdefault((to_id, int(to_epoch)), set()) if (data_id, epoch) in held else set()
                new = held.get((data_id, epoch), known) - known
                if new:
                    known |= new
                    out += [(to_id, int(to_epoch), s, seq) for s in new]
                    if len(out) >= BATCH:
                        yield pd.DataFrame(out, columns=[*FACT, "since"])
                        out = []
        yield pd.DataFrame(out, columns=[*FACT, "since"])

    # a fact of this point of the log is passed on by later edges only, so edges come first
    return steps.unionByName(begun).repartition("namespace").sortWithinPartitions("namespace", "seq", "kind").mapInPandas(run, _PASSED)


def replay(ops: DataFrame, rounds: int = ROUNDS) -> Replay:
    """The state that a log (seq, kind, data_id, to_data_id, source_id, operation) leads to.

    A mark without a source makes an empty entry. Operations on a NULL id do nothing.
    """
    touch = F.array(
        F.struct(F.col("data_id").alias("id"), F.lit("from").alias("role")),
        F.struct(F.when(F.col("kind") == "propagate", F.col("to_data_id")).alias("id"), F.lit("to").alias("role")),
    )
    touched = ops.select("seq", "kind", "source_id", "operation", F.inline(touch)).filter("id IS NOT NULL")
    clean = F.when((F.col("kind") == "sanitize") & (F.col("role") == "from"), F.lit(1)).otherwise(F.lit(0))
    # a propagation touching one id twice has two rows of one seq, neither of which begins an epoch
    touched = cut(running_sums(touched, ["id"], "seq", {"epoch": clean}).withColumn("epoch", F.col("epoch").cast("bigint")))
    epochs = touched.groupBy(F.col("id").alias("data_id")).agg(F.max("epoch").alias("epoch"))
    marks = touched.filter("kind = 'mark' AND role = 'from'").select(F.col("id").alias("data_id"), "epoch", "source_id", "seq")
    of = {r: touched.filter(f"kind = 'propagate' AND role = '{r}'") for r in ("from", "to")}
    edges = of["from"].select("seq", F.col("id").alias("data_id"), "epoch", "operation").join(of["to"].select("seq", F.col("id").alias("to_id"), F.col("epoch").alias("to_epoch")), "seq")
    edges = cut(edges)
    fresh = cut(marks.filter("source_id IS NOT NULL").groupBy(*FACT).agg(F.min("seq").alias("since")))
    found = [fresh]
    for _ in range(rounds):
        passed = fresh.join(edges, NODE).filter("since < seq")
        got = passed.groupBy(F.col("to_id").alias("data_id"), F.col("to_epoch").alias("epoch"), "source_id").agg(F.min("seq").alias("since"))
        known = reduce(DataFrame.unionByName, found).withColumnRenamed("since", "_known")
        fresh = cut(got.join(known, FACT, "left").groupBy(*FACT, "since").agg(F.min("_known").alias("_known")).filter("_known IS NULL OR since < _known").drop("_known"))
        if fresh.isEmpty():
            break
        found.append(fresh)
    else:
        found.append(cut(_followed(fresh, edges)))
    facts = reduce(DataFrame.unionByName, found).groupBy(*FACT).agg(F.min("since").alias("since"))
    live = edges.join(facts.groupBy(*NODE).agg(F.min("since").alias("since")), NODE).filter("since < seq")
    entries = marks.select(*NODE).unionByName(facts.select(*NODE)).distinct().join(epochs, NODE).select("data_id")
    return Replay(facts, live.select("seq", "data_id", F.col("to_id").alias("to_data_id"), "operation"), epochs, entries)


def current_taint(facts: DataFrame, epochs: DataFrame) -> DataFrame:
    """(data_id, source_id): what taints each id now; sources need not be registered."""
    return facts.join(epochs, NODE).select("data_id", "source_id")


def levels(taint: DataFrame, sources: DataFrame, ids: DataFrame) -> DataFrame:
    """(data_id, is_tainted, level): the worst level of registered sources; tainted by unregistered ones only is untainted."""
    ranked = taint.join(sources.select("source_id", rank_of(F.col("level")).alias("rank")), "source_id", "left")
    worst = ranked.groupBy("data_id").agg(F.max("rank").alias("rank"), F.lit(True).alias("_any"))
    out = ids.select("data_id").distinct().join(worst, "data_id", "left")
    return out.select("data_id", F.coalesce("_any", F.lit(False)).alias("is_tainted"), level_of(F.coalesce("rank", F.lit(0))).alias("level"))


def taint_sources(taint: DataFrame, sources: DataFrame) -> DataFrame:
    """(data_id, source_id, source_type, level) of registered sources."""
    return taint.join(sources, "source_id").select("data_id", "source_id", "source_type", "level")


def flow(propagations: DataFrame, data_id: str | None = None) -> DataFrame:
    """The propagations into an id, one hop, or into all."""
    rows = propagations if data_id is None else propagations.filter(F.col("to_data_id") == data_id)
    return rows.orderBy("seq")


def stats(taint: DataFrame, sources: DataFrame, propagations: DataFrame, entries: DataFrame) -> DataFrame:
    """(measure, n): sources, ids with an entry (empty ones too), propagations, and pairs of id and registered source by level."""
    by_level = taint_sources(taint, sources).groupBy(F.concat(F.lit("level_"), "level").alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    for name, rows in (("total_sources", sources), ("tainted_data", entries), ("propagations", propagations)):
        by_level = by_level.unionByName(rows.agg(F.lit(name).alias("measure"), F.count(F.lit(1)).alias("n")))
    return by_level
