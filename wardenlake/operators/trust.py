"""Trust scores: clamped running sums.

A step x -> clamp(x + d) clamps, so a score isn't a sum. But steps compose: any run of steps is x -> min(hi, max(lo, x + d)) for some lo, hi and
d. Runs of a bounded stretch of the log are folded into such a triple, triples of stretches into triples again, and so on up;
histories go down the same tree. No task ever holds more than ``FAN`` rows of one agent, however many it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardenlake.operators.scan import _same
from wardenlake.plans.lineage import cut

INITIAL, LOWEST, HIGHEST, THRESHOLD = 0.5, 0.0, 1.0, 0.6
#: Steps, or runs of steps, that one task folds for an agent.
FAN = 256


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _then(run: Column, step: Column) -> Column:
    """The run followed by the step, both (lo, hi, d)."""

    def through(x: Column) -> Column:
        return F.least(step["hi"], F.greatest(step["lo"], x + step["d"]))

    return F.struct(through(run["lo"]).alias("lo"), through(run["hi"]).alias("hi"), (run["d"] + step["d"]).alias("d"))


def _steps(ops: DataFrame, low: float, high: float) -> DataFrame:
    """(agent_id, at, run, factors): each operation as a run of one step. A NULL delta is an error; ``factors`` are an empty map where the log has none."""
    delta = F.when(F.col("delta").isNotNull(), F.col("delta")).otherwise(F.raise_error(F.lit("delta is NULL")).cast("double"))
    none = F.create_map().cast("map<string,double>")
    factors = F.coalesce(F.col("factors"), none) if "factors" in ops.columns else none
    return ops.select("agent_id", F.col("seq").alias("at"), F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi"), delta.alias("d")).alias("run"), factors.alias("factors"))


_IDENTITY = (float("-inf"), float("inf"), 0.0)


def _identity() -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("lo", "hi", "d"), _IDENTITY, strict=True)])


def _folded(runs: DataFrame) -> DataFrame:
    """The next level: runs of ``FAN`` neighbours of an agent folded into one."""
    ordered = F.sort_array(F.collect_list(F.struct("at", "run")))
    folded = runs.groupBy("agent_id", F.floor(F.col("at") / FAN).cast("bigint").alias("up")).agg(ordered.alias("_runs"))
    return folded.select("agent_id", F.col("up").alias("at"), F.aggregate("_runs", _identity(), lambda a, x: _then(a, x["run"])).alias("run"))


def _levels(ops: DataFrame, low: float, high: float) -> list[DataFrame]:
    top = ops.agg(F.max(F.abs("seq"))).first()[0] or 0
    levels = [_steps(ops, low, high)]
    while top > 0:
        levels.append(_folded(levels[-1]))
        top //= FAN
    return levels


def _applied(run: Column, x: Column) -> Column:
    return F.least(run["hi"], F.greatest(run["lo"], x + run["d"]))


def current(ops: DataFrame, initial: float = INITIAL, low: float = LOWEST, high: float = HIGHEST) -> DataFrame:
    """(agent_id, score): the score after all operations (seq, agent_id, delta) in the order of seq."""
    top = _levels(ops, low, high)[-1]
    # negative and positive seqs meet at most once at the top: fold what is left
    runs = top.groupBy("agent_id").agg(F.sort_array(F.collect_list(F.struct("at", "run"))).alias("_runs"))
    return runs.select("agent_id", F.aggregate("_runs", F.lit(float(initial)), lambda x, r: _applied(r["run"], x)).alias("score"))


def history(ops: DataFrame, initial: float = INITIAL, low: float = LOWEST, high: float = HIGHEST) -> DataFrame:
    """(agent_id, seq, score, confidence, factors): the score after each operation, with the factors (map<string,double>) that it was made with."""
    levels = [cut(x) for x in _levels(ops, low, high)]
    starts = levels[-1].groupBy("agent_id").agg(F.lit(None).cast("bigint").alias("up"), F.lit(float(initial)).alias("start"))
    for depth in range(len(levels) - 1, -1, -1):
        up = F.lit(None).cast("bigint") if depth == len(levels) - 1 else F.floor(F.col("at") / FAN).cast("bigint")
        carried = ("at", "run") if depth else ("at", "run", "factors")
        listed = F.collect_list(F.struct(*carried))
        # maps have no order, so at the bottom the elements are compared by their place in the log only
        ordered = F.sort_array(listed) if depth else F.array_sort(listed, lambda a, b: F.when(a["at"] < b["at"], -1).otherwise(1))
        runs = levels[depth].withColumn("up", up).groupBy("agent_id", "up").agg(ordered.alias("_runs"))
        met = runs.alias("r").join(starts.alias("s"), _same("r", "s", ["agent_id", "up"])).select("r.agent_id", "r._runs", "s.start")
        first = F.struct(F.col("start").alias("x"), F.array().cast("array<double>").alias("all"))
        before = F.aggregate("_runs", first, lambda a, r: F.struct(_applied(r["run"], a["x"]).alias("x"), F.array_append(a["all"], a["x"]).alias("all")), lambda a: a["all"])
        each = met.select("agent_id", F.explode(F.zip_with("_runs", before, lambda r, x: F.struct(*[r[c].alias(c) for c in carried], x.alias("start")))).alias("_e"))  # noqa: B023
        if depth == 0:
            return each.select("agent_id", F.col("_e.at").alias("seq"), _applied(F.col("_e.run"), F.col("_e.start")).alias("score"), F.lit(1.0).alias("confidence"), "_e.factors")
        starts = each.select("agent_id", F.col("_e.at").alias("up"), "_e.start")
    raise AssertionError


def scores_of(agents: DataFrame, scores: DataFrame, initial: float = INITIAL) -> DataFrame:
    """The agents (agent_id) with their score; the initial one for those without operations."""
    return agents.join(scores, "agent_id", "left").withColumn("score", F.coalesce("score", F.lit(float(initial))))


def trusted(scored: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return scored.filter(F.col("score") >= threshold)


def evaluate_states(states: DataFrame, scores: DataFrame, initial: float = INITIAL, low: float = LOWEST, high: float = HIGHEST) -> DataFrame:
    """(agent_id, score, confidence, factors): what the reported states make of the current scores; nothing is kept.

    A list of violations, empty or not, gives the factor policy_compliance of -0.1 for each; a reported trust score is added as it is.
    """
    joined = scores_of(states, scores, initial)
    policy = F.when(F.col("policy_violations").isNotNull(), F.lit(-0.1) * F.size("policy_violations"))
    reported = F.col("trust_score")
    factors = F.map_filter(F.create_map(F.lit("policy_compliance"), policy, F.lit("self_reported"), reported), lambda _, v: v.isNotNull())
    total = _clamp(F.col("score") + F.coalesce(policy, F.lit(0.0)) + F.coalesce(reported, F.lit(0.0)), low, high)
    return joined.select("agent_id", total.alias("score"), F.lit(0.8).alias("confidence"), factors.alias("factors"))
