"""Mixing sources to target shares of all tokens, by Pareto order sampling.

A source that is to give r times its tokens gives every document an expected number of copies: in proportion to a weight, at most the
source's cap, and such that the expected tokens are those planned. The whole part of it is certain. The fraction is an inclusion probability p:
documents are ranked by (u / (1 - u)) / (p / (1 - p)), u a uniform number from the document's hash, and the lowest ranks are taken until the source
has its tokens. The ranking is never sorted as a whole: tokens are summed over buckets of ranks, all buckets below the bound
are taken, and only the bucket at the bound is looked at again, in finer buckets, and at last row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardenlake.plans.lineage import cut

#: Buckets of a rank's logarithm: width, and how many finer ones a bucket has in each later look.
WIDTH, FINER, LOOKS = 0.05, 1024, 3
#: The expected copies of a document go with its tokens to this power: longer documents are repeated a little less often.
LENGTH_POWER = -0.25
#: Weights that differ by less than this factor count as one while the copies are scaled.
WEIGHT_STEP = 1.05


def source_name(c: Column) -> Column:
    """One spelling for a source: lower case, no outer blanks, underscores; NULL for NULL and blank."""
    name = F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")
    return F.when(name != "", name)


def plan(sizes: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, planned, binds): the tokens each source is to give, and whether its cap bounds the total.

    Without a ``total`` it is the largest one that every source with documents can serve within its cap. With one, a source gives at most what its cap
    allows. A target without documents plans 0; a source without a target isn't in the plan. Targets spelled alike are added, with the larger cap.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"))
    wanted = wanted.filter("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    has = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("available"))
    both = wanted.join(has, "source", "left").withColumns({"documents": F.coalesce("documents", F.lit(0)), "available": F.coalesce("available", F.lit(0))})
    most = F.col("available") * F.col("max_repeats")
    reach = F.when((F.col("available") > 0) & (F.col("target_share") > 0), most / F.col("target_share"))
    if total is None:
        room = F.min(reach).over(Window.partitionBy())
        both = both.withColumn("_total", F.coalesce(room, F.lit(0.0)))
    else:
        both = both.withColumn("_total", F.lit(float(total)))
    both = both.withColumn("binds", F.coalesce(reach <= F.col("_total"), F.lit(False)))
    return both.withColumn("planned", F.floor(F.least(most, F.coalesce("target_share", F.lit(0.0)) * F.col("_total")) + F.lit(1e-6)).cast("bigint")).drop("_total")


def _scaled(weighed: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, scale): the factor by which weights become expected copies, so that capped copies give the planned tokens; NULL if all are capped.

    Weights are summed in steps of a few per cent, of which there are few; where the largest are capped, the others take what is left.
    """
    step = F.floor(F.log("_weight") / F.lit(_log(WEIGHT_STEP))).cast("bigint")
    steps = weighed.groupBy("source", step.alias("_step")).agg(F.sum("tokens").alias("_tokens"), F.sum(F.col("tokens") * F.col("_weight")).alias("_weighed"), F.max("_weight").alias("_top"))
    larger = Window.partitionBy("source").orderBy(F.desc("_step")).rowsBetween(Window.unboundedPreceding, -1)
    same_or_less = Window.partitionBy("source").orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    tried = steps.join(planned.select("source", "planned", "max_repeats"), "source").withColumns({"_capped": F.coalesce(F.sum("_tokens").over(larger), F.lit(0)), "_rest": F.sum("_weighed").over(same_or_less)})
    scale = (F.col("planned") - F.col("max_repeats") * F.col("_capped")) / F.col("_rest")
    fits = (scale * F.col("_top") <= F.col("max_repeats") * WEIGHT_STEP) & (scale >= 0)
    return tried.withColumn("_scale", scale).groupBy("source").agg(F.max_by("_scale", F.when(fits, F.col("_step"))).alias("scale"))


def _log(x: float) -> float:
    import math

    return math.log(x)


def _lowest(ranked: DataFrame, budget: DataFrame) -> DataFrame:
    """The rows (source, _id, tokens, _rank) of the lowest ranks of each source whose tokens together stay within its budget (source, _budget)."""
    taken, rest, left, width = None, ranked, budget, WIDTH
    for _ in range(LOOKS):
        rest = rest.withColumn("_bucket", F.floor(F.col("_rank") / F.lit(width)).cast("bigint"))
        sums = cut(rest.groupBy("source", "_bucket").agg(F.sum("tokens").alias("_sum")).join(left, "source"))
        upto = Window.partitionBy("source").orderBy("_bucket")
        sums = sums.withColumn("_upto", F.sum("_sum").over(upto))
        below = sums.filter("_upto <= _budget").groupBy("source").agg(F.max("_bucket").alias("_last"), F.max("_upto").alias("_used"))
        bound = sums.filter("_upto > _budget").groupBy("source").agg(F.min("_bucket").alias("_bound"))
        full = rest.join(F.broadcast(below.select("source", "_last")), "source").filter("_bucket <= _last").drop("_last", "_bucket")
        taken = full if taken is None else taken.unionByName(full)
        rest = rest.join(F.broadcast(bound), "source").filter("_bucket = _bound").drop("_bound", "_bucket")
        left = cut(left.join(below, "source", "left").select("source", (F.col("_budget") - F.coalesce("_used", F.lit(0))).alias("_budget")))
        width /= FINER
    upto = Window.partitionBy("source").orderBy("_rank", "_id").rowsBetween(Window.unboundedPreceding, 0)
    last = rest.join(F.broadcast(left), "source").withColumn("_upto", F.sum("tokens").over(upto)).filter("_upto <= _budget").drop("_upto", "_budget")
    return taken.unionByName(last)


def usable(sizes: DataFrame) -> DataFrame:
    """(id, source, tokens) of the documents that can be used: with an id, a source in one spelling, and tokens.

    An id names one document: of rows that repeat an id one stays, the one of the smallest source and size, so that the cap holds for the document.
    """
    named = sizes.select("id", source_name(F.col("source")).alias("source"), F.col("tokens").cast("bigint").alias("tokens")).filter("id IS NOT NULL AND source IS NOT NULL AND tokens > 0")
    return named.groupBy("id").agg(F.min(F.struct("source", "tokens")).alias("_one")).select("id", "_one.*")


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7) -> DataFrame:
    """(id, source, tokens, copies): how often each document of a planned source is used, for all that are used at all.

    ``sizes`` has id, source and tokens (see ``usable``). Documents with a NULL id or source, of a source without target, or without tokens are never
    used. The result depends on the seed only, not on the partitioning.
    """
    sizes = cut(usable(sizes))
    planned = cut(plan(sizes, targets, total))
    weighed = sizes.withColumn("_weight", F.pow(F.col("tokens").cast("double"), F.lit(LENGTH_POWER)))
    per_source = planned.join(_scaled(weighed, planned), "source").select("source", "planned", "max_repeats", "scale").filter("planned > 0")
    copies = F.least(F.col("max_repeats").cast("double"), F.coalesce("scale", F.lit(float("inf"))) * F.col("_weight"))
    expected = weighed.join(F.broadcast(per_source), "source").withColumn("_copies", copies)
    expected = expected.withColumn("_whole", F.floor(F.col("_copies") + F.lit(1e-9))).withColumn("_p", F.greatest(F.lit(0.0), F.col("_copies") - F.col("_whole")))
    expected = cut(expected.select("id", "source", "tokens", "planned", "max_repeats", "_whole", "_p"))
    certain = expected.groupBy("source").agg((F.max("planned") - F.sum(F.col("_whole") * F.col("tokens"))).alias("_budget"))
    u = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    rank = F.log(u / (1 - u)) - F.log(F.col("_p") / (1 - F.col("_p")))
    open_ = expected.filter("_p > 0 AND _whole < max_repeats").select("source", F.col("id").alias("_id"), "tokens", rank.alias("_rank"))
    drawn = _lowest(open_, cut(certain)).select(F.col("_id").alias("id"), "source", "tokens", F.lit(1).alias("copies"))
    whole = expected.filter("_whole > 0").select("id", "source", "tokens", F.col("_whole").cast("int").alias("copies"))
    return whole.unionByName(drawn).groupBy("id", "source", "tokens").agg(F.sum("copies").alias("copies"))


def shares(mixed: DataFrame, planned: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, available, planned, binds, used, most_copies, reached, share): what the mix holds."""
    used = mixed.groupBy("source").agg(F.count(F.lit(1)).alias("used"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("reached"))
    both = planned.join(used, "source", "left")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("used", "most_copies", "reached")})
    return both.withColumn("share", F.round(F.col("reached") / F.sum("reached").over(Window.partitionBy()), 6))


def expand(mixed: DataFrame, df: DataFrame, id_col: str) -> DataFrame:
    """The documents themselves, each as often as it is used, with the number of the copy; of rows that repeat an id one is taken."""
    return df.dropDuplicates([id_col]).join(mixed.select(F.col("id").alias(id_col), F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")), id_col)
