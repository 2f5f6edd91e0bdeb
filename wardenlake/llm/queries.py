"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.llm import bpe, confusables, language, mixing, pairs, pii, quantiles, reading
from wardenlake.plans.lineage import cut
from wardenlake.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]

PERF_VALUES = ("execution_time", "token_usage")
PROBS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
REL_ERR = 0.01
#: Labelled documents that fit the language trees; they are ten times as long as messages.
DOCUMENT_ROWS = 2000


def _message_languages(spark: SparkSession, d: str) -> DataFrame:
    messages = table(spark, d, "messages").select("seq", "content", "lang")
    fitted = language.fit(spark, language.sample_labelled(messages, "seq", "content", language.code_column(F.col("lang"))))
    return language.identify(spread(messages), "seq", "content", "lang", fitted)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = language.wrong_or_mixed(_message_languages(spark, d))
    return found.select(F.col("id").alias("seq"), "lang")


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    """Each stretch in one language, with its confidence."""
    rows = _message_languages(spark, d).select(F.col("id").alias("seq"), F.posexplode("segments").alias("segment", "s"))
    return rows.select("seq", "segment", "s.start_pos", "s.length", "s.lang", "s.confidence")


#: The key of the surrogates; a deployment passes its own.
SURROGATE_KEY = b"wardenlake test key"


def _private_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = [
        spread(table(spark, d, t).select("seq", F.col(c).alias("text"))).select(F.lit(t).alias("tbl"), "seq", "text")
        for t, c in (("messages", "content"), ("memory_ops", "value"))
    ]
    return texts[0].unionByName(texts[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    marks = pii.with_surrogates(_private_texts(spark, d), "seq", "text", ["tbl"], SURROGATE_KEY)
    return marks.select("tbl", F.col("id").alias("seq"), F.col("kind").alias("pii_type"), "start_pos")


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every text with typed placeholders, and with surrogates."""
    return pii.replaced_texts(_private_texts(spark, d), "seq", "text", ["tbl"], SURROGATE_KEY).withColumnRenamed("id", "seq")


def _percentiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The percentiles to nine places, as the engines' exponentials differ in the last bit."""
    out = quantiles.percentiles(sketches, keys, PROBS, REL_ERR)
    return out.withColumns({c: F.round(c, 9) for c in PROBS})


def p3_spans(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each agent for every day and week of ``ts`` and of ``ingest_day``, and for all time; each span is made by adding
    the sketches of the spans in it.

    Both days of a row are counted in one scan. The daily sketches are brought together by agent and week once (as many rows as a week has days and
    buckets, however many measurements), where days and weeks are finished; weeks, of which there are few, are then added for all time.
    """
    keys = ["late", "agent_id", "since"]  # late: the day of ingestion, in a narrow column as it is part of every key
    days = F.array(*[F.struct(F.lit(late).alias("late"), day.alias("since")) for late, day in ((False, F.to_date("ts")), (True, F.col("ingest_day")))])
    perf = table(spark, d, "perf").select("agent_id", *PERF_VALUES, F.inline(days))
    day = quantiles.sketch(perf, keys, PERF_VALUES, REL_ERR)
    day = day.withColumn("week", F.to_date(F.date_trunc("week", "since"))).repartition("agent_id", "week")
    # by both columns, though one tells the other, so that days and weeks read one and the same exchange
    week = quantiles.merge(day.withColumn("since", F.to_date(F.date_trunc("week", "since"))), [*keys, "week"])
    # both days count every row once, so either has all rows; a filter instead would be a scan of its own
    ever = quantiles.merge(week.withColumns({"n": F.when(F.col("late"), 0).otherwise(F.col("n")), "late": F.lit(False), "since": F.lit(None).cast("date")}).drop("week"), keys)
    spans = {
        "day": _percentiles(day, [*keys, "week"]).drop("week"),  # the week belongs to the day; naming it keeps the windows where the rows are
        "week": _percentiles(week, [*keys, "week"]).drop("week"),
        "all": _percentiles(ever, keys),
    }
    out = reduce(DataFrame.unionByName, (x.withColumn("span", F.lit(name)) for name, x in spans.items()))
    return out.withColumn("day_of", F.when(F.col("late"), "ingest_day").otherwise("ts")).drop("late")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of both numbers of each agent over all days."""
    keys = ["agent_id"]
    return _percentiles(quantiles.sketch(table(spark, d, "perf"), keys, PERF_VALUES, REL_ERR), keys)


def p3_daily_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The same of each agent and day of ``ts``."""
    keys = ["agent_id", "day"]
    perf = table(spark, d, "perf").withColumn("day", F.to_date("ts"))
    return _percentiles(quantiles.sketch(perf, keys, PERF_VALUES, REL_ERR), keys)


def p3_merged_weeks(spark: SparkSession, d: str) -> DataFrame:
    """Sketches of single ingest days, combined to weeks."""
    daily = quantiles.sketch(table(spark, d, "perf"), ["agent_id", "ingest_day"], PERF_VALUES, REL_ERR)
    weekly = quantiles.merge(daily.withColumn("week", F.to_date(F.date_trunc("week", "ingest_day"))), ["agent_id", "week"])
    return _percentiles(weekly, ["agent_id", "week"])


def _two_texts(spark: SparkSession, d: str) -> DataFrame:
    texts = [spread(table(spark, d, t).select("seq", "content")).select(F.lit(t).alias("tbl"), "seq", "content") for t in ("messages", "attacks")]
    return texts[0].unionByName(texts[1])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = confusables.same_look_pairs(_two_texts(spark, d), "seq", "content", ["tbl"])
    return pairs.select("tbl", F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """One consistent form for each content."""
    return confusables.consistent_forms(_two_texts(spark, d), "seq", "content", ["tbl"])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """(id, text, lang) of all rows of both corpora that say in which language they are."""
    texts = [
        spread(table(spark, d, t).select(F.col(i).cast("string").alias("id"), F.col(c).alias("text"), language.code_column(F.col("lang")).alias("lang")).filter("lang IS NOT NULL"))
        for t, i, c in (("messages", "seq", "content"), ("documents", "doc_id", "text"))
    ]
    return texts[0].unionByName(texts[1])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    evals = spread(table(spark, d, "evals").select("seq", "input", "output", "expected"))
    known = pairs.all_pairs(evals, "input", "output", "expected")
    fitted = pairs.adapted(spark, _labelled(spark, d), known)
    return pairs.find_defects(evals, "seq", "input", "output", fitted, pairs.fit_endings(known))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(spread(table(spark, d, "documents").select("doc_id", "text")))


def _document_sizes(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return documents.select(F.col("doc_id").alias("id"), "source", bpe.count_column(F.col("text")).alias("tokens"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """How often each document is used."""
    mixed = mixing.mix(_document_sizes(spark, d), table(spark, d, "mix_targets"))
    return mixed.withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mix reaches."""
    sizes, targets = cut(mixing.usable(_document_sizes(spark, d))), table(spark, d, "mix_targets")
    return mixing.shares(mixing.mix(sizes, targets), mixing.plan(sizes, targets))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "text", "lang")
    samples = table(spark, d, "level_samples")
    labelled = language.sample_labelled(documents, "doc_id", "text", language.code_column(F.col("lang")), DOCUMENT_ROWS)
    labelled += language.sample_labelled(samples, "sample_id", "text", language.code_column(F.col("lang")), DOCUMENT_ROWS)
    found = reading.grades(documents, "doc_id", "text", samples, reading.fit_votes(spark, labelled))
    return found.select(F.col("id").alias("doc_id"), "grade")


def _percentile_sql(keys: dict[str, str]) -> str:
    """The buckets and ranks of ``quantiles`` in DuckDB's SQL."""
    names = ", ".join(keys)
    made = ", ".join(f"{e} AS {k}" for k, e in keys.items())
    lg = f"ln({1 + REL_ERR!r} / {1 - REL_ERR!r})"
    bucket = f"""CASE WHEN v IS NULL OR isnan(v) THEN NULL WHEN v = 0 THEN 0
        ELSE CAST(sign(v) AS INT) * (CAST(ceil(ln(abs(v)) / {lg}) AS INT) + {quantiles.OFFSET}) END"""
    picks = ",\n".join(f"min(CASE WHEN bucket IS NOT NULL AND upto >= greatest(1, ceil({p} * total)) THEN bucket END) AS b_{c}" for c, p in PROBS.items())
    values = ",\n".join(
        f"round(CASE WHEN b_{c} = 0 THEN 0.0 ELSE sign(b_{c}) * exp((abs(b_{c}) - {quantiles.OFFSET}) * {lg} + ln(2 / (exp({lg}) + 1))) END, 9) AS {c}" for c in PROBS
    )
    return f"""
    WITH long AS (
        SELECT {made}, 'execution_time' AS metric, execution_time AS v FROM perf
        UNION ALL SELECT {made}, 'token_usage', CAST(token_usage AS DOUBLE) FROM perf),
    counted AS (SELECT {names}, metric, {bucket} AS bucket, count(*) AS c FROM long GROUP BY ALL),
    ranked AS (SELECT *, CASE WHEN bucket IS NULL THEN 0 ELSE c END AS k,
        sum(CASE WHEN bucket IS NULL THEN 0 ELSE c END) OVER (PARTITION BY {names}, metric ORDER BY bucket NULLS FIRST) AS upto,
        sum(CASE WHEN bucket IS NULL THEN 0 ELSE c END) OVER (PARTITION BY {names}, metric) AS total FROM counted),
    picked AS (SELECT {names}, metric, CAST(sum(k) AS BIGINT) AS n, CAST(sum(c - k) AS BIGINT) AS n_missing, {picks} FROM ranked GROUP BY {names}, metric)
    SELECT {names}, metric, n, n_missing, {values}, CAST({REL_ERR} AS DOUBLE) AS rel_err FROM picked"""


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_segments": p1_segments,
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p3_spans": p3_spans,
    "p3_percentiles": p3_percentiles,
    "p3_daily_percentiles": p3_daily_percentiles,
    "p3_merged_weeks": p3_merged_weeks,
    "p4_found": p4_found,
    "p4_forms": p4_forms,
    "p5_found": p5_found,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p8_found": p8_found,
}

_DAY = "CAST(ts AT TIME ZONE 'UTC' AS DATE)"
_SPANS = [
    ("day", "ts", _DAY),
    ("week", "ts", f"CAST(date_trunc('week', {_DAY}) AS DATE)"),
    ("all", "ts", "CAST(NULL AS DATE)"),
    ("day", "ingest_day", "ingest_day"),
    ("week", "ingest_day", "CAST(date_trunc('week', ingest_day) AS DATE)"),
]

ORACLES: dict[str, str] = {
    "p3_spans": " UNION ALL ".join(
        f"SELECT *, '{span}' AS span, '{day_of}' AS day_of FROM ({_percentile_sql({'agent_id': 'agent_id', 'since': e})})" for span, day_of, e in _SPANS
    ),
    "p3_percentiles": _percentile_sql({"agent_id": "agent_id"}),
    "p3_daily_percentiles": _percentile_sql({"agent_id": "agent_id", "day": "CAST(ts AT TIME ZONE 'UTC' AS DATE)"}),
    "p3_merged_weeks": _percentile_sql({"agent_id": "agent_id", "week": "CAST(date_trunc('week', ingest_day) AS DATE)"}),
}
