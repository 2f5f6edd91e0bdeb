"""The registered queries of the core, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardenlake.operators import attacks, evaluation, memory, observability, patches, performance, taint, trust
from wardenlake.operators.lastn import last_n
from wardenlake.operators.policy import PolicyEnforcer
from wardenlake.operators.screen import Firewall
from wardenlake.plans.pipeline import Middleware
from wardenlake.sources.adapters import ConversationsAdapter
from wardenlake.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def rounded(column: str) -> Column:
    """Six places. Means of few rows often lie halfway between two rounded values; 1e-9 takes them to one side in either engine."""
    return F.round(F.col(column) + F.lit(1e-9), 6).alias(column)


def _any(column: str, phrases: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({column}), '{p}') THEN '{p}'" for p in phrases) + " END"


# --- screening -----------------------------------------------------------------------------------------------------------------------
ALLOW, BLOCK_EMAIL, BLOCK_WORD = "planning agent", "[a-z0-9_.+-]+@[a-z0-9.-]+[.][a-z]+", "[Oo]verride|[Dd]isregard"


def firewall() -> Firewall:
    wall = Firewall()
    wall.add_allowed_pattern(ALLOW)
    wall.add_blocked_pattern(BLOCK_EMAIL)
    wall.add_blocked_pattern(BLOCK_WORD)
    wall.add_custom_filter(lambda c: F.length(c) > 300)
    return wall


_MATCH = f"""CASE WHEN content IS NULL OR regexp_matches(content, '{ALLOW}') THEN NULL WHEN regexp_matches(content, '{BLOCK_EMAIL}') THEN 0
    WHEN regexp_matches(content, '{BLOCK_WORD}') THEN 1 WHEN length(content) > 300 THEN 2 END"""
_SCREEN = f"""SELECT *, rule_index IS NULL AS allowed, CASE WHEN rule_index < 2 THEN 'high' WHEN rule_index = 2 THEN 'medium' END AS severity,
    CASE rule_index WHEN 0 THEN 'Input matched blocked pattern: {BLOCK_EMAIL}' WHEN 1 THEN 'Input matched blocked pattern: {BLOCK_WORD}' WHEN 2 THEN 'Input blocked by custom filter' END AS description
    FROM (SELECT seq, role, content, CAST({_MATCH} AS INT) AS rule_index FROM messages)"""


_REDACTED = f"regexp_replace(regexp_replace(content, '{BLOCK_EMAIL}', '[REDACTED]', 'g'), '{BLOCK_WORD}', '[REDACTED]', 'g')"


@query(f"""SELECT seq, role, allowed, severity, description, rule_index, {_REDACTED} AS redacted,
    {_any('content', attacks.INJECTION)} AS injection, {_any('content', attacks.JAILBREAK)} AS jailbreak FROM ({_SCREEN})""")
def firewall_screen(spark: SparkSession, d: str) -> DataFrame:
    """Which messages are unsafe, why, and how they look redacted."""
    wall = firewall()
    content = F.col("content")
    return wall.check(table(spark, d, "messages").select("seq", "role", "content")).select(
        "seq", "role", "allowed", "severity", "description", "rule_index", wall.sanitize(content).alias("redacted"),
        attacks.first_indicator(content, attacks.INJECTION).alias("injection"), attacks.first_indicator(content, attacks.JAILBREAK).alias("jailbreak"),
    )


@query(f"SELECT seq, 'blocked_input' AS event_type, severity, description, substring(content, 1, 100) AS content_snippet FROM ({_SCREEN}) WHERE severity = 'high'")
def firewall_events_high(spark: SparkSession, d: str) -> DataFrame:
    return firewall().events(table(spark, d, "messages"), severity="high")


@query(f"""SELECT seq, 'blocked_input' AS event_type, severity, description, substring(content, 1, 100) AS content_snippet FROM ({_SCREEN}) WHERE NOT allowed ORDER BY seq DESC LIMIT 25""")
def firewall_events_last(spark: SparkSession, d: str) -> DataFrame:
    """The last 25 security events."""
    return firewall().events(table(spark, d, "messages"), limit=25)


@query(f"SELECT seq, {_REDACTED} AS redacted FROM messages")
def firewall_redact(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages").select("seq", firewall().sanitize(F.col("content")).alias("redacted"))


@query(f"SELECT count(*) FILTER (NOT allowed) AS total_blocked, count(*) FILTER (NOT allowed) AS security_events, 2 AS blocked_patterns, 1 AS allowed_patterns, 1 AS custom_filters FROM ({_SCREEN})")
def firewall_stats(spark: SparkSession, d: str) -> DataFrame:
    return firewall().stats(table(spark, d, "messages"))


# --- attacks -------------------------------------------------------------------------------------------------------------------------
@query(f"SELECT seq, {_any('content', attacks.INJECTION)} AS found FROM attacks")
def detect_injection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attacks").select("seq", attacks.first_indicator(F.col("content"), attacks.INJECTION).alias("found"))


@query(f"SELECT seq, {_any('content', attacks.JAILBREAK)} AS found FROM attacks")
def detect_jailbreak(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "attacks").select("seq", attacks.first_indicator(F.col("content"), attacks.JAILBREAK).alias("found"))


_THREATS = f"SELECT seq, substring(content, 1, 100) AS content, {_any('content', attacks.INJECTION)} AS i, {_any('content', attacks.JAILBREAK)} AS j FROM messages"


@query(f"""SELECT seq, concat_ws(',', CASE WHEN i IS NOT NULL THEN 'prompt_injection' END, CASE WHEN j IS NOT NULL THEN 'jailbreak' END) AS threats, i IS NULL AND j IS NULL AS is_safe FROM ({_THREATS})""")
def analyze_threats(spark: SparkSession, d: str) -> DataFrame:
    return attacks.analyze(table(spark, d, "messages")).select("seq", F.array_join("threats_detected", ",").alias("threats"), "is_safe")


_ATTACKS = f"SELECT seq, 'prompt_injection' AS attack_type, content, i AS indicator FROM ({_THREATS}) WHERE i IS NOT NULL UNION ALL SELECT seq, 'jailbreak', content, j FROM ({_THREATS}) WHERE j IS NOT NULL"


@query(f"SELECT attack_type, indicator, count(*) AS n FROM ({_ATTACKS}) GROUP BY ALL")
def attacks_by_type(spark: SparkSession, d: str) -> DataFrame:
    return attacks.detected_attacks(table(spark, d, "messages")).groupBy("attack_type", "indicator").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT * FROM ({_ATTACKS}) WHERE attack_type = 'jailbreak' ORDER BY seq DESC LIMIT 20")
def attacks_last(spark: SparkSession, d: str) -> DataFrame:
    return attacks.detected_attacks(table(spark, d, "messages"), attack_type="jailbreak", limit=20)


# --- last-N --------------------------------------------------------------------------------------------------------------------------
@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 50")
def recent_events_last_n(spark: SparkSession, d: str) -> DataFrame:
    return last_n(table(spark, d, "events").select("event_id", "user_id", "event_type"), 50, "event_id", event_type="error")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id OFFSET 50")
def recent_events_skip_n(spark: SparkSession, d: str) -> DataFrame:
    return last_n(table(spark, d, "events").select("event_id", "user_id", "event_type"), -50, "event_id", event_type="")


# --- trust ---------------------------------------------------------------------------------------------------------------------------
_DELTA = "CAST(CASE event_type WHEN 'error' THEN -0.3 WHEN 'signup' THEN 0.2 WHEN 'purchase' THEN 0.1 ELSE -0.05 END AS DOUBLE)"
_CURRENT = f"SELECT user_id AS agent_id, list_reduce(list_prepend(CAST(0.5 AS DOUBLE), list({_DELTA} ORDER BY event_id)), lambda s, x: greatest(0.0, least(1.0, s + x))) AS score FROM events GROUP BY user_id"


def trust_ops(spark: SparkSession, d: str) -> DataFrame:
    """Trust operations made of events."""
    return table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("agent_id"), F.expr(_DELTA).alias("delta"), F.create_map(F.lit("value"), F.col("value")).alias("factors"))


@query(f"SELECT agent_id, round(score, 6) AS score FROM ({_CURRENT})")
def trust_current(spark: SparkSession, d: str) -> DataFrame:
    return trust.current(trust_ops(spark, d)).select("agent_id", F.round("score", 6).alias("score"))


@query(f"""WITH RECURSIVE ops AS (SELECT user_id AS agent_id, event_id AS seq, {_DELTA} AS delta, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    walk AS (SELECT agent_id, seq, n, greatest(0.0, least(1.0, 0.5 + delta)) AS score, value FROM ops WHERE n = 1
      UNION ALL SELECT o.agent_id, o.seq, o.n, greatest(0.0, least(1.0, w.score + o.delta)), o.value FROM walk w JOIN ops o ON o.agent_id = w.agent_id AND o.n = w.n + 1)
    SELECT agent_id, seq, round(score, 6) AS score, CAST(1.0 AS DOUBLE) AS confidence, CAST(value AS DOUBLE) AS factor_value FROM walk""")
def trust_history(spark: SparkSession, d: str) -> DataFrame:
    return trust.history(trust_ops(spark, d)).select("agent_id", "seq", F.round("score", 6).alias("score"), "confidence", F.col("factors")["value"].alias("factor_value"))


@query(f"SELECT agent_id, round(score, 6) AS score FROM ({_CURRENT}) WHERE round(score, 6) >= 0.6")
def trusted_agents(spark: SparkSession, d: str) -> DataFrame:
    return trust.trusted(trust.current(trust_ops(spark, d)).withColumn("score", F.round("score", 6)))


@query(f"""SELECT a.agent_id, round(greatest(0.0, least(1.0, coalesce(t.score, 0.5) + coalesce(-0.1 * len(policy_violations), 0) + coalesce(trust_score, 0))), 6) AS score,
    CAST(0.8 AS DOUBLE) AS confidence, round(CAST(-0.1 AS DOUBLE) * len(policy_violations), 6) + CAST(0 AS DOUBLE) AS policy_compliance, trust_score AS self_reported FROM agent_states a LEFT JOIN ({_CURRENT}) t USING (agent_id)""")
def trust_evaluate_state(spark: SparkSession, d: str) -> DataFrame:
    out = trust.evaluate_states(table(spark, d, "agent_states"), trust.current(trust_ops(spark, d)))
    return out.select("agent_id", F.round("score", 6).alias("score"), "confidence", F.round(F.col("factors")["policy_compliance"], 6).alias("policy_compliance"), F.col("factors")["self_reported"].alias("self_reported"))


# --- performance ---------------------------------------------------------------------------------------------------------------------
_TIME = "CASE WHEN isnan(execution_time) THEN NULL ELSE execution_time END"
_OK = "CAST(coalesce(success, false) AS INT)"


@query(f"""SELECT seq, agent_id, count(*) OVER w AS total_executions, round(CAST(sum(CAST({_TIME} AS DECIMAL(38, 9))) OVER w AS DOUBLE) / count({_TIME}) OVER w + 1e-9, 6) AS avg_execution_time, round(avg({_OK}) OVER w + 1e-9, 6) AS success_rate
    FROM perf WINDOW w AS (PARTITION BY agent_id ORDER BY seq)""")
def perf_running_stats(spark: SparkSession, d: str) -> DataFrame:
    out = performance.running_stats(table(spark, d, "perf"))
    return out.select("seq", "agent_id", F.col("total_executions").cast("bigint").alias("total_executions"), rounded("avg_execution_time"), rounded("success_rate"))


@query(f"SELECT agent_id, count(*) AS total_executions, round(avg({_TIME}) + 1e-9, 6) AS avg_execution_time, round(avg({_OK}) + 1e-9, 6) AS success_rate FROM perf GROUP BY agent_id")
def perf_stats(spark: SparkSession, d: str) -> DataFrame:
    out = performance.statistics(table(spark, d, "perf"))
    return out.select("agent_id", "total_executions", *[rounded(c) for c in ("avg_execution_time", "success_rate")])


@query(f"""WITH a AS (SELECT agent_id, avg({_TIME}) AS t, arg_min_null(token_usage, seq) AS f, avg(coalesce(token_usage, 0)) AS k FROM perf GROUP BY agent_id)
    SELECT agent_id, 'performance' AS type, 'medium' AS severity, '{performance.SLOW}' AS suggestion, 'execution_time' AS metric, round(t + 1e-9, 6) AS value FROM a WHERE t > 5
    UNION ALL SELECT agent_id, 'efficiency', 'low', '{performance.EXPENSIVE}', 'token_usage', round(k + 1e-9, 6) FROM a WHERE coalesce(f, 0) <> 0 AND k > 1000""")
def perf_suggestions(spark: SparkSession, d: str) -> DataFrame:
    return performance.suggestions(table(spark, d, "perf")).withColumn("value", rounded("value"))


# --- evaluation ----------------------------------------------------------------------------------------------------------------------
@query("""WITH m AS (SELECT unnest(map_entries(metrics)) AS e FROM evals)
    SELECT e.key AS metric, round(avg(e.value) + 1e-9, 6) AS score, count(*) AS n FROM m WHERE e.value IS NOT NULL AND NOT isnan(e.value) GROUP BY e.key""")
def eval_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.aggregate(table(spark, d, "evals")).withColumn("score", rounded("score"))


@query("""SELECT seq, CAST(length(output) AS DOUBLE) AS characters, CASE WHEN expected IS NULL OR output IS NULL THEN NULL ELSE CAST(output = expected AS DOUBLE) END AS exact FROM evals""")
def eval_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two metrics of each response."""
    judge = evaluation.Evaluator()
    judge.register_metric("characters", lambda o, _: F.length(o))
    judge.register_metric("exact", lambda o, e: (o == e).cast("double"))
    return judge.evaluate(table(spark, d, "evals")).select("seq", F.col("metrics")["characters"].alias("characters"), F.col("metrics")["exact"].alias("exact"))


@query("SELECT seq, agent_id, output FROM evals WHERE agent_id = 7 ORDER BY seq DESC LIMIT 10")
def eval_results_last(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.results(table(spark, d, "evals").select("seq", "agent_id", "output"), 7, 10)


# --- traces, logs, series ------------------------------------------------------------------------------------------------------------
_TRACE_OPS = """SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'event' END AS kind, CAST(user_id AS VARCHAR) AS trace_id,
    user_id AS agent_id, event_type AS operation, CASE WHEN event_type = 'purchase' THEN CASE WHEN value > 50 THEN 'completed' ELSE 'failed' END END AS status, props AS description, props AS metadata, props AS result FROM events"""


def trace_ops(spark: SparkSession, d: str) -> DataFrame:
    """Trace operations made of events."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "end").otherwise("event")
    status = F.when(F.col("event_type") == "purchase", F.when(F.col("value") > 50, "completed").otherwise("failed"))
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), kind.alias("kind"), F.col("user_id").cast("string").alias("trace_id"), F.col("user_id").alias("agent_id"),
        F.col("event_type").alias("operation"), status.alias("status"), *[F.col("props").alias(c) for c in ("description", "metadata", "result")],
    )


_TRACES = f"""WITH ops AS ({_TRACE_OPS}), first AS (SELECT trace_id, min(seq) AS f FROM ops WHERE kind = 'start' GROUP BY 1),
    later AS (SELECT trace_id, max(seq) FILTER (kind = 'end') AS e, arg_max(status, seq) FILTER (kind = 'end') AS s, arg_max(result, seq) FILTER (kind = 'end') AS r, count(*) FILTER (kind = 'event') AS n
      FROM ops JOIN first USING (trace_id) WHERE kind <> 'start' AND seq > f GROUP BY 1)
    SELECT seq, ops.trace_id, agent_id, operation, CASE WHEN seq = f AND e IS NOT NULL THEN s ELSE 'active' END AS status,
      CASE WHEN seq = f THEN e END AS end_seq, CASE WHEN seq = f THEN coalesce(n, 0) ELSE 0 END AS events, metadata, CASE WHEN seq = f THEN r END AS result
    FROM ops JOIN first USING (trace_id) LEFT JOIN later ON later.trace_id = ops.trace_id WHERE kind = 'start'"""


@query(_TRACES)
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    return observability.traces(trace_ops(spark, d))


@query(f"SELECT * FROM ({_TRACES}) WHERE status = 'failed' ORDER BY seq DESC LIMIT 15")
def traces_failed_last(spark: SparkSession, d: str) -> DataFrame:
    return observability.traces(trace_ops(spark, d), status="failed", limit=15)


@query(f"""WITH ops AS ({_TRACE_OPS}), first AS (SELECT trace_id, min(seq) AS f FROM ops WHERE kind = 'start' GROUP BY 1)
    SELECT trace_id, seq, operation, description, metadata FROM ops JOIN first USING (trace_id) WHERE kind = 'event' AND seq > f""")
def trace_events(spark: SparkSession, d: str) -> DataFrame:
    return observability.trace_events(trace_ops(spark, d))


@query("SELECT event_id AS seq, event_type AS level, props AS message, user_id AS agent_id FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 30")
def logs_by_level(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("level"), F.col("props").alias("message"), F.col("user_id").alias("agent_id"))
    return observability.logs(rows, level="error", limit=30)


@query("SELECT event_type AS metric_name, count(value) AS n, min(value) AS min_value, max(value) AS max_value, round(avg(value) + 1e-9, 6) AS avg_value FROM events GROUP BY 1")
def metric_stats(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").select(F.col("event_type").alias("metric_name"), "value")
    return observability.metric_stats(points).withColumn("avg_value", rounded("avg_value"))


# --- taint ---------------------------------------------------------------------------------------------------------------------------
_K = "CAST(props->>'$.k' AS INT)"
_TAINT_OPS = f"""SELECT event_id AS seq, CASE event_type WHEN 'signup' THEN 'mark' WHEN 'error' THEN 'sanitize' ELSE 'propagate' END AS kind, user_id || ':' || ({_K} % 8) AS data_id,
    user_id || ':' || (({_K} // 8) % 8) AS to_data_id, CASE WHEN {_K} % 7 <> 0 THEN 's' || ({_K} % 5) END AS source_id, event_type AS operation FROM events"""
_SOURCES = "SELECT * FROM (VALUES ('s0', 'user_input', 'low'), ('s1', 'user_input', 'medium'), ('s2', 'tool', 'high'), ('s3', 'web', 'critical')) v(source_id, source_type, level)"
_FACTS = f"""ops AS ({_TAINT_OPS}), sources AS ({_SOURCES}),
    touch AS (SELECT seq, kind, 'from' AS role, data_id AS id FROM ops UNION ALL SELECT seq, kind, 'to', to_data_id FROM ops WHERE kind = 'propagate'),
    epochs AS (SELECT seq, kind, role, id, sum(CASE WHEN kind = 'sanitize' AND role = 'from' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY seq) AS epoch FROM touch),
    edges AS (SELECT o.seq, o.data_id, f.epoch, o.to_data_id, t.epoch AS to_epoch, o.operation FROM ops o JOIN epochs f ON f.seq = o.seq AND f.role = 'from' JOIN epochs t ON t.seq = o.seq AND t.role = 'to' WHERE o.kind = 'propagate'),
    facts AS (SELECT o.data_id, e.epoch, o.source_id, o.seq AS since FROM ops o JOIN epochs e ON e.seq = o.seq AND e.role = 'from' WHERE o.kind = 'mark' AND o.source_id IS NOT NULL
      UNION SELECT g.to_data_id, g.to_epoch, f.source_id, g.seq FROM facts f JOIN edges g ON g.data_id = f.data_id AND g.epoch = f.epoch AND f.since < g.seq),
    last AS (SELECT id AS data_id, max(epoch) AS epoch FROM epochs GROUP BY 1),
    now AS (SELECT DISTINCT data_id, source_id FROM facts JOIN last USING (data_id, epoch)),
    entries AS (SELECT data_id FROM facts JOIN last USING (data_id, epoch) UNION SELECT e.id FROM epochs e JOIN last l ON l.data_id = e.id AND l.epoch = e.epoch WHERE e.kind = 'mark'),
    live AS (SELECT DISTINCT g.* FROM edges g JOIN facts f ON f.data_id = g.data_id AND f.epoch = g.epoch AND f.since < g.seq)"""


def taint_ops(spark: SparkSession, d: str) -> DataFrame:
    """Taint operations made of events."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.when(F.col("event_type") == "signup", "mark").when(F.col("event_type") == "error", "sanitize").otherwise("propagate")
    user = F.col("user_id").cast("string")
    return table(spark, d, "events").select(
        F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(user, F.lit(":"), (k % 8).cast("string")).alias("data_id"),
        F.concat(user, F.lit(":"), (F.floor(k / 8).cast("int") % 8).cast("string")).alias("to_data_id"), F.when(k % 7 != 0, F.concat(F.lit("s"), (k % 5).cast("string"))).alias("source_id"), F.col("event_type").alias("operation"),
    )


def _taint_sources(spark: SparkSession) -> DataFrame:
    rows = [(1, "s0", "user_input", "low"), (2, "s1", "user_input", "medium"), (3, "s2", "tool", "high"), (4, "s3", "web", "critical")]
    return taint.register_sources(spark.createDataFrame(rows, "seq bigint, source_id string, source_type string, level string"))


@query(f"""WITH RECURSIVE {_FACTS} SELECT data_id, bool_or(n.source_id IS NOT NULL) AS is_tainted,
    list_extract(['untainted', 'low', 'medium', 'high', 'critical'], coalesce(max(list_position(['untainted', 'low', 'medium', 'high', 'critical'], s.level)), 1)) AS level
    FROM last LEFT JOIN now n USING (data_id) LEFT JOIN sources s ON s.source_id = n.source_id GROUP BY data_id""")
def taint_levels(spark: SparkSession, d: str) -> DataFrame:
    log = taint.replay(taint_ops(spark, d))
    return taint.levels(taint.current_taint(log.facts, log.epochs), _taint_sources(spark), log.epochs)


@query(f"WITH RECURSIVE {_FACTS} SELECT data_id, source_id, source_type, level FROM now JOIN sources USING (source_id)")
def taint_sources(spark: SparkSession, d: str) -> DataFrame:
    log = taint.replay(taint_ops(spark, d))
    return taint.taint_sources(taint.current_taint(log.facts, log.epochs), _taint_sources(spark))


@query(f"WITH RECURSIVE {_FACTS} SELECT seq, data_id, to_data_id, operation FROM live")
def taint_flow(spark: SparkSession, d: str) -> DataFrame:
    return taint.flow(taint.replay(taint_ops(spark, d)).propagations)


@query(f"""WITH RECURSIVE {_FACTS} SELECT 'total_sources' AS measure, count(*) AS n FROM sources UNION ALL SELECT 'tainted_data', count(*) FROM entries
    UNION ALL SELECT 'propagations', count(*) FROM live UNION ALL SELECT 'level_' || level, count(*) FROM now JOIN sources USING (source_id) GROUP BY level""")
def taint_stats(spark: SparkSession, d: str) -> DataFrame:
    log = taint.replay(taint_ops(spark, d))
    return taint.stats(taint.current_taint(log.facts, log.epochs), _taint_sources(spark), log.propagations, log.entries)


# --- memory --------------------------------------------------------------------------------------------------------------------------
CAPACITY = 20
_SHORT = """c AS (SELECT *, sum(CASE WHEN kind = 'clear' THEN 1 ELSE 0 END) OVER w AS epoch, sum(CASE WHEN kind = 'store' THEN 1 ELSE 0 END) OVER w AS stored
    FROM memory_ops WHERE tier = 'short' WINDOW w AS (PARTITION BY store_id ORDER BY seq))"""


@query(f"""WITH {_SHORT} SELECT r.seq, r.store_id, r.mkey, coalesce(s.stored > r.stored - {CAPACITY}, false) AS hit, CASE WHEN s.stored > r.stored - {CAPACITY} THEN s.value END AS value
    FROM (SELECT * FROM c WHERE kind = 'retrieve') r ASOF LEFT JOIN (SELECT * FROM c WHERE kind = 'store') s ON r.store_id = s.store_id AND r.epoch = s.epoch AND r.mkey = s.mkey AND r.seq >= s.seq""")
def memory_recall(spark: SparkSession, d: str) -> DataFrame:
    return memory.recall_short(table(spark, d, "memory_ops"), CAPACITY)


_LIVE = f"""WITH {_SHORT}, last AS (SELECT store_id, max(epoch) AS e, max(stored) AS n FROM c GROUP BY 1)
    SELECT store_id, seq, mkey, value FROM c JOIN last USING (store_id) WHERE kind = 'store' AND epoch = e AND stored > n - {CAPACITY}"""


@query(f"SELECT store_id, count(*) AS items, {CAPACITY} AS capacity FROM ({_LIVE}) GROUP BY store_id")
def memory_stats(spark: SparkSession, d: str) -> DataFrame:
    return memory.stats_short(table(spark, d, "memory_ops"), CAPACITY)


@query(f"SELECT store_id, seq, mkey, value FROM ({_LIVE}) WHERE contains(lower(value), 'agent') ORDER BY seq DESC LIMIT 10")
def memory_search(spark: SparkSession, d: str) -> DataFrame:
    return memory.search(memory.live_short(table(spark, d, "memory_ops"), CAPACITY), "agent")


LONG = 50
_BUMP = "list_transform(cur, lambda x, i: struct_pack(k := x.k, v := x.v, a := x.a + CASE WHEN list_contains(met, i) THEN 1 ELSE 0 END, t := CASE WHEN kind = 'retrieve' AND list_contains(met, i) THEN seq ELSE x.t END))"
_PUT = "list_append(cur, struct_pack(k := mkey, v := value, a := CAST(0 AS BIGINT), t := CAST(NULL AS BIGINT)))"
#: Both tiers replayed in SQL, all stores in step: one round of the recursion for each operation of the busiest store.
_WALK = f"""RECURSIVE o AS (SELECT seq, store_id, kind, CASE WHEN tier = 'long' THEN 'long' ELSE 'short' END AS tier, mkey, value, query, row_number() OVER (PARTITION BY store_id ORDER BY seq) AS i
      FROM memory_ops WHERE store_id IS NOT NULL),
    walk AS (
      SELECT DISTINCT store_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS tier, CAST([] AS STRUCT(k VARCHAR, v VARCHAR, a BIGINT, t BIGINT)[]) AS s,
        CAST([] AS STRUCT(k VARCHAR, v VARCHAR, a BIGINT, t BIGINT)[]) AS l, CAST(NULL AS BOOLEAN) AS hit, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS BIGINT) AS n FROM o
      UNION ALL
      SELECT store_id, i, seq, kind, tier, CASE WHEN tier = 'short' AND kind <> 'consolidate' THEN next ELSE s END, CASE WHEN kind = 'consolidate' THEN list_concat(l, moved) WHEN tier = 'long' THEN next ELSE l END,
        CASE WHEN kind = 'retrieve' THEN len(met) > 0 END, CASE WHEN kind = 'retrieve' AND len(met) > 0 THEN cur[met[1]].v END, CASE kind WHEN 'search' THEN len(met) WHEN 'consolidate' THEN len(moved) END
      FROM (
        SELECT *, CASE kind WHEN 'clear' THEN list_filter(cur, lambda x: false)
          WHEN 'store' THEN CASE WHEN len(cur) < CASE tier WHEN 'long' THEN {LONG} ELSE {CAPACITY} END THEN put
            WHEN tier = 'short' THEN list_slice(put, 2, len(put))
            ELSE list_slice(list_transform(list_sort(list_transform(put, lambda x, i: struct_pack(a := x.a, i := i))), lambda y: put[y.i]), 2, len(put)) END
          ELSE {_BUMP} END AS next
        FROM (
          SELECT *, {_PUT} AS put, list_filter(s, lambda x: x.a >= {memory.CONSOLIDATE_FROM}) AS moved, CASE kind
            WHEN 'retrieve' THEN list_slice(list_filter(list_reverse(range(1, len(cur) + 1)), lambda j: coalesce(cur[j].k = mkey, false)), 1, 1)
            WHEN 'search' THEN list_slice(list_filter(list_reverse(range(1, len(cur) + 1)), lambda j: coalesce(contains(lower(coalesce(cur[j].v, 'None')), lower(query)), false)), 1, 10)
            ELSE CAST([] AS BIGINT[]) END AS met
          FROM (SELECT o.*, w.s, w.l, CASE o.tier WHEN 'long' THEN w.l ELSE w.s END AS cur FROM walk w JOIN o ON o.store_id = w.store_id AND o.i = w.i + 1))))"""
_LAST = "SELECT store_id, arg_max(s, i) AS s, arg_max(l, i) AS l FROM walk GROUP BY store_id"


@query(f"WITH {_WALK} SELECT seq, store_id, kind, tier, hit, value, n, len(s) AS short_items, len(l) AS long_items FROM walk WHERE i > 0")
def memory_replay(spark: SparkSession, d: str) -> DataFrame:
    """Every operation on both tiers."""
    return memory.replay(table(spark, d, "memory_ops"), CAPACITY, LONG)


@query(f"""WITH {_WALK}, ends AS ({_LAST}), x AS (SELECT store_id, unnest(l) AS e, unnest(range(1, len(l) + 1)) AS position FROM ends)
    SELECT store_id, 'long' AS tier, position, e.k AS mkey, e.v AS value, e.a AS access_count, e.t AS last_accessed FROM x""")
def memory_eviction(spark: SparkSession, d: str) -> DataFrame:
    """What the long tiers hold in the end, after all evictions."""
    return memory.items(table(spark, d, "memory_ops"), CAPACITY, LONG).filter("tier = 'long'")


@query(f"WITH {_WALK} SELECT seq, store_id, n, len(l) AS long_items FROM walk WHERE kind = 'consolidate'")
def memory_consolidate(spark: SparkSession, d: str) -> DataFrame:
    """How many items each consolidation copies to the long tier."""
    return memory.replay(table(spark, d, "memory_ops"), CAPACITY, LONG).filter("kind = 'consolidate'").select("seq", "store_id", "n", "long_items")


@query(f"WITH {_WALK}, ends AS ({_LAST}) SELECT store_id, len(s) AS short_items, len(l) AS long_items, {CAPACITY} AS short_capacity, {LONG} AS long_capacity FROM ends")
def memory_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The sizes of both tiers in the end."""
    return memory.tier_sizes(memory.replay(table(spark, d, "memory_ops"), CAPACITY, LONG), CAPACITY, LONG)


# --- policy, middleware, patches, adapters -------------------------------------------------------------------------------------------
_VIOLATIONS = """SELECT seq, 'no_override' AS rule_name, 'message' AS violation_type, 'high' AS severity, 'block' AS action, content AS data FROM messages WHERE contains(lower(content), 'override')
    UNION ALL SELECT seq, 'short', 'message', 'low', 'warn', content FROM messages WHERE length(content) > 200"""


def message_rules() -> PolicyEnforcer:
    rules = PolicyEnforcer(sql_conditions=True)
    rules.add_rule("no_override", "No overriding", "contains(lower(content), 'override')", "block", "high")
    rules.add_rule("short", "Messages are short", "length(content) > 200", "warn", "low")
    return rules


@query(_VIOLATIONS)
def policy_violations(spark: SparkSession, d: str) -> DataFrame:
    """Conditions in SQL, an extension."""
    return message_rules().violations(table(spark, d, "messages"), data=F.col("content"))


@query(f"SELECT * FROM ({_VIOLATIONS}) WHERE severity = 'low' ORDER BY seq DESC LIMIT 20")
def policy_violations_last(spark: SparkSession, d: str) -> DataFrame:
    """The last violations of one severity."""
    return message_rules().violations(table(spark, d, "messages"), severity="low", limit=20, data=F.col("content"))


@query("""SELECT agent_id, 'trusted' AS rule_name, 'state' AS violation_type, 'high' AS severity, 'block' AS action, agent_name AS data FROM agent_states WHERE trust_score < 0.4
    UNION ALL SELECT agent_id, 'clean', 'state', 'medium', 'warn', agent_name FROM agent_states WHERE len(policy_violations) > 0""")
def policy_state_violations(spark: SparkSession, d: str) -> DataFrame:
    """Rules over the states of agents."""
    rules = PolicyEnforcer(sql_conditions=True)
    rules.add_rule("clean", "No violations so far", "size(policy_violations) > 0")
    rules.add_rule("trusted", "Agents report some trust", "trust_score < 0.4", "block", "high")
    return rules.check_state(table(spark, d, "agent_states"), data=F.col("agent_name"))


@query("SELECT seq, 'rule' AS rule_name, 'message' AS violation_type, 'medium' AS severity, 'warn' AS action, content AS data FROM messages WHERE false")
def policy_faithful_empty(spark: SparkSession, d: str) -> DataFrame:
    """Without the extension no condition is ever met."""
    rules = PolicyEnforcer()
    rules.add_rule("rule", "Any rule", "length(content) > 200")
    return rules.violations(table(spark, d, "messages"))


@query(f"SELECT role, count(*) AS n FROM ({_SCREEN}) WHERE allowed AND role <> 'tool' GROUP BY role")
def middleware_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Two stages before and one after a count."""
    stages = Middleware()
    stages.add_pre_middleware(lambda df: df.filter("role <> 'tool'"), "no_tools")
    stages.add_pre_middleware(lambda df: firewall().check(df), "screen", priority=5)
    stages.add_post_middleware(lambda df: df.withColumnRenamed("count", "n"))
    return stages.wrap_function(lambda df: df.filter("allowed").groupBy("role").count())(table(spark, d, "messages"))


_PATCH_OPS = "SELECT event_id AS seq, CASE WHEN event_type = 'signup' THEN 'register' ELSE 'apply' END AS kind, CAST(user_id % 50 AS VARCHAR) AS patch_id, CASE WHEN event_id % 2 = 0 THEN 'one' ELSE 'two' END AS framework, event_type = 'purchase' AS succeeded FROM events"


@query(f"""WITH ops AS ({_PATCH_OPS}), known AS (SELECT patch_id, arg_max(framework, seq) AS framework, min(seq) AS f FROM ops WHERE kind = 'register' GROUP BY 1)
    SELECT patch_id, framework, min(seq) FILTER (kind = 'apply' AND succeeded AND seq > f) AS applied_seq, min(seq) FILTER (kind = 'apply' AND succeeded AND seq > f) IS NOT NULL AS applied
    FROM known JOIN (SELECT patch_id, kind, succeeded, seq FROM ops) USING (patch_id) GROUP BY patch_id, framework""")
def patch_status(spark: SparkSession, d: str) -> DataFrame:
    event = F.col("event_type")
    ops = table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.when(event == "signup", "register").otherwise("apply").alias("kind"), (F.col("user_id") % 50).cast("string").alias("patch_id"),
        F.when(F.col("event_id") % 2 == 0, "one").otherwise("two").alias("framework"), (event == "purchase").alias("succeeded"),
    )
    return patches.status(ops)


@query("SELECT conv_id, count(*) AS messages, arg_max(role, seq) AS last_role, max(seq) AS last_seq FROM messages GROUP BY conv_id")
def adapter_states(spark: SparkSession, d: str) -> DataFrame:
    return ConversationsAdapter().extract_state(table(spark, d, "messages"))
