"""Schemas of the records that the operators take and give."""

from __future__ import annotations

#: Taint levels from harmless to worst; the place in the list is the rank.
TAINT_LEVELS = ("untainted", "low", "medium", "high", "critical")

AGENT_MESSAGE = "role STRING, content STRING, metadata MAP<STRING,STRING>"
AGENT_STATE = f"messages ARRAY<STRUCT<{AGENT_MESSAGE.replace(' STRING', ': STRING').replace('metadata MAP', 'metadata: MAP')}>>, context MAP<STRING,STRING>, trust_score DOUBLE, policy_violations ARRAY<STRING>"
TRUST_SCORE = "score DOUBLE, confidence DOUBLE, factors MAP<STRING,DOUBLE>, ts TIMESTAMP"
POLICY_RULE = "name STRING, description STRING, condition STRING, action STRING, severity STRING"
POLICY_VIOLATION = "seq BIGINT, rule_name STRING, violation_type STRING, severity STRING, data STRING"
SECURITY_EVENT = "seq BIGINT, event_type STRING, severity STRING, description STRING, content_snippet STRING"
TAINT_SOURCE = "seq BIGINT, source_id STRING, source_type STRING, level STRING"
TAINT_OP = "seq BIGINT, kind STRING, data_id STRING, to_data_id STRING, source_id STRING, operation STRING"
TRUST_OP = "seq BIGINT, agent_id BIGINT, delta DOUBLE, factors MAP<STRING,DOUBLE>"
MEMORY_OP = "seq BIGINT, store_id BIGINT, kind STRING, tier STRING, mkey STRING, value STRING, query STRING"
ATTACK = "seq BIGINT, attack_type STRING, content STRING, indicator STRING"
PERF = "seq BIGINT, agent_id BIGINT, execution_time DOUBLE, token_usage INT, success BOOLEAN"
EVAL_RESULT = "seq BIGINT, agent_id BIGINT, input STRING, output STRING, expected STRING, metrics MAP<STRING,DOUBLE>"
TRACE_OP = "seq BIGINT, kind STRING, trace_id STRING, agent_id BIGINT, operation STRING, status STRING, description STRING"
LOG = "seq BIGINT, level STRING, message STRING, agent_id BIGINT"
METRIC_POINT = "seq BIGINT, metric_name STRING, value DOUBLE"
PATCH = "seq BIGINT, patch_id STRING, framework STRING, description STRING, version_requirement STRING"
