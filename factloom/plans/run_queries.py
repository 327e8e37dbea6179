"""Queries on run logs, attempts, requests and artifacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import ranking, runs
from factloom.plans.registry import query


@query("asof_side_table", "WITH best AS (SELECT s.run_id, max(s.state_version) AS sv FROM v_side s JOIN v_commits c ON s.run_id = c.run_id AND s.state_version <= c.state_version GROUP BY s.run_id) SELECT s.run_id, s.state_version, s.event_id, s.item FROM v_side s JOIN best b ON s.run_id = b.run_id AND s.state_version = b.sv")
def _(v):
    return runs.asof_side_table(v("v_side"), v("v_commits")).select("run_id", "state_version", "event_id", "item")


@query("current_artifacts", "SELECT a.run_id, a.artifact_id, a.version, a.content_hash FROM v_artifacts a JOIN v_manifest m ON a.run_id = m.run_id AND a.artifact_id = m.artifact_id AND a.version = m.version")
def _(v):
    return runs.current_artifacts(v("v_artifacts"), v("v_manifest")).select("run_id", "artifact_id", "version", "content_hash")


@query("orphan_artifacts", "SELECT a.run_id, a.artifact_id, a.version FROM v_artifacts a LEFT JOIN v_manifest m ON a.run_id = m.run_id AND a.artifact_id = m.artifact_id AND a.version = m.version WHERE m.version IS NULL")
def _(v):
    return runs.orphan_artifacts(v("v_artifacts"), v("v_manifest")).select("run_id", "artifact_id", "version")


@query("append_events", "WITH last AS (SELECT run_id, max(log_offset) AS last FROM v_events WHERE event_id % 3 <> 0 GROUP BY run_id) SELECT e.event_id, e.run_id, coalesce(l.last, 0) + row_number() OVER (PARTITION BY e.run_id ORDER BY e.event_id) AS log_offset FROM v_events e LEFT JOIN last l ON e.run_id = l.run_id WHERE e.event_id % 3 = 0")
def _(v):
    e = v("v_events")
    return runs.append_events(e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0").drop("log_offset"), ["event_id"]).select("event_id", "run_id", "log_offset")


@query("write_versioned", "WITH last AS (SELECT artifact_id, max(version) AS supersedes FROM v_artifacts GROUP BY artifact_id) SELECT DISTINCT e.event AS artifact_id, l.supersedes, coalesce(l.supersedes, 0) + 1 AS version, 'sha256:' || SHA256(e.event) AS content_hash FROM v_events e LEFT JOIN last l ON e.event = l.artifact_id")
def _(v):
    rows = v("v_events").select(F.col("event").alias("artifact_id")).distinct()
    return runs.write_versioned(rows, v("v_artifacts"), "artifact_id", F.col("artifact_id")).select("artifact_id", "supersedes", "version", "content_hash")


@query("inventory_audit", "SELECT 'inventory' AS rule, CASE WHEN page_id % 10 = 0 THEN 'MISSING' WHEN page_id % 10 = 1 THEN 'UNEXPECTED' ELSE 'CHANGED' END AS code, url AS key, '' AS detail FROM (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url) p WHERE page_id % 10 <= 2")
def _(v):
    p = v("pages").groupBy("url").agg(F.min("page_id").alias("page_id"))
    body = F.sha2(F.concat("url", F.when(F.col("page_id") % 10 == 2, "x").otherwise("")), 256)
    found = p.where("page_id % 10 <> 0").select(F.col("url").alias("path"), body.alias("sha256"))
    return runs.inventory_audit(found, p.where("page_id % 10 <> 1").select(F.col("url").alias("path"), F.sha2("url", 256).alias("sha256")))


@query("event_log_prefix", "SELECT CASE WHEN last AND torn THEN 'TORN_TAIL' WHEN torn THEN 'DAMAGED' ELSE 'OK' END AS state, count(*) AS n FROM (SELECT event_id % 89 = 3 OR event_id % 50 = 49 AS torn, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AS last FROM events) t GROUP BY 1")
def _(v):
    torn = (F.col("event_id") % 89 == 3) | (F.col("event_id") % 50 == 49)
    lines = v("events").select(F.col("user_id").alias("file"), F.col("event_id").alias("line_no"), F.when(torn, F.expr("left(props, 4)")).otherwise(F.col("props")).alias("value"))
    return runs.event_log_prefix(lines).groupBy("state").agg(F.count("*").alias("n"))


@query("read_event_log", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 89 <> 3 GROUP BY 1")
def _(v):
    from pyspark.sql.types import LongType, StructField, StructType

    lines = v("events").select(F.when(F.col("event_id") % 89 == 3, F.expr("left(props, 4)")).otherwise(F.col("props")).alias("value"))
    rows, _ = runs.parse_lines(lines, StructType([StructField("k", LongType())]))
    return rows.groupBy("k").agg(F.count("*").alias("n"))


@query("offset_gaps", "WITH t AS (SELECT run_id, event_id, event_id - coalesce(lag(event_id) OVER (PARTITION BY run_id ORDER BY event_id), 0) - 1 AS gap FROM v_events) SELECT 'offset_gap' AS rule, 'GAP' AS code, CAST(run_id AS STRING) || '/' || CAST(event_id AS STRING) AS key, CAST(gap AS STRING) AS detail FROM t WHERE gap <> 0")
def _(v):
    return runs.offset_gaps(v("v_events"), "event_id")


@query("event_field_bounds", "SELECT 'event_fields' AS rule, 'UNKNOWN_FIELD' AS code, CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING) AS key, 'role' AS detail FROM conversations UNION ALL SELECT 'event_fields', 'TOO_LONG', CAST(conv_id AS STRING) || '/' || CAST(turn AS STRING), 'reason' FROM conversations WHERE length(text) > 256")
def _(v):
    rows = v("conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("event"), F.col("text").alias("reason"), "role")
    return runs.event_field_bounds(rows, F.col("event"))


_MOVES = ", ".join(f"('{a}', '{b}')" for a, bs in runs.TRANSITIONS.items() for b in bs)


@query("illegal_transitions", f"WITH m AS (SELECT * FROM (VALUES {_MOVES}) AS t(a, b)), s AS (SELECT run_id, log_offset, status, lag(status) OVER (PARTITION BY run_id ORDER BY log_offset) AS before FROM v_status) SELECT 'transition' AS rule, 'ILLEGAL' AS code, CAST(run_id AS STRING) || '/' || CAST(log_offset AS STRING) AS key, before || '>' || status AS detail FROM s LEFT JOIN m ON m.a = s.before AND m.b = s.status WHERE before IS NOT NULL AND before <> status AND m.a IS NULL")
def _(v):
    return runs.illegal_transitions(v("v_status"), ["run_id"], "log_offset")


@query("usage_totals", "SELECT run_id, count(*) AS attempts, CASE WHEN count(*) = count(tokens) THEN CAST(sum(tokens) AS BIGINT) END AS tokens FROM v_attempts GROUP BY run_id")
def _(v):
    return runs.usage_totals(v("v_attempts"), "run_id", ["tokens"])


@query("budget_violations", "WITH t AS (SELECT run_id, attempt_id, sum(tokens) OVER w AS so_far, sum(CASE WHEN tokens IS NULL THEN 1 ELSE 0 END) OVER w > 0 AS u FROM v_attempts WINDOW w AS (PARTITION BY run_id ORDER BY started_at, attempt_id ROWS UNBOUNDED PRECEDING)) SELECT 'budget' AS rule, CASE WHEN u THEN 'UNKNOWN_USAGE' ELSE 'EXCEEDED' END AS code, CAST(run_id AS STRING) || '/' || CAST(attempt_id AS STRING) AS key, '' AS detail FROM t WHERE u OR so_far > 20000")
def _(v):
    return runs.budget_violations(v("v_attempts"), "tokens", 20000, ["started_at", "attempt_id"])


@query("run_budget_exceeded", "SELECT run_id, CAST(sum(tokens) AS BIGINT) AS used FROM v_attempts GROUP BY run_id HAVING sum(tokens) >= 30000")
def _(v):
    return runs.run_budget_exceeded(v("v_attempts"), "tokens", 30000)


@query("version_chain", "SELECT 'version_chain' AS rule, 'SUPERSEDES' AS code, CAST(run_id AS STRING) || '/' || artifact_id || '/' || CAST(version AS STRING) AS key, '' AS detail FROM v_artifacts WHERE supersedes <> version - 1")
def _(v):
    return runs.version_chain(v("v_artifacts"))


_LAST = "SELECT run_id, count(*) AS attempts, arg_max(status, (started_at, attempt_id)) AS status FROM v_attempts GROUP BY run_id"


@query("retry_state", f"WITH r AS ({_LAST}) SELECT *, greatest(12 - (attempts - 1), 0) AS retries_left, CASE WHEN status = 'FAILED' THEN CASE WHEN attempts - 1 < 12 THEN 'RETRY_READY' ELSE 'BLOCKED' END ELSE status END AS next_state FROM r")
def _(v):
    return runs.retry_state(v("v_attempts"), 12)


@query("run_status", f"WITH r AS ({_LAST}), x AS (SELECT run_id, bool_or(status = 'RUNNING') AS running FROM v_attempts GROUP BY run_id) SELECT r.run_id, CASE WHEN running THEN 'RUNNING' ELSE status END AS status FROM r JOIN x ON r.run_id = x.run_id")
def _(v):
    return runs.run_status(v("v_attempts"))


@query("slot_usage", "SELECT run_id, count(CASE WHEN status = 'RUNNING' THEN 1 END) AS active, greatest(4 - count(CASE WHEN status = 'RUNNING' THEN 1 END), 0) AS slots FROM v_attempts GROUP BY run_id")
def _(v):
    return runs.slot_usage(v("v_attempts"), 4, 5)


@query("quota_topk", "WITH s AS (SELECT run_id, greatest(8 - count(CASE WHEN status = 'RUNNING' THEN 1 END), 0) AS slots FROM v_attempts GROUP BY run_id), p AS (SELECT run_id, attempt_id, row_number() OVER (PARTITION BY run_id ORDER BY tokens DESC NULLS LAST, attempt_id) AS pos FROM v_attempts WHERE status = 'FAILED') SELECT p.run_id, p.attempt_id, CAST(pos AS INT) AS pos, pos <= slots AS taken, CASE WHEN pos > slots THEN 'NO_FREE_SLOT' END AS reason FROM p JOIN s ON p.run_id = s.run_id")
def _(v):
    a = v("v_attempts")
    out = ranking.quota_topk(a.where("status = 'FAILED'"), runs.slot_usage(a, 8).select("run_id", "slots"), "run_id", [F.col("tokens").desc_nulls_last(), "attempt_id"])
    return out.select("run_id", "attempt_id", "pos", "taken", "reason")


@query("response_conflicts", "WITH t AS (SELECT attempt, question, seq, answer_hash, first_value(answer_hash) OVER w AS f, row_number() OVER w AS n FROM v_turns WINDOW w AS (PARTITION BY attempt, question ORDER BY seq)) SELECT 'response' AS rule, CASE WHEN f = answer_hash THEN 'REPLAY' ELSE 'CONFLICT' END AS code, CAST(attempt AS STRING) || '/' || CAST(question AS STRING) || '/' || CAST(seq AS STRING) AS key, '' AS detail FROM t WHERE n > 1")
def _(v):
    return runs.response_conflicts(v("v_turns"), ["attempt", "question"], "seq")


@query("idempotency_audit", "WITH t AS (SELECT *, first_value(request_hash) OVER w AS h, first_value(operation) OVER w AS o, row_number() OVER w AS n FROM v_requests WINDOW w AS (PARTITION BY run_id, key_hash ORDER BY seq)) SELECT run_id, key_hash, seq, CASE WHEN n = 1 THEN 'FIRST' WHEN h = request_hash AND o = operation THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM t")
def _(v):
    return runs.idempotency_audit(v("v_requests")).select("run_id", "key_hash", "seq", "outcome")


@query("version_conflicts", "SELECT 'state_version' AS rule, 'CONFLICT' AS code, CAST(r.seq AS STRING) AS key, CAST(expected_version AS STRING) || '<>' || CAST(state_version AS STRING) AS detail FROM v_requests r JOIN v_commits c ON r.run_id = c.run_id WHERE expected_version <> state_version")
def _(v):
    return runs.version_conflicts(v("v_requests"), v("v_commits"))


@query("dependency_readiness", "WITH s AS (SELECT CAST(p_partkey AS BIGINT) AS node, CASE p_size % 3 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'SKIPPED' ELSE 'RUNNING' END AS status, p_size % 2 = 0 AS optional FROM part) SELECT e.node, bool_and(coalesce(status = 'VERIFIED' OR (status = 'SKIPPED' AND optional), false)) AS satisfied, bool_and(coalesce(status IN ('VERIFIED', 'SKIPPED', 'BLOCKED'), false)) AS resolved FROM v_edges e LEFT JOIN s ON s.node = e.depends_on GROUP BY e.node")
def _(v):
    status = F.when(F.col("p_size") % 3 == 0, "VERIFIED").when(F.col("p_size") % 3 == 1, "SKIPPED").otherwise("RUNNING")
    return runs.dependency_readiness(v("v_edges"), v("part").select(F.col("p_partkey").alias("node"), status.alias("status"), (F.col("p_size") % 2 == 0).alias("optional")))


@query("subgraph_complete", "SELECT p_brand AS subgraph, bool_and(p_size % 3 = 0 OR (p_size % 3 = 1 AND p_size % 2 = 0)) AS complete FROM part GROUP BY p_brand")
def _(v):
    good = (F.col("p_size") % 3 == 0) | ((F.col("p_size") % 3 == 1) & (F.col("p_size") % 2 == 0))
    return runs.subgraph_complete(v("part").withColumnRenamed("p_brand", "subgraph"), "subgraph", good)


@query("uncommitted_tail", "WITH c AS (SELECT run_id, max(log_offset) - 3 AS last_event_offset FROM v_events GROUP BY run_id) SELECT e.run_id, e.log_offset, e.event_id FROM v_events e JOIN c ON e.run_id = c.run_id AND e.log_offset > c.last_event_offset")
def _(v):
    e = v("v_events")
    commits = e.groupBy("run_id").agg((F.max("log_offset") - 3).alias("last_event_offset"))
    return runs.uncommitted_tail(e, commits).select("run_id", "log_offset", "event_id")


@query("fingerprint_reuse", "WITH d AS (SELECT * FROM v_attempts WHERE status = 'COMPLETED'), p AS (SELECT * FROM v_attempts WHERE status = 'RUNNING') SELECT p.attempt_id, arg_max(d.attempt_id, (d.started_at, d.attempt_id)) AS reuse_of FROM p LEFT JOIN d ON p.input_fingerprint = d.input_fingerprint AND d.started_at < p.started_at GROUP BY p.attempt_id")
def _(v):
    a = v("v_attempts")
    return runs.fingerprint_reuse(a.where("status = 'RUNNING'"), a.where("status = 'COMPLETED'")).select("attempt_id", "reuse_of")


_CODES = "CASE CAST(log_offset % 5 AS INT) WHEN 0 THEN 'SOURCE_UNAVAILABLE' WHEN 1 THEN 'INSUFFICIENT_EVIDENCE' WHEN 2 THEN 'GATE_NOT_APPROVED' WHEN 3 THEN 'EXECUTOR_FAILED' ELSE 'OTHER' END"
_POLICY = [("SOURCE_UNAVAILABLE", "RETRY_NODE"), ("EXECUTOR_FAILED", "RETRY_NODE"), ("INSUFFICIENT_EVIDENCE", "OPEN_RESEARCH_GAP"), ("GATE_NOT_APPROVED", "WAIT_FOR_USER")]


@query("error_routing", f"WITH f AS (SELECT run_id, log_offset, {_CODES} AS code, log_offset % 4 AS attempts, log_offset % 3 AS cycles FROM v_events) SELECT run_id, log_offset, CASE WHEN code IN ('SOURCE_UNAVAILABLE', 'EXECUTOR_FAILED') THEN CASE WHEN attempts - 1 < 2 THEN 'RETRY_NODE' ELSE 'BLOCK_NODE' END WHEN code = 'INSUFFICIENT_EVIDENCE' THEN CASE WHEN cycles < 2 THEN 'OPEN_RESEARCH_GAP' ELSE 'PAUSE_RUN' END WHEN code = 'GATE_NOT_APPROVED' THEN 'WAIT_FOR_USER' ELSE 'UNKNOWN_CODE' END AS routed FROM f")
def _(v):
    rows = v("v_events").withColumn("code", F.expr(_CODES)).withColumn("attempts", F.col("log_offset") % 4).withColumn("cycles", F.col("log_offset") % 3)
    return runs.error_routing(rows, v.spark.createDataFrame(_POLICY, "code string, action string"), 2, 2).select("run_id", "log_offset", "routed")


@query("error_metadata_check", f"SELECT 'error_metadata' AS rule, 'ACTION' AS code, CAST(event_id AS STRING) AS key, code AS detail FROM (SELECT event_id, {_CODES} AS code FROM v_events) t WHERE code IN ('SOURCE_UNAVAILABLE', 'EXECUTOR_FAILED', 'GATE_NOT_APPROVED')")
def _(v):
    rows = v("v_events").withColumn("code", F.expr(_CODES)).withColumn("reported", F.lit("OPEN_RESEARCH_GAP"))
    return runs.error_metadata_check(rows, v.spark.createDataFrame(_POLICY, "code string, action string"), F.col("event_id"))


@query("decision_events", "WITH l AS (SELECT run_id, max(log_offset) AS last FROM v_events GROUP BY run_id), d AS (SELECT o_custkey % 200 AS run_id, o_orderkey % 120 AS event_offset FROM orders) SELECT 'decision_event' AS rule, 'OFFSET' AS code, CAST(d.run_id AS STRING) || '/' || CAST(event_offset AS STRING) AS key, '' AS detail FROM d LEFT JOIN l ON l.run_id = d.run_id WHERE last IS NULL OR event_offset > last OR event_offset < 1")
def _(v):
    d = v("orders").select((F.col("o_custkey") % 200).alias("run_id"), (F.col("o_orderkey") % 120).alias("event_offset"))
    return runs.decision_events(d, v("v_events"))


@query("producer_audit", "SELECT 'producer' AS rule, CASE WHEN a.status IS NULL THEN 'NO_ATTEMPT' ELSE 'NOT_VERIFIED' END AS code, CAST(e.event_id AS STRING) AS key, '' AS detail FROM events e LEFT JOIN v_attempts a ON a.attempt_id = e.event_id * 2 WHERE a.status IS NULL OR a.status <> 'COMPLETED'")
def _(v):
    return runs.producer_audit(v("events").select(F.col("event_id").alias("artifact_ref"), (F.col("event_id") * 2).alias("attempt_id")), v("v_attempts"))


@query("permission_audit", "SELECT 'permission' AS rule, 'EXCEEDED' AS code, CAST(attempt AS STRING) || '/' || role AS key, CAST(bucket AS STRING) AS detail FROM v_turns WHERE bucket > CASE role WHEN 'user' THEN 2 ELSE 0 END")
def _(v):
    t = v("v_turns")
    declared = t.where("role = 'user'").select("attempt", F.col("role").alias("kind"), F.lit(2).cast("long").alias("level")).distinct()
    return runs.permission_audit(t.select("attempt", F.col("role").alias("kind"), F.col("bucket").alias("level")), declared)


@query("round_limit", "WITH r AS (SELECT attempt, CASE WHEN bucket = 0 THEN seq + 3 ELSE seq + 1 END AS round FROM v_turns), t AS (SELECT attempt, round, row_number() OVER (PARTITION BY attempt ORDER BY round) AS n FROM r) SELECT 'round' AS rule, CASE WHEN round > 4 THEN 'TOO_MANY' ELSE 'JUMP' END AS code, CAST(attempt AS STRING) || '/' || CAST(round AS STRING) AS key, '' AS detail FROM t WHERE round > 4 OR round <> n")
def _(v):
    return runs.round_limit(v("v_turns").withColumn("round", F.when(F.col("bucket") == 0, F.col("seq") + 3).otherwise(F.col("seq") + 1)), 4)


@query("gate_to_decision", "SELECT o_custkey AS run_id, o_orderpriority AS gate, arg_max(o_orderstatus, o_orderkey) AS decision, max(o_orderkey) AS seq FROM orders GROUP BY 1, 2")
def _(v):
    return runs.gate_to_decision(v("orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("gate"), F.col("o_orderstatus").alias("decision"), F.col("o_orderkey").alias("seq")))


@query("interaction_consistency", "WITH f AS (SELECT attempt, min(bucket) AS held FROM v_turns WHERE role = 'user' AND attempt % 9 <> 0 GROUP BY attempt) SELECT 'interaction' AS rule, CASE WHEN held IS NULL THEN 'NO_CHECKPOINT' ELSE 'METHOD' END AS code, CAST(t.attempt AS STRING) AS key, '' AS detail FROM v_turns t LEFT JOIN f ON t.attempt = f.attempt WHERE role = 'assistant' AND (held IS NULL OR held <> bucket)")
def _(v):
    t = v("v_turns")
    held = t.where("role = 'user' AND attempt % 9 <> 0").groupBy("attempt").agg(F.min("bucket").alias("method"))
    return runs.interaction_consistency(t.where("role = 'assistant'").select("attempt", F.col("bucket").alias("method")), held)


@query("import_gate", "SELECT event_id, CASE WHEN event = 'click' AND log_offset % 2 = 0 THEN 'ACCEPT' WHEN event = 'view' THEN 'REJECT_UNSAFE' ELSE 'REJECT_NO_RULE' END AS decision FROM v_events")
def _(v):
    rules = v.spark.createDataFrame([(0, "click", True), (0, "view", False), (1, "view", False)], "source_version long, kind string, safe boolean")
    return runs.import_gate(v("v_events").select("event_id", (F.col("log_offset") % 2).alias("source_version"), F.col("event").alias("kind")), rules).select("event_id", "decision")


@query("stream_idempotent_requests", "WITH t AS (SELECT *, first_value(request_hash) OVER w AS h, first_value(operation) OVER w AS o, row_number() OVER w AS n FROM v_requests WINDOW w AS (PARTITION BY run_id, key_hash ORDER BY seq)) SELECT CASE WHEN n = 1 THEN 'FIRST' WHEN h = request_hash AND o = operation THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome, count(*) AS n FROM t GROUP BY 1")
def _(v):
    # the batch form of the stream; tests replay the stream itself
    return runs.idempotency_audit(v("v_requests")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("deep_dive", "SELECT id, length(name) + 1 AS score FROM v_candidates")
def _(v):
    from factloom.operators import providers

    return providers.deep_dive(v("v_candidates").select("id", "name"), lambda r: {"id": r["id"], "score": len(r["name"]) + 1}, "id string, score long")


@query("judge_and_verify", "SELECT competitor_id || '/' || dimension_id AS judgment_ref, CASE WHEN score IS NULL OR score + 2 <= 10 THEN 'ACCEPT' WHEN dimension_order < 2 THEN 'RETRY' ELSE 'REJECT' END AS result FROM v_judgments")
def _(v):
    from factloom.operators import providers, scoring

    rows = v("v_judgments").withColumn("score", F.col("score") + 2).withColumn("judgment_ref", F.concat_ws("/", "competitor_id", "dimension_id")).withColumn("retries", F.col("dimension_order"))
    return providers.judge_result(rows, scoring.score_status_check(rows, F.col("judgment_ref")), 2).select("judgment_ref", "result")


@query("plan_gaps", "SELECT run_id, count(DISTINCT code) AS gaps FROM v_issues WHERE issue GROUP BY run_id")
def _(v):
    import pandas as pd

    from factloom.operators import providers

    planned = providers.plan_gaps(v("v_issues").where("issue").select("run_id", "code"), lambda p: pd.DataFrame({"run_id": p.run_id.iloc[0], "code": sorted(set(p.code))}), "run_id string, code string")
    return planned.groupBy("run_id").agg(F.count("*").alias("gaps"))
