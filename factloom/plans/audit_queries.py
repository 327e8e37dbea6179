"""Queries of audits: permissions, budgets, imports, producers, claims and rubrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import provenance as pv
from factloom.operators import metrics, research, runs, scoring
from factloom.plans.document_queries import _BARE
from factloom.plans.registry import query

_PATHS = "CASE l_linenumber % 5 WHEN 0 THEN 'runs/0/a.json' WHEN 1 THEN 'runs/0x/a' WHEN 2 THEN 'runs/1' WHEN 3 THEN 'runs/../1/b' ELSE 'runs/1/c/d' END"


@query("permission_paths", f"WITH r AS (SELECT DISTINCT l_orderkey AS attempt, {_PATHS} AS path FROM lineitem), d AS (SELECT o_orderkey AS attempt, 'runs/' || (o_orderkey % 2) AS prefix FROM orders) SELECT 'permission' AS rule, 'WRITE_PATH' AS code, CAST(attempt AS STRING) AS key, path AS detail FROM r WHERE path LIKE '%..%' OR NOT EXISTS (SELECT 1 FROM d WHERE d.attempt = r.attempt AND (r.path = d.prefix OR starts_with(r.path, d.prefix || '/')))")
def _(v):
    requested = v("lineitem").select(F.col("l_orderkey").alias("attempt"), F.expr(_PATHS).alias("path"))
    declared = v("orders").select(F.col("o_orderkey").alias("attempt"), F.concat(F.lit("runs/"), (F.col("o_orderkey") % 2).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "/").otherwise("")).alias("prefix"))
    return runs.path_violations(requested, declared)


@query(
    "request_budget",
    """WITH r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 1 THEN 25 WHEN o_orderkey % 7 = 2 THEN 15 ELSE 20 END AS t, CASE WHEN o_orderkey % 5 <> 0 THEN 50 END AS s, CASE WHEN o_orderkey % 3 = 0 THEN 9 END AS c FROM orders)
    SELECT 'request_budget' AS rule, 'NOT_PLANNED' AS code, CAST(k AS STRING) AS key, '' AS detail FROM r WHERE k % 19 = 4
    UNION ALL SELECT 'request_budget', CASE WHEN t > 20 THEN 'BUDGET_EXCEEDED' ELSE 'DIFFERENT' END, CAST(k AS STRING), 'timeout_minutes' FROM r WHERE k % 19 <> 4 AND t <> 20
    UNION ALL SELECT 'request_budget', 'BUDGET_EXCEEDED', CAST(k AS STRING), 'max_sources' FROM r WHERE k % 19 <> 4 AND s IS NULL
    UNION ALL SELECT 'request_budget', 'DIFFERENT', CAST(k AS STRING), 'cost_limit' FROM r WHERE k % 19 <> 4 AND c IS NOT NULL""",
)
def _(v):
    k = F.col("o_orderkey")
    asked = v("orders").select(k.alias("attempt"), F.when(k % 7 == 1, 25).when(k % 7 == 2, 15).otherwise(20).alias("timeout_minutes"), F.when(k % 5 != 0, 50).alias("max_sources"), F.lit(None).cast("int").alias("token_limit"), F.when(k % 3 == 0, 9).alias("cost_limit"))
    planned = v("orders").where(k % 19 != 4).select(k.alias("attempt"), F.lit(20).alias("timeout_minutes"), F.lit(50).alias("max_sources"), F.lit(None).cast("int").alias("token_limit"), F.lit(None).cast("int").alias("cost_limit"))
    return runs.budget_mismatch(asked, planned, ["timeout_minutes", "max_sources", "token_limit", "cost_limit"])


_RULES = [("0.2", "0.3", "click", "resume", True), ("0.2", "0.3", "view", "resume", False), ("0.2", "0.3", "click", "audit", False), ("0.1", "0.3", "click", "resume", True)]


@query("import_gate_by_purpose", f"WITH g AS (SELECT * FROM (VALUES {', '.join(map(str, _RULES)).replace('True', 'true').replace('False', 'false')}) AS t(s, t, k, p, safe)), r AS (SELECT event_id, event_type AS k, CASE event_id % 3 WHEN 0 THEN '0.1' ELSE '0.2' END AS s, CASE event_id % 4 WHEN 0 THEN '0.4' ELSE '0.3' END AS t, CASE event_id % 5 WHEN 0 THEN 'audit' ELSE 'resume' END AS p FROM events) SELECT event_id, CASE WHEN safe IS NULL THEN 'REJECT_NO_RULE' WHEN NOT safe THEN 'REJECT_UNSAFE' ELSE 'ACCEPT' END AS decision FROM r LEFT JOIN g ON g.s = r.s AND g.t = r.t AND g.k = r.k AND g.p = r.p")
def _(v):
    e = F.col("event_id")
    refs = v("events").select("event_id", F.col("event_type").alias("kind"), F.when(e % 3 == 0, "0.1").otherwise("0.2").alias("source_version"), F.when(e % 4 == 0, "0.4").otherwise("0.3").alias("target_version"), F.when(e % 5 == 0, "audit").otherwise("resume").alias("purpose"))
    rules = v.spark.createDataFrame(_RULES, "source_version string, target_version string, kind string, purpose string, safe boolean")
    return runs.import_gate(refs, rules).select("event_id", "decision")


@query(
    "producer_binding_audit",
    f"""WITH d AS (SELECT k, artifact_ref, state, k % 11 = 5 AS none, 'sha256:' || sha256({_BARE}) AS hash FROM v_json_docs)
    SELECT 'producer' AS rule, 'NO_ATTEMPT' AS code, artifact_ref AS key, '' AS detail FROM d WHERE none
    UNION ALL SELECT 'producer', 'NOT_VERIFIED', artifact_ref, '' FROM d WHERE NOT none AND state <> 'F'
    UNION ALL SELECT 'producer', 'SKILL', artifact_ref, '' FROM d WHERE NOT none AND k % 13 = 2
    UNION ALL SELECT 'producer', 'VERSION', artifact_ref, '' FROM d WHERE NOT none AND k % 17 = 3
    UNION ALL SELECT 'producer', 'HASH', artifact_ref, '' FROM d WHERE k % 19 = 1""",
)
def _(v):
    k = F.col("k")
    bare = v.sql(f"SELECT k, artifact_ref, doc, 'sha256:' || SHA256(text) AS content_hash FROM (SELECT k, artifact_ref, doc, {_BARE} AS text FROM v_json_docs) t")
    docs = bare.select("artifact_ref", k.alias("attempt_id"), (k % 3).alias("skill"), F.lit(1).alias("version"), "doc", F.when(k % 19 == 1, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    made = v("v_json_docs").where(k % 11 != 5).select(k.alias("attempt_id"), F.when(F.col("state") == "F", "COMPLETED").otherwise("RUNNING").alias("status"), F.when(k % 13 == 2, 9).otherwise(k % 3).alias("skill"), F.when(k % 17 == 3, 2).otherwise(1).alias("version"))
    return runs.producer_audit(docs, made)


@query(
    "limit_violations",
    """WITH t AS (SELECT run_id, attempt_id, sum(tokens) OVER w AS tok, sum(CASE WHEN tokens IS NULL THEN 1 ELSE 0 END) OVER w AS tok_open, sum(CASE WHEN attempt_id % 31 <> 2 THEN attempt_id % 900 END) OVER w AS sec, sum(CASE WHEN attempt_id % 31 = 2 THEN 1 ELSE 0 END) OVER w AS sec_open, sum(attempt_id % 20) OVER w AS src
      FROM v_attempts WINDOW w AS (PARTITION BY run_id ORDER BY started_at, attempt_id ROWS UNBOUNDED PRECEDING))
    SELECT 'budget' AS rule, CASE WHEN tok_open > 0 THEN 'UNKNOWN_USAGE' ELSE 'EXCEEDED' END AS code, CAST(run_id AS STRING) || '/' || CAST(attempt_id AS STRING) AS key, 'tokens' AS detail FROM t WHERE tok_open > 0 OR tok > 9000
    UNION ALL SELECT 'budget', CASE WHEN sec_open > 0 THEN 'UNKNOWN_USAGE' ELSE 'EXCEEDED' END, CAST(run_id AS STRING) || '/' || CAST(attempt_id AS STRING), 'seconds' FROM t WHERE sec_open > 0 OR sec > 1200
    UNION ALL SELECT 'budget', 'EXCEEDED', CAST(run_id AS STRING) || '/' || CAST(attempt_id AS STRING), 'sources' FROM t WHERE src > 50""",
)
def _(v):
    a = F.col("attempt_id")
    rows = v("v_attempts").select("run_id", "attempt_id", "started_at", "tokens", F.when(a % 31 != 2, a % 900).alias("seconds"), (a % 20).alias("sources"), F.lit(None).cast("double").alias("cost"))
    return runs.limit_violations(rows, {"seconds": 1200, "sources": 50, "tokens": 9000, "cost": None}, ["started_at", "attempt_id"])


@query("ambiguous_artifacts", "WITH a AS (SELECT * FROM v_artifacts WHERE version % 9 <> 2 UNION ALL SELECT * FROM v_artifacts WHERE version % 9 = 4), n AS (SELECT run_id, artifact_id, version, count(*) AS n FROM a GROUP BY 1, 2, 3) SELECT 'current_artifact' AS rule, CASE WHEN n IS NULL THEN 'MISSING' ELSE 'AMBIGUOUS' END AS code, CAST(m.run_id AS STRING) || '/' || m.artifact_id || '/' || CAST(m.version AS STRING) AS key, CAST(coalesce(n, 0) AS STRING) AS detail FROM v_manifest m LEFT JOIN n ON n.run_id = m.run_id AND n.artifact_id = m.artifact_id AND n.version = m.version WHERE n IS NULL OR n <> 1")
def _(v):
    a = v("v_artifacts")
    return runs.ambiguous_artifacts(a.where("version % 9 <> 2").union(a.where("version % 9 = 4")), v("v_manifest"))


@query("committed_outside", "SELECT 'event_log' AS rule, 'OFFSET_OUTSIDE_LOG' AS code, CAST(run_id AS STRING) AS key, CAST(max(log_offset) + 1 AS STRING) AS detail FROM v_events WHERE run_id % 6 = 1 GROUP BY run_id")
def _(v):
    e = v("v_events")
    commits = e.groupBy("run_id").agg((F.max("log_offset") + F.when(F.col("run_id") % 6 == 1, 1).otherwise(0)).alias("last_event_offset"))
    return runs.committed_outside(e, commits)


@query("reserved_names", "SELECT 'field_whitelist' AS rule, CASE j.k WHEN 0 THEN 'UNKNOWN_KEY' ELSE 'RESERVED_KEY' END AS code, CAST(o_orderkey AS STRING) AS key, CASE j.k WHEN 0 THEN 'list' ELSE 'secret' END AS detail FROM orders CROSS JOIN k4 j WHERE j.k = 0 OR (j.k = 1 AND o_orderkey % 3 < 2)")
def _(v):
    # five levels down, inside lists, written with an escape; as a value it is no name
    name = F.when(F.col("o_orderkey") % 3 == 0, "sec\\u0072et").when(F.col("o_orderkey") % 3 == 1, "secret").otherwise("other")
    body = F.concat(F.lit('{"name": "secret", "list": [": ", {"a": [{"b": {"c": [{"'), name, F.lit('": "secret"}]}}]}]}'))
    return research.field_whitelist(v("orders").select("o_orderkey", body.alias("body")), F.col("o_orderkey"), "body", ["name"], ["secret"])


@query("build_claims", "WITH o AS (SELECT DISTINCT subject AS run_id, category AS node, e.source_id FROM v_claims c JOIN v_evidence e ON e.claim_id = c.id) SELECT 'CL-COMP-' || upper(substr(SHA256(run_id || '|' || node || '|' || 'seen'), 1, 16)) AS id, 'seen' AS statement, 'competitor' AS category, CASE WHEN bool_and(freshness_status = 'FRESH') AND bool_or(source_tier = 1) THEN 'VALIDATED' ELSE 'PARTIALLY_VALIDATED' END AS status, CASE WHEN bool_and(freshness_status = 'FRESH') AND bool_or(source_tier = 1) THEN 'MEDIUM' ELSE 'LOW' END AS confidence, count(*) AS n_evidence FROM o JOIN v_sources s ON s.id = o.source_id GROUP BY run_id, node")
def _(v):
    rows = v("v_claims").join(v("v_evidence").select(F.col("claim_id").alias("id"), "source_id"), "id").select(F.col("subject").alias("run_id"), F.col("category").alias("node"), F.lit("seen").alias("statement"), "source_id")
    return pv.build_claims(rows, v("v_sources"))


@query("rubric_bands", "SELECT 'rubric' AS rule, 'BANDS' AS code, CAST(s_suppkey AS STRING) AS key, '' AS detail FROM supplier WHERE s_suppkey % 4 <> 0")
def _(v):
    k = F.col("s_suppkey")
    five = v("supplier").select(k, F.explode(F.sequence(F.lit(1), F.lit(9), F.lit(2))).alias("lo"))
    # one band too wide, one missing, one repeated in place of another
    rows = five.select(k.alias("rubric_ref"), F.when((k % 4 == 3) & (F.col("lo") == 9), 7).otherwise(F.col("lo")).alias("lo"), (F.when((k % 4 == 3) & (F.col("lo") == 9), 7).otherwise(F.col("lo")) + F.when((k % 4 == 1) & (F.col("lo") == 5), 2).otherwise(1)).alias("hi"))
    return scoring.rubric_bands_check(rows.where("NOT (rubric_ref % 4 = 2 AND lo = 3)"))


@query("repeated_refs", "SELECT 'judgments' AS rule, 'DUPLICATE_REF' AS code, 'judgment/' || CAST(l_orderkey AS STRING) AS key, CAST(count(*) AS STRING) AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 UNION ALL SELECT 'judgments', 'DUPLICATE_REF', 'verification/' || CAST(l_orderkey * 10 + l_linenumber % 5 AS STRING), CAST(count(*) AS STRING) FROM lineitem GROUP BY l_orderkey * 10 + l_linenumber % 5 HAVING count(*) > 1")
def _(v):
    return scoring.repeated_refs(v("lineitem").select(F.col("l_orderkey").cast("long").alias("judgment_ref"), (F.col("l_orderkey") * 10 + F.col("l_linenumber") % 5).cast("long").alias("verification_ref")))


@query(
    "score_parts_audit",
    """WITH n AS (SELECT competitor_id, count(score) AS n FROM v_judgments GROUP BY competitor_id)
    SELECT 'score_audit' AS rule, 'MISSING_UNSTATED' AS code, competitor_id || '/' || dimension_id AS key, '' AS detail FROM v_judgments WHERE score IS NULL AND dimension_order = 1
    UNION ALL SELECT 'score_audit', 'NOT_MISSING', competitor_id || '/' || dimension_id, '' FROM v_judgments WHERE score = 3
    UNION ALL SELECT 'score_audit', 'WEIGHT', j.competitor_id || '/' || dimension_id, CAST(CAST(1.0 / n AS DECIMAL(9,6)) AS STRING) FROM v_judgments j JOIN n ON n.competitor_id = j.competitor_id WHERE score = 5""",
)
def _(v):
    j = v("v_judgments")
    weights = scoring.effective_weights(j).join(j.select("competitor_id", "dimension_id", F.col("score").alias("s")), ["competitor_id", "dimension_id"])
    weights = weights.withColumn("effective_weight", F.when(F.col("s") == 5, F.lit(0).cast("decimal(9,6)")).otherwise(F.col("effective_weight")))
    missing = j.where("(score IS NULL AND dimension_order <> 1) OR score = 3")
    return scoring.score_parts_audit(j, j.select("dimension_id").distinct(), missing, weights)


@query("set_differences", "SELECT 'sources' AS rule, CASE WHEN direction = 'contextual' THEN 'MISSING' ELSE 'EXTRA' END AS code, claim_id AS key, id AS detail FROM v_evidence WHERE direction <> 'supports'")
def _(v):
    e = v("v_evidence").select(F.col("claim_id").alias("key"), F.col("id").alias("member"), "direction")
    return pv.set_differences(e.where("direction <> 'contradicts'"), e.where("direction <> 'contextual'"), "sources")


@query(
    "gap_branches",
    """WITH b AS (SELECT DISTINCT run_id, section AS branch, section <> 'de' AND (run_id <> 'web' OR section <> 'fr') AS enabled FROM v_issues), g AS (SELECT run_id, code, section AS branch FROM v_issues WHERE waived)
    SELECT 'gap_branch' AS rule, 'NOT_ENABLED' AS code, g.run_id || '/' || code AS key, g.branch AS detail FROM g JOIN b ON b.run_id = g.run_id AND b.branch = g.branch WHERE NOT enabled
    UNION ALL SELECT 'gap_branch', 'ALL_BRANCHES', b.run_id, '' FROM b WHERE enabled GROUP BY b.run_id HAVING bool_and(EXISTS (SELECT 1 FROM g WHERE g.run_id = b.run_id AND g.branch = b.branch))""",
)
def _(v):
    i = v("v_issues").withColumnRenamed("section", "branch")
    branches = i.select("run_id", "branch").distinct().withColumn("enabled", (F.col("branch") != "de") & ((F.col("run_id") != "web") | (F.col("branch") != "fr")))
    return research.gap_branches(i.where("waived").select("run_id", "code", "branch"), branches)


@query("evidence_requirements", "WITH c AS (SELECT source_type AS key, count(*) AS n FROM v_sources GROUP BY 1) SELECT 'evidence_threshold' AS rule, CASE WHEN s_suppkey % 4 = 1 THEN 'INVALID' ELSE 'TOO_FEW' END AS code, key, 'need' || s_suppkey AS detail FROM c CROSS JOIN supplier WHERE s_suppkey % 4 = 1 OR (s_suppkey % 4 = 2 AND n < s_suppkey * 40)")
def _(v):
    k = F.col("s_suppkey")
    names = v("supplier").select(F.concat(F.lit("need"), k.cast("string")).alias("name"), F.when(k % 4 == 0, "N/A").when(k % 4 == 1, "many").when(k % 4 == 2, (k * 40).cast("string")).otherwise("0").alias("need"))
    counts = v("v_sources").groupBy(F.col("source_type").alias("key")).agg(F.count("*").alias("n"))
    grid = counts.select("key").crossJoin(F.broadcast(names))
    return research.evidence_requirements(grid.where("need <> '0'").select("key", "name").join(counts, "key"), grid)


@query("recommended_check", "WITH t AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part), r AS (SELECT p_brand, min(p_partkey) AS id FROM part GROUP BY 1) SELECT 'opportunity' AS rule, 'NOT_LISTED' AS code, r.p_brand AS key, CAST(r.id AS STRING) AS detail FROM r JOIN t ON t.p_brand = r.p_brand AND t.p_partkey = r.id WHERE pos > 4")
def _(v):
    top = research.top_k(v("part"), "p_brand", [F.col("p_retailprice").desc(), "p_partkey"], 4).withColumnRenamed("p_partkey", "id")
    return research.recommended_check(top, v("part").groupBy("p_brand").agg(F.min("p_partkey").alias("id")), "p_brand")


@query("checkpoint_growth", "WITH c AS (SELECT attempt, seq AS round, CASE WHEN bucket = 0 THEN seq + 2 ELSE seq + 1 END AS version FROM v_turns), t AS (SELECT *, coalesce(lag(version) OVER (PARTITION BY attempt ORDER BY round, version), 0) + 1 AS want FROM c) SELECT 'checkpoint_version' AS rule, 'GROWTH' AS code, CAST(attempt AS STRING) || '/' || CAST(round AS STRING) AS key, CAST(version AS STRING) AS detail FROM t WHERE version <> want")
def _(v):
    rows = v("v_turns").select("attempt", F.col("seq").alias("round"), F.when(F.col("bucket") == 0, F.col("seq") + 2).otherwise(F.col("seq") + 1).alias("version"))
    return runs.checkpoint_growth(rows)


@query("corrupt_keys", "SELECT 'idempotency' AS rule, 'CORRUPT' AS code, CAST(run_id AS STRING) || '/' || key_hash AS key, CAST(count(*) AS STRING) AS detail FROM v_requests GROUP BY run_id, key_hash HAVING count(*) > 1")
def _(v):
    return runs.corrupt_keys(v("v_requests"))


@query("error_costs", "WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS code, o_orderkey % 5 = 0 AS a, o_orderkey % 3 = 1 AS r, o_orderkey % 7 = 2 AS c FROM orders WHERE o_orderstatus <> 'P') SELECT 'error_metadata' AS rule, 'ACTION' AS code, CAST(k AS STRING) AS key, code AS detail FROM e WHERE a UNION ALL SELECT 'error_metadata', 'RECOVERABLE', CAST(k AS STRING), code FROM e WHERE r UNION ALL SELECT 'error_metadata', 'CYCLE_COST', CAST(k AS STRING), code FROM e WHERE c")
def _(v):
    k = F.col("o_orderkey")
    policy = v.spark.createDataFrame([("F", "RETRY_NODE", True, 1, 0), ("O", "BLOCK_NODE", False, 0, 1)], "code string, action string, recoverable boolean, attempt_cost int, cycle_cost int")
    own = F.col("o_orderstatus") == "F"
    errors = v("orders").select(k.alias("k"), F.col("o_orderstatus").alias("code"), F.when(k % 5 != 0, F.when(own, "RETRY_NODE").otherwise("BLOCK_NODE")).alias("reported"), F.when(k % 3 == 1, ~own).otherwise(own).alias("reported_recoverable"), F.when(own, 1).otherwise(0).alias("reported_attempt_cost"), (F.when(own, 0).otherwise(1) + F.when(k % 7 == 2, 5).otherwise(0)).alias("reported_cycle_cost"))
    return runs.error_metadata_check(errors, policy, F.col("k"))


@query("mart_values_check", "SELECT 'mart_labels' AS rule, 'LABELS' AS code, 'a/1-URGENT' AS key, 'b/' || max(o_orderpriority) AS detail FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'mart_count', 'COUNT', CAST(o_orderkey AS STRING), 'n' FROM orders WHERE o_orderkey % 6 < 3")
def _(v):
    k = F.col("o_orderkey")
    rows = v("orders").select(k.alias("bucket"), F.when(k % 2 == 1, "b").otherwise("a").alias("x"), F.when(k % 2 == 1, F.col("o_orderpriority")).otherwise("1-URGENT").alias("y"), F.when(k % 6 == 0, -1.0).when(k % 6 == 1, 0.5).when(k % 6 > 2, 2.0).alias("n"))
    return metrics.mart_values_check(rows, "bucket", ["x", "y"], ["n"])
