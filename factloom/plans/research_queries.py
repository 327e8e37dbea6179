"""Queries on research contracts, rules, and lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import ideas, lineage, research, violations
from factloom.plans.registry import query

_SECTIONS = "sec AS (SELECT run_id, section, CASE WHEN bool_or(critical) THEN 'FAIL' WHEN bool_or(issue) THEN 'PARTIAL' ELSE 'PASS' END AS result FROM v_issues GROUP BY 1, 2)"


@query("section_verification", f"WITH {_SECTIONS} SELECT * FROM sec")
def _(v):
    return research.section_verification(v("v_issues"))


@query("overall_verification", f"WITH {_SECTIONS} SELECT run_id, CASE WHEN bool_or(result = 'FAIL') THEN 'FAIL' WHEN bool_and(result = 'PASS') THEN 'PASS' ELSE 'PARTIAL' END AS result FROM sec GROUP BY run_id")
def _(v):
    return research.overall_verification(research.section_verification(v("v_issues")))


@query("readiness", "SELECT run_id, CASE WHEN bool_or(critical) OR bool_or(issue AND NOT waived) THEN 'NOT_READY' WHEN bool_or(issue AND waived) THEN 'READY_WITH_ACCEPTED_RISKS' ELSE 'READY_FOR_BUILD' END AS readiness FROM v_issues GROUP BY run_id")
def _(v):
    return research.readiness(v("v_issues"))


@query("gap_issue_coverage", "WITH i AS (SELECT DISTINCT run_id, code FROM v_issues WHERE issue), g AS (SELECT run_id, code, count(*) AS n FROM v_issues WHERE waived GROUP BY 1, 2) SELECT 'gap_coverage' AS rule, CASE WHEN i.code IS NULL THEN 'NO_ISSUE' WHEN n IS NULL THEN 'NOT_COVERED' ELSE 'COVERED_TWICE' END AS code, coalesce(i.run_id, g.run_id) || '/' || coalesce(i.code, g.code) AS key, '' AS detail FROM i FULL JOIN g ON i.run_id = g.run_id AND i.code = g.code WHERE i.code IS NULL OR n IS NULL OR n > 1")
def _(v):
    return research.gap_issue_coverage(v("v_issues").where("waived"), v("v_issues").where("issue"))


@query("evidence_thresholds", "WITH c AS (SELECT source_type, count(*) AS n, count(CASE WHEN source_tier = 1 THEN 1 END) AS t FROM v_sources WHERE access_status = 'public' GROUP BY 1) SELECT 'evidence_threshold' AS rule, 'TOO_FEW' AS code, source_type AS key, 'primary' AS detail FROM c WHERE t < 20 UNION ALL SELECT 'evidence_threshold', 'TOO_FEW', source_type, 'sources' FROM c WHERE n < 80")
def _(v):
    counts = v("v_sources").where("access_status = 'public'").groupBy("source_type").agg(F.count("*").alias("sources"), F.count_if(F.col("source_tier") == 1).alias("primary"))
    return research.evidence_thresholds(counts, {"sources": 80, "primary": 20}, "source_type")


@query("pain_summary", "SELECT section AS pain, count(*) AS items, round(avg(doc_id % 5), 4) AS severity, count(DISTINCT run_id) AS sources FROM v_issues WHERE issue GROUP BY section")
def _(v):
    return research.pain_summary(v("v_issues").where("issue").select(F.col("section").alias("pain"), (F.col("doc_id") % 5).alias("severity"), F.col("run_id").alias("source")))


@query("license_reuse", "SELECT coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END, 'none') AS license, count(*) AS repositories, count(CASE WHEN p_size % 2 = 0 THEN 1 END) AS stale, CAST(sum(p_size) AS BIGINT) AS components FROM part GROUP BY 1")
def _(v):
    rows = v("part").select(F.when(F.col("p_size") % 5 != 0, F.col("p_type")).alias("license"), (F.col("p_size") % 2 == 0).alias("stale"), F.col("p_size").alias("components"))
    return research.license_reuse(rows)


@query("question_numbering", "WITH f AS (SELECT attempt, bucket, question, min(seq) AS first, count(*) AS origins FROM v_turns GROUP BY 1, 2, 3) SELECT attempt, bucket, question, origins, 'RQ-' || bucket || '-' || lpad(CAST(row_number() OVER (PARTITION BY attempt, bucket ORDER BY first, question) AS STRING), 2, '0') AS code FROM f")
def _(v):
    return research.question_numbering(v("v_turns")).select("attempt", "bucket", "question", "origins", "code")


@query("question_origins", "WITH a AS (SELECT DISTINCT attempt, question FROM v_turns WHERE role = 'user'), b AS (SELECT DISTINCT attempt, question FROM v_turns WHERE role = 'assistant') SELECT 'question_origin' AS rule, CASE WHEN b.attempt IS NULL THEN 'NO_ORIGIN' ELSE 'NOT_MAPPED' END AS code, CAST(coalesce(a.attempt, b.attempt) AS STRING) || '/' || CAST(coalesce(a.question, b.question) AS STRING) AS key, '' AS detail FROM a FULL JOIN b ON a.attempt = b.attempt AND a.question = b.question WHERE a.attempt IS NULL OR b.attempt IS NULL")
def _(v):
    t = v("v_turns")
    return research.question_origins(t.where("role = 'user'"), t.where("role = 'assistant'"), ["attempt", "question"])


@query("next_gap", "WITH a AS (SELECT p_brand, p_partkey AS id, p_size % 7 = 0 AS critical, p_size AS pos FROM part WHERE p_size % 7 = 0 OR p_type <> 'ECONOMY') SELECT p_brand, arg_min(id, (CASE WHEN critical THEN 0 ELSE 1 END, pos, id)) AS id FROM a GROUP BY p_brand")
def _(v):
    rows = v("part").select("p_brand", F.col("p_partkey").alias("id"), (F.col("p_size") % 7 == 0).alias("critical"), F.col("p_size").alias("pos"), F.when(F.col("p_type") == "ECONOMY", "HIGH").otherwise("LOW").alias("clarity"))
    return research.next_gap(rows, "p_brand")


@query("opportunity_topk", "SELECT p_brand, p_partkey, CAST(pos AS INT) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part) t WHERE pos <= 4")
def _(v):
    return research.top_k(v("part"), "p_brand", [F.col("p_retailprice").desc(), "p_partkey"], 4).select("p_brand", "p_partkey", "pos")


@query("contract_checks", "SELECT 'required.url' AS rule, 'REQUIRED' AS code, id AS key, '' AS detail FROM v_sources_raw WHERE url IS NULL UNION ALL SELECT 'enum.access_status', 'ENUM', id, access_status FROM v_sources_raw WHERE access_status <> 'public' UNION ALL SELECT 'range.source_tier', 'RANGE', id, CAST(source_tier AS STRING) FROM v_sources_raw WHERE source_tier NOT BETWEEN 1 AND 3 UNION ALL SELECT 'pattern.url', 'PATTERN', id, url FROM v_sources_raw WHERE url LIKE 'ftp%' UNION ALL SELECT 'conditional.tier_one', 'CONDITIONAL', id, '' FROM v_sources_raw WHERE source_tier = 1 AND source_type <> 'official_documentation'")
def _(v):
    rules = [
        violations.required("url"),
        violations.allowed("access_status", ["public"]),
        violations.between("source_tier", 1, 3),
        violations.matches("url", "^https?://"),
        violations.implies("tier_one", F.col("source_tier") == 1, F.col("source_type") == "official_documentation"),
    ]
    return violations.check(v("v_sources_raw"), F.col("id"), rules)


@query("field_whitelist", "SELECT 'field_whitelist' AS rule, CASE k.k WHEN 0 THEN 'UNKNOWN_KEY' ELSE 'RESERVED_KEY' END AS code, CAST(event_id AS STRING) AS key, 'k' AS detail FROM events CROSS JOIN k4 k WHERE k.k <= 1")
def _(v):
    return research.field_whitelist(v("events"), F.col("event_id"), "props", ["name"], ["k"])


@query("safe_relative_path", "SELECT page_id, page_id % 3 <> 0 AS safe FROM pages")
def _(v):
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "../").otherwise("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return v("pages").select("page_id", core.safe_relative_path(path).alias("safe"))


@query("condition_eval", "WITH t AS (SELECT node AS condition, CASE WHEN node % 2 = 0 THEN 'any_of' ELSE 'all' END AS kind, CASE depends_on % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE WHEN depends_on % 2 = 0 THEN false END END AS v FROM v_edges) SELECT condition, kind, CASE WHEN kind = 'any_of' THEN CASE WHEN bool_or(coalesce(v, false)) THEN true WHEN count(CASE WHEN NOT v THEN 1 END) = count(*) THEN false END ELSE CASE WHEN bool_or(NOT coalesce(v, true)) THEN false WHEN count(CASE WHEN v THEN 1 END) = count(*) THEN true END END AS value FROM t GROUP BY condition, kind")
def _(v):
    e = v("v_edges")
    terms = e.select(F.col("node").alias("condition"), F.when(F.col("node") % 2 == 0, "any_of").otherwise("all").alias("kind"), F.col("depends_on").alias("node"))
    n = F.col("depends_on")
    states = e.select("depends_on").distinct().select(n.alias("node"), F.when(n % 3 == 0, True).when(n % 3 == 1, False).alias("value"), (n % 2 == 0).alias("resolved"))
    return research.condition_eval(terms, states)


@query("citation_metadata_check", "SELECT 'citation_metadata' AS rule, 'URL' AS code, id AS key, '' AS detail FROM v_sources_raw WHERE url IS NULL OR url LIKE 'ftp%' UNION ALL SELECT 'citation_metadata', 'PUBLISHER', id, '' FROM v_sources_raw WHERE publisher IS NULL UNION ALL SELECT 'citation_metadata', 'TITLE', id, '' FROM v_sources_raw WHERE title IS NULL")
def _(v):
    return research.citation_metadata(v("v_sources_raw"))


@query("candidate_shape_check", "SELECT 'pattern.name' AS rule, 'PATTERN' AS code, id AS key, name AS detail FROM v_candidates WHERE name LIKE '%7' UNION ALL SELECT 'enum.category', 'ENUM', id, category FROM v_candidates WHERE category = 'platform_risk'")
def _(v):
    return violations.check(v("v_candidates"), F.col("id"), [violations.matches("name", "[^7]$"), violations.allowed("category", ["direct", "indirect", "substitute", "adjacent"])])


@query("gate_action_check", "SELECT 'gate' AS rule, CASE WHEN o_orderstatus = 'P' THEN 'KIND' WHEN o_orderkey % 3 = 0 THEN 'ACTIONS' ELSE 'RECOMMENDATION' END AS code, CAST(o_orderkey AS STRING) AS key, '' AS detail FROM orders WHERE o_orderstatus = 'P' OR o_orderkey % 3 = 0 OR o_orderkey % 5 = 0")
def _(v):
    actions = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("approve"))).otherwise(F.array(F.lit("reject"), F.lit("approve")))
    gates = v("orders").select(F.col("o_orderkey").alias("gate_id"), F.col("o_orderstatus").alias("kind"), actions.alias("actions"), F.when(F.col("o_orderkey") % 5 == 0, "wait").otherwise("approve").alias("recommendation"))
    return research.gate_actions(gates, {"F": ["approve", "reject"], "O": ["approve", "reject"]})


@query("required_charts", "WITH h AS (SELECT user_id AS g, bool_or(event_type = 'click') AS c, bool_or(event_type = 'error') AS e, count(DISTINCT CASE WHEN event_type IN ('view', 'signup') THEN event_type END) AS n FROM events GROUP BY 1) SELECT 'required_charts' AS rule, 'MISSING' AS code, CAST(g AS STRING) AS key, 'click' AS detail FROM h WHERE NOT c UNION ALL SELECT 'required_charts', 'MISSING', CAST(g AS STRING), 'error' FROM h WHERE NOT e UNION ALL SELECT 'required_charts', 'CHOICE', CAST(g AS STRING), '' FROM h WHERE n <> 1")
def _(v):
    charts = v("events").select(F.col("user_id").alias("group_id"), F.col("event_type").alias("chart"))
    return research.required_charts(charts, ["click", "error"], ["view", "signup"])


@query("report_lineage", "WITH r AS (SELECT l_orderkey AS report_id, l_linenumber AS version, l_linenumber - CASE WHEN l_partkey % 9 = 0 THEN 2 ELSE 1 END AS base_version, CAST(l_suppkey AS STRING) AS path FROM lineitem), u AS (SELECT report_id, version, min(base_version) AS base_version, min(path) AS path FROM r GROUP BY 1, 2) SELECT 'report_lineage' AS rule, CASE WHEN b.version IS NULL THEN 'NO_BASE' WHEN a.base_version <> b.version THEN 'BASE' ELSE 'PATH' END AS code, CAST(a.report_id AS STRING) || '@' || CAST(a.version AS STRING) AS key, '' AS detail FROM u a LEFT JOIN u b ON a.report_id = b.report_id AND a.version = b.version + 1 WHERE a.version > 1 AND (b.version IS NULL OR a.base_version <> b.version OR a.path = b.path)")
def _(v):
    rows = v("lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("version"), (F.col("l_linenumber") - F.when(F.col("l_partkey") % 9 == 0, 2).otherwise(1)).alias("base_version"), F.col("l_suppkey").cast("string").alias("path"))
    return research.report_lineage(rows.groupBy("report_id", "version").agg(F.min("base_version").alias("base_version"), F.min("path").alias("path")))


_IMPACT = "RECURSIVE imp AS (SELECT CAST(3 AS BIGINT) AS node UNION SELECT e.node FROM v_edges e JOIN imp ON e.depends_on = imp.node)"


def _roots(v):
    return v("v_edges").where("depends_on = 3").select(F.col("depends_on").alias("node")).distinct()


@query("downstream_impact", f"WITH {_IMPACT} SELECT node FROM imp WHERE node <> 3")
def _(v):
    return lineage.downstream_impact(v("v_edges"), _roots(v))


@query("impact_blocked", f"WITH {_IMPACT} SELECT 'impact' AS rule, 'RUNNING_ATTEMPT' AS code, CAST(o_orderkey AS STRING) AS key, CAST(o_orderkey % 2000 AS STRING) AS detail FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 2000 IN (SELECT node FROM imp)")
def _(v):
    attempts = v("orders").select(F.col("o_orderkey").alias("attempt_id"), (F.col("o_orderkey") % 2000).alias("node"), F.when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("DONE").alias("status"))
    return lineage.impact_blocked(lineage.downstream_impact(v("v_edges"), _roots(v), True), attempts)


@query("affected_artifact_types", f"WITH {_IMPACT} SELECT p_type AS artifact_type, count(DISTINCT p_partkey) AS nodes FROM part WHERE p_partkey IN (SELECT node FROM imp) GROUP BY 1")
def _(v):
    outputs = v("part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("artifact_type"))
    return lineage.affected_artifact_types(lineage.downstream_impact(v("v_edges"), _roots(v), True), outputs)


@query("apply_invalidation", f"WITH {_IMPACT} SELECT p_partkey AS node, CASE WHEN p_partkey IN (SELECT node FROM imp) THEN 'INVALIDATED' ELSE p_type END AS status, CAST(p_size + CASE WHEN p_partkey IN (SELECT node FROM imp) THEN 1 ELSE 0 END AS BIGINT) AS state_version FROM part")
def _(v):
    states = v("part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("status"), F.col("p_size").cast("long").alias("state_version"))
    return lineage.apply_invalidation(states, lineage.downstream_impact(v("v_edges"), _roots(v), True))


@query("retry_plan_reset", f"WITH {_IMPACT} SELECT p_partkey AS node FROM part WHERE p_partkey NOT IN (SELECT node FROM imp)")
def _(v):
    return lineage.retry_plan_reset(v("v_edges"), _roots(v), v("part").select(F.col("p_partkey").alias("node")))[1]


@query("cycle_nodes", "WITH RECURSIVE e AS (SELECT node, depends_on FROM v_edges UNION SELECT CAST(1 AS BIGINT), max(node) FROM v_edges), r AS (SELECT node, depends_on FROM e UNION SELECT r.node, e.depends_on FROM r JOIN e ON e.node = r.depends_on) , cyc AS (SELECT DISTINCT node FROM r WHERE node = depends_on) SELECT DISTINCT node FROM r WHERE depends_on IN (SELECT node FROM cyc) UNION SELECT node FROM cyc")
def _(v):
    e = v("v_edges")
    back = e.agg(F.lit(1).cast("long").alias("node"), F.max("node").alias("depends_on"))
    return lineage.cycle_nodes(e.union(back))


_BACK = "RECURSIVE e AS (SELECT node, depends_on FROM v_edges UNION SELECT CAST(1 AS BIGINT), max(node) FROM v_edges), r AS (SELECT node, depends_on FROM e UNION SELECT r.node, e.depends_on FROM r JOIN e ON e.node = r.depends_on)"


@query("cycle_violations", f"WITH {_BACK} SELECT 'dag_cycle' AS rule, 'CYCLE' AS code, CAST(a.node AS STRING) AS key, CAST(min(a.depends_on) AS STRING) AS detail FROM r a JOIN r b ON b.node = a.depends_on AND b.depends_on = a.node GROUP BY a.node")
def _(v):
    e = v("v_edges")
    return lineage.cycle_violations(e.union(e.agg(F.lit(1).cast("long").alias("node"), F.max("node").alias("depends_on"))))


@query("impact_by_root", "WITH RECURSIVE i AS (SELECT depends_on AS root, node FROM v_edges WHERE depends_on % 40 = 3 UNION SELECT i.root, e.node FROM i JOIN v_edges e ON e.depends_on = i.node) SELECT root, node FROM i")
def _(v):
    e = v("v_edges")
    return lineage.impact_by_root(e, e.where("depends_on % 40 = 3").select(F.col("depends_on").alias("node")))


@query("dangling_dependencies", "SELECT 'dependency' AS rule, 'UNKNOWN' AS code, CAST(node AS STRING) AS key, CAST(depends_on AS STRING) AS detail FROM v_edges WHERE depends_on NOT IN (SELECT p_partkey FROM part WHERE p_size % 10 <> 0) UNION ALL SELECT 'dependency', 'SELF', CAST(node AS STRING), CAST(depends_on AS STRING) FROM v_edges WHERE node = depends_on")
def _(v):
    return lineage.dangling_dependencies(v("v_edges"), v("part").where("p_size % 10 <> 0").select(F.col("p_partkey").alias("node")))


@query("input_refs", "SELECT e.node, string_agg(DISTINCT p.p_brand, ',' ORDER BY p.p_brand) AS input_refs FROM v_edges e JOIN part p ON p.p_partkey = e.depends_on GROUP BY e.node")
def _(v):
    out = lineage.input_refs(v("v_edges"), v("part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("artifact_ref")))
    return out.withColumn("input_refs", F.array_join("input_refs", ","))


@query("profile_extension", "WITH n AS (SELECT node + 1000000 AS node, depends_on AS after, node AS before FROM v_edges WHERE node % 10 = 0) SELECT e.node, e.depends_on FROM v_edges e WHERE e.node % 10 <> 0 UNION ALL SELECT node, after FROM n UNION ALL SELECT before, node FROM n")
def _(v):
    e = v("v_edges")
    new = e.where("node % 10 = 0").select((F.col("node") + 1000000).alias("node"), F.col("depends_on").alias("after"), F.col("node").alias("before"))
    return lineage.insert_between(e, new)


_IDEA = ["problem", "pain", "trigger", "user", "context", "outcome", "core_value", "better", "mechanism", "direction"]
_P = [2, 3, 5, 2, 3, 7, 2, 5, 2, 3]


def _ideas(v):
    have = {n: F.when(F.col("p_size") % m == 0, "x").otherwise("") for n, m in zip(_IDEA, _P, strict=True)}
    unknown = F.when(F.col("p_size") % 11 == 0, F.array(F.lit("problem"))).otherwise(F.array().cast("array<string>"))
    rows = v("part").select("p_partkey", "p_size", *(c.alias(n) for n, c in have.items()), unknown.alias("unknown_dimensions"), (F.col("p_size") % 13 == 0).alias("critical_assumption"), (F.col("p_size") % 4 != 1).alias("researchable"))
    return ideas.dimension_clarity(rows).withColumn("gap", ideas.gap_dimension())


_CLARITY = """WITH f AS (SELECT p_partkey, p_size, p_size % 2 = 0 AS a, p_size % 3 = 0 AS b, p_size % 5 = 0 AS c, p_size % 7 = 0 AS o, p_size % 11 = 0 AS u, p_size % 13 = 0 AS crit, p_size % 4 <> 1 AS res FROM part),
l AS (SELECT *, CASE WHEN a THEN 'HIGH' WHEN b OR c THEN 'LOW' ELSE 'UNKNOWN' END AS problem, CASE WHEN a THEN 'HIGH' ELSE 'UNKNOWN' END AS usr, CASE WHEN b THEN 'HIGH' WHEN c OR o THEN 'LOW' ELSE 'UNKNOWN' END AS scenario,
  CASE WHEN a THEN 'HIGH' WHEN c THEN 'LOW' ELSE 'UNKNOWN' END AS val, CASE WHEN a THEN 'HIGH' WHEN b THEN 'LOW' ELSE 'UNKNOWN' END AS mech FROM f),
k AS (SELECT *, CASE WHEN a AND b THEN 'CLEAR' WHEN NOT (a OR b OR c OR o) THEN 'VAGUE' ELSE 'PARTIAL' END AS clarity,
  CASE WHEN crit THEN 'assumptions' WHEN problem <> 'HIGH' THEN 'problem' WHEN usr <> 'HIGH' THEN 'user' WHEN scenario <> 'HIGH' THEN 'scenario' WHEN val <> 'HIGH' THEN 'value' WHEN mech <> 'HIGH' THEN 'mechanism' ELSE 'assumptions' END AS gap FROM l)"""


@query("dimension_clarity", f"{_CLARITY} SELECT p_partkey, clarity, gap FROM k")
def _(v):
    return _ideas(v).select("p_partkey", "clarity", "gap")


@query("idea_completion", f"{_CLARITY} SELECT p_partkey, CASE WHEN (a OR u) AND a AND b AND (crit OR res) THEN 'SUFFICIENT' WHEN p_size >= 8 THEN CASE WHEN crit OR res THEN 'PARTIAL_RESEARCHABLE' ELSE 'INSUFFICIENT_PRODUCT_CONTEXT' END ELSE 'IN_PROGRESS' END AS completion, NOT (crit OR res) AND (a OR b) AS seed FROM k")
def _(v):
    return _ideas(v).select("p_partkey", ideas.completion(F.col("p_size")).alias("completion"), ideas.needs_seed().alias("seed"))


@query("interview_method", f"{_CLARITY} SELECT p_partkey, CASE WHEN gap = 'assumptions' THEN 'assumption_challenge' WHEN clarity = 'VAGUE' AND p_size = 1 THEN 'controlled_brainstorming' WHEN clarity = 'VAGUE' THEN 'adaptive_product_discovery_interview' WHEN (gap = 'problem' AND problem = 'LOW' AND NOT u) OR (gap = 'scenario' AND scenario = 'LOW') OR (gap = 'value' AND val = 'LOW') OR (gap = 'mechanism' AND mech = 'LOW') THEN 'clarification' ELSE 'adaptive_product_discovery_interview' END AS method FROM k")
def _(v):
    return _ideas(v).select("p_partkey", ideas.interview_method(F.col("p_size")).alias("method"))
