"""Queries on claims, evidence and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import provenance as pv
from factloom.plans.registry import query


@query("dangling_evidence", "SELECT 'evidence_refs' AS rule, 'evidence_source' AS code, id AS key, source_id AS detail FROM v_evidence WHERE source_id NOT IN (SELECT id FROM v_sources)")
def _(v):
    return pv.dangling(pv.edge(v("v_evidence"), "evidence_source", "id", "source_id", "source"), pv.target(v("v_sources"), "source", "id"), "evidence_refs")


@query(
    "reference_integrity",
    """SELECT 'references' AS rule, 'evidence_source' AS code, id AS key, source_id AS detail FROM v_evidence WHERE source_id NOT IN (SELECT id FROM v_sources)
    UNION ALL SELECT 'references', 'evidence_claim', id, claim_id FROM v_evidence WHERE claim_id NOT IN (SELECT id FROM v_claims WHERE category <> 'market')
    UNION ALL SELECT 'references', 'candidate_source', candidate_id, source_id FROM v_candidate_sources WHERE source_id NOT IN (SELECT id FROM v_sources)""",
)
def _(v):
    e, s = v("v_evidence"), v("v_candidate_sources")
    edges = pv.edge(e, "evidence_source", "id", "source_id", "source").union(pv.edge(e, "evidence_claim", "id", "claim_id", "claim")).union(pv.edge(s, "candidate_source", "candidate_id", "source_id", "source"))
    targets = pv.target(v("v_sources"), "source", "id").union(pv.target(v("v_claims").where("category <> 'market'"), "claim", "id"))
    return pv.dangling(edges, targets, "references")


@query("fanin_completeness", "SELECT 'fanin' AS rule, 'PROFILE_MISSING' AS code, id AS key, '' AS detail FROM v_candidates WHERE id NOT IN (SELECT competitor_id FROM v_traction WHERE growth IS NOT NULL)")
def _(v):
    profiles = v("v_traction").select(F.col("competitor_id").alias("id"), F.col("growth").isNotNull().alias("verified"))
    return pv.fanin_completeness(v("v_candidates"), profiles)[1]


@query("identity_match", "SELECT 'identity' AS rule, 'MISMATCH' AS code, id AS key, 'category' AS detail FROM v_candidates WHERE category = 'direct'")
def _(v):
    c = v("v_candidates")
    return pv.identity_match(c.withColumn("category", F.when(F.col("category") == "direct", "other").otherwise(F.col("category"))), c, "id", ["name", "category"])


_CLAIMS = "c AS (SELECT id, subject || '/' || category AS statement, CASE WHEN quality = 1 THEN 'VALIDATED' ELSE 'OPEN' END AS status FROM v_claims WHERE length(id) > 4)"


@query("observation_claim", f"WITH {_CLAIMS}, t AS (SELECT statement, count(*) AS n FROM c WHERE status = 'VALIDATED' GROUP BY 1), o AS (SELECT id, subject || '/' || category AS text FROM v_claims) SELECT 'observation_claim' AS rule, CASE WHEN n IS NULL THEN 'NO_CLAIM' ELSE 'AMBIGUOUS' END AS code, o.id AS key, '' AS detail FROM o LEFT JOIN t ON o.text = t.statement WHERE coalesce(n, 0) <> 1")
def _(v):
    text = F.concat_ws("/", "subject", "category")
    claims = v("v_claims").where("length(id) > 4").select("id", text.alias("statement"), F.when(F.col("quality") == 1, "VALIDATED").otherwise("OPEN").alias("status"))
    return pv.observation_claim(v("v_claims").select(F.col("id").alias("obs_id"), text.alias("text")), claims)[1]


@query("fact_closure", "SELECT f.fact_id, string_agg(DISTINCT e.id, ',' ORDER BY e.id) AS evidence_refs, string_agg(DISTINCT e.source_id, ',' ORDER BY e.source_id) AS source_refs FROM v_facts f JOIN v_evidence e ON f.claim_id = e.claim_id JOIN v_sources s ON s.id = e.source_id GROUP BY f.fact_id")
def _(v):
    out = pv.fact_closure(v("v_facts"), v("v_evidence"), v("v_sources"))
    return out.select("fact_id", F.array_join("evidence_refs", ",").alias("evidence_refs"), F.array_join("source_refs", ",").alias("source_refs"))


@query("stale_facts", "SELECT 'fact_binding' AS rule, 'CONTENT_HASH' AS code, fact_id AS key, bound_hash AS detail FROM v_facts WHERE content_hash <> bound_hash")
def _(v):
    return pv.stale_facts(v("v_facts"))


@query("claims_reachable", "SELECT 'chart_claims' AS rule, 'MISSING' AS code, source_id AS key, 'CL-none' AS detail FROM v_evidence GROUP BY source_id")
def _(v):
    e = v("v_evidence")
    declared = e.select(F.col("source_id").alias("key"), F.col("claim_id").alias("member")).union(e.select("source_id", F.lit("CL-none")))
    return pv.claims_reachable(e.select(F.col("source_id").alias("key"), F.col("id").alias("evidence_id")), e, declared)


@query("set_equality", "SELECT 'sources' AS rule, CASE WHEN direction = 'contextual' THEN 'MISSING' ELSE 'EXTRA' END AS code, claim_id AS key, id AS detail FROM v_evidence WHERE direction <> 'supports'")
def _(v):
    e = v("v_evidence").select(F.col("claim_id").alias("key"), F.col("id").alias("member"), "direction")
    return pv.set_equality(e.where("direction <> 'contradicts'"), e.where("direction <> 'contextual'"), "sources")


@query("set_difference", "SELECT id, CASE WHEN batch = 0 THEN 'missing' ELSE 'unexpected' END AS side FROM v_sources_raw WHERE title <> 'Renamed'")
def _(v):
    rows = v("v_sources_raw").where("title <> 'Renamed'")
    a, b = rows.where("batch = 0").select("id"), rows.where("batch = 1").select("id")
    return a.exceptAll(b).withColumn("side", F.lit("missing")).union(b.exceptAll(a).withColumn("side", F.lit("unexpected")))


_FACTS = "(SELECT f.projection, f.group_id, f.claim_id, e.id AS evidence_id, e.source_id FROM v_facts f JOIN v_evidence e ON f.claim_id = e.claim_id)"


def _linked(v):
    return v("v_facts").join(v("v_evidence").select("claim_id", F.col("id").alias("evidence_id"), "source_id"), "claim_id")


@query("citation_closure", f"SELECT projection, string_agg(DISTINCT claim_id, ',' ORDER BY claim_id) AS claim_ids, string_agg(DISTINCT evidence_id, ',' ORDER BY evidence_id) AS evidence_ids, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS source_ids FROM {_FACTS} t GROUP BY projection")
def _(v):
    out = pv.citation_closure(_linked(v), "projection")
    return out.select("projection", *(F.array_join(c, ",").alias(c) for c in ("claim_ids", "evidence_ids", "source_ids")))


@query("group_citations", f"SELECT group_id, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS source_ids FROM {_FACTS} t GROUP BY group_id")
def _(v):
    return pv.citation_closure(_linked(v), "group_id").select("group_id", F.array_join("source_ids", ",").alias("source_ids"))


@query(
    "build_evidence",
    """WITH o AS (SELECT DISTINCT subject AS run_id, category AS node, e.source_id FROM v_claims c JOIN v_evidence e ON e.claim_id = c.id), c AS (SELECT *, 'CL-COMP-' || upper(substr(SHA256(run_id || '|' || node || '|' || 'seen'), 1, 16)) AS claim_id FROM o)
    SELECT 'EV-COMP-' || upper(substr(SHA256(claim_id || '|' || source_id), 1, 16)) AS id, claim_id, source_id, 'quantitative' AS evidence_type, 'supports' AS direction, 'high' AS relevance,
      CASE source_tier WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS reliability, CASE freshness_status WHEN 'FRESH' THEN 'high' WHEN 'STALE' THEN 'low' ELSE 'unknown' END AS freshness FROM c JOIN v_sources s ON s.id = c.source_id""",
)
def _(v):
    rows = v("v_claims").join(v("v_evidence").select(F.col("claim_id").alias("id"), "source_id"), "id").select(F.col("subject").alias("run_id"), F.col("category").alias("node"), F.lit("seen").alias("statement"), "source_id")
    return pv.build_evidence(rows, v("v_sources"), "feature")


@query("publication_union", "WITH t AS (SELECT DISTINCT group_id FROM v_facts), c AS (SELECT DISTINCT event AS chart_type FROM v_events), u AS (SELECT group_id, group_id AS section, 0 AS part, group_id AS o FROM t UNION ALL SELECT 'FG-CHART-' || upper(chart_type), lower('FG-CHART-' || upper(chart_type)), 1, chart_type FROM c) SELECT group_id, section, CAST(row_number() OVER (ORDER BY part, o) AS INT) AS pos FROM u")
def _(v):
    return pv.publication_union(v("v_facts").select("group_id").distinct(), v("v_events").select(F.col("event").alias("chart_type")).distinct())


@query("report_fact_rows", "SELECT DISTINCT f.group_id, f.fact_id, e.source_id, s.source_type FROM v_facts f JOIN v_evidence e ON f.claim_id = e.claim_id JOIN v_sources s ON s.id = e.source_id WHERE f.content_hash = f.bound_hash")
def _(v):
    return pv.report_rows(v("v_facts"), v("v_evidence"), v("v_sources"))[0]


@query("projection_audit", "SELECT DISTINCT 'projection' AS rule, 'INPUT_REFS' AS code, projection AS key, '' AS detail FROM v_facts WHERE bound_hash = 'stale'")
def _(v):
    facts = v("v_facts")
    stored = facts.groupBy("projection").agg(F.sort_array(F.collect_set("fact_id")).alias("refs")).withColumn("state_version", F.lit(1))
    return pv.projection_audit(stored, facts.where("bound_hash <> 'stale'"), F.lit(1))


@query("contradiction_rollup", "SELECT claim_id, count(CASE WHEN direction = 'supports' THEN 1 END) AS supports, count(CASE WHEN direction = 'contradicts' THEN 1 END) AS contradicts, count(CASE WHEN direction = 'contextual' THEN 1 END) AS contextual, bool_or(direction = 'supports') AND bool_or(direction = 'contradicts') AS contested FROM v_evidence GROUP BY claim_id")
def _(v):
    return pv.contradiction_rollup(v("v_evidence"))
