"""Views of the driver's tables in the shapes of research evidence.

The text is valid in Spark and in DuckDB, so a query and its counterpart start from the same rows;
SHA256(x) stands for the engine's own function.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS: dict[str, str] = {
    "k4": """
SELECT * FROM (VALUES (0),(1),(2),(3)) AS t(k)
""",
    "k5": """
SELECT * FROM (VALUES (0,'workflow_fit'),(1,'developer_experience'),(2,'extensibility_integration'),(3,'ai_capability'),(4,'ecosystem_maturity')) AS t(k, dimension_id)
""",
    "v_sources_raw": """
SELECT 'SRC-' || CAST(page_id AS STRING) AS id, CAST(0 AS INT) AS batch,
       CASE WHEN page_id % 41 = 7 THEN 'ftp://files.example.com/x' WHEN page_id % 29 = 3 THEN NULL ELSE url END AS url,
       CASE page_id % 3 WHEN 0 THEN 'official_documentation' WHEN 1 THEN 'repository' ELSE 'community_post' END AS source_type,
       CASE WHEN page_id % 29 = 3 THEN CASE WHEN page_id % 2 = 0 THEN 'T' END ELSE 'Page ' || CAST(page_id AS STRING) END AS title,
       CASE WHEN page_id % 29 = 3 THEN CASE WHEN page_id % 3 > 0 THEN 'T' END ELSE 'Publisher ' || CAST(page_id % 5 AS STRING) END AS publisher,
       CAST(1 + page_id % 4 AS INT) AS source_tier,
       CASE WHEN page_id % 17 = 0 THEN 'restricted' ELSE 'public' END AS access_status,
       DATE '2024-01-31' - CAST(page_id % 60 AS INT) AS accessed_on,
       CASE WHEN page_id % 4 <> 1 THEN DATE '2023-06-01' - CAST(page_id % 2 AS INT) END AS published_on, CASE WHEN page_id % 5 > 1 THEN 'h' || CAST(page_id % 3 AS STRING) END AS content_hash
FROM pages
UNION ALL
SELECT 'SRC-' || CAST(page_id + 1000000 AS STRING), CAST(1 AS INT), url || '#dup',
       CASE page_id % 3 WHEN 0 THEN 'official_documentation' WHEN 1 THEN 'repository' ELSE 'community_post' END,
       CASE WHEN page_id % 70 = 0 THEN 'Renamed' ELSE 'Page ' || CAST(page_id AS STRING) END, 'Publisher ' || CAST(page_id % 5 AS STRING),
       CAST(1 + page_id % 4 AS INT), CASE WHEN page_id % 17 = 0 THEN 'restricted' ELSE 'public' END,
       DATE '2024-01-31',
       CASE WHEN page_id % 4 <> 1 THEN DATE '2023-06-01' - CAST(page_id % 2 AS INT) END, CASE WHEN page_id % 140 = 7 THEN 'changed' WHEN page_id % 5 > 1 THEN 'h' || CAST(page_id % 3 AS STRING) END
FROM pages WHERE page_id % 7 = 0 AND page_id % 41 <> 7 AND page_id % 29 <> 3
""",
    "v_sources": """
SELECT id, source_type, source_tier, access_status, accessed_on,
       CASE WHEN accessed_on >= DATE '2024-01-24' THEN 'FRESH' WHEN accessed_on >= DATE '2023-12-15' THEN 'STALE' ELSE 'UNKNOWN' END AS freshness_status
FROM v_sources_raw WHERE batch = 0
""",
    "v_evidence": """
SELECT 'EV-' || CAST(d.doc_id AS STRING) || '-' || CAST(k.k AS STRING) AS id,
       'CL-' || CAST(d.doc_id AS STRING) AS claim_id,
       'SRC-' || CAST((d.doc_id * 7 + k.k * 13) % (n.n + 5) AS STRING) AS source_id,
       CASE WHEN (d.doc_id + k.k) % 9 = 0 THEN 'contradicts' WHEN (d.doc_id + k.k) % 4 = 0 THEN 'contextual' ELSE 'supports' END AS direction
FROM documents d CROSS JOIN k4 k CROSS JOIN (SELECT count(*) AS n FROM pages) n WHERE k.k <= d.doc_id % 4
""",
    "v_claims": """
SELECT 'CL-' || CAST(d.doc_id AS STRING) AS id, d.source AS subject,
       CASE d.doc_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'competitor' WHEN 2 THEN 'market' WHEN 3 THEN 'technology' ELSE 'product' END AS category,
       l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""",
    "v_candidates": """
SELECT 'cmp_' || CAST(s_suppkey AS STRING) AS id, s_name AS name,
       CASE s_nationkey % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'indirect' WHEN 2 THEN 'substitute' WHEN 3 THEN 'adjacent' ELSE 'platform_risk' END AS category
FROM supplier
""",
    "v_candidate_sources": """
SELECT 'cmp_' || CAST(s.s_suppkey AS STRING) AS candidate_id, CAST(k.k AS INT) AS pos,
       'SRC-' || CAST((s.s_suppkey * 5 + k.k * 11) % (n.n + 2) AS STRING) AS source_id
FROM supplier s CROSS JOIN k4 k CROSS JOIN (SELECT count(*) AS n FROM pages) n WHERE k.k < s.s_suppkey % 5
""",
    "v_features": """
SELECT DISTINCT 'cmp_' || CAST(l.l_suppkey AS STRING) AS competitor_id,
       CASE WHEN p.p_size % 2 = 0 THEN 'feature' ELSE 'workflow' END AS kind, p.p_brand AS label
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
""",
    "v_judgments": """
SELECT 'cmp_' || CAST(a.l_suppkey AS STRING) AS competitor_id, k.dimension_id, CAST(k.k AS INT) AS dimension_order,
       CASE WHEN (a.l_suppkey * 5 + k.k) % 7 = 0 OR (a.l_suppkey % 8 = 0 AND k.k < 2) THEN 'UNRESOLVED' ELSE 'SCORED' END AS judgment_status,
       CASE WHEN (a.l_suppkey * 5 + k.k) % 7 = 0 OR (a.l_suppkey % 8 = 0 AND k.k < 2) THEN NULL ELSE CAST(1 + (a.n + k.k * 3) % 10 AS INT) END AS score
FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey) a CROSS JOIN k5 k
""",
    "v_events": """
SELECT user_id AS run_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS log_offset, ts, event_type AS event, event_id, value
FROM events
""",
    "v_attempts": """
SELECT o_custkey AS run_id, o_orderkey AS attempt_id, o_orderdate AS started_at,
       CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RUNNING' ELSE 'FAILED' END AS status,
       SHA256(CAST(o_custkey % 50 AS STRING) || '|' || o_orderpriority) AS input_fingerprint,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderkey % 5000 AS BIGINT) END AS tokens
FROM orders
""",
    "v_edges": """
SELECT CAST(p_partkey AS BIGINT) AS node, CAST(FLOOR(p_partkey / 2.0) AS BIGINT) AS depends_on FROM part WHERE p_partkey >= 2
UNION
SELECT CAST(p_partkey AS BIGINT), CAST(FLOOR(p_partkey / 3.0) AS BIGINT) FROM part WHERE p_partkey >= 3 AND p_partkey % 4 = 0
""",
    "v_status": """
SELECT user_id AS run_id, CAST(user_id % 10 AS BIGINT) AS node, event_id, ts,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS log_offset,
       CASE event_type WHEN 'click' THEN 'READY' WHEN 'view' THEN 'RUNNING' WHEN 'purchase' THEN 'COMPLETED' WHEN 'signup' THEN 'VERIFIED' ELSE 'FAILED' END AS status
FROM events
""",
    "v_node_state": """
SELECT run_id, status, log_offset FROM (
  SELECT run_id, status, log_offset, row_number() OVER (PARTITION BY run_id ORDER BY log_offset DESC) AS rn FROM v_status
) t WHERE rn = 1
""",
    "v_artifacts": """
SELECT user_id AS run_id, event_type AS artifact_id, event_id,
       CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS BIGINT) AS version,
       CASE WHEN event_id % 53 = 1 THEN CAST(7 AS BIGINT) ELSE CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS BIGINT) END AS supersedes,
       SHA256(CAST(event_id AS STRING)) AS content_hash
FROM events
""",
    "v_manifest": """
SELECT run_id, artifact_id, max(version) AS version FROM v_artifacts WHERE event_id % 5 <> 0 GROUP BY run_id, artifact_id
""",
    "v_commits": """
SELECT user_id AS run_id, CAST(max(event_id % 40) AS BIGINT) AS state_version FROM events GROUP BY user_id
""",
    "v_side": """
SELECT user_id AS run_id, CAST(event_id % 60 AS BIGINT) AS state_version, event_id, event_type AS item FROM events
""",
    "v_requests": """
SELECT o_custkey AS run_id, 'K' || CAST(o_orderkey % 97 AS STRING) AS key_hash, o_orderpriority AS request_hash, o_orderstatus AS operation, o_orderkey AS seq,
       CAST(o_orderkey % 7 AS BIGINT) AS expected_version
FROM orders
""",
    "v_traction": """
SELECT 'cmp_' || CAST(l_suppkey AS STRING) AS competitor_id,
       CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS BIGINT) AS negative,
       CAST(count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS BIGINT) AS positive,
       CAST(count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS BIGINT) AS neutral,
       CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(sum(l_quantity) AS BIGINT) END AS growth,
       CASE WHEN l_suppkey % 4 = 1 THEN NULL ELSE CAST(count(DISTINCT l_partkey) AS BIGINT) END AS contributors,
       CAST(count(DISTINCT l_orderkey) AS BIGINT) AS stars
FROM lineitem GROUP BY l_suppkey
""",
    "v_turns": """
SELECT conv_id AS attempt, turn AS seq, role, text, CAST(length(text) % 5 AS BIGINT) AS bucket, SHA256(text) AS answer_hash, CAST(length(text) % 23 AS BIGINT) AS question
FROM conversations
""",
    "v_issues": """
SELECT d.source AS run_id, d.lang AS section, d.doc_id, 'I' || CAST(d.doc_id % 13 AS STRING) AS code, l.toxic = 1 AS critical, l.toxic = 1 OR l.quality = 0 AS issue, d.doc_id % 6 = 0 AS waived
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""",
    "v_facts": """
SELECT 'F' || CAST(doc_id AS STRING) AS fact_id, source AS projection, lang AS group_id, 'CL-' || CAST(doc_id AS STRING) AS claim_id,
       SHA256(CAST(n_chars AS STRING)) AS content_hash, CASE WHEN doc_id % 37 = 5 THEN 'stale' ELSE SHA256(CAST(n_chars AS STRING)) END AS bound_hash, doc_id
FROM documents
""",
    "v_json_docs": """
SELECT o_orderkey AS k, 'ART-' || CAST(o_orderkey AS STRING) || '@1' AS artifact_ref, CAST(o_custkey AS STRING) AS stars, o_orderstatus AS state, o_orderpriority AS priority,
       '{"metrics" : {"stars": ' || CAST(o_custkey AS STRING) || ', "rate": 1.50, "tags": ["a", {"z": null, "b": "' || o_orderstatus || '"}]}, "artifact": {"id": "A", "content_hash": "old"}, "name": "caf'
       || chr(92) || 'u00e9 ' || o_orderpriority || '", "a/b": 1e2, "m~n": {"d": {"c": {"y": -0.0, "x": 12345678901234567890}}}}' AS doc
FROM orders
""",
    "v_bindings": """
SELECT 'B' || CAST(k AS STRING) AS key, k, origin_artifact_ref, origin_field_pointer, content, content_hash,
       CASE WHEN k % 29 = 2 THEN 'FACT-COMP-0' ELSE 'FACT-COMP-' || upper(substr(SHA256(origin_artifact_ref || chr(0) || origin_field_pointer || chr(0) || content_hash), 1, 20)) END AS fact_id
FROM (
  SELECT k, origin_artifact_ref, origin_field_pointer, content, CASE WHEN k % 23 = 1 THEN 'sha256:stale' ELSE 'sha256:' || SHA256(content) END AS content_hash FROM (
    SELECT k, CASE WHEN k % 41 = 3 THEN 'ART-' || CAST(k AS STRING) || '@0' ELSE artifact_ref END AS origin_artifact_ref,
           CASE k % 10 WHEN 0 THEN '/metrics/stars' WHEN 1 THEN '/metrics/tags/1' WHEN 2 THEN '/name' WHEN 3 THEN '/a~1b' WHEN 4 THEN '/m~0n/d' WHEN 5 THEN '/metrics/tags/01' WHEN 6 THEN '/name/x' WHEN 7 THEN 'name' WHEN 8 THEN '/a~2' ELSE '' END AS origin_field_pointer,
           CASE k % 10 WHEN 0 THEN stars WHEN 1 THEN '{"b":"' || state || '","z":null}' WHEN 2 THEN '"café ' || priority || '"' WHEN 3 THEN '100.0' WHEN 4 THEN '{"c":{"x":12345678901234567890,"y":-0.0}}' ELSE 'none' END AS content
    FROM v_json_docs) a) b
""",
    "v_binding_links": """
SELECT key, k, 'claim' AS kind, claim_id AS ref FROM (SELECT o_orderkey AS k, 'B' || CAST(o_orderkey AS STRING) AS key, 'CL-' || CAST(o_orderkey % (n.n + 9) AS STRING) AS claim_id FROM orders CROSS JOIN (SELECT count(*) AS n FROM documents) n) c
UNION ALL
SELECT 'B' || CAST(o_orderkey AS STRING), o_orderkey, 'evidence', e.id FROM (SELECT o_orderkey, 'CL-' || CAST(o_orderkey % (n.n + 9) AS STRING) AS claim_id FROM orders CROSS JOIN (SELECT count(*) AS n FROM documents) n) c
JOIN v_evidence e ON e.claim_id = c.claim_id WHERE o_orderkey % 13 <> 4 OR e.id NOT LIKE '%-0'
UNION ALL
SELECT 'B' || CAST(o_orderkey AS STRING), o_orderkey, 'evidence', 'EV-none' FROM orders WHERE o_orderkey % 31 = 5
UNION ALL
SELECT DISTINCT 'B' || CAST(o_orderkey AS STRING), o_orderkey, 'source', e.source_id FROM (SELECT o_orderkey, 'CL-' || CAST(o_orderkey % (n.n + 9) AS STRING) AS claim_id FROM orders CROSS JOIN (SELECT count(*) AS n FROM documents) n) c
JOIN v_evidence e ON e.claim_id = c.claim_id WHERE o_orderkey % 17 <> 6 OR e.id NOT LIKE '%-1'
""",
    "v_scores": """
SELECT competitor_id, CAST(sum(score) AS BIGINT) AS points, CAST(count(score) AS BIGINT) AS scored, CAST(count(*) AS BIGINT) AS dimensions,
       CASE WHEN count(score) >= 4 THEN CAST(sum(score) AS DOUBLE) / count(score) END AS final_score, CAST(count(score) AS DOUBLE) / 5 AS coverage
FROM v_judgments GROUP BY competitor_id
""",
}


def with_views(sql: str, sha: str = "sha256({})") -> str:
    """`sql` behind WITH clauses for the views it names, directly or through others."""
    found: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in found and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                found[name] = VIEWS[name].strip()

    visit(sql)
    recursive = re.match(r"\s*WITH\s+RECURSIVE\s", sql, re.I)
    own = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    clauses = ",\n".join(f"{n} AS (\n{b}\n)" for n, b in found.items())
    if found:
        head = "WITH RECURSIVE " if recursive else "WITH "
        sql = f"{head}{clauses},\n{sql[own.end():]}" if own else f"WITH {clauses}\n{sql}"
    return re.sub(r"SHA256\(((?:[^()]|\([^()]*\))*)\)", lambda m: sha.format(m[1]), sql)


class Views:
    """The views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        text = with_views(text, "sha2({}, 256)")
        for name in TABLES:
            if re.search(rf"\b{name}\b", text):
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __call__(self, name: str) -> DataFrame:
        return self.table(name) if name in TABLES else self.sql(f"SELECT * FROM {name}")
