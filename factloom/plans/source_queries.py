"""Queries on sources and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import ranking, sources
from factloom.plans.registry import query

_URL = "'^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)(\\?[^#]*)?(#.*)?$'"
_CANON = f"""
parts AS (
  SELECT *, lower(regexp_extract(url, {_URL}, 1)) AS scheme, regexp_extract(url, {_URL}, 2) AS authority, regexp_extract(url, {_URL}, 3) AS path, regexp_extract(url, {_URL}, 4) AS q FROM v_sources_raw
), hosts AS (
  SELECT *, lower(regexp_extract(authority, '^([^:]*)(:[0-9]*)?$', 1)) AS host, regexp_extract(authority, '^[^:]*:([0-9]*)$', 1) AS port FROM parts
), canon AS (
  SELECT *, CASE WHEN url IS NOT NULL AND scheme IN ('http', 'https') AND host <> '' THEN
    scheme || '://' || host || CASE WHEN port = '' OR (scheme = 'http' AND port = '80') OR (scheme = 'https' AND port = '443') THEN '' ELSE ':' || port END
    || CASE WHEN path = '' THEN '/' ELSE path END || coalesce(q, '') END AS canonical_url FROM hosts
), ident AS (
  SELECT *, coalesce(canonical_url, 'meta' || CAST(to_json([publisher, title, CAST(published_on AS VARCHAR), content_hash]) AS VARCHAR)) AS identity, batch = 0 AS stored FROM canon
)"""
_VALID = """
good AS (
  SELECT l.candidate_id FROM v_candidate_sources l LEFT JOIN v_sources s ON l.source_id = s.id GROUP BY l.candidate_id HAVING bool_and(coalesce(s.access_status = 'public', false))
), valid AS (SELECT c.* FROM v_candidates c WHERE c.id IN (SELECT candidate_id FROM good))"""
_RANK = f"""WITH {_VALID}, counts AS (
  SELECT l.candidate_id, count(CASE WHEN s.freshness_status = 'FRESH' THEN 1 END) AS fresh, count(*) AS sources FROM v_candidate_sources l LEFT JOIN v_sources s ON l.source_id = s.id GROUP BY l.candidate_id
), ranked AS (
  SELECT v.id, v.name, v.category, coalesce(c.fresh, 0) AS fresh, coalesce(c.sources, 0) AS sources,
    row_number() OVER (PARTITION BY substr(v.id, length(v.id)) ORDER BY CASE v.category WHEN 'direct' THEN 5 WHEN 'indirect' THEN 4 WHEN 'substitute' THEN 3 WHEN 'adjacent' THEN 2 ELSE 1 END DESC,
      coalesce(c.fresh, 0) DESC, coalesce(c.sources, 0) DESC, lower(v.name), v.id) AS rank
  FROM valid v LEFT JOIN counts c ON v.id = c.candidate_id
)"""


def raw(v):
    return sources.canonical(v("v_sources_raw")).withColumn("stored", F.col("batch") == 0)


@query("canonicalize_url", f"WITH {_CANON} SELECT id, url, canonical_url FROM canon")
def _(v):
    return raw(v).select("id", "url", "canonical_url")


@query("quarantine_urls", f"WITH {_CANON} SELECT 'source_url' AS rule, 'SCHEME' AS code, id AS key, url AS detail FROM hosts WHERE url IS NOT NULL AND scheme NOT IN ('http', 'https')")
def _(v):
    return sources.quarantine_urls(v("v_sources_raw"))


@query("public_sources", "SELECT id, source_type, source_tier FROM v_sources WHERE access_status = 'public'")
def _(v):
    return sources.public_sources(v("v_sources")).select("id", "source_type", "source_tier")


@query("batch_union", "SELECT id, title, batch = 0 AS stored FROM v_sources_raw")
def _(v):
    rows = v("v_sources_raw").select("id", "title", "batch")
    return sources.batch_union(rows.where("batch = 0").drop("batch"), rows.where("batch = 1").drop("batch"))


@query("dedup_conflicts", f"WITH {_CANON} SELECT 'source_identity' AS rule, 'CONFLICT' AS code, identity AS key, CAST(count(DISTINCT (source_type, title, publisher, source_tier, access_status, published_on, content_hash)) AS STRING) AS detail FROM ident GROUP BY identity HAVING count(DISTINCT (source_type, title, publisher, source_tier, access_status, published_on, content_hash)) > 1")
def _(v):
    return sources.dedup_conflicts(raw(v))


@query(
    "dedup_sources",
    f"""WITH {_CANON}, best AS (SELECT *, row_number() OVER (PARTITION BY identity ORDER BY accessed_on DESC, id DESC) AS rn,
      coalesce(min(CASE WHEN stored THEN id END) OVER (PARTITION BY identity), min(id) OVER (PARTITION BY identity)) AS canonical_id FROM ident)
    SELECT canonical_id AS id, identity, title, publisher, source_type, source_tier, CAST(accessed_on AS STRING) AS accessed_on FROM best WHERE rn = 1""",
)
def _(v):
    return sources.dedup_sources(raw(v)).select("id", "identity", "title", "publisher", "source_type", "source_tier", F.col("accessed_on").cast("string").alias("accessed_on"))


@query("canonical_ids", f"WITH {_CANON} SELECT identity, coalesce(min(CASE WHEN stored THEN id END), min(id)) AS canonical_id FROM ident GROUP BY identity")
def _(v):
    return sources.canonical_ids(raw(v))


_ALIASES = f"WITH {_CANON}, ids AS (SELECT identity, coalesce(min(CASE WHEN stored THEN id END), min(id)) AS canonical_id FROM ident GROUP BY identity), aliases AS (SELECT DISTINCT i.id, d.canonical_id FROM ident i JOIN ids d ON i.identity = d.identity)"


@query("source_aliases", f"{_ALIASES} SELECT id, canonical_id FROM aliases")
def _(v):
    return sources.source_aliases(raw(v))


@query("canonical_collisions", f"{_ALIASES} SELECT 'canonical_id' AS rule, 'COLLISION' AS code, canonical_id AS key, CAST(count(DISTINCT identity) AS STRING) AS detail FROM ids GROUP BY canonical_id HAVING count(DISTINCT identity) > 1")
def _(v):
    return sources.canonical_collisions(raw(v))


@query(
    "rewrite_aliases",
    f"""{_ALIASES}, told AS (SELECT l.candidate_id, coalesce(a.canonical_id, l.source_id) AS source_id, min(l.pos) AS first FROM v_candidate_sources l LEFT JOIN aliases a ON l.source_id = a.id GROUP BY 1, 2)
    SELECT candidate_id, CAST(row_number() OVER (PARTITION BY candidate_id ORDER BY first, source_id) - 1 AS INT) AS pos, source_id FROM told""",
)
def _(v):
    return sources.rewrite_aliases(v("v_candidate_sources"), sources.source_aliases(raw(v)))


@query("stable_distinct", "SELECT candidate_id, string_agg(source_id, ',' ORDER BY first, source_id) AS source_ids FROM (SELECT candidate_id, source_id, min(pos) AS first FROM v_candidate_sources GROUP BY 1, 2) t GROUP BY 1")
def _(v):
    first = v("v_candidate_sources").groupBy("candidate_id", "source_id").agg(F.min("pos").alias("first"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "source_id")))
    return first.groupBy("candidate_id").agg(F.array_join(F.transform(ordered, lambda x: x["source_id"]), ",").alias("source_ids"))


@query(
    "source_issues",
    """WITH kinds AS (SELECT l.candidate_id, l.source_id, s.access_status, count(*) AS n FROM v_candidate_sources l LEFT JOIN v_sources s ON l.source_id = s.id GROUP BY 1, 2, 3)
    SELECT 'source_refs' AS rule, 'DUPLICATE' AS code, candidate_id AS key, source_id AS detail FROM kinds WHERE n > 1
    UNION ALL SELECT 'source_refs', 'MISSING', candidate_id, source_id FROM kinds WHERE access_status IS NULL
    UNION ALL SELECT 'source_refs', 'INACCESSIBLE', candidate_id, source_id FROM kinds WHERE access_status <> 'public'
    UNION ALL SELECT 'source_refs', 'EMPTY', id, '' FROM v_candidates WHERE id NOT IN (SELECT candidate_id FROM v_candidate_sources)""",
)
def _(v):
    return sources.source_issues(v("v_candidates"), v("v_candidate_sources").withColumnRenamed("candidate_id", "owner_id"), v("v_sources"))


@query("valid_candidates", f"WITH {_VALID} SELECT id, name, category FROM valid")
def _(v):
    return sources.valid_candidates(v("v_candidates"), v("v_candidate_sources"), v("v_sources"))


@query(
    "evidence_sufficiency",
    f"""WITH {_VALID}, counts AS (SELECT category AS group_id, count(*) AS valid FROM valid GROUP BY 1),
    kinds AS (SELECT v.category AS group_id, count(DISTINCT s.source_type) AS source_types, count(DISTINCT l.source_id) AS sources FROM valid v JOIN v_candidate_sources l ON v.id = l.candidate_id JOIN v_sources s ON s.id = l.source_id GROUP BY 1),
    told AS (SELECT c.group_id, c.valid, CASE WHEN c.group_id = 'direct' THEN CAST(5 AS BIGINT) ELSE c.valid END AS required, k.source_types, k.sources FROM counts c LEFT JOIN kinds k ON c.group_id = k.group_id)
    SELECT *, valid >= required AND source_types >= 2 AND sources <= 50 AS sufficient FROM told""",
)
def _(v):
    return sources.evidence_sufficiency(v("v_candidates").withColumn("group_id", F.col("category")), v("v_candidate_sources"), v("v_sources"), F.when(F.col("group_id") == "direct", 5))


@query("append_immutable", "SELECT 'immutable_append' AS rule, 'CONFLICT' AS code, 'Page ' || CAST(page_id AS STRING) AS key, '' AS detail FROM pages WHERE page_id % 7 = 0 AND page_id % 41 <> 7 AND page_id % 29 <> 3 AND page_id % 60 <> 0 AND page_id % 70 <> 0")
def _(v):
    rows = v("v_sources_raw").select(F.col("title").alias("key"), F.col("accessed_on"), "batch")
    _, conflicts = sources.append_immutable(rows.where("batch = 0"), rows.where("batch = 1"), "key", F.xxhash64("accessed_on"))
    return conflicts


@query("catalog_lookup", "SELECT id, CASE category WHEN 'direct' THEN 'deep' WHEN 'indirect' THEN 'short' ELSE 'none' END AS value FROM v_candidates")
def _(v):
    cat = v.spark.createDataFrame([("direct", "deep"), ("indirect", "short"), ("*", "none")], "category string, value string")
    keys = v("v_candidates").select("category").distinct()
    told = sources.catalog_lookup(keys, cat, "category")
    return v("v_candidates").join(told, "category").select("id", "value")


@query("claim_status", "SELECT e.claim_id, CASE WHEN bool_and(s.freshness_status = 'FRESH') AND bool_or(s.source_tier = 1) THEN 'VALIDATED' ELSE 'PARTIALLY_VALIDATED' END AS status, CASE WHEN bool_and(s.freshness_status = 'FRESH') AND bool_or(s.source_tier = 1) THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM v_evidence e JOIN v_sources s ON e.source_id = s.id GROUP BY e.claim_id")
def _(v):
    return sources.claim_status(v("v_evidence"), v("v_sources"))


def ranked(v):
    good = sources.valid_candidates(v("v_candidates"), v("v_candidate_sources"), v("v_sources"))
    runs = good.withColumn("run_id", F.expr("substr(id, length(id))"))
    return ranking.policy_ranking(runs, v("v_candidate_sources"), v("v_sources"), ("run_id",))


@query("policy_ranking", f"{_RANK} SELECT id, category, fresh, sources, CAST(rank AS INT) AS rank FROM ranked")
def _(v):
    return ranked(v).select("id", "category", "fresh", "sources", "rank")


@query("top_n_candidates", f"{_RANK} SELECT id, CAST(rank AS INT) AS rank, rank <= 5 AS selected, CASE WHEN rank <= 5 THEN 'rank ' || rank || ': category ' || category || ', ' || fresh || ' fresh of ' || sources || ' sources' ELSE 'rank ' || rank || ' is beyond the 5 requested' END AS rationale FROM ranked")
def _(v):
    return ranking.top_n(ranked(v), 5).select("id", "rank", "selected", "rationale")


@query("fanout_instances", f"{_RANK} SELECT 'deep_dive:' || id AS node, id AS instance_key, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5 AND id NOT IN (SELECT 'cmp_' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_suppkey % 9 = 0)")
def _(v):
    existing = v.table("supplier").where("s_suppkey % 9 = 0").select(F.concat(F.lit("deep_dive:cmp_"), F.col("s_suppkey").cast("string")).alias("node"))
    return ranking.fanout_instances("deep_dive", ranking.top_n(ranked(v), 5), existing)
