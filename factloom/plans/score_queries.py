"""Queries on judgments, scores, metrics and charts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import metrics, scoring
from factloom.plans.registry import query

_SCORE = """
agg AS (SELECT competitor_id, count(*) AS total, count(score) AS scored, sum(score) AS points FROM v_judgments GROUP BY competitor_id),
score AS (SELECT competitor_id, scored, CAST(scored AS DOUBLE) / total AS coverage, CASE WHEN scored = total THEN 'COMPLETE' WHEN scored * 5 >= total * 4 THEN 'PARTIAL' ELSE 'NOT_PERFORMED' END AS status,
  CASE WHEN scored * 5 >= total * 4 THEN round(CAST(points AS DOUBLE) / scored, 4) END AS final_score FROM agg)"""


def _plain(df):
    """Decimals as doubles with four places, which both engines round alike."""
    return df.withColumn("coverage", F.col("coverage").cast("double")).withColumn("final_score", F.round(F.col("final_score").cast("double"), 4))


@query("weighted_score", f"WITH {_SCORE} SELECT competitor_id, coverage, status, final_score FROM score")
def _(v):
    return _plain(scoring.weighted_score(v("v_judgments")))


@query("score_status", f"WITH {_SCORE} SELECT status, count(*) AS n FROM score GROUP BY status")
def _(v):
    return scoring.weighted_score(v("v_judgments")).groupBy("status").agg(F.count("*").alias("n"))


@query("effective_weights", "SELECT competitor_id, dimension_order, dimension_id, round(1.0::DOUBLE / count(*) OVER (PARTITION BY competitor_id), 4) AS effective_weight FROM v_judgments WHERE judgment_status = 'SCORED'")
def _(v):
    return scoring.effective_weights(v("v_judgments")).withColumn("effective_weight", F.round(F.col("effective_weight").cast("double"), 4))


@query("missing_dimensions", "SELECT competitor_id, string_agg(dimension_id, ',' ORDER BY dimension_order) AS missing FROM v_judgments WHERE judgment_status <> 'SCORED' GROUP BY competitor_id")
def _(v):
    dims = v("k5").withColumnRenamed("k", "dimension_order")
    return scoring.missing_dimensions(v("v_judgments"), dims).withColumn("missing", F.array_join("missing", ","))


@query(
    "competition_rank",
    f"""WITH {_SCORE}, ranked AS (SELECT *, rank() OVER (ORDER BY final_score DESC, coverage DESC) AS r, count(*) OVER (PARTITION BY final_score, coverage) AS n FROM score WHERE final_score IS NOT NULL)
    SELECT s.competitor_id, s.final_score, CAST(r.r AS INT) AS rank, CASE WHEN r.r IS NULL THEN 'NOT_RANKED' WHEN r.n > 1 THEN 'TIED' ELSE 'UNIQUE' END AS tie_status FROM score s LEFT JOIN ranked r ON s.competitor_id = r.competitor_id""",
)
def _(v):
    return _plain(scoring.competition_rank(scoring.weighted_score(v("v_judgments")))).select("competitor_id", "final_score", "rank", "tie_status")


@query("score_status_check", "SELECT 'judgment_score' AS rule, CASE WHEN judgment_status = 'SCORED' THEN 'SCORE' ELSE 'UNRESOLVED_SCORE' END AS code, competitor_id || '/' || dimension_id AS key, CAST(score + 2 AS STRING) AS detail FROM v_judgments WHERE score + 2 > 10")
def _(v):
    return scoring.score_status_check(v("v_judgments").withColumn("score", F.col("score") + 2), F.concat_ws("/", "competitor_id", "dimension_id"))


@query("duplicate_judgments", "SELECT 'judgments' AS rule, 'OUTSIDE_RANKING' AS code, competitor_id AS key, '' AS detail FROM v_judgments WHERE competitor_id NOT IN (SELECT id FROM v_candidates WHERE category <> 'adjacent') GROUP BY competitor_id UNION ALL SELECT 'judgments', 'DUPLICATE', competitor_id || '/' || dimension_id, '2' FROM v_judgments WHERE score = 7")
def _(v):
    j = v("v_judgments")
    return scoring.duplicate_judgments(j.union(j.where("score = 7")), v("v_candidates").where("category <> 'adjacent'"))


@query("score_audit", f"WITH {_SCORE} SELECT 'score_audit' AS rule, 'FINAL_SCORE' AS code, competitor_id AS key, '' AS detail FROM score WHERE final_score IS NOT NULL AND length(competitor_id) = 6 UNION ALL SELECT 'score_audit', 'STATUS', competitor_id, '' FROM score WHERE status = 'PARTIAL'")
def _(v):
    fresh = scoring.weighted_score(v("v_judgments"))
    tampered = F.when(F.length("competitor_id") == 6, F.col("final_score") + F.lit("0.5").cast("decimal(9,6)")).otherwise(F.col("final_score"))
    stored = fresh.withColumn("final_score", tampered.cast("decimal(9,6)")).withColumn("status", F.when(F.col("status") == "PARTIAL", "COMPLETE").otherwise(F.col("status")))
    return scoring.score_audit(v("v_judgments"), stored)


@query("score_band", "SELECT competitor_id, dimension_id, score, CASE WHEN score <= 2 THEN 'very_weak' WHEN score <= 4 THEN 'weak' WHEN score <= 6 THEN 'moderate' WHEN score <= 8 THEN 'strong' WHEN score <= 10 THEN 'exceptional' END AS band FROM v_judgments")
def _(v):
    return scoring.score_band(v("v_judgments")).select("competitor_id", "dimension_id", "score", "band")


@query("rubric_check", "SELECT 'rubric' AS rule, 'DIMENSION_COUNT' AS code, competitor_id AS key, '' AS detail FROM v_judgments WHERE judgment_status = 'SCORED' GROUP BY competitor_id HAVING count(*) <> 5 UNION ALL SELECT 'rubric', 'WEIGHT_SUM', competitor_id, '' FROM v_judgments WHERE judgment_status = 'SCORED' GROUP BY competitor_id HAVING count(*) <> 5")
def _(v):
    rows = scoring.with_weight(v("v_judgments").where("judgment_status = 'SCORED'"))
    return scoring.rubric_check(rows.select(F.col("competitor_id").alias("rubric_ref"), "dimension_id", "weight", F.lit(1).alias("minimum_evidence_count")))


@query("verification_binding", "SELECT 'verification_binding' AS rule, 'NOT_VERIFIED' AS code, CAST(o_orderkey AS STRING) AS key, '' AS detail FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT 'verification_binding', 'SHARED', CAST(l_orderkey AS STRING), '' FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey HAVING count(*) > 1")
def _(v):
    checks = v("lineitem").select(F.col("l_orderkey").alias("judgment_ref"), F.when(F.col("l_returnflag") == "A", "ACCEPT").otherwise("RETRY").alias("result"))
    return scoring.verification_binding(v("orders").select(F.col("o_orderkey").alias("judgment_ref")), checks)


@query("claim_category_scope", "SELECT 'claim_scope' AS rule, 'CATEGORY' AS code, 'ai_capability/' || id AS key, category AS detail FROM v_claims WHERE category NOT IN ('technology', 'product')")
def _(v):
    scope = v.spark.createDataFrame([("ai_capability", "technology"), ("ai_capability", "product")], "dimension_id string, category string")
    return scoring.claim_category_scope(v("v_claims").select(F.lit("ai_capability").alias("dimension_id"), F.col("id").alias("claim_id")), v("v_claims"), scope)


@query("judgment_links", "SELECT 'judgment_links' AS rule, 'EVIDENCE_NOT_OF_CLAIM' AS code, 'J' || CAST(doc_id AS STRING) || '/CL-' || CAST(doc_id AS STRING) AS key, 'EV-' || CAST(doc_id AS STRING) || '-2' AS detail FROM documents WHERE doc_id % 4 < 2")
def _(v):
    doc = F.col("doc_id").cast("string")
    links = v("documents").select(F.concat(F.lit("J"), doc).alias("judgment_ref"), F.concat(F.lit("CL-"), doc).alias("claim_id"), F.concat(F.lit("EV-"), doc, F.lit("-2")).alias("evidence_id"))
    return scoring.judgment_links(links, v("v_evidence"))


@query(
    "score_collection_order",
    """WITH told AS (SELECT competitor_id, row_number() OVER (ORDER BY final_score DESC NULLS LAST, CASE WHEN final_score IS NOT NULL THEN coverage END DESC NULLS LAST, competitor_id) AS pos, row_number() OVER (ORDER BY competitor_id) AS stored FROM v_scores)
    SELECT 'collection_order' AS rule, 'POSITION' AS code, competitor_id AS key, CAST(pos AS STRING) AS detail FROM told WHERE pos <> stored""",
)
def _(v):
    rows = v("v_scores")
    return scoring.collection_order(rows.withColumn("stored_pos", F.row_number().over(Window.orderBy("competitor_id"))))


_SCALED = "CASE WHEN hi = lo THEN (score - (lo - greatest(abs(hi) * 0.1, 1.0))) / (2 * greatest(abs(hi) * 0.1, 1.0)) ELSE CAST(score - lo AS DOUBLE) / (hi - lo) END"


@query("min_max_scale", f"WITH w AS (SELECT *, CAST(min(score) OVER (PARTITION BY dimension_id) AS DOUBLE) AS lo, CAST(max(score) OVER (PARTITION BY dimension_id) AS DOUBLE) AS hi FROM v_judgments WHERE score IS NOT NULL) SELECT competitor_id, dimension_id, CAST(round({_SCALED}, 6) AS DOUBLE) AS scaled FROM w")
def _(v):
    return scoring.min_max_scale(v("v_judgments").where("score IS NOT NULL"), "score", ["dimension_id"]).select("competitor_id", "dimension_id", F.round("scaled", 6).alias("scaled"))


def taxonomy(v):
    return metrics.feature_taxonomy(v("v_features"), [F.col("competitor_id"), F.col("kind"), F.col("label")])


_TAX = "tax AS (SELECT lower(label) AS token, min(label) AS label FROM v_features GROUP BY 1)"


@query("feature_taxonomy", f"WITH {_TAX} SELECT token, label FROM tax")
def _(v):
    return taxonomy(v)


@query("taxonomy_grid", f"WITH {_TAX} SELECT c.id AS competitor_id, t.token FROM v_candidates c CROSS JOIN tax t")
def _(v):
    return metrics.taxonomy_grid(taxonomy(v).select("token"), v("v_candidates").select(F.col("id").alias("competitor_id")))


@query("feature_coverage", f"WITH {_TAX}, have AS (SELECT competitor_id, lower(label) AS token, CAST(max(CASE kind WHEN 'feature' THEN 1.0 ELSE 0.5 END) AS DOUBLE) AS v FROM v_features GROUP BY 1, 2) SELECT c.id AS competitor_id, t.token, coalesce(h.v, 0.0) AS coverage FROM v_candidates c CROSS JOIN tax t LEFT JOIN have h ON h.competitor_id = c.id AND h.token = t.token")
def _(v):
    grid = metrics.taxonomy_grid(taxonomy(v).select("token"), v("v_candidates").select(F.col("id").alias("competitor_id")))
    return metrics.feature_coverage(v("v_features"), grid)


@query("traction_summary", "SELECT competitor_id, competitor_id || ': growth=' || coalesce(CAST(growth AS STRING), 'null') || '; contributors=' || coalesce(CAST(contributors AS STRING), 'null') || '; stars_context=' || CAST(stars AS STRING) || '.' AS observation, CASE WHEN growth IS NULL THEN competitor_id || ' has no observed growth value.' END AS limitation FROM v_traction")
def _(v):
    return metrics.traction_summary(v("v_traction"))


@query("review_counts", "SELECT competitor_id, positive, negative, positive + negative AS sample_size, CASE WHEN positive + negative = 0 THEN competitor_id || ' has no visible feedback sample.' END AS limitation FROM v_traction")
def _(v):
    return metrics.review_counts(v("v_traction"))


@query("pricing_limits", "WITH st AS (SELECT l.candidate_id, bool_or(s.freshness_status = 'STALE') AS stale FROM v_candidate_sources l JOIN v_sources s ON l.source_id = s.id GROUP BY 1) SELECT t.competitor_id, growth IS NULL OR contributors IS NULL AS unknown, coalesce(st.stale, false) AS stale FROM v_traction t LEFT JOIN st ON t.competitor_id = st.candidate_id")
def _(v):
    profiles = v("v_traction").select("competitor_id", F.col("growth").alias("pricing"), F.col("contributors").alias("license"), F.col("stars").alias("monetization"))
    return metrics.pricing_limits(profiles, v("v_candidate_sources").withColumnRenamed("candidate_id", "competitor_id"), v("v_sources"))


@query("normalize_metrics", " UNION ALL ".join(f"SELECT competitor_id, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM v_traction" for m in ("growth", "contributors", "stars", "positive", "negative")))
def _(v):
    return metrics.normalize_metrics(v("v_traction"), "competitor_id", ["growth", "contributors", "stars", "positive", "negative"])


@query("dataset_alignment", "SELECT 'dataset_alignment' AS rule, 'ORDER' AS code, category AS key, '' AS detail FROM v_candidates GROUP BY category HAVING count(*) > 1")
def _(v):
    rows = v("v_candidates").select(F.col("category").alias("group_id"), "id", F.expr("CAST(substr(id, 5) AS INT)").alias("pos"))
    return metrics.dataset_alignment(rows.withColumn("pos", -F.col("pos")), rows)


@query(
    "momentum_score",
    """WITH b AS (SELECT min(growth) AS l1, max(growth) AS h1, min(contributors) AS l2, max(contributors) AS h2, min(stars) AS l3, max(stars) AS h3 FROM v_traction),
    s AS (SELECT competitor_id, CASE WHEN growth IS NULL THEN NULL WHEN h1 = l1 THEN 0.0 ELSE 100.0::DOUBLE * (growth - l1) / (h1 - l1) END AS a, CASE WHEN contributors IS NULL THEN NULL WHEN h2 = l2 THEN 0.0 ELSE 100.0::DOUBLE * (contributors - l2) / (h2 - l2) END AS b, CASE WHEN h3 = l3 THEN 0.0 ELSE 100.0::DOUBLE * (stars - l3) / (h3 - l3) END AS c FROM v_traction CROSS JOIN b)
    SELECT competitor_id, CASE WHEN (a IS NULL)::INT + (b IS NULL)::INT <= 1 THEN 'SCORED' ELSE 'INSUFFICIENT_DATA' END AS status,
      CASE WHEN (a IS NULL)::INT + (b IS NULL)::INT <= 1 THEN round((coalesce(a, 0) * 0.35::DOUBLE + coalesce(b, 0) * 0.25::DOUBLE + c * 0.2::DOUBLE) / (CASE WHEN a IS NULL THEN 0 ELSE 0.35::DOUBLE END + CASE WHEN b IS NULL THEN 0 ELSE 0.25::DOUBLE END + 0.2::DOUBLE), 4) END AS momentum FROM s""",
)
def _(v):
    return metrics.momentum_score(v("v_traction"), "competitor_id", {"growth": 0.35, "contributors": 0.25, "stars": 0.2})


@query("temporal_metric_check", "SELECT 'temporal_metric' AS rule, 'OBSERVED_AT' AS code, competitor_id || '/growth' AS key, '' AS detail FROM v_traction WHERE growth IS NULL")
def _(v):
    rows = v("v_traction").withColumn("at", F.when(F.col("growth").isNotNull(), F.lit("2024-01-31")))
    long = rows.select("competitor_id", F.explode(F.array(F.lit("growth"), F.lit("stars"))).alias("metric"), F.col("at").alias("observed_at"))
    return metrics.temporal_metric_check(long)


@query("chart_value_check", "SELECT 'chart_value' AS rule, 'VALUE' AS code, competitor_id || '/' || dimension_id AS key, '' AS detail FROM v_judgments WHERE score IS NULL UNION ALL SELECT 'chart_value', 'DUPLICATE_EVIDENCE', competitor_id || '/' || dimension_id, '' FROM v_judgments WHERE dimension_order = 0")
def _(v):
    rows = v("v_judgments").withColumn("refs", F.array("dimension_id", F.when(F.col("dimension_order") == 0, F.col("dimension_id")).otherwise(F.col("competitor_id"))))
    return metrics.chart_value_check(rows, F.concat_ws("/", "competitor_id", "dimension_id"), "score", "refs")


@query("mart_matrix", "SELECT competitor_id, dimension_id, score FROM v_judgments WHERE score IS NOT NULL")
def _(v):
    return metrics.mart(v("v_judgments").where("score IS NOT NULL"), ["competitor_id", "dimension_id"], ["score"])[0]


@query("mart_scatter", "SELECT competitor_id, points AS x, coverage AS y FROM v_scores")
def _(v):
    return metrics.mart(v("v_scores").select("competitor_id", F.col("points").alias("x"), F.col("coverage").alias("y")), ["competitor_id"], ["x", "y"])[0]


@query("mart_bar", "SELECT CAST(l_suppkey AS STRING) AS category, coalesce(l_returnflag, '') AS series, count(*) AS value FROM lineitem GROUP BY 1, 2")
def _(v):
    rows = v("lineitem").groupBy(F.col("l_suppkey").cast("string").alias("category"), F.coalesce("l_returnflag", F.lit("")).alias("series")).agg(F.count("*").alias("value"))
    return metrics.mart(rows, ["category", "series"], ["value"])[0]


@query("mart_line", "SELECT event AS series, ts AS at, count(*) AS value FROM v_events GROUP BY 1, 2")
def _(v):
    rows = v("v_events").groupBy(F.col("event").alias("series"), F.col("ts").alias("at")).agg(F.count("*").alias("value"))
    return metrics.mart(rows, ["series", "at"], ["value"])[0]


@query("mart_distribution", "SELECT CAST(floor(value / 10) AS BIGINT) AS bucket, count(*) AS n FROM v_events GROUP BY 1")
def _(v):
    rows = v("v_events").groupBy(F.floor(F.col("value") / 10).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
    return metrics.mart(rows, ["bucket"], ["n"])[0]


@query("mart_catalog_check", "SELECT 'chart_catalog' AS rule, CASE WHEN l_returnflag = 'N' THEN 'UNKNOWN_CHART' WHEN l_linestatus <> 'F' THEN 'KIND' ELSE 'REPEATED' END AS code, l_returnflag || '/' || l_linestatus AS key, '' AS detail FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING l_returnflag = 'N' OR l_linestatus <> 'F' OR count(*) > 1")
def _(v):
    known = v.spark.createDataFrame([("R", "F"), ("A", "F")], "chart_id string, kind string")
    return metrics.mart_catalog_check(v("lineitem").select(F.col("l_returnflag").alias("chart_id"), F.col("l_linestatus").alias("kind")), known)


@query("time_index", "SELECT event_id, dense_rank() OVER (ORDER BY ts) AS time_index FROM v_events")
def _(v):
    return metrics.time_index(v("v_events"), "ts").select("event_id", "time_index")


@query("chart_row_order", "SELECT competitor_id, dimension_id, row_number() OVER (ORDER BY competitor_id, dimension_id) AS pos FROM v_judgments")
def _(v):
    return metrics.row_order(v("v_judgments"), "competitor_id", "dimension_id").select("competitor_id", "dimension_id", "pos")


@query("score_hash", "SELECT competitor_id, 'CL-COMP-' || upper(substr(SHA256(competitor_id || '|' || dimension_id), 1, 16)) AS claim_id FROM v_judgments")
def _(v):
    return v("v_judgments").select("competitor_id", core.claim_id(F.col("competitor_id"), F.col("dimension_id")).alias("claim_id"))
