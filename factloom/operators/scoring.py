"""Scores from judgments: weights, coverage, ranks, and audits of stored scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.violations import report
from factloom.sources.scratch import small_side

# fixed values
WEIGHT = "0.2"
LEAST_COVERAGE = "0.8"
BANDS = [(1, 2, "very_weak"), (3, 4, "weak"), (5, 6, "moderate"), (7, 8, "strong"), (9, 10, "exceptional")]

def _scored() -> Column:
    return F.col("judgment_status") == "SCORED"


def _decimal(x: Column | str) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(9,6)")


def with_weight(judgments: DataFrame) -> DataFrame:
    return judgments if "weight" in judgments.columns else judgments.withColumn("weight", _decimal(WEIGHT))


def score_status(coverage: Column) -> Column:
    return F.when(coverage >= _decimal("1"), "COMPLETE").when(coverage >= _decimal(LEAST_COVERAGE), "PARTIAL").otherwise("NOT_PERFORMED")


def weighted_score(judgments: DataFrame) -> DataFrame:
    """(competitor_id, coverage, status, final_score): the weighted mean, where enough weight is covered."""
    rows = with_weight(judgments).groupBy("competitor_id").agg(
        F.sum("weight").alias("total"),
        F.coalesce(F.sum(F.when(_scored(), F.col("weight"))), _decimal("0")).alias("covered"),
        F.sum(F.when(_scored(), F.col("weight") * F.col("score").cast("decimal(9,0)"))).alias("points"),
    )
    coverage = _decimal(F.bround(F.col("covered") / F.col("total"), 6))
    rows = rows.withColumn("coverage", coverage).withColumn("status", score_status(F.col("coverage")))
    final = F.when(F.col("status") != "NOT_PERFORMED", _decimal(F.bround(F.col("points") / F.col("covered"), 6)))
    return rows.select("competitor_id", "coverage", "status", final.alias("final_score"))


def effective_weights(judgments: DataFrame) -> DataFrame:
    """Weights of the scored dimensions, scaled to sum 1 per candidate."""
    rows = with_weight(judgments).where(_scored())
    covered = F.sum("weight").over(Window.partitionBy("competitor_id"))
    return rows.select("competitor_id", "dimension_order", "dimension_id", _decimal(F.bround(F.col("weight") / covered, 6)).alias("effective_weight"))


def missing_dimensions(judgments: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Per candidate the rubric dimensions without a score, in rubric order, as an array."""
    grid = judgments.select("competitor_id").distinct().crossJoin(small_side(dimensions.select("dimension_id", "dimension_order")))
    gaps = grid.join(judgments.where(_scored()).select("competitor_id", "dimension_id"), ["competitor_id", "dimension_id"], "left_anti")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("dimension_order", "dimension_id"))), lambda x: x["dimension_id"])
    return gaps.groupBy("competitor_id").agg(listed.alias("missing"))


def competition_rank(scores: DataFrame) -> DataFrame:
    """Shared ranks by score, then coverage; the next rank skips. Rows without a score are not ranked."""
    ranked = scores.where(F.col("final_score").isNotNull())
    order = Window.orderBy(F.col("final_score").desc(), F.col("coverage").desc())
    # ranks come from the distinct (score, coverage) pairs: few rows, however many candidates
    pairs = ranked.groupBy("final_score", "coverage").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = pairs.withColumn("rank", (before + 1).cast("int"))
    told = scores.join(pairs, ["final_score", "coverage"], "left")
    return told.withColumn("tie_status", F.when(F.col("rank").isNull(), "NOT_RANKED").when(F.col("n") > 1, "TIED").otherwise("UNIQUE")).drop("n")


def rubric_check(dimensions: DataFrame) -> DataFrame:
    """Five dimensions, no repeats, weights of 0.2 that sum to 1, at least one piece of evidence."""
    rows = dimensions.groupBy("rubric_ref").agg(
        F.count("*").alias("n"), F.count_distinct("dimension_id").alias("d"), F.sum("weight").alias("w"), F.min("weight").alias("lo"), F.max("weight").alias("hi"), F.min("minimum_evidence_count").alias("e")
    )
    codes = F.array_compact(
        F.array(
            F.when(F.col("n") != 5, "DIMENSION_COUNT"), F.when(F.col("d") < F.col("n"), "DUPLICATE_DIMENSION"), F.when(F.col("w") != 1, "WEIGHT_SUM"), F.when((F.col("lo") != F.lit("0.2").cast("decimal(9,6)")) | (F.col("hi") != F.lit("0.2").cast("decimal(9,6)")), "WEIGHT"), F.when(F.col("e") < 1, "MINIMUM_EVIDENCE")
        )
    )
    return report(rows.select("rubric_ref", F.explode(codes).alias("code")), "rubric", F.col("code"), F.col("rubric_ref"))


def rubric_bands_check(bands: DataFrame) -> DataFrame:
    """Rubrics (rubric_ref, lo, hi) whose bands are not 1-2, 3-4, ..., 9-10, each once."""
    pair = (F.col("lo") % 2 == 1) & (F.col("hi") == F.col("lo") + 1) & F.col("lo").between(1, 9)
    told = bands.groupBy("rubric_ref").agg(F.count("*").alias("n"), F.count_distinct("lo").alias("d"), F.count_if(pair).alias("fit"))
    return report(told.where("n <> 5 OR d <> 5 OR fit <> 5"), "rubric", "BANDS", F.col("rubric_ref"))


def repeated_refs(judgments: DataFrame) -> DataFrame:
    """Judgment and verification refs that more than one record uses."""
    kinds = F.stack(F.lit(2), F.lit("judgment"), F.col("judgment_ref"), F.lit("verification"), F.col("verification_ref")).alias("kind", "ref")
    twice = judgments.select(kinds).where("ref IS NOT NULL").groupBy("kind", "ref").count().where("count > 1")
    return report(twice, "judgments", "DUPLICATE_REF", F.concat_ws("/", "kind", F.col("ref").cast("string")), F.col("count"))


def score_parts_audit(judgments: DataFrame, dimensions: DataFrame, missing: DataFrame, weights: DataFrame) -> DataFrame:
    """Stored missing dimensions (competitor_id, dimension_id) and effective weights (with effective_weight)
    that are not those of the judgments, dimension by dimension."""
    keys = ["competitor_id", "dimension_id"]
    fresh = effective_weights(judgments).select(*keys, F.col("effective_weight").alias("now"))
    grid = judgments.select("competitor_id").distinct().crossJoin(small_side(dimensions.select("dimension_id").distinct()))
    open_now = grid.join(judgments.where(_scored()).select(*keys), keys, "left_anti").withColumn("l", F.lit(True))
    told = open_now.join(missing.select(*keys).distinct().withColumn("r", F.lit(True)), keys, "full_outer").where("l IS NULL OR r IS NULL")
    key = F.concat_ws("/", *keys)
    found = report(told, "score_audit", F.when(F.col("l").isNull(), "NOT_MISSING").otherwise("MISSING_UNSTATED"), key)
    both = fresh.join(weights.select(*keys, "effective_weight"), keys, "full_outer").where(~F.col("now").eqNullSafe(F.col("effective_weight")))
    return found.union(report(both, "score_audit", "WEIGHT", key, F.col("now").cast("decimal(9,6)")))


def score_status_check(judgments: DataFrame, key: Column) -> DataFrame:
    """SCORED needs a whole score from 1 to 10; UNRESOLVED must have none."""
    bad = F.when(_scored() & (F.col("score").isNull() | ~F.col("score").between(1, 10)), "SCORE").when(~_scored() & F.col("score").isNotNull(), "UNRESOLVED_SCORE")
    return report(judgments.where(bad.isNotNull()), "judgment_score", bad, key, F.coalesce(F.col("score").cast("string"), F.lit("")))


def duplicate_judgments(judgments: DataFrame, ranked: DataFrame) -> DataFrame:
    """Repeated dimensions of a candidate, and candidates that the ranking does not have."""
    twice = judgments.groupBy("competitor_id", "dimension_id").count().where("count > 1")
    outside = judgments.select("competitor_id").distinct().join(ranked.select(F.col("id").alias("competitor_id")), "competitor_id", "left_anti")
    key = F.concat_ws("/", "competitor_id", "dimension_id")
    return report(twice, "judgments", "DUPLICATE", key, F.col("count")).union(report(outside, "judgments", "OUTSIDE_RANKING", F.col("competitor_id")))


def score_audit(judgments: DataFrame, stored: DataFrame) -> DataFrame:
    """Recompute stored scores (competitor_id, coverage, status, final_score) and report every difference."""
    fresh = weighted_score(judgments).select("competitor_id", F.col("coverage").alias("c"), F.col("status").alias("s"), F.col("final_score").alias("f"))
    told = fresh.join(stored, "competitor_id", "full_outer")
    codes = F.array_compact(
        F.array(
            F.when(F.col("s").isNull(), "UNKNOWN_CANDIDATE"),
            F.when(F.col("status").isNull(), "NOT_STORED"),
            F.when(F.col("s").isNotNull() & F.col("status").isNotNull() & (F.col("s") != F.col("status")), "STATUS"),
            F.when(F.col("s").isNotNull() & F.col("status").isNotNull() & ~F.col("f").eqNullSafe(F.col("final_score")), "FINAL_SCORE"),
            F.when(F.col("c") != F.col("coverage"), "COVERAGE"),
        )
    )
    return report(told.select("competitor_id", F.explode(codes).alias("code")), "score_audit", F.col("code"), F.col("competitor_id"))


def score_band(scores: DataFrame, score: str = "score") -> DataFrame:
    """The label of the rubric band a score lies in."""
    bands = scores.sparkSession.createDataFrame(BANDS, "lo int, hi int, band string")
    return scores.join(F.broadcast(bands), F.col(score).between(F.col("lo"), F.col("hi")), "left").drop("lo", "hi")


def verification_binding(judgments: DataFrame, verifications: DataFrame) -> DataFrame:
    """Each judgment (judgment_ref) has exactly one accepted verification, and each that has a judgment."""
    accepted = verifications.where("result = 'ACCEPT'").groupBy("judgment_ref").agg(F.count("*").alias("n"))
    told = judgments.select("judgment_ref").withColumn("here", F.lit(True)).join(accepted, "judgment_ref", "full_outer")
    code = F.when(F.col("here").isNull(), "UNKNOWN_JUDGMENT").when(F.col("n").isNull(), "NOT_VERIFIED").when(F.col("n") > 1, "SHARED")
    return report(told.where(code.isNotNull()), "verification_binding", code, F.col("judgment_ref"))


def claim_category_scope(judgment_claims: DataFrame, claims: DataFrame, scope: DataFrame) -> DataFrame:
    """Claims (dimension_id, claim_id) whose category the dimension does not allow; scope: dimension_id, category."""
    told = judgment_claims.join(claims.select(F.col("id").alias("claim_id"), "category"), "claim_id")
    bad = told.join(scope, ["dimension_id", "category"], "left_anti")
    return report(bad, "claim_scope", "CATEGORY", F.concat_ws("/", "dimension_id", "claim_id"), F.col("category"))


def judgment_links(links: DataFrame, claim_evidence: DataFrame) -> DataFrame:
    """Judgment references (judgment_ref, claim_id, evidence_id) whose evidence is not the claim's."""
    bad = links.join(claim_evidence.select("claim_id", F.col("id").alias("evidence_id")), ["claim_id", "evidence_id"], "left_anti")
    return report(bad, "judgment_links", "EVIDENCE_NOT_OF_CLAIM", F.concat_ws("/", "judgment_ref", "claim_id"), F.col("evidence_id"))


def collection_order(scores: DataFrame) -> DataFrame:
    """Collection order: score, coverage, id; rows without a score last. `stored_pos` that differ are reported."""
    order = Window.orderBy(F.col("final_score").desc_nulls_last(), F.when(F.col("final_score").isNotNull(), F.col("coverage")).desc_nulls_last(), "competitor_id")
    told = scores.withColumn("pos", F.row_number().over(order))
    return report(told.where("pos <> stored_pos"), "collection_order", "POSITION", F.col("competitor_id"), F.col("pos"))


def min_max_scale(rows: DataFrame, value: str, by: list[str], zero: bool = False) -> DataFrame:
    """`scaled` from 0 to 1 over the group's domain; a domain of one value is padded by max(10 %, 1)."""
    lo, hi = F.min(value).cast("double"), F.max(value).cast("double")
    if zero:
        lo, hi = F.least(lo, F.lit(0.0)), F.greatest(hi, F.lit(0.0))
    domains = rows.groupBy(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by))).agg(lo.alias("_lo"), hi.alias("_hi"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    out = rows.join(domains, same).drop(*(f"_by{i}" for i in range(len(by)))) if by else rows.join(domains)
    pad = F.when(F.col("_lo") == F.col("_hi"), F.greatest(F.abs("_hi") * 0.1, F.lit(1.0))).otherwise(0.0)
    out = out.withColumn("_pad", pad)
    low, high = F.col("_lo") - F.col("_pad"), F.col("_hi") + F.col("_pad")
    return out.withColumn("scaled", (F.col(value) - low) / (high - low)).drop("_lo", "_hi", "_pad")
