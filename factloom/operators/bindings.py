"""Fact bindings: each ties a value inside a stored document to the claims, evidence and sources behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import core, documents
from factloom.operators.provenance import set_equality
from factloom.operators.violations import report


def binding_id(origin: Column, pointer: Column, content_hash: Column) -> Column:
    """The fact id that follows from what is bound."""
    return core.competitor_fact_id(origin, pointer, content_hash)


def origin_violations(bindings: DataFrame, current: DataFrame, docs: DataFrame) -> DataFrame:
    """Bindings (key, fact_id, origin_artifact_ref, origin_field_pointer, content_hash) that do not hold against
    the current documents.

    Documents (artifact_ref, doc) are shuffled and sorted once, by their ref and together with the current
    ones, and each pointer is walked where it meets its document. Pointer and hash are judged where the origin
    is current, the derived id always. A current document that is missing or no JSON resolves no pointer.
    """
    ref = F.col("artifact_ref").alias("origin_artifact_ref")
    stored = docs.select(ref, "doc", F.lit(False).alias("current")).unionByName(current.select(ref, F.lit(None).cast("string").alias("doc"), F.lit(True).alias("current")))
    # dealt by ref first: an aggregate of texts sorts its rows, and would do so before the shuffle too
    live = stored.repartition("origin_artifact_ref").groupBy("origin_artifact_ref").agg(F.first("doc", ignorenulls=True).alias("doc"), F.bool_or("current").alias("current")).where("current")
    text = documents.value_at(F.col("doc"), F.col("origin_field_pointer"))
    told = bindings.join(live, "origin_artifact_ref", "left").withColumn("now", F.concat(F.lit("sha256:"), core.sha(text))).drop("doc")
    is_current, valid = F.col("current").isNotNull(), documents.pointer_valid(F.col("origin_field_pointer"))
    derived = binding_id(F.col("origin_artifact_ref"), F.col("origin_field_pointer"), F.col("content_hash"))
    broken = [
        (~is_current, "fact_binding_origin", "NOT_CURRENT", F.col("origin_artifact_ref")),
        (is_current & ~valid, "fact_binding_pointer", "INVALID", F.col("origin_field_pointer")),
        (is_current & valid & F.col("now").isNull(), "fact_binding_pointer", "UNRESOLVED", F.col("origin_field_pointer")),
        (is_current & ~F.col("now").eqNullSafe(F.col("content_hash")) & F.col("now").isNotNull(), "fact_binding_hash", "CONTENT", F.col("now")),
        (~F.coalesce(F.col("fact_id") == derived, F.lit(False)), "fact_binding_identity", "DERIVATION", derived),
    ]
    entries = F.array_compact(F.array(*(F.when(bad, F.struct(F.lit(rule).alias("rule"), F.lit(code).alias("code"), detail.alias("detail"))) for bad, rule, code, detail in broken)))
    found = told.select("key", F.explode(entries).alias("v"))
    return found.select("v.rule", "v.code", F.col("key").cast("string").alias("key"), F.col("v.detail").cast("string").alias("detail"))


def closure_violations(links: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """Links (key, kind, ref) of bindings to claims, evidence and sources that are not closed.

    Claims must exist; the evidence must be exactly that of the claims (evidence: id, claim_id, source_id),
    the sources exactly those of the evidence, and known. Row-wise joins, so no group is held in one row; only
    what is reported is made distinct.
    """
    of = {kind: links.where(F.col("kind") == kind).select("key", F.col("ref").alias("member")) for kind in ("claim", "evidence", "source")}
    no_claim = of["claim"].join(claims.select(F.col("id").alias("member")), "member", "left_anti").distinct()
    by_claim = evidence.select(F.col("claim_id").alias("claim"), F.col("id").alias("member"))
    expected = of["claim"].withColumnRenamed("member", "claim").join(by_claim, "claim").select("key", "member")
    by_evidence = evidence.select(F.col("id").alias("evidence"), F.col("source_id").alias("member"))
    expected_sources = of["evidence"].withColumnRenamed("member", "evidence").join(by_evidence, "evidence").select("key", "member")
    no_source = of["source"].join(sources.select(F.col("id").alias("member")), "member", "left_anti").distinct()
    return (
        report(no_claim, "fact_binding_claim_ref", "UNKNOWN_CLAIM", F.col("key"), F.col("member"))
        .union(set_equality(expected, of["evidence"], "fact_binding_evidence_ref"))
        .union(set_equality(expected_sources, of["source"], "fact_binding_source_ref"))
        .union(report(no_source, "fact_binding_source_ref", "UNKNOWN_SOURCE", F.col("key"), F.col("member")))
    )


def binding_audit(bindings: DataFrame, links: DataFrame, current: DataFrame, docs: DataFrame, claims: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """All broken rules of all bindings: origin, pointer, hash, id, and the closure over claims, evidence and sources."""
    return origin_violations(bindings, current, docs).union(closure_violations(links, claims, evidence, sources))
