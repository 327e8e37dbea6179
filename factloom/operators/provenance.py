"""Claims, evidence and facts: reference integrity, closure and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators.metrics import row_order
from factloom.operators.sets import unequal_sets
from factloom.operators.violations import report


def dangling(edges: DataFrame, targets: DataFrame, rule: str) -> DataFrame:
    """Edges (kind, from, to, target_kind) whose (target_kind, to) does not exist: one anti join for all kinds."""
    bad = edges.join(targets.select("target_kind", "to"), ["target_kind", "to"], "left_anti")
    return report(bad, rule, F.col("kind"), F.col("from"), F.col("to"))


def edge(df: DataFrame, kind: str, source: str, target: str, target_kind: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).select(F.lit(kind).alias("kind"), F.col(source).cast("string").alias("from"), F.col(target).cast("string").alias("to"), F.lit(target_kind).alias("target_kind"))


def target(df: DataFrame, kind: str, key: str) -> DataFrame:
    return df.select(F.lit(kind).alias("target_kind"), F.col(key).cast("string").alias("to")).distinct()


def fanin_completeness(selected: DataFrame, profiles: DataFrame, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """Selected ids with a verified profile, and a violation for each without one."""
    done = profiles.where("verified").select(key).distinct()
    return selected.join(done, key, "left_semi"), report(selected.join(done, key, "left_anti"), "fanin", "PROFILE_MISSING", F.col(key))


def identity_match(profiles: DataFrame, candidates: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Profiles that differ from their candidate in a field."""
    told = profiles.alias("p").join(candidates.alias("c"), F.col(f"p.{key}") == F.col(f"c.{key}"))
    diff = F.array_compact(F.array(*(F.when(~F.col(f"p.{f}").eqNullSafe(F.col(f"c.{f}")), f) for f in fields)))
    return report(told.select(F.col(f"p.{key}").alias("k"), F.explode(diff).alias("f")), "identity", "MISMATCH", F.col("k"), F.col("f"))


def observation_claim(observations: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bind each observation (obs_id, text) to exactly one usable claim (id, statement, status) by its text."""
    usable = claims.where(F.col("status").isin("VALIDATED", "PARTIALLY_VALIDATED"))
    by_text = usable.groupBy("statement").agg(F.count("*").alias("n"), F.min("id").alias("claim_id"))
    told = observations.join(by_text, observations.text == by_text.statement, "left")
    bad = told.where(F.coalesce("n", F.lit(0)) != 1)
    return told.where("n = 1").select("obs_id", "claim_id"), report(bad, "observation_claim", F.when(F.col("n").isNull(), "NO_CLAIM").otherwise("AMBIGUOUS"), F.col("obs_id"))


def fact_closure(facts: DataFrame, evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """(fact_id, evidence_refs, source_refs): sorted evidence and known sources behind each fact's claims."""
    told = facts.select("fact_id", "claim_id").join(evidence.select("claim_id", F.col("id").alias("evidence_id"), "source_id"), "claim_id")
    told = told.join(sources.select(F.col("id").alias("source_id")), "source_id")
    return told.groupBy("fact_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("evidence_refs"), F.sort_array(F.collect_set("source_id")).alias("source_refs"))


def stale_facts(facts: DataFrame) -> DataFrame:
    """Facts whose stored hash is not the hash of their content."""
    return report(facts.where("content_hash <> bound_hash"), "fact_binding", "CONTENT_HASH", F.col("fact_id"), F.col("bound_hash"))


def set_equality(left: DataFrame, right: DataFrame, rule: str) -> DataFrame:
    """Members (key, member) that only one of two sets per key has; repeats and nulls count as in EXCEPT.

    The rows of both sides meet in one aggregate, so each is shuffled once and none is sorted.
    """
    sides = left.select("key", "member", F.lit(1).alias("side")).union(right.select("key", "member", F.lit(2)))
    told = sides.groupBy("key", "member").agg(F.bit_or("side").alias("sides")).where("sides < 3")
    return report(told, rule, F.when(F.col("sides") == 1, "MISSING").otherwise("EXTRA"), F.col("key"), F.col("member"))


def claims_reachable(chart_evidence: DataFrame, evidence: DataFrame, declared: DataFrame) -> DataFrame:
    """Claims reached from a chart's evidence (key, evidence_id) must equal the declared ones (key, member)."""
    reached = chart_evidence.join(evidence.select(F.col("id").alias("evidence_id"), F.col("claim_id").alias("member")), "evidence_id")
    return set_equality(declared, reached, "chart_claims")


def citation_closure(facts: DataFrame, by: str) -> DataFrame:
    """Sorted distinct claim, evidence and source ids per group of facts."""
    lists = {c: F.sort_array(F.collect_set(c)) for c in ("claim_id", "evidence_id", "source_id")}
    return facts.groupBy(by).agg(*(x.alias(c + "s") for c, x in lists.items()))


def build_evidence(observations: DataFrame, sources: DataFrame, analysis: str) -> DataFrame:
    """Evidence rows of (run_id, node, statement, source_id) observations."""
    claim = core.claim_id(F.col("run_id"), F.col("node"), F.col("statement"))
    rows = observations.select("run_id", "node", "statement", "source_id").distinct().withColumn("claim_id", claim).join(sources.select(F.col("id").alias("source_id"), "source_tier", "freshness_status"), "source_id")
    return rows.select(
        core.evidence_id(F.col("claim_id"), F.col("source_id")).alias("id"),
        "claim_id",
        "source_id",
        core.evidence_type(F.lit(analysis)).alias("evidence_type"),
        F.lit("supports").alias("direction"),
        F.lit("high").alias("relevance"),
        core.reliability(F.col("source_tier")).alias("reliability"),
        core.freshness_label(F.col("freshness_status")).alias("freshness"),
    )


def build_claims(observations: DataFrame, sources: DataFrame) -> DataFrame:
    """Claim rows of (run_id, node, statement, source_id) observations, one for each statement of a node.

    VALIDATED with MEDIUM confidence if all its sources are fresh and one is of tier 1, else
    PARTIALLY_VALIDATED with LOW. Its evidence is what build_evidence gives under its id; sources that are
    not known make no evidence, and a statement with none makes no claim.
    """
    rows = observations.select("run_id", "node", "statement", "source_id").distinct().join(sources.select(F.col("id").alias("source_id"), "source_tier", "freshness_status"), "source_id")
    fresh = F.bool_and(F.coalesce(F.col("freshness_status") == "FRESH", F.lit(False)))
    told = rows.groupBy("run_id", "node", "statement").agg((fresh & F.bool_or(F.coalesce(F.col("source_tier") == 1, F.lit(False)))).alias("ok"), F.count("*").alias("n_evidence"))
    return told.select(
        core.claim_id(F.col("run_id"), F.col("node"), F.col("statement")).alias("id"),
        "statement",
        F.lit("competitor").alias("category"),
        F.when(F.col("ok"), "VALIDATED").otherwise("PARTIALLY_VALIDATED").alias("status"),
        F.when(F.col("ok"), "MEDIUM").otherwise("LOW").alias("confidence"),
        "n_evidence",
    )


def set_differences(left: DataFrame, right: DataFrame, rule: str) -> DataFrame:
    """set_equality, which looks only into the keys whose sets differ."""
    keys = unequal_sets(left, right)
    return set_equality(left.join(keys, "key", "left_semi"), right.join(keys, "key", "left_semi"), rule)


def publication_union(text_groups: DataFrame, charts: DataFrame) -> DataFrame:
    """Text fact groups followed by one group per chart: (group_id, section, pos), charts in order of type."""
    chart = charts.select(core.chart_group_id(F.col("chart_type")).alias("group_id"), F.lower(core.chart_group_id(F.col("chart_type"))).alias("section"), F.lit(1).alias("part"), F.col("chart_type").alias("order"))
    text = text_groups.select("group_id", F.col("group_id").alias("section"), F.lit(0).alias("part"), F.col("group_id").alias("order"))
    # numbered inside ranges of the order, of which only the counts are summed one after another
    both = text.union(chart).withColumn("range", F.concat(F.col("part").cast("string"), F.coalesce(F.left("order", F.lit(6)), F.lit(""))))
    return row_order(both, "range", "order").withColumn("pos", F.col("pos").cast("int")).drop("part", "order", "range")


def report_rows(facts: DataFrame, evidence: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flat (group_id, fact_id, source_id, source_type) table of intact facts, and violations for the others."""
    good = facts.where("content_hash = bound_hash")
    told = good.select("group_id", "fact_id", "claim_id").join(evidence.select("claim_id", "source_id"), "claim_id").join(sources.select(F.col("id").alias("source_id"), "source_type"), "source_id")
    return told.select("group_id", "fact_id", "source_id", "source_type").distinct(), stale_facts(facts)


def projection_audit(stored: DataFrame, facts: DataFrame, state: Column) -> DataFrame:
    """Stored projections (projection, refs, state_version) whose facts changed, whose refs are not sorted and
    distinct, or whose state lies ahead. The current facts are compared as sets, without a row that holds them."""
    now = facts.select(F.col("projection").alias("key"), F.col("fact_id").alias("member")).join(stored.select(F.col("projection").alias("key")), "key", "left_semi")
    held = stored.select(F.col("projection").alias("key"), F.explode("refs").alias("member"))
    changed = unequal_sets(held, now).select(F.col("key").alias("projection"), F.lit(True).alias("changed"))
    told = stored.join(changed, "projection", "left")
    wrong = F.coalesce("changed", F.lit(False)) | ~F.coalesce(F.col("refs") == F.sort_array(F.array_distinct("refs")), F.lit(False))
    code = F.when(wrong, "INPUT_REFS").when(F.col("state_version") > state, "STATE_AHEAD")
    return report(told.where(code.isNotNull()), "projection", code, F.col("projection"))


def contradiction_rollup(evidence: DataFrame) -> DataFrame:
    counts = {d: F.count_if(F.col("direction") == d) for d in ("supports", "contradicts", "contextual")}
    rows = evidence.groupBy("claim_id").agg(*(c.alias(d) for d, c in counts.items()))
    return rows.withColumn("contested", (F.col("supports") > 0) & (F.col("contradicts") > 0))
