"""Research: verification, gaps, readiness, questions and rule-based checks of proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import documents
from factloom.operators.violations import report


def section_verification(issues: DataFrame) -> DataFrame:
    """FAIL on a critical issue, PARTIAL on another one, else PASS, for each run and section."""
    rows = issues.groupBy("run_id", "section").agg(F.bool_or("critical").alias("c"), F.bool_or("issue").alias("i"))
    return rows.select("run_id", "section", F.when(F.col("c"), "FAIL").when(F.col("i"), "PARTIAL").otherwise("PASS").alias("result"))


def overall_verification(sections: DataFrame) -> DataFrame:
    fail, good = F.bool_or(F.col("result") == "FAIL"), F.bool_and(F.col("result") == "PASS")
    return sections.groupBy("run_id").agg(F.when(fail, "FAIL").when(good, "PASS").otherwise("PARTIAL").alias("result"))


def readiness(issues: DataFrame) -> DataFrame:
    """Blocked by critical issues; open other ones must be waived."""
    rows = issues.groupBy("run_id").agg(F.bool_or("critical").alias("blocked"), F.bool_or(F.col("issue") & ~F.col("waived")).alias("open"), F.bool_or(F.col("issue") & F.col("waived")).alias("risk"))
    return rows.select("run_id", F.when(F.col("blocked") | F.col("open"), "NOT_READY").when(F.col("risk"), "READY_WITH_ACCEPTED_RISKS").otherwise("READY_FOR_BUILD").alias("readiness"))


def gap_issue_coverage(gaps: DataFrame, issues: DataFrame) -> DataFrame:
    """Every issue (run_id, code) has exactly one gap, and every gap an issue."""
    have = gaps.groupBy("run_id", "code").agg(F.count("*").alias("n"))
    told = issues.select("run_id", "code").distinct().withColumn("here", F.lit(True)).join(have, ["run_id", "code"], "full_outer")
    code = F.when(F.col("here").isNull(), "NO_ISSUE").when(F.col("n").isNull(), "NOT_COVERED").when(F.col("n") > 1, "COVERED_TWICE")
    return report(told.where(code.isNotNull()), "gap_coverage", code, F.concat_ws("/", "run_id", F.col("code")))


def gap_branches(gaps: DataFrame, branches: DataFrame) -> DataFrame:
    """Gaps (run_id, code, branch) that target no enabled branch of their run (run_id, branch, enabled), and runs
    whose gaps retry every enabled branch."""
    enabled = branches.where("enabled").select("run_id", "branch").distinct()
    off = gaps.join(enabled, ["run_id", "branch"], "left_anti")
    retried = enabled.join(gaps.select("run_id", "branch", F.lit(True).alias("retried")).distinct(), ["run_id", "branch"], "left")
    broad = retried.groupBy("run_id").agg(F.bool_and(F.coalesce("retried", F.lit(False))).alias("all")).where("all")
    return report(off, "gap_branch", "NOT_ENABLED", F.concat_ws("/", "run_id", "code"), F.col("branch")).union(report(broad, "gap_branch", "ALL_BRANCHES", F.col("run_id")))


def evidence_requirements(counts: DataFrame, required: DataFrame) -> DataFrame:
    """Counts (key, name, n) below what a contract asks for (key, name, need). A need of `N/A` asks for nothing,
    one that is no whole number is INVALID; a count that is missing is 0."""
    told = required.where("need <> 'N/A'").join(counts, ["key", "name"], "left").withColumn("least", F.col("need").try_cast("long"))
    code = F.when(F.col("least").isNull(), "INVALID").when(F.coalesce("n", F.lit(0)) < F.col("least"), "TOO_FEW")
    return report(told.where(code.isNotNull()), "evidence_threshold", code, F.col("key"), F.col("name"))


def recommended_check(top: DataFrame, recommended: DataFrame, by: str) -> DataFrame:
    """Groups (by, id) whose recommended id is none of their listed opportunities."""
    lost = recommended.join(top.select(by, "id"), [by, "id"], "left_anti")
    return report(lost, "opportunity", "NOT_LISTED", F.col(by), F.col("id"))


def evidence_thresholds(counts: DataFrame, required: dict[str, int], key: str) -> DataFrame:
    """Counts below the contract's required ones."""
    short = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c), F.lit(0)) < n, c) for c, n in required.items())))
    return report(counts.select(key, F.explode(short).alias("c")), "evidence_threshold", "TOO_FEW", F.col(key), F.col("c"))


def pain_summary(items: DataFrame) -> DataFrame:
    """Counts and mean severity by pain; a sample, not an incidence."""
    return items.groupBy("pain").agg(F.count("*").alias("items"), F.round(F.avg("severity"), 4).alias("severity"), F.count_distinct("source").alias("sources"))


def license_reuse(repositories: DataFrame) -> DataFrame:
    """(license, repositories, stale, components): how often components are reused under each licence."""
    return repositories.groupBy(F.coalesce("license", F.lit("none")).alias("license")).agg(F.count("*").alias("repositories"), F.count_if("stale").alias("stale"), F.sum("components").alias("components"))


def question_numbering(questions: DataFrame) -> DataFrame:
    """Distinct questions of each bucket, numbered in first-seen order, with the number of their origins."""
    first = questions.groupBy("attempt", "bucket", "question").agg(F.min("seq").alias("first"), F.count("*").alias("origins"))
    n = F.row_number().over(Window.partitionBy("attempt", "bucket").orderBy("first", "question"))
    return first.withColumn("code", F.format_string("RQ-%d-%02d", "bucket", n))


def question_origins(questions: DataFrame, origins: DataFrame, key: list[str]) -> DataFrame:
    """Questions without an origin, and origins that no question maps."""
    name = F.concat_ws("/", *(F.col(c).cast("string") for c in key))
    a = questions.select(*key).distinct().join(origins.select(*key).distinct(), key, "left_anti")
    b = origins.select(*key).distinct().join(questions.select(*key).distinct(), key, "left_anti")
    return report(a, "question_origin", "NO_ORIGIN", name).union(report(b, "question_origin", "NOT_MAPPED", name))


def next_gap(assumptions: DataFrame, group: str) -> DataFrame:
    """The lowest-id critical assumption of each group, else the first one not HIGH."""
    best = F.min_by("id", F.struct(F.when(F.col("critical"), 0).otherwise(1), "pos", "id"))
    return assumptions.where("critical OR clarity <> 'HIGH'").groupBy(group).agg(best.alias("id"))


def top_k(rows: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark keeps only k rows a group before it shuffles."""
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("pos") <= k)


def field_whitelist(df: DataFrame, key: Column, body: str, allowed: list[str], reserved: list[str]) -> DataFrame:
    """JSON objects may hold only the allowed keys, and no reserved key at any depth, however it is written."""
    keys = F.json_object_keys(body)
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, allowed))), lambda k: F.struct(F.lit("UNKNOWN_KEY").alias("code"), k.alias("k")))
    deep = documents.json_names(F.col(body))
    hit = F.transform(F.array_intersect(deep, F.array(*map(F.lit, reserved))), lambda k: F.struct(F.lit("RESERVED_KEY").alias("code"), k.alias("k")))
    bad = df.select(key.cast("string").alias("key"), F.explode(F.concat(F.coalesce(extra, F.array().cast("array<struct<code:string,k:string>>")), hit)).alias("v"))
    return report(bad, "field_whitelist", F.col("v.code"), F.col("key"), F.col("v.k"))


def condition_eval(conditions: DataFrame, states: DataFrame) -> DataFrame:
    """Three-valued value of (condition, kind any_of or all, node) terms; states: node, value, resolved.

    An unset value of a resolved node is false, of another one unknown.
    """
    told = conditions.join(states, "node", "left")
    value = F.coalesce(F.col("value"), F.when(F.col("resolved"), False))
    rows = told.withColumn("v", value).groupBy("condition", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("v")).alias("t"), F.count_if(~F.col("v")).alias("f"))
    any_of = F.when(F.col("t") > 0, True).when(F.col("f") == F.col("n"), False)
    every = F.when(F.col("f") > 0, False).when(F.col("t") == F.col("n"), True)
    return rows.select("condition", "kind", F.when(F.col("kind") == "any_of", any_of).otherwise(every).alias("value"))


def required_charts(charts: DataFrame, required: list[str], one_of: list[str]) -> DataFrame:
    """Groups (group_id, chart) that lack a required chart or have not exactly one of a choice."""
    have = charts.groupBy("group_id").agg(F.collect_set("chart").alias("have"))
    missing = F.transform(F.array_except(F.array(*map(F.lit, required)), "have"), lambda c: F.concat(F.lit("MISSING:"), c))
    choice = F.when(F.size(F.array_intersect("have", F.array(*map(F.lit, one_of)))) != 1, F.array(F.lit("CHOICE:"))).otherwise(F.array().cast("array<string>"))
    bad = have.select("group_id", F.explode(F.concat(missing, choice)).alias("c"))
    return report(bad, "required_charts", F.substring_index("c", ":", 1), F.col("group_id"), F.substring_index("c", ":", -1))


def gate_actions(gates: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Gates (gate_id, kind, actions, recommendation): the actions are those of the kind, the advice is one of them."""
    table = F.create_map(*(x for k, v in allowed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    want = F.try_element_at(table, F.col("kind"))
    differs = (F.size(F.array_except("actions", want)) > 0) | (F.size(F.array_except(want, "actions")) > 0)
    code = F.when(want.isNull(), "KIND").when(differs, "ACTIONS").when(~F.array_contains("actions", F.col("recommendation")), "RECOMMENDATION")
    return report(gates.where(code.isNotNull()), "gate", code, F.col("gate_id"))


def report_lineage(reports: DataFrame) -> DataFrame:
    """A successor (report_id, version n + 1) points at version n and uses another path."""
    base = reports.select("report_id", (F.col("version") + 1).alias("version"), F.col("version").alias("want"), F.col("path").alias("old_path"))
    told = reports.join(base, ["report_id", "version"], "left").where("version > 1")
    code = F.when(F.col("want").isNull(), "NO_BASE").when(~F.col("base_version").eqNullSafe(F.col("want")), "BASE").when(F.col("path") == F.col("old_path"), "PATH")
    return report(told.where(code.isNotNull()), "report_lineage", code, F.concat_ws("@", F.col("report_id").cast("string"), F.col("version").cast("string")))


def citation_metadata(sources: DataFrame) -> DataFrame:
    """Cited sources need a web URL, a publisher and a title."""
    codes = F.array_compact(F.array(F.when(F.coalesce(~F.col("url").rlike("^https?://"), F.lit(True)), "URL"), F.when(F.coalesce(F.col("publisher"), F.lit("")) == "", "PUBLISHER"), F.when(F.coalesce(F.col("title"), F.lit("")) == "", "TITLE")))
    return report(sources.select("id", F.explode(codes).alias("c")), "citation_metadata", F.col("c"), F.col("id"))
