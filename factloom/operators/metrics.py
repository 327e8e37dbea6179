"""Profiles to metrics: taxonomy, coverage, traction, reviews, pricing, momentum and chart marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators.sets import unequal_sets
from factloom.operators.violations import report
from factloom.sources.scratch import small_side

# fixed values
MOMENTUM_WEIGHTS = {"star_growth_30d": 0.35, "contributor_growth_30d": 0.25, "release_activity_90d": 0.20, "issue_activity_30d": 0.20}
LEAST_METRICS = 2


def feature_taxonomy(labels: DataFrame, order: list[Column]) -> DataFrame:
    """(token, label): distinct trimmed labels without case; the first seen one is shown."""
    rows = labels.withColumn("token", core.normalize_label("label")).where("token <> ''")
    return rows.groupBy("token").agg(F.min_by("label", F.struct(*order)).alias("label"))


def taxonomy_grid(taxonomy: DataFrame, competitors: DataFrame) -> DataFrame:
    """Every label for every candidate: the grid itself is the result. The labels are counted, and sent to the
    tasks of the candidates while they are few."""
    return competitors.crossJoin(small_side(taxonomy))


def feature_coverage(features: DataFrame, grid: DataFrame) -> DataFrame:
    """1.0 for a feature, 0.5 for a workflow step only, 0.0 for neither."""
    value = F.max(F.when(F.col("kind") == "feature", 1.0).when(F.col("kind") == "workflow", 0.5))
    have = features.groupBy("competitor_id", core.normalize_label("label").alias("token")).agg(value.alias("v"))
    return grid.join(have, ["competitor_id", "token"], "left").select("competitor_id", "token", F.coalesce("v", F.lit(0.0)).alias("coverage"))


def pivot_coverage(coverage: DataFrame, tokens: list[str]) -> DataFrame:
    """One column per token; the values are given, so no extra job finds them."""
    return coverage.groupBy("competitor_id").pivot("token", tokens).agg(F.max("coverage"))


def traction_summary(metrics: DataFrame) -> DataFrame:
    """Observed growth, contributors and stars of each candidate, and a limitation where growth is unknown."""
    text = F.format_string("%s: growth=%s; contributors=%s; stars_context=%s.", "competitor_id", *(core.display_value(F.col(c)) for c in ("growth", "contributors", "stars")))
    limit = F.when(F.col("growth").isNull(), F.concat("competitor_id", F.lit(" has no observed growth value.")))
    return metrics.select("competitor_id", text.alias("observation"), limit.alias("limitation"))


def review_counts(metrics: DataFrame) -> DataFrame:
    size = F.col("positive") + F.col("negative")
    limit = F.when(size == 0, F.concat("competitor_id", F.lit(" has no visible feedback sample.")))
    return metrics.select("competitor_id", "positive", "negative", size.alias("sample_size"), limit.alias("limitation"))


def pricing_limits(profiles: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Unknown pricing, license or monetization, and reliance on a stale source."""
    unknown = F.col("pricing").isNull() | F.col("license").isNull() | F.col("monetization").isNull()
    stale = links.join(sources.select(F.col("id").alias("source_id"), "freshness_status"), "source_id").groupBy("competitor_id").agg(F.bool_or(F.col("freshness_status") == "STALE").alias("stale"))
    told = profiles.withColumn("unknown", unknown).join(stale, "competitor_id", "left")
    return told.select("competitor_id", "unknown", F.coalesce("stale", F.lit(False)).alias("stale"))


def normalize_metrics(wide: DataFrame, id_col: str, metrics: list[str]) -> DataFrame:
    """Long (id, metric, value) rows; unknown values stay null."""
    return wide.select(id_col, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(id_col, metrics, "metric", "value")


def dataset_alignment(dataset: DataFrame, selected: DataFrame) -> DataFrame:
    """Groups whose dataset ids are not the selected ids in the same order; both have (group_id, pos, id).

    Ids are numbered in order, and the numbered ids of both sides compared as sets, so no row holds a group.
    """

    def numbered(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("group_id").orderBy("pos", "id"))
        return rows.select(F.col("group_id").alias("key"), F.struct(place.alias("n"), "id").alias("member"))

    return report(unequal_sets(numbered(dataset), numbered(selected)), "dataset_alignment", "ORDER", F.col("key"))


def momentum_score(metrics: DataFrame, id_col: str, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of metrics scaled to 0..100 over all rows, weights renormalised over the known ones."""
    bounds = metrics.agg(*(f(m).alias(f"{n}_{m}") for m in weights for n, f in (("lo", F.min), ("hi", F.max))))
    told = metrics.crossJoin(F.broadcast(bounds))  # one row
    scaled = {m: F.when(F.col(f"hi_{m}") == F.col(f"lo_{m}"), F.when(F.col(m).isNotNull(), 0.0)).otherwise(100.0 * (F.col(m) - F.col(f"lo_{m}")) / (F.col(f"hi_{m}") - F.col(f"lo_{m}"))) for m in weights}
    known = sum((F.col(m).isNotNull().cast("int") for m in weights), F.lit(0))
    weight = sum((F.when(F.col(m).isNotNull(), w).otherwise(0.0) for m, w in weights.items()), F.lit(0.0))
    points = sum((F.coalesce(scaled[m], F.lit(0.0)) * w for m, w in weights.items()), F.lit(0.0))
    enough = known >= LEAST_METRICS
    return told.select(id_col, F.when(enough, "SCORED").otherwise("INSUFFICIENT_DATA").alias("status"), F.when(enough, F.round(points / weight, 4)).alias("momentum"))


def temporal_metric_check(metrics: DataFrame) -> DataFrame:
    """Metrics named after a change over time need a time of observation."""
    bad = metrics.where(core.temporal_name(F.col("metric")) & F.col("observed_at").isNull())
    return report(bad, "temporal_metric", "OBSERVED_AT", F.concat_ws("/", "competitor_id", "metric"))


def chart_value_check(rows: DataFrame, key: Column, value: str, refs: str, at: str | None = None) -> DataFrame:
    """Finite values, non-empty references without repeats, readable times."""
    checks = [
        F.when(F.col(value).isNull() | F.isnan(F.col(value).cast("double")) | (F.abs(F.col(value).cast("double")) == float("inf")), "VALUE"),
        F.when(F.coalesce(F.size(refs), F.lit(0)) < 1, "NO_EVIDENCE"),
        F.when(F.size(F.array_distinct(refs)) < F.size(refs), "DUPLICATE_EVIDENCE"),
    ]
    if at:
        checks.append(F.when(core.to_utc(F.col(at)).isNull(), "TIME"))
    bad = rows.select(key.alias("k"), F.explode(F.array_compact(F.array(*checks))).alias("code"))
    return report(bad, "chart_value", F.col("code"), F.col("k"))


def mart(rows: DataFrame, keys: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    """A chart's rows with unique keys, and a violation for each key that repeats."""
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    twice = report(counted.where("_n > 1").select(*keys).distinct(), "mart_key", "DUPLICATE", F.concat_ws("/", *(F.col(k).cast("string") for k in keys)))
    return counted.where("_n = 1").select(*keys, *values), twice


def mart_values_check(rows: DataFrame, key: str, labels: list[str], counts: list[str]) -> DataFrame:
    """Charts with more than one combination of labels, and rows whose counts are not whole or below zero."""
    found = None
    if labels:
        ends = rows.agg(F.min(F.struct(*labels)).alias("lo"), F.max(F.struct(*labels)).alias("hi")).where("lo <> hi")
        found = report(ends, "mart_labels", "LABELS", F.concat_ws("/", *(F.col(f"lo.{c}") for c in labels)), F.concat_ws("/", *(F.col(f"hi.{c}") for c in labels)))
    if counts:
        bad = F.array_compact(F.array(*(F.when((F.col(c) < 0) | (F.col(c) != F.floor(c)) | F.col(c).isNull(), c) for c in counts)))
        told = report(rows.select(F.col(key).alias("_k"), F.explode(bad).alias("_c")), "mart_count", "COUNT", F.col("_k"), F.col("_c"))
        found = told if found is None else found.union(told)
    return found


def mart_catalog_check(charts: DataFrame, registry: DataFrame) -> DataFrame:
    """Charts (chart_id, kind) that the registry does not have, have another kind, or repeat."""
    known = registry.select("chart_id", F.col("kind").alias("known"))
    told = charts.groupBy("chart_id", "kind").agg(F.count("*").alias("n")).join(known, "chart_id", "left")
    code = F.when(F.col("known").isNull(), "UNKNOWN_CHART").when(F.col("known") != F.col("kind"), "KIND").when(F.col("n") > 1, "REPEATED")
    return report(told.where(code.isNotNull()), "chart_catalog", code, F.concat_ws("/", "chart_id", "kind"))


def time_index(rows: DataFrame, at: str) -> DataFrame:
    """Position of each time on an axis shared by all series: numbered over the distinct times, range by range."""
    times = rows.select(at).distinct()
    days = times.groupBy(F.to_date(at).alias("_day")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("_day", before.alias("_before"))
    local = times.withColumn("_day", F.to_date(at)).withColumn("_at", F.row_number().over(Window.partitionBy("_day").orderBy(at)))
    index = local.join(days, "_day").select(at, (F.col("_before") + F.col("_at")).cast("long").alias("time_index"))
    return rows.join(index, at)


def row_order(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Position `pos` of each row by `group`, then `order`: rows are numbered inside their group, and only the
    groups' counts are summed in order."""
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    told = rows.withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return told.join(counts.select(group, before.alias("_before")), group).withColumn("pos", (F.col("_before") + F.col("_at")).cast("long")).drop("_at", "_before")
