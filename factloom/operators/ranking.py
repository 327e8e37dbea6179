"""Ranking of candidates by a fixed policy, selection, and expansion of selected ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
CATEGORY_WEIGHT = {"direct": 5, "indirect": 4, "substitute": 3, "adjacent": 2, "platform_risk": 1}


def category_weight(category: Column) -> Column:
    out = F.lit(0)
    for name, weight in CATEGORY_WEIGHT.items():
        out = F.when(category == name, weight).otherwise(out)
    return out


def policy_ranking(candidates: DataFrame, links: DataFrame, sources: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Candidates with `rank`: category, fresh sources, sources, name, id. `by`: the columns that part the
    runs, each of which is ranked by itself."""
    told = links.join(sources.select(F.col("id").alias("source_id"), "freshness_status"), "source_id", "left")
    counts = told.groupBy(F.col("candidate_id").alias("id")).agg(F.count_if(F.col("freshness_status") == "FRESH").alias("fresh"), F.count("*").alias("sources"))
    rows = candidates.join(counts, "id", "left").fillna(0, ["fresh", "sources"])
    order = Window.partitionBy(*by).orderBy(category_weight(F.col("category")).desc(), F.col("fresh").desc(), F.col("sources").desc(), F.lower("name"), "id")
    return rows.withColumn("rank", F.row_number().over(order))


def top_n(ranked: DataFrame, n: int | Column) -> DataFrame:
    """The first n of each run are selected, the others excluded with a reason."""
    n = n if isinstance(n, Column) else F.lit(n)
    chosen = F.col("rank") <= n
    text = F.when(chosen, F.format_string("rank %d: category %s, %d fresh of %d sources", "rank", "category", "fresh", "sources")).otherwise(F.format_string("rank %d is beyond the %d requested", "rank", n))
    return ranked.withColumn("selected", chosen).withColumn("rationale", text)


def fanout_instances(template: str, selected: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One node per selected id that has none yet."""
    nodes = selected.where("selected").select(F.concat(F.lit(template + ":"), F.col("id")).alias("node"), F.col("id").alias("instance_key"), "rank")
    return nodes if existing is None else nodes.join(existing.select("node"), "node", "left_anti")


def quota_topk(items: DataFrame, slots: DataFrame, run: str, order: list) -> DataFrame:
    """Per run the first items up to its free slots are taken, the others deferred."""
    ranked = items.withColumn("pos", F.row_number().over(Window.partitionBy(run).orderBy(*order)))
    told = ranked.join(slots, run, "left").withColumn("slots", F.coalesce("slots", F.lit(0)))
    return told.withColumn("taken", F.col("pos") <= F.col("slots")).withColumn("reason", F.when(F.col("pos") > F.col("slots"), "NO_FREE_SLOT"))
