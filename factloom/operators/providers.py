"""User code on rows of runs: proposals come back untrusted and are checked before use."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.violations import report


def discover(requests: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Proposed candidates of each request: the provider sees batches of request rows."""
    return requests.mapInPandas(lambda batches: (provider(b) for b in batches), schema)


def deep_dive(instances: DataFrame, provider: Callable[[dict], dict], schema: str) -> DataFrame:
    """One provider call per selected candidate."""

    def run(batches):
        for b in batches:
            yield pd.DataFrame([provider(r) for r in b.to_dict("records")])

    return instances.mapInPandas(run, schema)


def merge_patches(ideas: DataFrame, patches: DataFrame, fields: list[str], fixed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ideas with the patched fields taken over; a patch (id, field, value) of an unknown or fixed field is reported."""
    good = patches.where(F.col("field").isin(*fields))
    wide = good.groupBy("id").pivot("field", fields).agg(F.max("value"))
    told = ideas.alias("i").join(wide.alias("p"), "id", "left")
    merged = told.select("id", *(F.col(f"i.{c}") for c in fixed), *(F.coalesce(F.col(f"p.{c}"), F.col(f"i.{c}")).alias(c) for c in fields))
    code = F.when(F.col("field").isin(*fixed), "FIXED_FIELD").otherwise("UNKNOWN_FIELD")
    return merged, report(patches.where(~F.col("field").isin(*fields)), "patch", code, F.col("id"), F.col("field"))


def plan_gaps(issues: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Gaps that user code proposes for the issues of each run; a run's issues are few by contract."""
    return issues.groupBy("run_id").applyInPandas(provider, schema)


def judge_result(judgments: DataFrame, violations: DataFrame, max_retries: int) -> DataFrame:
    """ACCEPT without a violation, RETRY while retries are left, else REJECT; keys are judgment_ref."""
    bad = violations.groupBy(F.col("key").alias("judgment_ref")).agg(F.count("*").alias("broken"))
    told = judgments.join(bad, "judgment_ref", "left")
    return told.withColumn("result", F.when(F.col("broken").isNull(), "ACCEPT").when(F.col("retries") < max_retries, "RETRY").otherwise("REJECT")).drop("broken")
