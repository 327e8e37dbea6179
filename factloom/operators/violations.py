"""Violation rows: every check reports (rule, code, key, detail) for all bad rows at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ["rule", "code", "key", "detail"]


def report(df: DataFrame, rule: str, code: str | Column, key: Column, detail: Column | str = "") -> DataFrame:
    """One violation for every row of `df`."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(F.lit(rule).alias("rule"), as_column(code).alias("code"), key.cast("string").alias("key"), as_column(detail).cast("string").alias("detail"))


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where `bad` is true; unknown (null) does not break it."""

    name: str
    code: str
    bad: Column
    detail: Column | None = None


def required(name: str) -> Rule:
    return Rule(f"required.{name}", "REQUIRED", F.col(name).isNull())


def allowed(name: str, values: list[str]) -> Rule:
    return Rule(f"enum.{name}", "ENUM", ~F.col(name).isin(*values), F.col(name).cast("string"))


def matches(name: str, pattern: str) -> Rule:
    return Rule(f"pattern.{name}", "PATTERN", ~F.col(name).rlike(pattern), F.col(name).cast("string"))


def between(name: str, lo: float, hi: float) -> Rule:
    return Rule(f"range.{name}", "RANGE", ~F.col(name).between(lo, hi), F.col(name).cast("string"))


def unique_items(name: str) -> Rule:
    return Rule(f"unique.{name}", "UNIQUE", F.size(F.array_distinct(name)) < F.size(name))


def implies(name: str, when: Column, then: Column) -> Rule:
    return Rule(f"conditional.{name}", "CONDITIONAL", when & ~F.coalesce(then, F.lit(False)))


def check(df: DataFrame, key: Column, rules: list[Rule]) -> DataFrame:
    """All broken rules of all rows in one pass: the rules become one array column that is exploded."""
    entry = lambda r: F.when(r.bad, F.struct(F.lit(r.name).alias("rule"), F.lit(r.code).alias("code"), (r.detail if r.detail is not None else F.lit("")).alias("detail")))
    found = df.select(key.cast("string").alias("key"), F.explode(F.filter(F.array(*map(entry, rules)), lambda x: x.isNotNull())).alias("v"))
    return found.select("v.rule", "v.code", "key", "v.detail")
