"""Product ideas: how clear each dimension is, whether an interview may end, and how it goes on.

An idea row has text columns problem, pain, trigger, user, context, outcome, core_value, better, mechanism,
direction; boolean columns critical_assumption and researchable (is there a high-criticality assumption, a
researchable unknown or a seed question); and unknown_dimensions, an array of dimensions with an unknown.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: dimension -> the column that makes it HIGH, the columns that make it LOW
DIMENSIONS = {
    "problem": ("problem", ("pain", "trigger")),
    "user": ("user", ()),
    "scenario": ("context", ("trigger", "outcome")),
    "value": ("core_value", ("better",)),
    "mechanism": ("mechanism", ("direction",)),
}
MOST_ROUNDS = 8


def filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def level(strong: str, weak: tuple[str, ...]) -> Column:
    hint = reduce(lambda a, b: a | b, (filled(w) for w in weak), F.lit(False))
    return F.when(filled(strong), "HIGH").when(hint, "LOW").otherwise("UNKNOWN")


def dimension_clarity(ideas: DataFrame) -> DataFrame:
    """clarity_<dimension> of each idea, and clarity: CLEAR, PARTIAL or VAGUE."""
    out = ideas.withColumns({f"clarity_{d}": level(*cols) for d, cols in DIMENSIONS.items()})
    names = [f"clarity_{d}" for d in DIMENSIONS]
    high = reduce(add, ((F.col(n) == "HIGH").cast("int") for n in names))
    vague = reduce(lambda a, b: a & b, (F.col(n) == "UNKNOWN" for n in names))
    return out.withColumn("clarity", F.when(high == len(names), "CLEAR").when(vague, "VAGUE").otherwise("PARTIAL"))


def completion(round_number: Column) -> Column:
    """SUFFICIENT when the minimum is there; past the last round by whether research can go on."""
    known = lambda col, d: filled(col) | F.array_contains("unknown_dimensions", d)
    derivable = F.col("critical_assumption") | F.col("researchable")
    least = known("problem", "problem") & known("user", "user") & known("context", "scenario") & filled("core_value") & (filled("mechanism") | filled("direction")) & derivable
    late = F.when(derivable, "PARTIAL_RESEARCHABLE").otherwise("INSUFFICIENT_PRODUCT_CONTEXT")
    return F.when(least, "SUFFICIENT").when(round_number >= MOST_ROUNDS, late).otherwise("IN_PROGRESS")


def needs_seed(name: str = "researchable") -> Column:
    """Anchors without any origin for research: one seed question is to be added."""
    return ~(F.col("critical_assumption") | F.col(name)) & (filled("problem") | filled("user") | filled("context"))


def gap_dimension() -> Column:
    """`assumptions` with a critical one or when all is clear, else the first dimension that is not HIGH."""
    first = F.coalesce(*(F.when(F.col(f"clarity_{d}") != "HIGH", d) for d in DIMENSIONS), F.lit("assumptions"))
    return F.when(F.col("critical_assumption"), "assumptions").otherwise(first)


def interview_method(round_number: Column) -> Column:
    """How to ask next; wants the columns of dimension_clarity and `gap` from gap_dimension."""
    low = reduce(lambda a, b: a | b, ((F.col("gap") == d) & (F.col(f"clarity_{d}") == "LOW") & ~F.array_contains("unknown_dimensions", d) for d in DIMENSIONS))
    return (
        F.when(F.col("gap") == "assumptions", "assumption_challenge")
        .when((F.col("clarity") == "VAGUE") & (round_number == 1), "controlled_brainstorming")
        .when(F.col("clarity") == "VAGUE", "adaptive_product_discovery_interview")
        .when(low, "clarification")
        .otherwise("adaptive_product_discovery_interview")
    )
