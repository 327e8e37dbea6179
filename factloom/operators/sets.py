"""Comparison of sets that may be of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unequal_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys whose sets (key, member) differ: members are hashed twice and combined, so a set of any size is
    compared by three numbers and no row holds a group."""
    sides = []
    for name, df in (("l", left), ("r", right)):
        told = df.select("key", "member").distinct()
        prints = (F.bit_xor(F.xxhash64("member")), F.bit_xor(F.xxhash64("member", F.lit(1))), F.count("*"))
        sides.append(told.groupBy("key").agg(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(prints))).alias(name)))
    return sides[0].join(sides[1], "key", "full_outer").where(~F.col("l").eqNullSafe(F.col("r"))).select("key")
