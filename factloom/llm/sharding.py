"""Jump consistent hashing: stable keys to shards without a table of the ring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.ordered import id_bounds, range_of


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key; with one more shard a key stays or moves into the new one."""
    key = keys.astype(np.uint64)
    # neighbouring ids must not walk together
    key = (key ^ (key >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    key ^= key >> np.uint64(33)
    out = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (out[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        live, step = live[step < shards], step[step < shards]
        out[live] = step.astype(np.int64)
    return out


def jump_column(key: Column, shards: int) -> Column:
    """Shard 0 to shards - 1 of an integer key; a null key is key -1."""

    @F.pandas_udf("int")
    def of(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy(np.int64), shards), dtype="int32")

    return of(F.coalesce(key.cast("long"), F.lit(-1).cast("long")))


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", range_rows: int = 200_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot and the shard under one more shard.

    The law is `key`: id and shard count decide. Slots are numbered in id order, gapless from 0 in each
    shard: rows are numbered inside id ranges and moved up by the counts of the ranges before. A null
    text has size 1; rows that share an id go to one shard and get slots of their own; an empty table
    gives no row. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    bounds = id_bounds(docs.select(F.col(id_col).cast("long").alias("doc_id")), "doc_id", range_rows)
    dealt = base.withColumn("shard", jump_column(F.col("doc_id"), shards)).withColumn("grown_shard", jump_column(F.col("doc_id"), shards + 1)).withColumn("part", range_of(F.col("doc_id"), bounds))
    numbered = dealt.withColumn("at", F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")))
    counts = dealt.groupBy("shard", "part").count()
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards x 512 rows: safe to broadcast
    offsets = counts.select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    out = numbered.join(F.broadcast(offsets), ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("at") - 1).alias("slot"), "grown_shard")


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards, and their shards if there were 17."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
