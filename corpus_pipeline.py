"""The corpus pipeline: language, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's documents. Null texts are documents without a language: the first stage drops them.
An empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, languages, lines, near, packing
from factloom.llm.frames import cut, merge_join


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the model accepts; it learns from two thirds of the labels."""
    labelled = docs.where(~languages.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["text"])
    found = languages.identify(rows, languages.train_languages(labelled))
    return found.where(~F.col("rejected")).select(*(F.col(f"row.`{c}`") for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated long lines; every document stays, its text and length are those of the kept lines."""
    rows = docs.select("doc_id", "text", F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    out = lines.dedup_lines(rows)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate group (5-word shingles, 0.8): that of the least id, a row with an
    id before one without. Rows are told apart by themselves, so repeated rows and rows that share an id or
    have none are judged like any other; rows without a word stay."""
    rows = cut(docs.select(F.monotonically_increasing_id().alias("at"), F.struct(*(docs[c] for c in docs.columns)).alias("row")))
    groups = near.near_groups(rows.select("at", "row.text"), "at")
    told = merge_join(groups.select(F.col("id").alias("at"), "component"), rows.select("at", "row.doc_id"), "at")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at")
    kept = told.groupBy("component").agg(F.min(order).alias("first")).select("first.at")
    return merge_join(rows, kept, "at", "left_semi").select(*(F.col(f"row.`{c}`") for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontamination.without_leaks(docs, benchmark)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their token ids, in sequences of at most 1024."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The trained and hashed stages cannot be written in SQL; tests/llm compares them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
