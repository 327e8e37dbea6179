"""Sources: canonical URLs, identity groups, deduplication, and candidates that rest on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators.violations import report


def canonical(sources: DataFrame, url: str = "url") -> DataFrame:
    return sources.withColumn("canonical_url", F.when(core.url_problem(url).isNull(), core.canonicalize_url(url)))


def quarantine_urls(sources: DataFrame, key: str = "id", url: str = "url") -> DataFrame:
    problem = core.url_problem(url)
    return report(sources.where(problem.isNotNull()), "source_url", problem, F.col(key), F.col(url))


def public_sources(sources: DataFrame) -> DataFrame:
    return sources.where(F.col("access_status") == "public")


def identity(columns: list[str] | None = None) -> Column:
    """Canonical URL, or else publisher, title, publication date and content hash, each of which may be null.

    The fallback is written as a JSON list, so a missing field differs from an empty one and no separator
    can be mistaken. With `columns`, fields that the table lacks are null.
    """
    fields = ("publisher", "title", "published_on", "content_hash")
    parts = [F.col(c).cast("string") if columns is None or c in columns else F.lit(None).cast("string") for c in fields]
    return F.coalesce(F.col("canonical_url"), F.concat(F.lit("meta"), F.to_json(F.array(*parts))))


#: What may change from one copy of a source to the next, and what is known of it here.
CHANGING = ("id", "accessed_on", "freshness_status", "url", "canonical_url", "stored", "batch", "identity")


def stable_fields(columns: list[str]) -> Column:
    """What may not differ inside an identity: every field that is not one of CHANGING, nulls kept apart."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns) if c not in CHANGING)), {"ignoreNullFields": "false"})


def batch_union(stored: DataFrame, supplied: DataFrame) -> DataFrame:
    return stored.withColumn("stored", F.lit(True)).unionByName(supplied.withColumn("stored", F.lit(False)), allowMissingColumns=True)


def dedup_conflicts(sources: DataFrame) -> DataFrame:
    """Identities whose members disagree on a stable field."""
    groups = sources.groupBy(identity(sources.columns).alias("identity")).agg(F.count_distinct(stable_fields(sources.columns)).alias("n")).where("n > 1")
    return report(groups, "source_identity", "CONFLICT", F.col("identity"), F.col("n"))


def dedup_sources(sources: DataFrame) -> DataFrame:
    """One row per identity: the newest by date and id, under the group's canonical id. One hash aggregate."""
    rows = sources.groupBy(identity(sources.columns).alias("identity")).agg(
        F.max_by(F.struct(*[c for c in sources.columns if c not in ("id", "stored")]), F.struct("accessed_on", "id")).alias("r"), canonical_id().alias("id")
    )
    return rows.select("id", "identity", "r.*")


def canonical_id() -> Column:
    """The smallest stored id of a group, or else the smallest id."""
    return F.coalesce(F.min(F.when(F.col("stored"), F.col("id"))), F.min("id"))


def canonical_ids(sources: DataFrame) -> DataFrame:
    return sources.groupBy(identity(sources.columns).alias("identity")).agg(canonical_id().alias("canonical_id"))


def source_aliases(sources: DataFrame) -> DataFrame:
    """Every provider id with its canonical id."""
    keyed = sources.withColumn("identity", identity(sources.columns))
    return keyed.select("id", "identity").join(canonical_ids(sources), "identity").select("id", "canonical_id").distinct()


def alias_changes(was: DataFrame, now: DataFrame) -> DataFrame:
    """(change, id, identity, canonical_id): -1 for each alias (id, identity, canonical_id) that no longer holds, +1 for each new one."""
    keys = ["id", "identity", "canonical_id"]
    lost = was.join(now, keys, "left_anti").select(F.lit(-1).alias("change"), *keys)
    return lost.union(now.join(was, keys, "left_anti").select(F.lit(1).alias("change"), *keys))


def canonical_collisions(sources: DataFrame) -> DataFrame:
    """Canonical ids elected by more than one identity with other content."""
    merged = dedup_sources(sources)
    rows = merged.groupBy("id").agg(F.count_distinct(stable_fields(merged.columns)).alias("n")).where("n > 1")
    return report(rows, "canonical_id", "COLLISION", F.col("id"), F.col("n"))


def rewrite_aliases(links: DataFrame, aliases: DataFrame, owner: str = "candidate_id") -> DataFrame:
    """(owner, pos, source_id) links under canonical ids, in order, without repeats."""
    told = links.join(aliases.withColumnRenamed("id", "source_id"), "source_id", "left").withColumn("source_id", F.coalesce("canonical_id", "source_id"))
    first = told.groupBy(owner, "source_id").agg(F.min("pos").alias("first"))
    return first.select(owner, (F.row_number().over(Window.partitionBy(owner).orderBy("first", "source_id")) - 1).alias("pos"), "source_id")


def source_issues(owners: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Empty, repeated, missing or inaccessible source references of each owner (id; links owner_id)."""
    told = links.select("owner_id", "source_id").join(sources.select(F.col("id").alias("source_id"), "access_status"), "source_id", "left")
    kinds = told.groupBy("owner_id", "source_id", "access_status").agg(F.count("*").alias("n"))
    code = F.array_compact(F.array(F.when(F.col("n") > 1, "DUPLICATE"), F.when(F.col("access_status").isNull(), "MISSING"), F.when(F.col("access_status") != "public", "INACCESSIBLE")))
    bad = kinds.select("owner_id", "source_id", F.explode(code).alias("code"))
    empty = owners.select(F.col("id").alias("owner_id")).join(links.select("owner_id").distinct(), "owner_id", "left_anti")
    return report(bad, "source_refs", F.col("code"), F.col("owner_id"), F.col("source_id")).union(report(empty, "source_refs", "EMPTY", F.col("owner_id")))


def valid_candidates(candidates: DataFrame, links: DataFrame, sources: DataFrame) -> DataFrame:
    """Candidates with at least one source, all of them public."""
    told = links.join(sources.select(F.col("id").alias("source_id"), "access_status"), "source_id", "left")
    good = told.groupBy("candidate_id").agg(F.bool_and(F.coalesce(F.col("access_status") == "public", F.lit(False))).alias("good")).where("good")
    return candidates.join(good.select(F.col("candidate_id").alias("id")), "id", "left_semi")


def evidence_sufficiency(candidates: DataFrame, links: DataFrame, sources: DataFrame, required: Column, budget: int = 50) -> DataFrame:
    """One row per group: are there enough valid candidates and source types, within the source budget?

    `candidates` has group_id; without a required count the number of valid candidates is required.
    """
    valid = valid_candidates(candidates, links, sources)
    used = valid.select(F.col("id").alias("candidate_id"), "group_id").join(links, "candidate_id").join(sources.select(F.col("id").alias("source_id"), "source_type"), "source_id")
    kinds = used.groupBy("group_id").agg(F.count_distinct("source_type").alias("source_types"), F.count_distinct("source_id").alias("sources"))
    counts = valid.groupBy("group_id").agg(F.count("*").alias("valid"))
    told = counts.join(kinds, "group_id", "left").withColumn("required", F.coalesce(required, F.col("valid")))
    enough = (F.col("valid") >= F.col("required")) & (F.col("source_types") >= 2) & (F.col("sources") <= budget)
    return told.select("group_id", "valid", F.col("required").cast("long").alias("required"), "source_types", "sources", enough.alias("sufficient"))


def append_immutable(target: DataFrame, batch: DataFrame, key: str, content: Column) -> tuple[DataFrame, DataFrame]:
    """One new row for each key to append, and a violation for each key that comes again with other content.

    A key that stands in the batch with two contents is a conflict too, and none of its rows is appended.
    A null content is one content; rows without a key are left out.
    """
    told = batch.where(F.col(key).isNotNull())
    known = target.select(F.col(key), F.struct(content.alias("v")).alias("_old")).dropDuplicates([key])
    own = told.groupBy(key).agg(F.min(F.struct(content.alias("v"))).alias("_lo"), F.max(F.struct(content.alias("v"))).alias("_hi"))
    own = own.join(known, key, "left").withColumn("_conflict", ~F.col("_lo").eqNullSafe(F.col("_hi")) | (F.col("_old").isNotNull() & ~F.col("_lo").eqNullSafe(F.col("_old"))))
    fresh = told.join(own.where(F.col("_old").isNull() & ~F.col("_conflict")).select(key), key, "left_semi").dropDuplicates([key])
    return fresh, report(own.where("_conflict"), "immutable_append", "CONFLICT", F.col(key))


def catalog_lookup(keys: DataFrame, catalog: DataFrame, key: str = "key") -> DataFrame:
    """The catalog's value of each key, or that of `*` (the least one if there are several)."""
    told = catalog.where(F.col(key) != "*")
    # one row
    default = catalog.where(F.col(key) == "*").agg(F.min("value").alias("_any"))
    return keys.join(told, key, "left").join(F.broadcast(default)).select(key, F.coalesce("value", "_any").alias("value"))


def claim_status(evidence: DataFrame, sources: DataFrame) -> DataFrame:
    """VALIDATED with medium confidence if all sources are fresh and one is of tier 1."""
    told = evidence.join(sources.select(F.col("id").alias("source_id"), "freshness_status", "source_tier"), "source_id")
    ok = F.bool_and(F.col("freshness_status") == "FRESH") & F.bool_or(F.col("source_tier") == 1)
    rows = told.groupBy("claim_id").agg(ok.alias("ok"))
    return rows.select("claim_id", F.when(F.col("ok"), "VALIDATED").otherwise("PARTIALLY_VALIDATED").alias("status"), F.when(F.col("ok"), "MEDIUM").otherwise("LOW").alias("confidence"))
