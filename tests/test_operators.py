"""Operators on small hand-made rows."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factloom.functions import core
from factloom.operators import lineage, providers, runs, scoring, sources, violations
from factloom.operators.sets import unequal_sets
from factloom.streaming import jobs


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("HTTP://Example.COM:80/A?b=C#d", "http://example.com/A?b=C"),
        ("https://example.com:443", "https://example.com/"),
        ("https://example.com:8443/x", "https://example.com:8443/x"),
        ("http://a_b.com/p", "http://a_b.com/p"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, core.canonicalize_url("u"), u=url) == want


@pytest.mark.parametrize(("url", "want"), [("ftp://x/y", "SCHEME"), ("http://u:p@x/", "CREDENTIALS"), ("http://x:99999/", "PORT"), ("  ", "EMPTY"), ("http://x/", None), ("http://[::1]/", "IPV6_HOST")])
def test_url_problem(spark, url, want):
    assert one(spark, core.url_problem("u"), u=url) == want


def test_shared_ranks(spark):
    rows = [(c, d, d, "SCORED" if c != "c" or d < 4 else "UNRESOLVED", 8 if c != "c" or d < 4 else None) for c in "abc" for d in range(5)]
    j = spark.createDataFrame([(c, f"d{d}", o, s, x) for c, d, o, s, x in rows], "competitor_id string, dimension_id string, dimension_order int, judgment_status string, score int")
    got = {r.competitor_id: (r["rank"], r.tie_status) for r in scoring.competition_rank(scoring.weighted_score(j)).collect()}
    assert got == {"a": (1, "TIED"), "b": (1, "TIED"), "c": (3, "UNIQUE")}
    weights = {float(r.effective_weight) for r in scoring.effective_weights(j).where("competitor_id = 'c'").collect()}
    assert weights == {0.25}
    assert scoring.weighted_score(j).where("competitor_id = 'c'").first().status == "PARTIAL"


def test_rules_report_all(spark):
    df = spark.createDataFrame([("a", None, 9), ("b", "x", 2), ("c", "ok", 5)], "id string, kind string, n int")
    got = violations.check(df, F.col("id"), [violations.required("kind"), violations.allowed("kind", ["ok"]), violations.between("n", 3, 6)])
    assert sorted((r.key, r.code) for r in got.collect()) == [("a", "RANGE"), ("a", "REQUIRED"), ("b", "ENUM"), ("b", "RANGE")]


def test_lineage(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (4, 3), (9, 8)], "node long, depends_on long")
    root = spark.createDataFrame([(1,)], "node long")
    assert sorted(r.node for r in lineage.downstream_impact(edges, root).collect()) == [2, 3, 4]
    assert lineage.cycle_nodes(edges).count() == 0
    loop = edges.union(spark.createDataFrame([(1, 3)], edges.schema))
    assert sorted(r.node for r in lineage.cycle_nodes(loop).collect()) == [1, 2, 3, 4]


def test_patches(spark):
    ideas = spark.createDataFrame([("i", "text", "old")], "id string, original string, goal string")
    patches = spark.createDataFrame([("i", "goal", "new"), ("i", "original", "x"), ("i", "other", "y")], "id string, field string, value string")
    merged, bad = providers.merge_patches(ideas, patches, ["goal"], ["original"])
    assert merged.first().goal == "new"
    assert sorted(r.code for r in bad.collect()) == ["FIXED_FIELD", "UNKNOWN_FIELD"]


def test_artifact_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"id": "ART-1", "version": 2}\n')
    (tmp_path / "a" / "log.jsonl").write_text('{"id": "e1", "version": 1}\n{"id": "e2"\n')
    schema = StructType([StructField("id", StringType()), StructField("version", LongType())])
    assert runs.read_artifacts(spark, str(tmp_path / "a" / "x.json"), schema).first().version == 2
    good, bad = runs.read_event_log(spark, str(tmp_path / "a" / "log.jsonl"), schema)
    assert good.count() == 1 and bad.first().code == "BAD_LINE"
    assert runs.read_inventory(spark, str(tmp_path / "a")).count() == 2


def _stream(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_source_stream_equals_batch(spark, tmp_path):
    schema = "id string, url string, source_type string, title string, publisher string, source_tier int, accessed_on date"
    import datetime as dt

    rows = [(f"S{i}", f"HTTP://x.com/{i % 3}#f", "t", "a", "p", 1, dt.date(2024, 1, i + 1)) for i in range(8)]
    stream = _stream(spark, rows, schema, str(tmp_path / "in"))
    jobs.stream_source_upsert(stream, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    got = {(r.identity, r.accessed_on) for r in jobs.read_sources(spark, str(tmp_path / "table")).collect()}
    batch = sources.dedup_sources(sources.canonical(spark.createDataFrame(rows, schema)).withColumn("stored", F.lit(False)))
    assert got == {(r.identity, r.accessed_on) for r in batch.collect()} and len(got) == 3


def test_append_stream_reports_conflicts(spark, tmp_path):
    """Conflicts inside one micro-batch and across two; repeats are no conflict."""
    schema = "id string, body string"
    for n, rows in enumerate(([("a", "1"), ("a", "2"), ("b", "1"), ("b", "1")], [("b", "1"), ("b", "9"), ("c", "1"), ("d", None)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        jobs.stream_provenance_append(stream, str(tmp_path / "t"), str(tmp_path / "cp"), "id", F.col("body")).awaitTermination()
        bad = {(r.key, r.v) for r in spark.read.parquet(str(tmp_path / "t_conflicts")).select("key", "v").collect()}
        assert bad == ({("a", 0)} if n == 0 else {("a", 0), ("b", 1)})
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["b", "c", "d"]


def test_append_immutable(spark):
    schema = "id string, body string"
    target = spark.createDataFrame([("a", "1"), ("n", None)], schema)
    batch = spark.createDataFrame([("a", "1"), ("x", "1"), ("x", "2"), ("y", "3"), ("y", "3"), ("n", None), ("z", None), ("z", "1"), (None, "1")], schema)
    fresh, bad = sources.append_immutable(target, batch, "id", F.col("body"))
    assert [(r.id, r.body) for r in fresh.collect()] == [("y", "3")]
    assert sorted(r.key for r in bad.collect()) == ["x", "z"]


def test_json_pointer(spark):
    doc = '{"a/b": [1, {"0": "x"}], "": {"~": null}, "q\'s": "{\\"k\\": 1}", "12": true, "\'\\"": 7}'
    pointers = {"/a~1b/0": "1", "/a~1b/1/0": "x", "/a~1b/00": None, "/a~1b/-": None, "/a~1b/2": None, "/a~1b/0/x": None, "/q's/k": None, "/q's": '{"k": 1}', "/12": "true", "/'\"": "7", "/no": None}
    for pointer, want in pointers.items():
        assert one(spark, core.json_pointer(F.col("d"), pointer).cast("string"), d=doc) == want
    assert one(spark, core.json_pointer(F.col("d"), "/a~1b").cast("string"), d="not json") is None
    for bad in ("a", "", "/a~2", "/a~"):
        with pytest.raises(ValueError):
            core.json_pointer(F.lit("{}"), bad)


def test_budget_stream(spark, tmp_path):
    stream = _stream(spark, [(1, 5), (1, 7), (2, 1)], "run_id long, seconds long", str(tmp_path / "in"))
    jobs.stream_run_budget(stream, "seconds", 10).writeStream.outputMode("complete").format("memory").queryName("budget").trigger(availableNow=True).start().awaitTermination()
    assert {(r.run_id, r.used, r.exceeded) for r in spark.table("budget").collect()} == {(1, 12, True), (2, 1, False)}


def test_all_rows_of_a_callers_rules_count(spark):
    n = 1500
    codes = spark.range(n).select(F.concat(F.lit("c"), "id").alias("code"))
    told = runs.error_routing(codes.select("code", F.lit(1).alias("attempts"), F.lit(0).alias("cycles")), codes.withColumn("action", F.lit("RETRY_NODE")), 3, 3)
    assert told.where("routed = 'RETRY_NODE'").count() == n
    refs = codes.select(F.lit("1").alias("source_version"), F.col("code").alias("kind"))
    assert runs.import_gate(refs, refs.withColumn("safe", F.lit(True))).where("decision = 'ACCEPT'").count() == n
    dims = spark.range(n).select(F.concat(F.lit("d"), "id").alias("dimension_id"), F.col("id").cast("int").alias("dimension_order"))
    judged = spark.createDataFrame([("x", "d0", 0, "SCORED", 3)], "competitor_id string, dimension_id string, dimension_order int, judgment_status string, score int")
    assert len(scoring.missing_dimensions(judged, dims).first().missing) == n - 1
    links = codes.select(F.lit("d").alias("dimension_id"), F.col("code").alias("claim_id"))
    claims = codes.select(F.col("code").alias("id"), F.col("code").alias("category"))
    assert scoring.claim_category_scope(links, claims, codes.select(F.lit("d").alias("dimension_id"), F.col("code").alias("category"))).count() == 0


def test_moves_as_the_rules_state_them():
    """Moves that tell the kinds apart, written out."""
    has = lambda kind, a, b: b in runs.MOVES[kind].get(a, ())
    allowed = [("executable", "READY", "RUNNING"), ("executable", "RUNNING", "WAITING_FOR_EXTERNAL"), ("executable", "FAILED", "RETRY_READY"), ("executable", "INVALIDATED", "PENDING"), ("interactive", "RUNNING", "WAITING_FOR_USER"), ("interactive", "WAITING_FOR_USER", "RUNNING"), ("human_gate", "READY", "WAITING_FOR_USER"), ("human_gate", "WAITING_FOR_USER", "APPROVED"), ("external_input", "READY", "WAITING_FOR_EXTERNAL"), ("external_input", "RETRY_READY", "WAITING_FOR_EXTERNAL"), ("workflow", "CREATED", "RUNNING"), ("workflow", "PAUSED", "CANCELLED"), ("attempt", "RUNNING", "COMPLETED"), ("attempt", "WAITING_FOR_USER", "INVALIDATED")]
    refused = [("executable", "RUNNING", "WAITING_FOR_USER"), ("executable", "READY", "VERIFIED"), ("executable", "COMPLETED", "VERIFIED"), ("executable", "VERIFIED", "RUNNING"), ("interactive", "WAITING_FOR_USER", "INVALIDATED"), ("human_gate", "READY", "RUNNING"), ("human_gate", "APPROVED", "PENDING"), ("external_input", "READY", "RUNNING"), ("workflow", "COMPLETED", "RUNNING"), ("workflow", "PAUSED", "COMPLETED"), ("attempt", "COMPLETED", "RUNNING"), ("attempt", "FAILED", "RUNNING")]
    assert all(has(*m) for m in allowed) and not any(has(*m) for m in refused)


def test_sets_of_any_size(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "x"), (1, "a"), (5, None)], "key long, member string")
    right = spark.createDataFrame([(1, "b"), (1, "a"), (2, "b"), (4, "x"), (5, None)], "key long, member string")
    assert sorted(r.key for r in unequal_sets(left, right).collect()) == [2, 3, 4]


def test_paths_lie_in_folders_not_in_prefixes(spark):
    requested = spark.createDataFrame([("t", p) for p in ("a/b", "a/b/c", "a/bc", "a", "../a/b/c", "", None, "x/y")] + [("u", "a/b/c")], "attempt string, path string")
    declared = spark.createDataFrame([("t", "a/b"), ("t", "x/")], "attempt string, prefix string")
    got = {(r.key, r.detail) for r in runs.path_violations(requested, declared).collect()}
    assert {("t", "a/bc"), ("t", "a"), ("t", "../a/b/c"), ("t", ""), ("u", "a/b/c")} <= got and not got & {("t", "a/b"), ("t", "a/b/c"), ("t", "x/y")}
