"""Queries that replay a table as a stream, in three batches with a restart before each."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators import runs
from factloom.plans.registry import query
from factloom.plans.source_queries import _ALIASES
from factloom.sources.scratch import shared
from factloom.streaming import jobs

BATCHES = 3


def _folder(v) -> str:
    return f"{shared(v.spark)}/stream-{uuid.uuid4().hex}"


def _replayed(v, rows, batch, job, schema: str, mode: str = "append"):
    """What a stateful stream puts out over the parts of `rows`."""
    folder = _folder(v)
    jobs.replay(rows, batch, BATCHES, folder, lambda stream: jobs.to_table(job(stream), folder, mode))
    return jobs.read_table(v.spark, folder, StructType.fromDDL(schema))


@query("stream_requests", "WITH t AS (SELECT *, first_value(request_hash) OVER w AS h, first_value(operation) OVER w AS o, row_number() OVER w AS n FROM v_requests WINDOW w AS (PARTITION BY run_id, key_hash ORDER BY seq)) SELECT run_id, key_hash, seq, CASE WHEN n = 1 THEN 'FIRST' WHEN h = request_hash AND o = operation THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM t")
def _(v):
    rows = v("v_requests").select("run_id", "key_hash", F.col("seq").cast("long").alias("seq"), "request_hash", "operation")
    most = rows.agg(F.max("seq")).first()[0] or 0
    return _replayed(v, rows, F.floor(F.col("seq") * BATCHES / F.lit(most + 1)).cast("int"), jobs.stream_idempotent_requests, jobs.REQUEST_SCHEMA)


_MOVES = ", ".join(f"('{a}', '{b}')" for a, bs in runs.TRANSITIONS.items() for b in bs)


@query("stream_node_state", f"WITH m AS (SELECT * FROM (VALUES {_MOVES}) AS t(a, b)), s AS (SELECT run_id, node, log_offset AS step, lag(status) OVER (PARTITION BY run_id, node ORDER BY log_offset) AS before, status FROM v_status) SELECT run_id, node, step, before, status, before IS NULL OR before = status OR m.a IS NOT NULL AS legal, 'STEP' AS kind FROM s LEFT JOIN m ON m.a = s.before AND m.b = s.status")
def _(v):
    # batches out of order: steps wait for those that come later
    rows = v("v_status").select("run_id", "node", F.col("log_offset").alias("step"), "status")
    return _replayed(v, rows, F.pmod(F.xxhash64("run_id", "step"), F.lit(BATCHES)).cast("int"), jobs.stream_node_state, jobs.NODE_SCHEMA)


@query("stream_budget_alerts", "SELECT run_id, count(*) AS alerts FROM (SELECT run_id FROM v_attempts WHERE status <> 'RUNNING' GROUP BY run_id HAVING sum(tokens) >= 9000) t GROUP BY run_id")
def _(v):
    rows = v("v_attempts").select("run_id", "attempt_id", "tokens", "status")
    out = _replayed(v, rows, (F.col("attempt_id") % BATCHES).cast("int"), lambda s: jobs.stream_budget_alerts(s, "tokens", 9000, F.col("status") == "RUNNING"), jobs.ALERT_SCHEMA)
    return out.groupBy("run_id").agg(F.count("*").alias("alerts"))


@query("stream_provenance_append", "WITH s AS (SELECT 'K' || CAST(page_id % 700 AS STRING) AS id, CAST(page_id % 5 AS STRING) AS body, page_id % 3 AS b FROM pages), k AS (SELECT id, b, count(DISTINCT body) AS n, min(body) AS body FROM s GROUP BY id, b), f AS (SELECT id, min(b) AS b FROM k WHERE n = 1 GROUP BY id) SELECT k.id, k.body FROM k JOIN f ON k.id = f.id AND k.b = f.b")
def _(v):
    rows = v("pages").select(F.concat(F.lit("K"), (F.col("page_id") % 700).cast("string")).alias("id"), (F.col("page_id") % 5).cast("string").alias("body"), (F.col("page_id") % BATCHES).cast("int").alias("b"))
    folder = _folder(v)
    jobs.replay(rows, F.col("b"), BATCHES, folder, lambda s: jobs.stream_provenance_append(s, f"{folder}/out", f"{folder}/checkpoint", "id", F.col("body")))
    return jobs.read_table(v.spark, folder, StructType.fromDDL("id string, body string"))


@query("stream_source_aliases", f"{_ALIASES} SELECT id, canonical_id FROM aliases")
def _(v):
    rows = v("v_sources_raw").drop("batch")
    # the first batch are the stored sources; those that come later may elect another id
    later = v("v_sources_raw").select("*", F.when(F.col("batch") == 0, 0).otherwise(1 + F.pmod(F.xxhash64("id"), F.lit(BATCHES - 1))).cast("int").alias("part"))
    folder = _folder(v)
    jobs.replay(later.select(*rows.columns, "part"), F.col("part"), BATCHES, folder, lambda s: jobs.stream_source_upsert(s.drop("part"), f"{folder}/out", f"{folder}/checkpoint"))
    return jobs.folded_aliases(jobs.read_aliases(v.spark, f"{folder}/out"))


@query("stream_closure", "WITH RECURSIVE i AS (SELECT depends_on AS root, node FROM v_edges WHERE depends_on % 60 = 3 AND node % 7 <> 1 UNION SELECT i.root, e.node FROM i JOIN v_edges e ON e.depends_on = i.node WHERE e.node % 7 <> 1) SELECT root, node FROM i")
def _(v):
    e = v("v_edges")
    # a third of the edges comes late, and some that came go again
    added = e.withColumn("added", F.lit(True)).withColumn("part", F.when(F.col("node") % 3 == 0, 1).otherwise(0))
    gone = e.where("node % 7 = 1").withColumn("added", F.lit(False)).withColumn("part", F.lit(2))
    folder = _folder(v)
    roots = e.where("depends_on % 60 = 3").select(F.col("depends_on").alias("node"))
    jobs.replay(added.union(gone), F.col("part"), BATCHES, folder, lambda s: jobs.stream_closure(s.drop("part"), roots, f"{folder}/out", f"{folder}/checkpoint"))
    return jobs.read_closure(v.spark, f"{folder}/out", BATCHES - 1)


@query("stream_torn_lines", "SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_id % 89 <> 3 GROUP BY 1")
def _(v):
    rows = v("events").select(F.when(F.col("event_id") % 89 == 3, F.expr("left(props, 4)")).otherwise(F.col("props")).alias("value"), "event_id")
    good = lambda s: jobs.stream_torn_lines(s, StructType.fromDDL("k long"))[0]
    return _replayed(v, rows, (F.col("event_id") % BATCHES).cast("int"), good, "k long").groupBy("k").agg(F.count("*").alias("n"))
