"""Streams in several batches with a restart before each, against the batch operators and by hand."""

import time

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators import lineage, runs, sources
from factloom.streaming import jobs

REQUESTS = "run_id long, key_hash string, request_hash string, operation string, seq long"
STEPS = "run_id long, node long, step long, status string"


def feed(spark, folder, batches, schema, job, pause=0.0):
    """Put each batch into the source and start the job again from its checkpoint."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/source")
        job(spark.readStream.schema(schema).parquet(f"{folder}/source")).awaitTermination()
        time.sleep(pause)


def out(spark, folder, schema):
    return jobs.read_table(spark, str(folder), StructType.fromDDL(schema)).collect()


def test_requests_over_restarts_equal_batch(spark, tmp_path):
    batches = [[(1, "k", "h1", "op", 1), (2, "k", "h2", "op", 4)], [(1, "k", "h2", "op", 3), (1, "k", "h1", "op", 2)], [(2, "k", "h2", "other", 6), (2, "k", "h2", "op", 5), (3, "x", "h", "op", 7)]]
    feed(spark, tmp_path, batches, REQUESTS, lambda s: jobs.to_table(jobs.stream_idempotent_requests(s), str(tmp_path)))
    batch = runs.idempotency_audit(spark.createDataFrame(sum(batches, []), REQUESTS))
    assert {(r.seq, r.outcome) for r in out(spark, tmp_path, jobs.REQUEST_SCHEMA)} == {(r.seq, r.outcome) for r in batch.collect()}


def test_requests_after_their_time(spark, tmp_path):
    batches = [[(1, "k", "h1", "op", 1)], [(1, "k", "h2", "op", 2)]]
    feed(spark, tmp_path, batches, REQUESTS, lambda s: jobs.to_table(jobs.stream_idempotent_requests(s, ttl_ms=1), str(tmp_path)), pause=0.1)
    assert {(r.seq, r.outcome) for r in out(spark, tmp_path, jobs.REQUEST_SCHEMA)} == {(1, "FIRST"), (2, "FIRST")}


def test_node_states_wait_for_missing_steps(spark, tmp_path):
    """Steps out of order over three batches, illegal moves, repeats and late rows."""
    batches = [[(1, 1, 3, "COMPLETED"), (1, 1, 1, "READY"), (1, 2, 2, "RUNNING")], [(1, 2, 1, "READY"), (1, 1, 1, "READY")], [(1, 1, 2, "RUNNING"), (1, 1, 4, "VERIFIED"), (2, 1, 1, "FAILED")]]
    feed(spark, tmp_path, batches, STEPS, lambda s: jobs.to_table(jobs.stream_node_state(s), str(tmp_path)))
    got = sorted((r.run_id, r.node, r.step, r.status, r.legal, r.kind) for r in out(spark, tmp_path, jobs.NODE_SCHEMA) if r.kind != "LATE")
    assert got == [(1, 1, 1, "READY", True, "STEP"), (1, 1, 2, "RUNNING", True, "STEP"), (1, 1, 3, "COMPLETED", True, "STEP"), (1, 1, 4, "VERIFIED", False, "STEP"), (1, 2, 1, "READY", True, "STEP"), (1, 2, 2, "RUNNING", True, "STEP"), (2, 1, 1, "FAILED", True, "STEP")]
    assert [(r.node, r.step) for r in out(spark, tmp_path, jobs.NODE_SCHEMA) if r.kind == "LATE"] == [(1, 1)]


def test_node_states_give_missing_steps_up(spark, tmp_path):
    batches = [[(1, 1, 1, "READY"), (1, 1, 3, "COMPLETED"), (1, 1, 4, "VERIFYING")], [(7, 1, 1, "READY")], [(1, 1, 2, "RUNNING"), (1, 1, 5, "VERIFIED")]]
    feed(spark, tmp_path, batches, STEPS, lambda s: jobs.to_table(jobs.stream_node_state(s, wait_ms=1), str(tmp_path)), pause=0.1)
    got = sorted((r.step, r.before, r.status, r.legal, r.kind) for r in out(spark, tmp_path, jobs.NODE_SCHEMA) if r.run_id == 1)
    assert got == [(1, None, "READY", True, "STEP"), (2, None, "RUNNING", None, "LATE"), (3, "READY", "COMPLETED", False, "AFTER_GAP"), (4, "COMPLETED", "VERIFYING", True, "STEP"), (5, "VERIFYING", "VERIFIED", True, "STEP")]


def test_one_alert_a_run(spark, tmp_path):
    schema = "run_id long, seconds long, status string"
    batches = [[(1, 6, "DONE"), (2, 4, "DONE"), (3, 99, "WAITING_FOR_USER")], [(1, 4, "DONE"), (2, None, "DONE")], [(1, 50, "DONE"), (2, 5, "DONE")]]
    feed(spark, tmp_path, batches, schema, lambda s: jobs.to_table(jobs.stream_budget_alerts(s, "seconds", 10, F.col("status").startswith("WAITING")), str(tmp_path)))
    assert [(r.run_id, r.used) for r in out(spark, tmp_path, jobs.ALERT_SCHEMA)] == [(1, 10)]


def test_aliases_are_taken_back(spark, tmp_path):
    """A later source with a smaller id re-elects the canonical id of its identity, unless one is stored."""
    schema = "id string, url string, source_type string, title string, publisher string, source_tier int, accessed_on date"
    row = lambda i, url: (i, url, "t", "a", "p", 1, None)
    batches = [[row("S5", "http://x.com/1")], [row("S4", "http://x.com/1"), row("S7", "http://x.com/2")], [row("S6", "http://x.com/2"), row("S7", "http://x.com/2"), row("S9", None)]]
    table = f"{tmp_path}/t"
    feed(spark, tmp_path, batches, schema, lambda s: jobs.stream_source_upsert(s, table, f"{tmp_path}/cp"))
    changes = jobs.read_aliases(spark, table)
    assert sorted((r.v, r.change, r.id, r.canonical_id) for r in changes.collect()) == [(0, 1, "S5", "S5"), (1, 1, "S4", "S5"), (1, 1, "S7", "S7"), (2, -1, "S7", "S7"), (2, 1, "S6", "S6"), (2, 1, "S7", "S6"), (2, 1, "S9", "S9")]
    rows = sources.canonical(spark.createDataFrame([(*r, b == 0) for b, rows in enumerate(batches) for r in rows], schema + ", stored boolean"))
    assert {tuple(r) for r in jobs.folded_aliases(changes).collect()} == {tuple(r) for r in sources.source_aliases(rows).collect()}


def test_closure_follows_its_edges(spark, tmp_path):
    """Inserts, deletes, both of one edge in a batch, and a ring; after each batch as the batch operator has it."""
    schema = "node long, depends_on long, added boolean"
    batches = [[(2, 1, True), (3, 2, True), (5, 4, True)], [(4, 3, True), (6, 1, True), (3, 2, False)], [(3, 2, True), (1, 5, True), (6, 1, False), (6, 1, True), (9, 8, False)], [(2, 1, False)]]
    roots = spark.createDataFrame([(1,), (3,), (77,)], "node long")
    edges = set()
    for n, rows in enumerate(batches):
        feed(spark, tmp_path, [rows], schema, lambda s: jobs.stream_closure(s, roots, f"{tmp_path}/t", f"{tmp_path}/cp"))
        edges = (edges - {r[:2] for r in rows if not r[2]}) | {r[:2] for r in rows if r[2]}
        want = lineage.impact_by_root(spark.createDataFrame(sorted(edges), "node long, depends_on long"), roots)
        assert {tuple(r) for r in jobs.read_closure(spark, f"{tmp_path}/t", n).collect()} == {tuple(r) for r in want.collect()}


def test_sources_without_a_url(spark):
    """A missing field is not an empty one, and no separator joins two fields."""
    rows = [("a", None, "x", None, None), ("b", "x", None, None, None), ("c", "x|y", "", None, None), ("d", "x", "y|", None, None), ("e", "x", None, None, None), ("f", "x", None, "2024-01-01", None), ("g", "x", None, None, "h")]
    df = spark.createDataFrame([(i, None, p, t, d, h, False) for i, p, t, d, h in rows], "id string, canonical_url string, publisher string, title string, published_on string, content_hash string, stored boolean")
    groups = {r.id: r.canonical_id for r in sources.source_aliases(df).collect()}
    assert groups == {"a": "a", "b": "b", "c": "c", "d": "d", "e": "b", "f": "f", "g": "g"}


def test_groups_of_a_batch_are_buckets(spark, tmp_path):
    """Many keys, null ones among them, share the entries of a fixed number of buckets over restarts."""
    n = 20_000
    df = spark.range(n).selectExpr("IF(id % 10 = 0, null, id) AS run_id", "concat('K', id % 3) AS key_hash", "IF(id % 5 = 0, null, 'h') AS request_hash", "'op' AS operation", "id AS seq")
    rows = df.union(df.selectExpr("run_id", "key_hash", f"IF(seq % 7 = 0 AND run_id IS NOT NULL, 'x', request_hash)", "operation", f"seq + {n}"))
    groups = []

    def job(stream):
        query = jobs.to_table(jobs.stream_idempotent_requests(stream), str(tmp_path))
        query.awaitTermination()
        groups.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
        return query

    jobs.replay(rows, F.floor(F.col("seq") / n).cast("int"), 2, str(tmp_path), job)
    got = spark.createDataFrame(out(spark, tmp_path, jobs.REQUEST_SCHEMA), jobs.REQUEST_SCHEMA)
    assert max(groups) <= jobs.BUCKETS
    assert got.count() == 2 * n and got.where("run_id IS NULL AND outcome = 'FIRST'").count() == 3
    assert got.where("run_id IS NULL AND outcome = 'REPLAY'").count() == n // 5 - 3
    known = {(r.seq, r.outcome) for r in got.where("run_id IS NOT NULL").collect()}
    assert known == {(i, "FIRST") for i in range(n) if i % 10} | {(i + n, "CONFLICT" if i % 7 == 0 else "REPLAY") for i in range(n) if i % 10}


def test_one_alert_a_run_in_a_shared_bucket(spark, tmp_path, monkeypatch):
    """Usage that falls and rises again gives no second alert; a run without a number is a run; sums are exact."""
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    big, schema = 2**53 + 1, "run_id long, seconds long"
    batches = [[(1, 12), (2, 4), (None, 3)], [(1, -9), (None, 7), (3, big), (3, None)], [(1, 20), (2, 6), (None, 1)]]
    feed(spark, tmp_path, batches, schema, lambda s: jobs.to_table(jobs.stream_budget_alerts(s, "seconds", 10), str(tmp_path)))
    assert {(r.run_id, r.used) for r in out(spark, tmp_path, jobs.ALERT_SCHEMA)} == {(1, 12), (None, 10), (3, big), (2, 10)}
    assert len(out(spark, tmp_path, jobs.ALERT_SCHEMA)) == 4


def test_waits_of_nodes_in_a_shared_bucket(spark, tmp_path, monkeypatch):
    """A row of one node neither puts off nor moves the wait of another in its bucket."""
    monkeypatch.setattr(jobs, "BUCKETS", 1)
    batches = [[(1, 1, 1, "READY"), (1, 1, 3, "COMPLETED"), (2, 1, 2, "RUNNING")], [(2, 1, 1, "READY"), (7, 1, 2, "READY")]]
    feed(spark, tmp_path, batches, STEPS, lambda s: jobs.to_table(jobs.stream_node_state(s, wait_ms=1), str(tmp_path)), pause=0.1)
    got = sorted((r.run_id, r.step, r.before, r.legal, r.kind) for r in out(spark, tmp_path, jobs.NODE_SCHEMA))
    assert got == [(1, 1, None, True, "STEP"), (1, 3, "READY", False, "AFTER_GAP"), (2, 1, None, True, "STEP"), (2, 2, "READY", True, "STEP")]


class State:
    exists, hasTimedOut, kept = False, False, None

    def update(self, kept):
        self.kept = kept


@pytest.mark.parametrize("fold", ["alerts", "records"])
def test_frames_of_a_bucket_are_joined_once(monkeypatch, fold):
    """The rows that are joined follow the rows of the batch, not the square of its frames."""
    joined, concat = [], pd.concat
    monkeypatch.setattr(jobs.pd, "concat", lambda frames, **how: joined.append(sum(len(f) for f in frames if f is not None)) or concat(frames, **how))
    frames = [pd.DataFrame({"key": [f"k{n}" for n in range(f * 10, f * 10 + 20)], "used": 5, "content": "c", "row": "r"}) for f in range(100)]
    judge = jobs._budget(10) if fold == "alerts" else jobs._judge
    told = next(judge((), iter(frames), State()))
    assert sum(joined) <= 2 * sum(map(len, frames))
    if fold == "alerts":  # all but the first and the last ten keys are in two frames
        assert sorted(told["key"]) == sorted(f"k{n}" for n in range(10, 1000)) and set(told["used"]) == {10}
    else:
        assert sorted(told["key"]) == sorted(f"k{n}" for n in range(1010)) and set(told["verdict"]) == {"FRESH"}
