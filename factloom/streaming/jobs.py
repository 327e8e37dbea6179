"""Incremental forms of the batch operators as Structured Streaming jobs.

Each job leaves the same rows as its batch operator on the same input, whatever its batches are. What keys
must remember is kept in Spark's state store, a bucket of keys in one entry: a group for each key would cost
more than its rows. A batch reads and writes the buckets of its keys only, each as one frame; tables that a job keeps beside have one version folder per batch, so a repeated batch
rewrites its own version only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from factloom.operators import reach, runs, sources
from factloom.operators.violations import report
from factloom.sources.scratch import written

NO_TIMEOUT, CLOCK = GroupStateTimeout.NoTimeout, GroupStateTimeout.ProcessingTimeTimeout


_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def _each_batch(stream: DataFrame, checkpoint: str, f: Callable[[DataFrame, int], None], mode: str = "append") -> StreamingQuery:
    """Run a stream over what its source holds now, and end.

    A stream with timers on the clock asks for another batch after each one, and one that ends when its
    source is read would go on for ever; so it gets no batches without data here, and its timers fire in the
    next batch with some. Started with a trigger of its own it fires them in time.
    """
    conf = stream.sparkSession.conf
    before = conf.get(_EMPTY_BATCHES)
    conf.set(_EMPTY_BATCHES, "false")
    try:
        return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(f).start()
    finally:
        conf.set(_EMPTY_BATCHES, before)


def replay(rows: DataFrame, batch: Column, batches: int, folder: str, job: Callable[[DataFrame], StreamingQuery]) -> None:
    """Run a job over `rows` in `batches` parts: each part is put into its source folder and the job started
    again from its checkpoint."""
    parts = written(rows.withColumn("_batch", batch))
    for b in range(batches):
        parts.where(F.col("_batch") == b).drop("_batch").write.mode("append").parquet(f"{folder}/source")
        job(rows.sparkSession.readStream.schema(rows.schema).parquet(f"{folder}/source")).awaitTermination()


def to_table(stream: DataFrame, folder: str, mode: str = "append") -> StreamingQuery:
    """Append what a stream puts out to the Parquet table `<folder>/out`."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/v={batch}")

    return _each_batch(stream, f"{folder}/checkpoint", put, mode)


def read_table(spark: SparkSession, folder: str, schema: StructType, name: str = "out") -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/{name}/*")


# sources


def stream_source_upsert(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep all sources by identity; `read_sources` gives the merged index, `read_aliases` the changes of the
    alias map.

    A batch that lets an identity elect another canonical id takes back the aliases of all its members and
    gives new ones. The sources of the first batch are the stored ones.
    """

    def merge(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        fresh = sources.canonical(df).withColumn("stored", F.lit(batch == 0))
        own = written(fresh.select("id", sources.identity(fresh.columns).alias("identity"), "stored").distinct())
        before = _members(spark, table, batch, own.schema)
        touched = own.select("identity").distinct()
        old = before.join(touched, "identity", "left_semi")
        was, now = _elected(old), _elected(old.unionByName(own))
        _write(own, f"{table}_members", batch)
        _write(sources.alias_changes(was, now), f"{table}_aliases", batch)
        _write(fresh, table, batch)

    return _each_batch(stream, checkpoint, merge)


def _write(df: DataFrame, table: str, batch: int) -> None:
    df.write.mode("overwrite").parquet(f"{table}/v={batch}")


def _members(spark: SparkSession, table: str, batch: int, schema: StructType) -> DataFrame:
    if not batch:
        return spark.createDataFrame([], schema)
    return spark.read.schema(StructType([*schema.fields]).add("v", "integer")).option("basePath", f"{table}_members").parquet(f"{table}_members").where(F.col("v") < batch).drop("v")


def _elected(members: DataFrame) -> DataFrame:
    ids = members.groupBy("identity").agg(sources.canonical_id().alias("canonical_id"))
    return members.select("id", "identity").distinct().join(ids, "identity").select("id", "identity", "canonical_id")


def read_sources(spark: SparkSession, table: str) -> DataFrame:
    return sources.dedup_sources(spark.read.parquet(table).drop("v"))


def read_aliases(spark: SparkSession, table: str) -> DataFrame:
    """(v, change, id, canonical_id): +1 where batch v gave an alias, -1 where it took one back."""
    return spark.read.parquet(f"{table}_aliases")


def folded_aliases(changes: DataFrame) -> DataFrame:
    """(id, canonical_id) that all changes together leave."""
    return changes.groupBy("id", "identity", "canonical_id").agg(F.sum("change").alias("n")).where("n > 0").select("id", "canonical_id").distinct()


# keyed state

#: Buckets of keys. Like the shuffle partitions of a stream, their number stays as its checkpoint began.
BUCKETS = 512
_KEY = "key string"


def _key(*columns: str) -> Column:
    """One text for the values of a key, nulls included; `_values` reads it back."""
    return F.to_json(F.array(*(F.col(c).cast("string") for c in columns)), {"ignoreNullFields": "false"}).alias("key")


def _values(df: DataFrame, **types: str) -> DataFrame:
    """The columns of a key in place of its text."""
    told = df.withColumn("key", F.from_json("key", "array<string>"))
    return told.select(*(F.col("key")[i].cast(t).alias(n) for i, (n, t) in enumerate(types.items())), *(c for c in df.columns if c != "key"))


def _bucketed(rows: DataFrame, judge: Callable, out: str, state: str, timeout: str) -> DataFrame:
    """Fold rows with a `key` over the state of their bucket."""
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    return rows.select(bucket, *rows.columns).groupBy("bucket").applyInPandasWithState(judge, out, state, "append", timeout)


def _packed(df: pd.DataFrame) -> bytes:
    table, sink = pa.Table.from_pandas(df, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(state: GroupState, at: int, /, **types: str) -> pd.DataFrame:
    """Frame `at` of a state, or an empty one."""
    if not state.exists:
        return pd.DataFrame({n: pd.Series(dtype=t) for n, t in types.items()})
    return pa.ipc.open_stream(pa.py_buffer(bytes(state.get[at]))).read_pandas().astype(types)


def _same(a: pd.Series, b: pd.Series) -> pd.Series:
    return (a == b) | (a.isna() & b.isna())


# append-only records

_VERDICT = "key string, verdict string, row string"


def _judge(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The content of a key decides what its later rows are; one row of a new key goes on."""
    known = _unpacked(state, 0, key="object", content="object")
    # each frame is reduced by itself and all are joined once: joining them one by one is quadratic
    parts = [pdf[["key", "content", "row"]].drop_duplicates(["key", "content"]) for pdf in frames]
    contents = pd.concat(parts, ignore_index=True).drop_duplicates(["key", "content"])
    firsts = contents.drop_duplicates("key")
    several = firsts["key"].isin(contents.loc[contents.duplicated("key"), "key"])
    stored = firsts["key"].isin(known["key"])
    before = firsts["key"].map(known.set_index("key")["content"])
    conflict = several | (stored & ~_same(before, firsts["content"]))
    fresh = ~stored & ~conflict
    if fresh.any():
        known = pd.concat([known, firsts.loc[fresh, ["key", "content"]]])
    state.update((_packed(known),))
    verdict = pd.Series("KNOWN", index=firsts.index).mask(fresh, "FRESH").mask(conflict, "CONFLICT")
    yield pd.DataFrame({"key": firsts["key"], "verdict": verdict, "row": firsts["row"].where(fresh, None)})


def stream_provenance_append(stream: DataFrame, table: str, checkpoint: str, key: str, content: Column) -> StreamingQuery:
    """Append rows of new keys; keys that come with other content go to `<table>_conflicts`.

    The contents of keys are state, so a batch touches the buckets of its own keys only and reads nothing
    that earlier batches wrote. Rows without a key are left out; a null content is one content.
    """
    rows = stream.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("key"), content.cast("string").alias("content"), F.to_json(F.struct(*stream.columns)).alias("row"))
    judged = _bucketed(rows, _judge, _VERDICT, "known binary", NO_TIMEOUT)
    schema = stream.schema

    def put(df: DataFrame, batch: int) -> None:
        told = df.persist()
        fresh = told.where("verdict = 'FRESH'").select(F.from_json("row", schema).alias("r")).select("r.*")
        _write(report(told.where("verdict = 'CONFLICT'"), "immutable_append", "CONFLICT", F.col("key")), f"{table}_conflicts", batch)
        _write(fresh, table, batch)
        told.unpersist()

    return _each_batch(judged, checkpoint, put)


def stream_torn_lines(stream: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of whole JSON lines, and violations for damaged ones."""
    return runs.parse_lines(stream, schema)


# requests

REQUEST_SCHEMA = "run_id long, key_hash string, seq long, outcome string"


def _requests(ttl_ms: int):
    def judge(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        known = _unpacked(state, 0, key="object", request_hash="object", operation="object", until="int64")
        known = known[known["until"] > now]
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values("seq", kind="stable", ignore_index=True)
            first = ~rows["key"].isin(known["key"]) & ~rows.duplicated("key")
            if first.any():
                known = pd.concat([known, rows.loc[first, ["key", "request_hash", "operation"]].assign(until=now + ttl_ms)])
            was = known.set_index("key")
            same = _same(rows["key"].map(was["request_hash"]), rows["request_hash"]) & _same(rows["key"].map(was["operation"]), rows["operation"])
            outcome = pd.Series("CONFLICT", index=rows.index).mask(same, "REPLAY").mask(first, "FIRST")
            yield pd.DataFrame({"key": rows["key"], "seq": rows["seq"], "outcome": outcome})
        if known.empty:
            state.remove()
        else:
            state.update((_packed(known),))
            state.setTimeoutDuration(max(1, int(known["until"].min()) - now))

    return judge


def stream_idempotent_requests(stream: DataFrame, ttl_ms: int = 7 * 86_400_000) -> DataFrame:
    """FIRST, REPLAY or CONFLICT of each request (run_id, key_hash, seq, request_hash, operation).

    The first request of a key is kept for the time to live, over restarts too; a replay after it counts as
    new. Inside a batch requests are judged by `seq`.
    """
    rows = stream.select(_key("run_id", "key_hash"), "seq", "request_hash", "operation")
    told = _bucketed(rows, _requests(ttl_ms), f"{_KEY}, seq long, outcome string", "known binary", CLOCK)
    return _values(told, run_id="long", key_hash="string")


# node states

NODE_SCHEMA = "run_id long, node long, step long, before string, status string, legal boolean, kind string"


def _nodes(moves: dict, wait_ms: int):
    legal_moves = {f"{a}>{b}" for a, after in moves.items() for b in after}

    def fold(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        last = _unpacked(state, 0, key="object", at="int64", status="object")
        waiting = _unpacked(state, 1, key="object", step="int64", status="object", until="int64")
        rows = pd.DataFrame({"key": [], "step": [], "status": []}) if state.hasTimedOut else pd.concat(list(frames), ignore_index=True)
        rows = rows[["key", "step", "status"]].assign(until=now + wait_ms, new=True)
        touched = rows["key"].drop_duplicates()
        # every row of a node puts the end of its wait off
        waiting.loc[waiting["key"].isin(touched), "until"] = now + wait_ms
        ahead = pd.concat([f for f in (waiting.assign(new=False), rows) if len(f)] or [rows], ignore_index=True)
        at = ahead["key"].map(last.set_index("key")["at"]).fillna(0).astype("int64")
        late = ahead["new"].astype(bool) & ((ahead["step"] <= at) | ahead.duplicated(["key", "step"]))
        missed = ahead.loc[late, ["key", "step", "status"]].assign(before=None, legal=None, kind="LATE")
        ahead = ahead[~late].assign(at=at[~late]).sort_values(["key", "step"], ignore_index=True)
        group = ahead.groupby("key", sort=False)
        # steps without a gap go on; after their wait the missing ones are given up
        moved = (ahead["step"] - group.cumcount() == ahead["at"] + 1) | (ahead["until"] < now)
        before = group["status"].shift().where(group.cumcount() > 0, ahead["key"].map(last.set_index("key")["status"]))
        kind = (ahead["step"] == group["step"].shift().fillna(ahead["at"]) + 1).map({True: "STEP", False: "AFTER_GAP"})
        legal = before.isna() | (before == ahead["status"]) | (before.astype("object") + ">" + ahead["status"]).isin(legal_moves)
        told = ahead.assign(before=before, legal=legal.astype("object"), kind=kind)[moved]
        if len(told):
            newest = told.drop_duplicates("key", keep="last")
            last = pd.concat([last[~last["key"].isin(newest["key"])], newest[["key", "step", "status"]].rename(columns={"step": "at"})])
        waiting = ahead.loc[~moved, ["key", "step", "status", "until"]]
        state.update((_packed(last), _packed(waiting)))
        if len(waiting):
            state.setTimeoutDuration(max(1, int(waiting["until"].min()) - now))
        columns = ["key", "step", "before", "status", "legal", "kind"]
        yield pd.concat([f[columns] for f in (told, missed) if len(f)] or [told[columns]])

    return fold


def stream_node_state(stream: DataFrame, moves: dict = runs.TRANSITIONS, wait_ms: int = 3_600_000) -> DataFrame:
    """Fold (run_id, node, step, status) rows, steps 1, 2, ... of each node, in their order.

    One row for each step, marked where the move is illegal. Rows ahead of a missing step wait in the state
    of their node; after `wait_ms` without a row they are folded over the gap (AFTER_GAP). A step that was
    folded, or waits, already changes nothing (LATE).
    """
    rows = stream.select(_key("run_id", "node"), "step", "status")
    told = _bucketed(rows, _nodes(moves, wait_ms), f"{_KEY}, step long, before string, status string, legal boolean, kind string", "last binary, waiting binary", CLOCK)
    return _values(told, run_id="long", node="long")


# budgets

ALERT_SCHEMA = "run_id long, used long, most long"


def _budget(most: int):
    def add(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs = _unpacked(state, 0, key="object", used="int64", told="bool")
        # each frame is summed by itself and all are joined once: joining them one by one is quadratic
        parts = [pdf.groupby("key", as_index=False, sort=False)["used"].sum().assign(told=False) for pdf in frames]
        runs = pd.concat([runs, *parts], ignore_index=True).groupby("key", as_index=False, sort=False).agg({"used": "sum", "told": "max"})
        alert = ~runs["told"] & (runs["used"] >= most)
        state.update((_packed(runs.assign(told=runs["told"] | alert)),))
        yield runs.loc[alert, ["key", "used"]].assign(most=most)

    return add


def stream_budget_alerts(stream: DataFrame, usage: str, most: int, waiting: Column | None = None) -> DataFrame:
    """One alert a run, in the batch in which its usage reaches the limit. Rows that are `waiting` don't count."""
    rows = stream.where(~F.coalesce(waiting, F.lit(False))) if waiting is not None else stream
    used = rows.select(_key("run_id"), F.coalesce(F.col(usage).cast("long"), F.lit(0)).alias("used"))
    return _values(_bucketed(used, _budget(most), f"{_KEY}, used long, most long", "runs binary", NO_TIMEOUT), run_id="long")


def stream_run_budget(stream: DataFrame, usage: str, limit: int) -> DataFrame:
    """Usage per run so far, and whether it reaches the limit; for the update output mode."""
    return stream.groupBy("run_id").agg(F.sum(usage).alias("used")).withColumn("exceeded", F.coalesce(F.col("used") >= limit, F.lit(False)))


# impact


def stream_impact(changes: DataFrame, closure: DataFrame) -> DataFrame:
    """For every changed node its downstream nodes: a join with a closure (root, node)."""
    return changes.join(closure.withColumnRenamed("root", "changed"), "changed")


def stream_closure(stream: DataFrame, roots: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep (root, node) of all that the roots reach while edges (node, depends_on, added) come and go.

    Inserts extend the pairs semi-naively: only what new edges reach is joined again. Deletes count the pairs
    of those roots anew that could reach a deleted edge. Inside a batch the deletes of an edge come before
    its inserts. `read_closure` gives the pairs after a batch.
    """
    roots = written(roots.select("node").where("node IS NOT NULL").distinct())

    def change(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        arcs_schema, pairs_schema = "a long, b long", "root long, node long"
        old = spark.read.schema(arcs_schema).parquet(f"{table}/arcs/v={batch - 1}") if batch else spark.createDataFrame([], arcs_schema)
        pairs = read_closure(spark, table, batch - 1) if batch else spark.createDataFrame([], pairs_schema)
        told = written(df.select("node", "depends_on", "added"))
        gone, new = (reach.arcs_of(told.where(F.col("added") == flag)) for flag in (False, True))
        kept = old.hint("merge").join(gone, ["a", "b"], "left_anti")
        arcs = written(kept.union(new).distinct())
        lost = old.hint("merge").join(gone.hint("merge").join(new, ["a", "b"], "left_anti"), ["a", "b"], "left_semi")
        starts = pairs.union(roots.select(F.col("node").alias("root"), "node")).distinct()
        recount = written(starts.hint("merge").join(lost.select(F.col("a").alias("node")), "node", "left_semi").select(F.col("root").alias("node")).distinct())
        safe = pairs.hint("merge").join(recount.withColumnRenamed("node", "root"), "root", "left_anti")
        fresh = new.hint("merge").join(old, ["a", "b"], "left_anti")
        ways = safe.union(roots.hint("merge").join(recount, "node", "left_anti").select("node", "node")).distinct()
        first = written(ways.withColumnRenamed("node", "a").hint("merge").join(fresh, "a").select("root", F.col("b").alias("node")).distinct().hint("merge").join(safe, ["root", "node"], "left_anti"))
        grown = [written(safe), first]
        newest = first
        while not newest.isEmpty():
            found = newest.withColumnRenamed("node", "a").hint("merge").join(arcs, "a").select("root", F.col("b").alias("node")).distinct()
            newest = written(found.hint("merge").join(grown[0].union(_all(grown[1:])), ["root", "node"], "left_anti"))
            grown.append(newest)
        again = reach.reached(arcs, recount)[0] if not recount.isEmpty() else newest
        arcs.write.mode("overwrite").parquet(f"{table}/arcs/v={batch}")
        _all(grown).union(again).distinct().write.mode("overwrite").parquet(f"{table}/pairs/v={batch}")

    return _each_batch(stream, checkpoint, change)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def read_closure(spark: SparkSession, table: str, batch: int) -> DataFrame:
    return spark.read.schema("root long, node long").parquet(f"{table}/pairs/v={batch}")


def conflicts(outcomes: DataFrame) -> DataFrame:
    return report(outcomes.where("outcome = 'CONFLICT'"), "idempotency", "CONFLICT", F.concat_ws("/", F.col("run_id").cast("string"), "key_hash", F.col("seq").cast("string")))
