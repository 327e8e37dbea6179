"""Run logs: reading, offsets, transitions, budgets, retries, and reuse of attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.functions import core, documents
from factloom.operators.violations import report

# fixed values: allowed moves of an executable node
TRANSITIONS = {
    "PENDING": ("READY", "SKIPPED", "BLOCKED", "INVALIDATED"),
    "READY": ("RUNNING", "SKIPPED", "BLOCKED", "INVALIDATED"),
    "RUNNING": ("COMPLETED", "FAILED", "BLOCKED", "INVALIDATED"),
    "COMPLETED": ("VERIFYING", "INVALIDATED"),
    "VERIFYING": ("VERIFIED", "FAILED", "BLOCKED", "INVALIDATED"),
    "FAILED": ("RETRY_READY", "BLOCKED", "INVALIDATED"),
    "RETRY_READY": ("RUNNING", "INVALIDATED"),
    "VERIFIED": ("INVALIDATED",),
    "INVALIDATED": ("PENDING",),
}
# fixed values: allowed moves of a gate, of a node that waits for input from outside, of a run and of an attempt
HUMAN_GATE = {
    "PENDING": ("READY", "SKIPPED", "BLOCKED", "INVALIDATED"),
    "READY": ("WAITING_FOR_USER", "SKIPPED", "BLOCKED", "INVALIDATED"),
    "WAITING_FOR_USER": ("APPROVED", "BLOCKED", "INVALIDATED"),
    "APPROVED": ("INVALIDATED",),
    "INVALIDATED": ("PENDING",),
}
EXTERNAL_INPUT = {
    "PENDING": ("READY", "SKIPPED", "BLOCKED", "INVALIDATED"),
    "READY": ("WAITING_FOR_EXTERNAL", "SKIPPED", "BLOCKED", "INVALIDATED"),
    "WAITING_FOR_EXTERNAL": ("COMPLETED", "FAILED", "BLOCKED", "INVALIDATED"),
    "COMPLETED": ("VERIFYING", "INVALIDATED"),
    "VERIFYING": ("VERIFIED", "FAILED", "BLOCKED", "INVALIDATED"),
    "FAILED": ("RETRY_READY", "BLOCKED", "INVALIDATED"),
    "RETRY_READY": ("WAITING_FOR_EXTERNAL", "INVALIDATED"),
    "VERIFIED": ("INVALIDATED",),
    "INVALIDATED": ("PENDING",),
}
WORKFLOW = {
    "CREATED": ("RUNNING", "PAUSED", "CANCELLED", "FAILED"),
    "RUNNING": ("WAITING_FOR_USER", "WAITING_FOR_EXTERNAL", "PAUSED", "COMPLETED", "CANCELLED", "FAILED"),
    "WAITING_FOR_USER": ("RUNNING", "PAUSED", "CANCELLED", "FAILED"),
    "WAITING_FOR_EXTERNAL": ("RUNNING", "PAUSED", "CANCELLED", "FAILED"),
    "PAUSED": ("RUNNING", "CANCELLED", "FAILED"),
}
ATTEMPT = {
    "RUNNING": ("WAITING_FOR_USER", "WAITING_FOR_EXTERNAL", "COMPLETED", "FAILED", "INVALIDATED"),
    "WAITING_FOR_USER": ("RUNNING", "FAILED", "INVALIDATED"),
    "WAITING_FOR_EXTERNAL": ("RUNNING", "FAILED", "INVALIDATED"),
}
# fixed values: moves beside those of an executable node: of every one, and of an interactive one
WAITING = {"RUNNING": ("WAITING_FOR_EXTERNAL",), "WAITING_FOR_EXTERNAL": ("RUNNING", "FAILED", "BLOCKED", "INVALIDATED")}
ASKING = {"RUNNING": ("WAITING_FOR_USER",), "WAITING_FOR_USER": ("RUNNING", "FAILED", "BLOCKED")}
# fixed values: what an event may hold
EVENT_FIELDS = [
    "event", "ts", "state_version", "run_id", "node", "attempt", "question_id", "method", "round", "target_unknown_id", "reason",
    "source_contract_version", "ref_type", "content_hash", "matrix_rule", "artifact", "decision_id", "adapter_type", "operation",
]
MOST_CHARS = 256


def _with(moves: dict, more: dict) -> dict:
    return moves | {a: (*moves.get(a, ()), *bs) for a, bs in more.items()}


#: Allowed moves by the kind of what has the status.
MOVES = {
    "executable": _with(TRANSITIONS, WAITING),
    "interactive": _with(_with(TRANSITIONS, WAITING), ASKING),
    "human_gate": HUMAN_GATE,
    "external_input": EXTERNAL_INPUT,
    "workflow": WORKFLOW,
    "attempt": ATTEMPT,
}


def read_artifacts(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """JSON documents under a fixed schema; unreadable ones keep their text in _corrupt_record."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def read_event_log(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of a JSON-lines log, and a violation for each line that is not an object."""
    return parse_lines(spark.read.text(path).withColumn("file", F.input_file_name()), schema)


def parse_lines(lines: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    told = lines.withColumn("row", F.from_json("value", schema)).withColumn("object", F.col("value").rlike(r"^\s*\{.*\}\s*$"))
    ok = F.col("object") & F.try_parse_json("value").isNotNull()
    return told.where(ok).select("row.*"), report(told.where(~ok), "event_log", "BAD_LINE", F.substring("value", 1, MOST_CHARS))


def event_log_prefix(lines: DataFrame) -> DataFrame:
    """Lines (file, line_no, value) with `state`: OK, TORN_TAIL for a damaged last line, DAMAGED elsewhere."""
    ok = F.try_parse_json("value").isNotNull() & F.col("value").rlike(r"^\s*\{")
    last = F.max("line_no").over(Window.partitionBy("file"))
    return lines.withColumn("state", F.when(ok, "OK").when(F.col("line_no") == last, "TORN_TAIL").otherwise("DAMAGED"))


def asof_side_table(side: DataFrame, commits: DataFrame) -> DataFrame:
    """Of each run the rows of the newest side version at or below the committed one."""
    bound = commits.select("run_id", F.col("state_version").alias("committed"))
    best = side.select("run_id", "state_version").distinct().join(bound, "run_id").where("state_version <= committed").groupBy("run_id").agg(F.max("state_version").alias("state_version"))
    return side.join(best, ["run_id", "state_version"], "left_semi")


def current_artifacts(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    return artifacts.join(manifest, ["run_id", "artifact_id", "version"], "left_semi")


def orphan_artifacts(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored versions that no manifest points to."""
    return artifacts.join(manifest, ["run_id", "artifact_id", "version"], "left_anti")


def append_events(log: DataFrame, batch: DataFrame, order: list[str]) -> DataFrame:
    """New events with the next offsets of their run."""
    last = log.groupBy("run_id").agg(F.max("log_offset").alias("last"))
    numbered = batch.withColumn("n", F.row_number().over(Window.partitionBy("run_id").orderBy(*order)))
    return numbered.join(last, "run_id", "left").withColumn("log_offset", F.coalesce("last", F.lit(0)) + F.col("n")).drop("last", "n")


def write_versioned(df: DataFrame, previous: DataFrame, key: str, content: Column) -> DataFrame:
    """Rows with the next version of their key, what they supersede, and a content hash."""
    last = previous.groupBy(key).agg(F.max("version").alias("supersedes"))
    told = df.join(last, key, "left").withColumn("version", F.coalesce("supersedes", F.lit(0)) + 1)
    return told.withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2(content, 256)))


def inventory_audit(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Missing, unexpected and changed entries of (path, sha256) inventories."""
    told = found.select("path", F.col("sha256").alias("now")).join(manifest.select("path", F.col("sha256").alias("want")), "path", "full_outer")
    code = F.when(F.col("now").isNull(), "MISSING").when(F.col("want").isNull(), "UNEXPECTED").when(F.col("now") != F.col("want"), "CHANGED")
    return report(told.where(code.isNotNull()), "inventory", code, F.col("path"))


def read_inventory(spark: SparkSession, root: str) -> DataFrame:
    """(path, sha256) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def offset_gaps(log: DataFrame, offset: str = "log_offset") -> DataFrame:
    """Places where a log's offsets do not follow one another, with the number of missing ones."""
    w = Window.partitionBy("run_id").orderBy(offset)
    told = log.withColumn("gap", F.col(offset) - F.coalesce(F.lag(offset).over(w), F.lit(0)) - 1)
    return report(told.where("gap <> 0"), "offset_gap", "GAP", F.concat_ws("/", F.col("run_id").cast("string"), F.col(offset).cast("string")), F.col("gap"))


def event_field_bounds(events: DataFrame, key: Column) -> DataFrame:
    """Text fields of at most 256 characters, and only known fields."""
    long = F.array_compact(F.array(*(F.when(F.length(c) > MOST_CHARS, c) for c, t in events.dtypes if t == "string")))
    unknown = [c for c in events.columns if c not in EVENT_FIELDS]
    extra = F.array(*(F.lit(c) for c in unknown)) if unknown else F.array().cast("array<string>")
    bad = events.select(key.alias("k"), F.explode(F.concat(F.transform(long, lambda x: F.struct(F.lit("TOO_LONG").alias("code"), x.alias("f"))), F.transform(extra, lambda x: F.struct(F.lit("UNKNOWN_FIELD").alias("code"), x.alias("f"))))).alias("v"))
    return report(bad, "event_fields", F.col("v.code"), F.col("k"), F.col("v.f"))


def illegal_transitions(log: DataFrame, by: list[str], order: str, allowed: dict = TRANSITIONS, kind: str | None = None) -> DataFrame:
    """Status changes that the table of moves does not have; a first status is free, a repeat is no change.

    With `kind`, a column of the log, `allowed` holds a table of moves for each kind (see MOVES); a kind
    without one has no moves.
    """
    tables = allowed if kind else {"": allowed}
    # a table of fixed size
    table = log.sparkSession.createDataFrame([(k, a, b) for k, moves in tables.items() for a, bs in moves.items() for b in bs], "_kind string, before string, status string")
    told = log.withColumn("_kind", F.col(kind) if kind else F.lit("")).withColumn("before", F.lag("status").over(Window.partitionBy(*by).orderBy(order))).where("before IS NOT NULL AND before <> status")
    bad = told.join(F.broadcast(table), ["_kind", "before", "status"], "left_anti")
    return report(bad, "transition", "ILLEGAL", F.concat_ws("/", *(F.col(c).cast("string") for c in (*by, order))), F.concat_ws(">", "before", "status"))


def usage_totals(attempts: DataFrame, by: str, counted: list[str]) -> DataFrame:
    """Sums per group; a sum with an unknown part is unknown."""
    return attempts.groupBy(by).agg(F.count("*").alias("attempts"), *(F.when(F.count("*") == F.count(c), F.sum(c)).alias(c) for c in counted))


def budget_violations(attempts: DataFrame, usage: str, limit: int, order: list[str]) -> DataFrame:
    """Attempts at which a run's usage so far passes the limit, or is unknown."""
    w = Window.partitionBy("run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    told = attempts.withColumn("so_far", F.sum(usage).over(w)).withColumn("unknown", F.sum(F.col(usage).isNull().cast("int")).over(w) > 0)
    code = F.when(F.col("unknown"), "UNKNOWN_USAGE").when(F.col("so_far") > limit, "EXCEEDED")
    return report(told.where(code.isNotNull()), "budget", code, F.concat_ws("/", F.col("run_id").cast("string"), F.col("attempt_id").cast("string")))


def limit_violations(attempts: DataFrame, limits: dict[str, int | None], order: list[str]) -> DataFrame:
    """Attempts at which a run's usage so far passes one of its limits, or cannot be known, for all limits in
    one pass over one window. A limit of None is no limit. One row for each broken limit."""
    w = Window.partitionBy("run_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    set_limits = {c: most for c, most in limits.items() if most is not None}
    told = attempts.select("*", *(F.sum(c).over(w).alias(f"_sum_{c}") for c in set_limits), *(F.sum(F.col(c).isNull().cast("int")).over(w).alias(f"_open_{c}") for c in set_limits))
    broken = [F.when(F.col(f"_open_{c}") > 0, F.struct(F.lit("UNKNOWN_USAGE").alias("code"), F.lit(c).alias("c"))).when(F.col(f"_sum_{c}") > most, F.struct(F.lit("EXCEEDED").alias("code"), F.lit(c).alias("c"))) for c, most in set_limits.items()]
    bad = told.select("run_id", "attempt_id", F.explode(F.array_compact(F.array(*broken))).alias("v"))
    return report(bad, "budget", F.col("v.code"), F.concat_ws("/", F.col("run_id").cast("string"), F.col("attempt_id").cast("string")), F.col("v.c"))


def run_budget_exceeded(attempts: DataFrame, usage: str, limit: int) -> DataFrame:
    return attempts.groupBy("run_id").agg(F.sum(usage).alias("used")).where(F.col("used") >= limit)


def version_chain(artifacts: DataFrame) -> DataFrame:
    """Versions run 1..n and supersede the one before."""
    w = Window.partitionBy("run_id", "artifact_id").orderBy("version")
    told = artifacts.withColumn("want", F.row_number().over(w))
    code = F.when(F.col("version") != F.col("want"), "VERSION").when(F.coalesce("supersedes", F.lit(0)) != F.col("want") - 1, "SUPERSEDES")
    return report(told.where(code.isNotNull()), "version_chain", code, F.concat_ws("/", F.col("run_id").cast("string"), "artifact_id", F.col("version").cast("string")))


def retry_state(attempts: DataFrame, max_retries: int) -> DataFrame:
    """Per run: attempts used, retries left, and the next state after a failed last attempt."""
    rows = attempts.groupBy("run_id").agg(F.count("*").alias("attempts"), F.max_by("status", F.struct("started_at", "attempt_id")).alias("status"))
    left = F.greatest(F.lit(max_retries) - (F.col("attempts") - 1), F.lit(0))
    return rows.withColumn("retries_left", left).withColumn("next_state", F.when(F.col("status") == "FAILED", F.when(F.col("retries_left") > 0, "RETRY_READY").otherwise("BLOCKED")).otherwise(F.col("status")))


def response_conflicts(answers: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first answer to a question wins; later ones are replays or conflicts."""
    first = F.first("answer_hash").over(Window.partitionBy(*by).orderBy(order))
    n = F.row_number().over(Window.partitionBy(*by).orderBy(order))
    told = answers.withColumn("first", first).withColumn("n", n).where("n > 1")
    return report(told, "response", F.when(F.col("first") == F.col("answer_hash"), "REPLAY").otherwise("CONFLICT"), F.concat_ws("/", *(F.col(c).cast("string") for c in (*by, order))))


def idempotency_audit(requests: DataFrame) -> DataFrame:
    """FIRST, REPLAY or CONFLICT for every request under its key."""
    w = Window.partitionBy("run_id", "key_hash").orderBy("seq")
    same = (F.first("request_hash").over(w) == F.col("request_hash")) & (F.first("operation").over(w) == F.col("operation"))
    return requests.withColumn("outcome", F.when(F.row_number().over(w) == 1, "FIRST").when(same, "REPLAY").otherwise("CONFLICT"))


def version_conflicts(requests: DataFrame, state: DataFrame) -> DataFrame:
    """Change requests whose expected version is not the current one."""
    told = requests.join(state.select("run_id", "state_version"), "run_id").where("expected_version <> state_version")
    return report(told, "state_version", "CONFLICT", F.col("seq"), F.concat_ws("<>", F.col("expected_version").cast("string"), F.col("state_version").cast("string")))


def run_status(attempts: DataFrame) -> DataFrame:
    running, user, external = (F.bool_or(F.col("status") == s) for s in ("RUNNING", "WAITING_FOR_USER", "WAITING_FOR_EXTERNAL"))
    last = F.max_by("status", F.struct("started_at", "attempt_id"))
    return attempts.groupBy("run_id").agg(F.when(running, "RUNNING").when(user, "WAITING_FOR_USER").when(external, "WAITING_FOR_EXTERNAL").otherwise(last).alias("status"))


def slot_usage(attempts: DataFrame, *limits: int) -> DataFrame:
    rows = attempts.groupBy("run_id").agg(F.count_if(F.col("status") == "RUNNING").alias("active"))
    return rows.withColumn("slots", F.greatest(F.lit(min(limits)) - F.col("active"), F.lit(0)))


def dependency_readiness(edges: DataFrame, states: DataFrame) -> DataFrame:
    """Per node: are all its dependencies satisfied, and all resolved? (states: node, status, optional)"""
    st = states.select(F.col("node").alias("depends_on"), "status", "optional")
    told = edges.join(st, "depends_on", "left")
    good = (F.col("status") == "VERIFIED") | ((F.col("status") == "SKIPPED") & F.col("optional"))
    over = F.col("status").isin("VERIFIED", "SKIPPED", "BLOCKED")
    return told.groupBy("node").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("satisfied"), F.bool_and(F.coalesce(over, F.lit(False))).alias("resolved"))


def committed_outside(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Runs whose committed offset their log does not reach."""
    last = log.groupBy("run_id").agg(F.max("log_offset").alias("last"))
    told = commits.join(last, "run_id", "left").where(F.col("last_event_offset") > F.coalesce("last", F.lit(0)))
    return report(told, "event_log", "OFFSET_OUTSIDE_LOG", F.col("run_id"), F.col("last_event_offset"))


def ambiguous_artifacts(artifacts: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries that more than one stored artifact matches, or none."""
    keys = ["run_id", "artifact_id", "version"]
    n = artifacts.groupBy(*keys).agg(F.count("*").alias("n"))
    told = manifest.join(n, keys, "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")
    return report(told, "current_artifact", F.when(F.col("n") == 0, "MISSING").otherwise("AMBIGUOUS"), F.concat_ws("/", *(F.col(k).cast("string") for k in keys)), F.col("n"))


def uncommitted_tail(log: DataFrame, commits: DataFrame) -> DataFrame:
    """Events above the committed offset of their run."""
    return log.join(commits.select("run_id", "last_event_offset"), "run_id").where("log_offset > last_event_offset").drop("last_event_offset")


def fingerprint_reuse(planned: DataFrame, done: DataFrame) -> DataFrame:
    """The latest earlier completed attempt with the same input fingerprint: one window over both, no range join."""
    cols = ["input_fingerprint", "started_at", "attempt_id"]
    rows = planned.select(*cols, F.lit(True).alias("planned")).union(done.select(*cols, F.lit(False).alias("planned")))
    per_time = rows.groupBy("input_fingerprint", "started_at").agg(F.max(F.when(~F.col("planned"), F.col("attempt_id"))).alias("done_id"))
    before = Window.partitionBy("input_fingerprint").orderBy("started_at").rowsBetween(Window.unboundedPreceding, -1)
    known = per_time.withColumn("reuse_of", F.last("done_id", ignorenulls=True).over(before)).select("input_fingerprint", "started_at", "reuse_of")
    return planned.join(known, ["input_fingerprint", "started_at"], "left")


def error_routing(failures: DataFrame, policy: DataFrame, max_retries: int, max_cycles: int) -> DataFrame:
    """Action for each failure (code, attempts, cycles): retry, block, open a gap, or pause."""
    told = failures.join(policy, "code", "left")
    retry = F.when(F.col("attempts") - 1 < max_retries, "RETRY_NODE").otherwise("BLOCK_NODE")
    gap = F.when(F.col("cycles") < max_cycles, "OPEN_RESEARCH_GAP").otherwise("PAUSE_RUN")
    return told.withColumn("routed", F.when(F.col("action") == "RETRY_NODE", retry).when(F.col("action") == "OPEN_RESEARCH_GAP", gap).otherwise(F.coalesce("action", F.lit("UNKNOWN_CODE"))))


def decision_events(decisions: DataFrame, log: DataFrame) -> DataFrame:
    """Decisions that point at an offset their run's log does not have."""
    last = log.groupBy("run_id").agg(F.max("log_offset").alias("last"))
    told = decisions.join(last, "run_id", "left").where("last IS NULL OR event_offset > last OR event_offset < 1")
    return report(told, "decision_event", "OFFSET", F.concat_ws("/", F.col("run_id").cast("string"), F.col("event_offset").cast("string")))


def producer_audit(artifacts: DataFrame, attempts: DataFrame) -> DataFrame:
    """Artifacts whose producing attempt is missing, or not completed.

    Where both tables name a skill or a version these must agree too, and an artifact with a document (doc,
    content_hash) must have its hash, taken without the hash itself. Every broken rule is a row.
    """
    compared = [c for c in ("skill", "version") if c in artifacts.columns and c in attempts.columns]
    hashed = "doc" in artifacts.columns
    if hashed:  # where the documents lie, so that they need not be shuffled
        right = F.coalesce(documents.json_hash(F.col("doc"), "/artifact/content_hash") == F.col("content_hash"), F.lit(False))
        artifacts = artifacts.withColumn("right", right).drop("doc", "content_hash")
    told = artifacts.join(attempts.select("attempt_id", "status", *(F.col(c).alias(f"made_{c}") for c in compared)), "attempt_id", "left")
    known = F.col("status").isNotNull()
    codes = [F.when(~known, "NO_ATTEMPT").when(F.col("status") != "COMPLETED", "NOT_VERIFIED")]
    codes += [F.when(known & ~F.col(c).eqNullSafe(F.col(f"made_{c}")), c.upper()) for c in compared]
    if hashed:
        codes.append(F.when(~F.col("right"), "HASH"))
    return report(told.select("artifact_ref", F.explode(F.array_compact(F.array(*codes))).alias("code")), "producer", F.col("code"), F.col("artifact_ref"))


def path_violations(requested: DataFrame, declared: DataFrame) -> DataFrame:
    """Requested write paths (attempt, path) that lie in no declared one (attempt, prefix).

    A path lies in itself and in every folder above it, so `a/b` holds `a/b/c` and not `a/bc`. Each path is
    taken apart into these, and one equality join finds the declared ones. Unsafe paths lie nowhere.
    """
    told = requested.select("attempt", "path").distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = told.where(core.safe_relative_path("path")).select("attempt", "path", F.explode(above).alias("prefix"))
    inside = held.join(declared.select("attempt", F.regexp_replace("prefix", "/+$", "").alias("prefix")), ["attempt", "prefix"], "left_semi").select("attempt", "path")
    outside = told.join(inside, ["attempt", "path"], "left_anti")
    return report(outside, "permission", "WRITE_PATH", F.col("attempt"), F.col("path"))


def budget_mismatch(requested: DataFrame, planned: DataFrame, limits: list[str]) -> DataFrame:
    """Limits that attempts request and that are not those of their plan: BUDGET_EXCEEDED where the plan has
    a limit and the request a higher one or none, else DIFFERENT. Attempts without a plan are NOT_PLANNED."""
    told = requested.alias("r").join(planned.withColumn("_planned", F.lit(True)).alias("p"), "attempt", "left")
    entries = [F.when(F.col("p._planned").isNull(), F.struct(F.lit("NOT_PLANNED").alias("code"), F.lit("").alias("c")))]
    for c in limits:
        asked, most = F.col(f"r.{c}"), F.col(f"p.{c}")
        code = F.when(most.isNotNull() & (asked.isNull() | (asked > most)), "BUDGET_EXCEEDED").otherwise("DIFFERENT")
        entries.append(F.when(F.col("p._planned").isNotNull() & ~asked.eqNullSafe(most), F.struct(code.alias("code"), F.lit(c).alias("c"))))
    return report(told.select("attempt", F.explode(F.array_compact(F.array(*entries))).alias("v")), "request_budget", F.col("v.code"), F.col("attempt"), F.col("v.c"))


def permission_audit(requests: DataFrame, declared: DataFrame) -> DataFrame:
    """Requested access levels (attempt, kind, level) above the declared ones."""
    told = requests.join(declared.withColumnRenamed("level", "most"), ["attempt", "kind"], "left").where("level > coalesce(most, 0)")
    return report(told, "permission", "EXCEEDED", F.concat_ws("/", "attempt", "kind"), F.col("level"))


def round_limit(turns: DataFrame, most: int = 8) -> DataFrame:
    """Rounds of an attempt run 1..most without a jump."""
    w = Window.partitionBy("attempt").orderBy("round")
    told = turns.withColumn("n", F.row_number().over(w))
    code = F.when(F.col("round") > most, "TOO_MANY").when(F.col("round") != F.col("n"), "JUMP")
    return report(told.where(code.isNotNull()), "round", code, F.concat_ws("/", F.col("attempt").cast("string"), F.col("round").cast("string")))


def gate_to_decision(decisions: DataFrame) -> DataFrame:
    """Latest decision of each gate."""
    return decisions.groupBy("run_id", "gate").agg(F.max_by("decision", "seq").alias("decision"), F.max("seq").alias("seq"))


def interaction_consistency(requests: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Requests and checkpoints of an attempt must name the same method."""
    told = requests.join(checkpoints.withColumnRenamed("method", "held"), "attempt", "left")
    code = F.when(F.col("held").isNull(), "NO_CHECKPOINT").when(F.col("method") != F.col("held"), "METHOD")
    return report(told.where(code.isNotNull()), "interaction", code, F.col("attempt"))


def import_gate(refs: DataFrame, rules: DataFrame) -> DataFrame:
    """Decide old references by rule (source and target version, kind, purpose, safe); no rule and unsafe
    rules reject. Keys that the rules leave out are not asked for."""
    told = refs.join(rules, [k for k in ("source_version", "target_version", "kind", "purpose") if k in rules.columns], "left")
    return told.withColumn("decision", F.when(F.col("safe").isNull(), "REJECT_NO_RULE").when(~F.col("safe"), "REJECT_UNSAFE").otherwise("ACCEPT")).drop("safe")


def subgraph_complete(members: DataFrame, by: str, done: Column) -> DataFrame:
    """(by, complete): whether every member of a subgraph is done; an unknown state is not."""
    return members.groupBy(by).agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("complete"))


def error_metadata_check(errors: DataFrame, policy: DataFrame, key: Column) -> DataFrame:
    """Errors (code, reported) whose reported action is not the policy's (code, action) of a known code.

    Of recoverable, attempt_cost and cycle_cost those are compared as well that both tables have, in the
    errors as reported_<name>. One row for each difference.
    """
    pairs = {"action": "reported"} | {c: f"reported_{c}" for c in ("recoverable", "attempt_cost", "cycle_cost") if c in policy.columns and f"reported_{c}" in errors.columns}
    told = errors.join(policy.select("code", *pairs), "code")
    broken = F.array_compact(F.array(*(F.when(~F.col(r).eqNullSafe(F.col(c)), c.upper()) for c, r in pairs.items())))
    bad = told.select(key.alias("_key"), "code", F.explode(broken).alias("_what"))
    return report(bad, "error_metadata", F.col("_what"), F.col("_key"), F.col("code"))


def checkpoint_growth(checkpoints: DataFrame) -> DataFrame:
    """Checkpoints (attempt, round, version) whose version is not one more than that of the round before; the
    first version is 1."""
    before = F.lag("version", 1, 0).over(Window.partitionBy("attempt").orderBy("round", "version"))
    told = checkpoints.withColumn("want", before + 1).where(~F.col("version").eqNullSafe(F.col("want")))
    return report(told, "checkpoint_version", "GROWTH", F.concat_ws("/", F.col("attempt").cast("string"), F.col("round").cast("string")), F.col("version"))


def corrupt_keys(records: DataFrame) -> DataFrame:
    """Idempotency keys (run_id, key_hash) with more than one stored record."""
    n = records.groupBy("run_id", "key_hash").agg(F.count("*").alias("n")).where("n > 1")
    return report(n, "idempotency", "CORRUPT", F.concat_ws("/", F.col("run_id").cast("string"), "key_hash"), F.col("n"))
