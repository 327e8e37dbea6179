"""Scalar functions over the driver's tables, with SQL that shares no view with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import core
from factloom.operators import runs
from factloom.plans.registry import query


def _orders(v, **columns):
    return v.table("orders").select(F.col("o_orderkey").alias("k"), *(c.alias(n) for n, c in columns.items()))


_STATUS = "'sha256:' || sha256('{{\"key\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}}')"


@query("canonical_value_hash", f"SELECT o_orderkey AS k, {_STATUS.format()} AS hash FROM orders")
def _(v):
    return _orders(v, hash=core.canonical_value_hash(status=F.col("o_orderstatus"), key=F.col("o_orderkey")))


@query("artifact_content_hash", f"SELECT o_orderkey AS k, {_STATUS.format()} AS hash FROM orders")
def _(v):
    return _orders(v, hash=core.artifact_content_hash(status=F.col("o_orderstatus"), content_hash=F.lit("old"), key=F.col("o_orderkey")))


@query("artifact_ref", "SELECT o_orderkey AS k, 'ART-' || o_custkey || '@' || (o_orderkey % 9) AS ref, 'ART-' || o_custkey AS artifact_id, CAST(o_orderkey % 9 AS INTEGER) AS version FROM orders")
def _(v):
    rows = _orders(v, ref=core.artifact_ref(F.concat(F.lit("ART-"), F.col("o_custkey").cast("string")), F.col("o_orderkey") % 9))
    artifact, version = core.parse_artifact_ref(F.col("ref"))
    return rows.select("k", "ref", artifact.alias("artifact_id"), version.alias("version"))


@query("normalize_label", "SELECT c_custkey AS k, lower(c_mktsegment) AS label FROM customer")
def _(v):
    return v.table("customer").select(F.col("c_custkey").alias("k"), core.normalize_label(F.concat(F.lit(" \t"), F.upper("c_mktsegment"), F.lit(" \n"))).alias("label"))


@query("reliability", "SELECT o_orderkey AS k, CASE o_orderkey % 5 WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS reliability FROM orders")
def _(v):
    return _orders(v, reliability=core.reliability(F.col("o_orderkey") % 5))


_FRESH = "CASE o_orderstatus WHEN 'F' THEN 'FRESH' WHEN 'O' THEN 'STALE' ELSE 'UNKNOWN' END"


@query("freshness_label", "SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'low' ELSE 'unknown' END AS label FROM orders")
def _(v):
    return _orders(v, label=core.freshness_label(F.expr(_FRESH)))


@query("quantize6", "SELECT o_orderkey AS k, round_even(o_orderkey / 128.0::DOUBLE, 6) AS x FROM orders")
def _(v):
    return _orders(v, x=core.quantize6(F.col("o_orderkey") / F.lit(128.0)))


@query("to_utc", "SELECT o_orderkey AS k, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST(o_orderkey % 1000 - 5 AS INTEGER)), '%Y-%m-%d %H:%M:%S') AS at FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 7 = 0")
def _(v):
    text = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (F.col("o_orderkey") % 1000) * 3600), "yyyy-MM-dd'T'HH:mm:ss")
    stamp = core.to_utc(F.when(F.col("o_orderkey") % 7 == 0, "no date").otherwise(F.concat(text, F.lit("+05:00"))))
    return _orders(v, at=F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"))


@query("min_present", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey WHEN o_custkey < o_orderkey THEN o_custkey ELSE o_orderkey END AS least FROM orders")
def _(v):
    return _orders(v, least=core.min_present(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey")), F.col("o_custkey")))


@query("display_value", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE CAST(o_custkey AS STRING) END AS shown FROM orders")
def _(v):
    return _orders(v, shown=core.display_value(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))))


@query("feature_statement", "SELECT o_orderkey AS k, o_orderpriority || ' covers ' || format('{:.1f}', (o_orderkey % 9) * 12.5) || '% of the feature taxonomy.' AS statement FROM orders")
def _(v):
    return _orders(v, statement=core.feature_statement(F.col("o_orderpriority"), (F.col("o_orderkey") % 9) / F.lit(8.0)))


_KINDS = "['market', 'technical', 'solution', 'problem'][1 + o_orderkey % 4]"


@query("question_bucket", f"SELECT o_orderkey AS k, CASE {_KINDS} WHEN 'market' THEN 'market' WHEN 'technical' THEN 'technology' WHEN 'solution' THEN 'competitors' ELSE 'users' END AS bucket FROM orders")
def _(v):
    return _orders(v, bucket=core.question_bucket(F.expr("element_at(array('market', 'technical', 'solution', 'problem'), CAST(1 + o_orderkey % 4 AS INT))")))


@query("source_tier", "SELECT o_orderkey AS k, CAST(CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 END AS INTEGER) AS tier FROM orders")
def _(v):
    return _orders(v, tier=core.source_tier(F.expr("element_at(array('filing', 'paper', 'reddit', 'blog', 'aggregator', 'rumour'), CAST(1 + o_orderkey % 6 AS INT))")))


@query("freshness_status", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'UNKNOWN' WHEN o_orderkey % 100 > CASE o_orderkey % 3 WHEN 0 THEN 7 WHEN 1 THEN 30 ELSE 365 END THEN 'STALE' ELSE 'FRESH' END AS status FROM orders")
def _(v):
    kind = F.expr("element_at(array('github_metrics', 'pricing', 'market_reports'), CAST(1 + o_orderkey % 3 AS INT))")
    seen = F.when(F.col("o_orderkey") % 5 != 0, F.date_sub(F.lit("2024-06-01").cast("date"), (F.col("o_orderkey") % 100).cast("int")))
    return _orders(v, status=core.freshness_status(kind, seen, F.lit("2024-06-01").cast("date")))


@query("chart_group_id", "SELECT o_orderkey AS k, 'FG-CHART-' || CASE o_orderkey % 2 WHEN 0 THEN 'BAR' ELSE 'FEATURE-HEATMAP' END AS id FROM orders")
def _(v):
    return _orders(v, id=core.chart_group_id(F.when(F.col("o_orderkey") % 2 == 0, "bar").otherwise("feature_heatmap")))


@query("temporal_name", "SELECT o_orderkey AS k, o_orderkey % 3 = 1 AS temporal FROM orders")
def _(v):
    return _orders(v, temporal=core.temporal_name(F.expr("element_at(array('stars', 'Star_GROWTH_90d', 'price'), CAST(1 + o_orderkey % 3 AS INT))")))


@query("evidence_type", "SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 < 3 THEN 'quantitative' ELSE 'qualitative' END AS type FROM orders")
def _(v):
    return _orders(v, type=core.evidence_type(F.expr("element_at(array('feature', 'traction', 'review', 'pricing'), CAST(1 + o_orderkey % 4 AS INT))")))


_DOC = """CAST('{"a/b":' || o_custkey || ',"m~n":[' || o_orderkey || ',{"0":"' || o_orderstatus || '"}],"1":[[' || o_custkey || ']]}' AS JSON)"""
_POINTERS = {"slash": "/a~1b", "item": "/m~0n/0", "name": "/m~0n/1/0", "deep": "/1/0/0", "end": "/m~0n/2", "below": "/a~1b/x"}


@query("json_pointer", f"SELECT o_orderkey AS k, {', '.join(f'json_extract_string({_DOC}, {p!r}) AS {n}' for n, p in _POINTERS.items())}, CAST(NULL AS STRING) AS zeros FROM orders")
def _(v):
    doc = F.concat(F.lit('{"a/b":'), F.col("o_custkey"), F.lit(',"m~n":['), F.col("o_orderkey"), F.lit(',{"0":"'), F.col("o_orderstatus"), F.lit('"}],"1":[['), F.col("o_custkey"), F.lit("]]}"))
    return _orders(v, **{n: core.json_pointer(doc, p).cast("string") for n, p in (_POINTERS | {"zeros": "/m~0n/00"}).items()})


@query(
    "input_fingerprint",
    """SELECT o_orderkey AS k, 'sha256:' || sha256('{"budget":{"cost_limit":null,"max_sources":50,"timeout_minutes":' || o_orderkey % 20 || ',"token_limit":9000},"input_artifact_refs":'
       || to_json(list_sort(list_distinct(['ART-' || o_custkey || '@1', 'ART-' || o_custkey % 7 || '@2', 'ART-' || o_custkey || '@1'])))
       || ',"permissions":{"external_access":"READ","secrets":false,"workspace_write_paths":["a","b"]},"profile_ref":"p@1","relevant_config":{"order":["z","' || o_orderstatus || '"]},"research_contract_ref":null,"skill_ref":"s@3"}') AS fingerprint FROM orders""",
)
def _(v):
    own = F.concat(F.lit("ART-"), F.col("o_custkey").cast("string"), F.lit("@1"))
    refs = F.array(own, F.concat(F.lit("ART-"), (F.col("o_custkey") % 7).cast("string"), F.lit("@2")), own)
    permissions = {"external_access": F.lit("READ"), "secrets": F.lit(False), "workspace_write_paths": F.array(F.lit("b"), F.lit("a"), F.lit("b"))}
    budget = {"cost_limit": F.lit(None).cast("double"), "max_sources": F.lit(50), "timeout_minutes": F.col("o_orderkey") % 20, "token_limit": F.lit(9000)}
    config = F.struct(F.array(F.lit("z"), F.col("o_orderstatus")).alias("order"))
    return _orders(v, fingerprint=core.input_fingerprint(F.lit("s@3"), refs, F.lit("p@1"), F.lit(None).cast("string"), config, permissions, budget))


_LIST = ["PENDING", "READY", "RUNNING", "WAITING_FOR_USER", "APPROVED", "WAITING_FOR_EXTERNAL", "COMPLETED", "CREATED", "PAUSED", "FAILED"]
_ALL_MOVES = ", ".join(f"('{k}', '{a}', '{b}')" for k, moves in runs.MOVES.items() for a, bs in moves.items() for b in bs)


@query(
    "illegal_transitions_by_kind",
    f"""WITH m AS (SELECT * FROM (VALUES {_ALL_MOVES}) AS t(kind, a, b)),
    s AS (SELECT l_partkey AS p, l_orderkey * 10 + l_linenumber AS o, {sorted(runs.MOVES)}[1 + l_partkey % {len(runs.MOVES)}] AS kind, {_LIST}[1 + (l_orderkey * 7 + l_linenumber * 3) % {len(_LIST)}] AS status FROM lineitem),
    t AS (SELECT *, lag(status) OVER (PARTITION BY p ORDER BY o) AS before FROM s)
    SELECT 'transition' AS rule, 'ILLEGAL' AS code, CAST(p AS STRING) || '/' || CAST(o AS STRING) AS key, before || '>' || status AS detail
    FROM t LEFT JOIN m ON m.kind = t.kind AND m.a = t.before AND m.b = t.status WHERE before IS NOT NULL AND before <> status AND m.a IS NULL""",
)
def _(v):
    kind = F.element_at(F.array(*map(F.lit, sorted(runs.MOVES))), (1 + F.col("l_partkey") % len(runs.MOVES)).cast("int"))
    status = F.element_at(F.array(*map(F.lit, _LIST)), (1 + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % len(_LIST)).cast("int"))
    log = v.table("lineitem").select(F.col("l_partkey").alias("p"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"), kind.alias("kind"), status.alias("status"))
    return runs.illegal_transitions(log, ["p"], "o", runs.MOVES, "kind")
