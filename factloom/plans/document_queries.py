"""Queries on JSON documents and the facts bound to their fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import core, documents
from factloom.operators import bindings
from factloom.plans.registry import query

_NAME = "'\"name\":\"café ' || priority || '\"'"
_METRICS = """'"metrics":{"rate":1.5,"stars":' || stars || ',"tags":["a",{"b":"' || state || '","z":null}]}'"""
_DEEP = '"m~n":{"d":{"c":{"x":12345678901234567890,"y":-0.0}}}'
_WHOLE = f"""'{{"a/b":100.0,"artifact":{{"content_hash":"old","id":"A"}},' || {_METRICS} || ',{_DEEP},' || {_NAME} || '}}'"""
_BARE = f"""'{{"a/b":100.0,"artifact":{{"id":"A"}},' || {_METRICS} || ',{_DEEP},' || {_NAME} || '}}'"""


@query("canonical_json", f"SELECT k, {_WHOLE} AS canonical, 'sha256:' || sha256({_WHOLE}) AS hash, 'sha256:' || sha256({_BARE}) AS content_hash, true AS same FROM v_json_docs")
def _(v):
    rows = v("v_json_docs")
    # the same names in another order, and one number and one character written differently
    other = F.replace(F.replace(F.concat(F.lit('{"name": "café '), "priority", F.lit('", '), F.substring("doc", 2, 10_000)), F.lit('"a/b": 1e2'), F.lit('"a/b": 100.0')), F.concat(F.lit(', "name": "caf\\u00e9 '), "priority", F.lit('"')), F.lit(""))
    doc = F.col("doc")
    hashes = rows.select("k", documents.canonical_json(doc).alias("canonical"), documents.json_hash(doc, without="/artifact/content_hash").alias("content_hash"), documents.json_hash(other).alias("other"))
    told = hashes.withColumn("hash", documents.text_hash(F.col("canonical")))
    return told.select("k", "canonical", "hash", "content_hash", (F.col("hash") == F.col("other")).alias("same"))


@query("json_pointer_by_row", "SELECT k, origin_field_pointer AS pointer, CASE WHEN k % 10 < 5 THEN content END AS text FROM v_bindings")
def _(v):
    told = v("v_bindings").select("k", F.col("origin_field_pointer").alias("pointer")).join(v("v_json_docs").select("k", "doc"), "k")
    return told.select("k", "pointer", documents.value_at(F.col("doc"), F.col("pointer")).alias("text"))


@query("binding_id", "SELECT DISTINCT k, 'FACT-COMP-' || upper(substr(SHA256(origin_artifact_ref || chr(0) || origin_field_pointer || chr(0) || content_hash), 1, 20)) AS id FROM v_bindings")
def _(v):
    return v("v_bindings").select("k", core.competitor_fact_id(F.col("origin_artifact_ref"), F.col("origin_field_pointer"), F.col("content_hash")).alias("id"))


@query(
    "fact_binding_audit",
    """WITH b AS (SELECT *, k % 41 = 3 AS gone, k % 10 AS p, 'FACT-COMP-' || upper(substr(SHA256(origin_artifact_ref || chr(0) || origin_field_pointer || chr(0) || content_hash), 1, 20)) AS derived FROM v_bindings),
    claims AS (SELECT DISTINCT key, ref FROM v_binding_links WHERE kind = 'claim'), ev AS (SELECT DISTINCT key, ref FROM v_binding_links WHERE kind = 'evidence'), src AS (SELECT DISTINCT key, ref FROM v_binding_links WHERE kind = 'source'),
    want_ev AS (SELECT c.key, e.id AS ref FROM claims c JOIN v_evidence e ON e.claim_id = c.ref), want_src AS (SELECT DISTINCT x.key, e.source_id AS ref FROM ev x JOIN v_evidence e ON e.id = x.ref)
    SELECT 'fact_binding_origin' AS rule, 'NOT_CURRENT' AS code, key, origin_artifact_ref AS detail FROM b WHERE gone
    UNION ALL SELECT 'fact_binding_pointer', CASE WHEN p >= 7 THEN 'INVALID' ELSE 'UNRESOLVED' END, key, origin_field_pointer FROM b WHERE NOT gone AND p >= 5
    UNION ALL SELECT 'fact_binding_hash', 'CONTENT', key, 'sha256:' || sha256(content) FROM b WHERE NOT gone AND p < 5 AND k % 23 = 1
    UNION ALL SELECT 'fact_binding_identity', 'DERIVATION', key, derived FROM b WHERE k % 29 = 2
    UNION ALL SELECT 'fact_binding_claim_ref', 'UNKNOWN_CLAIM', key, ref FROM claims WHERE ref NOT IN (SELECT id FROM v_claims)
    UNION ALL SELECT 'fact_binding_evidence_ref', 'MISSING', key, ref FROM (SELECT * FROM want_ev EXCEPT SELECT * FROM ev)
    UNION ALL SELECT 'fact_binding_evidence_ref', 'EXTRA', key, ref FROM (SELECT * FROM ev EXCEPT SELECT * FROM want_ev)
    UNION ALL SELECT 'fact_binding_source_ref', 'MISSING', key, ref FROM (SELECT * FROM want_src EXCEPT SELECT * FROM src)
    UNION ALL SELECT 'fact_binding_source_ref', 'EXTRA', key, ref FROM (SELECT * FROM src EXCEPT SELECT * FROM want_src)
    UNION ALL SELECT 'fact_binding_source_ref', 'UNKNOWN_SOURCE', key, ref FROM src WHERE ref NOT IN (SELECT id FROM v_sources)""",
)
def _(v):
    docs = v("v_json_docs").select("artifact_ref", "doc")
    return bindings.binding_audit(v("v_bindings"), v("v_binding_links"), docs.select("artifact_ref"), docs, v("v_claims"), v("v_evidence"), v("v_sources"))
