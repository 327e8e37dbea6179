"""Graph loops and JSON documents against plain Python."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import core, documents
from factloom.operators import bindings, lineage, provenance, reach

EDGES = "node long, depends_on long"


def reach_sets(edges):
    after = {}
    for node, before in edges:
        after.setdefault(before, set()).add(node)
        after.setdefault(node, set())
    found = {}
    for start in after:
        seen, todo = set(), list(after[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += after[x]
        found[start] = seen
    return found


@pytest.mark.parametrize("seed", [0, 1])
def test_cycles_and_impact(spark, seed):
    """Branches, rings, loops and chains that hang between them."""
    rng = random.Random(seed)
    edges = {(rng.randrange(30), rng.randrange(30)) for _ in range(33)} | {(101 + i, 100 + i) for i in range(15)} | ({(100, 115)} if seed else {(3, 115), (100, 4), (7, 7)})
    df = spark.createDataFrame([*edges, (None, 3), (9, None)], EDGES)
    reached = reach_sets(edges)
    cycle = {v: min(u for u in reached[v] if v in reached[u]) for v in reached if v in reached[v]}
    assert {r.node: r.cycle for r in lineage.cycle_members(df).collect()} == cycle
    assert {r.node for r in lineage.cycle_nodes(df).collect()} == set(cycle) | {u for v in cycle for u in reached[v]}
    roots = spark.createDataFrame([(0,), (3,), (100,), (3,), (999,), (None,)], "node long")
    assert {(r.root, r.node) for r in lineage.impact_by_root(df, roots).collect()} == {(a, b) for a in (0, 3, 100) for b in reached.get(a, ())}


def test_long_chain_in_few_rounds(spark):
    n = 10_000
    chain = spark.range(1, n).selectExpr("id + 1 AS node", "id AS depends_on")
    pairs, rounds = reach.reached(reach.arcs_of(chain), spark.createDataFrame([(9_000,)], "node long"))
    assert pairs.count() == 1_000 and rounds < 20
    members, rounds = reach.strong_cycles(chain.union(spark.createDataFrame([(1, n)], EDGES)))
    assert members.where("cycle = 1").count() == n and rounds < 20


def test_no_edges(spark):
    empty = spark.createDataFrame([], EDGES)
    assert lineage.cycle_nodes(empty).count() == 0
    assert [r.node for r in lineage.downstream_impact(empty, spark.createDataFrame([(1,)], "node long"), True).collect()] == [1]


NUMBERS = [0, -7, 10**25, 1.0, 0.1, 1e16, 1e15, 123456.789, 1e-4, 9.9e-5, 2e23, 2e-3, 1e22, 5e-324, 1.7976931348623157e308, -0.0, 100.0, 0.5, 0.00012, 7.25]
NAMES = ["a", "b", "Z", "é", "😀", "豈", "a/b", "m~n", "", "1", "0", "q'\"s", "\x02", "퟿"]


def some_value(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.5:
        return rng.choice([None, True, False, "", 'a"b\\c\n\t\x01\x1f\x7f/é😀', "~/", "#null", "$x", *NUMBERS])
    if kind < 0.75:
        return [some_value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(NAMES): some_value(rng, depth + 1) for _ in range(rng.randint(0, 5))}


def canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def pointers(value, at=""):
    yield at, canonical(value)
    for k, x in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from pointers(x, f"{at}/{str(k).replace('~', '~0').replace('/', '~1')}")


def test_canonical_json(spark):
    rng = random.Random(4)
    values = [some_value(rng) for _ in range(250)]
    rows = [(json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])), canonical(v)) for v in values]
    rows += [("1e2", "100.0"), ("-0", "0"), ('"\\u0041\\/"', '"A/"'), ("[" * 30 + "]" * 30, "[" * 30 + "]" * 30), ('{"n":12345678901234567890123, "f":1.10}', '{"f":1.1,"n":12345678901234567890123}')]
    rows += [(bad, None) for bad in ("", " ", "nope", '{"a":1,"a":2}', "[1,]", None, "{'a':1}")]
    df = spark.createDataFrame(rows, "doc string, want string")
    assert df.where(~documents.canonical_json(F.col("doc")).eqNullSafe(F.col("want"))).collect() == []
    told = [(rows[i][0], p, text) for i, v in enumerate(values) for p, text in pointers(v) if p]
    df = spark.createDataFrame(told, "doc string, pointer string, want string")
    assert df.where(~documents.value_at(F.col("doc"), F.col("pointer")).eqNullSafe(F.col("want"))).collect() == []


def test_pointers_that_lead_nowhere(spark):
    doc = '{"a/b": [1, {"0": "x"}], "": {"~": null}, "s": "{\\"k\\": 1}", "00": 1}'
    nowhere = ["", "a", "/a~2", "/a~", "/no", "/a~1b/00", "/a~1b/-", "/a~1b/2", "/a~1b/0/x", "/s/k", "/a~1b/1/1", "/a~1b/99999999999", None]
    rows = [(p, None) for p in nowhere] + [("/", '{"~":null}'), ("//~0", "null"), ("/00", "1"), ("/a~1b/1/0", '"x"')]
    got = spark.createDataFrame(rows, "p string, want string").select("p", "want", documents.value_at(F.lit(doc), F.col("p")).alias("x"), core.json_pointer(F.lit(doc), F.col("p")).cast("string").alias("v")).collect()
    assert all(r.x == r.want for r in got) and {r.p: r.v for r in got}["/a~1b/1/0"] == "x"


def test_hash_without_a_field(spark):
    a, b = '{"artifact": {"content_hash": "x", "id": 1}, "z": {"artifact": {"content_hash": 2}}}', '{"z": {"artifact": {"content_hash": 2}}, "artifact": {"id": 1}}'
    row = spark.range(1).select(documents.json_hash(F.lit(a), "/artifact/content_hash").alias("a"), documents.json_hash(F.lit(b)).alias("b"), documents.json_hash(F.lit("[1]"), "/artifact/content_hash").alias("c"), documents.json_hash(F.lit("[1]")).alias("d")).first()
    assert row.a == row.b and row.c == row.d


def test_binding_audit(spark):
    """A current document that is missing or broken, repeated links, and nulls."""
    docs = spark.createDataFrame([("A@1", '{"x": 1}'), ("B@1", "broken")], "artifact_ref string, doc string")
    current = spark.createDataFrame([("A@1",), ("B@1",), ("C@1",)], "artifact_ref string")
    rows = [(i, None, ref, p, h) for i, (ref, p, h) in enumerate([("A@1", "/x", "sha256:0"), ("B@1", "/x", "h"), ("C@1", "/x", "h"), ("A@0", "/x", "h"), ("A@1", None, "h"), (None, "/x", None)])]
    held = spark.createDataFrame(rows, "key long, fact_id string, origin_artifact_ref string, origin_field_pointer string, content_hash string")
    got = {(r.key, r.rule, r.code) for r in bindings.origin_violations(held, current, docs).where("rule <> 'fact_binding_identity'").collect()}
    assert got == {("0", "fact_binding_hash", "CONTENT"), ("1", "fact_binding_pointer", "UNRESOLVED"), ("2", "fact_binding_pointer", "UNRESOLVED"), ("3", "fact_binding_origin", "NOT_CURRENT"), ("4", "fact_binding_pointer", "INVALID"), ("5", "fact_binding_origin", "NOT_CURRENT")}
    assert bindings.origin_violations(held, current, docs).where("rule = 'fact_binding_identity'").count() == 6


def test_sets_meet_in_one_aggregate(spark):
    """Repeats and nulls count as in EXCEPT, and no side is sorted for a join."""
    schema = "key string, member string"
    left = spark.createDataFrame([("a", "x"), ("a", "x"), ("a", None), (None, "y"), ("b", "z"), ("c", None)], schema)
    right = spark.createDataFrame([("a", "x"), ("a", None), (None, "y"), ("b", "w"), ("b", "w"), (None, None)], schema)
    told = provenance.set_equality(left, right, "sets")
    assert sorted((r.code, r.key or "-", r.detail or "-") for r in told.collect()) == [("EXTRA", "-", "-"), ("EXTRA", "b", "w"), ("MISSING", "b", "z"), ("MISSING", "c", "-")]
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan


def test_documents_of_bindings_are_sorted_once(spark):
    """Documents and current refs are dealt once; a ref that repeats, with and without a document, has one."""
    docs = spark.createDataFrame([("A@1", None), ("A@1", '{"x": 1}'), ("B@1", '{"x": 1}')], "artifact_ref string, doc string")
    current = spark.createDataFrame([("A@1",), ("A@1",), (None,)], "artifact_ref string")
    held = spark.createDataFrame([(1, "f", "A@1", "/x", "h"), (2, "f", "B@1", "/x", "h"), (3, "f", None, "/x", "h")], "key long, fact_id string, origin_artifact_ref string, origin_field_pointer string, content_hash string")
    told = bindings.origin_violations(held, current, docs).where("rule <> 'fact_binding_identity'")
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert sorted((r.key, r.code) for r in told.collect()) == [("1", "CONTENT"), ("2", "NOT_CURRENT"), ("3", "NOT_CURRENT")]


def test_deep_and_long_documents(spark):
    """Whole numbers of any length, half a surrogate pair, and depth that is no document."""
    rows = [("[" * 900 + "]" * 900,) * 2, ("-" + "9" * 5000,) * 2, ('"\\ud800é"', '"?é"'), ("[" * 60_000, None), ("[" * 60_000 + "]" * 60_000, None), ("NaN", None), ("-Infinity", None), ("[1e999,-0.0]", "[Infinity,-0.0]")]
    df = spark.createDataFrame(rows, "doc string, want string")
    assert df.where(~documents.canonical_json(F.col("doc")).eqNullSafe(F.col("want"))).collect() == []


def test_canonical_json_takes_few_expressions(spark):
    """Documents are read in batches of Arrow, in a plan of a size that codegen can compile."""
    doc = spark.range(1).select(F.lit('{"b":1e2,"a":null}').alias("doc"))
    told = doc.select(documents.json_hash(F.col("doc"), "/b").alias("hash"), documents.value_at(F.col("doc"), F.lit("/b")).alias("b"))
    plan = told._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and len(plan) < 5_000 and told.first().b == "100.0"


def test_loops_send_no_table_through_the_driver(spark):
    """Small files may hold many rows: no join of a loop is a broadcast."""
    edges = spark.range(2, 300).selectExpr("id AS node", "id DIV 2 AS depends_on").union(spark.createDataFrame([(1, 299)], EDGES))
    roots = spark.createDataFrame([(3,), (7,)], "node long")
    for told in (lineage.impact_by_root(edges, roots), lineage.cycle_members(edges), lineage.downstream_impact(edges, roots)):
        assert "Broadcast" not in told._jdf.queryExecution().executedPlan().toString()
