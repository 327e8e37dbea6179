"""Lineage over an edge table (node, depends_on): impact, cycles, and states after a change.

Loops (see reach) write each round to the shared folder, so a lost executor costs one round; the driver
sees one row a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators import reach
from factloom.operators.violations import report


def downstream_impact(edges: DataFrame, roots: DataFrame, include_roots: bool = False) -> DataFrame:
    """All nodes that depend on a root, directly or not."""
    found = reach.reached(reach.arcs_of(edges), roots, labelled=False)[0].select("node")
    own = roots.select("node").where("node IS NOT NULL").distinct()
    return found.union(own).distinct() if include_roots else found.hint("merge").join(own, "node", "left_anti")


def impact_by_root(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): the nodes that depend on each root, directly or not."""
    return reach.reached(reach.arcs_of(edges), roots)[0]


def cycle_members(edges: DataFrame) -> DataFrame:
    """(node, cycle) of the nodes on a cycle; a cycle is named by its least node."""
    return reach.strong_cycles(edges)[0]


def cycle_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on a cycle or behind one."""
    return downstream_impact(edges, cycle_members(edges), include_roots=True)


def cycle_violations(edges: DataFrame) -> DataFrame:
    """A violation for each node on a cycle, which names the cycle."""
    return report(cycle_members(edges), "dag_cycle", "CYCLE", F.col("node"), F.col("cycle"))


def impact_blocked(impact: DataFrame, attempts: DataFrame) -> DataFrame:
    """Running attempts (attempt_id, node, status) on affected nodes forbid the change."""
    bad = attempts.where("status = 'RUNNING'").join(impact.select("node"), "node", "left_semi")
    return report(bad, "impact", "RUNNING_ATTEMPT", F.col("attempt_id"), F.col("node"))


def affected_artifact_types(impact: DataFrame, outputs: DataFrame) -> DataFrame:
    return outputs.join(impact.select("node"), "node", "left_semi").groupBy("artifact_type").agg(F.count_distinct("node").alias("nodes"))


def apply_invalidation(states: DataFrame, impact: DataFrame) -> DataFrame:
    """States (node, status, state_version) with affected nodes INVALIDATED in the next version."""
    told = states.join(impact.select("node", F.lit(True).alias("hit")), "node", "left")
    hit = F.coalesce("hit", F.lit(False))
    return told.select("node", F.when(hit, "INVALIDATED").otherwise(F.col("status")).alias("status"), (F.col("state_version") + hit.cast("long")).alias("state_version"))


def dangling_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    unknown = edges.join(nodes.select(F.col("node").alias("depends_on")), "depends_on", "left_anti")
    return report(unknown, "dependency", "UNKNOWN", F.col("node"), F.col("depends_on")).union(report(edges.where("node = depends_on"), "dependency", "SELF", F.col("node"), F.col("depends_on")))


def input_refs(edges: DataFrame, outputs: DataFrame) -> DataFrame:
    """Sorted distinct artifacts of each node's direct dependencies."""
    told = edges.join(outputs.select(F.col("node").alias("depends_on"), "artifact_ref"), "depends_on")
    return told.groupBy("node").agg(F.sort_array(F.collect_set("artifact_ref")).alias("input_refs"))


def retry_plan_reset(edges: DataFrame, roots: DataFrame, instances: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes to run again with the retried roots, and fan-out instances of other branches that stay."""
    impact = downstream_impact(edges, roots, include_roots=True)
    return impact, instances.join(impact, "node", "left_anti")


def insert_between(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Put nodes (node, after, before) on edges: `before` then depends on the new node, and it on `after`."""
    gone = edges.join(new.select(F.col("before").alias("node"), F.col("after").alias("depends_on")), ["node", "depends_on"], "left_anti")
    return gone.union(new.select("node", F.col("after"))).union(new.select(F.col("before"), "node"))
