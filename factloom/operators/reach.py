"""Reachability and cycles of a directed graph, as rounds of joins over written tables.

Arcs are (a, b): b comes after a. Long chains are what makes rounds many, so nodes with one way in and one
way out are first contracted by pointer jumping: a chain of n nodes becomes one arc in log n rounds, and its
inner nodes are added to the result by one join at the end. No table of all pairs is made.

A written table is small in its file and large in its rows, so a planner that goes by the file sends it through
the driver to every task. All joins here are asked to merge, and only counts of a round reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.sources.scratch import dropped, written


def arcs_of(edges: DataFrame) -> DataFrame:
    """(a, b) of an edge table (node, depends_on), each once; edges without an end are left out."""
    return edges.select(F.col("depends_on").alias("a"), F.col("node").alias("b")).where("a IS NOT NULL AND b IS NOT NULL").distinct()


def contracted(arcs: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Arcs with every chain replaced by one, its inner nodes, bare rings, and the rounds that took.

    `arcs` is distinct, without loops. A chain node has one way in and one way out and is not in `keep`.
    Returns (a, b) arcs, among them loops where a chain leaves a node and comes back; (node, a, b) of the
    nodes inside a chain from a to b; (node, ring) of rings without any other way in or out, named by their
    least node.
    """
    ends = arcs.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("i"), F.lit(1).alias("o"), F.lit(None).alias("before"), F.col("b").alias("after"))
    ends = ends.union(arcs.select("b", F.lit(1).cast("long"), F.lit(0), F.col("a"), F.lit(None)))
    degrees = ends.groupBy("node").agg(F.count("i").alias("i"), F.sum("o").alias("o"), F.max("before").alias("before"), F.max("after").alias("after"))
    chain = degrees.where("i = 1 AND o = 1").select("node", "before", "after")
    if keep is not None:
        chain = chain.hint("merge").join(keep.select("node"), "node", "left_anti")
    chain = written(chain)
    inside = chain.select(F.col("node").alias("before"), F.lit(True).alias("inside"))
    # each chain node points to one before it; a head points to itself
    at = written(chain.hint("merge").join(inside, "before", "left").select("node", F.coalesce(F.when(F.col("inside"), F.col("before")), F.col("node")).alias("at"), F.col("inside").isNull().alias("done"), F.col("node").alias("least")))
    rounds, left, told = 0, -1, None
    while True:
        open_rows = at.where("NOT done").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", "least")).alias("told")).first()
        if not open_rows.n or (open_rows.n, open_rows.told) == (left, told):
            break
        left, told = open_rows.n, open_rows.told
        ahead = at.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("done").alias("there"), F.col("least").alias("further"))
        moved = at.where("NOT done").hint("merge").join(ahead, "at").select("node", F.col("to").alias("at"), F.col("there").alias("done"), F.least("least", "further").alias("least"))
        jumped = written(at.where("done").unionByName(moved))
        dropped(at)
        at, rounds = jumped, rounds + 1
    rings = at.where("NOT done").select("node", F.col("least").alias("ring"))
    of = at.where("done").select("node", F.col("at").alias("head"))
    heads = chain.hint("merge").join(of.where("node = head").select("node"), "node", "left_semi").select(F.col("node").alias("head"), F.col("before").alias("a"))
    tails = chain.hint("merge").join(inside.select(F.col("before").alias("after")), "after", "left_anti").select("node", F.col("after").alias("b"))
    spans = written(of.hint("merge").join(tails, "node").select("head", "b").hint("merge").join(heads, "head"))
    inner = of.hint("merge").join(spans, "head").select("node", "a", "b")
    plain = arcs.hint("merge").join(chain.select(F.col("node").alias("a")), "a", "left_anti").hint("merge").join(chain.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b")
    return plain.union(spans.select("a", "b")).distinct(), inner, rings, rounds


def reached(arcs: DataFrame, roots: DataFrame, labelled: bool = True) -> tuple[DataFrame, int]:
    """(root, node) for every node that a root reaches by one arc or more, and the rounds that took.

    Work and rows follow the result: each round joins the newest pairs only, over arcs whose chains are
    contracted. A root reaches itself only over a cycle. Without labels each node comes once, under a root
    of no meaning.
    """
    roots = written(roots.select("node").where("node IS NOT NULL").distinct())
    links, inner, _, rounds = contracted(written(arcs.where("a <> b")), roots)
    loops = arcs.where("a = b").select("a", "b")
    links = written(links.union(loops.hint("merge").join(roots.withColumnRenamed("node", "a"), "a", "left_semi")))
    root = F.col("node") if labelled else F.lit(0).cast(roots.schema["node"].dataType)
    newest = roots.select(root.alias("root"), F.col("node").alias("a"))
    seen: list[DataFrame] = []
    while True:
        found = newest.hint("merge").join(links, "a").select("root", F.col("b").alias("node")).distinct()
        if seen:
            found = found.hint("merge").join(reduce(DataFrame.union, seen), ["root", "node"], "left_anti")
        found = written(found)
        rounds += 1
        if found.isEmpty():
            break
        seen.append(found)
        newest = found.withColumnRenamed("node", "a")
    pairs = reduce(DataFrame.union, seen) if seen else newest.select("root", F.col("a").alias("node")).limit(0)
    starts = pairs.select("root", F.col("node").alias("a")).union(roots.select(root, F.col("node"))).distinct()
    return pairs.union(starts.hint("merge").join(inner.select("a", F.col("node").alias("within")), "a").select("root", "within")).distinct(), rounds


def _trimmed(arcs: DataFrame) -> DataFrame:
    """Arcs between nodes that have both a way in and a way out."""
    starts, ends = arcs.select("a").distinct(), arcs.select("b").distinct()
    return arcs.hint("merge").join(ends.withColumnRenamed("b", "a"), "a", "left_semi").hint("merge").join(starts.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")


def _spread(arcs: DataFrame, label: DataFrame) -> DataFrame:
    """(node, color): the greatest node that reaches each node, itself included."""
    while True:
        coming = arcs.hint("merge").join(label.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("color").alias("new"))
        told = label.hint("merge").join(coming, "node", "left").select("node", F.greatest("color", "new").alias("color"), (F.col("new") > F.col("color")).alias("moved"))
        told = written(told.withColumn("moved", F.coalesce("moved", F.lit(False))))
        if told.where("moved").isEmpty():
            return told.drop("moved")
        label = told.drop("moved")


def strong_cycles(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, cycle) of every node on a cycle, and the rounds of trimming and contraction.

    A cycle is a strongly connected component, named by its least node. Chains are contracted and nodes
    without a way in or out trimmed in turn until neither changes the graph; what is left is coloured by the
    greatest node that reaches it, and a colour's own node then collects what reaches it in its colour.
    """
    arcs = written(arcs_of(edges))
    loops = [arcs.where("a = b").select(F.col("a").alias("node"))]
    graph, passes, rings, rounds = written(arcs.where("a <> b")), [], [], 0
    n = graph.count()
    while n:
        before, graph = n, written(_trimmed(graph))
        n, rounds = graph.count(), rounds + 1
        if n < 0.9 * before:
            continue  # trimming alone shrinks the graph fast
        links, inner, ring, jumps = contracted(graph)
        links, rounds = written(links), rounds + jumps
        passes.append(inner)
        rings.append(ring.select("node", F.col("ring").alias("label")))
        loops.append(links.where("a = b").select(F.col("a").alias("node")))
        graph = links.where("a <> b")
        n = graph.count()
        if n == before:
            break
    labels = list(rings)
    while not graph.isEmpty():
        nodes = graph.select(F.col("a").alias("node")).union(graph.select("b")).distinct()
        color = _spread(graph, written(nodes.withColumn("color", F.col("node"))))
        within = written(graph.hint("merge").join(color.select(F.col("node").alias("a"), F.col("color").alias("ca")), "a").hint("merge").join(color.select(F.col("node").alias("b"), F.col("color").alias("cb")), "b").where("ca = cb").select("a", "b"))
        newest = written(color.where("node = color").select("node", F.col("color").alias("label")))
        members = [newest]
        while True:
            found = within.hint("merge").join(newest.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "label").distinct()
            newest = written(found.hint("merge").join(reduce(DataFrame.union, members).select("node"), "node", "left_anti"))
            if newest.isEmpty():
                break
            members.append(newest)
        told = reduce(DataFrame.union, members)
        labels.append(told)
        done = told.select("node")
        graph = written(_trimmed(graph.hint("merge").join(done.withColumnRenamed("node", "a"), "a", "left_anti").hint("merge").join(done.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b")))
    # a node is inner in one pass at most, and between nodes of later passes: labels go from the last pass back
    own = written(reduce(DataFrame.union, loops).distinct())
    label = reduce(DataFrame.union, labels) if labels else own.select("node", F.col("node").alias("label")).limit(0)
    alone = reduce(lambda left, inner: left.hint("merge").join(inner.select("node"), "node", "left_anti"), passes, own)
    label = written(label.union(alone.hint("merge").join(label.select("node"), "node", "left_anti").select("node", F.col("node").alias("label"))))
    for inner in reversed(passes):
        held = inner.hint("merge").join(label.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").hint("merge").join(label.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
        held = held.hint("merge").join(own.withColumn("loop", F.lit(True)), "node", "left")
        held = held.select("node", F.when(F.col("la") == F.col("lb"), F.col("la")).when(F.col("loop"), F.col("node")).alias("label")).where("label IS NOT NULL")
        label = written(label.union(held))
    groups = label.hint("merge").join(own.withColumn("loop", F.lit(1)), "node", "left").groupBy("label").agg(F.min("node").alias("cycle"), F.count("*").alias("n"), F.count("loop").alias("looped")).where("n > 1 OR looped > 0")
    return label.hint("merge").join(groups.select("label", "cycle"), "label").select("node", "cycle"), rounds
