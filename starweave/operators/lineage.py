"""Cycles, levels and values along the edges of a graph, in work that grows with the edges.

Nothing holds all pairs of nodes that reach each other. Cycles are found first: edges whose ends lie on none are trimmed from both sides, what
is left takes the least node that reaches it as its colour, and the nodes of a colour that lead back to its root are one component. Then
components are levelled from the leaves up: a round settles those whose targets are all settled, and hands on the greatest depth
and the least value. Each round reads the edges of its front only; the number of rounds is that of levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starweave.operators.scoring import settled


def _kept(rows: DataFrame) -> DataFrame:
    return settled(rows, parts=None)


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """The edges (src, dst) that lie on a cycle or between two."""
    n = edges.count()
    while n:
        into, out = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = _kept(edges.join(into, "src", "left_semi").join(out, "dst", "left_semi").select("src", "dst"))
        if (left := edges.count()) == n:
            break
        n = left
    return edges


def _colours(edges: DataFrame) -> DataFrame:
    """(node, colour): the least node that reaches it, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    state = _kept(nodes.select("node", F.col("node").alias("colour"), F.lit(True).alias("new")))
    while not (front := state.where("new")).isEmpty():
        passed = edges.join(front.select(F.col("node").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("least"))
        state = _kept(state.join(passed, "node", "left").select("node", F.least("colour", "least").alias("colour"), F.coalesce(F.col("least") < F.col("colour"), F.lit(False)).alias("new")))
    return state.select("node", "colour")


def components(edges: DataFrame) -> DataFrame:
    """(node, component, size) of the nodes on cycles; a component's name is its least node. Nulls are no nodes."""
    edges = _kept(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    live, found = cyclic_edges(edges), []
    while not live.isEmpty():
        colour = _colours(live)
        within = live.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("other")), "dst")
        within = _kept(within.where("colour = other").select("src", "dst", "colour"))
        front = members = _kept(colour.where("node = colour"))
        while not front.isEmpty():
            back = within.join(front.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = _kept(back.join(members.select("node"), "node", "left_anti"))
            members = members.unionByName(front)
        members = _kept(members)
        found.append(members)
        gone = members.select("node")
        rest = live.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        live = cyclic_edges(_kept(rest.select("src", "dst")))
    if not found:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component"), F.lit(1).cast("long").alias("size")).where("false")
    members = reduce(DataFrame.unionByName, found).withColumnRenamed("colour", "component")
    own = edges.where("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop"))
    sized = members.join(members.groupBy("component").agg(F.count("*").alias("size")), "component").join(own, "node", "left")
    return _kept(sized.where("size > 1 or loop").select("node", "component", "size"))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, members): one row for each cycle or knot of cycles, its nodes in order."""
    return components(edges).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))


def levels(edges: DataFrame, values: DataFrame | None = None, knots: DataFrame | None = None) -> DataFrame:
    """(node, component, size, depth, least) of all nodes of ``edges`` (src, dst).

    ``depth`` is the longest chain below a node, in which the members of a component count as one chain of all of them; ``least`` is
    the least value (node, value) of the node and all it reaches. ``component`` is null and ``size`` 1 off the cycles. ``knots`` are the
    components, if they are known.
    """
    edges = _kept(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    knots = components(edges) if knots is None else knots
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().join(knots, "node", "left")
    nodes = nodes.join(values, "node", "left") if values is not None else nodes.withColumn("value", F.lit(None).cast("int"))
    nodes = _kept(nodes.select("node", "component", F.coalesce("size", F.lit(1)).alias("size"), F.coalesce("component", "node").alias("at"), "value"))
    ends = nodes.select("node", "at")
    links = edges.join(ends.toDF("src", "a"), "src").join(ends.toDF("dst", "b"), "dst").where("a != b").select("a", "b").distinct()
    links = _kept(links)
    start = nodes.groupBy("at").agg((F.max("size") - 1).alias("depth"), F.min("value").alias("least"))
    state = start.join(links.groupBy(F.col("a").alias("at")).agg(F.count("*").alias("open")), "at", "left")
    state = _kept(state.select("at", F.col("depth").alias("inner"), "depth", "least", F.coalesce("open", F.lit(0)).alias("open")))
    done = []
    while not (front := state.where("open = 0")).isEmpty():
        done.append(front.select("at", "depth", "least"))
        below = front.select(F.col("at").alias("b"), F.col("depth").alias("d"), F.col("least").alias("v"))
        passed = links.join(below, "b").groupBy(F.col("a").alias("at")).agg(F.count("*").alias("n"), (F.max("d") + 1).alias("d"), F.min("v").alias("v"))
        state = _kept(
            state.where("open > 0").join(passed, "at", "left")
            .select("at", "inner", F.greatest("depth", F.col("inner") + F.col("d")).alias("depth"), F.least("least", "v").alias("least"), (F.col("open") - F.coalesce("n", F.lit(0))).alias("open"))
        )
    if not done:
        return nodes.select("node", "component", "size", F.lit(0).cast("long").alias("depth"), F.col("value").alias("least"))
    return nodes.join(reduce(DataFrame.unionByName, done), "at").select("node", "component", "size", "depth", "least")
