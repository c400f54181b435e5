"""Strong components, shortest cycles and topological levels of graphs of any size, as joins over edge tables.

``edges`` have ``scan_id, src, dst``; graphs of many scans are worked on at once. No step holds a graph, a component or all
pairs of reachable nodes in one place: what grows is joined and combined by node, and every step is stored, so that the
lineage stays short. A node with very many edges makes one side of a join long, which Spark splits; the other side has one
row for each node.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.stage import stored

#: Hops of a propagation that one job makes, and rounds of plain trimming before levels are computed.
HOPS, TRIMS = 2, 3


def _ends(edges: DataFrame) -> DataFrame:
    """All nodes: scan_id, v."""
    return edges.select("scan_id", F.col("u").alias("v")).union(edges.select("scan_id", "v")).distinct()


def _both_in(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    """The edges whose two ends are (``left_semi``) or aren't (``left_anti``) among the nodes."""
    for end in ("u", "v"):
        edges = edges.join(nodes.select("scan_id", F.col("v").alias(end)), ["scan_id", end], how)
    return edges


def _trimmed(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Edges between nodes that have edges on both sides. Long ways that plain rounds don't end are taken off by their levels."""
    for _ in range(TRIMS):
        inner = edges.select("scan_id", "u").intersect(edges.select("scan_id", F.col("v").alias("u")))
        edges, seen = stored(_both_in(edges, inner.withColumnRenamed("u", "v"), "left_semi"))
        if seen["rows"] in (0, n):
            return edges, seen["rows"]
        n = seen["rows"]
    for a, b in (("u", "v"), ("v", "u")):
        loose = topological_levels(edges.select("scan_id", F.col(a).alias("src"), F.col(b).alias("dst")))
        edges, seen = stored(_both_in(edges, loose.select("scan_id", F.col("module_id").alias("v")), "left_anti"))
    return edges, seen["rows"]


def _coloured(edges: DataFrame) -> DataFrame:
    """scan_id, v, colour: the least node from which a node can be reached, itself included."""
    colour, _ = stored(_ends(edges).withColumn("colour", F.col("v")))
    while True:
        now = colour.withColumn("was", F.col("colour"))
        for _ in range(HOPS):
            sent = edges.join(now.select("scan_id", F.col("v").alias("u"), "colour"), ["scan_id", "u"])
            sent = sent.groupBy("scan_id", "v").agg(F.min("colour").alias("sent"))
            now = now.join(sent, ["scan_id", "v"], "left").withColumn("colour", F.least("colour", "sent")).drop("sent")
        colour, seen = stored(now, changed=F.count_if(F.col("colour") < F.col("was")))
        colour = colour.drop("was")
        if not seen["changed"]:
            return colour


def _back(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """scan_id, v, colour of the nodes that reach the root of their colour; ``edges`` stay within a colour."""
    parts, all_seen = [roots], roots
    while True:
        before = edges.join(parts[-1].select("scan_id", "v"), ["scan_id", "v"]).select("scan_id", F.col("u").alias("v"), "colour").distinct()
        fresh, seen = stored(before.join(all_seen, ["scan_id", "v"], "left_anti"))
        if not seen["rows"]:
            return all_seen
        parts.append(fresh)
        all_seen = reduce(DataFrame.unionByName, parts)
        if len(parts) > 16:
            all_seen, _ = stored(all_seen)
            parts = [all_seen, fresh]


def strong_components(edges: DataFrame) -> DataFrame:
    """scan_id, module_id, component (the least module of it), for modules that stand on a cycle with another.

    Forward, every node takes the least colour that reaches it; a node that keeps its own is a root. Backward from each
    root, within its colour, are the nodes of its component. They go, edges between colours too, and the rest follows.

    Defined cases: a self-loop makes no component; repeated edges count once; edges with a null end are left out; an
    empty graph, and one without cycles, gives an empty table.
    """
    rows = edges.filter("src <> dst").select("scan_id", F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    left, seen = stored(rows)
    n, found = seen["rows"], []
    while n:
        left, n = _trimmed(left, n)
        if not n:
            break
        colour = _coloured(left)
        inner = left.join(colour, ["scan_id", "v"]).join(colour.withColumnRenamed("v", "u"), ["scan_id", "u", "colour"])
        inner, _ = stored(inner.select("scan_id", "u", "v", "colour"))
        roots = colour.filter("v = colour").select("scan_id", "v", "colour")
        part, _ = stored(_back(inner, roots).distinct())
        found.append(part)
        left, seen = stored(_both_in(inner.drop("colour"), part, "left_anti"))
        n = seen["rows"]
    if not found:
        return rows.select("scan_id", F.col("u").alias("module_id"), F.col("v").alias("component")).limit(0)
    parts = reduce(DataFrame.unionByName, found).select("scan_id", F.col("v").alias("module_id"), F.col("colour").alias("component"))
    # a root alone is on no cycle
    grown = parts.filter("module_id <> component").select("scan_id", "component").distinct()
    return parts.join(grown, ["scan_id", "component"], "left_semi").select("scan_id", "module_id", "component")


def inner_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The edges within a component: the columns of ``edges`` and ``component``."""
    rows = edges.filter("src <> dst").join(components.withColumnRenamed("module_id", "src"), ["scan_id", "src"])
    return rows.join(components.withColumnRenamed("module_id", "dst"), ["scan_id", "dst", "component"])


def shortest_cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """scan_id, component, pos (from 0), module_id: a shortest cycle through the least module of every component.

    A search of all components at once, level by level: a module first met in a level keeps the least module before it
    that is in the last level. The cycle closes at the least module of the level that leads back to the start.
    """
    rows = inner_edges(edges, components).select("scan_id", "component", F.col("src").alias("u"), F.col("dst").alias("v")).distinct()
    inner, seen = stored(rows)
    start = inner.select("scan_id", "component").distinct()
    start = start.select("scan_id", "component", F.col("component").alias("v"), F.lit(None).cast("string").alias("before"))
    levels, ends, open_rows = [stored(start)[0]], [], seen["rows"]
    while open_rows:
        step = inner.join(levels[-1].select("scan_id", "component", F.col("v").alias("u")), ["scan_id", "component", "u"])
        step = step.groupBy("scan_id", "component", "v").agg(F.min("u").alias("before"))
        step, _ = stored(step)
        closed = step.filter("v = component").select("scan_id", "component", F.col("before").alias("v"))
        ends.append(closed)
        met = reduce(DataFrame.unionByName, levels)
        fresh = step.join(met, ["scan_id", "component", "v"], "left_anti").join(closed, ["scan_id", "component"], "left_anti")
        fresh, seen = stored(fresh.select("scan_id", "component", "v", "before"))
        levels.append(fresh)
        open_rows = seen["rows"]
    path, on = [], None
    for depth in reversed(range(len(ends))):
        here = ends[depth] if on is None else on.unionByName(ends[depth])
        here, _ = stored(here.join(levels[depth], ["scan_id", "component", "v"]))
        path.append(here.select("scan_id", "component", F.lit(depth).alias("pos"), F.col("v").alias("module_id")))
        on = here.select("scan_id", "component", F.col("before").alias("v"))
    if not path:
        return start.select("scan_id", "component", F.lit(0).alias("pos"), F.col("v").alias("module_id"))
    return reduce(DataFrame.unionByName, path)


def _jumped(way: DataFrame) -> DataFrame:
    """``way`` (v, p, w, b, open) with the pointers of open rows twice as far."""
    far = way.select("scan_id", F.col("v").alias("p"), F.col("p").alias("p2"), F.col("w").alias("w2"), F.col("b").alias("b2"), F.col("open").alias("open2"))
    met = F.col("open") & F.col("p2").isNotNull()
    rows = way.join(far, ["scan_id", "p"], "left")
    return rows.select(
        "scan_id", "v",
        F.when(met, F.col("p2")).otherwise(F.col("p")).alias("p"),
        F.when(met, F.col("w") + F.col("w2")).otherwise(F.col("w")).alias("w"),
        F.when(met, F.greatest("b", F.col("b2") + F.col("w"))).otherwise(F.col("b")).alias("b"),
        F.when(met, F.col("open2")).otherwise(F.col("open")).alias("open"),
    )


def topological_levels(edges: DataFrame) -> DataFrame:
    """scan_id, module_id, level: the longest way from a module that nothing leads to.

    A module with one edge into it has the level of that edge's source and some more, so chains and trees of such modules
    are contracted by doubling, and only their heads are left. Of these, the ones that nothing leads to are taken off, which
    may leave others with one edge, and so on. An edge of the contracted graph has the length of its longest way, a module a
    least level from the edges that are gone already.

    Defined cases: modules on a cycle (a self-loop too), and what a cycle leads to, have no level; repeated edges count
    once; a graph without levels gives an empty table.
    """
    ends = edges.select("scan_id", F.col("src").alias("u"), F.col("dst").alias("v"), F.lit(1).alias("w"))
    left, _ = stored(ends.filter("u is not null and v is not null").distinct())
    nodes = _ends(left).withColumn("b", F.lit(0))
    sources, trees = [], []
    while True:
        one = left.groupBy("scan_id", "v").agg(F.count(F.lit(1)).alias("k"), F.min("u").alias("p"), F.min("w").alias("w")).filter("k = 1").drop("k")
        one = one.join(nodes, ["scan_id", "v"])
        led = one.select("scan_id", F.col("v").alias("p"), F.lit(True).alias("led"))
        way = one.join(led, ["scan_id", "p"], "left").select("scan_id", "v", "p", "w", "b", F.col("led").isNotNull().alias("open"))
        way, seen = stored(way, open=F.count_if("open"))
        span = 1
        while seen["open"] and span <= seen["rows"]:
            for _ in range(HOPS):
                way, span = _jumped(way), span * 2
            way, seen = stored(way, open=F.count_if("open"))
        trees.append(way.filter("not open").drop("open"))
        # edges into heads, from heads; what an endless pointer (a ring) leads to is held back by a loop
        above = way.select("scan_id", F.col("v").alias("u"), "p", F.col("w").alias("pw"), F.col("b").alias("pb"), "open")
        into = left.join(way.select("scan_id", "v"), ["scan_id", "v"], "left_anti").join(above, ["scan_id", "u"], "left")
        tail = F.when(F.col("open"), F.col("v")).otherwise(F.coalesce("p", "u"))
        into = into.select("scan_id", tail.alias("u"), "v", (F.col("w") + F.coalesce("pw", F.lit(0))).alias("w"), (F.col("pb") + F.col("w")).alias("pb"))
        into = into.groupBy("scan_id", "u", "v").agg(F.max("w").alias("w"), F.max("pb").alias("pb"))
        into, seen = stored(into)
        least = into.groupBy("scan_id", "v").agg(F.max("pb").alias("pb"))
        heads = nodes.join(way.select("scan_id", "v"), ["scan_id", "v"], "left_anti").join(least, ["scan_id", "v"], "left")
        heads, _ = stored(heads.select("scan_id", "v", F.greatest("b", "pb").alias("b")))
        free = heads.join(into.select("scan_id", "v"), ["scan_id", "v"], "left_anti").select("scan_id", "v", F.col("b").alias("level"))
        sources.append(free)
        if not seen["rows"]:
            break
        told = into.join(free.withColumnRenamed("v", "u"), ["scan_id", "u"])
        told = told.groupBy("scan_id", "v").agg(F.max(F.col("level") + F.col("w")).alias("told"))
        rest, seen = stored(into.join(free.select("scan_id", F.col("v").alias("u")), ["scan_id", "u"], "left_anti").drop("pb"), before=F.lit(0))
        nodes = heads.join(free, ["scan_id", "v"], "left_anti").join(told, ["scan_id", "v"], "left")
        nodes, after = stored(nodes.select("scan_id", "v", F.greatest("b", "told").alias("b")))
        left = rest
        if free.isEmpty():
            break
    known = reduce(DataFrame.unionByName, sources)
    for tree in reversed(trees):
        more = tree.join(known.select("scan_id", F.col("v").alias("p"), "level"), ["scan_id", "p"])
        more = more.select("scan_id", "v", F.greatest("b", F.col("level") + F.col("w")).alias("level"))
        known, _ = stored(known.unionByName(more))
    return known.select("scan_id", F.col("v").alias("module_id"), "level")
