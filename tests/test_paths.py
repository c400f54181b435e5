"""Strong components, shortest cycles and topological levels against plain searches, over several scans at once."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import graph, paths, stage

EDGES = "scan_id long, src string, dst string"


def reach(edges):
    """(x, y) pairs joined by a way of one edge at least."""
    found = set(edges)
    while True:
        more = {(a, d) for a, b in found for c, d in edges if b == c} - found
        if not more:
            return found
        found |= more


def plain_components(rows):
    out = set()
    for s in {r[0] for r in rows}:
        r = reach({(a, b) for t, a, b in rows if t == s and a != b})
        for x in {a for a, _ in r}:
            both = {y for y in {b for _, b in r} if (x, y) in r and (y, x) in r}
            if len(both) > 1:
                out.add((s, x, min(both)))
    return out


def plain_levels(rows):
    out = set()
    for s in {r[0] for r in rows}:
        left = {(a, b) for t, a, b in rows if t == s}
        nodes, level = {x for e in left for x in e}, 0
        while True:
            ready = {x for x in nodes if all(b != x for _, b in left)}
            if not ready:
                break
            out |= {(s, x, level) for x in ready}
            nodes -= ready
            left = {(a, b) for a, b in left if a not in ready}
            level += 1
    return out


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def random_graph(seed, nodes, edges, scans=3):
    rng = random.Random(seed)
    return [(s, f"n{rng.randrange(nodes):02}", f"n{rng.randrange(nodes):02}") for s in range(1, scans + 1) for _ in range(edges)]


@pytest.mark.parametrize(("seed", "nodes", "edges"), [(1, 12, 16), (2, 30, 40), (3, 8, 30)])
def test_components_of_random_graphs(spark, seed, nodes, edges):
    rows = random_graph(seed, nodes, edges)
    assert rows_of(paths.strong_components(spark.createDataFrame(rows, EDGES))) == plain_components(rows)


def test_components_of_rings_and_long_ways(spark):
    ring = [(1, f"r{i:03}", f"r{(i + 1) % 9:03}") for i in range(9)]
    way = [(1, f"w{i:03}", f"w{i + 1:03}") for i in range(200)] + [(1, "w200", "r004"), (1, "r007", "a000")]
    way += [(1, f"a{i:03}", f"a{i + 1:03}") for i in range(50)] + [(2, "x", "x"), (2, "x", "y")]
    df = spark.createDataFrame(ring + way + ring, EDGES)
    assert rows_of(paths.strong_components(df)) == {(1, f"r{i:03}", "r000") for i in range(9)}
    assert paths.strong_components(df.limit(0)).count() == 0


def shortest(rows, scan, inside, start):
    """Length of a shortest cycle through the start."""
    level, k = {start}, 0
    while True:
        k += 1
        level = {b for s, a, b in rows if s == scan and a in level and b in inside and a != b}
        if start in level:
            return k


@pytest.mark.parametrize("seed", [4, 5])
def test_shortest_cycles(spark, seed):
    rows = random_graph(seed, 14, 24)
    df = spark.createDataFrame(rows, EDGES)
    parts = paths.strong_components(df)
    members = {}
    for s, x, c in rows_of(parts):
        members.setdefault((s, c), set()).add(x)
    found = {}
    for s, c, pos, x in rows_of(paths.shortest_cycles(df, parts)):
        found.setdefault((s, c), {})[pos] = x
    assert found.keys() == members.keys() and found
    have = set(rows)
    for (s, c), at in found.items():
        way = [at[i] for i in range(len(at))]
        assert way[0] == c and len(set(way)) == len(way) == shortest(rows, s, members[s, c], c)
        assert all((s, x, y) in have for x, y in zip(way, way[1:] + way[:1], strict=True))
    assert paths.shortest_cycles(df.limit(0), parts.limit(0)).count() == 0


def test_cycles_have_members_path_and_severities(spark):
    rows = [(1, "a", "b", False), (1, "b", "a", False), (1, "c", "d", False), (1, "d", "e", True), (1, "e", "c", False), (2, "b", "a", False)]
    found = graph.cycles(spark.createDataFrame(rows, EDGES + ", is_wildcard boolean")).orderBy("members").collect()
    assert [(r.scan_id, r.members, r.path, r["size"], r.severity, r.go_severity) for r in found] == [
        (1, ["a", "b"], ["a", "b"], 2, "low", "minor"),
        (1, ["c", "d", "e"], ["c", "d", "e"], 3, "medium", "critical"),
    ]


@pytest.mark.parametrize(("seed", "nodes", "edges"), [(6, 20, 18), (7, 40, 45), (8, 9, 12)])
def test_levels_of_random_graphs(spark, seed, nodes, edges):
    rng = random.Random(seed)
    rows = random_graph(seed, nodes, edges, 2)
    # a third scan without cycles: edges from lower to higher names
    rows += [(3, *sorted((a, b))) for _, a, b in random_graph(seed + 50, nodes, edges, 1) if a != b or rng.random() < 0.1]
    assert rows_of(paths.topological_levels(spark.createDataFrame(rows, EDGES))) == plain_levels(rows)


def test_levels_of_a_long_chain_in_few_jobs(spark, monkeypatch):
    made = []
    real = stage.stored
    monkeypatch.setattr(paths, "stored", lambda df, **m: made.append(1) or real(df, **m))
    n = 5000
    rows = [(1, f"m{i}", f"m{i + 1}") for i in range(n)] + [(1, "m10", "m12")]
    got = rows_of(paths.topological_levels(spark.createDataFrame(rows, EDGES)))
    assert got == {(1, f"m{i}", i) for i in range(n + 1)}
    assert len(made) < 20


def test_levels_of_awkward_graphs(spark):
    def levels(rows):
        return {(x, k) for _, x, k in rows_of(graph.topological_levels(spark.createDataFrame(rows, EDGES)))}

    assert levels([]) == set()
    assert levels([(1, "a", "b"), (1, "b", "a"), (1, "b", "c")]) == set()
    assert levels([(1, "a", "a"), (1, "a", "b")]) == set()
    assert levels([(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "x", "y"), (1, "y", "x")]) == {("a", 0), ("b", 1), ("c", 2)}
    diamonds = [(1, f"v{i}", f"{s}{i}") for i in range(40) for s in "ab"] + [(1, f"{s}{i}", f"v{i + 1}") for i in range(40) for s in "ab"]
    assert ("v40", 80) in levels(diamonds)


def test_a_step_counts_its_rows(spark):
    df, seen = stage.stored(spark.range(10), even=F.count_if(F.col("id") % 2 == 0))
    assert seen == {"rows": 10, "even": 5} and df.count() == 10
    assert stage.stored(spark.range(10).filter("id < 0"))[1] == {"rows": 0}
