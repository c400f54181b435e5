"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents are aggregated by the set of sources they belong to (their pattern). In the flow network a pattern offers
its words once at cost 1, a second time at cost 3, a third at cost 5 (so a repetition is used only where no fresh
words are left: the cost is convex), and may send them to any source of the pattern; a source asks for its target.
The flow says how many words each pattern gives. Its documents then give whole passes, and the rest of a pass
is filled with documents in the order of a seeded hash, the last of them in part: a histogram of 4,096 hash bins finds the bin in which the
rest ends, and only that bin's rows are ordered, so no task ever holds a source.

The plan has a row per pattern and is made on the driver. Sources with target weights are a configured list, so
are the patterns that occur; ``MAX_PATTERNS`` is checked and documented rather than assumed.
"""

from __future__ import annotations

import heapq
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import stored, words_of

#: Most passes over a document, weights in the order of sources, and the seed of the selection.
PASSES, WEIGHTS, SEED = 3, (1, 2, 3), 11
#: The plan is refused beyond this many membership patterns; nothing is ever dropped to stay below it.
MAX_PATTERNS = 200_000
_BINS = 4096


def source_order(names: list[str | None]) -> list[str | None]:
    """By code point, null last."""
    return sorted((x for x in names if x is not None), key=lambda x: x) + [None] * (None in names)


def targets(sizes: dict, weights=WEIGHTS, passes: int = PASSES, total: int | None = None) -> dict:
    """Words wanted of each source: its weight's share of ``total``, at most ``passes`` times its size.

    What is cut off a source is shared by weight among the others until none is above its bound.
    """
    order = source_order([*sizes])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, active, out = float(sum(sizes.values()) if total is None else total), set(order), {}
    while active:
        whole = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / whole > passes * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / whole for s in active}
        for s in over:
            out[s] = float(passes * sizes[s])
        left -= sum(out[s] for s in over)
        left = max(left, 0.0)
        active -= set(over)
    return out


def min_cost_flow(arcs: list[tuple[int, int, int, int]], n: int, start: int, end: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost >= 0) of a maximum flow of least cost.

    Successive shortest paths with node potentials.
    """
    to, room, cost, at = [], [], [], [[] for _ in range(n)]
    for a, b, c, w in arcs:
        for x, y, r, p in ((a, b, c, w), (b, a, 0, -w)):
            at[x].append(len(to))
            to.append(y), room.append(r), cost.append(p)
    height = [0] * n
    while True:
        far, by, heap = [None] * n, [-1] * n, [(0, start)]
        done = [False] * n
        far[start] = 0
        while heap:
            d, x = heapq.heappop(heap)
            if done[x]:
                continue
            done[x] = True
            for e in at[x]:
                y = to[e]
                if room[e] > 0 and not done[y]:
                    d2 = d + cost[e] + height[x] - height[y]
                    if far[y] is None or d2 < far[y]:
                        far[y], by[y] = d2, e
                        heapq.heappush(heap, (d2, y))
        if far[end] is None:
            return [room[2 * i + 1] for i in range(len(arcs))]
        top = max(d for d in far if d is not None)
        for x in range(n):
            height[x] += far[x] if far[x] is not None else top
        path, x = [], end
        while x != start:
            path.append(by[x])
            x = to[by[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def plan(patterns: dict[tuple, int], wanted: dict, passes: int = PASSES) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources."""
    sources, names = [*wanted], [*patterns]
    source_at = {s: 2 + len(names) + i for i, s in enumerate(sources)}
    arcs, inner = [], []
    for i, p in enumerate(names):
        arcs += [(0, 2 + i, patterns[p], 2 * k + 1) for k in range(passes)]
    for i, p in enumerate(names):
        for s in p:
            inner.append((len(arcs), p, s))
            arcs.append((2 + i, source_at[s], passes * patterns[p], 0))
    arcs += [(source_at[s], 1, round(wanted[s]), 0) for s in sources]
    flow = min_cost_flow(arcs, 2 + len(names) + len(sources), 0, 1)
    out: dict[tuple, dict] = {p: {} for p in names}
    for k, p, s in inner:
        out[p][s] = flow[k]
    return out


def mix(
    docs: DataFrame,
    sources: Column | None = None,
    weights=WEIGHTS,
    passes: int = PASSES,
    seed: int = SEED,
) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken`` and ``passes`` (how often it is read).

    ``sources``: an array column of the sources a document belongs to (default: its ``source`` alone); for a document
    of several, ``source_size`` and ``target`` are sums over them. Defined cases: a null text has size 0; null
    is a source of its own and comes last; documents without words are never taken; equal texts count each;
    rows repeated with one id are told apart only by their order, which leaves the result the same; an empty table
    gives an empty result; other columns are ignored. Reruns agree: the order is a hash of the seed and the id.
    """
    spark = docs.sparkSession
    member = F.array(F.col("source").cast("string")) if sources is None else F.array_distinct(sources)
    rows = docs.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("size"), member.alias("m"))
    hashed = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = rows.select(
        "doc_id", "size", F.to_json(F.struct(F.sort_array("m").alias("m")), {"ignoreNullFields": "false"}).alias("pattern"), hashed.alias("h")
    )
    rows = stored(rows, "mix-sizes").withColumn("bin", F.pmod(F.shiftrightunsigned("h", 40), F.lit(_BINS)))
    sums = rows.groupBy("pattern").agg(F.sum("size").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(sums) > MAX_PATTERNS:
        raise ValueError(f"over {MAX_PATTERNS} membership patterns; give fewer sources")
    names = {r.pattern: tuple(json.loads(r.pattern)["m"]) for r in sums}
    sizes: dict = {}
    for r in sums:
        for s in names[r.pattern]:
            sizes[s] = sizes.get(s, 0) + r.n
    wanted = targets(sizes, weights, passes, sum(r.n for r in sums))
    given = plan({names[r.pattern]: r.n for r in sums}, wanted, passes)
    steps = []
    for r in sums:
        m = names[r.pattern]
        words = sum(given[m].values())
        whole, rest = divmod(words, r.n) if r.n else (0, 0)
        steps.append(
            (r.pattern, sum(sizes[s] for s in m), float(sum(wanted[s] for s in m)), int(whole), int(rest))
        )
    schema = "pattern string, source_size long, target double, whole long, rest long"
    steps_df = spark.createDataFrame(steps, schema)
    if len(steps) <= 20_000:
        steps_df = F.broadcast(steps_df)
    rows = rows.join(steps_df, "pattern")
    # where the rest of the last pass ends: a bin of the histogram, and within it a row
    bins = rows.filter("rest > 0").groupBy("pattern", "bin", "rest").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("pattern").orderBy("bin"))
    ends = bins.withColumn("before", upto - F.col("n")).filter("before < rest and rest <= before + n")
    ends = ends.select("pattern", F.col("bin").alias("last_bin"), "before")
    if len(steps) <= 20_000:
        ends = F.broadcast(ends)
    rows = rows.join(ends, "pattern", "left")
    inside = rows.filter("bin = last_bin")
    order = Window.partitionBy("pattern").orderBy("h", "doc_id", "size")
    upto = F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    # of the row in which the rest ends, only so many words are taken; as a whole row it counts if over half of it is
    inside = inside.withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - upto + F.col("size"))))
    outside = rows.filter("last_bin is null or bin <> last_bin").withColumn(
        "part", F.when(F.col("bin") < F.col("last_bin"), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    both = inside.unionByName(outside)
    more = ((F.col("size") > 0) & (2 * F.col("part") > F.col("size"))).cast("long")
    return both.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("whole") + F.col("part")).alias("taken"),
        F.when(F.col("size") > 0, F.col("whole") + more).otherwise(F.lit(0).cast("long")).alias("passes"),
    )


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them."""
    often = mix(docs, **options).filter("passes > 0").groupBy(F.col("doc_id").alias("_id")).agg(
        F.max("passes").alias("_passes")
    )
    joined = docs.join(often, F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_passes")))).select(
        *[docs[c] for c in docs.columns]
    )
