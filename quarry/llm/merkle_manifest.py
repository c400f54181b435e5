"""A Merkle manifest of a dataset: leaf, subroot, root and proof of every document.

Leaves of one source, in the order of their ids, stand in arrays of ``BLOCK`` (a power of ``FAN``). Inside a block the
levels are made by higher-order functions: ``sequence`` numbers the runs, ``transform`` and ``slice`` hash each run, and
``aggregate`` goes from level to level. A block ends as one node, so the block roots of a source are again an ordered
list, a block's length shorter, and the same step follows until each source has one node left. The subroots are one more
such list. On the way back every node gets its proof: what stands left and right of it at each level. A block's part of
the proof above it is joined once per block, so no proof of a single document is ever shuffled.

Text is read once, to make the leaves; only ids and digests go on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.order import placed
from quarry.llm.shared import stored

FAN, DEPTH = 3, 6
BLOCK = FAN**DEPTH
#: Fields of a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = "array<struct<left:string,right:string>>"


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a document's fields, with ``text`` as its text."""
    return _digest(*[_field(text if c == "text" else F.col(c)) for c in FIELDS])


def _run(level: Column, i: Column) -> Column:
    """The nodes of the run number ``i`` of a level."""
    return F.slice(level, (i * FAN + 1).cast("int"), FAN)


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(_run(level, i), ""), 256))


def _levels(nodes: Column, deep: Column) -> Column:
    """All levels above ``nodes`` and they themselves: ``DEPTH`` steps where ``deep``, else until one node is left."""

    def step(levels: Column, _: Column) -> Column:
        last = F.element_at(levels, -1)
        return F.when(deep | (F.size(last) > 1), F.concat(levels, F.array(_parents(last)))).otherwise(levels)

    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(nodes), step)


def _steps(levels: Column, i: Column) -> Column:
    """What stands left and right of node ``i`` and of its ancestors, for all levels but the last."""

    def at(level: Column, n: Column) -> Column:
        mine = F.floor(i / F.pow(F.lit(FAN), n)).cast("int")
        run, k = _run(level, F.floor(mine / FAN).cast("int")), F.pmod(mine, F.lit(FAN))
        return F.struct(
            F.array_join(F.slice(run, F.lit(1), k), "").alias("left"),
            F.array_join(F.slice(run, k + 2, F.lit(FAN)), "").alias("right"),
        )

    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), at)


def _blocks(nodes: DataFrame, group: str) -> DataFrame:
    """``nodes`` (group, place, size, node, ...) in blocks: group, block, size, items in order, levels."""
    item = F.struct("place", *[c for c in nodes.columns if c not in (group, "place", "size")])
    block = F.floor(F.col("place") / BLOCK).alias("block")
    blocks = nodes.groupBy(group, block).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(item)).alias("items"))
    levels = _levels(F.col("items.node"), F.col("size") > BLOCK)
    return blocks.withColumn("levels", levels)


def rise(nodes: DataFrame, group: str, name: str) -> list[DataFrame]:
    """The rounds of blocks, the last with one block for each group. ``nodes``: group, place and size (``order.placed``),
    node, and columns that are handed through.
    """
    rounds = [stored(_blocks(nodes, group), name)]
    largest = rounds[0].agg(F.max("size")).first()[0] or 0
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        above = rounds[-1].select(
            group,
            F.col("block").alias("place"),
            F.ceil(F.col("size") / BLOCK).alias("size"),
            _top().alias("node"),
        )
        rounds.append(stored(_blocks(above, group), name))
    return rounds


def _top() -> Column:
    return F.element_at(F.element_at("levels", -1), 1)


def roots(rounds: list[DataFrame], group: str) -> DataFrame:
    return rounds[-1].select(group, _top().alias("root"))


def descend(rounds: list[DataFrame], group: str, upper: DataFrame, result: Callable[[Column, Column], Column]) -> DataFrame:
    """``result(item, steps)``, a struct, of every node; ``steps`` lead up to the end of ``upper``.

    ``upper`` has the column ``group``, ``upper`` (the steps above the group's root) and columns that are handed through.
    """
    carried = [c for c in upper.columns if c not in (group, "upper")]
    upper = upper.withColumnRenamed(group, "_group").withColumn("_block", F.lit(0))

    def inner(item: Column, steps: Column) -> Column:
        return F.struct(item["place"].alias("_block"), steps.alias("upper"))

    def all_items(make: Callable[[Column, Column], Column]) -> Column:
        return F.transform("items", lambda item, i: make(item, F.concat(_steps(F.col("levels"), i), "upper")))

    for k, blocks in reversed([*enumerate(rounds)]):
        of = F.col(group).eqNullSafe(F.col("_group")) & (F.col("block") == F.col("_block"))
        items = all_items(inner if k else result)
        upper = blocks.join(upper, of).select(F.col(group).alias("_group"), *carried, F.inline(items))
    return upper.drop("_group")


def fold(node: Column, steps: Column) -> Column:
    """The root that follows from a node and its proof."""
    return F.aggregate(steps, node, lambda n, s: _digest(s["left"], n, s["right"]))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text of a tampered copy: without line feeds where the crc32 of the id is even; a null id is left alone."""
    even = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Defined cases: every null field is a "-", unlike an empty text, and a null source is a source of its own, the first;
    rows with a null id come first in their source and are not tampered with; repeated rows are leaves each, in the order
    of their digests where the ids are equal; a very long text is hashed whole, as one value; an empty table gives an
    empty result; further columns are ignored, whatever their names.
    """
    leaves = stored(
        docs.select("doc_id", "source", leaf(F.col("text")).alias("node"), leaf(tampered(F.col("doc_id"), F.col("text"))).alias("other")),
        "merkle-leaves",
    )
    leaves = placed(leaves, ["source"], [F.col("doc_id").asc(), F.col("node").asc()], "merkle-places")
    rounds = rise(leaves, "source", "merkle-blocks")
    tops = roots(rounds, "source").select(F.lit(0).alias("all"), "source", F.col("root").alias("node"))
    tops = rise(placed(tops, ["all"], [F.col("source").asc()], "merkle-tops"), "all", "merkle-top-blocks")
    root = roots(tops, "all").first()
    above = tops[-1].select("all", F.array().cast(_STEPS).alias("upper"))
    above = descend(tops, "all", above, lambda item, steps: F.struct(item["source"].alias("source"), item["node"].alias("subroot"), steps.alias("upper")))

    def verdict(item: Column, steps: Column) -> Column:
        proof = F.aggregate(steps, F.lit(""), lambda p, s: F.concat(p, s["left"], s["right"]))
        return F.struct(
            item["doc_id"].alias("doc_id"),
            item["node"].alias("leaf"),
            F.sha2(proof, 256).alias("proof_sha256"),
            fold(item["other"], steps).alias("folded_root"),
        )

    rows = descend(rounds, "source", above, verdict).withColumn("root", F.lit(root.root if root else None).cast("string"))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


_HASH = "sha256(string_agg(node, '' ORDER BY i))"
_STEP = "string_agg(s.node, '' ORDER BY s.i) FILTER (s.i {} n.i)"

#: Level by level, with every level's nodes as rows.
SQL = rf"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT *, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])) & 1 = 1 AS bad FROM documents, t),
v AS (SELECT doc_id, source,
  {" || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in FIELDS[:-1])} AS head, text,
  CASE WHEN bad THEN replace(text, chr(10), '') ELSE text END AS other FROM d),
leaves AS (SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS other FROM v),
numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
low AS (SELECT source, 0 AS level, i, leaf AS node, count(*) OVER (PARTITION BY source) AS n FROM numbered
  UNION ALL SELECT source, level + 1, i // {FAN}, {_HASH}, any_value((n + {FAN - 1}) // {FAN}) FROM low WHERE n > 1 GROUP BY source, level, i // {FAN}),
subroots AS (SELECT source, node, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS k FROM low WHERE n = 1),
high AS (SELECT 0 AS level, k AS i, node, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, i // {FAN}, {_HASH}, any_value((n + {FAN - 1}) // {FAN}) FROM high WHERE n > 1 GROUP BY level, i // {FAN}),
every AS (SELECT s.k AS source, level, i, l.node, n FROM low l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source),
around AS (SELECT n.source, n.level, n.i, coalesce({_STEP.format("<")}, '') AS l, coalesce({_STEP.format(">")}, '') AS r
  FROM every n JOIN every s ON s.source = n.source AND s.level = n.level AND s.i // {FAN} = n.i // {FAN} WHERE n.n > 1 GROUP BY ALL),
above AS (SELECT n.level, n.i, coalesce({_STEP.format("<")}, '') AS l, coalesce({_STEP.format(">")}, '') AS r
  FROM high n JOIN high s ON s.level = n.level AND s.i // {FAN} = n.i // {FAN} WHERE n.n > 1 GROUP BY ALL),
walk AS (SELECT x.doc_id, x.leaf, s.k, s.node AS subroot, FALSE AS up, 0 AS level, x.i, '' AS proof, x.other AS node
  FROM numbered x JOIN subroots s ON x.source IS NOT DISTINCT FROM s.source
  UNION ALL SELECT w.doc_id, w.leaf, w.k, w.subroot,
    w.up OR a.l IS NULL, CASE WHEN w.up OR a.l IS NOT NULL THEN w.level + 1 ELSE 0 END,
    CASE WHEN w.up OR a.l IS NOT NULL THEN w.i // {FAN} ELSE w.k END,
    w.proof || coalesce(CASE WHEN w.up THEN b.l || b.r ELSE a.l || a.r END, ''),
    CASE WHEN w.up THEN sha256(b.l || w.node || b.r) WHEN a.l IS NULL THEN w.node ELSE sha256(a.l || w.node || a.r) END
  FROM walk w LEFT JOIN around a ON NOT w.up AND a.source = w.k AND a.level = w.level AND a.i = w.i
  LEFT JOIN above b ON w.up AND b.level = w.level AND b.i = w.i WHERE NOT w.up OR b.l IS NOT NULL),
ends AS (SELECT * FROM walk w WHERE up AND level = (SELECT max(level) FROM high))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, e.node AS folded_root, e.node = root AS verified
FROM ends e, (SELECT node AS root FROM high WHERE n = 1)
"""
