"""Places in an order, without a window over one large group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.shared import stored

#: ``monotonically_increasing_id`` holds the partition above this bit and the place in it below.
_BITS = 33


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``place``: 0, 1, 2... within the group, by ``order``; and ``size``, the rows of the group.

    The rows are dealt by range on group and order, so that a large group spans many tasks, and stored sorted with their
    place in the task. A group's part in a task then starts where its parts in earlier tasks end: one row per group and
    task is summed, and joined back on both. An empty ``group`` places all rows in one order.
    """
    by = [F.col(g).asc() for g in group] + order
    at = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", at)
    rows = stored(rows, name).withColumn("_task", F.shiftright("_at", _BITS))
    parts = rows.groupBy(*group, "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_task").rowsBetween(W.unboundedPreceding, -1))
    size = F.sum("_n").over(W.partitionBy(*group))
    parts = parts.withColumns({"_before": F.coalesce(before, F.lit(0)), "size": size}).drop("_n").alias("p")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in [*group, "_task"]]
    joined = rows.alias("r").join(parts, same)
    place = F.col("_at") - F.col("_first") + F.col("_before")
    return joined.select(*[f"r.{c}" for c in rows.columns if c not in ("_at", "_task")], place.alias("place"), "size")
