"""Function measures: sums over the syntax nodes below each function."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FILE = ["scan_id", "rel_path"]
NESTING = ("If", "For", "While", "With", "Try", "AsyncFor", "AsyncWith")


def risk_level(cyclomatic: Column) -> Column:
    return F.when(cyclomatic <= 5, "low").when(cyclomatic <= 10, "medium").when(cyclomatic <= 20, "high").otherwise("critical")


def python_metrics(nodes: DataFrame) -> DataFrame:
    """One row per function. A nested function counts for each function around it too."""
    funcs = nodes.filter("kind in ('FunctionDef', 'AsyncFunctionDef')")
    funcs = funcs.select(
        *_FILE, F.col("node_id").alias("func"), F.col("name").alias("function_name"), F.col("qname").alias("qualified_name"),
        F.col("line").alias("start_line"), "end_line", F.size("params").alias("parameters"), F.col("cog_depth").alias("c0"),
        F.col("nest_depth").alias("n0"),
    )
    # a node that is no branch adds nothing, and is no deeper than the one that it stands in
    weighty = nodes.filter(F.col("kind").isin(*NESTING) | (F.col("cyclomatic") > 0) | (F.col("cognitive") > 0))
    below = weighty.select(*_FILE, F.explode("funcs").alias("func"), "cyclomatic", "cognitive", "nest_depth", (F.col("value_kind") == "deep").alias("deep"))
    sums = below.groupBy(*_FILE, "func").agg(
        F.sum("cyclomatic").alias("cc"), F.sum("cognitive").alias("cg"), F.count_if("deep").alias("n_deep"), F.max("nest_depth").alias("nest")
    )
    rows = funcs.join(sums, [*_FILE, "func"], "left").fillna(0, ["cc", "cg", "n_deep"])
    cyclomatic = F.col("cc") + 1
    return rows.select(
        *_FILE, "function_name", "qualified_name", "start_line", "end_line",
        (F.col("end_line") - F.col("start_line") + 1).alias("lines"), cyclomatic.alias("cyclomatic"),
        # what the nodes around the function add to every depth below it is taken off
        (F.col("cg") - F.col("n_deep") * F.col("c0")).alias("cognitive"),
        F.greatest(F.lit(0), F.coalesce("nest", "n0") - F.col("n0")).alias("nesting_depth"), "parameters", risk_level(cyclomatic).alias("risk_level"),
    )


def java_metrics(facts: DataFrame) -> DataFrame:
    rows = facts.filter("kind = 'method'")
    return rows.select(
        *_FILE, F.col("name").alias("function_name"), F.col("qname").alias("qualified_name"), F.col("line").alias("start_line"), "end_line",
        (F.col("end_line") - F.col("line") + 1).alias("lines"), F.col("cyclomatic").cast("bigint").alias("cyclomatic"),
        F.col("cognitive").cast("bigint").alias("cognitive"), F.col("nesting").alias("nesting_depth"), F.size("params").alias("parameters"),
        risk_level(F.col("cyclomatic")).alias("risk_level"),
    )
