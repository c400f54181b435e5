"""Small cases of the findings of round 3: each failed before."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.functions import line_facts, python_facts
from quarry.operators import architecture, complexity, payloads, refactor, rules, scoring
from quarry.plans import graph_plans, store_plans, text_plans


def test_tenths_rounds_ten_times_the_value(spark, tmp_path):
    x = spark.createDataFrame([(31.549999999999997,), (-54.349999999999994,), (2.04,), (None,)], "x double")
    assert [r.y for r in x.select(scoring.tenths(F.col("x")).alias("y")).collect()] == [31.6, -54.4, 2.0, None]
    rows = [(1, 7, "F", 342250.0, "2024-01-01", "1-URGENT"), (2, 7, "F", 1000.0, "2024-01-02", "1-URGENT")]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string")
    orders.withColumn("o_orderdate", F.to_timestamp("o_orderdate")).write.parquet(f"{tmp_path}/orders.parquet")
    assert {r.o_orderkey: r.score for r in store_plans.Q["q_radar_delta"](spark, str(tmp_path)).collect()} == {1: 31.6, 2: 99.8}


def test_radar_inputs_of_a_scan_without_edges(spark):
    modules = spark.createDataFrame([(1, "a", "api/a.py")], "scan_id long, module_id string, file_path string")
    edges = spark.createDataFrame([], "scan_id long, src string, dst string, kind string, count long, is_wildcard boolean")
    totals = spark.createDataFrame([(1, 0, 0, 0.0)], "scan_id long, issues long, loc long, dup_rate double")
    row = payloads.radar_inputs(modules, edges, totals).collect()[0]
    assert (row.modules, row.edges, row.out_edges, row.cyclic) == (1, 0, 0, 0)
    assert (row.classified, row.reverse, row.intra, row.inter) == (None,) * 4
    score = architecture.radar(payloads.radar_inputs(modules, edges, totals)).collect()[0]
    assert (score.isolation, score.decoupling, score.cohesion) == (85.0, 100.0, 75.0)


def test_merged_keeps_categories_that_share_an_id(spark):
    rows = [(1, "2d3077a5", "class_split", "a", 34), (1, "2d3077a5", "class_split", "b", 67), (1, "2d3077a5", "arg_object", "c", 67), (2, "2d3077a5", "arg_object", "c", 67)]
    s = spark.createDataFrame(rows, "scan_id long, id string, category string, title string, priority int")
    assert sorted((r.scan_id, r.category, r.title) for r in refactor.merged(s, s).collect()) == [(1, "arg_object", "c"), (1, "class_split", "b"), (2, "arg_object", "c")]


def test_config_files_without_lines_have_no_row(spark, tmp_path):
    rows = [(2, "12 +", "fr", "s1", 4), (3, None, "fr", "s1", 0), (1, "", "fr", "s1", 0), (7, "one two", "fr", "s1", 7)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.rel_path for r in text_plans.q_loc_config(spark, str(tmp_path)).collect()}
    # an .ini file begins with a section, the others are made of words only
    assert found == {"config/services/s1.ini", "config/api/s7.yaml"}


SOURCE = """import os, sys
class A(B):
    x = 1
    def run(self, a, b=2):
        self.y = [f(i) for i in a if i and b]
        def inner():
            return g(a) if a else b
        class C:
            def deep(self):
                while a:
                    with b: break
        return inner
async def free():
    from os import path
    try:
        pass
    except E as e:
        raise
"""


@pytest.mark.parametrize("kinds", [("FunctionDef", "AsyncFunctionDef"), ("ClassDef",), ("Import", "ImportFrom"), ("Call", "FunctionDef"), ("Attribute", "ClassDef")])
def test_nodes_of_some_kinds_equal_those_of_all(kinds):
    def seen(rows, *off):
        return [{k: v for k, v in r.items() if k not in off} for r in rows]

    whole, some = [r for r in python_facts.nodes(SOURCE) if r["kind"] in kinds], python_facts.nodes(SOURCE, frozenset(kinds))
    off = ("node_id", "parent_id", "funcs", "class_id") if set(kinds) <= python_facts.STATEMENTS else ()
    assert seen(some, *off) == seen(whole, *off) and some


def test_metrics_of_weighted_nodes_equal_those_of_all(spark):
    corpus = spark.createDataFrame([(1, "a.py", "python", SOURCE), (1, "b.py", "python", "def f(:"), (1, "c.java", "java", SOURCE)], "scan_id long, rel_path string, language string, text string")
    whole = complexity.python_metrics(python_facts.python_nodes(corpus)).collect()
    assert sorted(complexity.python_metrics(graph_plans.metric_nodes(rules.Facts(corpus, shared=False))).collect()) == sorted(whole) and len(whole) == 4


def test_findings_with_snippets_join_no_table_of_lines(spark):
    corpus = spark.createDataFrame([(1, "a.py", "python", "  def f(): pass\n" + "x = 1\n" * 3)], "scan_id long, rel_path string, language string, text string")
    found = rules.run_rules(rules.Facts(corpus, shared=False), ["PY-I001", "PY-L001"])
    assert [(r.rule_code, r.line, r.code_snippet) for r in found.collect()] == [("PY-I001", 1, "  def f(): pass")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_line_facts_read_files_not_lines(spark):
    """Texts of one path are one file, read side by side; nothing but whole files is shuffled."""
    rows = [(1, "a.py", "python", "class A:\n    def f(self):\r\n        g()\x0bx = 1\n"), (1, "b.java", "java", "class B {\n void f() { g(); }\n}\n"), (1, "c.py", "python", None), (1, "d.py", "python", "")]
    corpus = spark.createDataFrame(rows, "scan_id long, rel_path string, language string, text string")
    facts = line_facts.line_facts(corpus)
    assert sorted((r.rel_path, r.fact, r.name, r.owner, r.line) for r in facts.collect()) == [
        ("a.py", "call", "g", "f", 3), ("a.py", "symbol", "A", None, 1), ("a.py", "symbol", "f", "A", 2), ("a.py", "write", "x", None, 4),
        ("b.java", "call", "f", "f", 2), ("b.java", "call", "g", "f", 2), ("b.java", "symbol", "B", None, 1), ("b.java", "symbol", "f", "B", 2),
    ]
    assert "Generate" not in facts._jdf.queryExecution().optimizedPlan().toString()
    twice = spark.createDataFrame([(1, "a.py", "python", "class A:\n"), (1, "a.py", "python", "\n    def f(self): pass\n")], "scan_id long, rel_path string, language string, text string")
    assert sorted((r.name, r.owner) for r in line_facts.line_facts(twice).collect()) == [("A", None), ("f", "A")]


def test_layers_are_looked_up_once(spark):
    edges = spark.createDataFrame([(1, "a.utils.x", "b.api.y", "import"), (1, "b.api.y", "a.utils.x", "import"), (1, "z", "b.api", "import"), (1, "a.services.core", "b.views", "import"), (1, "a.dao", "b.api", "inherit")], "scan_id long, src string, dst string, kind string")
    found = architecture.dotted_violations(edges)
    assert sorted(tuple(r) for r in found.collect()) == [(1, "a.services.core", "application", "b.views", "presentation", "error"), (1, "a.utils.x", "infra", "b.api.y", "presentation", "error")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("split") <= 4


def test_windows_are_shuffled_once(spark):
    plan = text_plans.q_token_windows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
