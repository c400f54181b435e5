"""Small cases of the findings of round 4: each failed before."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quarry.operators import lines
from quarry.plans import derived, text_plans


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def words_sought(df) -> int:
    """How often a plan looks for the words of a text."""
    return plan_of(df).count("regexp_extract_all(")


LINE_RULES = ["q_cfg_cors", "q_cfg_debug", "q_cfg_secret", "q_cfg_syntax", "q_cfg_url", "q_cfg_weak", "q_comma_space", "q_indent_multiple", "q_keyword_paren", "q_mixed_indent", "q_mixed_indent_java", "q_operator_space"]


@pytest.mark.parametrize("name", LINE_RULES)
def test_line_rules_make_a_text_once(spark, name):
    """The words of a text are found once, not anew for each word of a block in a filter that was pushed down to the table."""
    df = text_plans.Q[name](spark, "/root/testdata/sf0.001")
    assert words_sought(df.select("rel_path", "line", "rule_code")) == 1


def test_made_texts_pass_words_and_odd_rows(spark, tmp_path):
    words = "a b c d e f g h i j k l m n o p"
    rows = [(1, None, "fr", "s1"), (2, "", "de", "s1"), (3, "it's \\n ${x} Ä", "fr", "s1"), (4, words + " q", "fr", "s1"), (5, words, "xx", "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.rel_path: r.text for r in derived.files(spark, str(tmp_path)).collect()}
    assert found["config/services/s1.ini"] == "[main]\n"
    assert found["src/main/java/shop/repository/C2.java"].endswith("public class C2 {\n}\n")
    duck = pytest.importorskip("duckdb").connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert found == dict(duck.execute(f"SELECT rel_path, text FROM {derived.CORPUS_SQL}").fetchall())


def test_a_value_made_once_stops_filters(spark):
    rows = spark.createDataFrame([("a\nb\n",), ("",), (None,), ("\n",)], "text string")
    df = rows.select("text", lines.once(lines.line_array(F.col("text"))).alias("ls")).filter(F.exists("ls", lambda x: x == "b"))
    assert [r.ls for r in df.collect()] == [["a", "b"]] and plan_of(df).count("split(") == 1
    assert [r.ls for r in rows.select(lines.line_array(F.col("text")).alias("ls")).collect()] == [["a", "b"], [], [], [""]]


@pytest.mark.parametrize(("name", "language"), [("q_py_rules", "python"), ("q_java_rules", "java"), ("q_config_rules", "config")])
def test_rules_of_a_language_keep_its_files_only(spark, monkeypatch, name, language):
    from quarry.plans import graph_plans

    monkeypatch.setattr(graph_plans, "run_rules", lambda facts, codes: facts)
    facts = graph_plans.Q[name](spark, "/root/testdata/sf0.001")
    try:
        assert [r.language for r in facts.corpus.select("language").distinct().collect()] == [language]
    finally:
        facts.close()
