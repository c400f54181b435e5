"""Rules, measures, clones, graphs and scans on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.functions.java_facts import parse
from quarry.functions.python_facts import nodes
from quarry.operators import architecture, clones, complexity, graph, refactor, reports, scoring
from quarry.operators.lines import lines, loc
from quarry.operators.rules import REGISTRY, Facts, rule, rule_rows, rule_stats, run_rules, set_enabled
from quarry.plans import fixtures
from quarry.plans.scan import architecture_facts, scan
from quarry.sources.corpus import from_rows


@pytest.fixture(scope="module")
def facts(spark):
    return Facts(fixtures.files(spark))


@pytest.fixture(scope="module")
def found(facts):
    return {(r.rule_code, r.rel_path.split("/")[-1], r.line) for r in run_rules(facts).collect()}


EXPECTED = [
    ("PY-N002", "calc.py", 23), ("PY-N003", "calc.py", 9), ("PY-N004", "calc.py", 7), ("PY-N005", "Views-old.py", None), ("PY-C001", "calc.py", 9),
    ("PY-C002", "calc.py", 23), ("PY-C003", "calc.py", 31), ("PY-M001", "calc.py", 13), ("PY-S001", "calc.py", 11), ("PY-S002", "calc.py", 9),
    ("PY-S003", "calc.py", 9), ("PY-D001", "calc.py", 2), ("PY-D002", "calc.py", 10), ("PY-D003", "calc.py", 20), ("PY-D004", "calc.py", 39),
    ("PY-IM002", "calc.py", 3), ("PY-IM003", "calc.py", 6), ("PY-I001", "Views-old.py", 7), ("PY-I002", "Views-old.py", 2), ("PY-N001", "Views-old.py", 1),
    ("PY-SM003", "calc.py", 26), ("JA-N001", "account.java", 8), ("JA-N002", "account.java", 13), ("JA-N003", "account.java", 9), ("JA-N004", "account.java", 1),
    ("JA-N005", "account.java", 14), ("JA-C001", "account.java", 8), ("JA-C002", "account.java", 24), ("JA-C003", "account.java", 13), ("JA-D001", "account.java", 4),
    ("JA-D002", "account.java", 19), ("JA-IM001", "account.java", 3), ("JA-M001", "account.java", 14), ("JA-S001", "account.java", 15),
    ("JA-I001", "Store.java", 5), ("JAVA-SM004", "account.java", 13), ("CFG-SEC001", ".env", 2), ("CFG-ENV001", ".env", 5), ("CFG-SEC003", ".env", 7),
    ("CFG-SEC004", ".env", 6), ("CFG-SEC002", ".env", 4), ("CFG-SYN001", "settings.json", 1),
]


@pytest.mark.parametrize("code,name,line", [e for e in EXPECTED if e[2]])
def test_rule_fires(found, code, name, line):
    assert (code, name, line) in found, sorted(x for x in found if x[0] == code)


def test_registry(spark):
    assert len(REGISTRY) == 56
    with pytest.raises(ValueError):
        rule("PY-L001", "python", "x", "info", "again")(lambda f: None)
    set_enabled("PY-L001", False)
    assert not rule_rows(spark).filter("code = 'PY-L001'").first().enabled
    set_enabled("PY-L001", True)
    assert rule_stats(rule_rows(spark)).agg(F.sum("n")).first()[0] == 56


PIECES = {
    "def f():\n    return 1\n": (1, 0, 0),
    "def f(x):\n    if x:\n        return 1\n": (2, 1, 1),
    "def f(x):\n    for i in x:\n        if i and x:\n            break\n    return [a for a in x if a]\n": (6, 5, 2),
    "def f(x):\n    try:\n        pass\n    except E:\n        while x:\n            y = 1 if x else 2\n": (4, 8, 2),
}


def test_python_measures_against_recursion(spark):
    import ast

    def cognitive(node, depth=0):
        score = 0
        if isinstance(node, ast.If | ast.For | ast.AsyncFor | ast.While | ast.Try):
            score, depth = 1 + depth, depth + 1
        elif isinstance(node, ast.IfExp | ast.ExceptHandler):
            score = 1 + depth
        elif isinstance(node, ast.Break | ast.Continue):
            score = 1
        elif isinstance(node, ast.BoolOp):
            score = len(node.values) - 1
        return score + sum(cognitive(c, depth) for c in ast.iter_child_nodes(node))

    nested = "def g(a):\n    while a:\n        def h(b):\n            if b:\n                return b or a\n        a = h(a)\n"
    texts = [*PIECES, nested, fixtures.CALC]
    rows = complexity.python_metrics(Facts(from_rows(spark, [(1, f"{i}.py", "python", t) for i, t in enumerate(texts)])).nodes).collect()
    for r in rows:
        tree = ast.parse(texts[int(r.rel_path[0])])
        fn = next(n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef) and n.name == r.function_name and n.lineno == r.start_line)
        assert r.cognitive == sum(cognitive(c) for c in ast.iter_child_nodes(fn)), r
    got = {r.rel_path: (r.cyclomatic, r.nesting_depth) for r in rows if int(r.rel_path[0]) < 2}
    assert got == {"0.py": (1, 0), "1.py": (2, 1)}


def test_java_parser():
    rows = parse(fixtures.ACCOUNT)
    m = {r["name"]: r for r in rows if r["kind"] == "method"}
    assert m["Add"]["cyclomatic"] == 5 and m["Add"]["cyclomatic_plain"] == 4 and m["Add"]["params"] == ["a", "b", "c", "d", "e", "f"]
    assert m["names"]["returns"] == "List<String>" and m["Add"]["end_line"] == 22
    assert [r["name"] for r in rows if r["kind"] == "field"] == ["limit", "total", "count"]
    assert [r["name"] for r in parse(fixtures.STORE) if r["kind"] == "method"] == ["find", "save"]
    for text in ("", "class", "class A {", "import", "@", "class A { int f( }", "}}}", "/* open", '"open'):
        parse(text)


def test_parse_errors_are_rows(spark):
    assert nodes("def (:")[0]["kind"] == "Error"
    bad = from_rows(spark, [(1, "a.py", "python", "def (:"), (1, "b.py", "python", None), (1, "c.java", "java", None), (1, "d.env", "config", None)])
    assert run_rules(Facts(bad)).count() >= 0 and lines(bad).count() == 1


def test_lines_and_loc(spark):
    c = from_rows(spark, [(1, "a.py", "python", "x = 1\r\n\n# c\n  y\x0b"), (1, "b.py", "python", ""), (1, "c.java", "java", "/* a\n b */ int x;\nint y; // z\n//q\n")])
    assert [r.raw for r in lines(c).filter("rel_path = 'a.py'").orderBy("line_no").collect()] == ["x = 1", "", "# c", "  y"]
    assert {r.rel_path: (r.total_lines, r.loc) for r in loc(c).collect()} == {"a.py": (4, 2), "b.py": (0, 0), "c.java": (4, 1)}


def rabin_karp(values, size, base=257, mod=1_000_000_007):
    h, out = 0, []
    for i, v in enumerate(values):
        if i >= size:
            h = (h - values[i - size] * pow(base, size - 1, mod)) % mod
        h = (h * base + v) % mod
        if i >= size - 1:
            out.append(h)
    return out


def test_windows_roll(spark):
    words = random.Random(0).choices(["if", "ID", "NUM", "(", ")"], k=40)
    rows = spark.createDataFrame([(1, "a", i, "keyword", w, i, i) for i, w in enumerate(words)], "scan_id long, rel_path string, pos int, kind string, value string, line int, end_line int")

    def value(t):
        h = 0
        for c in t:
            h = (h * 131 + ord(c)) & 0x7FFFFFFF
        return h

    got = [r.hash for r in clones.windows(rows, 7).orderBy("start").collect()]
    assert got == rabin_karp([value(w) for w in words], 7) and clones.windows(rows, 41).count() == 0


def test_clones_of_the_copy(spark, facts):
    shape = clones.shape_clones(facts.nodes)
    two = {r.scan_id: len(r.occurrences) for r in shape.collect()}
    assert two == {}  # Total and its copy differ by the dead statement and the sum
    w = clones.windows(clones.normalised(facts.py_tokens), 30)
    assert clones.token_clones(w, 30, 6).filter("scan_id = 1").count() > 0


def test_borders(spark):
    rows = spark.createDataFrame([(90.0,), (89.99,), (75.0,), (60.0,), (59.0,)], "s double")
    assert [r[0] for r in rows.select(scoring.grade(F.col("s"))).collect()] == ["A", "B", "B", "C", "D"]
    one = spark.range(1).select(scoring.spec_score(F.lit(1), F.lit(0), F.lit(0), F.lit(100)), scoring.spec_score(F.lit(9), F.lit(0), F.lit(0), F.lit(0)), scoring.dup_score(F.lit(0.1)), scoring.priority(F.lit("high"), F.lit("medium")))
    assert tuple(one.first()) == (50.0, 100.0, 80.0, 50)


def test_layers(spark):
    e = spark.createDataFrame(fixtures.EDGES, "scan_id long, src string, dst string")
    layers = architecture.file_layers(spark.createDataFrame(fixtures.PATHS, "scan_id long, file_path string"))
    got = {(r.src_layer, r.dst_layer, r.severity, r.kind) for r in architecture.layer_violations(e, layers).collect()}
    assert ("repository", "service", "error", "reverse") in got and ("controller", "infra", "warning", "skip") in got


def test_whole_scan(spark, tmp_path):
    s = scan(fixtures.files(spark))
    t = {r.scan_id: r for r in s.totals.collect()}
    assert set(t) == {1, 2} and 0 <= t[1].overall <= 100 and t[1].grade in "ABCD" and t[1].files == 6
    s.save(str(tmp_path / "out"))
    scan(fixtures.files(spark).filter("scan_id = 2")).save(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/files")).count() == len(fixtures.FILES)
    text = reports.markdown("Scan 1", {"overall": t[1].overall}, s.issues.filter("scan_id = 1"), s.metrics, s.duplications)
    assert text.startswith("# Scan 1") and "| PY-" in text and "<table>" in reports.as_html(text)
    assert reports.write_report(text, str(tmp_path / "r"), "pdf") == "html"
    ids = refactor.merged(refactor.hot_functions(s.metrics), refactor.clone_suggestions(s.duplications), refactor.smell_suggestions(s.issues))
    assert ids.groupBy("scan_id", "id").count().filter("count > 1").count() == 0


def test_architecture_tables(spark):
    f = architecture_facts(fixtures.files(spark))
    assert f["modules"].count() == 7 and f["symbols"].filter("name = 'Add' and parent = 'account'").count() == 1
    assert [(r.src, r.dst) for r in f["edges"].collect()] == [("app.services.calc", "app.services.user_service")]
    assert f["calls"].filter("callee = 'Total'").count() == 1


def test_entry_without_the_pipeline_subpackage():
    """The library's own modules never import the optional subpackage."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['quarry.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'q_spec_score' in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
