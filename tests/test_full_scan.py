"""F5 q_full_scan: totals need neither source lines nor places, and facts of a place are made by the parse; against brute force."""

from __future__ import annotations

import ast
import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import java_facts, python_facts
from quarry.operators import clones, rules
from quarry.plans import derived, graph_plans
from quarry.plans.scan import scan
from quarry.sources.corpus import from_rows

SOURCE = '''"""Text."""
import os
import b, a
x = 5
from c import *
class K:
    one: int = 3
    if x:
        two = 4
    else:
        three = 5
    def m(self):
        class Inner:
            def deep(self):
                return 1
                print(2)
                print(3)
        self.four = yes = True
        for i in x:
            break
            i = 7
def f(a):
    A, B = 1, 2
    c = d = a
    c.e = 9
    return d
'''


def test_totals_collect_nothing(spark):
    plan = graph_plans.q_full_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" not in plan and "code_snippet" not in plan


def test_facts_of_a_place():
    rows = python_facts.nodes(SOURCE)
    lean = python_facts.nodes(SOURCE, frozenset(python_facts.SCANNED), True)
    kinds = {"FunctionDef", "ClassDef", "Import", "ImportFrom", "Name"}
    assert [r for r in lean if r["kind"] in kinds] == [r for r in rows if r["kind"] in kinds]
    of = {(r["kind"], r.get("name"), r["line"]): r for r in rows}
    assert [(r["line"], r["late"], r["head"]) for r in rows if r["kind"] in ("Import", "ImportFrom")] == [(2, False, True), (3, False, True), (5, True, False)]
    assert {r["name"] for r in rows if r.get("member")} == {"one", "two"}
    assert {r["name"]: r["holds"] for r in rows if r.get("holds")} == {"x": "Constant", "two": "Constant", "three": "Constant", "yes": "bool", "c": "Name", "d": "Name", "i": "Constant"}
    assert [(r["kind"], r["line"], r["dead_line"]) for r in rows if r.get("dead_line")] == [("FunctionDef", 14, 16), ("For", 19, 21)]
    assert of["FunctionDef", "f", 22]["gap"] == 0 and of["ClassDef", "K", 6]["gap"] == 0
    assert {r["name"]: r["n_functions"] for r in rows if r["kind"] == "ClassDef"} == {"K": 2, "Inner": 1}
    assert {r["line"] for r in rows if r.get("by_constant")} == {4}
    assert python_facts.nodes("")[0]["kind"] == "Module" == type(ast.parse("")).__name__


def test_words_are_the_tokens(spark):
    text = "def f(a, b):  # c\n  return 'x' + f'{a}y' + 1.5 if b else None\n#d\n'''p\nq'''\nx = (\n"
    kept = [t for t in python_facts.tokens(text) if t["kind"] not in python_facts.LAYOUT]
    words, line, end, *marks = python_facts.python_words(text)
    assert words == [python_facts.PLACEHOLDERS.get(t["kind"], t["value"]) for t in kept] and len(words) > 20
    assert (line, end) == ([t["line"] for t in kept], [t["end_line"] for t in kept])
    assert list(zip(*marks, strict=True)) == [("# c", 1, 14), ("#d", 3, 0)]
    words, line, end, *marks = java_facts.java_words('/* 1 */ int a = 12;\nString s = """x\ny"""; // 3\n')
    assert words == ["int", "ID", "=", "NUM", ";", "ID", "ID", "=", "STR", ";"] and end[-2:] == [3, 3]
    assert list(zip(*marks, strict=True)) == [("12", 1, 16)]


def test_windows_tell_what_a_range_hides(spark):
    rng = random.Random(5)
    files = [(s, f"f{i}", [rng.choice("ab") for _ in range(n)]) for s in (1, 2) for i, n in enumerate([0, 3, 4, 40, 90])]
    rows = [(s, p, w, [*range(1, len(w) + 1)], [i + rng.randrange(3) for i in range(1, len(w) + 1)]) for s, p, w in files]
    ranges = [(s, f"f{i}", a := rng.randrange(1, 90), a + rng.randrange(2, 12)) for s in (1, 2) for i in range(6) for _ in range(4)]
    df = spark.createDataFrame(rows, "scan_id long, rel_path string, words array<string>, line array<int>, end_line array<int>")
    r = spark.createDataFrame([*ranges, (1, "f3", None, 99)], "scan_id long, rel_path string, lo int, hi int")
    got = {(x.scan_id, x.rel_path, x.start): x for x in clones.windows(df, 4, r).collect()}
    want = {(s, p, i): (line[i], end[i + 3], "".join(w[i : i + 4])) for s, p, w, line, end in rows for i in range(len(w) - 3)}
    assert got.keys() == want.keys()
    hidden = {k: any((k[0], k[1]) == (s, p) and lo <= a and b <= hi for s, p, lo, hi in ranges) for k, (a, b, _) in want.items()}
    assert {k: x.hidden for k, x in got.items()} == hidden and 0 < sum(hidden.values()) < len(hidden)
    assert all((x.start_line, x.end_line) == want[k][:2] for k, x in got.items())
    texts = {}
    for k, x in got.items():
        texts.setdefault((x.hash, x.check), set()).add(want[k][2])
    assert all(len(t) == 1 for t in texts.values()) and len(texts) == len({v[2] for v in want.values()})
    groups = {}
    for k, (a, b, t) in want.items():
        groups.setdefault((k[0], t), []).append((k[1], a, b, hidden[k]))
    blocks = clones.token_blocks(clones.windows(df, 4, r), 3).collect()
    sets = {(s, tuple(sorted(p[:2] for p in ps))) for (s, _), ps in groups.items() if len(ps) > 1 and sum(b - a + 1 for _, a, b, _ in ps) / len(ps) >= 3}
    assert len(blocks) == len(sets) and {b.n for b in blocks} == {len(p) for _, p in sets}


@pytest.fixture(scope="module")
def made(spark):
    return scan(derived.files(spark, "/root/testdata/sf0.001"))


def test_duplications_are_the_merged_clones(spark, made):
    f = made.facts
    shapes = clones.shape_clones(f.nodes.select("scan_id", "rel_path", "line", "end_line", "skeleton").unionByName(f.java.filter("kind = 'method'").select("scan_id", "rel_path", "line", "end_line", F.sha2("shape", 256).alias("skeleton"))))
    tokens = clones.normalised(f.py_tokens.unionByName(f.java_tokens))
    want = sorted(map(str, clones.merged_clones(clones.token_clones(clones.windows(tokens)), shapes).collect()))
    assert sorted(map(str, made.duplications.collect())) == want and len(want) > 50


def test_counts_are_those_of_the_issues(made):
    issues = made.issues.groupBy("scan_id").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("error", "warning", "info")])
    assert sorted(map(tuple, issues.collect())) == sorted((r.scan_id, r.n_error, r.n_warning, r.n_info) for r in made.totals.collect())


def test_parens_and_jumps_by_lines(spark):
    java = "class A {\n/* if(a)\n while(b) */ if(c)\n for(d) // e\n//if(f)\n /* x */ if(g)\n/*/\nif(k)\n*/\nif(l) /* m\nif(n)\n}\n"
    jump = "class B {\n int h() {\n  return 1;\n\n  // i\n  int j;\n }\n int k() {\n  return 2;\n }\n int l() {\n   return 3;\n  int m;\n }\n}\n"
    found = rules.run_rules(rules.Facts(from_rows(spark, [(1, "A.java", "java", java), (1, "B.java", "java", jump)])), ["JA-S001", "JA-D003"]).collect()
    # a line that ends a comment (also /*/) and one that begins with a comment pass as a whole; a comment that begins within a line opens none
    assert sorted((r.rule_code, r.line) for r in found) == [("JA-D003", 6), ("JA-S001", 4), ("JA-S001", 8), ("JA-S001", 10), ("JA-S001", 11)]
