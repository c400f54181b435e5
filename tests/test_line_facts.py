"""Facts of lines, the resolvers of imports, and the corpus that is made from documents."""

import ast

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.functions.line_facts import JavaLines, PythonLines, line_facts
from quarry.operators import graph
from quarry.plans import derived
from quarry.plans.scan import architecture_facts, dependency_graph
from quarry.sources.corpus import from_rows

PY = '''import os as o, sys
from .near import a, b as c
from .. import up
from pkg.mod import *
from pkg import (x, y)
top = make(1)
same == 2
class A(Base, metaclass=M):
    """doc
    class Hidden:
    """
    def m(self):  # not_a_call()
        return helper("# no comment") + self.other(3)

    class Inner:
        def deep(self): pass
    def again(self):
        print(len(x), real(1))
def free(q):
    s = \'\'\'text\'\'\'
    return m(q)
value = free(2)
'''
JAVA = """package a.b;
import java.util.*;
import static a.b.C.d;
/* class Hidden {
*/ public class Shop extends Base<T, List<U>> implements One, x.Two {
    int n = count("call(");  // other(
    public List<String> names(int a) throws E, F {
        if (a > 0) { return new ArrayList(go(a)); }
    }
    interface Inner { String k(); }
    enum Kind {
        A;
        void act() { run(); }
    }
    void last() {
        end();
    }
}
"""


def facts_of(state, text):
    return [(*fact, i) for i, raw in enumerate(text.split("\n"), 1) for fact in state.read(raw)]


def test_python_lines():
    got = facts_of(PythonLines(), PY)
    assert [(f[1], f[2], f[4]) for f in got if f[0] == "import"] == [
        ("os", "import", False), (".near", "import", False), (".near.a", "import", False), (".near.b", "import", False), ("..", "import", False),
        ("..up", "import", False), ("pkg.mod", "import", True), ("pkg", "import", False), ("pkg.x", "import", False), ("pkg.y", "import", False), ("Base", "inherit", False),
    ]
    assert [(f[1], f[2], f[3], f[5]) for f in got if f[0] == "symbol"] == [
        ("A", "class", None, 8), ("m", "method", "A", 12), ("Inner", "class", "A", 15), ("deep", "method", "Inner", 16), ("again", "method", "A", 17), ("free", "function", None, 19),
    ]
    assert [(f[3], f[1], f[5]) for f in got if f[0] == "call"] == [("m", "helper", 13), ("m", "other", 13), ("again", "real", 18), ("free", "m", 21), ("free", "free", 22)]
    assert [(f[1], f[5]) for f in got if f[0] == "write"] == [("top", 6), ("value", 22)]


def test_java_lines():
    got = facts_of(JavaLines(), JAVA)
    assert [(f[1], f[2], f[4]) for f in got if f[0] == "import"] == [("java.util", "import", True), ("a.b.C.d", "import", False), ("Base", "inherit", False), ("One", "inherit", False), ("x.Two", "inherit", False)]
    assert [(f[1], f[2], f[3], f[5]) for f in got if f[0] == "symbol"] == [
        ("Shop", "class", None, 5), ("names", "method", "Shop", 7), ("Inner", "interface", "Shop", 10), ("Kind", "enum", "Inner", 11), ("act", "method", "Kind", 13), ("last", "method", "Inner", 15),
    ]
    assert [(f[3], f[1], f[5]) for f in got if f[0] == "call"] == [
        ("<static>", "count", 6), ("names", "names", 7), ("names", "ArrayList", 8), ("names", "go", 8), ("act", "act", 13), ("act", "run", 13), ("last", "last", 15), ("last", "end", 16),
    ]


@pytest.fixture(scope="module")
def made(spark):
    return derived.files(spark, "/root/testdata/sf0.001")


def test_facts_of_many_files_equal_a_loop(spark, made):
    got = sorted(tuple(r) for r in line_facts(made.withColumn("line_no", F.lit(3)).repartition(5)).collect())
    want = []
    for r in made.filter("language <> 'config'").collect():
        state = JavaLines() if r.language == "java" else PythonLines()
        want += [(r.scan_id, r.rel_path, *fact) for fact in facts_of(state, r.text)]
    assert got == sorted(want, key=lambda r: tuple((x is not None, x) for x in r)) or sorted(map(repr, got)) == sorted(map(repr, want))
    assert len(got) > 3000
    # the syntax tree names the same functions and classes
    symbols = {(r[1], r[3], r[7]) for r in got if r[2] == "symbol" and r[1].endswith(".py")}
    trees = set()
    for r in made.filter("language = 'python'").collect():
        trees |= {(r.rel_path, n.name, n.lineno) for n in ast.walk(ast.parse(r.text)) if isinstance(n, ast.FunctionDef | ast.ClassDef)}
    assert symbols == trees


def test_no_facts(spark):
    rows = [(1, "a.py", "python", None), (1, "b.py", "python", ""), (1, "c.ini", "config", "import x"), (2, "d.java", "java", "\n\n")]
    assert line_facts(from_rows(spark, rows)).count() == 0
    assert line_facts(from_rows(spark, [])).count() == 0


def test_made_files_equal_their_sql(spark, made):
    with duckdb.connect() as con:
        con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
        want = con.execute(f"SELECT * FROM {derived.CORPUS_SQL}").fetchall()
    assert sorted(tuple(r) for r in made.collect()) == sorted(want)


def test_imports_in_three_steps(spark):
    modules = spark.createDataFrame([(1, m) for m in ("app/a/user", "app/user", "lib/x/deep", "y/deep", "tool")] + [(2, "user"), (1, None)], "scan_id long, module_id string")
    symbols = spark.createDataFrame([(1, "Shop", "app/user"), (1, "Shop", "tool"), (1, "user", "tool"), (2, "Other", "user"), (1, None, "tool")], "scan_id long, name string, module_id string")
    wanted = {
        "user": ("app/a/user", 1), "a.user": ("app/a/user", 1), "z.app.user": ("app/user", 1), "pkg.Shop": ("tool", 2), "other.user": ("tool", 2),
        "q.deep": ("y/deep", 3), "none": None, "": None, "..": None,
    }
    imports = spark.createDataFrame([(1, "s", t) for t in wanted] + [(1, "s2", "user"), (2, "s", "q.user"), (2, "s", "q.Other")], "scan_id long, src string, target string")
    got = {(r.scan_id, r.src, r.target): (r.dst, r.step) for r in graph.resolve_imports(imports, modules, symbols).collect()}
    want = {(1, "s", t): v for t, v in wanted.items() if v} | {(1, "s2", "user"): ("app/a/user", 1), (2, "s", "q.user"): ("user", 1), (2, "s", "q.Other"): ("user", 2)}
    assert got == want
    plain = {r.target: r.step for r in graph.resolve_imports(imports, modules).filter("scan_id = 1").collect()}
    assert plain["other.user"] == 3 and "pkg.Shop" not in plain


def test_dotted_targets(spark):
    modules = spark.createDataFrame([(1, m) for m in ("a.b.c", "x.c", "c.d", "k")], "scan_id long, module_id string")
    targets = {"c": "a.b.c", "b.c": "a.b.c", "x.c.Name": "x.c", "k.f": "k", "zz": None, "q.d": None, "d": "c.d"}
    imports = spark.createDataFrame([(1, t) for t in targets], "scan_id long, target string")
    assert {r.target: r.dst for r in graph.resolve_dotted(imports, modules).collect()} == {t: m for t, m in targets.items() if m}


def test_edges_of_a_tree(spark):
    rows = [
        (1, "pkg/__init__.py", "python", "from . import mod\n"),
        (1, "pkg/mod.py", "python", "from .sub.deep import f\nfrom ..outer import g\nimport os\nclass K(deep.Base):\n    pass\n"),
        (1, "pkg/sub/deep.py", "python", "import pkg.mod\nfrom pkg.mod import K, *\n"),
        (1, "outer.py", "python", "from . import pkg\nfrom .missing import z\n"),
        (1, "src/main/java/com/A.java", "java", "import com.B;\nimport com.*;\nclass A extends B {\n}\n"),
        (1, "src/main/java/com/B.java", "java", "class B {\n}\n"),
    ]
    edges = architecture_facts(from_rows(spark, rows))["edges"]
    got = {(r.src, r.dst, r.kind, r["count"], r.is_wildcard) for r in edges.collect()}
    assert got == {
        ("pkg", "pkg.mod", "import", 1, False), ("pkg.mod", "pkg.sub.deep", "import", 1, False), ("pkg.mod", "outer", "import", 1, False),
        ("pkg.sub.deep", "pkg.mod", "import", 3, True), ("outer", "pkg", "import", 1, False), ("com.A", "com.B", "import", 1, False), ("com.A", "com.B", "inherit", 1, False),
        ("pkg.mod", "pkg.sub.deep", "inherit", 1, False),
    }


def test_dependency_graph(spark):
    rows = [
        (1, "src/app/shop.py", "python", "import os\nfrom app.store import load\nfrom far.away import Keeper\nimport app.store\n"),
        (1, "src/app/store.py", "python", "def load():\n    pass\n"),
        (1, "src/app/deep/hold.py", "python", "class Keeper:\n    pass\n"),
    ]
    found = dependency_graph(from_rows(spark, rows))
    assert {(r.src, r.dst, r["count"]) for r in found["edges"].collect()} == {("app/shop", "app/store", 2), ("app/shop", "app/deep/hold", 1)}
    assert {(r.module_id, r.fan_in, r.fan_out) for r in found["modules"].collect()} == {("app/shop", 0, 2), ("app/store", 1, 0), ("app/deep/hold", 1, 0)}
