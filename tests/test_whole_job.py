"""Queries that once did a part of their job: the whole of it on small inputs, against brute force."""

import re

from quarry.plans import graph_plans, text_plans
from quarry.plans.scan import architecture_facts
from quarry.sources.corpus import from_rows


def test_token_normalise_reads_texts_of_any_length(spark, tmp_path):
    texts = ['x = "a b" + 12', 'call f1("s") 7 ' * 60, "WORD Word 3", "9 lives " * 400, "", None]
    rows = [(i, t, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")

    def normal(t):
        t = re.sub(r"\b[0-9]+\b", "NUM", re.sub('"[^"]*"', " STR ", t))
        return re.sub("[A-Za-z_]*[a-z_][A-Za-z_]*", "ID", t)

    got = {r.doc_id: r.normal for r in text_plans.q_token_normalise(spark, str(tmp_path)).collect()}
    assert got == {i: t if t is None else normal(t) for i, t in enumerate(texts)}


def test_rolling_hash_of_every_window(spark, tmp_path):
    texts = ["a b c d e f", "Ünï \U0001f600x ▁ d e", "one two three", " a  b ", "", None, "w " * 300 + "tail"]
    rows = [(7, i, "user", t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def value(word):
        h = 0
        for c in word:
            h = (h * 131 + ord(c)) & 0x7FFFFFFF
        return h

    want = set()
    for turn, t in enumerate(texts):
        v = [value(w) for w in (t or "").split(" ")]
        for i in range(len(v) - 3):
            h = 0
            for x in v[i : i + 4]:
                h = (h * 257 + x) % 1_000_000_007
            want.add((7, turn, i, h))
    got = [tuple(r) for r in text_plans.q_rolling_hash(spark, str(tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want


def test_relative_imports_go_to_their_own_package(spark):
    sources = {
        "pkg/__init__.py": "from .core import run\nfrom . import util\n",
        "pkg/core.py": "from . import util\nfrom .missing import x\nfrom .util import *\n",
        "pkg/util.py": "from ..util import x\nfrom ...far import y\n",
        "pkg/sub/deep.py": "from .. import core, util as u\nfrom ..core import run\nfrom .util import z\n",
        "other/long/util.py": "from . import missing\n",
        "other/long/missing.py": "",
        "util.py": "from .top import a\nimport pkg.core\n",
        "top.py": "",
    }
    corpus = from_rows(spark, [(1, p, "python", t) for p, t in sources.items()])
    got = {(r.src, r.dst): (r["count"], r.is_wildcard) for r in architecture_facts(corpus)["edges"].collect()}
    assert got == {
        ("pkg", "pkg.core"): (1, False), ("pkg", "pkg.util"): (1, False),
        ("pkg.core", "pkg"): (1, False), ("pkg.core", "pkg.util"): (2, True), ("pkg.util", "util"): (1, False),
        ("pkg.sub.deep", "pkg"): (1, False), ("pkg.sub.deep", "pkg.core"): (2, False), ("pkg.sub.deep", "pkg.util"): (1, False),
        ("other.long.util", "other.long.missing"): (1, False), ("util", "top"): (1, False), ("util", "pkg.core"): (1, False),
    }


def test_nation_edges_of_all_pairs(spark, tmp_path):
    pairs = [(0, 1), (0, 1), (1, 0), (1, 2), (2, 2), (3, 0), (0, 3), (4, 3)]
    tables = {
        "lineitem": ([(i, a) for i, (a, _) in enumerate(pairs)], "l_orderkey long, l_suppkey long"),
        "orders": ([(i, b) for i, (_, b) in enumerate(pairs)], "o_orderkey long, o_custkey long"),
        "customer": ([(k, k) for k in range(5)], "c_custkey long, c_nationkey int"),
        "supplier": ([(k, k) for k in range(5)], "s_suppkey long, s_nationkey int"),
        "nation": ([(k, k // 2) for k in range(5)], "n_nationkey int, n_regionkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    d = str(tmp_path)
    edges = {(f"{a:02}", f"{b:02}"): pairs.count((a, b)) for a, b in pairs if a != b}
    assert {(r.src, r.dst): r.n for r in graph_plans.q_dep_edges(spark, d).collect()} == edges
    fans = {(m, sum(y == m for _, y in edges), sum(x == m for x, _ in edges)) for e in edges for m in e}
    assert {tuple(r) for r in graph_plans.q_fan(spark, d).collect()} == fans
    near = {("in", x, n) for (x, y), n in edges.items() if y == "03"} | {("out", y, n) for (x, y), n in edges.items() if x == "03"}
    assert {tuple(r) for r in graph_plans.q_neighbours(spark, d).collect()} == near
    crossed = sum(int(x) // 2 != int(y) // 2 for x, y in edges) / len(edges)
    assert graph_plans.q_cross_layer_ratio(spark, d).first().ratio == round(crossed, 6)
