"""Source files, module paths, edges, types and calls made from the given tables by rule: as DataFrames, and as SQL.

Every document becomes one file, of all its words: each run of ``WORDS`` words is the stuff of one block of code, and the
lengths of its first words choose the block's form. So equal passages become equal code, and a corpus has as many files, lines
and clones as the documents have texts, lines and copies. Both sides are made from the same templates, in which {a} to {p}
stand for the words of a run.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.lines import once

WORDS = 16
_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIRS = ("controllers", "services", "repository", "models", "infra", "views", "events", "api", "utils", "core")

PYTHON = (
    'def {a}_{b}(v_{c}, v_{d}=2):\n    """{e} {f} {g}."""\n    total = 0\n    for item in v_{c}:\n        if item > 42 and v_{d}:\n            total = total + item\n'
    "        elif item < 0:\n            continue\n        else:\n            total += 1\n    return {h}_{i}(total)  # {j} {k} {l} {m} {n} {o} {p}\n",
    "class C{a}(B{b}):\n    size = 0\n    kind_{c} = '{d}'\n\n    def __init__(self, v_{e}):\n        self.v_{f} = v_{e}\n        self.w_{g} = []\n\n    def {h}_run(self):\n"
    "        # {i} {j} {k}\n        return {l}_{m}(self.v_{f})\n\n    def _{n}(self):\n        pass  # {o} {p}\n",
    "import {a}_mod\nfrom {b}_pkg import {c}_part, {d}_rest\n#{e} {f} {g} {h} {i} {j} {k} {l}\n{d}_rest({m}_{n}, '{o} {p}')\n",
    "k_{a} = 7.5\nRATE_{b} = [{c}_x,{d}_y]\nZ{e} = k_{a}*2\nq = '{f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}'\n",
    "def Bad{a}(b_{b}, c_{c}, d_{d}, e_{e}, f_{f}, g_{g}):\n    unused_{h} = 17\n    return b_{b}\n    print('{i} {j} {k} {l} {m} {n} {o} {p}')\n",
    "def {a}_read(path):\n  try:\n    with open(path) as f_{b}:\n      for row in f_{b}:\n        while row:\n          if row == '{c}':\n            row = {d}_{e}(row)\n"
    "          if row and path:\n            break\n  except ValueError:\n    return None\n  return '{f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}'\n",
    "def {a}_tab():\n\tx = 1\n\treturn [x for x in '{b} {c} {d}'.split() if x]\n# {e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}\n",
    "from {a}_all import *\n\n\nclass D{b}:\n    \"\"\"{c} {d} {e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p} {c} {d} {e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}.\"\"\"\n\n    {a}_count = 3\n",
)
JAVA = (
    "    /** {a} {b} {c}.\n     * @param v_{d} {e}\n     */\n    public int {f}{g}(int v_{d}, int w_{h}) {\n        int q = 12;\n        if(v_{d} > 5 && w_{h} > 0) {\n            return v_{d} + 7;\n        }\n"
    "        for (int i = 0; i < v_{d}; i++) {\n            try { q += {i}{j}(i); } catch (Exception ex) {}\n        }\n        return q; // {k} {l} {m} {n} {o} {p}\n    }\n",
    "    private static final int {a} = 10;\n    String s_{b} = \"{c} {d} {e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}\";\n",
    "    public List<String> {a}(int b, int c, int d, int e, int f, int g) {\n        // {b} {c} {d} {e}\n        return null;\n        {f}({g}, \"{h} {i} {j} {k} {l} {m} {n} {o} {p}\");\n    }\n",
    "    /* {a} {b}\n       {c} {d} {e} */\n    void Run{f}(String k) {\n        while(k != null) {\n            switch (k) { case \"{g}\": k = {h}(k); break; default: k = null; }\n        }\n"
    "\tString t = \"{i} {j} {k} {l} {m} {n} {o} {p}\";\n    }\n",
    "    /** {a} {b} {c} {d}. */\n    public interface I{e} {\n        String {f}(String key); // {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}\n    }\n",
)
CONFIG = (
    "{a}_password = {b}{c}\n# {d} {e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}\n",
    "{a}.token: ${{b}}\n{c}.{d} = {e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}\n",
    "debug.{a} = true\n{b}_secret = admin\n{c} = {d} {e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}\n",
    "{a}_url = http://{b}.example.com/{c}\nlocal_{d} = http://localhost:1\n; {e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}\n",
    "{a}.allowed-origins = \"*\"\n{b}-{c}: '{d} {e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}'\n",
)
JSON = (
    '  "{a}_password": "{b}{c}",\n  "{d}": ["{e}", "{f}", "{g}", "{h}", "{i}", "{j}", "{k}", "{l}", "{m}", "{n}", "{o}", "{p}"],\n',
    '  "debug_{a}": "on",\n  "{b}_url": "http://{c}.example.org",\n  "{d}": "{e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}",\n',
    '  "cors_{a}": "*",\n  "{b}_token": "secret",\n  "{c}": {"{d}": "{e} {f} {g} {h} {i} {j} {k} {l} {m} {n} {o} {p}"},\n',
)


def _pieces(template: str) -> list[str | int]:
    """A template as texts and numbers of words."""
    parts = re.split(r"\{([a-p])\}", template)
    return [p if i % 2 == 0 else ord(p) - 97 for i, p in enumerate(parts) if p or i % 2]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- the same rule twice: columns, and SQL ----


def _literal(text: str) -> str:
    """A text in Spark's SQL. A dollar sign would begin a variable."""
    for c, code in (("\\", "\\\\"), ("'", "\\'"), ("$", "\\u0024"), ("\n", "\\n"), ("\t", "\\t")):
        text = text.replace(c, code)
    return f"'{text}'"


def _blocks(templates: tuple[str, ...]) -> str:
    """Blocks of ``w``, whose size is a multiple of ``WORDS``: a run of words meets the number of its template, then that template."""
    pick = f"(length(w[g]) * 7 + length(w[g + 1]) * 3 + length(w[g + 2])) % {len(templates)}"
    cases = " ".join(f"WHEN r.k = {k} THEN concat({', '.join(_literal(p) if isinstance(p, str) else f'r.b[{p}]' for p in _pieces(t))})" for k, t in enumerate(templates))
    runs = f"transform(sequence(0, size(w) - 1, {WORDS}), g -> struct(slice(w, g + 1, {WORDS}) AS b, {pick} AS k))"
    return f"CASE WHEN size(w) > 0 THEN array_join(transform({runs}, r -> CASE {cases} END), chr(10)) ELSE '' END"


def _blocks_sql(templates: tuple[str, ...]) -> str:
    def word(i: int) -> str:
        return f"coalesce(w[g * {WORDS} + {i + 1}], 'pad')"

    cases = " ".join(f"WHEN {k} THEN {' || '.join(quoted(p) if isinstance(p, str) else word(p) for p in _pieces(t))}" for k, t in enumerate(templates))
    pick = f"(length({word(0)}) * 7 + length({word(1)}) * 3 + length({word(2)})) % {len(templates)}"
    return f"array_to_string(list_transform(range((len(w) + {WORDS - 1}) // {WORDS}), lambda g: CASE {pick} {cases} END), chr(10))"


_LANGUAGE = "CASE lang WHEN 'de' THEN 'java' WHEN 'fr' THEN 'config' ELSE 'python' END"
_DIR = f"CASE doc_id % 10 {' '.join(f'WHEN {i} THEN {quoted(x)}' for i, x in enumerate(DIRS))} ELSE 'core' END"
_SUFFIX = "CASE doc_id % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.ini' WHEN 2 THEN '.properties' ELSE '.yaml' END"
#: Paths: some modules have names against the rule.
_PATH = f"""CASE language WHEN 'python' THEN 'app/' || dir || CASE WHEN doc_id % 7 = 0 THEN '/Mod-' ELSE '/mod_' END || doc_id || '.py'
WHEN 'java' THEN 'src/main/java/shop/' || dir || '/C' || doc_id || '.java' ELSE 'config/' || dir || '/s' || doc_id || {_SUFFIX} END"""
_HEAD = r"""CASE WHEN language = 'python' THEN '"Made of words."' || chr(10) || 'import os' || chr(10) || 'from app.' || dir || ' import mod_' || doc_id % 100 || chr(10) || 'import json, sys' || chr(10) || chr(10)
WHEN language = 'java' THEN 'package shop.' || CASE WHEN doc_id % 9 = 0 THEN 'Made' ELSE dir END || ';' || chr(10) || 'import java.util.List;' || chr(10) || 'import java.util.*;' || chr(10) || 'import java.io.File;' || chr(10) || 'import shop.' || dir || '.C' || doc_id % 50 || ';' || chr(10) || chr(10)
|| 'public class ' || CASE WHEN doc_id % 5 = 0 THEN 'c' ELSE 'C' END || doc_id || ' {' || chr(10)
WHEN rel_path LIKE '%.json' THEN '{' || chr(10) WHEN rel_path LIKE '%.ini' THEN '[main]' || chr(10) ELSE '' END"""
_TAIL = r"""CASE WHEN language = 'java' THEN '}' || chr(10) WHEN rel_path LIKE '%.json' THEN CASE WHEN doc_id % 8 = 0 THEN '}' ELSE '  "end": 1' || chr(10) || '}' END || chr(10) ELSE '' END"""
_SCAN = r"coalesce(CAST(regexp_extract(source, '[0-9]+', 0) AS BIGINT), 0)"


def files(spark: SparkSession, d: str) -> DataFrame:
    """The corpus: scan_id (the number of the source), rel_path, language, text; the operators' own input."""
    rows = spark.read.parquet(f"{d}/documents.parquet").select(
        "doc_id", F.expr(_SCAN).alias("scan_id"), F.expr(_LANGUAGE).alias("language"), F.expr(_DIR).alias("dir"),
        F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), _ABC, _ABC.lower()), F.lit("[a-z]+"), F.lit(0)).alias("w"),
    )
    # the last run is filled up
    rows = rows.withColumns({"rel_path": F.expr(_PATH), "w": F.expr(f"concat(w, array_repeat('pad', pmod(-size(w), {WORDS})))")})
    body = f"CASE WHEN language = 'python' THEN {_blocks(PYTHON)} WHEN language = 'java' THEN {_blocks(JAVA)} WHEN rel_path LIKE '%.json' THEN {_blocks(JSON)} ELSE {_blocks(CONFIG)} END"
    # a filter on a text or its lines would else be pushed down to here, and find the words of the text anew for each word of a block
    return rows.select("scan_id", "rel_path", "language", once(F.concat(F.expr(_HEAD), F.expr(body), F.expr(_TAIL))).alias("text"))


def _paths_sql() -> str:
    return f"(SELECT *, {_PATH} AS rel_path FROM (SELECT doc_id, text, {_SCAN} AS scan_id, {_LANGUAGE} AS language, {_DIR} AS dir FROM documents))"


CORPUS_SQL = f"""(SELECT scan_id, rel_path, language, {_HEAD} || CASE WHEN language = 'python' THEN {_blocks_sql(PYTHON)} WHEN language = 'java' THEN {_blocks_sql(JAVA)}
WHEN rel_path LIKE '%.json' THEN {_blocks_sql(JSON)} ELSE {_blocks_sql(CONFIG)} END || {_TAIL} AS text
FROM (SELECT *, regexp_extract_all(translate(coalesce(text, ''), '{_ABC}', '{_ABC.lower()}'), '[a-z]+') AS w FROM {_paths_sql()}))"""

#: A module for each supplier and each part, and an import for each line item; scans are the return flags.
_FLAG = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END"
_TOPS = ("app", "cmd", "internal", "pkg", "services")


def _module(prefix: str, key: str) -> str:
    top = f"CASE {key} % 5 {' '.join(f'WHEN {i} THEN {quoted(x)}' for i, x in enumerate(_TOPS))} END"
    place = f"CASE ({key} * 7 + 3) % 10 {' '.join(f'WHEN {i} THEN {quoted(x)}' for i, x in enumerate(DIRS))} END"
    return f"{top} || '/' || {place} || '/{prefix}' || {key} || '.py'"


_EDGE_COLUMNS = [f"CAST({_FLAG} AS BIGINT) AS scan_id", f"{_module('s', 'l_suppkey')} AS src", f"{_module('p', 'l_partkey')} AS dst"]
EDGES_SQL = f"(SELECT DISTINCT {', '.join(_EDGE_COLUMNS)} FROM lineitem)"
PATHS_SQL = f"(SELECT DISTINCT scan_id, unnest([src, dst]) AS file_path FROM {EDGES_SQL})"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*_EDGE_COLUMNS).distinct()


def modules(spark: SparkSession, d: str) -> DataFrame:
    """scan_id, file_path of the modules that stand at an edge."""
    return edges(spark, d).select("scan_id", F.explode(F.array("src", "dst")).alias("file_path")).distinct()


#: Dotted edges: most are imports.
_DOTTED = ("shop.utils", "shop.services", "shop.api", "shop.models", "shop.engines", "shop.other")


def _dotted(key: str) -> str:
    return f"CASE {key} % 6 {' '.join(f'WHEN {i} THEN {quoted(x)}' for i, x in enumerate(_DOTTED))} END || '.m' || {key}"


_DOTTED_COLUMNS = [f"CAST({_FLAG} AS BIGINT) AS scan_id", f"{_dotted('l_suppkey')} AS src", f"{_dotted('l_partkey')} AS dst", "CASE WHEN l_linenumber = 1 THEN 'inherit' ELSE 'import' END AS kind"]
DOTTED_SQL = f"(SELECT DISTINCT {', '.join(_DOTTED_COLUMNS)} FROM lineitem)"


def dotted_edges(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(*_DOTTED_COLUMNS).distinct()


#: Types: a class or interface for each part, named after its type and size.
_SUFFIXES = ("Factory", "Builder", "Repository", "Dao", "Helper", "Manager", "Service", "", "Bus")
_METHODS = ("get_instance,load", "create_shape,build", "find_by_id,save,count", "subscribe,publish", "apply", "getItem,insertItem,query", "register,fire", "execute", "run,close", "find")
_NAME = f"'T' || p_partkey || CASE p_size % 9 {' '.join(f'WHEN {i} THEN {quoted(x)}' for i, x in enumerate(_SUFFIXES))} END"
_METHOD = f"CASE p_partkey % 10 {' '.join(f'WHEN {i} THEN {quoted(x)}' for i, x in enumerate(_METHODS))} END"
_PARENTS = "CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'T' || p_partkey % 40 ELSE 'A,B,C,D,T' || p_partkey % 30 END"
_TYPE_COLUMNS = ["1 AS scan_id", "'m.t' || p_partkey AS module_id", "CASE WHEN p_partkey < 40 THEN 'T' || p_partkey ELSE {name} END AS name", "CASE WHEN p_partkey < 40 OR p_size % 5 = 0 THEN 'interface' ELSE 'class' END AS kind"]
TYPES_SQL = f"(SELECT {', '.join(_TYPE_COLUMNS).format(name=_NAME)}, string_split({_METHOD}, ',') AS methods, list_filter(string_split({_PARENTS}, ','), lambda x: x <> '') AS parents FROM part)"


def types(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.read.parquet(f"{d}/part.parquet")
    parents = F.filter(F.split(F.expr(_PARENTS), ","), lambda x: x != "")
    columns = [F.expr(c.format(name=_NAME)) for c in _TYPE_COLUMNS]
    return rows.select(*columns, F.split(F.expr(_METHOD), ",").alias("methods"), parents.alias("parents"))


#: A function for each order, in its customer's file, and a call for each line item.
_FUNCTION = ["CAST(1 AS BIGINT) AS scan_id", "'c' || o_custkey || '.py' AS rel_path", "'f' || o_orderkey % 6000 AS name", "CASE WHEN o_orderkey % 3 = 0 THEN 'K.' ELSE '' END || 'f' || o_orderkey % 6000 AS qname"]
_CALL = ["CAST(1 AS BIGINT) AS scan_id", "'c' || o_custkey || '.py' AS rel_path", "CASE WHEN o_orderkey % 3 = 0 THEN 'K.' ELSE '' END || 'f' || o_orderkey % 6000 AS caller", "'f' || l_partkey * 7 % 20000 AS callee"]
FUNCTIONS_SQL = f"(SELECT {', '.join(_FUNCTION)} FROM orders)"
CALLS_SQL = f"(SELECT {', '.join(_CALL)} FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def functions(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").selectExpr(*_FUNCTION)


def calls(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey")
    return spark.read.parquet(f"{d}/lineitem.parquet").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(*_CALL)


#: Paths of documents below directories of which some are never walked.
_TREES = ("a/node_modules", "a", ".git", "build", "x", "lib/.cache", "venv/lib")
_TREE = f"CASE doc_id % 7 {' '.join(f'WHEN {i} THEN {quoted(x)}' for i, x in enumerate(_TREES))} END || '/d' || doc_id || '.py'"
TREE_SQL = f"(SELECT {_TREE} AS path FROM documents)"


def tree(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").selectExpr(f"{_TREE} AS path")
