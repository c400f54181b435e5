"""The rule registry and all rules: each is a function from fact tables to a table of findings.

A rule yields ``scan_id, rel_path, line, col, end_line, message, code_snippet`` and may yield its own ``severity``;
``run_rules`` adds the rule's code, category and severity. Rules are set operations over the fact tables; the parse
is shared. A rule is added with ``@rule(...)``, and switched by its code.

A rule that needs one row only is added with ``@row_rule(...)`` and gives columns instead of a table: all such rules of a fact
table run in one pass over it, which makes an array of findings for each row and explodes it.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import config as C
from quarry.functions.java_facts import java_facts, java_tokens, java_words
from quarry.functions.python_facts import SCANNED, lexed, python_nodes, python_tokens, python_words
from quarry.operators.lines import line_array, lines, once, strip
from quarry.operators.stage import stored

FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
_FILE = ["scan_id", "rel_path"]


class Facts:
    """The fact tables of a corpus, for readers that share them: the corpus is persisted on first use (it spills; ``close`` frees
    it), and each parsed table is stored as Parquet when it is first asked for, of which a rule reads the columns that it names.

    With ``shared`` off nothing is kept: for a query that reads a table once. ``python`` and ``tokens`` parse what is named only.
    """

    def __init__(self, corpus: DataFrame, settings: C.Settings = C.DEFAULTS, shared: bool = True):
        self._kept: list[DataFrame] = []
        self.shared, self.settings = shared, settings
        # a parse costs far more than the shuffle of a text, so files are dealt evenly before it
        self.dealt = corpus.repartition("scan_id", "rel_path")
        # behind the shuffle a made text is a column, not an expression that each use of it computes anew
        self.corpus = self.dealt.withColumn("ls", once(line_array(F.col("text"))))
        if shared:
            # a text is split into lines once
            self.corpus = self.dealt = self.dealt.withColumn("ls", line_array(F.col("text"))).persist()
            self._kept.append(self.corpus)

    def close(self) -> None:
        while self._kept:
            self._kept.pop().unpersist()

    def _keep(self, df: DataFrame) -> DataFrame:
        return stored(df)[0] if self.shared else df

    @cached_property
    def lines(self) -> DataFrame:
        return lines(self.corpus)

    @cached_property
    def nodes(self) -> DataFrame:
        """Python nodes that rules, measures and shapes read."""
        return self._keep(python_nodes(self.dealt, SCANNED, weighted=True))

    @cached_property
    def metrics(self) -> DataFrame:
        """Measures of Python functions."""
        from quarry.operators.complexity import python_metrics

        return self._keep(python_metrics(self.nodes))

    @cached_property
    def lexed(self) -> DataFrame:
        """One row per Python or Java file: its words for clones, and its comments (Python) or numbers (Java)."""
        python = lexed(self.dealt, "python", python_words).withColumn("language", F.lit("python"))
        return self._keep(python.unionByName(lexed(self.dealt, "java", java_words).withColumn("language", F.lit("java"))))

    def _marks(self, language: str) -> DataFrame:
        zipped = F.arrays_zip(F.col("m_value").alias("value"), F.col("m_line").alias("line"), F.col("m_col").alias("col"))
        return self.lexed.filter(F.col("language") == language).select(*_FILE, F.inline(zipped))

    @cached_property
    def comments(self) -> DataFrame:
        """Python comments: value, line, col."""
        if self.shared:
            return self._marks("python")
        return self.tokens("kind", "value", "line", "col").filter("kind = 'comment'").drop("kind")

    @cached_property
    def java_numbers(self) -> DataFrame:
        """Java numbers: value, line, col."""
        if self.shared:
            return self._marks("java")
        return self.java_tokens.filter("kind = 'number'").select(*_FILE, "value", "line", "col")

    @cached_property
    def documented(self) -> DataFrame:
        """Public Java types and methods with the javadoc text above them."""
        public = _java(self, "class", "interface", "method").filter(_has("public") & ((F.col("kind") != "method") | F.col("returns").isNotNull()))
        return self._keep(java_docs(self, public.select(*_FILE, "kind", "name", "line", "annotations", "params", "returns")))

    @cached_property
    def py_tokens(self) -> DataFrame:
        return self._keep(python_tokens(self.dealt))

    @cached_property
    def java(self) -> DataFrame:
        return self._keep(java_facts(self.dealt))

    @cached_property
    def java_tokens(self) -> DataFrame:
        return self._keep(java_tokens(self.dealt))

    def python(self, kinds: tuple[str, ...], *only: str, weighted: bool = False) -> DataFrame:
        """Nodes of some kinds with some fields, parsed for one reader."""
        return python_nodes(self.dealt, kinds, only, weighted)

    def tokens(self, *only: str) -> DataFrame:
        """Python tokens with some fields, parsed for one reader."""
        return python_tokens(self.dealt, only)

    def of(self, language: str) -> DataFrame:
        return self.lines.filter(F.col("language") == language)

    def with_snippet(self, rows: DataFrame, languages: list[str]) -> DataFrame:
        """Findings with their stripped source line: a file's findings meet its text, which is split once. No table of lines is joined."""
        text = self.corpus.filter(F.col("language").isin(languages)).select(*_FILE, "ls")
        rest = [c for c in rows.columns if c not in _FILE]
        files = rows.groupBy(*_FILE).agg(F.collect_list(F.struct(*rest)).alias("found")).join(text, _FILE, "left")

        def told(f: Column) -> Column:
            return F.struct(*[f[c].alias(c) for c in rest], F.coalesce(strip(F.get("ls", f["line"] - 1)), F.lit("")).alias("code_snippet"))

        return files.select(*_FILE, F.inline(F.transform("found", told)))


@dataclass(frozen=True)
class Rule:
    code: str
    language: str
    category: str
    severity: str
    name: str
    find: Callable[[Facts], DataFrame] | None = None
    #: For a rule of one row: the fact table, and the columns of a finding.
    table: str | None = None
    columns: Callable[[C.Settings], Hit] | None = None


@dataclass(frozen=True)
class Hit:
    """A finding of one row, as columns: whether there is one, and what it says."""

    when: Column
    message: Column
    col: Column | None = None
    snippet: Column | None = None
    severity: Column | None = None
    line: Column | None = None


REGISTRY: dict[str, Rule] = {}
_off: set[str] = set()


def rule(code: str, language: str, category: str, severity: str, name: str):
    """Register a rule; a code may be used once."""

    def add(find: Callable[[Facts], DataFrame]) -> Callable[[Facts], DataFrame]:
        _register(Rule(code, language, category, severity, name, find))
        return find

    return add


def row_rule(code: str, language: str, category: str, severity: str, name: str, table: str):
    """Register a rule of one row of a fact table: "lines", "nodes", "java" or "comments"."""

    def add(columns: Callable[[C.Settings], Hit]) -> Callable[[C.Settings], Hit]:
        _register(Rule(code, language, category, severity, name, None, table, columns))
        return columns

    return add


def _register(r: Rule) -> None:
    if r.code in REGISTRY:
        raise ValueError(f"rule {r.code} is registered already")
    REGISTRY[r.code] = r


def set_enabled(code: str, enabled: bool) -> None:
    if code not in REGISTRY:
        raise KeyError(code)
    (_off.discard if enabled else _off.add)(code)


def rule_rows(spark) -> DataFrame:
    """The rules as a table."""
    rows = [(r.code, r.language, r.category, r.severity, r.name, r.code not in _off) for r in REGISTRY.values()]
    return spark.createDataFrame(rows, "code string, language string, category string, severity string, name string, enabled boolean")


def rule_stats(rules: DataFrame) -> DataFrame:
    """Rules by language and severity, with how many are on and off."""
    return rules.groupBy("language", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("enabled").alias("enabled"), F.count_if(~F.col("enabled")).alias("disabled")
    )


def _finding(rows: DataFrame, message: Column, line: str | Column = "line", col: str | Column | None = None, snippet: Column | None = None, end: Column | None = None, severity: Column | None = None) -> DataFrame:
    at = F.col(line) if isinstance(line, str) else line
    out = [F.col("scan_id"), F.col("rel_path"), at.cast("int").alias("line")]
    out.append((F.lit(0) if col is None else F.col(col) if isinstance(col, str) else col).cast("int").alias("col"))
    out.append((at if end is None else end).cast("int").alias("end_line"))
    out.append(message.alias("message"))
    if snippet is not None:
        out.append(snippet.alias("code_snippet"))
    out.append((F.lit(None) if severity is None else severity).cast("string").alias("own_severity"))
    return rows.select(*out)


#: The place of a finding in a row of each fact table.
_AT = {"lines": "line_no", "nodes": "line", "java": "line", "comments": "line"}


def _row_findings(facts: Facts, table: str, rules: list[Rule]) -> DataFrame:
    """Findings of all ``rules`` of a table, in one pass over it."""
    rows, at = getattr(facts, table), F.col(_AT[table]).cast("int")
    hits, conditions = [], []
    for r in rules:
        h = r.columns(facts.settings)
        found = F.struct(
            F.lit(r.code).alias("rule_code"), F.lit(r.category).alias("category"), (F.lit(r.severity) if h.severity is None else h.severity).alias("severity"),
            (at if h.line is None else h.line).alias("line"), (F.lit(0) if h.col is None else h.col).cast("int").alias("col"), (at if h.line is None else h.line).alias("end_line"), h.message.alias("message"),
            (F.lit(None) if h.snippet is None else h.snippet).cast("string").alias("own"),
        )
        of = h.when if table != "lines" else (F.col("language") == r.language) & h.when
        hits.append(F.when(of, found))
        conditions.append(of)
    if table == "lines":  # files of other languages are not made
        rows = _with_line_parts(rows.filter(F.col("language").isin(sorted({r.language for r in rules}))))
    else:  # most rows meet no rule, and no array is made for them
        rows = rows.filter(reduce(Column.__or__, [F.coalesce(c, F.lit(False)) for c in conditions]))
    return rows.select("scan_id", "rel_path", F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))


def findings(facts: Facts, codes: list[str] | None = None) -> DataFrame:
    """Findings of the enabled rules (or of ``codes``) before their source lines are looked up: one pass for the row rules of each table,
    and a union with the others'. ``own`` is a snippet that a rule gives itself, ``bare`` tells that it gives none."""
    chosen = [REGISTRY[c] for c in (codes or REGISTRY) if c not in _off]
    parts = []
    for table in _AT:
        of = [r for r in chosen if r.table == table]
        if of:
            lacking = [r.code for r in of if r.columns(facts.settings).snippet is None]
            parts.append(_row_findings(facts, table, of).withColumn("bare", F.col("rule_code").isin(lacking) if 0 < len(lacking) < len(of) else F.lit(bool(lacking))))
    for r in chosen:
        if r.find is None:
            continue
        rows = r.find(facts)
        has = "code_snippet" in rows.columns
        parts.append(
            rows.select(
                "scan_id", "rel_path", F.lit(r.code).alias("rule_code"), F.lit(r.category).alias("category"),
                F.coalesce("own_severity", F.lit(r.severity)).alias("severity"), "line", "col", "end_line", "message",
                (F.col("code_snippet") if has else F.lit(None).cast("string")).alias("own"), F.lit(not has).alias("bare"),
            )
        )
    return reduce(DataFrame.unionByName, parts)


def with_snippets(facts: Facts, found: DataFrame) -> DataFrame:
    """``findings`` with their source lines: only those without a snippet of their own need them, all rules' at once."""
    names = [*_FILE, "line", "rule_code", "category", "severity", "col", "end_line", "message", "code_snippet"]
    told = found.filter(~F.col("bare")).withColumn("code_snippet", F.coalesce("own", F.lit(""))).select(*names)
    return told.unionByName(facts.with_snippet(found.filter("bare").drop("own", "bare"), ["python", "java", "config"]).select(*names))


def run_rules(facts: Facts, codes: list[str] | None = None) -> DataFrame:
    """Findings of the enabled rules (or of ``codes``) with their snippets. Where facts are shared, findings are stored, as both kinds read
    them."""
    chosen = [REGISTRY[c] for c in (codes or REGISTRY) if c not in _off]
    own = [r.code for r in chosen if r.table and r.columns(facts.settings).snippet is not None]
    found = findings(facts, codes)
    if facts.shared and len(chosen) > 1:
        found, _ = stored(found)
    elif len(own) == len(chosen):  # no line is looked up
        return found.withColumn("code_snippet", F.coalesce("own", F.lit(""))).select(*_FILE, "line", "rule_code", "category", "severity", "col", "end_line", "message", "code_snippet")
    return with_snippets(facts, found)


# ---- lines ----

#: String literals and comments, as a reader meets them from the left.
STRINGS = r"""("(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)|#.*$)"""
BAD_OPERATOR = r"[A-Za-z0-9_)\]](?:(?:==|!=|<=|>=|\+=|-=|\*=|/=|=|\+|\*|/|%|<|>)[A-Za-z0-9_(]|-[A-Za-z_(])"
BAD_COMMA = r",[A-Za-z0-9_(\[]"


ASSIGNMENT = r"""^[\s"']*([A-Za-z0-9_.-]+)[\s"']*(?:=|:)[\s"']*(.+?)[\s,]*$"""


def bare(raw: Column) -> Column:
    """Without strings and comments; a line without a sign that begins one stays as it is."""
    return F.when(raw.rlike("[\"'#]"), F.regexp_replace(raw, STRINGS, "")).otherwise(raw)


def _with_line_parts(rows: DataFrame) -> DataFrame:
    """Lines with what several rules look at: Python's text without strings and its indent; key and value of an assignment in a
    configuration (key = value or key: value), the value without quotes and trailing comma."""
    raw = F.col("raw")
    assigned = (F.col("language") == "config") & ~raw.rlike(r"^\s*(#|//|;|$)") & raw.rlike(ASSIGNMENT)
    value = F.regexp_replace(F.regexp_replace(strip(F.regexp_extract("raw", ASSIGNMENT, 2)), "^[\"']+|[\"']+$", ""), ",+$", "")
    return rows.withColumns({
        "bare": F.when(F.col("language") == "python", bare(raw)),
        "indent": F.when(F.col("language") == "python", F.regexp_extract("raw", r"^(\s*)\S", 1)),
        "key": F.when(assigned, F.regexp_extract("raw", ASSIGNMENT, 1)),
        "value": F.when(assigned, value),
    })


def _first(text: Column, pattern: str) -> Column:
    """Column of the first match, from 0."""
    return F.regexp_instr(text, F.lit(pattern)) - 1


def _head(length: int = 80) -> Column:
    return F.substring("raw", 1, length)


@row_rule("PY-S001", "python", "space", "info", "Space around binary operators", "lines")
def operator_space(s: C.Settings) -> Hit:
    b = F.col("bare")
    return Hit(~(b.contains("(") & b.contains(")")) & b.rlike(BAD_OPERATOR), F.lit("no space around an operator"), _first(b, BAD_OPERATOR), _head())


@row_rule("PY-S002", "python", "space", "info", "Space after a comma", "lines")
def comma_space(s: C.Settings) -> Hit:
    return Hit(F.col("bare").rlike(BAD_COMMA), F.lit("no space after a comma"), _first(F.col("bare"), BAD_COMMA), _head())


@row_rule("PY-I001", "python", "indent", "warning", "Indent of four spaces", "lines")
def indent_multiple(s: C.Settings) -> Hit:
    n = F.length("indent")
    return Hit(F.col("raw").rlike(r"^\s*[^\s#]") & ~F.col("indent").contains("\t") & (n % 4 != 0), F.format_string("indent of %d is no multiple of 4", n), snippet=_head())


def _mixed(f: Facts, language: str) -> DataFrame:
    """Files of which one line is indented by tabs, and another by spaces alone. Each is judged by its lines in one row."""
    rows = f.corpus.filter(F.col("language") == language).select(*_FILE, "ls")
    rows = rows.filter(F.exists("ls", lambda x: x.rlike(r"^ +\S")) & F.exists("ls", lambda x: x.rlike(r"^\s*\t\s*\S")))
    tabbed = F.filter(F.transform("ls", lambda x, i: F.when(x.rlike(r"^\s*\t"), F.struct((i + 1).alias("line_no"), x.alias("raw")))), lambda u: u.isNotNull())
    rows = rows.select(*_FILE, F.get(tabbed, F.lit(0)).alias("first"))
    return _finding(rows, F.lit("tabs and spaces are mixed"), F.col("first.line_no"), None, F.substring(F.col("first.raw"), 1, 80))


@rule("PY-I002", "python", "indent", "error", "Mixed indent")
def mixed_indent(f: Facts) -> DataFrame:
    return _mixed(f, "python")


@rule("JA-I001", "java", "indent", "warning", "Mixed indent")
def java_mixed_indent(f: Facts) -> DataFrame:
    return _mixed(f, "java")


def _long_line(limit: int) -> Hit:
    n = F.length("raw")
    return Hit(n > limit, F.format_string("line of %d characters", n), snippet=F.concat(_head(120), F.when(n > 120, "...").otherwise("")))


@row_rule("PY-L001", "python", "length", "info", "Line over 100 characters", "lines")
def long_line(s: C.Settings) -> Hit:
    return _long_line(100)


@row_rule("JA-L001", "java", "length", "info", "Line over 120 characters", "lines")
def java_long_line(s: C.Settings) -> Hit:
    return _long_line(120)


@rule("PY-N001", "python", "naming", "warning", "Module name")
def module_name(f: Facts) -> DataFrame:
    name = F.element_at(F.split("rel_path", "/"), -1)
    rows = f.corpus.filter("language = 'python'").withColumn("file", name)
    rows = rows.withColumn("stem", F.regexp_replace("file", r"(?<=.)\.[^.]*$", ""))
    rows = rows.filter(~F.col("stem").isin("__init__", "__main__") & ~F.col("stem").rlike("^[a-z][a-z0-9_]*$"))
    return _finding(rows, F.concat(F.lit("module name "), "file"), F.lit(1), None, F.col("file"))


@rule("JA-S001", "java", "space", "info", "Space between keyword and parenthesis")
def keyword_paren(f: Facts) -> DataFrame:
    """Lines in block comments pass. A comment is open after a line that begins one and does not end it, and after all lines that
    neither end nor begin one below it, so the last line above that does either tells."""
    bad = r"\b(if|for|while|switch|catch)\("
    x = strip(F.col("raw"))
    rows = f.of("java").filter(F.col("raw").contains("*/") | F.col("raw").contains("/*") | F.col("raw").rlike(bad))
    opens = F.when(x.contains("*/"), False).when(x.startswith("/*"), True)
    above = Window.partitionBy(*_FILE).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.coalesce(F.last(opens, ignorenulls=True).over(above), F.lit(False)))
    rows = rows.filter(~(F.col("open") | x.startswith("/*") | x.startswith("//")) & F.col("raw").rlike(bad))
    word = F.regexp_extract("raw", bad, 1)
    return _finding(rows, F.concat(F.lit("no space after "), word), "line_no", _first(F.col("raw"), bad), F.substring("raw", 1, 80))


# ---- configuration ----

def _i(pattern: str) -> str:
    return f"(?i){pattern}"


def _setting(when: Column, text: str) -> Hit:
    return Hit(F.col("key").isNotNull() & when, F.concat(F.lit(text), F.col("key")), snippet=strip(F.col("raw")))


@row_rule("CFG-SEC001", "config", "security", "error", "Secret in configuration", "lines")
def config_secret(s: C.Settings) -> Hit:
    return _setting(F.col("key").rlike(_i(C.SECRET_KEY)) & (F.col("value") != "") & ~F.col("value").rlike(_i(C.PLACEHOLDER)), "secret value of ")


@row_rule("CFG-SEC002", "config", "security", "warning", "Weak secret", "lines")
def config_weak(s: C.Settings) -> Hit:
    return _setting(F.col("key").rlike(_i(C.SECRET_KEY)) & F.col("value").rlike(_i(C.WEAK_VALUE)), "weak value of ")


@row_rule("CFG-ENV001", "config", "environment", "warning", "Debugging is on", "lines")
def config_debug(s: C.Settings) -> Hit:
    return _setting(F.col("key").rlike(_i(C.DEBUG_KEY)) & F.col("value").rlike(_i(C.TRUTHY)), "debugging by ")


@row_rule("CFG-SEC003", "config", "security", "warning", "Plain http address", "lines")
def config_url(s: C.Settings) -> Hit:
    bad = r"(?i)http://(?!localhost|127\.0\.0\.1|0\.0\.0\.0)"
    return Hit(F.col("raw").rlike(bad), F.lit("address without TLS"), snippet=strip(F.col("raw")))


@row_rule("CFG-SEC004", "config", "security", "warning", "Any origin is allowed", "lines")
def config_origin(s: C.Settings) -> Hit:
    return _setting(F.col("key").rlike(_i(C.ORIGIN_KEY)) & F.col("value").contains("*"), "any origin by ")


@rule("CFG-SYN001", "config", "config", "error", "Syntax of a configuration file")
def config_syntax(f: Facts) -> DataFrame:
    from quarry.functions.config_syntax import syntax_error

    rows = f.corpus.filter("language = 'config'").select(*_FILE, "ls", syntax_error("rel_path", "text").alias("error"))
    rows = rows.select(*_FILE, "ls", once(F.col("error")).alias("error")).filter("error <> ''")
    return _finding(rows, F.concat(F.lit("does not parse: "), "error"), F.lit(1), snippet=F.coalesce(strip(F.get("ls", F.lit(0))), F.lit("")))


# ---- Python syntax ----


def _kind(f: Facts, *kinds: str) -> DataFrame:
    return f.nodes.filter(F.col("kind").isin(*kinds))


def _is(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


@row_rule("PY-N002", "python", "naming", "error", "Class name", "nodes")
def class_name(s: C.Settings) -> Hit:
    return Hit(_is("ClassDef") & ~F.col("name").rlike("^[A-Z][a-zA-Z0-9]*$"), F.concat(F.lit("class name "), "name"), F.col("col"))


@row_rule("PY-N003", "python", "naming", "warning", "Function name", "nodes")
def function_name(s: C.Settings) -> Hit:
    bare_name = F.regexp_replace("name", "^_+", "")
    checked = F.when(bare_name == "", F.col("name")).otherwise(bare_name)
    return Hit(_is(*FUNCTIONS) & ~checked.rlike("^[a-z_][a-z0-9_]*$"), F.concat(F.lit("function name "), "name"), F.col("col"))


@row_rule("PY-N004", "python", "naming", "info", "Constant name", "nodes")
def constant_name(s: C.Settings) -> Hit:
    ok = F.col("name").startswith("_") | F.col("name").rlike("^[A-Z_][A-Z0-9_]*$")
    return Hit(_is("Name") & (F.col("level") == 2) & (F.col("holds") == "Constant") & ~ok, F.concat(F.lit("constant name "), "name"), F.col("col"))


@row_rule("PY-N005", "python", "naming", "info", "Name of one letter", "nodes")
def short_name(s: C.Settings) -> Hit:
    short = (F.length("name") == 1) & ~F.col("name").isin(*C.PY_SHORT_NAMES)
    return Hit(_is("Name") & F.col("holds").isNotNull() & short, F.concat(F.lit("name of one letter "), "name"), F.col("col"))


def _undocumented(kind: Column) -> Hit:
    return Hit(kind & ~F.col("name").startswith("_") & ~F.col("has_doc"), F.concat(F.lit("no docstring: "), "name"))


@row_rule("PY-C001", "python", "comment", "info", "Docstring of public functions", "nodes")
def function_doc(s: C.Settings) -> Hit:
    return _undocumented(_is(*FUNCTIONS))


@row_rule("PY-C002", "python", "comment", "info", "Docstring of public classes", "nodes")
def class_doc(s: C.Settings) -> Hit:
    return _undocumented(_is("ClassDef"))


@row_rule("PY-C003", "python", "comment", "info", "Space after a comment sign", "comments")
def comment_space(s: C.Settings) -> Hit:
    return Hit(F.col("value").rlike("^#[^ !#]"), F.lit("no space after #"), F.col("col"), F.substring("value", 1, 80))


@row_rule("PY-M001", "python", "magic", "warning", "Magic number", "nodes")
def magic_number(s: C.Settings) -> Hit:
    odd = F.col("number").isNotNull() & ~F.col("number").isin(*C.PY_NUMBERS)
    return Hit(odd & ~F.col("by_constant"), F.concat(F.lit("magic number "), F.col("number").cast("string")), F.col("col"))


@row_rule("PY-S003", "python", "space", "info", "Two blank lines before definitions", "nodes")
def blank_lines(s: C.Settings) -> Hit:
    return Hit(_is(*FUNCTIONS, "ClassDef") & (F.col("gap") < 2), F.format_string("%d blank lines before a definition", "gap"))


@rule("PY-D001", "python", "dead", "warning", "Unused import")
def unused_import(f: Facts) -> DataFrame:
    imports = _kind(f, "Import", "ImportFrom").select(*_FILE, "line", F.explode(F.arrays_zip("params", "bases")).alias("a"))
    imports = imports.select(*_FILE, "line", F.col("a.params").alias("what"), F.col("a.bases").alias("used")).filter("what <> '*'")
    used = _kind(f, "Name").select(*_FILE, F.col("name").alias("used")).distinct()
    return _finding(imports.join(used, [*_FILE, "used"], "left_anti"), F.concat(F.lit("unused import "), "what"))


@rule("PY-D002", "python", "dead", "info", "Unused local")
def unused_local(f: Facts) -> DataFrame:
    names = _kind(f, "Name").filter(~F.col("name").startswith("_")).select(
        *_FILE, "name", F.explode("funcs").alias("func"), (F.col("value_kind") == "Load").alias("load"), F.when(F.col("holds").isNotNull(), F.col("line")).alias("set_at"))
    # the last assignment in a function where the name is never read
    unread = names.groupBy(*_FILE, "func", "name").agg(F.max("load").alias("read"), F.max("set_at").alias("line")).filter("not read and line is not null")
    return _finding(unread, F.concat(F.lit("unused local "), "name"))


@row_rule("PY-D003", "python", "dead", "error", "Unreachable statement", "nodes")
def unreachable(s: C.Settings) -> Hit:
    return Hit(_is(*FUNCTIONS, "For", "While", "If", "Try") & F.col("dead_line").isNotNull(), F.lit("statement is never reached"), line=F.col("dead_line"))


@row_rule("PY-D004", "python", "dead", "info", "Empty function", "nodes")
def empty_function(s: C.Settings) -> Hit:
    abstract = F.arrays_overlap("decorators", F.array(F.lit("abstractmethod"), F.lit("abstract")))
    return Hit(_is(*FUNCTIONS) & (F.col("value_kind") == "pass") & ~abstract, F.concat(F.lit("only pass in "), "name"))


@row_rule("PY-IM001", "python", "import", "warning", "Imports at the top", "nodes")
def late_import(s: C.Settings) -> Hit:
    return Hit(_is("Import", "ImportFrom") & F.col("late"), F.lit("import after other statements"))


@row_rule("PY-IM002", "python", "import", "warning", "Wildcard import", "nodes")
def wildcard_import(s: C.Settings) -> Hit:
    return Hit((F.col("kind") == "ImportFrom") & F.array_contains("params", "*"), F.concat(F.lit("wildcard import of "), "name"))


@rule("PY-IM003", "python", "import", "info", "Order of imports")
def import_order(f: Facts) -> DataFrame:
    mods = _kind(f, "Import", "ImportFrom").filter("head")  # the first block of imports
    names = F.when(F.col("kind") == "Import", F.col("params")).otherwise(F.array("name"))
    mods = mods.select(*_FILE, "line", "pos", F.posexplode(names).alias("k", "module"))
    head = F.element_at(F.split("module", r"\."), 1)
    local = (F.col("module") == "") | head.isin(*C.LOCAL_PACKAGES)
    std = head.isin(*sorted(sys.stdlib_module_names), "typing_extensions")
    mods = mods.withColumn("g", F.when(F.col("module") == "", 2).when(std, 0).when(local, 2).otherwise(1))
    order = Window.partitionBy(*_FILE).orderBy("pos", "k")
    bad = mods.withColumn("before", F.lag("g").over(order)).filter("g < before")
    first = bad.groupBy(*_FILE).agg(F.min(F.struct("pos", "k", "line", "module")).alias("x"))
    return _finding(first, F.concat(F.lit("import out of order: "), F.col("x.module")), F.col("x.line"))


def _too_long(kind: Column, limit: int, text: str) -> Hit:
    n = F.col("end_line") - F.col("line") + 1
    return Hit(kind & (n > limit), F.format_string(f"{text} of %d lines", n))


@row_rule("PY-L002", "python", "length", "warning", "Function over 50 lines", "nodes")
def long_function(s: C.Settings) -> Hit:
    return _too_long(_is(*FUNCTIONS), 50, "function")


def _metrics(f: Facts) -> DataFrame:
    return f.metrics


def _complex(s: C.Settings) -> Hit:
    n = F.col("cyclomatic")
    severity = F.when(n > s.complexity_critical, "error").otherwise("warning")
    return Hit(n > s.complexity_warn, F.format_string("cyclomatic complexity %d", n.cast("int")), severity=severity)


@rule("PY-X001", "python", "complexity", "warning", "Cyclomatic complexity")
def py_cyclomatic(f: Facts) -> DataFrame:
    hit = _complex(f.settings)
    return _finding(_metrics(f).filter(hit.when), hit.message, "start_line", severity=hit.severity)


@rule("PY-X002", "python", "complexity", "warning", "Nesting over 4")
def py_nesting(f: Facts) -> DataFrame:
    return _finding(_metrics(f).filter("nesting_depth > 4"), F.format_string("nesting of %d", F.col("nesting_depth").cast("int")), "start_line")


def _god_classes(rows: DataFrame, f: Facts) -> DataFrame:
    """``rows``: line, end_line, name, methods, fields."""
    s = f.settings
    length = F.greatest(F.lit(0), F.col("end_line") - F.col("line") + 1)
    hits = (F.col("methods") > s.god_class_methods).cast("int") + (length > s.god_class_lines).cast("int") + (F.col("fields") > s.god_class_fields).cast("int")
    rows = rows.withColumn("hits", hits).filter("hits > 0")
    return _finding(rows, F.concat(F.lit("god class "), "name"), end=F.col("end_line"), severity=F.when(F.col("hits") >= 2, "error").otherwise("warning"))


def py_class_sizes(nodes: DataFrame) -> DataFrame:
    """Classes with the functions inside and the distinct fields: class-level names and ``self.x`` set in ``__init__``."""
    classes = nodes.filter("kind = 'ClassDef'").select(*_FILE, F.col("node_id").alias("class_node"), "name", "qname", "line", "end_line", F.col("n_functions").alias("methods"))
    own = nodes.filter("kind = 'Name' and member").select(*_FILE, F.col("class_id").alias("class_node"), F.col("name").alias("field_name"))
    inits = nodes.filter("name = '__init__' and class_id is not null").filter(F.col("kind").isin(*FUNCTIONS)).select(*_FILE, F.col("node_id").alias("func"), F.col("class_id").alias("class_node"))
    selfs = nodes.filter("kind = 'Attribute' and field = 'targets' and qname = 'self'").select(*_FILE, F.col("name").alias("field_name"), F.explode("funcs").alias("func"))
    selfs = selfs.join(inits, [*_FILE, "func"]).select(*_FILE, "class_node", "field_name")
    fields = own.unionByName(selfs).groupBy(*_FILE, "class_node").agg(F.countDistinct("field_name").alias("fields"))
    return classes.join(fields, [*_FILE, "class_node"], "left").fillna(0, ["fields"])


@rule("PY-SM001", "python", "smell", "warning", "God class")
def py_god_class(f: Facts) -> DataFrame:
    return _god_classes(py_class_sizes(f.nodes), f)


@rule("PY-SM002", "python", "smell", "warning", "God method")
def py_god_method(f: Facts) -> DataFrame:
    s = f.settings
    rows = _metrics(f).filter((F.col("lines") > s.god_method_lines) | (F.col("cyclomatic") > s.god_method_cc))
    rows = rows.dropDuplicates([*_FILE, "qualified_name", "start_line"])
    return _finding(rows, F.concat(F.lit("god method "), "function_name"), "start_line", end=F.col("end_line"))


@rule("PY-SM003", "python", "smell", "info", "Long parameter list")
def py_long_params(f: Facts) -> DataFrame:
    n = F.size(F.filter("params", lambda p: ~p.isin("self", "cls")))
    rows = _kind(f, *FUNCTIONS).withColumn("n", n).filter(F.col("n") > f.settings.long_params).dropDuplicates([*_FILE, "qname", "line"])
    return _finding(rows, F.format_string("%d parameters", "n"))


# ---- Java ----


def _java(f: Facts, *kinds: str) -> DataFrame:
    return f.java.filter(F.col("kind").isin(*kinds))


def _has(word: str) -> Column:
    return F.array_contains("modifiers", word)


def _methods(f: Facts) -> DataFrame:
    """Methods without constructors."""
    return _java(f, "method").filter("returns is not null")


def _is_method() -> Column:
    """Methods without constructors."""
    return _is("method") & F.col("returns").isNotNull()


@row_rule("JA-N001", "java", "naming", "error", "Type name", "java")
def java_type_name(s: C.Settings) -> Hit:
    return Hit(_is("class", "interface") & ~F.col("name").rlike("^[A-Z][a-zA-Z0-9]*$"), F.concat(F.lit("type name "), "name"))


@row_rule("JA-N002", "java", "naming", "warning", "Method name", "java")
def java_method_name(s: C.Settings) -> Hit:
    return Hit(_is_method() & ~F.col("name").rlike("^[a-z][a-zA-Z0-9]*$"), F.concat(F.lit("method name "), "name"))


@row_rule("JA-N003", "java", "naming", "warning", "Constant name", "java")
def java_constant_name(s: C.Settings) -> Hit:
    constant = (F.col("kind") == "field") & _has("static") & _has("final")
    return Hit(constant & ~F.col("name").rlike("^[A-Z][A-Z0-9_]*$"), F.concat(F.lit("constant name "), "name"))


@row_rule("JA-N004", "java", "naming", "warning", "Package name", "java")
def java_package_name(s: C.Settings) -> Hit:
    bad = ~F.col("name").rlike(r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)*$")
    return Hit((F.col("kind") == "package") & bad, F.concat(F.lit("package name "), "name"))


@row_rule("JA-N005", "java", "naming", "info", "Name of one letter", "java")
def java_short_name(s: C.Settings) -> Hit:
    short = (F.length("name") == 1) & ~F.col("name").isin(*C.JAVA_SHORT_NAMES)
    return Hit((F.col("kind") == "local") & short, F.concat(F.lit("name of one letter "), "name"))


def java_docs(f: Facts, rows: DataFrame) -> DataFrame:
    """``doc``: the javadoc text above each row's line, null if there is none.

    Upwards, blank lines and annotations are passed over; the next line must end a block comment, whose start is at
    most 50 lines further up. The lines of a file are one array, so this needs no join per line.
    """
    src = f.corpus.filter("language = 'java'").select(*_FILE, "ls")
    rest = [c for c in rows.columns if c not in _FILE]

    def told(r: Column) -> Column:
        line = r["line"]
        lo = F.greatest(F.lit(1), line - 49)
        above = F.when(line > 1, F.reverse(F.slice("ls", lo, line - lo))).otherwise(F.array().cast("array<string>"))
        numbered = F.transform(above, lambda x, i: F.struct(strip(x).alias("x"), i.alias("i")))
        solid = F.get(F.filter(numbered, lambda u: (u["x"] != "") & ~u["x"].startswith("@")), F.lit(0))

        def text(start: Column) -> Column:
            return F.array_join(F.slice("ls", start, line - start), "\n")

        def block(stop: Column) -> Column:
            first = F.greatest(F.lit(1), stop - 49)
            starts = F.transform(F.slice("ls", first, stop - first + 1), lambda x, i: F.when(x.contains("/**"), first + i))
            return _let(F.array_max(starts), text)

        doc = _let(solid, lambda end: F.when(end["x"].endswith("*/"), _let(line - 1 - end["i"], block)))
        return F.struct(*[r[c].alias(c) for c in rest], doc.alias("doc"))

    # a file's rows meet its lines once; the lines are not copied beside each of them
    files = rows.groupBy(*_FILE).agg(F.collect_list(F.struct(*rest)).alias("found")).join(src, _FILE)
    return files.select(*_FILE, F.inline(F.transform("found", told)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@rule("JA-C001", "java", "comment", "warning", "Javadoc of public types")
def java_type_doc(f: Facts) -> DataFrame:
    rows = f.documented.filter("kind <> 'method' and doc is null")
    return _finding(rows, F.concat(F.lit("no javadoc: "), "name"))


@rule("JA-C002", "java", "comment", "info", "Javadoc of public methods")
def java_method_doc(f: Facts) -> DataFrame:
    rows = f.documented.filter((F.col("kind") == "method") & F.col("doc").isNull() & ~F.array_contains("annotations", "Override"))
    return _finding(rows, F.concat(F.lit("no javadoc: "), "name"))


@rule("JA-C003", "java", "comment", "info", "Javadoc tags")
def java_doc_tags(f: Facts) -> DataFrame:
    rows = f.documented.filter("kind = 'method' and doc is not null")
    params = rows.select(*_FILE, "line", "doc", F.explode("params").alias("p"))
    missing = params.filter(~F.regexp_like("doc", F.concat(F.lit(r"@param\s+\Q"), "p", F.lit(r"\E\b"))))
    returns = rows.filter((F.col("returns") != "void") & ~F.col("returns").endswith(">void") & ~F.col("doc").contains("@return"))
    return _finding(missing, F.concat(F.lit("no @param "), "p")).unionByName(_finding(returns, F.lit("no @return")))


@rule("JA-D001", "java", "dead", "warning", "Unused import")
def java_unused_import(f: Facts) -> DataFrame:
    body = f.corpus.filter("language = 'java'").select(*_FILE, F.array_join(F.filter("ls", lambda x: ~x.rlike(r"^\s*(import|package) ")), "\n").alias("body"))
    rows = _java(f, "import").filter(~F.col("wildcard") & ~_has("static"))
    rows = rows.withColumn("short", F.element_at(F.split("name", r"\."), -1)).join(body, _FILE)
    rows = rows.filter(~F.regexp_like("body", F.concat(F.lit(r"\b\Q"), "short", F.lit(r"\E\b"))))
    return _finding(rows, F.concat(F.lit("unused import "), "name"))


@row_rule("JA-D002", "java", "dead", "error", "Empty catch block", "java")
def java_empty_catch(s: C.Settings) -> Hit:
    return Hit(F.col("kind") == "empty_catch", F.lit("empty catch block"))


@rule("JA-D003", "java", "dead", "error", "Unreachable statement")
def java_unreachable(f: Facts) -> DataFrame:
    """The next line of code within ten lines after a jump, if it is indented as deep and closes nothing."""
    jumps = _java(f, "jump").groupBy(*_FILE).agg(F.collect_set("line").alias("jumps"))
    files = jumps.join(f.corpus.filter("language = 'java'").select(*_FILE, "ls"), _FILE)

    def depth(x: Column) -> Column:
        return F.length(F.regexp_extract(x, r"^(\s*)", 1))

    def next_line(at: Column) -> Column:
        after = F.transform(F.slice("ls", at + 1, 10), lambda x, i: F.struct((at + 1 + i).alias("line"), x.alias("raw"), strip(x).alias("x")))
        code = F.get(F.filter(after, lambda u: (u["x"] != "") & ~u["x"].rlike(r"^(//|/\*|\*)")), F.lit(0))
        return _let(code, lambda u: F.when(~u["x"].startswith("}") & (depth(u["raw"]) >= depth(F.get("ls", at - 1))), u["line"]))

    found = files.select(*_FILE, F.explode(F.array_distinct(F.transform("jumps", next_line))).alias("line")).filter("line is not null")
    return _finding(found, F.lit("statement is never reached"))


@row_rule("JA-IM001", "java", "import", "warning", "Wildcard import", "java")
def java_wildcard(s: C.Settings) -> Hit:
    return Hit((F.col("kind") == "import") & F.col("wildcard"), F.concat(F.lit("wildcard import of "), "name"))


@row_rule("JA-L002", "java", "length", "warning", "Method over 80 lines", "java")
def java_long_method(s: C.Settings) -> Hit:
    return _too_long(F.col("kind") == "method", 80, "method")


@rule("JA-M001", "java", "magic", "warning", "Magic number")
def java_magic_number(f: Facts) -> DataFrame:
    finals = _java(f, "field").filter(_has("final")).select(*_FILE, "line").distinct()
    clean = F.regexp_replace("value", "[LlFfDd]+$", "")
    rows = f.java_numbers.withColumn("clean", clean).filter(~F.col("clean").isin(*C.JAVA_NUMBERS))
    rows = rows.filter(F.expr("try_cast(clean as double)").isNotNull()).join(finals, [*_FILE, "line"], "left_anti")
    return _finding(rows, F.concat(F.lit("magic number "), "value"), "line", "col")


@row_rule("JA-X001", "java", "complexity", "warning", "Cyclomatic complexity", "java")
def java_cyclomatic(s: C.Settings) -> Hit:
    hit = _complex(s)
    return Hit(_is_method() & hit.when, hit.message, severity=hit.severity)


@rule("JAVA-SM001", "java", "smell", "warning", "God class")
def java_god_class(f: Facts) -> DataFrame:
    classes = _java(f, "class").select(*_FILE, "name", "qname", "line", "end_line")
    members = f.java.filter("kind in ('method', 'field')").groupBy(*_FILE, F.col("owner").alias("qname")).agg(F.count_if(F.col("kind") == "method").alias("methods"), F.count_if(F.col("kind") == "field").alias("fields"))
    return _god_classes(classes.join(members, [*_FILE, "qname"], "left").fillna(0, ["methods", "fields"]), f)


@rule("JAVA-SM002", "java", "smell", "warning", "God method")
def java_god_method(f: Facts) -> DataFrame:
    s = f.settings
    long = F.col("end_line") - F.col("line") + 1 > s.god_method_lines
    rows = _java(f, "method").filter(long | (F.col("cyclomatic_plain") > s.god_method_cc)).dropDuplicates([*_FILE, "qname", "line"])
    return _finding(rows, F.concat(F.lit("god method "), "name"), end=F.col("end_line"))


@rule("JAVA-SM003", "java", "smell", "warning", "Fat interface")
def java_fat_interface(f: Facts) -> DataFrame:
    faces = _java(f, "interface").select(*_FILE, "name", "qname", "line", "end_line")
    n = _java(f, "method").groupBy(*_FILE, F.col("owner").alias("qname")).agg(F.count(F.lit(1)).alias("n"))
    rows = faces.join(n, [*_FILE, "qname"]).filter(F.col("n") > f.settings.fat_interface_methods)
    return _finding(rows, F.concat(F.lit("fat interface "), "name"), end=F.col("end_line"))


@rule("JAVA-SM004", "java", "smell", "info", "Long parameter list")
def java_long_params(f: Facts) -> DataFrame:
    rows = _java(f, "method").filter(F.size("params") > f.settings.long_params).dropDuplicates([*_FILE, "qname", "line"])
    return _finding(rows, F.format_string("%d parameters", F.size("params")))
