"""Imports, symbols, calls and variable writes of Python and Java files, read line by line.

A task reads the lines of one file in their order and holds what the next line depends on: an open docstring or comment, the
classes around, by indent or by braces, and the function that was begun last. Spark deals whole files, not lines, to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What counts as a declaration or a call, and the names that are no calls.
PY_IMPORT = r"\s*import\s+([\w.]+)(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*\s*$"
PY_FROM = r"\s*from\s+(\.{0,3}[\w.]*)\s+import\s+(.+)$"
PY_CLASS = r"(\s*)class\s+([A-Za-z_]\w*)\s*(?:\(([^)]*)\))?\s*:"
PY_DEF = r"\s*def\s+([A-Za-z_]\w*)\s*\("
PY_ASSIGN = r"([A-Za-z_]\w*)\s*=\s*[^=]"
CALL = r"([A-Za-z_]\w*)\s*\("
PY_NO_CALLS = (
    "if", "elif", "else", "for", "while", "with", "in", "return", "yield", "and", "or", "not", "is", "lambda", "def", "class",
    "from", "import", "as", "pass", "raise", "try", "except", "finally", "True", "False", "None", "print", "len", "str", "int",
    "float", "list", "dict", "set", "tuple", "bool", "type", "isinstance", "issubclass", "range", "enumerate", "map", "filter",
    "zip", "sorted", "open", "input", "super", "self", "cls",
)
JAVA_IMPORT = r"\s*import\s+(?:static\s+)?([\w.*]+)\s*;"
JAVA_PACKAGE = r"\s*package\s+[\w.]+\s*;"
JAVA_TYPE = (
    r"\s*(?:(?:public|private|protected|abstract|final|static|sealed|non-sealed)\s+)*(class|interface|enum|record)\s+([A-Za-z_]\w*)"
    r"(?:\s*<[^{]*>)?(?:\s+extends\s+([A-Za-z_][\w.,\s<>]*?))?(?:\s+implements\s+([A-Za-z_][\w.,\s<>]*?))?\s*\{"
)
JAVA_METHOD = (
    r"\s*(?:(?:public|private|protected|static|final|abstract|synchronized|native|default)\s+|@[A-Za-z_][\w.]*\s*)*(?:<[^>]*>\s*)?"
    r"([A-Za-z_][\w<>\[\],\s.]*?)\s+([A-Za-z_]\w*)\s*\([^)]*\)\s*(?:throws\s+[\w.,\s]+)?\s*\{"
)
JAVA_NO_CALLS = (
    "if", "for", "while", "switch", "return", "throw", "new", "this", "super", "true", "false", "null", "void", "int", "long",
    "short", "byte", "double", "float", "boolean", "char", "String", "Object", "try", "catch", "finally", "synchronized", "public",
    "private", "protected", "static", "final", "abstract", "class", "interface", "enum", "record", "package", "import", "extends",
    "implements",
)

_PY = {k: re.compile(p, re.A) for k, p in {"import": PY_IMPORT, "from": PY_FROM, "class": PY_CLASS, "def": PY_DEF, "assign": PY_ASSIGN}.items()}
_JAVA = {k: re.compile(p, re.A) for k, p in {"import": JAVA_IMPORT, "package": JAVA_PACKAGE, "type": JAVA_TYPE, "method": JAVA_METHOD}.items()}
_CALLS = re.compile(CALL, re.A)
_PY_SKIP, _JAVA_SKIP = frozenset(PY_NO_CALLS), frozenset(JAVA_NO_CALLS)
#: A line up to its comment: strings, escaped characters and all else but a "#".
_BEFORE_COMMENT = re.compile(r"""(?:\\(?:.|$)|'(?:\\.|[^'\\])*(?:'|\\?$)|"(?:\\.|[^"\\])*(?:"|\\?$)|[^#'"\\])*""", re.S)
#: Pieces of a Java line: comments, strings and characters.
_JAVA_PIECE = re.compile(r"""//.*$|/\*|"(?:\\.|[^"\\])*(?:"|\\?$)|'(?:\\.|[^'\\])*(?:'|\\?$)""")

#: fact: import (name is the target, kind import or inherit), symbol (owner is the type around), call (owner is the caller), write.
SCHEMA = "scan_id bigint, rel_path string, fact string, name string, kind string, owner string, wildcard boolean, line int"
Fact = tuple[str, str, str | None, str | None, bool]


def _listed(names: str) -> list[str]:
    return [n for n in (x.strip() for x in names.split(",")) if n]


class PythonLines:
    """The state of a Python file."""

    def __init__(self) -> None:
        self.closing: str | None = None
        self.classes: list[tuple[int, str]] = []
        self.function = ""

    def _code(self, raw: str) -> str | None:
        """The part of a line that is code, or None inside a docstring and where one begins."""
        code = _BEFORE_COMMENT.match(raw).group()
        if self.closing:
            _, end, code = code.partition(self.closing)
            if not end:
                return None
            self.closing = None
        for quote in ('"""', "'''"):
            _, begins, rest = code.partition(quote)
            if begins and quote not in rest:
                self.closing = quote
                return None
        return code

    def read(self, raw: str) -> Iterator[Fact]:
        code = self._code(raw)
        if code is None or not code.strip():
            return
        indent = len(code) - len(code.lstrip(" \t"))
        while self.classes and indent <= self.classes[-1][0]:
            self.classes.pop()
        around = self.classes[-1][1] if self.classes else None
        if m := _PY["import"].match(code):
            yield "import", m[1], "import", None, False
        elif m := _PY["from"].match(code):
            base, names = m[1], m[2].strip()
            wildcard = names == "*" or ", *" in names
            if base:
                yield "import", base, "import", None, wildcard
            for item in _listed(names.removeprefix("(").removesuffix(")")):
                name = item.partition(" as ")[0].strip()
                if name and name != "*":
                    yield "import", base + ("." if base.strip(".") else "") + name, "import", None, False
        elif m := _PY["class"].match(code):
            yield "symbol", m[2], "class", around, False
            for parent in _listed(m[3] or ""):
                if "=" not in parent:
                    yield "import", parent, "inherit", None, False
            self.classes.append((len(m[1]), m[2]))
        elif m := _PY["def"].match(code):
            yield "symbol", m[1], "method" if around else "function", around, False
            self.function = m[1]
        else:
            if indent == 0 and (m := _PY["assign"].match(code)):
                yield "write", m[1], "write", None, False
            if self.function or indent:
                for name in _CALLS.findall(code):
                    if name not in _PY_SKIP:
                        yield "call", name, None, self.function or "<module>", False


class JavaLines:
    """The state of a Java file: an open block comment, and the types around with the brace depth inside of them."""

    def __init__(self) -> None:
        self.comment = False
        self.types: list[tuple[int, str]] = []
        self.depth = 0
        self.method = ""

    def _code(self, raw: str) -> str:
        """The line without comments; strings and characters keep their quotes only. A string ends with its line."""
        out, at = [], 0
        while True:
            if self.comment:
                end = raw.find("*/", at)
                if end < 0:
                    return "".join(out)
                self.comment, at = False, end + 2
            m = _JAVA_PIECE.search(raw, at)
            if not m:
                return "".join([*out, raw[at:]])
            out.append(raw[at : m.start()])
            at = m.end()
            if m[0] == "/*":
                self.comment = True
            elif m[0][0] in "\"'":
                out.append(m[0][0] * 2)

    def read(self, raw: str) -> Iterator[Fact]:
        code = self._code(raw)
        braces = code.count("{") - code.count("}")
        if not code.strip() or _JAVA["package"].match(code):
            self.depth += braces
        elif m := _JAVA["import"].match(code):
            self.depth += braces
            yield "import", m[1].removesuffix(".*"), "import", None, m[1].endswith(".*")
        elif m := _JAVA["type"].match(code):
            yield "symbol", m[2], m[1], self.types[-1][1] if self.types else None, False
            for above in (m[3], m[4]):
                for parent in _listed(_without_generics(above or "")):
                    yield "import", parent, "inherit", None, False
            self.depth += braces
            self.types.append((self.depth, m[2]))
        else:
            if self.types and (m := _JAVA["method"].match(code)):
                yield "symbol", m[2], "method", self.types[-1][1], False
                self.method = m[2]
            for name in _CALLS.findall(code):
                if name not in _JAVA_SKIP:
                    yield "call", name, None, self.method or "<static>", False
            self.depth += braces
            while self.types and self.depth < self.types[-1][0]:
                self.types.pop()
                self.method = ""


def _without_generics(names: str) -> str:
    """Names without what stands between angle brackets, inner ones first."""
    while (shorter := re.sub(r"<[^<>]*>", "", names)) != names:
        names = shorter
    return names


_ARROW = pa.schema([("scan_id", pa.int64()), ("rel_path", pa.string()), ("fact", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("owner", pa.string()), ("wildcard", pa.bool_()), ("line", pa.int32())])
#: Facts that make a batch.
_BATCH = 8192


def _file_lines(texts: list[str]) -> Iterator[tuple[int, str]]:
    """Lines of a file with their numbers; ``splitlines`` knows the ends of ``lines``. Texts of one path are read side by side."""
    if len(texts) == 1:
        yield from enumerate(texts[0].splitlines(), 1)
        return
    for n, row in enumerate(zip_longest(*(t.splitlines() for t in texts)), 1):
        yield from ((n, raw) for raw in row if raw is not None)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for batch in batches:
        for scan, path, language, texts in zip(*(batch.column(c).to_pylist() for c in ("scan_id", "rel_path", "language", "texts")), strict=True):
            state = JavaLines() if language == "java" else PythonLines()
            for line_no, raw in _file_lines(texts):
                out += [(scan, path, *fact, line_no) for fact in state.read(raw)]
            if len(out) >= _BATCH:
                yield _batch(out)
                out = []
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def line_facts(corpus: DataFrame) -> DataFrame:
    """The facts of all Python and Java files of a corpus, as rows of ``SCHEMA``.

    Defined cases: files of other languages, and null and empty texts, have none; paths repeated in a scan are read as one
    file; a file is read line by line; further columns are ignored.
    """
    rows = corpus.filter(F.col("language").isin("python", "java")).select("scan_id", "rel_path", "language", "text")
    return rows.groupBy("scan_id", "rel_path", "language").agg(F.collect_list("text").alias("texts")).mapInArrow(_facts, SCHEMA)
