"""Python sources to flat syntax tables: one parse per file, on the executors, in Arrow batches.

A node's place in each enclosing function is kept as ``funcs`` (ids from the outermost), so that measures of a function
are sums over the nodes below it; depths are absolute, and a function's own depth is subtracted by the reader.
"""

from __future__ import annotations

import ast
import hashlib
import io
import keyword
import tokenize
from collections.abc import Iterator, Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_DEFINITIONS = (*_FUNCTIONS, ast.ClassDef)
#: Nodes that deepen the cognitive measure, and those that count as nesting.
_COGNITIVE = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try)
_NESTING = (ast.If, ast.For, ast.While, ast.With, ast.Try, ast.AsyncFor, ast.AsyncWith)
_DECISION = (
    ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Assert, ast.IfExp
)
_FIELDS = [
    ("node_id", pa.int32()), ("parent_id", pa.int32()), ("field", pa.string()), ("pos", pa.int32()),
    ("kind", pa.string()), ("name", pa.string()), ("qname", pa.string()), ("line", pa.int32()), ("col", pa.int32()),
    ("end_line", pa.int32()), ("funcs", pa.list_(pa.int32())), ("class_id", pa.int32()), ("level", pa.int32()),
    ("cyclomatic", pa.int32()), ("cognitive", pa.int32()), ("cog_depth", pa.int32()), ("nest_depth", pa.int32()),
    ("params", pa.list_(pa.string())), ("has_doc", pa.bool_()), ("decorators", pa.list_(pa.string())),
    ("bases", pa.list_(pa.string())), ("value_kind", pa.string()), ("number", pa.float64()), ("skeleton", pa.string()), ("dots", pa.int32()),
    # facts of a node's place: what an assigned name holds, whether a name is a field of its class, lines to the statement before in a
    # module, whether an import stands after other statements or in the first block of imports, whether a number stands on the line of a
    # module's constant, the functions inside a class at any depth, and the first line of a body that follows a jump
    ("holds", pa.string()), ("member", pa.bool_()), ("gap", pa.int32()), ("late", pa.bool_()), ("head", pa.bool_()),
    ("by_constant", pa.bool_()), ("n_functions", pa.int32()), ("dead_line", pa.int32()),
]
_TYPES = {"node_id": "int", "parent_id": "int", "pos": "int", "line": "int", "col": "int", "end_line": "int", "class_id": "int", "level": "int", "cyclomatic": "int", "cognitive": "int", "cog_depth": "int", "nest_depth": "int", "funcs": "array<int>", "params": "array<string>", "decorators": "array<string>", "bases": "array<string>", "has_doc": "boolean", "number": "double", "dots": "int", "member": "boolean", "gap": "int", "late": "boolean", "head": "boolean", "by_constant": "boolean", "n_functions": "int", "dead_line": "int"}
NODE_SCHEMA = "scan_id bigint, rel_path string, " + ", ".join(f"{n} {_TYPES.get(n, 'string')}" for n, _ in _FIELDS)
TOKEN_SCHEMA = (
    "scan_id bigint, rel_path string, pos int, kind string, value string, line int, col int, end_line int, end_col int"
)


def skeleton(node: ast.AST) -> str:
    """The shape of a subtree: names, arguments and literals by kind only. Booleans count as numbers."""
    if isinstance(node, ast.Constant):
        v = node.value
        return "N" if isinstance(v, int | float | complex) else "S" if isinstance(v, str) else "C"
    if isinstance(node, ast.Name):
        return "I"
    if isinstance(node, ast.arg):
        return "A"
    inner = ",".join(skeleton(c) for c in ast.iter_child_nodes(node) if not isinstance(c, ast.expr_context))
    return f"{type(node).__name__}({inner})"


def _root_name(node: ast.AST) -> str | None:
    while isinstance(node, ast.Attribute):
        node = node.value
    return node.id if isinstance(node, ast.Name) else None


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Attribute):
        return f"{_dotted(node.value)}.{node.attr}"
    return node.id if isinstance(node, ast.Name) else ""


_weight_of: dict[type, tuple[int, int, bool]] = {}


def _weights(node: ast.AST) -> tuple[int, int, bool]:
    """Cyclomatic weight, cognitive weight without depth, and whether the depth is added."""
    cls = type(node)
    if cls is ast.BoolOp:
        n = max(0, len(node.values) - 1)
        return n, n, False
    if cls is ast.comprehension:
        return 1 + len(node.ifs), 0, False
    if cls is ast.Match:
        return len(node.cases), 0, False
    found = _weight_of.get(cls)
    if found is None:  # the others weigh by their class alone
        deep = issubclass(cls, _COGNITIVE) or cls in (ast.IfExp, ast.ExceptHandler)
        found = _weight_of[cls] = (0, 1, False) if cls in (ast.Break, ast.Continue) else (int(issubclass(cls, _DECISION)), int(deep), deep)
    return found


#: Fields that hold no node which has a row: contexts, operators, names and constants.
_NO_CHILDREN = frozenset({"ctx", "op", "ops", "id", "attr", "arg", "module", "level", "asname", "kind", "type_comment", "type_ignores", "conversion", "simple", "is_async", "lineno"})
#: Kinds that are statements, and the fields below which all statements are.
STATEMENTS = frozenset({"FunctionDef", "AsyncFunctionDef", "ClassDef", "Import", "ImportFrom"})
_BLOCKS = frozenset({"body", "orelse", "finalbody", "handlers", "cases"})
_fields_of: dict[tuple[type, bool], tuple[str, ...]] = {}


def _child_fields(cls: type, blocks: bool) -> tuple[str, ...]:
    found = _fields_of.get((cls, blocks))
    if found is None:
        names = () if cls in (ast.Constant, ast.Name) else (f for f in cls._fields if f not in _NO_CHILDREN and not (cls is ast.arg and f == "arg"))
        found = _fields_of[cls, blocks] = tuple(f for f in names if not blocks or (f in _BLOCKS and not issubclass(cls, ast.expr)))
    return found


#: What rules, measures and shapes read: ``NUMBER`` are constants that are numbers, ``TARGET`` attributes that are assigned to.
NUMBER, TARGET = "Number", "Target"
SCANNED = ("Error", "FunctionDef", "AsyncFunctionDef", "ClassDef", "Import", "ImportFrom", "Name", NUMBER, TARGET)
_OWNERS = (*_FUNCTIONS, ast.For, ast.While, ast.If, ast.Try)
_JUMPS = (ast.Return, ast.Raise, ast.Break, ast.Continue)
_IMPORTS = (ast.Import, ast.ImportFrom)


def _is_number(node: ast.AST) -> bool:
    return isinstance(node.value, int | float) and not isinstance(node.value, bool)


def _module_facts(body: list[ast.stmt]) -> tuple[int, int, int, set[int]]:
    """Of a module's statements: the place of the first that is neither import nor text, the first block of imports (from, to), and the
    lines of constants that are assigned."""
    far = len(body)
    other = next((i for i, x in enumerate(body) if not isinstance(x, _IMPORTS) and not (isinstance(x, ast.Expr) and isinstance(x.value, ast.Constant))), far)
    first = next((i for i, x in enumerate(body) if isinstance(x, _IMPORTS)), far)
    last = next((i for i in range(first, far) if not isinstance(body[i], _IMPORTS)), far)
    return other, first, last, {x.value.lineno for x in body if isinstance(x, ast.Assign) and isinstance(x.value, ast.Constant)}


def nodes(text: str, kinds: frozenset[str] | None = None, weighted: bool = False) -> list[dict]:
    """Node rows of a source; one row of kind "Error" where it does not parse.

    With ``kinds``, only rows of these kinds are made, and with ``weighted`` also those that add to a measure of the functions
    around. Where all of them are statements, expressions are not walked; ids then count the nodes that are.
    """
    blocks = kinds is not None and kinds <= STATEMENTS and not weighted
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [{"node_id": 0, "kind": "Error", "name": str(e)[:200], "line": getattr(e, "lineno", None) or 1}] if kinds is None or "Error" in kinds else []
    rows: list[dict] = []
    # what a node's children share is one tuple: the node, its place, and what stands around them
    stack: list[tuple] = [(tree, "", 0, (None, None, "", (), (), None, "", 0, 0, 0))]
    other, first_import, last_import, constant_lines = _module_facts(tree.body)
    me = -1
    while stack:
        node, field, pos, state = stack.pop()
        parent, above, above_field, classes, funcs, class_id, prefix, cog, nest, level = state
        me += 1
        cls = type(node)
        kind = cls.__name__
        is_nest = cls in _NESTING
        # names, classes and functions around are taken from every definition, wanted or not
        wanted = kinds is None or kind in kinds
        if not wanted and (cls is ast.Constant or cls is ast.Attribute):
            wanted = (NUMBER in kinds and _is_number(node)) if cls is ast.Constant else (TARGET in kinds and field == "targets")
        if wanted or weighted or cls in _DEFINITIONS:
            cc, cg, deep = _weights(node)
            wanted = wanted or (weighted and bool(cc or cg or is_nest))
        if not wanted and cls not in _DEFINITIONS:
            if cls not in _LEAVES:
                _push(stack, node, cls, blocks, (me, node, field, classes, funcs, class_id, prefix, cog + (cls in _COGNITIVE), nest + is_nest, level + 1))
            continue
        row = {
            "node_id": me, "parent_id": parent, "field": field, "pos": pos, "kind": kind, "line": getattr(node, "lineno", None),
            "col": getattr(node, "col_offset", None), "end_line": getattr(node, "end_lineno", None), "funcs": list(funcs),
            "class_id": class_id, "level": level, "cyclomatic": cc, "cognitive": cg + (cog if deep else 0),
            "cog_depth": cog, "nest_depth": nest + is_nest,
        }
        if deep:
            row["value_kind"] = "deep"
        if level == 1 and field == "body":
            row["gap"] = node.lineno - tree.body[pos - 1].end_lineno - 1 if pos else None
            if cls in _IMPORTS:
                row |= {"late": pos > other, "head": first_import <= pos < last_import}
        if cls in _OWNERS:
            row["dead_line"] = next((b.lineno for a, b in pairwise(node.body) if isinstance(a, _JUMPS)), None)
        inner_funcs, inner_class, inner_prefix, inner_classes = funcs, class_id, prefix, classes
        if isinstance(node, _FUNCTIONS):
            row |= {
                "name": node.name, "qname": prefix + node.name, "params": [a.arg for a in node.args.args],
                "has_doc": ast.get_docstring(node) is not None, "decorators": [_dotted(d) for d in node.decorator_list],
                "skeleton": hashlib.sha256(skeleton(node).encode()).hexdigest() if node.end_lineno - node.lineno >= 3 else None,
                "value_kind": "pass" if [type(s).__name__ for s in node.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and isinstance(s.value.value, str))] == ["Pass"] else None,
            }
            for around in classes:
                around["n_functions"] += 1
            inner_funcs, inner_prefix = (*funcs, me), f"{prefix}{node.name}."
        elif isinstance(node, ast.ClassDef):
            row |= {"name": node.name, "qname": prefix + node.name, "has_doc": ast.get_docstring(node) is not None, "bases": [b for b in map(_dotted, node.bases) if b], "decorators": [_dotted(d) for d in node.decorator_list]}
            row["n_functions"] = 0  # each function below adds one
            inner_class, inner_prefix, inner_classes = me, f"{prefix}{node.name}.", (*classes, row)
        elif isinstance(node, ast.ImportFrom):
            row |= {"name": node.module or "", "dots": node.level or 0, "params": [a.name for a in node.names], "bases": [a.asname or a.name for a in node.names]}
        elif isinstance(node, ast.Import):
            row |= {"params": [a.name for a in node.names], "bases": [a.asname or a.name.split(".")[0] for a in node.names]}
        elif isinstance(node, ast.Name):
            row |= {"name": node.id, "value_kind": type(node.ctx).__name__}
            if field == "targets" and isinstance(above, ast.Assign):
                v = above.value
                row["holds"] = "bool" if isinstance(v, ast.Constant) and isinstance(v.value, bool) else type(v).__name__
            if field in ("targets", "target") and isinstance(above, ast.Assign | ast.AnnAssign):
                row["member"] = above_field == "body" and not funcs and class_id is not None
        elif isinstance(node, ast.Attribute):
            row |= {"name": node.attr, "qname": _root_name(node), "value_kind": type(node.ctx).__name__}
        elif isinstance(node, ast.Constant):
            v = node.value
            row["value_kind"] = type(v).__name__
            if _is_number(node):
                row |= {"number": float(v) if abs(v) < 1e300 else float("inf"), "by_constant": node.lineno in constant_lines}
        elif isinstance(node, ast.Call):
            f = node.func
            row["name"] = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
        if wanted:
            rows.append(row)
        if cls not in _LEAVES:
            _push(stack, node, cls, blocks, (me, node, field, inner_classes, inner_funcs, inner_class, inner_prefix, cog + (cls in _COGNITIVE), nest + is_nest, level + 1))
    return rows


_LEAVES = frozenset({ast.Constant, ast.Name, ast.alias, ast.Pass, ast.Break, ast.Continue})


def _push(stack: list[tuple], node: ast.AST, cls: type, blocks: bool, state: tuple) -> None:
    """Put the nodes below a node on the stack, the first on top."""
    for f in reversed(_child_fields(cls, blocks)):
        value = getattr(node, f, None)
        if type(value) is list:
            for i in range(len(value) - 1, -1, -1):
                if isinstance(value[i], ast.AST):
                    stack.append((value[i], f, i, state))
        elif isinstance(value, ast.AST):
            stack.append((value, f, 0, state))


_TOKEN_KINDS = {
    tokenize.NUMBER: "number", tokenize.STRING: "string", tokenize.COMMENT: "comment", tokenize.NEWLINE: "newline",
    tokenize.NL: "newline", tokenize.INDENT: "indent", tokenize.DEDENT: "dedent", tokenize.FSTRING_START: "string",
    tokenize.FSTRING_MIDDLE: "string", tokenize.FSTRING_END: "string",
}
_WORDS = frozenset(keyword.kwlist) | {"match", "case"}


def tokens(text: str) -> list[dict]:
    """Token rows; where the tokenizer stops, those before it are kept."""
    out: list[dict] = []
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type in (tokenize.ENDMARKER, tokenize.ENCODING):
                continue
            kind = _TOKEN_KINDS.get(t.type)
            if t.type == tokenize.NAME:
                kind = "keyword" if t.string in _WORDS else "identifier"
            elif t.type == tokenize.OP:
                kind = "punct" if t.string in "()[]{},:;." else "operator"
            out.append({"pos": len(out), "kind": kind or "other", "value": t.string, "line": t.start[0], "col": t.start[1], "end_line": t.end[0], "end_col": t.end[1]})
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    return out


#: Rows that make a batch.
_BATCH = 8192


def _table(corpus: DataFrame, language: str, rows_of, schema: str, fields: list, only: Sequence[str] = ()) -> DataFrame:
    """The rows of all files of a language; ``only`` names the fields that are made, all without."""
    if only:
        types = dict(x.strip().split(" ") for x in schema.split(","))
        fields = [(n, t) for n, t in fields if n in only]
        schema = ", ".join(f"{n} {types[n]}" for n in ("scan_id", "rel_path", *(n for n, _ in fields)))
    arrow = pa.schema([("scan_id", pa.int64()), ("rel_path", pa.string()), *fields])

    def batch_of(places: list[tuple], rows: list[dict]) -> pa.RecordBatch:
        place = [pa.array([p[i] for p in places for _ in range(p[2])], t) for i, t in ((0, pa.int64()), (1, pa.string()))]
        return pa.RecordBatch.from_arrays([*place, *(pa.array([r.get(name) for r in rows], t) for name, t in fields)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, rows = [], []
        for batch in batches:
            for scan, path, text in zip(*(batch.column(c).to_pylist() for c in ("scan_id", "rel_path", "text")), strict=True):
                found = rows_of(text or "")
                if found:
                    places.append((scan, path, len(found)))
                    rows += found
                if len(rows) >= _BATCH:
                    yield batch_of(places, rows)
                    places, rows = [], []
        if rows:
            yield batch_of(places, rows)

    return corpus.filter(corpus.language == language).select("scan_id", "rel_path", "text").mapInArrow(run, schema)


def python_nodes(corpus: DataFrame, kinds: Sequence[str] = (), only: Sequence[str] = (), weighted: bool = False) -> DataFrame:
    """Nodes of all Python files. A query that reads some kinds and fields names them, so that no others are made and moved."""
    wanted = frozenset(kinds) or None
    return _table(corpus, "python", lambda text: nodes(text, wanted, weighted), NODE_SCHEMA, _FIELDS, only)


_TOKEN_FIELDS = [("pos", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("end_line", pa.int32()), ("end_col", pa.int32())]


def python_tokens(corpus: DataFrame, only: Sequence[str] = ()) -> DataFrame:
    return _table(corpus, "python", tokens, TOKEN_SCHEMA, _TOKEN_FIELDS, only)


#: A file's words for clones (identifiers, numbers and strings as placeholders), and its tokens that rules read, as arrays of a row.
PLACEHOLDERS = {"identifier": "ID", "number": "NUM", "string": "STR"}
LAYOUT = frozenset({"comment", "newline", "indent", "dedent"})
_LEXED = [
    ("words", pa.list_(pa.string())), ("line", pa.list_(pa.int32())), ("end_line", pa.list_(pa.int32())),
    ("m_value", pa.list_(pa.string())), ("m_line", pa.list_(pa.int32())), ("m_col", pa.list_(pa.int32())),
]
LEXED_SCHEMA = "scan_id bigint, rel_path string, words array<string>, line array<int>, end_line array<int>, m_value array<string>, m_line array<int>, m_col array<int>"


def python_words(text: str) -> tuple[list, ...]:
    """Words with their lines; comments with line and column. Equal to what ``tokens`` has, without a row for each token."""
    words, line, end, marks = [], [], [], []
    kinds, keywords, skipped = _TOKEN_KINDS, _WORDS, (tokenize.ENDMARKER, tokenize.ENCODING)
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            kind, value, begin, stop, _ = t
            if kind == tokenize.NAME:
                value = value if value in keywords else "ID"
            elif kind != tokenize.OP:
                of = kinds.get(kind)
                if of == "comment":
                    marks.append((value, *begin))
                if of in LAYOUT or kind in skipped:
                    continue
                value = PLACEHOLDERS.get(of, value)
            words.append(value)
            line.append(begin[0])
            end.append(stop[0])
    except (tokenize.TokenError, SyntaxError, ValueError):
        pass
    return words, line, end, *([m[i] for m in marks] for i in range(3))


def lexed(corpus: DataFrame, language: str, words_of) -> DataFrame:
    """One row for each file of a language: what ``words_of`` gives for its text."""
    arrow = pa.schema([("scan_id", pa.int64()), ("rel_path", pa.string()), *_LEXED])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = [words_of(t or "") for t in part.column("text").to_pylist()]
                columns = [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_LEXED)]
                yield pa.RecordBatch.from_arrays([part.column("scan_id").cast(pa.int64()), part.column("rel_path"), *columns], schema=arrow)

    return corpus.filter(corpus.language == language).select("scan_id", "rel_path", "text").mapInArrow(run, LEXED_SCHEMA)
