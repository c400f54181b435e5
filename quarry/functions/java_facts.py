"""Java sources to flat tables by a light lexer and a brace-matching parser.

No Java grammar is installed, so this reads declarations by their token patterns: types (class and interface; enums and
records are passed over), fields, methods and constructors, and inside methods the statements that the measures need.
Lambdas and anonymous classes count for the method they stand in.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.functions.python_facts import PLACEHOLDERS, TOKEN_SCHEMA, _TOKEN_FIELDS, _table

# Fixed values.
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final "
    "finally float for goto if implements import instanceof int interface long native new package private protected "
    "public return short static strictfp super switch synchronized this throw throws transient try void volatile while "
    "true false null".split()
)
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default".split())
_LEX = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<number>0[xXbB][0-9a-fA-F_]+[lL]?|(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[lLfFdD]?)"
    r"|(?P<word>[A-Za-z_$][\w$]*)|(?P<operator>>>>=|<<=|>>=|->|::|\+\+|--|&&|\|\||[-+*/%&|^!<>=]=|[-+*/%&|^!~<>=?:@])"
    r"|(?P<punct>[(){}\[\];,.])|(?P<space>\s+)|(?P<other>.)",
    re.S,
)


def lex(text: str) -> list[dict]:
    """Token rows, comments included, in order."""
    out, line, begin = [], 1, 0
    for m in _LEX.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind != "space":
            if kind == "word":
                kind = "keyword" if value in KEYWORDS else "identifier"
            ends = value.count("\n")
            end_col = len(value) - value.rfind("\n") - 1 if ends else m.end() - begin
            out.append({"pos": len(out), "kind": kind, "value": value, "line": line, "col": m.start() - begin, "end_line": line + ends, "end_col": end_col})
        if "\n" in value:
            line += value.count("\n")
            begin = m.start() + value.rfind("\n") + 1
    return out


def _closing(t: list[dict], i: int, open_: str = "{", close: str = "}") -> int:
    depth = 0
    for j in range(i, len(t)):
        if t[j]["value"] == open_ and t[j]["kind"] == "punct":
            depth += 1
        elif t[j]["value"] == close and t[j]["kind"] == "punct":
            depth -= 1
            if depth == 0:
                return j
    return len(t) - 1


def _parameters(t: list[dict]) -> list[str]:
    """Names in a parameter list: the last word before each top-level comma or the end."""
    names, depth, last = [], 0, None
    for x in t:
        v = x["value"]
        if v in "(<[{":
            depth += 1
        elif v in ")>]}":
            depth -= 1
        elif v == "," and depth == 0:
            names.append(last)
        elif depth == 0 and x["kind"] == "identifier":
            last = v
    return [n for n in [*names, last] if n] if t else []


def _body(t: list[dict]) -> tuple[int, int, int, int, list[dict], str]:
    """cyclomatic, the same without && and ||, cognitive, nesting, rows of statements, and the shape of a body."""
    plain, ops, cognitive, deepest, rows, shape = 1, 0, 0, 0, [], []
    braces: list[str] = []
    pending, last_op, do_open = "", None, 0
    for i, x in enumerate(t):
        v, k = x["value"], x["kind"]
        depth = sum(b in ("if", "for", "while", "do", "switch", "catch") for b in braces)
        if k == "keyword" and v in ("if", "for", "while", "do", "switch", "catch", "case", "default", "break", "continue", "return", "throw", "else", "try", "finally"):
            shape.append(v)
            if v == "while" and do_open and i and t[i - 1]["value"] == "}":
                do_open -= 1
                continue
            if v == "do":
                do_open += 1
            if v in ("if", "for", "while", "do", "catch", "case") or v == "default" and i + 1 < len(t) and t[i + 1]["value"] in (":", "->"):
                plain += 1
            if v in ("if", "for", "while", "do", "switch", "catch"):
                cognitive += 1 + depth
                deepest = max(deepest, depth + 1)
                pending = v
            elif v in ("break", "continue"):
                cognitive += 1
            elif v in ("else", "try", "finally"):
                pending = v
            if v in ("return", "throw", "break", "continue"):
                rows.append({"kind": "jump", "name": v, "line": x["line"], "col": x["col"]})
            if v == "catch":
                j = _closing(t, i + 1, "(", ")") + 1
                if j + 1 < len(t) and t[j]["value"] == "{" and t[j + 1]["value"] == "}":
                    rows.append({"kind": "empty_catch", "line": x["line"], "col": x["col"]})
            last_op = None
        elif v == "?" and k == "operator" and not (i and t[i - 1]["value"] in ("<", ",")):
            plain += 1
            cognitive += 1 + depth
            shape.append("?")
        elif v in ("&&", "||"):
            ops += 1
            cognitive += last_op != v
            last_op = v
            shape.append(v)
        elif v == "{" and k == "punct":
            braces.append(pending)
            pending = ""
            shape.append("{")
        elif v == "}" and k == "punct" and braces:
            braces.pop()
            shape.append("}")
        elif v == ";":
            pending = "" if pending != "for" or not braces else pending
            shape.append(";")
            last_op = None
        elif k == "number":
            shape.append("N")
        elif k == "string":
            shape.append("S")
        elif k == "identifier":
            shape.append("I")
            after = t[i + 1] if i + 1 < len(t) else None
            before = t[i - 1] if i else None
            if after and after["value"] == "(":
                rows.append({"kind": "call", "name": v, "line": x["line"], "col": x["col"]})
            elif after and after["value"] in ("=", ";", ":") and before and before["kind"] in ("identifier", "keyword") and before["value"] not in ("return", "new", "throw", "case", "break", "continue", "else", "goto", "this", "super", "instanceof"):
                rows.append({"kind": "local", "name": v, "line": x["line"], "col": x["col"]})
        elif k == "operator":
            shape.append(v)
    return plain + ops, plain, cognitive, deepest, rows, "".join(shape)


def parse(text: str) -> list[dict]:
    """Rows of kind package, import, class, interface, field, method, call, local, jump, empty_catch."""
    t = [x for x in lex(text) if x["kind"] != "comment"]
    rows: list[dict] = []
    i = 0
    while i < len(t) and t[i]["value"] in ("package", "import", "@") or i < len(t) and t[i]["value"] == ";":
        if t[i]["value"] == "@" and not (i + 1 < len(t) and t[i + 1]["value"] != "interface"):
            break
        if t[i]["value"] in ("package", "import"):
            j = i + 1
            while j < len(t) and t[j]["value"] != ";":
                j += 1
            words = [x["value"] for x in t[i + 1 : j]]
            static = bool(words) and words[0] == "static"
            name = "".join(words[static:])
            wild = name.endswith(".*")
            rows.append({"kind": t[i]["value"], "name": name.removesuffix(".*"), "line": t[i]["line"], "col": t[i]["col"], "wildcard": wild, "modifiers": ["static"] if static else []})
            i = j + 1
        elif t[i]["value"] == "@":
            break
        else:
            i += 1

    def members(i: int, end: int, owner: str, in_interface: bool) -> None:
        while i < end:
            start, mods, notes = i, [], []
            while i < end and (t[i]["value"] in _MODIFIERS or t[i]["value"] == "@" and i + 1 < end and t[i + 1]["value"] != "interface"):
                if t[i]["value"] == "@":
                    i += 1
                    notes.append(t[i]["value"])
                    i += 1
                    while i < end and t[i]["value"] == ".":
                        notes[-1] = t[i + 1]["value"]
                        i += 2
                    if i < end and t[i]["value"] == "(":
                        i = _closing(t, i, "(", ")") + 1
                else:
                    mods.append(t[i]["value"])
                    i += 1
            if i >= end:
                return
            v = t[i]["value"]
            if v in ("class", "interface", "enum", "record") and i + 1 < end and t[i + 1]["kind"] == "identifier":
                name = t[i + 1]["value"]
                j = i + 2
                parents = []
                while j < end and t[j]["value"] != "{":
                    if t[j]["kind"] == "identifier" and t[j - 1]["value"] in ("extends", "implements", ",") and owner is not None:
                        parents.append(t[j]["value"])
                    j += 1
                close = _closing(t, j)
                q = f"{owner}.{name}" if owner else name
                if v in ("class", "interface"):
                    rows.append({"kind": v, "name": name, "qname": q, "line": t[start]["line"], "col": t[start]["col"], "end_line": t[close]["line"], "modifiers": mods, "annotations": notes, "parents": parents, "owner": owner})
                members(j + 1, close, q, v == "interface")
                i = close + 1
                continue
            if v == "{":
                i = _closing(t, i) + 1
                continue
            if v in (";", "}"):
                i += 1
                continue
            j = i
            angle = 0
            while j < end and not (angle <= 0 and t[j]["value"] in ("(", "=", ";", "{", ",")):
                angle += t[j]["value"].count("<") - t[j]["value"].count(">") if t[j]["value"] in ("<", ">", ">>") else 0
                j += 1
            if j < end and t[j]["value"] == "(" and t[j - 1]["kind"] == "identifier":
                close = _closing(t, j, "(", ")")
                k = close + 1
                while k < end and t[k]["value"] not in ("{", ";"):
                    k += 1
                stop = _closing(t, k) if k < end and t[k]["value"] == "{" else min(k, end - 1)
                body = t[k : stop + 1] if k < end and t[k]["value"] == "{" else []
                cc, plain, cog, deep, inner, shape = _body(body)
                name, types = t[j - 1]["value"], [x["value"] for x in t[i : j - 1]]
                q = f"{owner}.{name}"
                rows.append({"kind": "method", "name": name, "qname": q, "line": t[start]["line"], "col": t[start]["col"], "end_line": t[stop]["line"], "modifiers": mods, "annotations": notes, "params": _parameters(t[j + 1 : close]), "owner": owner, "cyclomatic": cc, "cyclomatic_plain": plain, "cognitive": cog, "nesting": deep, "returns": "".join(types) or None, "shape": f"{name}:{shape}", "in_interface": in_interface})
                rows.extend(r | {"owner": q} for r in inner)
                i = stop + 1
            else:
                names, depth, k = [t[j - 1]["value"]] if j > i and t[j - 1]["kind"] == "identifier" else [], 0, j
                while k < end and not (depth == 0 and t[k]["value"] == ";"):
                    if t[k]["value"] in ("(", "{", "["):
                        depth += 1
                    elif t[k]["value"] in (")", "}", "]"):
                        depth -= 1
                    elif t[k]["value"] == "," and depth == 0 and k + 1 < end and t[k + 1]["kind"] == "identifier":
                        names.append(t[k + 1]["value"])
                    k += 1
                for n in names:
                    rows.append({"kind": "field", "name": n, "line": t[start]["line"], "col": t[start]["col"], "end_line": t[min(k, end - 1)]["line"], "modifiers": mods, "owner": owner})
                i = k + 1

    members(i, len(t), "", False)
    return rows


_FIELDS = [
    ("kind", pa.string()), ("name", pa.string()), ("qname", pa.string()), ("owner", pa.string()), ("line", pa.int32()),
    ("col", pa.int32()), ("end_line", pa.int32()), ("modifiers", pa.list_(pa.string())),
    ("annotations", pa.list_(pa.string())), ("params", pa.list_(pa.string())), ("parents", pa.list_(pa.string())),
    ("wildcard", pa.bool_()), ("cyclomatic", pa.int32()), ("cyclomatic_plain", pa.int32()), ("cognitive", pa.int32()),
    ("nesting", pa.int32()), ("returns", pa.string()), ("shape", pa.string()), ("in_interface", pa.bool_()),
]
FACT_SCHEMA = (
    "scan_id bigint, rel_path string, kind string, name string, qname string, owner string, line int, col int, end_line int, "
    "modifiers array<string>, annotations array<string>, params array<string>, parents array<string>, wildcard boolean, "
    "cyclomatic int, cyclomatic_plain int, cognitive int, nesting int, returns string, shape string, in_interface boolean"
)


def java_facts(corpus: DataFrame) -> DataFrame:
    return _table(corpus, "java", parse, FACT_SCHEMA, _FIELDS)


def java_tokens(corpus: DataFrame) -> DataFrame:
    return _table(corpus, "java", lex, TOKEN_SCHEMA, _TOKEN_FIELDS)


def java_words(text: str) -> tuple[list, ...]:
    """Words with their lines, without comments; numbers with line and column."""
    t = [x for x in lex(text) if x["kind"] != "comment"]
    numbers = [x for x in t if x["kind"] == "number"]
    words = [PLACEHOLDERS.get(x["kind"], x["value"]) for x in t]
    return words, [x["line"] for x in t], [x["end_line"] for x in t], *([x[k] for x in numbers] for k in ("value", "line", "col"))
