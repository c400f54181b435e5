"""A small corpus of source files, defined once: a DataFrame for Spark and a VALUES list for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.sources.corpus import from_rows

CALC = '''"""Sums."""
import os, sys
from typing import *
from app.services import user_service
import requests
import json
tax = 7.5
RATE = 3
def Total(items,rate=2):
    unused = 1
    total=0
    for i in items:
        if i > 42 and rate:
            total = total + i
        elif i < 0:
            continue
        else:
            total += 1
    return total
    print(total)


class bag:
    size = 0

    def __init__(self, a, b, c, d, e, f):
        self.items = []
        self.a = a

    def add(self, q):
        #no space
        while q:
            try:
                q -= 1
            except ValueError:
                break
        return [x for x in self.items if x and q]

    def empty(self):
        pass


def total_twice(items, rate=2):
    unused = 1
    total = 0
    for i in items:
        if i > 42 and rate:
            total = total + i
        elif i < 0:
            continue
        else:
            total += 1
    return Total(items) + bag(1, 2, 3, 4, 5, 6).add(total)
'''
TABS = "def f():\n\tx = 1\n\treturn x\n\n\ndef g():\n  y = 2\n  return [y,3]\n# end\n"
ACCOUNT = """package com.Shop.orders;
import java.util.List;
import java.util.*;
import java.io.File;

/* A block
   comment */
public class account {
    private static final int limit = 10;
    int total, count;

    /** Adds. */
    public int Add(int a, int b, int c, int d, int e, int f) {
        int q = 12;
        if(a > 5 && b > 0) {
            return a + 7;
        }
        for (int i = 0; i < a; i++) {
            try { q += i; } catch (Exception ex) {}
        }
        return q;
    }

    public List<String> names() {
        // a line
        return null;
    }
}
"""
STORE = "package shop.data;\n\npublic interface Store {\n    String find(String key);\n\tvoid save(String key);\n}\n"
ENV = "# settings\npassword = hunter2\nAPI_KEY: ${KEY}\nadmin_token='secret'\ndebug=true\ncors.allowed-origins: \"*\"\nurl=http://example.com/a\nlocal=http://localhost:1\n"

FILES: list[tuple[int, str, str, str]] = [
    (1, "app/services/calc.py", "python", CALC),
    (1, "app/services/user_service.py", "python", "def find(key):\n    return key\n"),
    (1, "app/api/Views-old.py", "python", TABS),
    (1, "src/main/java/com/shop/orders/account.java", "java", ACCOUNT),
    (1, "src/main/java/shop/data/Store.java", "java", STORE),
    (1, "config/.env", "config", ENV),
    (2, "app/services/calc_copy.py", "python", CALC.replace("Total", "total_of")),
    (2, "conf/settings.json", "config", '{"debug": "on", "list": [1, 2,]}\n'),
    (2, "conf/ok.json", "config", '{"secret": "demo"}\n'),
    (2, "blank.py", "python", "\n   \n# only\n\n"),
]
#: Module paths of three invented projects, and imports between them.
PATHS: list[tuple[int, str]] = [
    (1, "app/controllers/user.py"), (1, "app/services/user.py"), (1, "app/repository/user.py"), (1, "app/models/user.py"),
    (1, "app/infra/db.py"), (1, "app/views/page.py"), (1, "app/events/bus.py"),
    (2, "cmd/main.go"), (2, "internal/store/db.go"), (2, "pkg/util/x.go"),
    (3, "a/b.py"), (3, "a/c.py"),
]
EDGES: list[tuple[int, str, str]] = [
    (1, "app/controllers/user.py", "app/services/user.py"), (1, "app/services/user.py", "app/repository/user.py"),
    (1, "app/repository/user.py", "app/services/user.py"), (1, "app/controllers/user.py", "app/infra/db.py"),
    (1, "app/models/user.py", "app/controllers/user.py"), (1, "app/views/page.py", "app/models/user.py"),
    (1, "app/events/bus.py", "app/services/user.py"), (2, "cmd/main.go", "internal/store/db.go"), (3, "a/b.py", "a/c.py"),
]
#: Types of an invented project: module, name, kind, methods, parents.
TYPES: list[tuple[int, str, str, str, list[str], list[str]]] = [
    (1, "m.conf", "Conf", "class", ["get_instance", "load"], []),
    (1, "m.shapes", "ShapeFactory", "class", ["create_shape"], []),
    (1, "m.users", "UserRepository", "class", ["find_by_id", "save", "count"], ["Store"]),
    (1, "m.bus", "Bus", "class", ["subscribe", "publish"], ["A", "B", "C", "D"]),
    (1, "m.price", "Discount", "interface", ["apply"], []),
    (1, "m.store", "Store", "interface", ["find"], []),
    *[(1, f"m.h{i}", f"Thing{i}Helper", "class", ["go"], []) for i in range(9)],
]


def files(spark: SparkSession) -> DataFrame:
    return from_rows(spark, FILES)


def sql_text(value) -> str:
    if isinstance(value, list):
        return "CAST([" + ", ".join(map(sql_text, value)) + "] AS VARCHAR[])"
    return str(value) if isinstance(value, int | float) else "'" + value.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A derived table of constants for the SQL side."""
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(sql_text, r)) + ")" for r in rows) + f") AS v({names}))"


CORPUS_SQL = values(FILES, "scan_id, rel_path, language, text")
PATHS_SQL = values(PATHS, "scan_id, file_path")
EDGES_SQL = values(EDGES, "scan_id, src, dst")
TYPES_SQL = values(TYPES, "scan_id, module_id, name, kind, methods, parents")
