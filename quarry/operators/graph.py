"""Dependency graphs as tables: ``modules(scan_id, module_id, ...)`` and ``edges(scan_id, src, dst, kind, count)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators import paths
from quarry.operators.stage import stored


def module_id(path: Column) -> Column:
    """Path without source root and suffix, packages folded."""
    bare = F.regexp_replace(path, r"^(src/main/java|src/main/python|src/main/kotlin|src/main|src|lib|app)/", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\.[A-Za-z0-9]+$", ""), r"/__init__$", "")


def dotted_id(path: Column) -> Column:
    """Dotted module id; Java paths begin after their source root."""
    bare = F.regexp_replace(path, r"^.*src/(?:main|test)/java/", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\.[A-Za-z0-9]+$", ""), "/", "."), r"\.__init__$", "")


def package_of(path: Column) -> Column:
    """Segments of a Python file's package: its folder's dotted id."""
    bare = F.regexp_replace(path, r"^.*src/(?:main|test)/java/", "")
    return F.filter(F.split(F.regexp_replace(bare, r"/?[^/]*$", ""), r"[/.]"), lambda x: x != "")


def relative_target(package: Column, dots: Column, name: Column) -> Column:
    """Dotted id that a relative import names: one dot is the package, each further one a level up; null above the top."""
    kept = F.size(package) - dots + 1
    parts = F.concat(F.slice(package, F.lit(1), F.greatest(kept, F.lit(0))), F.filter(F.split(name, r"\."), lambda x: x != ""))
    return F.when(kept >= 0, F.array_join(parts, "."))


def merged_edges(raw: DataFrame) -> DataFrame:
    """Edges with the number of imports and whether one is a wildcard; self-loops go."""
    return raw.filter("src <> dst").groupBy("scan_id", "src", "dst", "kind").agg(
        F.sum("count").alias("count"), F.max("is_wildcard").alias("is_wildcard")
    )


def heavy_edges(edges: DataFrame, times: float) -> DataFrame:
    """Edges with at least ``times`` the mean count of their scan: the strong dependencies of a dense graph."""
    mean = edges.groupBy("scan_id").agg(F.avg("count").alias("_mean"))
    return edges.join(mean, "scan_id").filter(F.col("count") >= F.col("_mean") * times).drop("_mean")


def _suffixes(parts: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.slice(parts, i, F.size(parts)))


def resolve_imports(imports: DataFrame, modules: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """scan_id, src, target, dst, step: the module that an import (scan_id, src, target: dotted) means.

    1. The module whose path ends with the import's segments, or the reverse. Both sides' suffixes are exploded, so this is
       an equi-join; of several the longest module wins, then the first by name.
    2. The module that declares the import's last segment, by an inverted index of ``symbols`` (scan_id, name, module_id);
       of several the shortest, then the first.
    3. The module whose last segment it is; of several the shortest, then the first.

    Each step sees only what the ones before left. Imports without a segment, and modules and symbols that are null, match nothing.
    """
    def path(parts: Column) -> Column:
        return F.array_join(parts, "/")

    keys = ["scan_id", "target"]
    wanted = imports.select(*keys).distinct().withColumn("path", F.regexp_replace("target", r"\.", "/"))
    wanted = wanted.withColumn("parts", F.filter(F.split("path", "/"), lambda x: x != "")).filter(F.size("parts") > 0).withColumn("path", path(F.col("parts")))
    mods = modules.select("scan_id", F.col("module_id").alias("dst")).filter("dst <> ''").distinct()
    ends = mods.select("scan_id", "dst", F.explode(F.transform(_suffixes(F.split("dst", "/")), path)).alias("path"))
    heads = wanted.select(*keys, F.explode(F.transform(_suffixes(F.col("parts")), path)).alias("dst"))
    found = wanted.join(ends, ["scan_id", "path"]).select(*keys, "dst", F.lit(0).alias("way"))
    found = found.unionByName(heads.join(mods, ["scan_id", "dst"]).select(*keys, "dst", F.lit(1).alias("way")))
    longest = F.min(F.struct((-F.length("dst")).alias("n"), "way", "dst"))
    found = found.groupBy(*keys).agg(longest.alias("best")).select(*keys, F.col("best.dst").alias("dst"), F.lit(1).alias("step"))
    shortest = F.min(F.struct(F.length("dst").alias("n"), "dst"))
    last = wanted.select(*keys, F.element_at("parts", -1).alias("name"))
    tables = [mods.select("scan_id", F.element_at(F.split("dst", "/"), -1).alias("name"), "dst")]
    if symbols is not None:
        tables.insert(0, symbols.select("scan_id", "name", F.col("module_id").alias("dst")))
    for index in tables:
        step = 3 if index is tables[-1] else 2
        first = index.groupBy("scan_id", "name").agg(shortest.alias("best")).select("scan_id", "name", F.col("best.dst").alias("dst"))
        more = last.join(found, keys, "left_anti").join(first, ["scan_id", "name"]).select(*keys, "dst", F.lit(step).alias("step"))
        found = found.unionByName(more)
    return imports.select("scan_id", "src", "target").distinct().join(found, keys)


def resolve_dotted(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """scan_id, target, dst: the dotted module that ends with an absolute target, else with all but its last segment.

    Of several the one with most segments wins, then the first by name. What matches neither is left out.
    """
    mods = modules.select("scan_id", F.col("module_id").alias("dst")).distinct().withColumn("parts", F.split("dst", r"\."))
    ends = mods.select("scan_id", "dst", F.size("parts").alias("n"), F.explode(F.transform(_suffixes(F.col("parts")), lambda p: F.array_join(p, "."))).alias("name"))
    index = ends.groupBy("scan_id", "name").agg(F.min(F.struct((-F.col("n")).alias("n"), "dst")).alias("best")).select("scan_id", "name", F.col("best.dst").alias("dst"))
    wanted = imports.select("scan_id", "target").distinct()
    whole = wanted.select("scan_id", "target", F.col("target").alias("name"), F.lit(0).alias("way"))
    head = F.regexp_extract("target", r"^(.+)\.[^.]*$", 1)
    tries = whole.unionByName(wanted.select("scan_id", "target", head.alias("name"), F.lit(1).alias("way")))
    hits = tries.join(index, ["scan_id", "name"]).groupBy("scan_id", "target").agg(F.min_by("dst", "way").alias("dst"))
    return hits


def fans(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct neighbours in and out of every module, 0 included."""
    out = edges.groupBy("scan_id", F.col("src").alias("module_id")).agg(F.countDistinct("dst").alias("fan_out"))
    into = edges.groupBy("scan_id", F.col("dst").alias("module_id")).agg(F.countDistinct("src").alias("fan_in"))
    rows = modules.select("scan_id", "module_id").join(out, ["scan_id", "module_id"], "left").join(into, ["scan_id", "module_id"], "left")
    return rows.fillna(0, ["fan_in", "fan_out"])


def cycles(edges: DataFrame) -> DataFrame:
    """Strong components of more than one module: members, size, a shortest cycle and two severities.

    Members and path are lists for reports (a scan has at most ``Settings.max_files`` modules); ``paths`` has them as rows.
    """
    edges, _ = stored(edges)
    parts = paths.strong_components(edges)
    wild = F.coalesce(F.bool_or("is_wildcard"), F.lit(False)).alias("has_wildcard")
    flags = paths.inner_edges(edges, parts).groupBy("scan_id", "component").agg(wild)
    way = paths.shortest_cycles(edges, parts).groupBy("scan_id", "component").agg(F.array_sort(F.collect_list(F.struct("pos", "module_id"))).alias("path"))
    found = parts.groupBy("scan_id", "component").agg(F.array_sort(F.collect_list("module_id")).alias("members"))
    found = found.join(flags, ["scan_id", "component"]).join(way, ["scan_id", "component"])
    size = F.size("members")
    return found.select(
        "scan_id", "members", F.col("path.module_id").alias("path"), size.alias("size"),
        F.when(size >= 8, "critical").when(size >= 5, "high").when(size >= 3, "medium").otherwise("low").alias("severity"),
        F.when((size >= 6) | F.col("has_wildcard"), "critical").when(size >= 3, "major").otherwise("minor").alias("go_severity"),
    )


strong_components, topological_levels = paths.strong_components, paths.topological_levels


def neighbours(edges: DataFrame, node: str, most: int = 15) -> DataFrame:
    """The first ``most`` modules before and after a module."""
    into = edges.filter(F.col("dst") == node).select(F.lit("in").alias("side"), F.col("src").alias("other"), "count")
    out = edges.filter(F.col("src") == node).select(F.lit("out").alias("side"), F.col("dst").alias("other"), "count")
    w = Window.partitionBy("side").orderBy("other")
    return into.union(out).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most).drop("n")


def call_links(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls resolved to functions: of the same file first, else a name that one function alone has. No self-calls."""
    f = functions.select("scan_id", F.col("rel_path").alias("t_path"), F.col("name").alias("callee"), F.col("qname").alias("target"))
    one = Window.partitionBy("scan_id", "callee")
    same = f.withColumn("n", F.row_number().over(Window.partitionBy("scan_id", "t_path", "callee").orderBy("target"))).filter("n = 1").drop("n")
    unique = f.withColumn("n", F.count(F.lit(1)).over(one)).filter("n = 1").drop("n")
    c = calls.select("scan_id", "rel_path", "caller", "callee").distinct()
    c = c.join(same.select("scan_id", F.col("t_path").alias("rel_path"), "callee", F.col("target").alias("local")), ["scan_id", "rel_path", "callee"], "left")
    c = c.join(unique.select("scan_id", "callee", F.col("target").alias("far"), "t_path"), ["scan_id", "callee"], "left")
    c = c.withColumn("target", F.coalesce("local", "far")).withColumn("target_path", F.when(F.col("local").isNotNull(), F.col("rel_path")).otherwise(F.col("t_path")))
    c = c.filter("target is not null").filter(~((F.col("target") == F.col("caller")) & (F.col("target_path") == F.col("rel_path"))))
    return c.select("scan_id", "rel_path", "caller", "target_path", "target").distinct()


