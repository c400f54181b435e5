"""Layers, patterns, oversized modules, radar scores: joins with small constant dimensions, and one row of scores per scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import config as C
from quarry.operators.scoring import radar_grade

#: Ranks of the radar's isolation score; domain and repository stand the other way round than for violations.
RADAR_RANKS = {"controller": 0, "service": 1, "domain": 2, "repository": 3, "infra": 4}


def layer_words(spark: SparkSession) -> DataFrame:
    """(word, layer, layer_order, rank): a constant of the code, a few dozen rows, so it may be broadcast."""
    rows = [(w, name, i, rank) for i, (name, words, rank) in enumerate(C.LAYERS) for w in words]
    return F.broadcast(spark.createDataFrame(rows, "word string, layer string, layer_order int, rank int"))


def layer_hits(modules: DataFrame) -> DataFrame:
    """Every layer that a file's directories name. ``modules``: scan_id, file_path."""
    parts = F.split(F.lower("file_path"), "/")
    rows = modules.select("scan_id", "file_path", F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("word"))
    return rows.join(layer_words(modules.sparkSession), "word").select("scan_id", "file_path", "layer", "layer_order", "rank").distinct()


def file_layers(modules: DataFrame) -> DataFrame:
    """One ranked layer per file: the first by the order of layers."""
    w = Window.partitionBy("scan_id", "file_path").orderBy("layer_order")
    return layer_hits(modules).filter("rank is not null").withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n", "layer_order")


def layered_edges(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges with the layers of both ends; ``edges``: scan_id, src, dst as file paths."""
    s = layers.select("scan_id", F.col("file_path").alias("src"), F.col("layer").alias("src_layer"), F.col("rank").alias("src_rank"))
    d = layers.select("scan_id", F.col("file_path").alias("dst"), F.col("layer").alias("dst_layer"), F.col("rank").alias("dst_rank"))
    return edges.join(s, ["scan_id", "src"]).join(d, ["scan_id", "dst"])


def violation(src: Column, dst: Column, src_rank: Column, dst_rank: Column) -> tuple[Column, Column]:
    """(severity or null, kind or null) of an edge between two layers."""
    back = (src != dst) & (src_rank > dst_rank)
    skip = ((src == "controller") & dst.isin("repository", "infra")) | ((src == "view") & dst.isin("repository", "infra", "domain"))
    severity = F.when(back, F.when(src.isin("repository", "domain", "infra"), "error").otherwise("warning")).when(skip, "warning")
    return severity, F.when(back, "reverse").when(skip, "skip")


def layer_violations(edges: DataFrame, layers: DataFrame) -> DataFrame:
    rows = layered_edges(edges, layers)
    severity, kind = violation(*(F.col(c) for c in ("src_layer", "dst_layer", "src_rank", "dst_rank")))
    rows = rows.select("scan_id", "src", "src_layer", "dst", "dst_layer", severity.alias("severity"), kind.alias("kind"))
    return rows.filter("severity is not null")


def violation_summary(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Counts per scan; the ratio is over all edges."""
    severity, _ = violation(*(F.col(c) for c in ("src_layer", "dst_layer", "src_rank", "dst_rank")))
    known = layered_edges(edges, layers).groupBy("scan_id").agg(
        F.count(F.lit(1)).alias("classified_edges"), F.count(severity).alias("violation_count"),
        F.count_if(severity == "error").alias("errors"), F.count_if(severity == "warning").alias("warnings"),
    )
    rows = edges.groupBy("scan_id").agg(F.count(F.lit(1)).alias("total_edges")).join(known, "scan_id", "left")
    rows = rows.fillna(0, ["classified_edges", "violation_count", "errors", "warnings"])
    return rows.withColumn("violation_ratio", F.round(F.col("violation_count") / F.col("total_edges"), 3))


def dotted_layer(module: Column) -> Column:
    """The first layer of which a word is a segment of the dotted id."""
    out = F.lit(None).cast("string")
    for name, words, _ in reversed(C.GO_LAYERS):
        hit = F.arrays_overlap(F.split(F.lower(module), r"\."), F.array(*[F.lit(w) for w in words]))
        out = F.when(hit, name).otherwise(out)
    return out


def dotted_rank(layer: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, _, rank in C.GO_LAYERS:
        out = F.when(layer == name, rank).otherwise(out)
    return out


def dotted_violations(edges: DataFrame) -> DataFrame:
    """Import edges from a lower to an upper layer, by dotted ids. The place in the list of layers is looked up by a map, once for
    each end."""
    names, ranks = [name for name, _, _ in C.GO_LAYERS], [rank for _, _, rank in C.GO_LAYERS]
    first_of = {w: i for i, (_, words, _) in reversed([*enumerate(C.GO_LAYERS)]) for w in words}
    place = F.create_map(*[F.lit(x) for pair in first_of.items() for x in pair])

    def first(module: str) -> Column:
        return F.array_min(F.transform(F.split(F.lower(module), r"\."), lambda w: F.coalesce(F.element_at(place, w), F.lit(len(names)))))

    rows = edges.filter("kind = 'import'").select("scan_id", "src", "dst", first("src").alias("s"), first("dst").alias("d"))

    def at(values: list, place: str) -> Column:
        """The value at a place; null after the last, where no layer is named."""
        return F.get(F.array(*[F.lit(v) for v in values]), F.col(place))

    rows = rows.filter(at(ranks, "s") > at(ranks, "d"))
    return rows.select("scan_id", "src", at(names, "s").alias("src_layer"), "dst", at(names, "d").alias("dst_layer"), F.lit("error").alias("severity"))


def arch_patterns(modules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Candidate patterns per scan with a confidence, the surest first by ``place``."""
    hits = layer_hits(modules).groupBy("scan_id").agg(F.collect_set("layer").alias("layers"), F.count_if(F.col("layer") == "event").alias("events"))
    heads = modules.withColumn("p", F.split(F.lower("file_path"), "/")).groupBy("scan_id").agg(
        F.collect_set(F.when(F.size("p") > 1, F.element_at("p", 1))).alias("tops"),
        F.countDistinct(F.when((F.size("p") > 2) & F.element_at("p", 1).isin("services", "microservices", "apps"), F.element_at("p", 2))).alias("services"),
    )
    rows = heads.join(hits, "scan_id", "left").withColumn("layers", F.coalesce("layers", F.array().cast("array<string>"))).fillna(0, ["events"])

    def has(*names: str) -> Column:
        return F.size(F.array_intersect("layers", F.array(*[F.lit(n) for n in names])))

    tier, mvc, ddd = has("controller", "service", "repository"), has("domain", "view", "controller"), has("domain", "service", "repository", "infra")
    go = F.size(F.array_intersect("tops", F.array(F.lit("cmd"), F.lit("internal"), F.lit("pkg"))))
    found = {
        "three_tier": F.when(tier == 3, 0.9),
        "mvc": F.when(mvc / 3 >= 0.66, mvc / 3 * 0.85),
        "mvvm": F.when(has("view", "viewmodel") == 2, 0.8),
        "ddd": F.when(ddd / 4 >= 0.66, ddd / 4 * 0.85),
        "clean": F.when(has("domain", "service", "infra") == 3, 0.75),
        "cqrs": F.when(has("command", "query") == 2, 0.85),
        "event_driven": F.when(F.col("events") > 0, 0.3 + 0.1 * F.least(F.lit(7), F.col("events"))),
        "go_layout": F.when(go >= 2, 0.4 + 0.2 * go),
        "microservice": F.when(F.col("services") >= 2, F.least(F.lit(1.0), 0.4 + 0.1 * F.col("services"))),
    }
    none = ~F.greatest(*[c.isNotNull() for c in found.values()])
    found["monolith"] = F.when(none, 0.5)
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("pattern"), v.cast("double").alias("confidence")) for k, v in found.items()]), lambda x: x["confidence"].isNotNull())
    out = rows.select("scan_id", F.inline(pairs)).withColumn("confidence", F.round(F.least("confidence", F.lit(1.0)), 4))
    return out.withColumn("place", F.row_number().over(Window.partitionBy("scan_id").orderBy(F.desc("confidence"), "pattern")))


def _begins(prefix: str):
    return lambda m: m.startswith(prefix)


def design_patterns(classes: DataFrame) -> DataFrame:
    """scan_id, module_id, class_name, pattern, confidence. ``classes``: ..., name, kind, methods (array)."""
    def any_of(*names: str) -> Column:
        return F.exists("methods", lambda m: m.isin(*names))

    def starts(m: Column, prefixes: tuple[str, ...]) -> Column:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | m.startswith(p)
        return hit

    def ends(*suffixes: str) -> Column:
        hit = F.lit(False)
        for s in suffixes:
            hit = hit | F.col("name").endswith(s)
        return hit

    data = ("find", "get", "save", "insert", "update", "delete", "query")
    hits = sum((F.exists("methods", _begins(p)).cast("int") for p in data), F.lit(0))
    make = F.exists("methods", lambda m: starts(m, ("create", "build", "make", "new")))
    listen = F.exists("methods", lambda m: starts(m, ("register", "addListener", "addObserver", "subscribe", "on_")))
    tell = F.exists("methods", lambda m: starts(m, ("notify", "fire", "publish", "emit")))
    found = {
        "singleton": F.when(any_of("getInstance", "get_instance", "instance"), 0.9).when(any_of("__new__"), 0.6),
        "factory": F.when(ends("Factory", "Builder") & make, 0.85),
        "repository": F.when(ends("Repository", "Dao", "Mapper") & (hits >= 2), F.least(F.lit(1.0), 0.8 + 0.03 * hits)),
        "observer": F.when(listen & tell, 0.75),
        "strategy": F.when(ends("Strategy", "Policy", "Algorithm"), 0.85).when((F.col("kind") == "interface") & any_of("execute", "apply", "run", "handle"), 0.65),
    }
    pairs = F.filter(F.array(*[F.struct(F.lit(k).alias("pattern"), v.cast("double").alias("confidence")) for k, v in found.items()]), lambda x: x["confidence"].isNotNull())
    return classes.select("scan_id", "module_id", F.col("name").alias("class_name"), F.inline(pairs))


def directory_styles(modules: DataFrame) -> DataFrame:
    """scan_id, pattern, confidence of the styles that a tree's first three segments show: MVC and layers."""
    layers = ("routers", "services", "engines", "models", "schemas")
    names = {*layers, "controllers", "views"}
    heads = modules.select("scan_id", F.explode(F.slice(F.split("file_path", "/"), 1, 3)).alias("d")).filter(F.col("d").isin(*sorted(names)))
    have = heads.groupBy("scan_id").agg(F.collect_set("d").alias("dirs"))

    def count(*wanted: str) -> Column:
        return F.size(F.array_intersect("dirs", F.array(*[F.lit(w) for w in wanted])))

    found = F.array(
        F.struct(F.lit("mvc").alias("pattern"), F.when(count("controllers", "models", "views") == 3, F.lit(0.9)).alias("confidence")),
        F.struct(F.lit("layered").alias("pattern"), F.when(count(*layers) >= 3, F.round(0.6 + 0.08 * count(*layers), 2)).alias("confidence")),
    )
    return have.select("scan_id", F.inline(F.filter(found, lambda x: x["confidence"].isNotNull())))


def span(line: str, end: Column | int, w) -> Column:
    """Lines from a symbol to the next one of its window, or to ``end``."""
    last = F.lit(end) if isinstance(end, int) else end
    return F.coalesce(F.lead(line).over(w), last) - F.col(line)


def average_fans(modules: DataFrame) -> DataFrame:
    """Averages over all modules. ``modules``: fan_in, fan_out."""
    return modules.agg(F.round(F.avg("fan_in"), 4).alias("avg_fan_in"), F.round(F.avg("fan_out"), 4).alias("avg_fan_out"))


def method_spans(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Length of each method: up to the next method of its class, or to the file's end; at least 1."""
    w = Window.partitionBy("scan_id", "module_id", "parent").orderBy("line", "name")
    rows = symbols.filter("kind = 'method'").join(modules.select("scan_id", "module_id", "loc"), ["scan_id", "module_id"])
    return rows.withColumn("span", F.greatest(F.lit(1), span("line", F.col("loc") + 1, w)))


def long_methods(spans: DataFrame, limit: int = 80) -> DataFrame:
    return spans.filter(F.col("span") > limit).withColumn("severity", F.when(F.col("span") > 2 * limit, "error").otherwise("warning"))


def god_modules(modules: DataFrame, loc: int = 500, methods: int = 25, fan_in: int = 20, fan_out: int = 10) -> DataFrame:
    """``modules``: loc, methods, fan_in, fan_out."""
    hits = (F.col("loc") > loc).cast("int") + (F.col("methods") > methods).cast("int") + ((F.col("fan_in") > fan_in) & (F.col("fan_out") > fan_out)).cast("int")
    score = F.col("loc") / loc + F.col("methods") / methods
    rows = modules.withColumn("hits", hits).withColumn("score", F.round(score, 2)).filter("hits > 0")
    return rows.withColumn("severity", F.when((F.col("hits") >= 2) | (F.col("score") > 10), "error").otherwise("warning"))


def hotspots(modules: DataFrame, most: int = 50) -> DataFrame:
    """Modules of health 95 or less, the worst first."""
    health = 100 - F.greatest(F.lit(0.0), (F.col("loc") - 500) / 50) - F.greatest(F.lit(0.0), (F.col("fan_in") * F.col("fan_out") - 50) / 10)
    rows = modules.withColumn("score", F.round(F.greatest(F.lit(0.0), health), 2)).filter("score <= 95")
    return rows.orderBy("score", "module_id").limit(most)


def naming_noise(classes: DataFrame, least: int = 8) -> DataFrame:
    """Suffixes that at least ``least`` classes end with; a class counts for the first suffix in the list."""
    first = F.lit(None).cast("string")
    for s in reversed(C.NOISE_SUFFIXES):
        first = F.when(F.col("name").endswith(s), s).otherwise(first)
    rows = classes.filter("kind = 'class'").withColumn("suffix", first).filter("suffix is not null")
    return rows.groupBy("scan_id", "suffix").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def few_implementations(interfaces: DataFrame, inherits: DataFrame, most: int = 1) -> DataFrame:
    """Interfaces that at most ``most`` types inherit, by name or last segment."""
    by = inherits.select("scan_id", "src", F.element_at(F.split("dst", r"\."), -1).alias("name")).distinct()
    n = by.groupBy("scan_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return interfaces.select("scan_id", "name").distinct().join(n, ["scan_id", "name"], "left").fillna(0, ["n"]).filter(F.col("n") <= most)


def many_parents(inherits: DataFrame, least: int = 4) -> DataFrame:
    return inherits.groupBy("scan_id", "src").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def clarity(modules: DataFrame) -> DataFrame:
    """scan_id, clarity: 40 and 15 for each telling directory, at most 100; 50 for one top directory and none."""
    parts = F.split(F.lower("file_path"), "/")
    dirs = modules.select("scan_id", F.explode(F.slice(parts, 1, F.size(parts) - 1)).alias("d"))
    n = dirs.groupBy("scan_id").agg(F.countDistinct(F.when(F.col("d").isin(*C.CLARITY_DIRS), F.col("d"))).alias("hits"))
    tops = modules.groupBy("scan_id").agg(F.countDistinct(F.element_at(parts, 1)).alias("tops"))
    rows = tops.join(n, "scan_id", "left").fillna(0, ["hits"])
    return rows.select("scan_id", F.when((F.col("hits") == 0) & (F.col("tops") <= 1), 50.0).otherwise(F.least(F.lit(100.0), 40.0 + 15.0 * F.col("hits"))).alias("clarity"))


def radar(counts: DataFrame) -> DataFrame:
    """Six scores, their mean and a grade per scan.

    ``counts``: scan_id, clarity, edges, classified, reverse, modules, cyclic, out_edges, intra, inter, issues, loc, dup_rate.
    """
    c = F.col
    zero = F.lit(0.0)
    isolation = F.when(c("edges") == 0, 85.0).when(c("classified") == 0, 80.0).otherwise(F.greatest(zero, 100.0 - 120.0 * c("reverse") / c("classified")))
    n = F.greatest(c("modules"), F.lit(1))
    decoupling = F.greatest(zero, 100.0 - F.least(F.lit(50.0), 200.0 * c("cyclic") / n) - F.greatest(zero, 5.0 * (c("out_edges") / n - 4)))
    cohesion = F.when(c("edges") == 0, 75.0).when(c("intra") + c("inter") == 0, 70.0).otherwise(40 + 60.0 * c("intra") / (c("intra") + c("inter")))
    spec = F.greatest(zero, 100.0 - 400.0 * c("issues") / F.greatest(c("loc"), F.lit(1)))
    dedup = F.greatest(zero, 100.0 - 200.0 * c("dup_rate"))
    dims = {"clarity": c("clarity"), "isolation": isolation, "decoupling": decoupling, "cohesion": cohesion, "spec": spec, "dedup": dedup}
    mean = sum(dims.values(), zero) / 6
    return counts.select("scan_id", *[F.round(v, 1).alias(k) for k, v in dims.items()], F.round(mean, 1).alias("overall"), radar_grade(mean).alias("grade"))


def radar_dotted(counts: DataFrame) -> DataFrame:
    """The other radar. ``counts``: scan_id, modules, layered, violations, fan_avg, critical, major, minor, gods, longs, noise, depth_avg, depth_max."""
    c = F.col
    zero, n = F.lit(0.0), F.greatest(F.col("modules"), F.lit(1))

    def cut(x: Column) -> Column:
        return F.greatest(zero, F.least(F.lit(100.0), x))

    dims = {
        "clarity": cut(100.0 * c("layered") / n),
        "isolation": cut(100.0 - 200.0 * c("violations") / n),
        "decoupling": cut(100.0 - 4 * F.greatest(zero, c("fan_avg") - 5) - 8 * c("critical") - 5 * c("major") - 2 * c("minor")),
        "cohesion": cut(100.0 - 4 * c("gods") - c("longs") + 0.05 * F.greatest(zero, c("modules") - 50.0)),
        "discipline": cut(100.0 - 40.0 * c("noise") / n),
        "redundancy": cut(100.0 - 8 * F.greatest(zero, c("depth_avg") - 5) - 3 * F.greatest(zero, c("depth_max") - 8)),
    }
    mean = sum(dims.values(), zero) / 6
    grade = F.when(mean >= 90, "A").when(mean >= 75, "B").when(mean >= 60, "C").otherwise("D")
    return counts.select("scan_id", *[F.round(v, 1).alias(k) for k, v in dims.items()], F.round(mean, 1).alias("overall"), grade.alias("grade"))


def dotted_radar_inputs(modules: DataFrame, edges: DataFrame, cycles: DataFrame, violations: DataFrame) -> DataFrame:
    """The counts that ``radar_dotted`` takes, from the tables of an architecture scan.

    ``modules``: scan_id, file_path, layer (null: none); ``edges``: as of ``merged_edges``; ``cycles``: scan_id, go_severity;
    ``violations``: scan_id, kind (layer, godclass, longmethod, overeng). A scan without modules has no row.
    """
    depth = F.length("file_path") - F.length(F.replace("file_path", F.lit("/"), F.lit("")))
    rows = modules.groupBy("scan_id").agg(F.count(F.lit(1)).alias("modules"), F.count("layer").alias("layered"), F.avg(depth).alias("depth_avg"), F.max(depth).alias("depth_max"))
    out = edges.filter("kind = 'import'").groupBy("scan_id").agg(F.sum("count").alias("fan_out"))
    kinds = {"violations": "layer", "gods": "godclass", "longs": "longmethod", "noise": "overeng"}
    told = violations.groupBy("scan_id").agg(*[F.count_if(F.col("kind") == k).alias(name) for name, k in kinds.items()])
    rings = cycles.groupBy("scan_id").agg(*[F.count_if(F.col("go_severity") == k).alias(k) for k in ("critical", "major", "minor")])
    for other in (out, told, rings):
        rows = rows.join(other, "scan_id", "left")
    rows = rows.fillna(0, ["fan_out", *kinds, "critical", "major", "minor"])
    return rows.withColumn("fan_avg", F.col("fan_out") / F.col("modules"))


def hierarchy(leaves: DataFrame) -> DataFrame:
    """Sizes and colours of every directory and file. ``leaves``: scan_id, path, value, color.

    All prefixes of a path are exploded and grouped: a roll-up over as many levels as there are.
    """
    parts = F.split("path", "/")
    rows = leaves.select("scan_id", "value", "color", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("node"), i.alias("depth"), (i == F.size(parts)).alias("leaf")))).alias("x"))
    return rows.groupBy("scan_id", "x.node", "x.depth").agg(F.sum("value").alias("value"), F.max("color").alias("color"), F.bool_and("x.leaf").alias("is_leaf"), F.count(F.lit(1)).alias("leaves"))
