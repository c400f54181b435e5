"""Named queries on graphs, architecture, suggestions, hierarchies and parsed code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import config as C
from quarry.operators import architecture as A
from quarry.operators import clones, complexity, graph, refactor, reports
from quarry.operators.scan_store import ScanStore
from quarry.operators.stage import stored
from quarry.operators.rules import FUNCTIONS, REGISTRY, Facts, run_rules
from quarry.plans import derived
from quarry.plans.derived import CALLS_SQL, CORPUS_SQL, DOTTED_SQL, EDGES_SQL, FUNCTIONS_SQL, PATHS_SQL, TYPES_SQL, files
from quarry.plans.shared_sql import ISSUES, METRICS
from quarry.plans.text_plans import LINES
from quarry.streaming import progress

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: A graph of nations: from a line item's supplier to its customer, a scan for all rows or for each year of the orders.
RAW = """(SELECT s.s_nationkey AS a, c.c_nationkey AS b, year(o.o_orderdate) AS y FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
JOIN customer c ON c.c_custkey = o.o_custkey JOIN supplier s ON s.s_suppkey = l.l_suppkey)"""
#: Weight that an edge of the thinned graphs has at least, in means of its scan.
TIMES, YEARLY_TIMES = 1.25, 1.5


def nation_edges(spark, d: str, yearly: bool = False) -> DataFrame:
    """Edges between nations, with their number of line items; ``yearly`` has a scan for each year."""
    def t(name):
        return spark.read.parquet(f"{d}/{name}.parquet")

    li = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey", *["o_orderdate"] * yearly), F.col("l_orderkey") == F.col("o_orderkey"))
    li = li.join(t("customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    li = li.join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    scan_id = F.year("o_orderdate").cast("bigint") if yearly else F.lit(1).cast("bigint")
    raw = li.filter("s_nationkey <> c_nationkey")
    raw = raw.select(scan_id.alias("scan_id"), F.format_string("%02d", "s_nationkey").alias("src"), F.format_string("%02d", "c_nationkey").alias("dst"), F.lit("import").alias("kind"), F.lit(1).alias("count"), F.lit(False).alias("is_wildcard"))
    return graph.merged_edges(raw)


def heavy_nations(spark, d: str) -> DataFrame:
    return graph.heavy_edges(nation_edges(spark, d), TIMES)


def heavy_years(spark, d: str) -> DataFrame:
    return graph.heavy_edges(nation_edges(spark, d, yearly=True), YEARLY_TIMES)


def _heavy_sql(scan_id: str, times: float) -> str:
    return f"""(SELECT scan_id, printf('%02d', a) AS src, printf('%02d', b) AS dst, n FROM (SELECT *, avg(n) OVER (PARTITION BY scan_id) AS mean
FROM (SELECT {scan_id} AS scan_id, a, b, count(*) AS n FROM {RAW} r WHERE a <> b GROUP BY ALL)) WHERE n >= mean * {times})"""


WHOLE_EDGES = f"(SELECT 1 AS scan_id, a AS src, b AS dst, count(*) AS n FROM {RAW} r WHERE a <> b GROUP BY a, b)"
E1 = f"(SELECT scan_id, printf('%02d', src) AS src, printf('%02d', dst) AS dst, n FROM {WHOLE_EDGES} e)"
E2 = _heavy_sql("1", TIMES)
E3 = _heavy_sql("y", YEARLY_TIMES)
REACH = f"RECURSIVE e AS (SELECT src, dst FROM {E2}), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)"
_REACH = "RECURSIVE e AS (SELECT scan_id, src, dst FROM {}), reach AS (SELECT * FROM e UNION SELECT r.scan_id, r.src, e.dst FROM reach r JOIN e ON e.src = r.dst AND e.scan_id = r.scan_id)"
_SCC = "{}, scc AS (SELECT a.scan_id, a.src AS module_id, min(a.dst) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src AND a.scan_id = b.scan_id GROUP BY ALL)"
SCC, YEARLY_SCC = (_SCC.format(_REACH.format(e)) for e in (E2, E3))


def modules_of(edges: DataFrame) -> DataFrame:
    return edges.select("scan_id", F.col("src").alias("module_id")).union(edges.select("scan_id", "dst")).distinct()


@query(f"SELECT src, dst, n FROM {E1}")
def q_dep_edges(spark, d):
    return nation_edges(spark, d).select("src", "dst", F.col("count").alias("n"))


@query(f"WITH e AS (SELECT * FROM {E1}), m AS (SELECT src AS x FROM e UNION SELECT dst FROM e) SELECT x AS module_id, (SELECT count(DISTINCT src) FROM e WHERE dst = x) AS fan_in, (SELECT count(DISTINCT dst) FROM e WHERE src = x) AS fan_out FROM m")
def q_fan(spark, d):
    e = nation_edges(spark, d)
    return graph.fans(modules_of(e), e).select("module_id", "fan_in", "fan_out")


@query(f"WITH {YEARLY_SCC} SELECT scan_id, module_id, component FROM scc")
def q_scc(spark, d):
    return graph.strong_components(heavy_years(spark, d))


@query(f"WITH {SCC} SELECT module_id, component FROM scc")
def q_scc_closure(spark, d):
    return graph.strong_components(heavy_nations(spark, d)).drop("scan_id")


@query(f"WITH {YEARLY_SCC} SELECT scan_id, component, count(*) AS size, CASE WHEN count(*) >= 8 THEN 'critical' WHEN count(*) >= 5 THEN 'high' WHEN count(*) >= 3 THEN 'medium' ELSE 'low' END AS severity, CASE WHEN count(*) >= 6 THEN 'critical' WHEN count(*) >= 3 THEN 'major' ELSE 'minor' END AS go_severity FROM scc GROUP BY scan_id, component")
def q_cycle_severity(spark, d):
    found = graph.cycles(heavy_years(spark, d))
    return found.select("scan_id", F.element_at("members", 1).alias("component"), F.col("size").cast("bigint").alias("size"), "severity", "go_severity")


#: A search from every component's least node: the least depth of each node, the way back, and where it closes.
_SEARCH = f"""{YEARLY_SCC}, i AS (SELECT e.*, s.component FROM e JOIN scc s ON s.scan_id = e.scan_id AND s.module_id = e.src JOIN scc t ON t.scan_id = e.scan_id AND t.module_id = e.dst AND t.component = s.component),
steps AS (SELECT DISTINCT scan_id, component, component AS x, 0 AS k FROM scc UNION SELECT s.scan_id, s.component, i.dst, s.k + 1 FROM steps s JOIN i ON i.scan_id = s.scan_id AND i.component = s.component AND i.src = s.x WHERE s.k < 25),
depth AS (SELECT scan_id, component, x, min(k) AS k FROM steps GROUP BY ALL),
last AS (SELECT d.scan_id, d.component, min_by(x, (k, x)) AS x, min(k) AS k FROM depth d JOIN i ON i.scan_id = d.scan_id AND i.component = d.component AND i.src = d.x WHERE i.dst = d.component GROUP BY ALL)"""


@query(f"WITH {_SEARCH} SELECT scan_id, component, CAST(k + 1 AS BIGINT) AS length FROM last")
def q_shortest_cycle_len(spark, d):
    return _nation_cycles(spark, d).groupBy("scan_id", "component").agg(F.count(F.lit(1)).alias("length"))


@query(f"""WITH {_SEARCH}, before AS (SELECT d.scan_id, d.component, d.x, min(b.x) AS p FROM depth d JOIN depth b ON b.scan_id = d.scan_id AND b.component = d.component AND b.k = d.k - 1
JOIN i ON i.scan_id = d.scan_id AND i.component = d.component AND i.src = b.x AND i.dst = d.x GROUP BY ALL),
way AS (SELECT * FROM last UNION ALL SELECT w.scan_id, w.component, b.p, w.k - 1 FROM way w JOIN before b ON b.scan_id = w.scan_id AND b.component = w.component AND b.x = w.x WHERE w.k > 0)
SELECT scan_id, component, CAST(k AS INT) AS pos, x AS module_id FROM way""")
def q_shortest_cycle(spark, d):
    return _nation_cycles(spark, d)


def _nation_cycles(spark, d) -> DataFrame:
    edges, _ = stored(heavy_years(spark, d))
    return graph.paths.shortest_cycles(edges, graph.strong_components(edges))


@query("""WITH RECURSIVE e AS (SELECT DISTINCT p_size % 10 AS a, p_size % 10 + 1 + p_partkey % 3 AS b FROM part WHERE p_size % 10 + 1 + p_partkey % 3 < 12),
l AS (SELECT DISTINCT a AS x, 0 AS k FROM e WHERE a NOT IN (SELECT b FROM e) UNION SELECT e.b, l.k + 1 FROM l JOIN e ON e.a = l.x)
SELECT CAST(x AS VARCHAR) AS module_id, CAST(max(k) AS INT) AS level FROM l GROUP BY x""")
def q_topo_level(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    a, b = F.col("p_size") % 10, F.col("p_size") % 10 + 1 + F.col("p_partkey") % 3
    e = part.filter(b < 12).select(F.lit(1).alias("scan_id"), a.cast("string").alias("src"), b.cast("string").alias("dst")).distinct()
    return graph.topological_levels(e).select("module_id", "level")


@query(f"SELECT side, other, n FROM (SELECT 'in' AS side, src AS other, n, row_number() OVER (ORDER BY src) AS k FROM {E1} WHERE dst = '03' UNION ALL SELECT 'out', dst, n, row_number() OVER (ORDER BY dst) FROM {E1} WHERE src = '03') WHERE k <= 15")
def q_neighbours(spark, d):
    return graph.neighbours(nation_edges(spark, d), "03").select("side", "other", F.col("count").alias("n"))


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages),
m AS (SELECT DISTINCT lower(regexp_extract(url, '//([^/]*)', 1)) AS module_id FROM pages)
SELECT target, count(*) AS n, count(DISTINCT page_id) AS pages FROM h WHERE target <> '' GROUP BY target""")
def q_href_edges(spark, d):
    p = spark.read.parquet(f"{d}/pages.parquet")
    h = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1))).alias("target")).filter("target <> ''")
    return h.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


#: Pages as modules by site, language and number, and a module for each language; their links and their own numbers are imports,
#: the words of their headings symbols.
_SITE = r"https?://(?:www\.|blog\.|m\.)?([a-z0-9-]+)\.[^/]*/([a-z]+)/([0-9]+)"
_PAGES_SQL = f"(SELECT html, regexp_extract(url, '{_SITE}', 1) || '/' || regexp_extract(url, '{_SITE}', 2) || '/' || regexp_extract(url, '{_SITE}', 3) AS module_id, regexp_extract(url, '{_SITE}', 2) AS lang, regexp_extract(url, '{_SITE}', 3) AS k FROM pages)"


@query(f"""WITH p AS (SELECT * FROM {_PAGES_SQL}), m AS (SELECT module_id AS dst FROM p UNION SELECT 'site/' || lang FROM p),
sym AS (SELECT DISTINCT module_id AS dst, unnest(string_split(regexp_extract(html, '<h1[^>]*>([^<]*)<', 1), ' ')) AS name FROM p),
i AS (SELECT DISTINCT 'index' AS src, lang || '.' || k AS target FROM p UNION SELECT module_id, lang || '.' || unnest(regexp_extract_all(html, 'href="/([^".]+)"', 1)) FROM p),
w AS (SELECT DISTINCT target, list_filter(string_split(replace(target, '.', '/'), '/'), lambda x: x <> '') AS parts FROM i),
a AS (SELECT target, min_by(dst, (-length(dst), dst)) AS dst, 1 AS step FROM w JOIN m ON m.dst = array_to_string(parts, '/') OR ends_with(m.dst, '/' || array_to_string(parts, '/')) OR ends_with(array_to_string(parts, '/'), '/' || m.dst) GROUP BY target),
b AS (SELECT target, min_by(dst, (length(dst), dst)) AS dst, 2 AS step FROM w JOIN sym ON name = parts[-1] WHERE target NOT IN (SELECT target FROM a) GROUP BY target),
c AS (SELECT target, min_by(dst, (length(dst), dst)) AS dst, 3 AS step FROM w JOIN m ON string_split(m.dst, '/')[-1] = parts[-1] WHERE target NOT IN (SELECT target FROM a UNION SELECT target FROM b) GROUP BY target)
SELECT src, target, dst, step FROM i JOIN (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) USING (target)""")
def q_import_suffix(spark, d):
    part = [F.regexp_extract("url", _SITE, i) for i in (1, 2, 3)]
    p = spark.read.parquet(f"{d}/pages.parquet").select(F.lit(1).alias("scan_id"), "html", F.concat_ws("/", *part).alias("module_id"), part[1].alias("lang"), part[2].alias("k"))
    mods = p.select("scan_id", "module_id").union(p.select("scan_id", F.concat(F.lit("site/"), "lang"))).distinct()
    heading = F.regexp_extract("html", "<h1[^>]*>([^<]*)<", 1)
    symbols = p.select("scan_id", "module_id", F.explode(F.split(heading, " ")).alias("name")).distinct()
    links = p.select("scan_id", F.col("module_id").alias("src"), "lang", F.explode(F.regexp_extract_all("html", F.lit('href="/([^".]+)"'), F.lit(1))).alias("x"))
    imports = links.unionByName(p.select("scan_id", F.lit("index").alias("src"), "lang", F.col("k").alias("x")))
    return graph.resolve_imports(imports.select("scan_id", "src", F.concat_ws(".", "lang", "x").alias("target")), mods, symbols).drop("scan_id")


_WORDS = ", ".join(f"('{w}', '{name}', {i}, {rank if rank is not None else 'NULL'})" for i, (name, words, rank) in enumerate(C.LAYERS) for w in words)
HITS = f"(SELECT DISTINCT scan_id, file_path, layer, ord, rank FROM (SELECT scan_id, file_path, unnest(string_split(lower(file_path), '/')[1:-2]) AS word FROM {PATHS_SQL}) JOIN (VALUES {_WORDS}) k(word, layer, ord, rank) USING (word))"
FILE_LAYERS = f"(SELECT scan_id, file_path, layer, rank FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, file_path ORDER BY ord) AS n FROM {HITS} WHERE rank IS NOT NULL) WHERE n = 1)"
LAYERED = f"(SELECT e.*, s.layer AS sl, s.rank AS sr, t.layer AS dl, t.rank AS dr FROM {EDGES_SQL} e JOIN {FILE_LAYERS} s ON s.scan_id = e.scan_id AND s.file_path = e.src JOIN {FILE_LAYERS} t ON t.scan_id = e.scan_id AND t.file_path = e.dst)"
SEVERITY = "CASE WHEN sl <> dl AND sr > dr THEN CASE WHEN sl IN ('repository', 'domain', 'infra') THEN 'error' ELSE 'warning' END WHEN (sl = 'controller' AND dl IN ('repository', 'infra')) OR (sl = 'view' AND dl IN ('repository', 'infra', 'domain')) THEN 'warning' END"


@query(f"SELECT scan_id, file_path, layer FROM {FILE_LAYERS}")
def q_layer_assign(spark, d):
    return A.file_layers(derived.modules(spark, d)).select("scan_id", "file_path", "layer")


@query(f"SELECT src, sl AS src_layer, dst, dl AS dst_layer, {SEVERITY} AS severity FROM {LAYERED} WHERE {SEVERITY} IS NOT NULL")
def q_layer_violations(spark, d):
    return A.layer_violations(derived.edges(spark, d), A.file_layers(derived.modules(spark, d))).drop("scan_id", "kind")


@query(f"SELECT e.scan_id, count(*) AS total_edges, count(x.sl) AS classified_edges, count(x.s) AS violation_count, CAST(count(*) FILTER (x.s = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (x.s = 'warning') AS BIGINT) AS warnings, round(count(x.s) / count(*), 3) AS violation_ratio FROM {EDGES_SQL} e LEFT JOIN (SELECT *, {SEVERITY} AS s FROM {LAYERED}) x ON x.scan_id = e.scan_id AND x.src = e.src AND x.dst = e.dst GROUP BY e.scan_id")
def q_layer_summary(spark, d):
    return A.violation_summary(derived.edges(spark, d), A.file_layers(derived.modules(spark, d)))


def _go_layer(col: str, value: str) -> str:
    cases = " ".join(f"WHEN list_has_any(string_split(lower({col}), '.'), [{', '.join(repr(w) for w in words)}]) THEN {repr(name) if value == 'name' else rank}" for name, words, rank in C.GO_LAYERS)
    return f"CASE {cases} END"


@query(f"SELECT scan_id, src, {_go_layer('src', 'name')} AS src_layer, dst, {_go_layer('dst', 'name')} AS dst_layer FROM {DOTTED_SQL} WHERE kind = 'import' AND {_go_layer('src', 'rank')} > {_go_layer('dst', 'rank')}")
def q_layer_go(spark, d):
    return A.dotted_violations(derived.dotted_edges(spark, d)).drop("severity")


@query(f"SELECT round(count_if(a.n_regionkey <> b.n_regionkey) / count(*), 6) AS ratio FROM {WHOLE_EDGES} e JOIN nation a ON a.n_nationkey = e.src JOIN nation b ON b.n_nationkey = e.dst")
def q_cross_layer_ratio(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet").select(F.format_string("%02d", "n_nationkey").alias("k"), "n_regionkey")
    e = nation_edges(spark, d)
    e = e.join(n.toDF("src", "ra"), "src").join(n.toDF("dst", "rb"), "dst")
    return e.agg(F.round(F.count_if(F.col("ra") != F.col("rb")) / F.count(F.lit(1)), 6).alias("ratio"))


@query(f"""WITH h AS (SELECT scan_id, list(DISTINCT layer) AS l, count_if(layer = 'event') AS ev FROM {HITS} GROUP BY scan_id),
t AS (SELECT scan_id, list(DISTINCT string_split(lower(file_path), '/')[1]) AS tops FROM {PATHS_SQL} GROUP BY scan_id),
b AS (SELECT t.scan_id, coalesce(l, []) AS l, coalesce(ev, 0) AS ev, tops, len(list_intersect(tops, ['cmd', 'internal', 'pkg'])) AS go FROM t LEFT JOIN h USING (scan_id)),
ms AS (SELECT scan_id, count(DISTINCT p[2]) AS services FROM (SELECT scan_id, string_split(lower(file_path), '/') AS p FROM {PATHS_SQL}) WHERE len(p) > 2 AND p[1] IN ('services', 'microservices', 'apps') GROUP BY scan_id),
c AS (SELECT scan_id, 'three_tier' AS pattern, CASE WHEN len(list_intersect(l, ['controller', 'service', 'repository'])) = 3 THEN 0.9 END AS confidence FROM b
UNION ALL SELECT scan_id, 'mvc', CASE WHEN len(list_intersect(l, ['domain', 'view', 'controller'])) / 3 >= 0.66 THEN len(list_intersect(l, ['domain', 'view', 'controller'])) / 3 * 0.85 END FROM b
UNION ALL SELECT scan_id, 'mvvm', CASE WHEN len(list_intersect(l, ['view', 'viewmodel'])) = 2 THEN 0.8 END FROM b
UNION ALL SELECT scan_id, 'ddd', CASE WHEN len(list_intersect(l, ['domain', 'service', 'repository', 'infra'])) / 4 >= 0.66 THEN len(list_intersect(l, ['domain', 'service', 'repository', 'infra'])) / 4 * 0.85 END FROM b
UNION ALL SELECT scan_id, 'clean', CASE WHEN len(list_intersect(l, ['domain', 'service', 'infra'])) = 3 THEN 0.75 END FROM b
UNION ALL SELECT scan_id, 'cqrs', CASE WHEN len(list_intersect(l, ['command', 'query'])) = 2 THEN 0.85 END FROM b
UNION ALL SELECT scan_id, 'event_driven', CASE WHEN ev > 0 THEN 0.3 + 0.1 * least(7, ev) END FROM b
UNION ALL SELECT scan_id, 'microservice', CASE WHEN services >= 2 THEN least(1.0, 0.4 + 0.1 * services) END FROM ms
UNION ALL SELECT scan_id, 'go_layout', CASE WHEN go >= 2 THEN 0.4 + 0.2 * go END FROM b),
k AS (SELECT * FROM c WHERE confidence IS NOT NULL UNION ALL SELECT scan_id, 'monolith', 0.5 FROM b WHERE scan_id NOT IN (SELECT scan_id FROM c WHERE confidence IS NOT NULL))
SELECT scan_id, pattern, round(least(confidence, 1.0), 4) AS confidence FROM k""")
def q_arch_patterns(spark, d):
    return A.arch_patterns(derived.modules(spark, d)).drop("place")


_M = "len(list_filter(methods, lambda m: regexp_matches(m, '{}'))) > 0"


@query(f"""WITH t AS (SELECT * FROM {TYPES_SQL})
SELECT module_id, name AS class_name, 'singleton' AS pattern, 0.9 AS confidence FROM t WHERE {_M.format('^(getInstance|get_instance|instance)$')}
UNION ALL SELECT module_id, name, 'factory', 0.85 FROM t WHERE regexp_matches(name, '(Factory|Builder)$') AND {_M.format('^(create|build|make|new)')}
UNION ALL SELECT module_id, name, 'repository', 0.8 + 0.03 * h FROM (SELECT *, len(list_filter(['find', 'get', 'save', 'insert', 'update', 'delete', 'query'], lambda p: len(list_filter(methods, lambda m: starts_with(m, p))) > 0)) AS h FROM t) WHERE regexp_matches(name, '(Repository|Dao|Mapper)$') AND h >= 2
UNION ALL SELECT module_id, name, 'observer', 0.75 FROM t WHERE {_M.format('^(register|addListener|addObserver|subscribe|on_)')} AND {_M.format('^(notify|fire|publish|emit)')}
UNION ALL SELECT module_id, name, 'strategy', 0.65 FROM t WHERE kind = 'interface' AND {_M.format('^(execute|apply|run|handle)$')}""")
def q_design_patterns(spark, d):
    return A.design_patterns(derived.types(spark, d)).drop("scan_id")


_NOISE = " ".join(f"WHEN ends_with(name, '{x}') THEN '{x}'" for x in C.NOISE_SUFFIXES)


@query(f"SELECT suffix, count(*) AS n FROM (SELECT CASE {_NOISE} END AS suffix FROM {TYPES_SQL} WHERE kind = 'class') WHERE suffix IS NOT NULL GROUP BY suffix HAVING count(*) >= 8")
def q_naming_noise(spark, d):
    return A.naming_noise(derived.types(spark, d)).drop("scan_id")


@query(f"WITH t AS (SELECT * FROM {TYPES_SQL}), p AS (SELECT DISTINCT module_id, unnest(parents) AS parent FROM t) SELECT name, (SELECT count(*) FROM p WHERE parent = name) AS n FROM t WHERE kind = 'interface' AND (SELECT count(*) FROM p WHERE parent = name) <= 1")
def q_abstract_few_impl(spark, d):
    t = derived.types(spark, d)
    return A.few_implementations(t.filter("kind = 'interface'"), t.select("scan_id", F.col("module_id").alias("src"), F.explode("parents").alias("dst"))).drop("scan_id")


@query(f"SELECT module_id AS src, len(parents) AS n FROM {TYPES_SQL} WHERE len(parents) >= 4")
def q_deep_inherit(spark, d):
    return A.many_parents(derived.types(spark, d).select("scan_id", F.col("module_id").alias("src"), F.explode("parents").alias("dst"))).drop("scan_id")


MODULES = "(SELECT o_custkey AS module_id, count(*) * 40 AS loc, CAST(max(extract('month' FROM o_orderdate)) + 16 AS BIGINT) AS methods, count(DISTINCT o_orderstatus) * 8 AS fan_in, count(DISTINCT o_orderpriority) * 3 AS fan_out FROM orders GROUP BY o_custkey)"


def _order_modules(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.groupBy(F.col("o_custkey").alias("module_id")).agg(
        (F.count(F.lit(1)) * 40).alias("loc"), (F.max(F.month("o_orderdate")) + 16).cast("bigint").alias("methods"),
        (F.countDistinct("o_orderstatus") * 8).alias("fan_in"), (F.countDistinct("o_orderpriority") * 3).alias("fan_out"),
    )


_HITS = "(CASE WHEN loc > 500 THEN 1 ELSE 0 END + CASE WHEN methods > 25 THEN 1 ELSE 0 END + CASE WHEN fan_in > 20 AND fan_out > 10 THEN 1 ELSE 0 END)"


@query(f"SELECT module_id, round(loc / 500 + methods / 25, 2) AS score, CASE WHEN {_HITS} >= 2 OR round(loc / 500 + methods / 25, 2) > 10 THEN 'error' ELSE 'warning' END AS severity FROM {MODULES} WHERE {_HITS} > 0")
def q_godclass_go(spark, d):
    return A.god_modules(_order_modules(spark, d)).select("module_id", "score", "severity")


@query(f"SELECT module_id, round(greatest(0.0, 100 - greatest(0.0, (loc - 500) / 50) - greatest(0.0, (fan_in * fan_out - 50) / 10)), 2) AS score FROM {MODULES} WHERE round(greatest(0.0, 100 - greatest(0.0, (loc - 500) / 50) - greatest(0.0, (fan_in * fan_out - 50) / 10)), 2) <= 95 ORDER BY score, module_id LIMIT 50")
def q_hotspots(spark, d):
    return A.hotspots(_order_modules(spark, d)).select("module_id", "score")


_RADAR = f"""SELECT o_custkey AS scan_id, 40.0 + o_custkey % 50 AS clarity, count(*) AS edges, count(*) - 1 AS classified, CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS rev,
count(DISTINCT o_orderpriority) AS modules, CAST(count_if(o_orderstatus = 'P') AS BIGINT) % 2 AS cyclic, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS intra, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS inter_, count(*) * 2 AS issues, count(*) * 90 AS loc FROM orders GROUP BY o_custkey"""


@query(f"""WITH r AS ({_RADAR}), s AS (SELECT scan_id, clarity, CASE WHEN classified = 0 THEN 80.0 ELSE greatest(0.0, 100.0 - 120.0 * rev / classified) END AS isolation,
greatest(0.0, 100.0 - least(50.0, 200.0 * cyclic / greatest(modules, 1)) - greatest(0.0, 5.0 * (edges / greatest(modules, 1) - 4))) AS decoupling,
CASE WHEN intra + inter_ = 0 THEN 70.0 ELSE 40 + 60.0 * intra / (intra + inter_) END AS cohesion, greatest(0.0, 100.0 - 400.0 * issues / loc) AS spec, 80.0 AS dedup FROM r)
SELECT scan_id, round(clarity, 1) AS clarity, round(isolation, 1) AS isolation, round(decoupling, 1) AS decoupling, round(cohesion, 1) AS cohesion, round(spec, 1) AS spec, dedup, round((clarity + isolation + decoupling + cohesion + spec + dedup) / 6, 1) AS overall,
CASE WHEN (clarity + isolation + decoupling + cohesion + spec + dedup) / 6 >= 90 THEN 'A' WHEN (clarity + isolation + decoupling + cohesion + spec + dedup) / 6 >= 80 THEN 'B' WHEN (clarity + isolation + decoupling + cohesion + spec + dedup) / 6 >= 70 THEN 'C' WHEN (clarity + isolation + decoupling + cohesion + spec + dedup) / 6 >= 60 THEN 'D' ELSE 'E' END AS grade FROM s""")
def q_radar_py(spark, d):
    n = F.count(F.lit(1))
    status = lambda s: F.count_if(F.col("o_orderstatus") == s)
    c = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("scan_id")).agg(
        n.alias("edges"), (n - 1).alias("classified"), status("F").alias("reverse"), F.countDistinct("o_orderpriority").alias("modules"), (status("P") % 2).alias("cyclic"),
        n.alias("out_edges"), status("O").alias("intra"), status("P").alias("inter"), (n * 2).alias("issues"), (n * 90).alias("loc"),
    )
    return A.radar(c.withColumn("clarity", 40.0 + F.col("scan_id") % 50).withColumn("dup_rate", F.lit(0.1)))


@query("""SELECT scan_id, 60.0 AS clarity, round(greatest(0.0, 100.0 - 200.0 * v / 10), 1) AS isolation, round(greatest(0.0, 100.0 - 4 * greatest(0.0, f - 5) - 8 * v), 1) AS decoupling, 96.0 AS cohesion, 80.0 AS discipline, 92.0 AS redundancy
FROM (SELECT o_custkey AS scan_id, CAST(count_if(o_orderstatus = 'F') AS BIGINT) % 4 AS v, count(*) AS f FROM orders GROUP BY o_custkey)""")
def q_radar_go(spark, d):
    c = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("scan_id")).agg((F.count_if(F.col("o_orderstatus") == "F") % 4).alias("violations"), F.count(F.lit(1)).alias("fan_avg"))
    c = c.withColumns({"modules": F.lit(10), "layered": F.lit(6), "critical": F.col("violations"), "major": F.lit(0), "minor": F.lit(0), "gods": F.lit(1), "longs": F.lit(0), "noise": F.lit(5), "depth_avg": F.lit(6.0), "depth_max": F.lit(8)})
    return A.radar_dotted(c).drop("overall", "grade")


@query(f"SELECT scan_id, CASE WHEN hits = 0 AND tops <= 1 THEN 50.0 ELSE least(100.0, 40.0 + 15.0 * hits) END AS clarity FROM (SELECT p.scan_id, count(DISTINCT string_split(lower(file_path), '/')[1]) AS tops, (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split(lower(q.file_path), '/')[1:-2]) AS w FROM {PATHS_SQL} q WHERE q.scan_id = p.scan_id) WHERE w IN ({', '.join(repr(w) for w in C.CLARITY_DIRS)})) AS hits FROM {PATHS_SQL} p GROUP BY p.scan_id)")
def q_clarity(spark, d):
    return A.clarity(derived.modules(spark, d))


_PARTS = "(SELECT page_id, string_split(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/') AS p, length(html) AS value, page_id % 7 AS color FROM pages)"


@query(f"SELECT node, CAST(depth AS INT) AS depth, CAST(sum(value) AS BIGINT) AS value, max(color) AS color, count(*) AS leaves FROM (SELECT array_to_string(p[1:i], '/') AS node, i AS depth, value, color FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM {_PARTS})) GROUP BY node, depth")
def q_hierarchy(spark, d):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    leaves = spark.read.parquet(f"{d}/pages.parquet").select(F.lit(1).alias("scan_id"), path.alias("path"), F.length("html").cast("bigint").alias("value"), (F.col("page_id") % 7).alias("color"))
    return A.hierarchy(leaves).drop("scan_id", "is_leaf")


@query(f"SELECT node, CAST(sum(value) AS BIGINT) AS value, max(color) AS color FROM (SELECT p[1] AS node, value, color FROM {_PARTS}) GROUP BY node ORDER BY value DESC, node LIMIT 20")
def q_treemap_go(spark, d):
    return q_hierarchy(spark, d).filter("depth = 1").orderBy(F.desc("value"), "node").limit(20).select("node", "value", "color")


@query(f"""WITH f AS (SELECT * FROM {FUNCTIONS_SQL}), c AS (SELECT DISTINCT * FROM {CALLS_SQL}), u AS (SELECT name FROM f GROUP BY name HAVING count(*) = 1),
r AS (SELECT c.*, coalesce(l.qname, g.qname) AS target, coalesce(l.rel_path, g.rel_path) AS target_path FROM c LEFT JOIN f l ON l.rel_path = c.rel_path AND l.name = c.callee LEFT JOIN (SELECT f.* FROM f JOIN u USING (name)) g ON g.name = c.callee)
SELECT DISTINCT rel_path, caller, target_path, target FROM r WHERE target IS NOT NULL AND NOT (target = caller AND target_path = rel_path)""")
def q_call_graph(spark, d):
    return graph.call_links(derived.functions(spark, d), derived.calls(spark, d)).drop("scan_id")


def _metric_rows(spark, d) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.select(F.lit(1).alias("scan_id"), F.col("l_orderkey").cast("string").alias("rel_path"), F.col("l_partkey").cast("string").alias("function_name"), F.col("l_linenumber").alias("start_line"), F.col("l_quantity").cast("int").alias("cyclomatic"), F.floor(F.col("l_extendedprice") / 5000).cast("int").alias("cognitive"), F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("lines"))


@query(f"""SELECT substring(md5('hot|' || file_id || '|' || fn), 1, 8) AS id, CASE WHEN cyclomatic >= 20 THEN 'high' ELSE 'medium' END AS impact, CAST(CASE WHEN cyclomatic >= 20 THEN 50 ELSE 34 END AS INT) AS priority
FROM {METRICS} m WHERE cyclomatic >= 15 OR cognitive >= 20 OR lines >= 80 ORDER BY cyclomatic + cognitive DESC, lines DESC, CAST(file_id AS VARCHAR), CAST(fn AS VARCHAR), pos LIMIT 10""")
def q_refactor_hot(spark, d):
    return refactor.hot_functions(_metric_rows(spark, d)).select("id", "impact", "priority")


@query("""SELECT substring(md5('dup|' || fp), 1, 8) AS id, CASE WHEN ln < 20 THEN 'low' ELSE 'medium' END AS effort, CAST(CASE WHEN ln < 20 THEN 67 ELSE 34 END AS INT) AS priority FROM
(SELECT CAST(l_partkey AS VARCHAR) AS fp, count(*) AS n, max(l_linenumber) * 5 AS ln FROM lineitem GROUP BY l_partkey) WHERE n >= 2 AND ln >= 10 ORDER BY ln * n DESC, fp LIMIT 8""")
def q_refactor_dups(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_partkey").cast("string").alias("fingerprint")).agg((F.max("l_linenumber") * 5).alias("line_length"), F.collect_list(F.struct(F.col("l_orderkey").cast("string").alias("file_path"))).alias("occurrences"))
    return refactor.clone_suggestions(li.withColumn("scan_id", F.lit(1))).select("id", "effort", "priority")


_SMELL = "CASE event_type WHEN 'error' THEN 'class_split' WHEN 'view' THEN 'method_decomp' WHEN 'click' THEN 'arg_object' END"


def _smell_rows(spark, d) -> DataFrame:
    code = F.when(F.col("event_type") == "error", "PY-SM001").when(F.col("event_type") == "view", "PY-SM002").when(F.col("event_type") == "click", "PY-SM003")
    return spark.read.parquet(f"{d}/events.parquet").select(F.lit(1).alias("scan_id"), code.alias("rule_code"), F.col("user_id").cast("string").alias("rel_path"), F.floor("value").cast("int").alias("line"), F.lit("m").alias("message"))


@query(f"SELECT substring(md5(k || '|' || user_id || '|' || line), 1, 8) AS id, k AS category, CAST(CASE k WHEN 'class_split' THEN 34 WHEN 'method_decomp' THEN 34 ELSE 67 END AS INT) AS priority FROM (SELECT user_id, CAST(floor(value) AS INT) AS line, {_SMELL} AS k FROM events) WHERE k IS NOT NULL")
def q_refactor_smells(spark, d):
    return refactor.smell_suggestions(_smell_rows(spark, d)).select("id", "category", "priority")


@query(f"SELECT DISTINCT substring(md5(k || '|' || user_id || '|' || line), 1, 8) AS id, k AS category, CAST(CASE k WHEN 'class_split' THEN 34 WHEN 'method_decomp' THEN 34 ELSE 67 END AS INT) AS priority FROM (SELECT user_id, CAST(floor(value) AS INT) AS line, {_SMELL} AS k FROM events) WHERE k IS NOT NULL")
def q_refactor_merge(spark, d):
    s = refactor.smell_suggestions(_smell_rows(spark, d))
    return refactor.merged(s, s).select("id", "category", "priority")


@query(f"SELECT scan_id, substring(md5('layer|' || sl || '|' || dl), 1, 8) AS id, CASE WHEN bool_or(s = 'error') THEN 'high' ELSE 'medium' END AS impact FROM (SELECT *, {SEVERITY} AS s FROM {LAYERED}) WHERE s IS NOT NULL GROUP BY scan_id, sl, dl")
def q_refactor_layers(spark, d):
    v = A.layer_violations(derived.edges(spark, d), A.file_layers(derived.modules(spark, d)))
    return refactor.layer_suggestions(v).select("scan_id", "id", "impact")


@query(f"SELECT category, severity, count(*) AS n FROM {ISSUES} i GROUP BY category, severity")
def q_violations_by_kind(spark, d):
    ev = spark.read.parquet(f"{d}/events.parquet")
    sev = F.when(F.col("event_type") == "error", "error").when(F.col("event_type").isin("purchase", "signup"), "warning").otherwise("info")
    cat = F.when(F.col("event_id") % 3 == 0, "style").when(F.col("event_id") % 3 == 1, "dead").otherwise("naming")
    return ev.groupBy(cat.alias("category"), sev.alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT l.rel_path, l.line_no AS line, string_agg(c.raw, chr(10) ORDER BY c.line_no) AS snippet FROM {LINES} l JOIN {LINES} c ON c.scan_id = l.scan_id AND c.rel_path = l.rel_path AND c.line_no BETWEEN l.line_no - 1 AND l.line_no + 1 WHERE length(l.raw) > 60 GROUP BY ALL")
def q_snippet_context(spark, d):
    from quarry.operators.lines import line_array

    def around(raw, i):
        lo = F.greatest(F.lit(1), i)
        return F.when(F.length(raw) > 60, F.struct((i + 1).alias("line"), F.array_join(F.slice("ls", lo, i + 3 - lo), "\n").alias("snippet")))

    # a text is split once, and its snippets are made before they are exploded
    texts = files(spark, d).select("rel_path", F.explode(F.array(line_array(F.col("text")))).alias("ls"))
    return texts.select("rel_path", F.inline(F.filter(F.transform("ls", around), lambda x: x.isNotNull())))


@query(f"SELECT rel_path, regexp_replace(regexp_replace(regexp_replace(rel_path, '^.*src/(main|test)/java/', ''), '\\.[A-Za-z0-9]+$', ''), '/', '.', 'g') AS module_id FROM {CORPUS_SQL} WHERE language <> 'config'")
def q_module_ids(spark, d):
    return files(spark, d).filter("language <> 'config'").select("rel_path", graph.dotted_id(F.col("rel_path")).alias("module_id"))


# ---- parsed code: no SQL form ----

SHAPE_FIELDS = ("line", "end_line", "skeleton")
TOKEN_FIELDS = ("pos", "kind", "value", "line", "end_line")


def _once(spark, d: str) -> Facts:
    """Facts of which a query reads one table, so that nothing is kept."""
    return Facts(files(spark, d), shared=False)


def metric_nodes(f: Facts) -> DataFrame:
    """Functions, and the nodes that add to their measures; what is read of them is stored, as both are taken from it."""
    fields = ("node_id", "kind", "name", "qname", "line", "end_line", "params", "cog_depth", "nest_depth", "funcs", "cyclomatic", "cognitive", "value_kind")
    return stored(f.python(FUNCTIONS, *fields, weighted=True))[0]


@query()
def q_py_functions(spark, d):
    return _once(spark, d).python((*FUNCTIONS, "ClassDef"), "kind", "qname", "line", "end_line", "params", "has_doc").select("scan_id", "rel_path", "kind", "qname", "line", "end_line", "params", "has_doc")


@query()
def q_py_imports(spark, d):
    return _once(spark, d).python(("Import", "ImportFrom"), "line", "name", "params").select("scan_id", "rel_path", "line", F.col("name").alias("module"), F.col("params").alias("names"))


@query()
def q_py_tokens(spark, d):
    return _once(spark, d).tokens("kind").groupBy("scan_id", "rel_path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query()
def q_py_metrics(spark, d):
    return complexity.python_metrics(metric_nodes(_once(spark, d)))


@query()
def q_java_metrics(spark, d):
    return complexity.java_metrics(_once(spark, d).java)


@query()
def q_java_structure(spark, d):
    return _once(spark, d).java.select("scan_id", "rel_path", "kind", "name", "owner", "line", "end_line", "modifiers", "params")


def _all(language: str):
    def run(spark, d):
        # what is kept, and lexed, is files of the rules' language only
        return run_rules(Facts(files(spark, d).filter(F.col("language") == language)), [r.code for r in REGISTRY.values() if r.language == language])

    return run


Q["q_py_rules"], Q["q_java_rules"], Q["q_config_rules"] = _all("python"), _all("java"), _all("config")


@query()
def q_py_token_clones(spark, d):
    w = clones.windows(clones.normalised(_once(spark, d).tokens(*TOKEN_FIELDS)))
    return clones.token_clones(w)


@query()
def q_py_ast_clones(spark, d):
    return clones.shape_clones(_once(spark, d).python(FUNCTIONS, *SHAPE_FIELDS))


@query()
def q_java_ast_clones(spark, d):
    f = _once(spark, d).java.filter("kind = 'method'")
    return clones.shape_clones(f.withColumn("skeleton", F.sha2("shape", 256)))


@query()
def q_merged_clones(spark, d):
    f = _once(spark, d)
    shapes = clones.shape_clones(f.python(FUNCTIONS, *SHAPE_FIELDS))
    return clones.merged_clones(clones.token_clones(clones.windows(clones.normalised(f.tokens(*TOKEN_FIELDS)))), stored(shapes)[0])


def uml_classes(spark, d) -> DataFrame:
    fields = ("node_id", "kind", "name", "bases", "class_id", "field", "qname")
    n, _ = stored(_once(spark, d).python((*FUNCTIONS, "ClassDef", "Attribute"), *fields).filter("kind <> 'Attribute' or (field = 'targets' and qname = 'self')"))
    c = n.filter("kind = 'ClassDef'").select("scan_id", "rel_path", F.col("node_id").alias("class_id"), "name", F.col("bases").alias("parents"))
    m = n.filter("kind in ('FunctionDef', 'AsyncFunctionDef') and class_id is not null").groupBy("scan_id", "rel_path", "class_id").agg(F.array_sort(F.collect_set("name")).alias("methods"))
    s = n.filter("kind = 'Attribute' and field = 'targets' and qname = 'self' and class_id is not null").groupBy("scan_id", "rel_path", "class_id").agg(F.array_sort(F.collect_set("name")).alias("fields"))
    none = F.array().cast("array<string>")
    return c.join(m, ["scan_id", "rel_path", "class_id"], "left").join(s, ["scan_id", "rel_path", "class_id"], "left").withColumn("methods", F.coalesce("methods", none)).withColumn("fields", F.coalesce("fields", none))


@query()
def q_uml(spark, d):
    return uml_classes(spark, d).drop("class_id")


@query()
def q_mermaid(spark, d):
    return reports.mermaid(uml_classes(spark, d))


@query()
def q_py_call_graph(spark, d):
    n, _ = stored(_once(spark, d).python((*FUNCTIONS, "Call"), "node_id", "kind", "name", "qname", "funcs"))
    f = n.filter("kind in ('FunctionDef', 'AsyncFunctionDef')")
    calls = n.filter("kind = 'Call' and name is not null and size(funcs) > 0").select("scan_id", "rel_path", F.element_at("funcs", -1).alias("node_id"), F.col("name").alias("callee"))
    calls = calls.join(f.select("scan_id", "rel_path", "node_id", F.col("qname").alias("caller")), ["scan_id", "rel_path", "node_id"])
    return graph.call_links(f.select("scan_id", "rel_path", "name", "qname"), calls)


@query()
def q_full_scan(spark, d):
    from quarry.plans.scan import scan

    return scan(files(spark, d)).totals


@query()
def q_arch_edges(spark, d):
    from quarry.plans.scan import architecture_facts

    return architecture_facts(files(spark, d))["edges"]


@query()
def q_arch_symbols(spark, d):
    from quarry.plans.scan import architecture_facts

    return architecture_facts(files(spark, d))["symbols"]


@query()
def q_arch_calls(spark, d):
    from quarry.plans.scan import architecture_facts

    return architecture_facts(files(spark, d))["calls"]


@query()
def q_arch_violations(spark, d):
    from quarry.plans.scan import architecture_scan

    return architecture_scan(files(spark, d))["violations"]


@query()
def q_arch_radar(spark, d):
    from quarry.plans.scan import architecture_scan

    return architecture_scan(files(spark, d))["radar"]


@query(f"""WITH d AS (SELECT DISTINCT scan_id, unnest(string_split(file_path, '/')[1:3]) AS d FROM {PATHS_SQL}),
n AS (SELECT scan_id, count_if(d IN ('controllers', 'models', 'views')) AS mvc, count_if(d IN ('routers', 'services', 'engines', 'models', 'schemas')) AS hits FROM d GROUP BY scan_id)
SELECT scan_id, 'mvc' AS pattern, 0.9::DOUBLE AS confidence FROM n WHERE mvc = 3 UNION ALL SELECT scan_id, 'layered', round(0.6 + 0.08 * hits, 2)::DOUBLE FROM n WHERE hits >= 3""")
def q_directory_styles(spark, d):
    return A.directory_styles(derived.modules(spark, d))


@query()
def q_module_edges(spark, d):
    from quarry.plans.scan import dependency_graph

    return dependency_graph(files(spark, d))["edges"]


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def q_progress_stream(spark, d):
    """The stream's result after all that is there was read, written by each batch; the same rows as the batch form."""
    counts = progress.windowed_counts(_events(spark, d))
    place = _stream_folder(spark)
    stream = counts.writeStream.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{place}/counts"))
    stream.option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/counts").select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


_SILENCE, _LATE = int(progress.SILENCE.total_seconds()), 600
_EVENT = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'file' END"


@query(f"""WITH e AS (SELECT user_id * 100 + day(ts) AS scan_id, ts, {_EVENT} AS event, printf('f%06d', event_id) AS file, CAST(floor(value) AS BIGINT) AS total FROM events),
s AS (SELECT scan_id, count_if(event = 'file') AS files, coalesce(max(total) FILTER (event = 'start'), 0) AS total, max_by(file, (ts, file)) FILTER (event = 'file') AS current_file, max(ts) AS updated,
min_by(event, (ts, event)) FILTER (event IN ('done', 'failed')) AS told FROM e GROUP BY scan_id),
x AS (SELECT *, coalesce(told, CASE WHEN updated + INTERVAL {_SILENCE} SECOND < (SELECT max(ts) FROM events) - INTERVAL {_LATE} SECOND THEN 'failed' WHEN files + total > 0 THEN 'running' ELSE 'pending' END) AS status FROM s)
SELECT scan_id, status, round(CASE WHEN status = 'done' THEN 1.0 WHEN total > 0 THEN 0.85 * least(files, total) / total WHEN files > 0 THEN 0.85 ELSE 0.0 END, 6) AS progress, files, total, current_file, updated FROM x""")
def q_scan_progress(spark, d):
    """Scans (a user's day) whose events are a stream: the store's rows after all that is there was read."""
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("file")
    events = _events(spark, d).select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("scan_id"), "ts", kind.alias("event"), F.format_string("f%06d", "event_id").alias("file"), F.floor("value").cast("bigint").alias("total"),
    )
    place = _stream_folder(spark)
    store = ScanStore(spark, f"{place}/store")
    progress.keep_progress(progress.scan_progress(events), store, f"{place}/checkpoint").awaitTermination()
    return store.read("progress").select("scan_id", "status", F.round("progress", 6).alias("progress"), "files", "total", "current_file", F.col("updated").cast("timestamp_ntz").alias("updated"))


def _events(spark, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    # the table is a file, or a folder of files
    return progress.event_stream(spark, f"{d}/events.parquet*", schema, recursiveFileLookup="true")


def _stream_folder(spark) -> str:
    import uuid

    from quarry.plans.session import checkpoint_dir

    checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stream-{uuid.uuid4().hex[:12]}"
