"""Named queries on what a front end draws, and on the radar's counts.

Nations stand in for modules, their regions for top directories; customers for files and their orders for functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import config as C
from quarry.operators import architecture, payloads
from quarry.plans.graph_plans import RAW, REACH, heavy_nations

Q: dict = {}
SQL: dict[str, str] = {}
_DIRS = ("controllers", "services", "models", "dao", "infra")


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _modules(spark, d: str, prefix: str = "") -> DataFrame:
    place = F.element_at(F.array(*[F.lit(x) for x in _DIRS]), F.col("n_regionkey").cast("int") + 1)
    return _read(spark, d, "nation").select(
        F.lit(1).cast("bigint").alias("scan_id"), F.format_string(prefix + "%02d", "n_nationkey").alias("module_id"),
        F.concat(place, F.lit("/"), F.lower("n_name"), F.lit(".py")).alias("file_path"), (F.col("n_nationkey") * 90).cast("int").alias("loc"), F.col("n_nationkey").alias("seen"),
    )


def _raw(spark, d: str, prefix: str = "") -> DataFrame:
    """One row for each line item, from its supplier's nation to its customer's: imports as they are written."""
    rows = _read(spark, d, "lineitem").join(_read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(_read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(_read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.lit(1).cast("bigint").alias("scan_id"), F.format_string(prefix + "%02d", "s_nationkey").alias("src"), F.format_string(prefix + "%02d", "c_nationkey").alias("dst"),
        F.lit("import").alias("kind"), F.lit(1).alias("count"), F.lit(False).alias("is_wildcard"),
    )


_M = f"m AS (SELECT n_nationkey AS k, printf('%02d', n_nationkey) AS module_id, [{', '.join(repr(x) for x in _DIRS)}][n_regionkey + 1] AS dir, lower(n_name) || '.py' AS name, n_nationkey * 90 AS loc FROM nation)"
_CAT = "cat AS (SELECT dir, row_number() OVER (ORDER BY min(k)) - 1 AS category FROM m GROUP BY dir)"


@query(f"""WITH {REACH}, {_M}, {_CAT} SELECT module_id, dir || '/' || name AS file_path, name, dir AS category_name, category, loc, greatest(8.0, least(60.0, loc / 10.0 + 12)) AS size,
(SELECT count(DISTINCT src) FROM e WHERE dst = module_id) AS fan_in, (SELECT count(DISTINCT dst) FROM e WHERE src = module_id) AS fan_out,
EXISTS (SELECT 1 FROM reach WHERE src = module_id AND dst = module_id) AS in_cycle FROM m JOIN cat USING (dir)""")
def q_graph_nodes(spark, d):
    return payloads.graph_nodes(_modules(spark, d), heavy_nations(spark, d)).drop("scan_id")


@query(f"""WITH RECURSIVE raw AS (SELECT printf('%02d', a) AS src, printf('%02d', b) AS dst FROM {RAW} r), e AS (SELECT DISTINCT src, dst FROM raw WHERE src <> dst),
reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst), {_M}, {_CAT}
SELECT 'n.' || module_id AS module_id, dir || '/' || name AS file_path, module_id AS name, dir AS category_name, category, loc, least(60, 12 + CAST(floor(sqrt(loc)) AS INT)) AS size,
(SELECT count(*) FROM raw WHERE dst = module_id) AS fan_in, (SELECT count(*) FROM raw WHERE src = module_id) AS fan_out,
EXISTS (SELECT 1 FROM reach WHERE src = module_id AND dst = module_id) AS in_cycle FROM m JOIN cat USING (dir)""")
def q_dotted_nodes(spark, d):
    return payloads.dotted_nodes(_modules(spark, d, "n."), _raw(spark, d, "n.")).drop("scan_id")


@query(f"WITH raw AS (SELECT * FROM {RAW} r) SELECT printf('%02d', n_nationkey) AS module_id, (SELECT count(*) FROM raw WHERE b = n_nationkey) AS fan_in, (SELECT count(*) FROM raw WHERE a = n_nationkey) AS fan_out FROM nation")
def q_raw_fans(spark, d):
    return payloads.raw_fans(_modules(spark, d), _raw(spark, d)).drop("scan_id")


@query("SELECT version_id, rel_path, o_orderkey FROM (SELECT o_custkey AS version_id, o_orderpriority AS rel_path, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def q_first_per_path(spark, d):
    rows = _read(spark, d, "orders").select(F.col("o_custkey").alias("version_id"), F.col("o_orderpriority").alias("rel_path"), "o_orderkey")
    return payloads.first_per_path(rows, "o_orderkey")


@query("SELECT page_id, CASE WHEN dir = '' THEN 'root' ELSE dir END AS category_name FROM (SELECT page_id, split_part(regexp_replace(url, '^https?://[^/]*/?', ''), '/', 1) AS dir FROM pages)")
def q_top_directory(spark, d):
    path = F.regexp_replace("url", "^https?://[^/]*/?", "")
    return _read(spark, d, "pages").select("page_id", payloads.top_directory(path).alias("category_name"))


@query("""WITH f AS (SELECT o_custkey, o_orderkey, o_orderpriority AS name, greatest(1, CAST(floor(o_totalprice / 1000) AS BIGINT) + 1) AS value, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, name ORDER BY pos DESC) AS n FROM f WHERE pos <= 60) WHERE n = 1),
x AS (SELECT o_custkey, name, min(o_orderkey) AS first FROM f GROUP BY o_custkey, name)
SELECT o_custkey || '/' || name AS path, value, CAST(first % 30 AS INT) AS color FROM l JOIN x USING (o_custkey, name)
UNION ALL SELECT CAST(c_custkey AS VARCHAR), greatest(1, c_nationkey), CAST(c_custkey % 9 AS INT) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def q_function_leaves(spark, d):
    scan = F.lit(1).cast("bigint").alias("scan_id")
    files = _read(spark, d, "customer").select(scan, F.col("c_custkey").cast("string").alias("rel_path"), F.col("c_nationkey").alias("total_lines"), (F.col("c_custkey") % 9).alias("issues"))
    o = _read(spark, d, "orders").withColumn("rel_path", F.col("o_custkey").cast("string"))
    functions = o.select(scan, "rel_path", F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("name"), F.lit(1).alias("start_line"), (F.floor(F.col("o_totalprice") / 1000) + 1).alias("end_line"))
    metrics = o.select(scan, "rel_path", F.col("o_orderpriority").alias("function_name"), F.col("o_orderkey").alias("pos"), (F.col("o_orderkey") % 30).alias("cyclomatic"))
    return payloads.function_leaves(files, functions, metrics).drop("scan_id")


@query("""SELECT c_custkey, concat_ws(' ', printf('Score %.1f (grade %s).', score, grade), printf('%d issues: %d errors, %d warnings, %d hints.', 3 * k, k, k, k),
CASE WHEN k % 3 > 0 THEN printf('%d duplicated blocks, rate %.1f%%.', k % 3, 25.0 * (k % 4)) END, CASE WHEN k % 2 > 0 THEN printf('%d complex functions, the highest at %d.', k % 2, k) END,
CASE WHEN grade IN ('A', 'B') THEN 'The code is in good order.' WHEN grade = 'C' THEN 'The code is fair: mend errors and warnings first.' ELSE 'The code has many problems: mend errors, duplication and complexity first.' END) AS summary
FROM (SELECT c_custkey, c_nationkey AS k, CAST(c_custkey % 1000 AS DOUBLE) / 10 AS score, CASE WHEN c_custkey % 1000 >= 900 THEN 'A' WHEN c_custkey % 1000 >= 750 THEN 'B' WHEN c_custkey % 1000 >= 600 THEN 'C' ELSE 'D' END AS grade FROM customer)""")
def q_summary_sentence(spark, d):
    from quarry.operators.scoring import grade

    k, score = F.col("c_nationkey"), (F.col("c_custkey") % 1000).cast("double") / 10
    rows = _read(spark, d, "customer").select(
        "c_custkey", score.alias("overall"), grade(score).alias("grade"), (k * 3).alias("issues"), k.alias("errors"), k.alias("warnings"), k.alias("infos"),
        (k % 3).alias("duplicates"), ((k % 4) / 4).alias("dup_rate"), (k % 2).alias("complex"), k.alias("max_complexity"),
    )
    return rows.select("c_custkey", payloads.summary_sentence().alias("summary"))


_RANK = f"CASE dir {' '.join(f'WHEN {x!r} THEN {architecture.RADAR_RANKS[name]}' for x in _DIRS for name, words in C.RADAR_LAYERS if x in words)} END"


@query(f"""WITH {REACH}, {_M}, r AS (SELECT module_id, dir, {_RANK} AS rank FROM m),
p AS (SELECT s.dir AS sd, t.dir AS td, s.rank AS sr, t.rank AS tr FROM e JOIN r s ON s.module_id = e.src JOIN r t ON t.module_id = e.dst)
SELECT (SELECT count(*) FROM m) AS modules, count(*) AS edges, count(*) AS out_edges, count_if(sr IS NOT NULL AND tr IS NOT NULL) AS classified, count_if(sr > tr) AS reverse, count_if(sd = td) AS intra, count_if(sd <> td) AS inter,
(SELECT count(*) FROM reach WHERE src = dst) AS cyclic, (SELECT least(100.0, 40.0 + 15.0 * count(DISTINCT dir)) FROM m WHERE dir IN ({', '.join(repr(w) for w in C.CLARITY_DIRS)})) AS clarity FROM p""")
def q_radar_inputs(spark, d):
    none = _modules(spark, d).select("scan_id").distinct().select("scan_id", F.lit(0).alias("issues"), F.lit(0).alias("loc"), F.lit(0.0).alias("dup_rate"))
    return payloads.radar_inputs(_modules(spark, d), heavy_nations(spark, d), none).drop("scan_id", "issues", "loc", "dup_rate")


@query()
def q_undocumented_lines(spark, d):
    """No SQL: a fold over lines; tested against a loop."""
    return _read(spark, d, "documents").select("doc_id", payloads.undocumented_lines(F.col("text")).alias("loc"))
