"""Named queries on the scan store: the library's reads over the driver's tables; ``shared_sql`` has their SQL.

The tables stand in for those of a store: ``events`` for findings (type = rule, user = file), ``lineitem`` for function
measures, ``orders``/``customer``/``nation`` for scans, versions and projects, ``part`` for rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.operators import architecture, clones, rules, scoring, store
from quarry.plans.shared_sql import SHARED

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


class Store:
    """The store's tables, from those of ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def issues(self) -> DataFrame:
        kind, rest = F.col("event_type"), F.pmod("event_id", F.lit(3))
        return self.table("events").select(
            F.col("event_id").alias("issue_id"), F.col("user_id").alias("file_id"), kind.alias("rule_code"), F.floor("value").cast("int").alias("line"),
            F.when(kind == "error", "error").when(kind.isin("purchase", "signup"), "warning").otherwise("info").alias("severity"),
            F.when(rest == 0, "style").when(rest == 1, "dead").otherwise("naming").alias("category"),
        )

    @property
    def files(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("file_id"), F.col("c_name").alias("file_path"))

    @property
    def metrics(self) -> DataFrame:
        price = F.col("l_extendedprice")
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("fn"), F.col("l_quantity").cast("int").alias("cyclomatic"),
            F.floor(price / 5000).cast("int").alias("cognitive"), F.floor(price / 1000).cast("int").alias("lines"),
        )

    @property
    def scans(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "F", store.DONE).otherwise(F.col("o_orderstatus"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("version_id"), status.alias("status"), F.col("o_orderdate").alias("started"),
            F.col("o_totalprice").alias("price"), "o_orderstatus", "o_orderpriority",
        )

    @property
    def versions(self) -> DataFrame:
        return self.table("customer").select(F.col("c_custkey").alias("version_id"), F.col("c_nationkey").alias("project_id"), F.col("c_name").alias("version"), "c_acctbal")

    @property
    def projects(self) -> DataFrame:
        return self.table("nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("project"), "n_regionkey")

    @property
    def rules(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("code"), F.col("p_name").alias("name"), F.col("p_brand").alias("language"), F.col("p_type").alias("severity"),
            (F.pmod("p_size", F.lit(4)) > 0).alias("enabled"),
        )


def query(f: Callable[[Store], DataFrame]) -> Callable[[Store], DataFrame]:
    Q[f.__name__] = lambda spark, folder: f(Store(spark, folder))
    return f


@query
def q_issue_list(s):
    return store.issue_list(s.issues, s.files, F.col("severity") != "info", offset=20).withColumnRenamed("issue_id", "event_id")


@query
def q_issue_by_severity(s):
    return store.summary(s.issues).filter("dimension = 'severity'").select(F.col("value").alias("severity"), "n")


@query
def q_issue_by_category(s):
    return store.summary(s.issues).filter("dimension = 'category'").select(F.col("value").alias("category"), "n")


@query
def q_issue_by_id(s):
    return store.issue(s.issues, 77).select(F.col("issue_id").alias("event_id"), "rule_code", "severity", "line")


@query
def q_top_rules(s):
    return store.top_by(s.metrics.select(F.col("fn").alias("rule_id")), "rule_id")


@query
def q_top_files(s):
    return store.top_files(s.issues, s.files)


@query
def q_file_health(s):
    return store.files_with_health(s.issues, s.files).select("file_id", "issues", "health")


@query
def q_scan_totals(s):
    return store.function_totals(s.metrics).select("file_id", "functions", "avg_complexity", "max_complexity", "loc")


@query
def q_complexity_rank(s):
    named = s.metrics.join(s.rules.select(F.col("code").alias("fn"), F.col("name").alias("function_name")), "fn")
    return store.complexity_rank(named).select("file_id", "pos", "function_name", "cyclomatic", "cognitive")


@query
def q_latest_scan(s):
    rows = store.scan_list(store.latest_scans(s.scans), s.versions, s.projects).select("scan_id", "version", "project")
    return rows.join(s.scans.select("scan_id", "price"), "scan_id").select(
        F.col("project").alias("n_name"), F.col("version").alias("c_name"), F.col("scan_id").alias("o_orderkey"), F.col("price").alias("o_totalprice")
    )


@query
def q_version_count(s):
    rows = store.version_counts(s.projects, s.versions.filter("c_acctbal > 5000"))
    return rows.select(F.col("project_id").alias("n_nationkey"), F.col("project").alias("n_name"), "versions")


@query
def q_previous_scan(s):
    rows = store.with_previous(s.scans, ["price"])
    return rows.select(F.col("scan_id").alias("o_orderkey"), "previous", F.round("price_delta", 2).alias("delta"))


@query
def q_scan_picker(s):
    scans = s.scans.withColumn("status", F.col("o_orderstatus"))
    return store.scan_list(scans, s.versions, s.projects).select("scan_id", "version", "project", "status")


@query
def q_scans_of_version(s):
    return store.scans_of(s.scans, 7).select(F.col("scan_id").alias("o_orderkey"), F.col("started").alias("o_orderdate"), "o_orderstatus")


@query
def q_metrics_in_files(s):
    urgent = s.scans.filter("o_orderpriority = '1-URGENT'").select(F.col("scan_id").alias("file_id"))
    return store.metrics_of(s.metrics, urgent).select("file_id", "pos", "fn", "cyclomatic")


@query
def q_rule_stats(s):
    return rules.rule_stats(s.rules)


@query
def q_rule_filter(s):
    rows = store.rule_list(s.rules, "ring", language="Brand#2", severity="ECONOMY")
    return rows.select(F.col("code").alias("p_partkey"), F.col("name").alias("p_name"))


@query
def q_project_search(s):
    rows = s.table("customer").select(F.col("c_custkey"), F.col("c_name").alias("project"), F.col("c_mktsegment").alias("segment"))
    return store.project_list(rows, "00001", segment="HOUSEHOLD").select("c_custkey", F.col("project").alias("c_name"))


@query
def q_project_delete(s):
    return store.without_projects(s.versions, s.projects.filter("n_regionkey = 1")).agg(F.count(F.lit(1)).alias("kept"))


@query
def q_risk_bucket(s):
    return store.risk_buckets(s.metrics)


@query
def q_grade(s):
    scores = s.table("events").select(scoring.grade(F.col("value") % 101).alias("grade"))
    return store.count_by(scores, "grade")


@query
def q_complexity_score(s):
    return store.complexity_scores(s.metrics)


@query
def q_method_span(s):
    rows = s.table("lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", architecture.span("l_linenumber", 8, w).alias("span"))


@query
def q_go_averages(s):
    return architecture.average_fans(s.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("fan_in"), F.countDistinct("c_mktsegment").alias("fan_out")))


@query
def q_radar_delta(s):
    scored = s.scans.withColumn("score", F.greatest(F.lit(0.0), 100.0 - F.col("price") / 5000))
    rows = store.with_previous(scored, ["score"], status=None)
    return rows.select(
        F.col("version_id").alias("o_custkey"), F.col("scan_id").alias("o_orderkey"), scoring.tenths(F.col("score")).alias("score"),
        (scoring.tenths(F.col("score_delta")) + 0.0).alias("delta"),
    )


@query
def q_exact_clones(s):
    return clones.equal_texts(s.table("documents"), "doc_id", "text").withColumnRenamed("first", "first_doc")


@query
def q_arch_table_reads(s):
    return store.table_counts({"modules": s.table("part"), "edges": s.table("lineitem"), "symbols": s.table("orders")})


assert Q.keys() == SHARED.keys()
