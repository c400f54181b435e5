"""Reads of the scan store: findings, measures, scans, versions, projects and rules, as lazy DataFrames.

Tables and their columns (others are ignored):

* issues: issue_id, file_id, rule_code, severity, category, line
* files: file_id, file_path
* metrics: file_id, pos, function_name, cyclomatic, cognitive, lines
* scans: scan_id, version_id, status, started
* versions: version_id, project_id, version
* projects: project_id, project
* rules: code, name, language, severity, enabled

Every ordering ends in a key, so pages and top lists are the same in every run; limits are those of the interface.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.complexity import risk_level
from quarry.operators.scoring import complexity_score, file_health

TOP = 20
MOST_ISSUES, MOST_METRICS = 500, 50
DONE = "done"


def _matches(filters: dict[str, object]) -> Column:
    """Equality with every filter that is given (not None)."""
    return reduce(Column.__and__, [F.col(k) == v for k, v in filters.items() if v is not None], F.lit(True))


def issue_list(issues: DataFrame, files: DataFrame, where: Column | None = None, limit: int = MOST_ISSUES, offset: int = 0, **filters) -> DataFrame:
    """A page of findings with their paths, by severity (last name first), line and id; findings without a file are left out."""
    rows = issues.filter(_matches(filters) if where is None else _matches(filters) & where)
    rows = rows.join(files.select("file_id", "file_path"), "file_id")
    rows = rows.orderBy(F.desc("severity"), "line", "issue_id").offset(offset).limit(limit)
    return rows.select("issue_id", "file_path", "rule_code", "severity", "line")


def issue(issues: DataFrame, issue_id: int) -> DataFrame:
    return issues.filter(F.col("issue_id") == issue_id)


def count_by(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def top_by(rows: DataFrame, key: str, limit: int = TOP) -> DataFrame:
    """The values of ``key`` that most rows have, of equal counts the first value."""
    return count_by(rows, key).orderBy(F.desc("n"), key).limit(limit)


def summary(issues: DataFrame) -> DataFrame:
    """``dimension, value, n``: findings by severity and by category, in one pass."""
    rows = issues.groupingSets([[F.col("severity")], [F.col("category")]], "severity", "category").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("severity", "category").alias("g"))
    return rows.select(F.when(F.col("g") == 1, "severity").otherwise("category").alias("dimension"), F.coalesce("severity", "category").alias("value"), "n")


def files_with_health(issues: DataFrame, files: DataFrame) -> DataFrame:
    """Every file with its findings and health; files without findings are whole."""
    counts = count_by(issues, "file_id").withColumnRenamed("n", "issues")
    rows = files.join(counts, "file_id", "left").fillna(0, ["issues"])
    return rows.withColumn("health", file_health(F.col("issues")))


def top_files(issues: DataFrame, files: DataFrame, limit: int = TOP) -> DataFrame:
    rows = issues.join(files.select("file_id", "file_path"), "file_id")
    return top_by(rows, "file_path", limit).withColumn("health", file_health(F.col("n")))


def function_totals(metrics: DataFrame) -> DataFrame:
    """Per file: functions, average and greatest complexity, lines, and the functions of each risk."""
    risk = risk_level(F.col("cyclomatic"))
    return metrics.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("functions"), F.round(F.avg("cyclomatic"), 2).alias("avg_complexity"), F.max("cyclomatic").alias("max_complexity"),
        F.sum("lines").alias("loc"), *[F.count_if(risk == r).alias(r) for r in ("critical", "high", "medium")],
    )


def complexity_scores(metrics: DataFrame) -> DataFrame:
    """Per file the score of its functions; a file has at least one line."""
    loc = F.greatest(F.lit(1), F.col("loc")).cast("double")
    return function_totals(metrics).select("file_id", complexity_score(F.col("critical"), F.col("high"), F.col("medium"), loc).alias("score"))


def complexity_rank(metrics: DataFrame, limit: int = MOST_METRICS) -> DataFrame:
    """The most complex functions."""
    return metrics.orderBy(F.desc("cyclomatic"), "file_id", "pos", "function_name", "cognitive").limit(limit)


def metrics_of(metrics: DataFrame, files: DataFrame) -> DataFrame:
    """Measures of the given files."""
    return metrics.join(files.select("file_id"), "file_id", "left_semi")


def risk_buckets(metrics: DataFrame) -> DataFrame:
    return count_by(metrics.select(risk_level(F.col("cyclomatic")).alias("risk")), "risk")


def scan_list(scans: DataFrame, versions: DataFrame, projects: DataFrame) -> DataFrame:
    """Scans with the names of their version and project, for pickers."""
    return scans.join(versions, "version_id").join(projects, "project_id").select("scan_id", "version_id", "version", "project_id", "project", "status", "started")


def latest_scans(scans: DataFrame, key: str = "version_id", status: str = DONE) -> DataFrame:
    """The last finished scan of each ``key``; of equal times that of the greatest id. One aggregate, without a sort."""
    last = F.max_by(F.struct(*[c for c in scans.columns if c != key]), F.struct("started", "scan_id"))
    return scans.filter(F.col("status") == status).groupBy(key).agg(last.alias("s")).select(key, "s.*")


def with_previous(scans: DataFrame, values: list[str], key: str = "version_id", status: str | None = DONE) -> DataFrame:
    """Scans with the one before of the same ``key`` and ``values`` less those of that one."""
    rows = scans if status is None else scans.filter(F.col("status") == status)
    w = Window.partitionBy(key).orderBy("started", "scan_id")
    return rows.select("*", F.lag("scan_id").over(w).alias("previous"), *[(F.col(v) - F.lag(v).over(w)).alias(f"{v}_delta") for v in values])


def scans_of(scans: DataFrame, version_id: int) -> DataFrame:
    """A version's scans, the last first."""
    return scans.filter(F.col("version_id") == version_id).orderBy(F.desc("started"), F.desc("scan_id"))


def version_counts(projects: DataFrame, versions: DataFrame) -> DataFrame:
    """Every project with the number of its versions."""
    counts = versions.groupBy("project_id").agg(F.count("version_id").alias("versions"))
    return projects.join(counts, "project_id", "left").fillna(0, ["versions"]).select("project_id", "project", "versions")


def rule_list(rules: DataFrame, text: str | None = None, **filters) -> DataFrame:
    """Rules that meet all filters and whose name or code holds ``text``, whatever its case."""
    rows = rules.filter(_matches(filters))
    if text:
        rows = rows.filter(F.lower("name").contains(text.lower()) | F.lower(F.col("code").cast("string")).contains(text.lower()))
    return rows.orderBy("code")


def project_list(projects: DataFrame, text: str | None = None, **filters) -> DataFrame:
    rows = projects.filter(_matches(filters))
    return rows.filter(F.lower("project").contains(text.lower())) if text else rows


def without_projects(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """What stays of a table when projects go: rows of every other project."""
    return rows.join(gone.select("project_id"), "project_id", "left_anti")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``kind, n``: the rows of each table of an architecture scan."""
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def health(spark) -> dict[str, object]:
    """What the service says about itself."""
    from quarry.operators.rules import REGISTRY

    return {"status": "ok", "engine": f"spark {spark.version}", "rules": len(REGISTRY)}
