"""SQL of the queries on the scan store, for comparison only; ``store_plans`` has the queries.

The tables stand in for those of a scan store: ``events`` for findings (type = rule, user = file), ``lineitem`` for
function measures, ``orders``/``customer``/``nation`` for scans, versions and projects, ``part`` for rules.
"""

from __future__ import annotations

#: Findings: severity and category derived from the event.
ISSUES = """(SELECT event_id, event_type AS rule_code, user_id AS file_id, CAST(floor(value) AS INT) AS line,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type IN ('purchase', 'signup') THEN 'warning' ELSE 'info' END AS severity,
  CASE WHEN event_id % 3 = 0 THEN 'style' WHEN event_id % 3 = 1 THEN 'dead' ELSE 'naming' END AS category FROM events)"""
#: Function measures.
METRICS = """(SELECT l_orderkey AS file_id, l_linenumber AS pos, l_partkey AS fn, CAST(l_quantity AS INT) AS cyclomatic,
  CAST(floor(l_extendedprice / 5000) AS INT) AS cognitive, CAST(floor(l_extendedprice / 1000) AS INT) AS lines FROM lineitem)"""

SHARED: dict[str, str] = {
    "q_issue_list": f"""SELECT i.event_id, c.c_name AS file_path, i.rule_code, i.severity, i.line FROM {ISSUES} i
        JOIN customer c ON c.c_custkey = i.file_id WHERE i.severity <> 'info' ORDER BY i.severity DESC, i.line, i.event_id LIMIT 500 OFFSET 20""",
    "q_issue_by_severity": f"SELECT severity, count(*) AS n FROM {ISSUES} i GROUP BY severity",
    "q_issue_by_category": f"SELECT category, count(*) AS n FROM {ISSUES} i GROUP BY category",
    "q_issue_by_id": f"SELECT event_id, rule_code, severity, line FROM {ISSUES} i WHERE event_id = 77",
    "q_top_rules": "SELECT l_partkey AS rule_id, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, rule_id LIMIT 20",
    "q_top_files": f"""SELECT c.c_name AS file_path, count(*) AS n, greatest(0, 100 - 3 * count(*)) AS health FROM {ISSUES} i
        JOIN customer c ON c.c_custkey = i.file_id GROUP BY c.c_name ORDER BY n DESC, file_path LIMIT 20""",
    "q_file_health": f"""SELECT c.c_custkey AS file_id, coalesce(i.n, 0) AS issues, greatest(0, 100 - 3 * coalesce(i.n, 0)) AS health
        FROM customer c LEFT JOIN (SELECT file_id, count(*) AS n FROM {ISSUES} x GROUP BY file_id) i ON i.file_id = c.c_custkey""",
    "q_scan_totals": f"""SELECT file_id, count(*) AS functions, round(avg(cyclomatic), 2) AS avg_complexity, max(cyclomatic) AS max_complexity,
        CAST(sum(lines) AS BIGINT) AS loc FROM {METRICS} m GROUP BY file_id""",
    "q_complexity_rank": f"""SELECT m.file_id, m.pos, p.p_name AS function_name, m.cyclomatic, m.cognitive FROM {METRICS} m
        JOIN part p ON p.p_partkey = m.fn ORDER BY m.cyclomatic DESC, m.file_id, m.pos, function_name, m.cognitive LIMIT 50""",
    "q_latest_scan": """SELECT n_name, c_name, o_orderkey, o_totalprice FROM (SELECT n.n_name, c.c_name, o.o_orderkey, o.o_totalprice,
        row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rn FROM orders o
        JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderstatus = 'F') x WHERE rn = 1""",
    "q_version_count": """SELECT n.n_nationkey, n.n_name, count(c.c_custkey) AS versions FROM nation n
        LEFT JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000 GROUP BY n.n_nationkey, n.n_name""",
    "q_previous_scan": """SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, round(o_totalprice - lag(o_totalprice) OVER w, 2) AS delta
        FROM orders WHERE o_orderstatus = 'F' WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "q_scan_picker": """SELECT o.o_orderkey AS scan_id, c.c_name AS version, n.n_name AS project, o.o_orderstatus AS status FROM orders o
        JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey""",
    "q_scans_of_version": "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey DESC",
    "q_metrics_in_files": f"SELECT file_id, pos, fn, cyclomatic FROM {METRICS} m WHERE file_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "q_rule_stats": """SELECT p_brand AS language, p_type AS severity, count(*) AS n, CAST(sum(CASE WHEN p_size % 4 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS enabled,
        CAST(sum(CASE WHEN p_size % 4 > 0 THEN 0 ELSE 1 END) AS BIGINT) AS disabled FROM part GROUP BY p_brand, p_type""",
    "q_rule_filter": "SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' AND lower(p_name) LIKE '%ring%' AND p_type = 'ECONOMY' ORDER BY p_partkey",
    "q_project_search": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'HOUSEHOLD' AND contains(lower(c_name), '00001')",
    "q_project_delete": "SELECT count(*) AS kept FROM customer c WHERE NOT EXISTS (SELECT 1 FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1)",
    "q_risk_bucket": f"""SELECT CASE WHEN cyclomatic <= 5 THEN 'low' WHEN cyclomatic <= 10 THEN 'medium' WHEN cyclomatic <= 20 THEN 'high' ELSE 'critical' END AS risk,
        count(*) AS n FROM {METRICS} m GROUP BY 1""",
    "q_grade": """SELECT CASE WHEN v >= 90 THEN 'A' WHEN v >= 75 THEN 'B' WHEN v >= 60 THEN 'C' ELSE 'D' END AS grade, count(*) AS n
        FROM (SELECT value % 101 AS v FROM events) x GROUP BY 1""",
    "q_complexity_score": f"""SELECT file_id, round(greatest(0.0, least(100.0, 100.0 - 1000.0 * (10 * crit + 5 * high + 2 * med) / loc)), 2) AS score
        FROM (SELECT file_id, sum(CASE WHEN cyclomatic > 20 THEN 1 ELSE 0 END) AS crit, sum(CASE WHEN cyclomatic BETWEEN 11 AND 20 THEN 1 ELSE 0 END) AS high,
        sum(CASE WHEN cyclomatic BETWEEN 6 AND 10 THEN 1 ELSE 0 END) AS med, CAST(greatest(1, sum(lines)) AS DOUBLE) AS loc FROM {METRICS} m GROUP BY file_id) x""",
    "q_method_span": """SELECT l_orderkey, l_linenumber, l_partkey, (lead(l_linenumber, 1, 8) OVER w) - l_linenumber AS span FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)""",
    "q_go_averages": "SELECT round(avg(fi), 4) AS avg_fan_in, round(avg(fo), 4) AS avg_fan_out FROM (SELECT c_nationkey AS k, count(*) AS fi, count(DISTINCT c_mktsegment) AS fo FROM customer GROUP BY c_nationkey) x",
    "q_radar_delta": """SELECT o_custkey, o_orderkey, round(s, 1) AS score, round(s - lag(s) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 1) + 0.0 AS delta
        FROM (SELECT o_custkey, o_orderkey, o_orderdate, greatest(0.0, 100.0 - o_totalprice / 5000) AS s FROM orders) x""",
    "q_exact_clones": "SELECT sha256(text) AS fingerprint, count(*) AS occurrences, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "q_arch_table_reads": "SELECT 'modules' AS kind, count(*) AS n FROM part UNION ALL SELECT 'edges', count(*) FROM lineitem UNION ALL SELECT 'symbols', count(*) FROM orders",
}
